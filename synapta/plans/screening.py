"""Motion screening, cohort algebra and ordered series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from synapta import functions as fn
from synapta.operators import cohort, motion
from synapta.operators.scans import scan
from synapta.plans.base import FRAMES, RUNS, frames, query, read
from synapta.sources import io

RUN_KEYS = ["click", "error", "purchase", "signup", "view"]
_VALID = "(coalesce(mean_fd <= 0.5 AND low_ratio > 0.4, false))"


def _summary(spark, d):
    return motion.run_summary(frames(spark, d), ["subid", "run_key"], "fd")


@query("cohort_screen", f"SELECT subid, count(*) FILTER (WHERE {_VALID}) AS valid_num, count(*) FILTER (WHERE {_VALID}) >= 2 AS valid_subject FROM {RUNS} GROUP BY subid")
def cohort_screen(spark, d):
    """E1 B9 B16 E3"""
    return motion.screen(_summary(spark, d), ["subid"])


@query("run_summary_long", f"SELECT *, {_VALID} AS valid FROM {RUNS}")
def run_summary_long(spark, d):
    return _summary(spark, d).withColumn("valid", fn.motion_valid(F.col("mean_fd"), F.col("low_ratio")))


@query("run_summary_wide", "SELECT subid, " + ", ".join(f"max(n_frames) FILTER (WHERE run_key = '{r}') AS {r}_frame, max(mean_fd) FILTER (WHERE run_key = '{r}') AS {r}_fd, coalesce(bool_or(run_key = '{r}' AND {_VALID}), false) AS {r}_valid" for r in RUN_KEYS) + f" FROM {RUNS} GROUP BY subid")
def run_summary_wide(spark, d):
    return motion.wide_summary(_summary(spark, d), "subid", "run_key", RUN_KEYS)


@query("run_summary_pooled", f"SELECT subid, count(*) AS n_frames, round(avg(fd), 6) AS mean_fd, round(count(*) FILTER (WHERE fd < 0.2) / count(fd), 6) AS low_ratio FROM {FRAMES} WHERE run_key IN ('click', 'view') GROUP BY subid")
def run_summary_pooled(spark, d):
    return motion.pooled_summary(frames(spark, d).where(F.col("run_key").isin("click", "view")), ["subid"], "fd")


@query("required_runs_gate", "SELECT user_id AS subid FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def required_runs_gate(spark, d):
    return cohort.required_runs(frames(spark, d), "subid", "run_key", RUN_KEYS)


@query("valid_run_select", f"""
WITH r AS (SELECT subid, run_key, {_VALID} AS valid FROM {RUNS} WHERE subid % 7 <> 0),
a AS (SELECT DISTINCT user_id AS subid, event_type AS run_key FROM events)
SELECT a.subid, a.run_key FROM a LEFT JOIN r USING (subid, run_key) WHERE coalesce(valid, false) OR a.subid NOT IN (SELECT subid FROM r)""")
def valid_run_select(spark, d):
    """Subjects whose number is divisible by 7 have no summary here"""
    s = run_summary_long(spark, d).where("subid % 7 <> 0")
    return cohort.select_runs(frames(spark, d).select("subid", "run_key").distinct(), s, "subid", "run_key")


for _name, _only in (("weighted_fd_all", False), ("weighted_fd_valid", True)):
    _use = _VALID if _only else "mean_fd IS NOT NULL"

    @query(_name, f"SELECT subid, round(sum(n_frames * mean_fd) FILTER (WHERE {_use}) / sum(n_frames) FILTER (WHERE {_use}), 6) AS weighted_fd FROM {RUNS} GROUP BY subid")
    def _weighted(spark, d, only=_only):
        return motion.weighted_fd(_summary(spark, d), "subid", only)


@query("attrition_report", """
WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE c_nationkey < 20) AS b, count(*) FILTER (WHERE c_nationkey < 20 AND c_acctbal > 0) AS c,
  count(*) FILTER (WHERE c_nationkey < 20 AND c_acctbal > 0 AND c_mktsegment <> 'MACHINERY') AS d FROM customer)
SELECT 0 AS step, 'nation' AS name, a AS n_in, b AS n_out FROM c UNION ALL SELECT 1, 'balance', b, c FROM c UNION ALL SELECT 2, 'segment', c, d FROM c""")
def attrition_report(spark, d):
    return cohort.attrition(read(spark, d, "customer"), [("nation", F.col("c_nationkey") < 20), ("balance", F.col("c_acctbal") > 0), ("segment", F.col("c_mktsegment") != "MACHINERY")])


@query("na_report", """SELECT 'doc_id' AS "column", count(*) FILTER (WHERE l.doc_id IS NULL) AS n_null FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'quality', count(*) FILTER (WHERE quality IS NULL) FROM documents d LEFT JOIN labels l USING (doc_id)
UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL) FROM documents d LEFT JOIN labels l USING (doc_id)""")
def na_report(spark, d):
    """E8"""
    labels = read(spark, d, "labels").select(F.col("doc_id").alias("id"), "doc_id", "quality", "toxic")
    return cohort.na_counts(read(spark, d, "documents").select(F.col("doc_id").alias("id")).join(labels, "id", "left"), ["doc_id", "quality", "toxic"])


@query("cohort_inner_chain", """SELECT o_orderkey, c_custkey, n_name, r_name, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey IN (1, 2, 3) AND c_acctbal IS NOT NULL AND c_custkey IN (SELECT user_id FROM events)""")
def cohort_inner_chain(spark, d):
    """D1 C2 C3 C4"""
    orders = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = read(spark, d, "customer").where(F.col("c_nationkey").isin(1, 2, 3))
    nation = read(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = read(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    out = cohort.inner_chain([cohort.inner_chain([cohort.inner_chain([orders, customers], "c_custkey"), nation], "c_nationkey"), region], "n_regionkey")
    out = cohort.members(cohort.complete_cases(out, ["c_acctbal", "absent"]), read(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")
    return out.select("o_orderkey", "c_custkey", "n_name", "r_name", "c_acctbal")


_SITES = "(SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS site_code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL))"


@query("covariates_left_chain", f"""SELECT l.user_id AS subid, round(c_acctbal / 12, 6) AS age, CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 2 END AS sex, CAST(site_code AS INT) AS site_code, c_acctbal IS NOT NULL AND mean_fd IS NOT NULL AS complete
FROM (SELECT DISTINCT user_id FROM events) l LEFT JOIN customer ON user_id = c_custkey LEFT JOIN {_SITES} USING (c_mktsegment)
LEFT JOIN (SELECT user_id AS u, avg(value) AS mean_fd FROM events GROUP BY 1) ON u = user_id""")
def covariates_left_chain(spark, d):
    """D2 B7 B8 B22"""
    ev = read(spark, d, "events")
    listed = ev.select(F.col("user_id").alias("subid")).distinct()
    people = cohort.site_codes(read(spark, d, "customer"), "c_mktsegment").select(F.col("c_custkey").alias("subid"), "c_acctbal", F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female").alias("s"), "site_code")
    fd = ev.groupBy(F.col("user_id").alias("subid")).agg(F.avg("value").alias("mean_fd"))
    out = cohort.left_chain(listed, [people, fd], "subid")
    return out.select("subid", fn.r6(fn.months_to_years(F.col("c_acctbal"))).alias("age"), F.coalesce(fn.recode(F.col("s"), {"Male": 1, "Female": 2}), F.lit(2)).alias("sex"), F.col("site_code").cast("int").alias("site_code"), (F.col("c_acctbal").isNotNull() & F.col("mean_fd").isNotNull()).alias("complete"))


@query("overlay_update", "SELECT c_custkey, c_name, coalesce(m, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS m FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def overlay_update(spark, d):
    new = read(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return cohort.overlay(read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), new, "c_custkey", ["c_acctbal"])


@query("family_unique", "SELECT c_nationkey, c_mktsegment, min(c_custkey) AS c_custkey FROM customer GROUP BY 1, 2")
def family_unique(spark, d):
    return cohort.first_of_family(read(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_custkey"), ["c_nationkey", "c_mktsegment"], ["c_custkey"])


@query("family_repeat_summary", "SELECT c_nationkey, c_mktsegment, count(*) AS n_members FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def family_repeat_summary(spark, d):
    return cohort.repeated_families(read(spark, d, "customer"), ["c_nationkey", "c_mktsegment"])


@query("list_diff", """WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1997), b AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NULL THEN 'added' WHEN b.o_custkey IS NULL THEN 'removed' ELSE 'common' END AS change FROM a FULL JOIN b USING (o_custkey)""")
def list_diff(spark, d):
    o = read(spark, d, "orders")
    return cohort.list_difference(o.where("year(o_orderdate) = 1997"), o.where("year(o_orderdate) = 1998"), "o_custkey")


@query("first_root_wins", "SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, min(o_orderpriority) OVER (PARTITION BY o_custkey) AS p FROM orders) WHERE p = o_orderpriority")
def first_root_wins(spark, d):
    """A customer's orders of its first priority class only"""
    return cohort.best_source(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), [], ["o_orderpriority"], whole=["o_custkey"])


@query("first_file_match", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def first_file_match(spark, d):
    """D15"""
    return cohort.best_source(read(spark, d, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("canonical_ids", "SELECT c_custkey, 'sub-' || replace(replace(c_name, '#', '_'), '_', '') AS subid, 'sub-' || replace(replace(c_name, '#', '_'), '_', '') AS twice, replace(replace('[''' || c_name || ''']', '[', ''), ']', '') AS raw, c_name AS cleaned FROM customer")
def canonical_ids(spark, d):
    """B1 B2 B3"""
    c = cohort.ensure_id(read(spark, d, "customer").withColumn("src_subject_id", F.replace("c_name", F.lit("#"), F.lit("_"))), ["participant_id", "src_subject_id"], "id")
    sub, raw = fn.canonical_subid(F.col("id")), F.concat(F.lit("'"), "c_name", F.lit("'"))
    return c.select("c_custkey", sub.alias("subid"), fn.canonical_subid(sub).alias("twice"), raw.alias("raw"), fn.clean_id(F.concat(F.lit("["), raw, F.lit("]"))).alias("cleaned"))


@query("path_entities", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '/0*([0-9]+)$', 1) AS run_text, TRY_CAST(nullif(regexp_extract(url, '([0-9]+)$', 1), '') AS INT) AS run, upper(regexp_extract(url, '/([a-z]+)', 1)) AS task FROM pages""")
def path_entities(spark, d):
    """B4"""
    u = F.col("url")
    return read(spark, d, "pages").select("page_id", F.regexp_extract(u, "^https?://([^/]+)", 1).alias("host"), F.regexp_extract(u, "/0*([0-9]+)$", 1).alias("run_text"), fn.na_parse(F.regexp_extract(u, "([0-9]+)$", 1), "int").alias("run"), F.upper(F.regexp_extract(u, "/([a-z]+)", 1)).alias("task"))


@query("na_parse", """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events""")
def na_parse(spark, d):
    """A JSON number with blanks, n/a or junk in its place"""
    k = F.get_json_object("props", "$.k")
    cell = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), k, F.lit("  "))).when(F.col("event_id") % 6 == 1, "n/a").when(F.col("event_id") % 3 == 1, " ").otherwise(k)
    return read(spark, d, "events").select("event_id", fn.na_parse(cell).alias("k"))


_ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


@query("backward_diff", f"SELECT event_id, round(coalesce(value - lag(value) OVER ({_ORDER}), 0), 6) + 0.0 AS d FROM events")
def backward_diff(spark, d):
    return motion.backward_difference(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", "d", io.checkpointed).select("event_id", fn.r6(F.col("d")).alias("d"))


@query("unbiased_diff", f"""SELECT event_id, round(CASE WHEN lag(1) OVER w IS NULL AND lead(1) OVER w IS NULL THEN 0 WHEN lag(1) OVER w IS NULL THEN lead(value) OVER w - value
WHEN lead(1) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END, 6) + 0.0 AS d FROM events WINDOW w AS ({_ORDER})""")
def unbiased_diff(spark, d):
    return motion.unbiased_difference(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], "value", "d").select("event_id", fn.r6(F.col("d")).alias("d"))


def _indexed(spark, d):
    return motion.frame_index(read(spark, d, "events"), ["user_id"], ["ts", "event_id"])


_INDEXED = f"(SELECT event_id, user_id, event_type, value, row_number() OVER ({_ORDER}) - 1 AS t FROM events)"


for _name in ("linear_detrend", "detrend_zero"):

    @query(_name, f"SELECT event_id, round(value - avg(value) OVER w - coalesce(regr_slope(value, t) OVER w, 0) * (t - avg(t) OVER w), 6) + 0.0 AS resid FROM {_INDEXED} WINDOW w AS (PARTITION BY user_id)")
    def _detrend(spark, d):
        """F5 L17"""
        return motion.linear_detrend(_indexed(spark, d), ["user_id"], "t", "value", "resid").select("event_id", fn.r6(F.col("resid")).alias("resid"))


@query("poly_detrend", f"""
WITH a AS (SELECT event_id, user_id, value AS y, t - avg(t) OVER (PARTITION BY user_id) AS u FROM {_INDEXED}),
s AS (SELECT user_id, count(*) AS n, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(u * u * u * u) AS s4, sum(y) AS y0, sum(u * y) AS y1, sum(u * u * y) AS y2 FROM a GROUP BY 1),
q AS (SELECT *, y0 / n AS m, y2 - s2 / n * y0 - s3 / nullif(s2, 0) * y1 AS num, s4 - s2 * s2 / n - s3 * s3 / nullif(s2, 0) AS den FROM s)
SELECT event_id, round(y - m - coalesce(y1 / nullif(s2, 0) * u, 0) - CASE WHEN den > 1e-6 THEN num / den * (u * u - s2 / n - s3 / s2 * u) ELSE 0 END, 5) + 0.0 AS resid FROM a JOIN q USING (user_id)""")
def poly_detrend(spark, d):
    """F6, order 2"""
    return motion.polynomial_detrend(_indexed(spark, d), ["user_id"], "t", "value", "resid").select("event_id", F.round("resid", 5).alias("resid"))


_PARAMS = ["l_quantity", "l_discount", "l_tax", "r1", "r2", "r3"]


def _params(spark, d):
    li = read(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", (F.col("l_discount") * 90).alias("r1"), (F.col("l_tax") * 90).alias("r2"), (F.col("l_quantity") / 10).alias("r3"))
    return motion.motion_expansion(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], _PARAMS, ["r1", "r2", "r3"])


@query("fd_from_params", """
WITH p AS (SELECT *, radians(l_discount * 90) AS r1, radians(l_tax * 90) AS r2, radians(l_quantity / 10) AS r3 FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, round(coalesce(abs(l_quantity - lag(l_quantity) OVER w) + abs(l_discount - lag(l_discount) OVER w) + abs(l_tax - lag(l_tax) OVER w)
  + 50 * (abs(r1 - lag(r1) OVER w) + abs(r2 - lag(r2) OVER w) + abs(r3 - lag(r3) OVER w)), 0), 5) AS fd, round(r1 * r1, 6) AS r1_sq
FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity)""")
def fd_from_params(spark, d):
    """B10 B11 B12"""
    p = _params(spark, d)
    fd = fn.framewise_displacement([F.col(f"d_{c}") for c in _PARAMS[:3]], [F.col(f"d_{c}") for c in _PARAMS[3:]])
    return p.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", F.round(fd, 5).alias("fd"), fn.r6(F.col("r1_sq")).alias("r1_sq"))


_BM = "(SELECT p_brand AS roi, CAST((year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS INT) AS t, avg(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def brand_month(spark, d):
    """ROI time series: mean quantity of each brand and month."""
    li = read(spark, d, "lineitem").join(read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("roi")), "l_partkey")
    t = ((F.year("l_shipdate") - 1990) * 12 + F.month("l_shipdate")).cast("int")
    return li.groupBy("roi", t.alias("t")).agg(F.avg("l_quantity").alias("x"))


@query("dvars", f"""
WITH s AS (SELECT 1 AS run, t, sqrt(avg(power(coalesce(x - p, 0), 2))) AS dvars FROM (SELECT *, lag(x) OVER (PARTITION BY roi ORDER BY t) AS p FROM {_BM}) GROUP BY t)
SELECT t, round(dvars, 6) AS dvars, round(dvars - quantile_cont(dvars, 0.5) OVER (), 6) + 0.0 AS dvars_centred FROM s""")
def dvars(spark, d):
    out = motion.dvars(brand_month(spark, d).withColumn("run", F.lit(1)), ["run"], "roi", "t", "x")
    return out.select("t", fn.r6(F.col("dvars")).alias("dvars"), fn.r6(F.col("dvars_centred")).alias("dvars_centred"))


_RUN_T = "(SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t FROM events)"


@query("run_concat", f"""WITH a AS (SELECT * FROM {_RUN_T}), n AS (SELECT user_id, event_type, count(*) AS n FROM a GROUP BY 1, 2),
b AS (SELECT user_id, event_type, coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT event_id, CAST(t + before AS BIGINT) AS t_global FROM a JOIN b USING (user_id, event_type)""")
def run_concat(spark, d):
    runs = motion.frame_index(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return motion.concatenate_runs(runs, ["user_id"], "event_type", "t").select("event_id", F.col("t_global").cast("bigint").alias("t_global"))


@query("normalise_series", "SELECT event_id, round((value - avg(value) OVER w) / greatest(coalesce(stddev_samp(value) OVER w, 0), 1e-5), 6) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY user_id, event_type)")
def normalise_series(spark, d):
    return motion.normalise(read(spark, d, "events"), ["user_id", "event_type"], "value", "z").select("event_id", fn.r6(F.col("z")).alias("z"))


@query("run_variance_equalise", "SELECT event_id, round(value / nullif(stddev_samp(value) OVER (PARTITION BY user_id, event_type), 0) * stddev_samp(value) OVER (PARTITION BY user_id), 5) AS x FROM events")
def run_variance_equalise(spark, d):
    return motion.equalise_runs(read(spark, d, "events"), ["user_id"], "event_type", "value", "x").select("event_id", F.round("x", 5).alias("x"))


@query("signal_expansion", f"WITH a AS (SELECT event_id, value / 100 AS v, coalesce(value / 100 - lag(value / 100) OVER ({_ORDER}), 0) AS dv FROM events) SELECT event_id, round(v, 6) AS v, round(dv, 6) + 0.0 AS v_derivative1, round(v * v, 6) AS v_power2, round(dv * dv, 6) AS v_derivative1_power2 FROM a")
def signal_expansion(spark, d):
    e = motion.signal_expansion(read(spark, d, "events").withColumn("v", F.col("value") / 100), ["user_id"], ["ts", "event_id"], "v")
    return e.select("event_id", *(fn.r6(F.col(c)).alias(c) for c in ("v", "v_derivative1", "v_power2", "v_derivative1_power2")))


@query("confounds_24p_norm", f"""
WITH a AS (SELECT event_id, user_id, value AS v, coalesce(value - lag(value) OVER ({_ORDER}), 0) AS dv FROM events),
n AS (SELECT event_id, user_id, (v - avg(v) OVER w) / greatest(coalesce(stddev_samp(v) OVER w, 0), 1e-5) AS nv, (dv - avg(dv) OVER w) / greatest(coalesce(stddev_samp(dv) OVER w, 0), 1e-5) AS nd FROM a WINDOW w AS (PARTITION BY user_id))
SELECT event_id, round(nv, 5) + 0.0 AS n_value, round(nd, 5) + 0.0 AS n_d_value, round((nv * nv - avg(nv * nv) OVER w) / greatest(coalesce(stddev_samp(nv * nv) OVER w, 0), 1e-5), 5) + 0.0 AS n_value_sq,
round((nd * nd - avg(nd * nd) OVER w) / greatest(coalesce(stddev_samp(nd * nd) OVER w, 0), 1e-5), 5) + 0.0 AS n_d_value_sq FROM n WINDOW w AS (PARTITION BY user_id)""")
def confounds_24p_norm(spark, d):
    c = motion.motion_confounds(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value"])
    return c.select("event_id", *(F.round(x, 5).alias(x) for x in ("n_value", "n_d_value", "n_value_sq", "n_d_value_sq")))


@query("global_signal", f"SELECT t, round(avg(x), 6) AS mean_signal FROM {_BM} GROUP BY t")
def global_signal(spark, d):
    """L9 F13"""
    return motion.mean_signal(brand_month(spark, d), ["t"], "x").select("t", fn.r6(F.col("mean_signal")).alias("mean_signal"))


@query("mask_mean_signal", f"SELECT t, round(avg(x) FILTER (WHERE roi IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')), 6) AS mean_signal FROM {_BM} GROUP BY t HAVING count(*) FILTER (WHERE roi IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')) > 0")
def mask_mean_signal(spark, d):
    """E10, over the months in which the mask has data; others would be an error"""
    m = F.col("roi").isin(*(f"Brand#{i}" for i in range(1, 6)))
    s = brand_month(spark, d)
    return motion.mask_mean_signal(s.join(s.where(m).select("t").distinct(), "t", "left_semi"), ["t"], "x", m).select("t", fn.r6(F.col("mean_signal")).alias("mean_signal"))


# single predicates
for _name, _sql, _rule in (
    ("event_filter", "o_orderpriority = '1-URGENT'", "o_orderpriority = '1-URGENT'"),
    ("frames_exact", "day(o_orderdate) = 15", "day(o_orderdate) = 15"),
    ("index_bounds", "month(o_orderdate) BETWEEN 1 AND 4", "month(o_orderdate) BETWEEN 1 AND 4"),
):  # C1 C7 C9

    @query(_name, f"SELECT o_orderkey, o_custkey FROM orders WHERE {_sql}")
    def _filtered(spark, d, rule=_rule):
        return read(spark, d, "orders").where(rule).select("o_orderkey", "o_custkey")


@query("exclude_listed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def exclude_listed(spark, d):
    """C5"""
    return cohort.excluded(read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("age_floor", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def age_floor(spark, d):
    """An unknown value is kept"""
    return cohort.age_floor(read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left"), "quality", 1).select("doc_id")


@query("schema_guard", "SELECT c_custkey, c_acctbal FROM customer")
def schema_guard(spark, d):
    """C11"""
    return cohort.require_columns(read(spark, d, "customer"), ["c_custkey", "c_acctbal"]).select("c_custkey", "c_acctbal")


@query("unique_guard", "SELECT c_custkey, c_acctbal FROM customer")
def unique_guard(spark, d):
    """C12"""
    return cohort.require_unique(read(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])


_LIST = "(SELECT user_id AS c_custkey, row_number() OVER (ORDER BY md5(concat('list|', user_id)), user_id) - 1 AS pos FROM (SELECT DISTINCT user_id FROM events))"


def subject_list(spark, d):
    """An ordered subject list: the users by a seeded hash. The list is one row a subject."""
    ids = read(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct()
    placed = scan(ids, [], [fn.seeded("list", F.col("c_custkey")).asc(), F.asc("c_custkey")], io.checkpointed, number="pos")
    return placed.withColumn("pos", (F.col("pos") - 1).cast("bigint"))


@query("list_order_align", f"SELECT pos, c_custkey, c_acctbal FROM {_LIST} JOIN customer USING (c_custkey)")
def list_order_align(spark, d):
    """D5"""
    return cohort.align(subject_list(spark, d), read(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey").select("pos", "c_custkey", "c_acctbal")


@query("row_gather", f"SELECT l.pos, vec_id AS c_custkey, round(embedding[1]::DOUBLE, 6) + 0.0 AS first FROM {_LIST} l JOIN embeddings ON vec_id = l.c_custkey")
def row_gather(spark, d):
    """D6"""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("c_custkey"), F.col("embedding")[0].cast("double").alias("first"))
    return cohort.align(subject_list(spark, d), e, "c_custkey").select("pos", "c_custkey", fn.r6(F.col("first")).alias("first"))


@query("availability_intersection", f"SELECT pos, c_custkey FROM {_LIST} WHERE c_custkey IN (SELECT c_custkey FROM customer) AND c_custkey IN (SELECT vec_id FROM embeddings) AND c_custkey IN (SELECT doc_id FROM labels)")
def availability_intersection(spark, d):
    """D7 H2"""
    out = subject_list(spark, d)
    for t, k in (("customer", "c_custkey"), ("embeddings", "vec_id"), ("labels", "doc_id")):
        out = cohort.members(out, read(spark, d, t).select(F.col(k).alias("c_custkey")), "c_custkey")
    return out.select("pos", "c_custkey")


@query("list_fd_demo_chain", f"SELECT pos, c_custkey, round(weighted_fd, 6) AS weighted_fd, c_nationkey AS sex FROM {_LIST} JOIN (SELECT subid AS c_custkey, round(sum(n_frames * mean_fd) / sum(n_frames), 6) AS weighted_fd FROM {RUNS} GROUP BY 1) USING (c_custkey) JOIN customer USING (c_custkey)")
def list_fd_demo_chain(spark, d):
    """D3 B30"""
    fd = motion.weighted_fd(_summary(spark, d), "subid", False).withColumnRenamed("subid", "c_custkey")
    people = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("sex"))
    return cohort.inner_chain([subject_list(spark, d), fd, people], "c_custkey").select("pos", "c_custkey", "weighted_fd", "sex")


@query("family_lookup", "SELECT o_orderkey, c_nationkey AS family FROM orders JOIN customer ON o_custkey = c_custkey")
def family_lookup(spark, d):
    """D16"""
    fam = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("family"))
    return cohort.family_lookup(read(spark, d, "orders").select("o_orderkey", "o_custkey"), fam, "o_custkey", "family").select("o_orderkey", "family")


@query("session_overlap_join", """
WITH a AS (SELECT n_nationkey AS k, n_regionkey AS x, n_nationkey AS idx FROM nation WHERE n_nationkey < 18), b AS (SELECT n_nationkey AS k, n_regionkey + 100 AS x, n_nationkey AS idx FROM nation WHERE n_nationkey >= 7)
SELECT k, coalesce(a.idx, -1) AS idx_a, coalesce(b.idx, -1) AS idx_b, coalesce(a.x, b.x) AS x_a, coalesce(b.x, a.x) AS x_b FROM a FULL JOIN b USING (k)""")
def session_overlap_join(spark, d):
    """D17"""
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("x"), F.col("n_nationkey").alias("idx"))
    return cohort.session_overlap(n.where("k < 18"), n.where("k >= 7").withColumn("x", F.col("x") + 100), ["k"], ["x"])
