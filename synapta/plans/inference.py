"""Significance reports over result records. lineitem stands for repeated runs: a run is a supplier, a feature set a return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from synapta import functions as fn
from synapta.operators import inference as inf
from synapta.operators.scans import scan
from synapta.plans.base import query, read
from synapta.sources import io


def records(spark, d):
    """(time_id, feature_set, corr): one value for each run and set."""
    li = read(spark, d, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 101).cast("int").alias("time_id"), F.col("l_returnflag").alias("feature_set")).agg(fn.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("corr"), F.avg("l_discount").alias("metric"))


_CORR = "CASE WHEN count(*) > 1 AND stddev_samp({0}) > 0 AND stddev_samp({1}) > 0 THEN covar_samp({0}, {1}) / (stddev_samp({0}) * stddev_samp({1})) END"
_REC = f"(SELECT CAST(l_suppkey % 101 AS INT) AS time_id, l_returnflag AS feature_set, {_CORR.format('l_quantity', 'l_extendedprice')} AS corr, avg(l_discount) AS metric FROM lineitem GROUP BY 1, 2)"


def nulls(spark, d):
    """(perm_id, feature_set, corr): the same by permutation id."""
    li = read(spark, d, "lineitem")
    return li.groupBy((F.col("l_partkey") % 1000).cast("int").alias("perm_id"), F.col("l_returnflag").alias("feature_set")).agg(fn.pearson(F.col("l_quantity"), F.col("l_extendedprice")).alias("corr"))


_NULL = f"(SELECT CAST(l_partkey % 1000 AS INT) AS perm_id, l_returnflag AS feature_set, {_CORR.format('l_quantity', 'l_extendedprice')} AS corr FROM lineitem GROUP BY 1, 2)"
_OBS = f"(SELECT feature_set, quantile_cont(corr, 0.5) AS corr FROM {_REC} GROUP BY 1)"


def _observed(spark, d):
    return records(spark, d).groupBy("feature_set").agg(F.percentile("corr", F.lit(0.5)).alias("corr"))


for _name, _one in (("perm_pvalue_plus1", 1), ("perm_pvalue_raw", 0)):

    @query(_name, f"SELECT o.feature_set, round(any_value(o.corr), 6) + 0.0 AS observed, count(n.corr) AS n_null, round((count(*) FILTER (WHERE n.corr >= o.corr) + {_one}) / (count(n.corr) + {_one}), 6) AS p FROM {_OBS} o JOIN {_NULL} n USING (feature_set) GROUP BY 1")
    def _perm(spark, d, one=_one):
        """K1 K2"""
        p = inf.right_tail_p(_observed(spark, d), nulls(spark, d), ["feature_set"], "corr", bool(one))
        return p.select("feature_set", fn.r6(F.col("observed")).alias("observed"), "n_null", fn.r6(F.col("p")).alias("p"))


def tagged(spark, d):
    """H4: observed and permutation rows in one table."""
    obs = records(spark, d).select("feature_set", "corr", F.lit("observed").alias("source"), F.col("time_id").alias("id"))
    return obs.unionByName(nulls(spark, d).select("feature_set", "corr", F.lit("permutation").alias("source"), F.col("perm_id").alias("id")))


_TAGGED = f"(SELECT feature_set, corr, 'observed' AS source, time_id AS id FROM {_REC} UNION ALL SELECT feature_set, corr, 'permutation', perm_id FROM {_NULL})"
_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END"
_SUMMARY = f"""(SELECT feature_set, any_value(o.corr) AS observed, count(n.corr) AS n_null, avg(n.corr) AS null_mean, quantile_cont(n.corr, 0.5) AS null_median, stddev_samp(n.corr) AS null_std,
(count(*) FILTER (WHERE n.corr >= o.corr) + 1) / (count(n.corr) + 1) AS p FROM {_OBS} o JOIN {_NULL} n USING (feature_set) GROUP BY 1)"""


@query("source_split", f"SELECT source, feature_set, count(*) AS n, count(corr) AS n_valid FROM {_TAGGED} GROUP BY 1, 2")
def source_split(spark, d):
    """C16 H4"""
    return tagged(spark, d).groupBy("source", "feature_set").agg(F.count("*").alias("n"), F.count("corr").alias("n_valid"))


@query("null_summary", f"SELECT feature_set, round(observed, 6) + 0.0 AS observed, n_null, round(null_mean, 6) + 0.0 AS null_mean, round(null_median, 6) + 0.0 AS null_median, round(null_std, 6) AS null_std, round(p, 6) AS p, round((observed - null_mean) / null_std, 6) + 0.0 AS z, {_STARS} AS label FROM {_SUMMARY}")
def null_summary(spark, d):
    """K3"""
    s = inf.null_summary(tagged(spark, d), ["feature_set"], "corr", F.col("source") == "observed")
    return s.select("feature_set", *(fn.r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "null_median", "null_std", "p", "z")), "n_null", "label")


@query("missing_null_status", f"SELECT t.feature_set, s.n_null, round(s.p, 6) AS p, CASE WHEN s.n_null IS NULL THEN 'missing_null' ELSE 'ok' END AS status FROM (SELECT DISTINCT l_returnflag AS feature_set FROM lineitem UNION ALL SELECT 'absent') t LEFT JOIN {_SUMMARY} s USING (feature_set)")
def missing_null_status(spark, d):
    """K4"""
    targets = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("feature_set")).distinct().union(spark.range(1).select(F.lit("absent")))
    s = inf.null_summary(tagged(spark, d), ["feature_set"], "corr", F.col("source") == "observed")
    return inf.with_status(targets, s, ["feature_set"]).select("feature_set", "n_null", fn.r6(F.col("p")).alias("p"), "status")


_DELTA = f"(SELECT time_id, a.metric - b.metric AS delta FROM {_REC} a JOIN {_REC} b USING (time_id) WHERE a.feature_set = 'N' AND b.feature_set = 'R')"


@query("delta_vs_null", f"""
WITH o AS (SELECT median(a.corr - b.corr) AS x FROM {_REC} a JOIN {_REC} b USING (time_id) WHERE a.feature_set = 'N' AND b.feature_set = 'R'),
n AS (SELECT a.corr - b.corr AS x FROM {_NULL} a JOIN {_NULL} b USING (perm_id) WHERE a.feature_set = 'N' AND b.feature_set = 'R')
SELECT s AS direction, round(s * any_value(o.x), 6) + 0.0 AS observed, count(n.x) AS n_null, round((count(*) FILTER (WHERE s * n.x >= s * o.x) + 1) / (count(n.x) + 1), 6) AS p FROM o, n, (SELECT unnest([1, -1]) AS s) GROUP BY s""")
def delta_vs_null(spark, d):
    """Both directions"""
    obs = inf.deltas(records(spark, d), ["time_id"], "feature_set", "corr", "N", "R").agg(F.percentile("delta", F.lit(0.5)).alias("x"))
    null = inf.deltas(nulls(spark, d), ["perm_id"], "feature_set", "corr", "N", "R").select(F.col("delta").alias("x"))
    both = F.explode(F.array(F.lit(1), F.lit(-1)))
    o, n = (x.withColumn("direction", both).withColumn("x", F.col("x") * F.col("direction")) for x in (obs, null))
    p = inf.right_tail_p(o, n, ["direction"], "x")
    return p.select("direction", fn.r6(F.col("observed")).alias("observed"), "n_null", fn.r6(F.col("p")).alias("p"))


@query("paired_t", f"SELECT count(delta) AS n, round(avg(delta), 6) + 0.0 AS mean_delta, round(avg(delta) / (stddev_samp(delta) / sqrt(count(delta))), 6) + 0.0 AS t, count(delta) - 1 AS dof FROM {_DELTA}")
def paired_t(spark, d):
    """K6"""
    t = inf.paired_t(inf.deltas(records(spark, d), ["time_id"], "feature_set", "metric", "N", "R"), [], "delta")
    return t.select("n", fn.r6(F.col("mean_delta")).alias("mean_delta"), fn.r6(F.col("t")).alias("t"), "dof")


@query("corrected_resampled_t", f"SELECT count(delta) AS n, round(avg(delta) / (stddev_samp(delta) * sqrt(1 / count(delta) + 0.25)), 6) + 0.0 AS t, count(delta) - 1 AS dof FROM {_DELTA}")
def corrected_resampled_t(spark, d):
    """K7 D9"""
    t = inf.paired_t(inf.deltas(records(spark, d), ["time_id"], "feature_set", "metric", "N", "R"), [], "delta", test_to_train=0.25)
    return t.select("n", fn.r6(F.col("t")).alias("t"), "dof")


#: The tail for whole degrees of freedom is a finite series in the angle a = atan(t / sqrt(dof)).
_ODD = "2 / pi() * (a + sin(a) * coalesce(list_sum(list_transform(range(0, (dof - 1) // 2), lambda j: power(cos(a), 2 * j + 1) * coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: 2.0 * i / (2 * i + 1)), 'product'), 1))), 0))"
_EVEN = "sin(a) * list_sum(list_transform(range(0, dof // 2), lambda j: power(cos(a), 2 * j) * coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: (2.0 * i - 1) / (2 * i)), 'product'), 1)))"


@query("t_tail", f"""WITH s AS (SELECT time_id % 5 AS g, count(delta) AS n, avg(delta) AS mean_delta, avg(delta) / (stddev_samp(delta) / sqrt(count(delta))) AS t, count(delta) - 1 AS dof FROM {_DELTA} GROUP BY 1),
w AS (SELECT *, atan(abs(t) / sqrt(dof)) AS a FROM s)
SELECT g, n, round(mean_delta, 6) + 0.0 AS mean_delta, round(t, 6) + 0.0 AS t, dof, round(1 - CASE WHEN dof % 2 = 1 THEN {_ODD} ELSE {_EVEN} END, 6) + 0.0 AS p FROM w""")
def t_tail(spark, d):
    """K9: p of the paired t of each part of the suppliers"""
    li = records(spark, d).withColumn("g", F.col("time_id") % 5)
    t = inf.with_t_p(inf.paired_t(inf.deltas(li, ["g", "time_id"], "feature_set", "metric", "N", "R"), ["g"], "delta"))
    return t.select("g", "n", "dof", *(fn.r6(F.col(c)).alias(c) for c in ("mean_delta", "t", "p")))


@query("oneway_anova", f"""WITH r AS (SELECT * FROM {_REC} WHERE metric IS NOT NULL), g AS (SELECT feature_set, count(*) AS n, avg(metric) AS m, var_pop(metric) AS v FROM r GROUP BY 1),
t AS (SELECT sum(n * m) / sum(n) AS grand FROM g), s AS (SELECT sum(n * power(m - grand, 2)) AS b, sum(n * v) AS w, count(*) - 1 AS d1, sum(n) - count(*) AS d2 FROM g, t)
SELECT d1, CAST(d2 AS BIGINT) AS d2, round((b / d1) / (w / d2), 5) AS f FROM s""")
def oneway_anova(spark, d):
    """K10 (trap T24)"""
    return inf.anova(records(spark, d).withColumn("k", F.lit(1)), ["k"], "feature_set", "metric").select("d1", "d2", F.round("f", 5).alias("f"))


_WIDE = """(SELECT l_linenumber AS dataset, CAST(count(*) FILTER (WHERE l_returnflag = 'A') * 37 % 1000 AS DOUBLE) / 2000 AS a_p, CAST(count(*) FILTER (WHERE l_returnflag = 'N') * 41 % 1000 AS DOUBLE) / 4000 AS n_p,
CASE WHEN l_linenumber > 1 THEN CAST(count(*) FILTER (WHERE l_returnflag = 'R') * 43 % 1000 AS DOUBLE) / 8000 END AS r_p FROM lineitem GROUP BY 1)"""


def _wide(spark, d):
    f = lambda s, k: F.count_if(F.col("l_returnflag") == s) * k % 1000
    g = read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("dataset")).agg((f("A", 37) / 2000).alias("a_p"), (f("N", 41) / 4000).alias("n_p"), (f("R", 43) / 8000).alias("r_p"))
    return g.withColumn("r_p", F.when(F.col("dataset") > 1, F.col("r_p")))


@query("bh_fdr", f"""WITH u AS (SELECT dataset, metric, p FROM {_WIDE} UNPIVOT (p FOR metric IN (a_p, n_p, r_p))),
r AS (SELECT *, row_number() OVER (ORDER BY p, dataset, metric) AS k, count(*) OVER () AS n FROM u),
q AS (SELECT dataset, metric, least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT w.dataset, round(a_p, 6) AS a_p, round(n_p, 6) AS n_p, round(r_p, 6) AS r_p, round(max(q) FILTER (WHERE metric = 'a_p'), 6) AS a_p_q, round(max(q) FILTER (WHERE metric = 'n_p'), 6) AS n_p_q, round(max(q) FILTER (WHERE metric = 'r_p'), 6) AS r_p_q
FROM {_WIDE} w LEFT JOIN q USING (dataset) GROUP BY ALL""")
def bh_fdr(spark, d):
    """A NULL p is not counted (trap T19)"""
    q = inf.fdr_wide(_wide(spark, d), ["dataset"], ["a_p", "n_p", "r_p"])
    return q.select("dataset", *(fn.r6(F.col(c)).alias(c) for c in q.columns if c != "dataset"))


_MANY = "(SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 50 <> 0 THEN CAST((o_orderkey * 7919 + CAST(round(o_totalprice * 100) AS BIGINT)) % 100003 AS DOUBLE) / 100003 * (CASE WHEN o_orderkey % 7 = 0 THEN 0.001 ELSE 1 END) END AS p FROM orders)"


@query("bh_fdr_families", f"""WITH r AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM {_MANY} WHERE p IS NOT NULL WINDOW w AS (PARTITION BY o_orderstatus ORDER BY p, o_orderkey))
SELECT o_orderkey, o_orderstatus, round(least(1.0, min(p * n / k) OVER (PARTITION BY o_orderstatus ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r UNION ALL SELECT o_orderkey, o_orderstatus, NULL FROM {_MANY} WHERE p IS NULL""")
def bh_fdr_families(spark, d):
    """K8 F10 with families of any size: a test an order, three families"""
    o = read(spark, d, "orders")
    p = ((F.col("o_orderkey") * 7919 + F.round(F.col("o_totalprice") * 100).cast("bigint")) % 100003).cast("double") / 100003 * F.when(F.col("o_orderkey") % 7 == 0, 0.001).otherwise(1.0)
    t = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 50 != 0, p).alias("p"))
    return inf.bh_fdr(t, "p", ["o_orderstatus"], ["o_orderkey"], checkpoint=io.checkpointed).select("o_orderkey", "o_orderstatus", fn.r6(F.col("q")).alias("q"))


@query("label_stars", f"SELECT feature_set, perm_id, {_STARS.replace('p <', 'abs(corr) <')} AS label FROM {_NULL} WHERE corr IS NOT NULL")
def label_stars(spark, d):
    """B23"""
    return nulls(spark, d).where("corr is not null").select("feature_set", "perm_id", fn.stars(F.abs("corr")).alias("label"))


@query("label_stars_plot", f"SELECT feature_set, perm_id, CASE WHEN abs(corr) < 0.001 THEN '**' WHEN abs(corr) < 0.05 THEN '*' ELSE 'ns' END AS label FROM {_NULL} WHERE corr IS NOT NULL")
def label_stars_plot(spark, d):
    """B24 (trap T18)"""
    return nulls(spark, d).where("corr is not null").select("feature_set", "perm_id", fn.stars_plot(F.abs("corr")).alias("label"))


_PARTIAL = """(SELECT {k}, n, CASE WHEN n >= 3 AND (1 - xz * xz) * (1 - yz * yz) > 1e-24 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END AS partial_r FROM (SELECT {k}, count(*) AS n, corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_discount) AS xz, corr(l_extendedprice, l_discount) AS yz FROM lineitem GROUP BY 1))"""


@query("partial_corr", f"SELECT time_id, n, round(partial_r, 6) + 0.0 AS partial_r FROM {_PARTIAL.format(k='time_id').replace('FROM lineitem', 'FROM (SELECT *, CAST(l_suppkey % 101 AS INT) AS time_id FROM lineitem)')}")
def partial_corr(spark, d):
    """J21 J22"""
    li = read(spark, d, "lineitem").withColumn("time_id", (F.col("l_suppkey") % 101).cast("int"))
    p = inf.partial_correlation(li, ["time_id"], "l_quantity", "l_extendedprice", "l_discount")
    return p.select("time_id", "n", fn.r6(F.col("partial_r")).alias("partial_r"))


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY feature_set ORDER BY metric DESC NULLS LAST, time_id) AS rank FROM {_REC})"


@query("partial_corr_rank_matched", f"SELECT a.rank, a.time_id AS N_run, b.time_id AS R_run, round(a.metric, 6) AS N_value, round(b.metric, 6) AS R_value FROM {_RANKED} a JOIN {_RANKED} b ON a.rank = b.rank AND a.feature_set = 'N' AND b.feature_set = 'R'")
def partial_corr_rank_matched(spark, d):
    """D11 F9"""
    m = inf.rank_matched(records(spark, d), "feature_set", "time_id", "metric", "N", "R")
    return m.select("rank", "N_run", "R_run", fn.r6(F.col("N_value")).alias("N_value"), fn.r6(F.col("R_value")).alias("R_value"))


@query("same_run_join", f"SELECT a.time_id, round(a.metric - b.metric, 6) + 0.0 AS delta FROM {_REC} a JOIN {_REC} b ON a.time_id = b.time_id AND a.feature_set = 'N' AND b.feature_set = 'A'")
def same_run_join(spark, d):
    """D12"""
    x = inf.deltas(records(spark, d), ["time_id"], "feature_set", "metric", "N", "A")
    return x.select("time_id", fn.r6(F.col("delta")).alias("delta"))


@query("rank_desc_nulls_last", f"SELECT feature_set, time_id, rank FROM {_RANKED}")
def rank_desc_nulls_last(spark, d):
    """F9"""
    ranked = scan(records(spark, d).select("feature_set", "time_id", "metric"), ["feature_set"], [F.desc_nulls_last("metric"), F.asc("time_id")], io.checkpointed, number="rank")
    return ranked.select("feature_set", "time_id", "rank")


_Q = ", ".join(f"round(quantile_cont(x, {q}), 6) + 0.0 AS {n}" for n, q in (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95)))


@query("dist_summary", f"SELECT feature_set, count(x) AS n, round(avg(x), 6) + 0.0 AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) + 0.0 AS min, round(max(x), 6) + 0.0 AS max, {_Q}, round(avg(CASE WHEN x >= 0.9 THEN 1.0 WHEN x < 0.9 THEN 0.0 END), 6) AS exceedance FROM (SELECT feature_set, corr AS x FROM {_NULL}) GROUP BY 1")
def dist_summary(spark, d):
    """E17 E18"""
    s = inf.distribution(nulls(spark, d), ["feature_set"], "corr", io.checkpointed, F.lit(0.9))
    return s.select("feature_set", "n", *(fn.r6(F.col(c)).alias(c) for c in s.columns if c not in ("feature_set", "n")))


@query("shared_histogram", """WITH b AS (SELECT l_returnflag AS feature_set, CAST(least(floor((l_quantity - 1) / 4.9), 9) AS INT) AS bin FROM lineitem WHERE l_quantity BETWEEN 1 AND 50), h AS (SELECT feature_set, bin, count(*) AS n FROM b GROUP BY 1, 2)
SELECT feature_set, bin, n, round(n / sum(n) OVER (PARTITION BY feature_set) / 4.9, 6) AS density FROM h""")
def shared_histogram(spark, d):
    """E19"""
    h = inf.shared_histogram(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "feature_set"), ["feature_set"], "l_quantity", 1.0, 50.0, 10)
    return h.select("feature_set", "bin", "n", fn.r6(F.col("density")).alias("density"))


@query("best_baseline_delta", f"""WITH m AS (SELECT feature_set, quantile_cont(metric, 0.5) AS median FROM {_REC} GROUP BY 1), b AS (SELECT feature_set AS best, median AS best_median FROM m ORDER BY median DESC, feature_set LIMIT 1)
SELECT feature_set, round(median, 6) AS median, best, round(best_median, 6) AS best_median, round(median - best_median, 6) + 0.0 AS delta FROM m, b""")
def best_baseline_delta(spark, d):
    """E20 G3"""
    m = inf.against_best(records(spark, d).withColumn("k", F.lit(1)), ["k"], "feature_set", "metric")
    return m.select("feature_set", "best", *(fn.r6(F.col(c)).alias(c) for c in ("median", "best_median", "delta")))


@query("weight_counts", "SELECT label, CAST(f AS INT) AS f, count(w) AS n FROM (SELECT label, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS w FROM embeddings) GROUP BY 1, 2")
def weight_counts(spark, d):
    """A dataset is a label"""
    e = read(spark, d, "embeddings").select("label", F.col("embedding").alias("w"))
    return inf.dataset_counts(e, [], "w", "label")


@query("weight_median", "SELECT CAST(f AS INT) AS f, round(quantile_cont(w, 0.5), 6) + 0.0 AS median, count(w) AS n, count(DISTINCT label) AS n_sources FROM (SELECT label, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS w FROM embeddings) GROUP BY 1")
def weight_median(spark, d):
    """E21 E22"""
    e = read(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("w"))
    return inf.weight_median(e, [], "w", "label").select("f", fn.r6(F.col("median")).alias("median"), "n", "n_sources")


@query("first_valid", f"SELECT feature_set, round(arg_min(corr, time_id) FILTER (WHERE corr IS NOT NULL AND time_id > 3), 6) + 0.0 AS first_valid FROM {_REC} GROUP BY 1")
def first_valid(spark, d):
    """The values of the first runs are taken out"""
    r = records(spark, d).withColumn("corr", F.when(F.col("time_id") > 3, F.col("corr")))
    return inf.first_valid(r, ["feature_set"], "time_id", "corr").select("feature_set", fn.r6(F.col("first_valid")).alias("first_valid"))


@query("min_score_pick", "SELECT l_returnflag AS series, l_orderkey AS best, l_extendedprice AS best_score FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey) AS k FROM lineitem) WHERE k = 1")
def min_score_pick(spark, d):
    """G5"""
    return inf.least_score(read(spark, d, "lineitem").withColumnRenamed("l_returnflag", "series"), ["series"], "l_orderkey", "l_extendedprice")


@query("align_by_index", """WITH a AS (SELECT CAST(o_custkey % 20 AS INT) AS run, o_orderkey AS idx FROM orders WHERE o_orderkey % 50 <> 1), b AS (SELECT CAST(o_custkey % 20 AS INT) AS run, o_orderkey AS idx FROM orders WHERE o_orderkey % 70 <> 2)
SELECT run, count(*) FILTER (WHERE a.idx IS NULL OR b.idx IS NULL) AS n_mismatch, count(*) AS n FROM (SELECT run, idx FROM a UNION SELECT run, idx FROM b) u LEFT JOIN a USING (run, idx) LEFT JOIN b USING (run, idx) GROUP BY run""")
def align_by_index(spark, d):
    """D10"""
    o = read(spark, d, "orders").select((F.col("o_custkey") % 20).cast("int").alias("run"), F.col("o_orderkey").alias("idx"))
    return inf.index_mismatches(o.where("idx % 50 <> 1"), o.where("idx % 70 <> 2"), "run", "idx")


_EXPORT = _SUMMARY.replace(") + 1) / (count(n.corr) + 1) AS p", ")) / count(n.corr) AS p")


@query("significance_export", f"""WITH s AS (SELECT * FROM {_EXPORT}), r AS (SELECT *, row_number() OVER (ORDER BY p, feature_set) AS k, count(*) OVER () AS n FROM s),
q AS (SELECT *, least(1.0, min(p * n / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r)
SELECT 'lineitem' AS dataset, feature_set AS metric, round(observed, 6) + 0.0 AS observed, round(null_mean, 6) + 0.0 AS null_mean, round(p, 6) AS p, {_STARS} AS label, round(q, 6) AS q, {_STARS.replace('p <', 'q <')} AS q_label FROM q""")
def significance_export(spark, d):
    """K11 with K2 and K8"""
    s = inf.null_summary(tagged(spark, d), ["feature_set"], "corr", F.col("source") == "observed").select("feature_set", "null_mean")
    p = inf.right_tail_p(_observed(spark, d), nulls(spark, d), ["feature_set"], "corr", plus_one=False).join(s, "feature_set")
    q = inf.bh_fdr(p, "p", tie=["feature_set"])
    return q.select(F.lit("lineitem").alias("dataset"), F.col("feature_set").alias("metric"), *(fn.r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "p", "q")), fn.stars(F.col("p")).alias("label"), fn.stars(F.col("q")).alias("q_label"))


_T = """(SELECT p_brand AS loc, regr_slope(l_extendedprice / 1000, l_quantity) AS slope, regr_count(l_extendedprice / 1000, l_quantity) - 2 AS dof, regr_sxx(l_extendedprice / 1000, l_quantity) AS sxx,
regr_syy(l_extendedprice / 1000, l_quantity) - power(regr_sxy(l_extendedprice / 1000, l_quantity), 2) / regr_sxx(l_extendedprice / 1000, l_quantity) AS sse FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def _t_map(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("loc"))
    li = read(spark, d, "lineitem").withColumn("y", F.col("l_extendedprice") / 1000).join(p, "l_partkey")
    return inf.regression_t(li, ["loc"], "y", "l_quantity")


@query("regression_t_map", f"SELECT loc, CAST(dof AS BIGINT) AS dof, round(slope, 6) + 0.0 AS slope, round(slope / sqrt(sse / dof / sxx), 4) + 0.0 AS t FROM {_T}")
def regression_t_map(spark, d):
    """K12"""
    return _t_map(spark, d).select("loc", "dof", fn.r6(F.col("slope")).alias("slope"), F.round("t", 4).alias("t"))


@query("t_to_z", f"SELECT loc, round((dof + 0.125) / (dof + 1.125) * sqrt((dof + 19.0 / 12) * ln(1 + t * t / (dof + 1.0 / 12))) * sign(t), 4) + 0.0 AS z FROM (SELECT loc, dof, slope / sqrt(sse / dof / sxx) AS t FROM {_T})")
def t_to_z(spark, d):
    """B26"""
    return _t_map(spark, d).select("loc", F.round(fn.t_to_z(F.col("t"), F.col("dof")), 4).alias("z"))


@query("fit_line", "SELECT l_returnflag AS feature_set, round(regr_slope(l_extendedprice / 1000, l_quantity), 6) + 0.0 AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 5) + 0.0 AS intercept, round(regr_r2(l_extendedprice / 1000, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def fit_line(spark, d):
    """J23"""
    y, x = F.col("l_extendedprice") / 1000, F.col("l_quantity")
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("feature_set")).agg(fn.r6(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 5).alias("intercept"), fn.r6(F.regr_r2(y, x)).alias("r2"))
