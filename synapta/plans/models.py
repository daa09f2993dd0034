"""Regression, splits, permutation and partial least squares over the embedding vectors (subject: vector, target: label)."""

from __future__ import annotations

from pyspark.sql import functions as F

from synapta import functions as fn
from synapta.operators import crossval as cv
from synapta.operators import inference as inf
from synapta.operators import models as md
from synapta.plans.base import LONG, long_vectors, query, read, vectors
from synapta.sources import io

K, SEED = 5, "split"
_ORD = "row_number() OVER (ORDER BY label DESC, vec_id)"
_FOLDS = f"(SELECT subid, label, row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', '{SEED}', subid)), subid) - 1 AS fold FROM (SELECT vec_id AS subid, label, ({_ORD} - 1) // {K} AS b FROM embeddings))"


def folds(spark, d):
    return md.block_folds(vectors(spark, d).select("subid", "label"), "label", "subid", K, SEED, io.checkpointed)


@query("fold_assign", f"SELECT subid, label, CAST(fold AS INT) AS fold FROM {_FOLDS}")
def fold_assign(spark, d):
    """F11 J9"""
    return folds(spark, d)


@query("repeated_folds", f"""WITH t AS (SELECT unnest(range(101)) AS time_id), o AS (SELECT time_id, vec_id AS subid, ({_ORD.replace('OVER (', 'OVER (PARTITION BY time_id ')} - 1) // {K} AS b FROM embeddings, t)
SELECT CAST(time_id AS INT) AS time_id, subid, CAST(row_number() OVER (PARTITION BY time_id, b ORDER BY md5(concat_ws('|', '{SEED}', time_id, subid)), subid) - 1 AS INT) AS fold FROM o""")
def repeated_folds(spark, d):
    """J10 J17"""
    t = md.repeats(vectors(spark, d).select("subid", "label"), 101)
    return md.block_folds(t, "label", "subid", K, SEED, io.checkpointed, by=["time_id"]).select("time_id", "subid", "fold")


@query("split_reuse", f"SELECT f.fold, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) + 0.0 AS gg, round(avg(embedding[33]::DOUBLE), 6) + 0.0 AS gw FROM {_FOLDS} f JOIN embeddings ON vec_id = f.subid GROUP BY 1")
def split_reuse(spark, d):
    """Two feature sets joined to one stored split"""
    j = folds(spark, d).select("subid", "fold").join(vectors(spark, d), "subid")
    return j.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count("*").alias("n"), fn.r6(F.avg(F.col("x")[0])).alias("gg"), fn.r6(F.avg(F.col("x")[32])).alias("gw"))


def _bin_sql(y, table, bins=10, least=2):
    parts = []
    for b in range(bins, 1, -1):
        qs = ", ".join(str(i / b) for i in range(b + 1))
        parts.append(f"SELECT {b} AS b, k, greatest(len(list_filter(list_distinct((SELECT quantile_cont({y}, [{qs}]) FROM {table})), lambda e: e < y)) - 1, 0) AS s FROM v")
    union = " UNION ALL ".join(parts)
    return f"WITH v AS (SELECT c_custkey AS k, {y} AS y FROM {table}), a AS ({union}), c AS (SELECT b, s, count(*) AS n FROM a GROUP BY 1, 2), u AS (SELECT max(b) AS b FROM (SELECT b FROM c GROUP BY b HAVING min(n) >= {least} AND count(*) >= 2)) SELECT k AS c_custkey, CAST(s AS INT) AS stratum FROM a JOIN u USING (b)"


_STRATA = _bin_sql("c_nationkey", "customer")


def strata(spark, d):
    return md.quantile_strata(read(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", 10, 2)


@query("quantile_strata", _STRATA)
def quantile_strata(spark, d):
    """F12"""
    return strata(spark, d).select("c_custkey", "stratum")


@query("half_split", f"SELECT c_custkey, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws('|', 'half', c_custkey)), c_custkey) % 2 = 1 THEN 'train' ELSE 'test' END AS side FROM ({_STRATA})")
def half_split(spark, d):
    """J12 J14"""
    return md.check_split(md.half_split(strata(spark, d), "stratum", "c_custkey", "half"), "c_custkey").select("c_custkey", "stratum", "side")


@query("family_half_split", f"""WITH s AS (SELECT c_custkey, stratum, c_nationkey || c_mktsegment AS family FROM ({_STRATA}) JOIN customer USING (c_custkey)),
f AS (SELECT family, count(*) AS n, CAST(floor(quantile_cont(stratum, 0.5)) AS INT) AS s FROM s GROUP BY 1),
r AS (SELECT family, CASE WHEN row_number() OVER (PARTITION BY s ORDER BY n DESC, md5(concat_ws('|', 'family', family)), family) % 4 IN (0, 1) THEN 'train' ELSE 'test' END AS side FROM f)
SELECT c_custkey, family, side FROM s JOIN r USING (family)""")
def family_half_split(spark, d):
    """J13 J14"""
    s = strata(spark, d).join(read(spark, d, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment").alias("family")), "c_custkey")
    return md.check_split(md.family_half_split(s, "family", "stratum", "c_custkey", "family"), "family").select("c_custkey", "family", "side")


@query("label_permutation", f"""WITH t AS (SELECT f.subid, f.label, p AS perm_id, f.fold <> 0 AS is_train FROM {_FOLDS} f, (SELECT unnest(range(1000)) AS p)),
a AS (SELECT *, row_number() OVER (PARTITION BY perm_id, is_train ORDER BY subid) AS k FROM t),
b AS (SELECT perm_id, is_train, label AS y, row_number() OVER (PARTITION BY perm_id, is_train ORDER BY CASE WHEN perm_id = 0 THEN '' ELSE md5(concat_ws('|', 'perm', perm_id, subid)) END, subid) AS k FROM t)
SELECT CAST(perm_id AS INT) AS perm_id, subid, CASE WHEN is_train THEN y ELSE label END AS y_perm FROM a JOIN b USING (perm_id, is_train, k)""")
def label_permutation(spark, d):
    """J16 J17"""
    t = io.checkpointed(folds(spark, d).select("subid", "label", (F.col("fold") != 0).alias("is_train")))
    return md.permuted_copies(t, "label", "subid", "perm", 1000, "is_train", io.checkpointed)


_COV = f"(SELECT l.subid, l.f, l.x, CAST(length(coalesce(d.text, '')) AS DOUBLE) / 1000 AS c FROM {LONG} l JOIN documents d ON d.doc_id = l.subid)"


def covariates(spark, d):
    """Long features with the covariates of the document of the same number."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("subid"), "lang", (F.char_length(F.coalesce("text", F.lit(""))).cast("double") / 1000).alias("motion"))
    return long_vectors(spark, d).join(docs, "subid")


@query("residualise", f"SELECT subid, CAST(f AS INT) AS f, round(x - avg(x) OVER w - regr_slope(x, c) OVER w * (c - avg(c) OVER w), 5) + 0.0 AS resid FROM {_COV} WINDOW w AS (PARTITION BY f)")
def residualise(spark, d):
    """J2 with one numeric covariate"""
    x, names = md.design(covariates(spark, d), [], ["motion"])
    return md.residuals(x, ["f"], names, "x", "resid").select("subid", "f", F.round("resid", 5).alias("resid"))


_SITE = f"(SELECT l.subid, l.f, l.x, lang, length(coalesce(text, '')) / 1000.0 AS c FROM {LONG} l JOIN documents ON doc_id = l.subid)"


@query("residualise_site", f"""WITH v AS (SELECT * FROM {_SITE}), g AS (SELECT f, lang, avg(x) AS mx, avg(c) AS mc FROM v WHERE subid % 2 = 0 GROUP BY 1, 2),
b AS (SELECT f, sum((c - mc) * (x - mx)) / sum(power(c - mc, 2)) AS b FROM v JOIN g USING (f, lang) WHERE subid % 2 = 0 GROUP BY 1)
SELECT subid, CAST(f AS INT) AS f, round(x - mx - b * (c - mc), 5) + 0.0 AS resid FROM v JOIN g USING (f, lang) JOIN b USING (f)""")
def residualise_site(spark, d):
    """Site dummies and motion, fitted on even subjects, applied to all"""
    x, names = md.design(covariates(spark, d), ["lang"], ["motion"])
    return md.residuals(x, ["f"], names, "x", "resid", where="subid % 2 = 0").select("subid", "f", F.round("resid", 5).alias("resid"))


@query("minmax_train_test", f"WITH v AS (SELECT l.*, s.fold FROM {LONG} l JOIN {_FOLDS} s ON l.subid = s.subid), r AS (SELECT f, min(x) AS lo, max(x) AS hi FROM v WHERE fold <> 0 GROUP BY 1) SELECT subid, CAST(f AS INT) AS f, round(coalesce((x - lo) / nullif(hi - lo, 0), 0), 6) + 0.0 AS scaled FROM v JOIN r USING (f) WHERE fold = 0")
def minmax_train_test(spark, d):
    """J3"""
    v = long_vectors(spark, d).join(folds(spark, d).select("subid", "fold"), "subid")
    return md.minmax(v, ["f"], "x", "fold <> 0", "scaled").where("fold = 0").select("subid", "f", fn.r6(F.col("scaled")).alias("scaled"))


@query("zscore_guarded", f"SELECT subid, CAST(f AS INT) AS f, round(coalesce((x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0), 0), 5) + 0.0 AS z FROM (SELECT subid, f, CASE WHEN f = 0 THEN 1.0 ELSE x END AS x FROM {LONG}) WINDOW w AS (PARTITION BY f)")
def zscore_guarded(spark, d):
    """J20"""
    v = long_vectors(spark, d).withColumn("x", F.when(F.col("f") == 0, 1.0).otherwise(F.col("x")))
    return md.zscore_or_zero(v, ["f"], "x", "z").select("subid", "f", F.round("z", 5).alias("z"))


_STD = f"""s AS (SELECT subid, f, (x - avg(x) OVER (PARTITION BY f)) / stddev_samp(x) OVER (PARTITION BY f) AS e, (label - avg(label) OVER (PARTITION BY f)) / stddev_samp(label) OVER (PARTITION BY f) AS y FROM {LONG}),
w0 AS (SELECT f, sum(e * y) AS w FROM s GROUP BY 1), w1 AS (SELECT f, w / sqrt(sum(w * w) OVER ()) AS w FROM w0), t1 AS (SELECT subid, sum(e * w) AS t, any_value(y) AS y FROM s JOIN w1 USING (f) GROUP BY 1),
q1 AS (SELECT sum(t * t) AS tt, sum(t * y) / sum(t * t) AS q FROM t1)"""
_STD2 = _STD + """, p1 AS (SELECT f, sum(e * t) / any_value(tt) AS p FROM s JOIN t1 USING (subid), q1 GROUP BY 1),
s2 AS (SELECT s.subid, f, e - t * p AS e, s.y - q * t AS y FROM s JOIN t1 USING (subid) JOIN p1 USING (f), q1),
w2 AS (SELECT f, w / sqrt(sum(w * w) OVER ()) AS w FROM (SELECT f, sum(e * y) AS w FROM s2 GROUP BY 1)), t2 AS (SELECT subid, sum(e * w) AS t, any_value(y) AS y FROM s2 JOIN w2 USING (f) GROUP BY 1),
q2 AS (SELECT sum(t * y) / sum(t * t) AS q FROM t2)"""


def _scores(spark, d, k):
    return md.pls1_long(long_vectors(spark, d).withColumn("label", F.col("label").cast("double")), "subid", "f", "x", "label", k, io.checkpointed)[0]


@query("pls1_k1", f"WITH {_STD} SELECT subid, round(t, 5) + 0.0 AS t1, round(q * t, 5) + 0.0 AS yhat FROM t1, q1")
def pls1_k1(spark, d):
    """J4 on standardised values"""
    return _scores(spark, d, 1).select("subid", F.round("t1", 5).alias("t1"), F.round("fit1", 5).alias("yhat"))


@query("pls1_k2", f"WITH {_STD2} SELECT t1.subid, round(t2.t, 5) + 0.0 AS t2, round(q1.q * t1.t + q2.q * t2.t, 5) + 0.0 AS yhat FROM t1 JOIN t2 USING (subid), q1, q2")
def pls1_k2(spark, d):
    return _scores(spark, d, 2).select("subid", F.round("t2", 5).alias("t2"), F.round(F.col("fit1") + F.col("fit2"), 5).alias("yhat"))


@query("haufe_weights", f"WITH {_STD}, c AS (SELECT l.f, covar_samp(l.x, t) AS c FROM {LONG} l JOIN t1 USING (subid) GROUP BY 1) SELECT CAST(f AS INT) AS f, round(c / sqrt(sum(c * c) OVER ()), 5) + 0.0 AS w_haufe FROM c")
def haufe_weights(spark, d):
    """J18 J19"""
    return md.haufe(long_vectors(spark, d), _scores(spark, d, 1), "subid", "f", "x", "t1").select("f", F.round("w_haufe", 5).alias("w_haufe"))


SETS = {"GG": (0, 32), "GW": (32, 16), "WW": (48, 16), "GG_GW_WW": (0, 64)}


def subjects(spark, d):
    """Vectors and targets with the design of the covariates."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("subid"), "lang", (F.char_length(F.coalesce("text", F.lit(""))) / 1000).alias("motion"))
    v, names = md.design(vectors(spark, d).join(docs, "subid", "left").na.fill({"motion": 0.0, "lang": "en"}), ["lang"], ["motion"])
    return v.select("subid", F.col("label").cast("double").alias("y"), F.array(*names).alias("c"), "x")


@query("nested_cv_score")
def nested_cv_score(spark, d):
    """Mean over folds of each repeat and feature set"""
    r = cv.nested_cv_scores(subjects(spark, d), SETS, io.checkpointed, cv.Plan(folds=K, fold_seed=SEED))
    return r.groupBy("time_id", "feature_set").agg(fn.r6(F.avg("corr")).alias("mean_corr"), fn.r6(F.avg("mae")).alias("mean_mae"), F.count("*").alias("n_folds"))


@query("permutation_null")
def permutation_null(spark, d):
    """The median correlation of all repeats against 1,000 whole runs on permuted training labels, for each feature set"""
    run = lambda plan: cv.nested_cv_scores(subjects(spark, d), SETS, io.checkpointed, plan).groupBy("time_id", "feature_set").agg(F.avg("corr").alias("mean_corr"))
    seen = run(cv.Plan(folds=K, fold_seed=SEED)).withColumn("permuted", F.lit(False))
    null = run(cv.Plan(times=1000, folds=K, fold_seed="permuted", permute="perm")).withColumn("permuted", F.lit(True))
    both = io.checkpointed(seen.unionByName(null))
    s = inf.null_summary(both, ["feature_set"], "mean_corr", ~F.col("permuted"))
    return s.select("feature_set", "n_null", *(fn.r6(F.col(c)).alias(c) for c in ("observed", "null_mean", "null_median", "null_std", "z", "p")), "label")


@query("pls1_grid")
def pls1_grid(spark, d):
    """The fits of one repeat with weights and activation patterns"""
    r = cv.nested_cv_scores(subjects(spark, d), SETS, io.checkpointed, cv.Plan(times=1, folds=K, fold_seed=SEED))
    return r.select("time_id", "feature_set", "fold", "n_comp", fn.r6(F.col("corr")).alias("corr"), fn.r6(F.col("mae")).alias("mae"), F.col("n_test").cast("int").alias("n_test"), F.size("w").alias("n_weights"))


@query("pls1_edges")
def pls1_edges(spark, d):
    """J4 J8 with more features than subjects: products of all pairs of positions (2,016 edges), one repeat"""
    edges = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: F.transform(F.slice("x", 1, i), lambda v: v * F.get("x", i))))
    wide = subjects(spark, d).withColumn("x", edges)
    r = cv.nested_cv_scores(wide, {"edges": (0, 2016)}, io.checkpointed, cv.Plan(times=1, folds=K, fold_seed=SEED))
    return r.select("time_id", "feature_set", "fold", "n_comp", fn.r6(F.col("corr")).alias("corr"), fn.r6(F.col("mae")).alias("mae"), F.col("n_test").cast("int").alias("n_test"), F.size("w").alias("n_weights"))


_FM = "(SELECT time_id, fold, avg(abs(l_discount * 100 - l_tax * 100)) AS mae, corr(l_tax, l_discount) AS corr FROM (SELECT CAST(l_suppkey % 10 AS INT) AS time_id, CAST(l_partkey % 5 AS INT) AS fold, l_discount, l_tax FROM lineitem) GROUP BY 1, 2)"


@query("fold_metrics", f"SELECT time_id, round(avg(corr), 6) + 0.0 AS mean_corr, round(avg(mae), 6) AS mean_mae, round(avg(1 / mae), 6) AS mean_mae_inv, count(*) AS n_folds FROM {_FM} GROUP BY 1")
def fold_metrics(spark, d):
    """E32 E33 E34"""
    li = read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("time_id"), (F.col("l_partkey") % 5).cast("int").alias("fold"), (F.col("l_tax") * 100).alias("y"), (F.col("l_discount") * 100).alias("yhat"))
    m = md.fold_metrics(li, ["time_id"], "fold", "y", "yhat")
    return m.select("time_id", *(fn.r6(F.col(c)).alias(c) for c in ("mean_corr", "mean_mae", "mean_mae_inv")), "n_folds")
