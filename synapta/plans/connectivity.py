"""Region time series, connectivity matrices and their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from synapta import functions as fn
from synapta.operators import connectivity as fc
from synapta.plans.base import LONG, long_vectors, query, read, vectors
from synapta.plans.screening import _BM, brand_month

#: Array positions in the roles of grey (0-39) and white (40-63) regions.
GREY = 40


def edges(spark, d):
    """All region pairs of each label, once; the three blocks are filters of it."""
    return fc.with_z(fc.pair_correlations(vectors(spark, d), "label", "x", 64))


_PAIRS = f"""(SELECT label, i, j, coalesce(r, 0) AS r, atanh(greatest(1e-6 - 1, least(1 - 1e-6, coalesce(r, 0)))) AS z FROM (
SELECT a.label, a.f AS i, b.f AS j, CASE WHEN count(*) > 1 AND stddev_samp(a.x) > 0 AND stddev_samp(b.x) > 0 THEN covar_samp(a.x, b.x) / (stddev_samp(a.x) * stddev_samp(b.x)) END AS r
FROM {LONG} a JOIN {LONG} b ON a.subid = b.subid AND a.f > b.f GROUP BY 1, 2, 3))"""

for _name, _sql in (("fc_gg", f"i < {GREY}"), ("fc_gw", f"i >= {GREY} AND j < {GREY}"), ("fc_ww", f"j >= {GREY}")):

    @query(_name, f"SELECT label, i, j, round(r, 6) + 0.0 AS r, round(z, 6) + 0.0 AS z FROM {_PAIRS} WHERE {_sql}")
    def _block(spark, d, rule=_sql):
        return edges(spark, d).where(rule).select("label", "i", "j", fn.r6(F.col("r")).alias("r"), fn.r6(F.col("z")).alias("z"))


@query("fc_vector_lower", f"SELECT label, CAST(i * (i - 1) // 2 + j AS INT) AS f, round(z, 6) + 0.0 AS z FROM {_PAIRS} WHERE i < {GREY}")
def fc_vector_lower(spark, d):
    """I1 (trap T2)"""
    return edges(spark, d).where(f"i < {GREY}").select("label", fc.lower_index(F.col("i"), F.col("j")).alias("f"), fn.r6(F.col("z")).alias("z"))


@query("fc_vector_upper", f"SELECT label, CAST(j * (2 * {GREY} - j - 1) // 2 + i - j - 1 AS INT) AS f, round(z, 6) + 0.0 AS z FROM {_PAIRS} WHERE i < {GREY}")
def fc_vector_upper(spark, d):
    """I3"""
    return edges(spark, d).where(f"i < {GREY}").select("label", fc.upper_index(F.col("j"), F.col("i"), GREY).alias("f"), fn.r6(F.col("z")).alias("z"))


@query("fc_vector_full", f"SELECT label, CAST(j * {64 - GREY} + i - {GREY} AS INT) AS f, round(z, 6) + 0.0 AS z FROM {_PAIRS} WHERE i >= {GREY} AND j < {GREY}")
def fc_vector_full(spark, d):
    """Grey rows by white columns"""
    return edges(spark, d).where(f"i >= {GREY} AND j < {GREY}").select("label", fc.rectangle_index(F.col("j"), F.col("i") - GREY, 64 - GREY).alias("f"), fn.r6(F.col("z")).alias("z"))


@query("fc_matrix_rebuild", f"""WITH e AS (SELECT label, i, j, z FROM {_PAIRS} WHERE i < {GREY}), b AS (SELECT * FROM e UNION ALL SELECT label, j, i, z FROM e)
SELECT label, CAST({GREY - 1} - i AS INT) AS i, CAST({GREY - 1} - j AS INT) AS j, round(z, 6) + 0.0 AS z, {GREY} AS n FROM b""")
def fc_matrix_rebuild(spark, d):
    """Vector, matrix, regions in reverse order"""
    v = fc_vector_lower(spark, d)
    order = spark.range(GREY).select(F.col("id").cast("int").alias("old_idx"), (GREY - 1 - F.col("id")).cast("int").alias("new_idx"))
    n = fc.dimension(F.lit(GREY * (GREY - 1) // 2))
    return fc.reorder(fc.rebuild(v, "f", "z"), order).select("label", "i", "j", "z", n.alias("n"))


@query("fc_group_mean", f"SELECT i, j, round(avg(r), 6) + 0.0 AS mean, count(*) AS n_subjects FROM {_PAIRS} WHERE i < {GREY} GROUP BY 1, 2")
def fc_group_mean(spark, d):
    return fc.group_mean(edges(spark, d).where(f"i < {GREY}"), ["i", "j"], "r").select("i", "j", fn.r6(F.col("mean")).alias("mean"), "n_subjects")


@query("matrix_summary", f"SELECT label, round(avg(r), 6) + 0.0 AS mean, round(stddev_pop(r), 6) AS std, round(min(r), 6) + 0.0 AS min, round(max(r), 6) AS max FROM {_PAIRS} GROUP BY 1")
def matrix_summary(spark, d):
    return fc.matrix_summary(edges(spark, d), ["label"], "r").select("label", *(fn.r6(F.col(c)).alias(c) for c in ("mean", "std", "min", "max")))


def _halves(spark, d):
    v = vectors(spark, d)
    half = lambda k: fc.with_z(fc.pair_correlations(v.where(f"subid % 2 = {k}"), "label", "x", 64)).where(f"i < {GREY}")
    return half(0), half(1)


def _half_sql(k):
    return _PAIRS.replace("a.f > b.f", f"a.f > b.f AND a.subid % 2 = {k} AND a.f < {GREY}")


_BOTH = f"(SELECT label, i, j, a.r AS a, b.r AS b FROM {_half_sql(0)} a JOIN {_half_sql(1)} b USING (label, i, j))"
_SIM = f"(SELECT label, covar_samp(a, b) / (stddev_samp(a) * stddev_samp(b)) AS r, count(*) AS n, avg(abs(a - b)) AS mad, avg(CASE WHEN sign(a) = sign(b) THEN 1.0 ELSE 0.0 END) AS sign_agreement FROM {_BOTH} GROUP BY label)"


@query("fc_similarity", f"SELECT label, round(r, 6) + 0.0 AS r, n, round(mad, 6) AS mad, round(sign_agreement, 6) AS sign_agreement FROM {_SIM}")
def fc_similarity(spark, d):
    a, b = _halves(spark, d)
    out = fc.similarity(a, b, ["label", "i", "j"], ["label"], "r")
    return out.select("label", fn.r6(F.col("r")).alias("r"), "n", fn.r6(F.col("mad")).alias("mad"), fn.r6(F.col("sign_agreement")).alias("sign_agreement"))


@query("fc_similarity_report", f"SELECT round(avg(r), 6) + 0.0 AS mean, round(quantile_cont(r, 0.5), 6) + 0.0 AS median, round(quantile_cont(r, 0.25), 6) + 0.0 AS q25, round(quantile_cont(r, 0.75), 6) + 0.0 AS q75, round(min(r), 6) + 0.0 AS min, round(max(r), 6) + 0.0 AS max, count(r) AS n FROM {_SIM}")
def fc_similarity_report(spark, d):
    """E15"""
    a, b = _halves(spark, d)
    out = fc.similarity_report(fc.similarity(a, b, ["label", "i", "j"], ["label"], "r"), "r")
    return out.select(*(fn.r6(F.col(c)).alias(c) for c in ("mean", "median", "q25", "q75", "min", "max")), "n")


@query("matrix_difference", f"SELECT label, i, j, round(b - a, 6) + 0.0 AS diff FROM {_BOTH}")
def matrix_difference(spark, d):
    a, b = _halves(spark, d)
    return fc.difference(a, b, ["label", "i", "j"], "r").select("label", "i", "j", fn.r6(F.col("diff")).alias("diff"))


@query("nearest_template", f"""WITH v AS (SELECT * FROM {LONG}), t AS (SELECT label AS template, f, avg(x) AS t FROM v GROUP BY 1, 2),
r AS (SELECT subid, template, covar_samp(x, t) / (stddev_samp(x) * stddev_samp(t)) AS r FROM v JOIN t USING (f) GROUP BY 1, 2)
SELECT subid, template, round(r, 6) + 0.0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY subid ORDER BY r DESC, template) AS k FROM r) WHERE k = 1""")
def nearest_template(spark, d):
    v = long_vectors(spark, d)
    t = v.groupBy(F.col("label").alias("template"), "f").agg(F.avg("x").alias("x"))
    return fc.nearest_template(v, t, "subid", "template", "f", "x").select("subid", "template", fn.r6(F.col("r")).alias("r"))


@query("roi_mean_masked", "SELECT p_brand AS roi, l_linenumber AS t, round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) / count(*), 6) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def roi_mean_masked(spark, d):
    labels = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("roi"))
    li = read(spark, d, "lineitem").withColumnRenamed("l_linenumber", "t")
    return fc.roi_means(li, labels, "l_partkey", ["roi", "t"], "l_quantity", F.col("l_returnflag") == "N").select("roi", "t", fn.r6(F.col("mean")).alias("mean"))


_LABELS = "(SELECT p_partkey, CAST(substr(p_brand, 7) AS INT) % 5 AS ribbon, p_size AS wmparc FROM part)"


def _labels(spark, d):
    return read(spark, d, "part").select("p_partkey", (F.substring("p_brand", 7, 3).cast("int") % 5).alias("ribbon"), F.col("p_size").alias("wmparc"))


@query("tissue_classify", f"""SELECT p_partkey, CASE WHEN wmparc IN (7, 16, 46) THEN 2 WHEN ribbon IN (3) THEN 1 WHEN ribbon IN (2) THEN 2 WHEN wmparc IN (4, 5, 14, 15, 43) THEN 3 ELSE 0 END AS tissue FROM {_LABELS}""")
def tissue_classify(spark, d):
    """B17"""
    return fc.tissue_labels(_labels(spark, d), "ribbon", "wmparc", [3], [2], [7, 16, 46], [4, 5, 14, 15, 43]).select("p_partkey", "tissue")


@query("csf_mask", f"SELECT p_partkey, CASE WHEN bool_and(wmparc BETWEEN 0 AND 3) OVER (PARTITION BY ribbon) THEN wmparc = 3 ELSE wmparc IN (4, 5, 14, 15) END AS is_csf FROM {_LABELS}")
def csf_mask(spark, d):
    """A subject is a ribbon value"""
    return fc.csf_mask(_labels(spark, d), ["ribbon"], "wmparc", [4, 5, 14, 15]).select("p_partkey", "is_csf")


@query("tissue_mask_by_dataset", "SELECT c_custkey, c_mktsegment AS dataset, c_nationkey % 4 = CASE c_mktsegment WHEN 'BUILDING' THEN 2 ELSE 1 END AS is_gm, c_nationkey % 4 = CASE c_mktsegment WHEN 'BUILDING' THEN 3 ELSE 2 END AS is_wm FROM customer")
def tissue_mask_by_dataset(spark, d):
    """One dataset has other codes than the rest (trap T4)"""
    c = read(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"), (F.col("c_nationkey") % 4).alias("label"))
    config = c.select("dataset").distinct().select("dataset", F.when(F.col("dataset") == "BUILDING", 2).otherwise(1).alias("gm"), F.when(F.col("dataset") == "BUILDING", 3).otherwise(2).alias("wm"))
    return fc.tissue_masks(c, config, "dataset", "label").select("c_custkey", "dataset", "is_gm", "is_wm")


@query("merged_features", "SELECT vec_id AS subid, list_transform(list_concat(embedding[1:32], embedding[33:48]), lambda x: round(x::DOUBLE, 6) + 0.0) AS GG_GW, list_transform(list_concat(embedding[1:32], embedding[49:64]), lambda x: round(x::DOUBLE, 6) + 0.0) AS GG_WW, list_transform(embedding[33:64], lambda x: round(x::DOUBLE, 6) + 0.0) AS GW_WW, list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0.0) AS GG_GW_WW FROM embeddings")
def merged_features(spark, d):
    """B29 I4"""
    v = vectors(spark, d).select("subid", *(F.transform(F.slice("x", a, n), lambda y: F.round(y, 6)).alias(b) for b, a, n in (("GG", 1, 32), ("GW", 33, 16), ("WW", 49, 16))))
    return fc.merged_sets(v, "GG", "GW", "WW").drop("GG", "GW", "WW")


@query("feature_blocks", "SELECT b AS block, CAST(o AS INT) AS position, CAST(sum(n) AS BIGINT) AS n_features FROM (SELECT unnest(['GG', 'GW', 'WW']) AS b, unnest([0, 1, 2]) AS o, unnest([32, 16, 16]) AS n FROM embeddings) GROUP BY 1, 2")
def feature_blocks(spark, d):
    """Features of each block over all subjects, with the blocks' display order"""
    order = {"GG": 0, "GW": 1, "WW": 2}
    block = F.when(F.col("f") < 32, "GG").when(F.col("f") < 48, "GW").otherwise("WW")
    return long_vectors(spark, d).groupBy(block.alias("block")).agg(F.count("*").alias("n_features")).select("block", fn.recode(F.col("block"), order).alias("position"), "n_features")


@query("subject_matrix", f"SELECT label, list(round(z, 6) + 0.0 ORDER BY i, j) AS x FROM {_PAIRS} WHERE i < {GREY} GROUP BY label")
def subject_matrix(spark, d):
    """I5"""
    return fc.subject_vectors(fc_vector_lower(spark, d), "label", "f", "z")


@query("grid_fill_mask", f"""WITH b AS (SELECT * FROM {_BM}), g AS (SELECT roi, unnest(range(24, 145)) AS t FROM (SELECT DISTINCT roi FROM b))
SELECT roi, CAST(t AS INT) AS t, round(coalesce(x, 0), 6) AS x, x IS NOT NULL AS covered, bool_and(x IS NOT NULL) OVER (PARTITION BY roi) AS is_full FROM g LEFT JOIN b USING (roi, t)""")
def grid_fill_mask(spark, d):
    """I10"""
    return fc.fill_grid(brand_month(spark, d), ["roi"], "t", "x", 24, 144).select("roi", "t", fn.r6(F.col("x")).alias("x"), "covered", "is_full")


@query("run_keyed_output", "SELECT user_id AS subid, event_type AS run, count(*) AS n FROM events GROUP BY 1, 2")
def run_keyed_output(spark, d):
    """Runs stay a column"""
    return read(spark, d, "events").groupBy(F.col("user_id").alias("subid"), F.col("event_type").alias("run")).agg(F.count("*").alias("n"))
