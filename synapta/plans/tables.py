"""Cleaning, variance, decomposition, component features, scans and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from synapta import functions as fn
from synapta.operators import cleaning as cl
from synapta.operators import cohort
from synapta.operators import components as cp
from synapta.operators import models as md
from synapta.operators import motion
from synapta.plans.base import FRAMES, LONG, frames, long_vectors, query, read, vectors
from synapta.plans.screening import _BM, brand_month
from synapta.sources import io


def r(df, keys, cols, places=5):
    return df.select(*keys, *(F.round(c, places).alias(c) for c in cols))


# --- regression of confounds: lineitem rows of a brand, price on two regressors -------------------------------------
def brands(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("loc"))
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_extendedprice") / 1000).alias("y"))
    return li.join(p, "l_partkey").withColumn("one", F.lit(1.0))


_BR = "(SELECT p_brand AS loc, l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_discount * 100 AS b, l_extendedprice / 1000 AS y FROM lineitem JOIN part ON l_partkey = p_partkey)"
_TWO = f"""(SELECT loc, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_samp(a, y) AS ay, covar_samp(b, y) AS by_, covar_samp(a, b) AS ab, var_samp(a) AS aa, var_samp(b) AS bb FROM {_BR} GROUP BY 1)"""
_BETA = f"(SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ba, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS bb_ FROM {_TWO})"
_KEY = "loc, l_orderkey, l_linenumber, l_partkey"
_K = ["loc", "l_orderkey", "l_linenumber", "l_partkey"]


@query("ols_clean_full", f"SELECT {_KEY}, round(y - my - ba * (a - ma) - bb_ * (b - mb), 4) + 0.0 AS resid FROM {_BR} JOIN {_BETA} USING (loc)")
def ols_clean_full(spark, d):
    """L2 J6"""
    return r(cl.full_cleanup(brands(spark, d), ["loc"], ["one", "a", "b"], "y", "resid"), _K, ["resid"], 4)


@query("ols_clean_partial", f"SELECT {_KEY}, round(y - bb_ * b, 6) + 0.0 AS resid FROM {_BR} JOIN {_BETA} USING (loc)")
def ols_clean_partial(spark, d):
    """L3"""
    return r(cl.partial_cleanup(brands(spark, d), ["loc"], ["one", "a", "b"], ["b"], "y", "resid"), _K, ["resid"], 6)


@query("temporal_cleanup", f"""WITH b AS (SELECT roi, t, x, CASE WHEN t < 40 THEN 0 ELSE 1 END AS run, avg(x) OVER (PARTITION BY t) AS g, (t % 12)::DOUBLE AS c FROM {_BM}),
v AS (SELECT roi, run, stddev_samp(x) AS vn, avg(x) AS m FROM b GROUP BY 1, 2), u AS (SELECT roi, run, m, greatest(vn / avg(vn) OVER (PARTITION BY run), 0.001) AS vn FROM v),
k AS (SELECT roi, avg(vn) AS back FROM u GROUP BY 1), s AS (SELECT avg(g) AS mg, stddev_samp(g) AS sg, avg(c) AS mc, stddev_samp(c) AS sc FROM (SELECT DISTINCT run, t, g, c FROM b)),
d AS (SELECT b.roi, b.run, b.t, (x - m) / u.vn * back AS y, (g - mg) / sg AS ga, (c - mc) / sc AS ca, u.vn FROM b JOIN u USING (roi, run) JOIN k USING (roi), s),
f AS (SELECT roi, covar_samp(ga, y) AS ay, covar_samp(ca, y) AS by_, covar_samp(ga, ca) AS ab, var_samp(ga) AS aa, var_samp(ca) AS bb FROM d GROUP BY 1)
SELECT d.roi, CAST(run AS INT) AS run, CAST(t AS INT) AS t, round(y - (by_ * aa - ay * ab) / (aa * bb - ab * ab) * ca, 5) + 0.0 AS clean, round(vn, 6) AS vn FROM d JOIN f USING (roi)""")
def temporal_cleanup(spark, d):
    """Two runs; a global course that stays and a seasonal one that goes"""
    b = brand_month(spark, d).withColumn("run", F.when(F.col("t") < 40, 0).otherwise(1))
    b = b.withColumns({"g": F.avg("x").over(Window.partitionBy("t")), "c": (F.col("t") % 12).cast("double"), "vn": F.stddev_samp("x").over(Window.partitionBy("roi", "run"))})
    out = cl.temporal_cleanup(b, ["roi"], "run", "t", "x", "vn", ["g", "c"], ["c"], "clean")
    return out.select("roi", "run", F.col("t").cast("int").alias("t"), F.round("clean", 5).alias("clean"), F.round("vn", 6).alias("vn"))


@query("nuisance_pair", f"SELECT {_KEY}, round(y - my - ay / aa * (a - ma), 4) + 0.0 AS one_out, round(y - my - ba * (a - ma) - bb_ * (b - mb), 4) + 0.0 AS both_out FROM {_BR} JOIN {_BETA} USING (loc)")
def nuisance_pair(spark, d):
    """With one and with two nuisance signals"""
    x = md.residuals(brands(spark, d), ["loc"], ["one", "a"], "y", "one_out")
    return r(md.residuals(x, ["loc"], ["one", "a", "b"], "y", "both_out"), _K, ["one_out", "both_out"], 4)


@query("component_maps", f"SELECT loc, round(ba, 5) + 0.0 AS a, round(bb_, 5) + 0.0 AS b FROM {_BETA}")
def component_maps(spark, d):
    """L18"""
    return r(cl.component_maps(brands(spark, d), ["loc"], ["a", "b"], "y"), ["loc"], ["a", "b"])


@query("variance_normalise", f"SELECT loc, round(greatest(stddev_samp(y - ba * a), 0.001), 5) AS vn FROM {_BR} JOIN (SELECT loc, ay / aa AS ba FROM {_TWO}) USING (loc) GROUP BY 1")
def variance_normalise(spark, d):
    """L8"""
    return r(cl.variance_normaliser(brands(spark, d), ["loc"], ["one", "a"], "y"), ["loc"], ["vn"])


@query("mean_signal_regression", f"WITH b AS (SELECT * FROM {_BM}), g AS (SELECT t, avg(x) AS g FROM b GROUP BY 1) SELECT roi, round(regr_slope(x, g), 5) + 0.0 AS beta, round(var_samp(x) * (1 - regr_r2(x, g)), 5) AS var_resid, round(regr_r2(x, g), 5) AS r2 FROM b JOIN g USING (t) GROUP BY 1")
def mean_signal_regression(spark, d):
    """L4"""
    return r(cl.mean_signal_regression(brand_month(spark, d), ["roi"], "t", "x"), ["roi"], ["beta", "var_resid", "r2"])


_STAGE = f"(SELECT loc, y AS raw, y - ay / aa * (a - ma) AS s1, y - ba * (a - ma) - bb_ * (b - mb) AS s2 FROM {_BR} JOIN {_BETA} USING (loc))"


@query("variance_partition", f"""WITH v AS (SELECT loc, var_samp(raw) AS total, var_samp(raw - s1) AS raw_to_s1, var_samp(s1 - s2) AS s1_to_s2, var_samp(s2) AS unstructured FROM {_STAGE} GROUP BY 1)
SELECT loc, round(raw_to_s1 / total, 5) AS raw_to_s1_share, round(s1_to_s2 / total, 5) AS s1_to_s2_share, round(unstructured / total, 5) AS unstructured_share, round((total - raw_to_s1 - s1_to_s2 - unstructured) / total, 5) + 0.0 AS shared_share FROM v""")
def variance_partition(spark, d):
    """L5 L6 E28 E29"""
    x = md.residuals(brands(spark, d), ["loc"], ["one", "a"], "y", "s1")
    x = md.residuals(x, ["loc"], ["one", "a", "b"], "y", "s2").withColumnRenamed("y", "raw")
    return r(cl.variance_partition(x, ["loc"], ["raw", "s1", "s2"]), ["loc"], ["raw_to_s1_share", "s1_to_s2_share", "unstructured_share", "shared_share"])


@query("temporal_moments", f"SELECT roi, round(avg(x), 5) AS mean, round(stddev_samp(x), 5) AS std, round(var_samp(x), 5) AS var, round(stddev_samp(x) / avg(x), 5) AS cov, round(avg(x) / stddev_samp(x), 5) AS tsnr FROM {_BM} GROUP BY 1")
def temporal_moments(spark, d):
    """E28"""
    return r(cl.temporal_moments(brand_month(spark, d), ["roi"], "x"), ["roi"], ["mean", "std", "var", "cov", "tsnr"])


@query("map_report", f"WITH m AS (SELECT roi, avg(x) AS mean, stddev_samp(x) AS std FROM {_BM} GROUP BY 1) SELECT 1 AS run, round(avg(mean), 5) AS mean_mean, round(avg(std), 5) AS mean_std FROM m")
def map_report(spark, d):
    """E29"""
    m = cl.temporal_moments(brand_month(spark, d), ["roi"], "x").withColumn("run", F.lit(1))
    return r(cl.map_report(m, ["run"], ["mean", "std"]), ["run"], ["mean_mean", "mean_std"])


_SRC = f"""WITH b AS (SELECT roi, t, x AS orig, (t % 12) - 5.5 AS c, (t % 7) - 3.0 AS s, (t % 5) - 2.0 AS n FROM {_BM}),
f AS (SELECT roi, regr_slope(orig, t) AS k, regr_intercept(orig, t) AS k0 FROM b GROUP BY 1), h AS (SELECT b.*, orig - k0 - k * t AS high_pass FROM b JOIN f USING (roi)),
m AS (SELECT roi, sum(c * high_pass) / sum(c * c) AS bc FROM h GROUP BY 1), w AS (SELECT h.*, high_pass - bc * c AS post_motion FROM h JOIN m USING (roi)),
q AS (SELECT roi, sum(s * post_motion) AS sp, sum(n * post_motion) AS np, sum(s * s) AS ss, sum(n * n) AS nn, sum(s * n) AS sn FROM w GROUP BY 1),
u AS (SELECT w.*, post_motion - bn * n AS cleaned, post_motion - bs * s AS noise, post_motion - bs * s - bn * n AS unstructured FROM w JOIN (SELECT roi, (sp * nn - np * sn) / (ss * nn - sn * sn) AS bs, (np * ss - sp * sn) / (ss * nn - sn * sn) AS bn FROM q) USING (roi)),
g AS (SELECT t, {', '.join(f'avg({x}) AS g_{x}' for x in cl.SERIES)} FROM u GROUP BY 1),
v AS (SELECT roi, avg(orig) AS mean, var_samp(orig) AS orig_var, var_samp(orig - high_pass) AS high_pass_var, var_samp(high_pass - post_motion) AS motion_var, var_samp(noise - unstructured) AS structured_var, var_samp(cleaned - unstructured) AS bold_var, var_samp(unstructured) AS unstructured_var,
{', '.join(f'regr_slope({x}, g_{x}) AS {x}_mean_signal_beta, regr_r2({x}, g_{x}) AS {x}_mean_signal_r2, power(regr_slope({x}, g_{x}), 2) * var_samp(g_{x}) AS {x}_mean_signal_var' for x in cl.SERIES)} FROM u JOIN g USING (t) GROUP BY 1),
o AS (SELECT *, sqrt(orig_var) AS std, sqrt(unstructured_var) / mean AS cov, mean / sqrt(unstructured_var) AS tsnr, sqrt(bold_var / unstructured_var) AS cnr, orig_var - high_pass_var - motion_var - structured_var - bold_var - unstructured_var AS shared_var,
{', '.join(f'{x}_var / orig_var AS {x}_share' for x in ('high_pass', 'motion', 'structured', 'bold', 'unstructured'))}, {', '.join(f'{x}_mean_signal_var / orig_var AS {x}_mean_signal_share' for x in cl.SERIES)}, cleaned_mean_signal_var / bold_var AS cleaned_mean_signal_vs_bold FROM v)
"""


def _runs(spark, d):
    """Brand series with their line taken out as high-pass filter, a yearly course as motion, and a signal and a noise component."""
    b = brand_month(spark, d).withColumns({"one": F.lit(1.0), "month": F.col("t").cast("double"), "c": F.col("t") % 12 - 5.5, "s": F.col("t") % 7 - 3.0, "n": F.col("t") % 5 - 2.0})
    return io.checkpointed(md.residuals(io.checkpointed(b), ["roi"], ["one", "month"], "x", "high_pass").withColumn("run", F.lit(1)))


def _sources(spark, d):
    return cl.variance_sources(_runs(spark, d), ["run"], "roi", "t", "x", "high_pass", ["c"], ["s"], ["n"], io.checkpointed)


@query("variance_sources", f"{_SRC} SELECT roi, {', '.join(f'round({x}, 5) + 0.0 AS {x}' for x in cl.SOURCE_STATISTICS)} FROM o")
def variance_sources(spark, d):
    """Five sources and what they share"""
    return r(_sources(spark, d), ["roi"], cl.SOURCE_STATISTICS).select("roi", *((F.col(c) + 0.0).alias(c) for c in cl.SOURCE_STATISTICS))


def _two(y, a, b, of):
    """SQL of both coefficients of y on a and b without an intercept, by sums over ``of``."""
    s = lambda p, q: f"sum({p} * {q})"
    det = f"({s(a, a)} * {s(b, b)} - {s(a, b)} * {s(a, b)})"
    return [f"({s(a, y)} * {s(b, b)} - {s(b, y)} * {s(a, b)}) / {det} AS b_{of}1", f"({s(b, y)} * {s(a, a)} - {s(a, y)} * {s(a, b)}) / {det} AS b_{of}2"]


@query("tissue_variances", f"""{_SRC},
tt AS (SELECT DISTINCT t, c, s, n, unnest(['wm', 'csf']) AS tissue FROM h), tv AS (SELECT *, CASE WHEN tissue = 'wm' THEN t % 3 - 1.0 ELSE t * t % 11 - 5.0 END AS v FROM tt),
tm AS (SELECT tissue, sum(c * v) / sum(c * c) AS bc FROM tv GROUP BY 1), tp AS (SELECT tv.*, v - bc * c AS pm FROM tv JOIN tm USING (tissue)),
tb AS (SELECT tissue, {', '.join(_two('pm', 's', 'n', 'x'))} FROM tp GROUP BY 1), tc AS (SELECT tissue, t, pm - b_x2 * n AS clean FROM tp JOIN tb USING (tissue)),
td AS (SELECT t, max(x) FILTER (WHERE tissue = 'wm') AS wm, max(x) FILTER (WHERE tissue = 'csf') AS csf FROM (SELECT *, clean - avg(clean) OVER (PARTITION BY tissue) AS x FROM tc) GROUP BY 1),
a AS (SELECT roi, t, cleaned, unstructured, wm, csf FROM u JOIN td USING (t)),
ab AS (SELECT roi, sum(wm * cleaned) / sum(wm * wm) AS bw, sum(csf * cleaned) / sum(csf * csf) AS bf, {', '.join(_two('cleaned', 'wm', 'csf', 'y'))} FROM a GROUP BY 1),
ar AS (SELECT a.*, cleaned - bw * wm AS x_wm, cleaned - bf * csf AS x_csf, cleaned - b_y1 * wm - b_y2 * csf AS x_wm_csf FROM a JOIN ab USING (roi)),
ag AS (SELECT t, {', '.join(f'avg(x_{k}) AS g_{k}' for k in cl.TISSUES)} FROM ar GROUP BY 1),
z AS (SELECT roi, {', '.join(f'var_samp(cleaned - x_{k}) AS {k}_var, var_samp(x_{k} - unstructured) AS {k}_bold_var, regr_slope(x_{k}, g_{k}) AS {k}_mean_signal_beta, regr_r2(x_{k}, g_{k}) AS {k}_mean_signal_r2, power(regr_slope(x_{k}, g_{k}), 2) * var_samp(g_{k}) AS {k}_mean_signal_var' for k in cl.TISSUES)} FROM ar JOIN ag USING (t) GROUP BY 1)
SELECT roi, {', '.join(f'round({x}, 5) + 0.0 AS {x}' for x in cl.TISSUE_STATISTICS)} FROM z""")
def tissue_variances(spark, d):
    """White-matter and CSF variants of the variance report"""
    b = _runs(spark, d)
    series = cl.source_series(b, ["run"], "roi", "t", "x", "high_pass", ["c"], ["s"], ["n"], io.checkpointed)
    courses = b.select("run", "t", "c", "s", "n", (F.col("t") % 3 - 1.0).alias("w"), (F.col("t") * F.col("t") % 11 - 5.0).alias("f")).distinct()
    cleaned = io.checkpointed(cl.tissue_courses(courses, ["run"], "t", ["c"], ["s"], ["n"], "w", "f"))
    v = cl.tissue_variances(series, cleaned, ["run"], "roi", "t", io.checkpointed)
    return v.select("roi", *((F.round(c, 5) + 0.0).alias(c) for c in cl.TISSUE_STATISTICS))


@query("source_report", f"{_SRC} SELECT 1 AS run, {', '.join(f'round(avg({x}), 5) + 0.0 AS mean_{x}' for x in cl.SOURCE_STATISTICS)} FROM o")
def source_report(spark, d):
    """One row a run, the mean of every statistic"""
    m = cl.map_report(_sources(spark, d), ["run"], cl.SOURCE_STATISTICS)
    return m.select("run", *((F.round(f"mean_{c}", 5) + 0.0).alias(f"mean_{c}") for c in cl.SOURCE_STATISTICS))


def _maps(spark, d):
    """Two fixed maps over array positions, as columns beside the locations of the vectors."""
    f = long_vectors(spark, d).select("f").distinct()
    return f.select("f", F.when(F.col("f") < 32, 1.0).otherwise(0.0).alias("m1"), (F.col("f") / 64.0).alias("m2"))


_MX = f"(SELECT v.*, CASE WHEN f < 32 THEN 1.0 ELSE 0.0 END AS m1, f / 64.0 AS m2 FROM {LONG} v)"
_FIT = f"(SELECT subid, any_value(label) AS label, (covar_pop(m1, x) * var_pop(m2) - covar_pop(m2, x) * covar_pop(m1, m2)) / (var_pop(m1) * var_pop(m2) - power(covar_pop(m1, m2), 2)) AS t1, (covar_pop(m2, x) * var_pop(m1) - covar_pop(m1, x) * covar_pop(m1, m2)) / (var_pop(m1) * var_pop(m2) - power(covar_pop(m1, m2), 2)) AS t2 FROM {_MX} GROUP BY subid)"
_TC = f"(SELECT subid, label, " + ", ".join(f"t{i} - avg(t{i}) OVER (PARTITION BY label) AS t{i}, stddev_samp(t{i}) OVER (PARTITION BY label) AS s{i}" for i in (1, 2)) + f" FROM {_FIT})"


@query("dual_regression_courses", f"SELECT label, subid AS t, round(t1, 5) + 0.0 AS m1, round(t2, 5) + 0.0 AS m2 FROM {_TC}")
def dual_regression_courses(spark, d):
    """L11, first step: a subject is a label, a time point a vector"""
    x = long_vectors(spark, d).withColumnRenamed("subid", "t")
    return r(cl.dual_regression(x, _maps(spark, d), ["label"], "f", "t", "x", ["m1", "m2"])[0], ["label", "t"], ["m1", "m2"])


@query("dual_regression", f"""WITH j AS (SELECT v.label, v.f, v.x, t1, t2, s1, s2 FROM {LONG} v JOIN {_TC} c ON c.subid = v.subid), s AS (SELECT label, f, any_value(s1) AS s1, any_value(s2) AS s2, covar_samp(t1, x) AS ax, covar_samp(t2, x) AS bx, covar_samp(t1, t2) AS ab, var_samp(t1) AS aa, var_samp(t2) AS bb FROM j GROUP BY 1, 2)
SELECT label, CAST(f AS INT) AS f, round(s1 * (ax * bb - bx * ab) / (aa * bb - ab * ab), 4) + 0.0 AS m1, round(s2 * (bx * aa - ax * ab) / (aa * bb - ab * ab), 4) + 0.0 AS m2 FROM s""")
def dual_regression(spark, d):
    """L11"""
    x = long_vectors(spark, d).withColumnRenamed("subid", "t")
    return r(cl.dual_regression(x, _maps(spark, d), ["label"], "f", "t", "x", ["m1", "m2"])[1], ["label", "f"], ["m1", "m2"], 4)


@query("weighted_dual_regression")
def weighted_dual_regression(spark, d):
    """Alignment quality from three low-dimensional maps, smoothed over neighbouring positions"""
    x = long_vectors(spark, d).withColumnRenamed("subid", "t")
    f = F.col("f")
    maps = _maps(spark, d)
    low = maps.select("f", F.when(f < 16, 1.0).otherwise(0.0).alias("a"), (f / 64.0).alias("b"), ((f % 8) / 8.0).alias("c"))
    near = maps.select("f", F.explode(F.sequence(f - 2, f + 2)).alias("other")).withColumn("w", F.exp(-F.pow(f - F.col("other"), F.lit(2)) / 2))
    q = cl.alignment_quality(x, [(low, ["a", "b", "c"])], F.broadcast(near), ["label"], "f", "t", "x", checkpoint=io.checkpointed)
    return r(cl.weighted_dual_regression(x, maps, q, ["label"], "f", "t", "x", ["m1", "m2"], checkpoint=io.checkpointed)[1], ["label", "f"], ["m1", "m2"], 4)


@query("unmix", """WITH e AS (SELECT vec_id, label, vec_id % 2 AS run, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT vec_id, a / stddev_samp(a) OVER (PARTITION BY label, run) * stddev_samp(a) OVER l AS a, b / stddev_samp(b) OVER (PARTITION BY label, run) * stddev_samp(b) OVER l AS b, stddev_samp(a) OVER l AS sa, stddev_samp(b) OVER l AS sb FROM e WINDOW l AS (PARTITION BY label))
SELECT vec_id, round((0.6 * a - 0.2 * b) * abs(2 / sa - 1 / sb) / sqrt(2), 5) + 0.0 AS component1, round((0.4 * b - 0.2 * a) * abs(1 / sa - 3 / sb) / sqrt(2), 5) + 0.0 AS component2 FROM s""")
def unmix(spark, d):
    """A full mixing matrix, two runs a subject"""
    x = read(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 2).alias("run"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("ab")))
    return r(cl.unmix(x, [[2.0, 1.0], [1.0, 3.0]], ["a", "b"], ["label"], "run"), ["vec_id"], ["component1", "component2"])


# --- maps and means ---------------------------------------------------------------------------------------------------
@query("grand_mean_scale", "WITH m AS (SELECT l_linenumber, avg(l_quantity) FILTER (WHERE l_returnflag = 'N') AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, l_partkey, l_linenumber, round(greatest(0, l_quantity * 10000 / m), 3) AS scaled FROM lineitem JOIN m USING (l_linenumber)")
def grand_mean_scale(spark, d):
    """B28"""
    return r(cl.grand_mean_scale(read(spark, d, "lineitem"), ["l_linenumber"], "l_quantity", F.col("l_returnflag") == "N"), ["l_orderkey", "l_partkey", "l_linenumber"], ["scaled"], 3)


@query("series_rescale", "WITH m AS (SELECT l_linenumber, avg(l_quantity) AS m FROM lineitem GROUP BY 1) SELECT l_orderkey, l_partkey, l_linenumber, round(l_quantity * (SELECT arg_min(m, l_linenumber) FROM m) / m, 5) AS scaled FROM lineitem JOIN m USING (l_linenumber)")
def series_rescale(spark, d):
    """E30"""
    return r(cl.rescale_to_first(read(spark, d, "lineitem"), "l_linenumber", "l_quantity"), ["l_orderkey", "l_partkey", "l_linenumber"], ["scaled"])


@query("group_mean_excl_outliers", f"WITH v AS (SELECT label, f, x FROM {LONG}), m AS (SELECT label, f, avg(x) AS mean, stddev_samp(x) AS s FROM v GROUP BY 1, 2) SELECT label, CAST(f AS INT) AS f, round(any_value(mean), 6) + 0.0 AS mean, round(avg(x), 6) + 0.0 AS mean_kept, round(stddev_samp(x), 6) AS std_kept, count(x) AS n_kept FROM v JOIN m USING (label, f) WHERE abs(x - mean) <= 3 * s GROUP BY 1, 2")
def group_mean_excl_outliers(spark, d):
    """E24 E25"""
    return r(cl.mean_without_outliers(long_vectors(spark, d), ["label", "f"], "x"), ["label", "f", "n_kept"], ["mean", "mean_kept", "std_kept"], 6)


@query("full_vs_any_mean", f"WITH b AS (SELECT *, count(*) OVER (PARTITION BY roi) >= 80 AS is_full FROM {_BM}) SELECT t, round(avg(x), 6) AS mean_any, round(avg(x) FILTER (WHERE is_full), 6) AS mean_full, round(avg(abs(x)), 6) AS mean_abs FROM b GROUP BY 1")
def full_vs_any_mean(spark, d):
    """E26"""
    b = brand_month(spark, d).withColumn("is_full", F.count("*").over(Window.partitionBy("roi")) >= 80)
    return r(cl.group_sums(b, ["t"], "x", "is_full"), ["t"], ["mean_any", "mean_full", "mean_abs"], 6)


@query("percent_variance", f"WITH v AS (SELECT roi, var_samp(x) AS v FROM {_BM} GROUP BY 1) SELECT roi, round(100 * v / sum(v) OVER (), 5) AS percent FROM v")
def percent_variance(spark, d):
    """E27"""
    return r(cl.percent_variance(brand_month(spark, d), "roi", "x"), ["roi"], ["percent"])


@query("parcel_mean", "SELECT p_type AS parcel, l_linenumber AS t, round(avg(l_quantity), 6) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def parcel_mean(spark, d):
    """E23"""
    labels = read(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("parcel"))
    return r(cl.parcel_mean(read(spark, d, "lineitem").withColumnRenamed("l_linenumber", "t"), labels, "l_partkey", ["parcel", "t"], "l_quantity"), ["parcel", "t"], ["mean"], 6)


@query("mean_vn", "SELECT subid, round(avg(s), 6) AS vn FROM (SELECT user_id AS subid, event_type, stddev_samp(value) AS s FROM events GROUP BY 1, 2) GROUP BY 1")
def mean_vn(spark, d):
    """E31 (trap T9)"""
    return r(cl.mean_vn(read(spark, d, "events").withColumnRenamed("user_id", "subid"), ["subid"], "event_type", "value"), ["subid"], ["vn"], 6)


@query("shell_select", "SELECT p_partkey, p_size FROM part WHERE abs(p_size - 10) < 2 OR abs(p_size - 30) < 2")
def shell_select(spark, d):
    """C14"""
    return cl.shell(read(spark, d, "part"), "p_size", [10, 30], 2).select("p_partkey", "p_size")


def _mad_sql(passes):
    ctes = [f"x AS (SELECT label, subid, f, x FROM {LONG})", "k0 AS (SELECT DISTINCT label, subid FROM x)"]
    for i in range(1, passes + 1):
        ctes += [
            f"a{i} AS (SELECT label, f, avg(x) AS a FROM x JOIN k{i - 1} USING (label, subid) GROUP BY 1, 2)",
            f"s{i} AS (SELECT label, subid, avg(power(x - a, 2)) AS score FROM x JOIN a{i} USING (label, f) GROUP BY 1, 2)",
            f"m{i} AS (SELECT *, quantile_cont(score, 0.5) OVER (PARTITION BY label) AS med FROM s{i})",
            f"k{i} AS (SELECT label, subid, score FROM (SELECT *, quantile_cont(abs(score - med), 0.5) OVER (PARTITION BY label) AS mad FROM m{i}) WHERE score < med + 2 * mad)",
        ]
    return f"WITH {', '.join(ctes)} SELECT label, subid, round(score, 6) AS score FROM k{passes}"


@query("mad_filter", _mad_sql(3))
def mad_filter(spark, d):
    """A series is a label, a volume a vector"""
    return r(cl.mad_filter(long_vectors(spark, d), ["label"], "subid", "f", "x", checkpoint=io.checkpointed), ["label", "subid"], ["score"], 6)


_ECHO = "(SELECT l_orderkey AS voxel, l_linenumber AS echo, l_linenumber * 12.0 AS te, any_value(y) AS y FROM (SELECT l_orderkey, l_linenumber, avg(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber) AS y FROM lineitem) GROUP BY 1, 2, 3)"


@query("echo_combine", f"""WITH e AS (SELECT *, coalesce(y > lag(y) OVER (PARTITION BY voxel ORDER BY echo), false) AS up FROM {_ECHO}),
u AS (SELECT *, count(*) FILTER (WHERE up) OVER (PARTITION BY voxel ORDER BY echo) = 0 AND y > 0 AS use FROM e),
f AS (SELECT voxel, regr_slope(ln(y), te) FILTER (WHERE use) AS b, count(*) FILTER (WHERE use) AS n_used FROM u GROUP BY 1),
t AS (SELECT voxel, n_used, CASE WHEN b < 0 THEN least(-1 / b, 2240.0) ELSE 2240.0 END AS t2 FROM f)
SELECT voxel, round(any_value(t2), 4) AS t2star, any_value(n_used) AS n_used, round(sum(te * exp(-te / t2) * y) / sum(te * exp(-te / t2)), 4) AS combined FROM u JOIN t USING (voxel) GROUP BY 1""")
def echo_combine(spark, d):
    """L16"""
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("voxel"), F.col("l_linenumber").alias("echo")).agg(F.avg("l_quantity").alias("y")).withColumn("te", F.col("echo") * 12.0)
    return r(cl.combine_echoes(li, "voxel", "echo", "te", "y"), ["voxel", "n_used"], ["t2star", "combined"], 4)


@query("echo_combine_weighted", f"""WITH e AS (SELECT *, coalesce(y > lag(y) OVER (PARTITION BY voxel ORDER BY echo), false) AS up FROM {_ECHO}),
u AS (SELECT *, count(*) FILTER (WHERE up) OVER (PARTITION BY voxel ORDER BY echo) = 0 AND y > 0 AS use FROM e),
s AS (SELECT voxel, count(*) AS n, sum(1 / y) AS sw, sum(te / y) AS sx, sum(ln(y) / y) AS sy, sum(te * te / y) AS sxx, sum(te * ln(y) / y) AS sxy FROM u WHERE use GROUP BY 1),
f AS (SELECT voxel, n, CASE WHEN n > 1 THEN (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) END AS b FROM s),
t AS (SELECT voxel, n, CASE WHEN b < 0 THEN least(-1 / b, 2240.0) ELSE 2240.0 END AS t2 FROM f)
SELECT voxel, round(any_value(t2), 3) AS t2star, any_value(n) AS n_used, round(sum(te * exp(-te / t2) * y) / sum(te * exp(-te / t2)), 4) AS combined FROM u JOIN t USING (voxel) GROUP BY 1""")
def echo_combine_weighted(spark, d):
    """L16, each echo weighted by 1 / y"""
    li = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("voxel"), F.col("l_linenumber").alias("echo")).agg(F.avg("l_quantity").alias("y")).withColumn("te", F.col("echo") * 12.0)
    out = cl.combine_echoes(li, "voxel", "echo", "te", "y", weighted=True)
    return out.select("voxel", "n_used", F.round("t2star", 3).alias("t2star"), F.round("combined", 4).alias("combined"))


def _directions(spark, d):
    x = vectors(spark, d).select("label", (F.col("subid") % 20).alias("volume"), F.slice("x", 1, 3).alias("v"))
    n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
    return x.withColumn("v", F.transform("v", lambda y: y / n)).withColumn("b", F.lit(1000.0))


@query("direction_tensors", """WITH v AS (SELECT label, vec_id % 20 AS volume, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings), u AS (SELECT label, volume, x, y, z, x * x + y * y + z * z AS n FROM v)
SELECT label, volume, round(avg(1000 * x * x / n), 4) AS d00, round(avg(1000 * x * y / n), 4) + 0.0 AS d01, round(avg(1000 * x * z / n), 4) + 0.0 AS d02, round(avg(1000 * y * y / n), 4) AS d11, round(avg(1000 * y * z / n), 4) + 0.0 AS d12, round(avg(1000 * z * z / n), 4) AS d22 FROM u GROUP BY 1, 2""")
def direction_tensors(spark, d):
    """L19, tensor sums"""
    return r(cl.direction_tensors(_directions(spark, d), ["label", "volume"], "b", "v"), ["label", "volume"], ["d00", "d01", "d02", "d11", "d12", "d22"], 4)


@query("average_directions")
def average_directions(spark, d):
    """L19"""
    return cl.average_directions(_directions(spark, d), ["label", "volume"], "b", "v")


@query("amplitude_spectrum", """WITH v AS (SELECT user_id, event_type, row_number() OVER w - 1 AS t, value - avg(value) OVER (PARTITION BY user_id, event_type) AS v FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
n AS (SELECT max(t) + 1 AS n FROM v), k AS (SELECT n, unnest(range((n + 1) // 2)) AS k FROM n),
a AS (SELECT user_id, event_type, k, sqrt(power(sum(v * cos(2 * pi() * k * t / n)), 2) + power(sum(v * sin(2 * pi() * k * t / n)), 2)) AS a FROM v, k GROUP BY 1, 2, 3)
SELECT event_type, CAST(k AS INT) AS freq, round(avg(a), 5) AS amplitude FROM a GROUP BY 1, 2""")
def amplitude_spectrum(spark, d):
    """Averaged over subjects"""
    s = cl.spectrum(motion.frame_index(read(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]), ["user_id", "event_type"], "t", "value")
    return s.groupBy("event_type", "freq").agg(F.round(F.avg("amplitude"), 5).alias("amplitude"))


@query("welch_spectrum", f"""WITH n AS (SELECT roi, x, row_number() OVER (PARTITION BY roi ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY roi) AS n FROM {_BM}),
z AS (SELECT *, CAST(greatest(floor(n / 4.5), 1) AS BIGINT) AS size FROM n), s AS (SELECT *, size - size // 2 AS step FROM z),
g AS (SELECT *, i - k * step AS j FROM (SELECT *, unnest(range(0, (n - size) // step + 1)) AS k FROM s) WHERE i >= k * step AND i < k * step + size),
w AS (SELECT roi, k, n, j, x * (0.54 - 0.46 * cos(2 * pi() * j / greatest(size - 1, 1))) AS v FROM g),
f AS (SELECT *, unnest(range(0, n // 2)) AS freq FROM w),
p AS (SELECT roi, freq, k, (power(sum(v * cos(2 * pi() * freq * j / n)), 2) + power(sum(v * sin(2 * pi() * freq * j / n)), 2)) * (CASE WHEN freq > 0 THEN 2 ELSE 1 END) AS p FROM f GROUP BY roi, freq, k),
m AS (SELECT roi, freq, avg(p) AS p, max(freq) OVER (PARTITION BY roi) AS top FROM p GROUP BY roi, freq)
SELECT roi, CAST(freq AS INT) AS freq, round(p / avg(p) FILTER (WHERE freq > top - 10) OVER (PARTITION BY roi), 6) AS amplitude FROM m""")
def welch_spectrum(spark, d):
    """L15"""
    return r(cl.welch_spectrum(brand_month(spark, d), ["roi"], "t", "x", io.checkpointed), ["roi", "freq"], ["amplitude"], 6)


_BIAS = "(SELECT run, l_orderkey, l_partkey, template, c * mt / mc AS corrected FROM c JOIN m USING (run))"
_BIAS_CTES = """c AS (SELECT *, x / (factor * 0.8 + 0.2) AS c FROM (SELECT l_linenumber AS run, l_orderkey, l_partkey, l_quantity AS x, 1 + (l_discount - 0.05) * 4 AS factor, 25.0 + l_partkey % 7 AS template FROM lineitem)),
m AS (SELECT run, quantile_cont(template, 0.5) FILTER (WHERE round(factor, 1) = 1.0) AS mt, quantile_cont(c, 0.5) FILTER (WHERE round(factor, 1) = 1.0) AS mc FROM c GROUP BY 1)"""


def _bias_corrected(spark, d):
    """Maps are lines of an order, locations parts; the template is known for each part."""
    li = read(spark, d, "lineitem").select(F.col("l_linenumber").alias("run"), "l_orderkey", "l_partkey", F.col("l_quantity").alias("x"), (1 + (F.col("l_discount") - 0.05) * 4).alias("factor"), (25.0 + F.col("l_partkey") % 7).alias("template"))
    return cl.bias_correct(li, ["run"], "x", "factor", F.lit(0.8), F.lit(0.2), "template")


@query("map_bias_correct", f"WITH {_BIAS_CTES} SELECT run, l_orderkey, l_partkey, round(corrected, 4) AS corrected FROM {_BIAS}")
def map_bias_correct(spark, d):
    """L20"""
    return r(_bias_corrected(spark, d), ["run", "l_orderkey", "l_partkey"], ["corrected"], 4)


@query("template_cost", f"WITH {_BIAS_CTES}, l AS (SELECT run, l_partkey, avg(corrected) AS x, any_value(template) AS t FROM {_BIAS} GROUP BY 1, 2) SELECT run, round(sum(abs(x - t) / t), 3) AS cost FROM l GROUP BY 1")
def template_cost(spark, d):
    """Of the corrected maps"""
    return r(cl.template_cost(_bias_corrected(spark, d), ["run"], ["l_partkey"], "corrected", "template"), ["run"], ["cost"], 3)


@query("safe_ratio", "SELECT l_linenumber, l_orderkey, l_partkey, CASE WHEN l_tax = 0 AND l_discount = 0 THEN 0.0 WHEN l_tax = 0 THEN NULL ELSE round(l_discount / l_tax, 6) END AS ratio FROM lineitem")
def safe_ratio(spark, d):
    """B25 (trap T21)"""
    return read(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_partkey", fn.r6(fn.safe_ratio(F.col("l_discount"), F.col("l_tax"))).alias("ratio"))


@query("log2_fold", "SELECT p_partkey, round(log2(p_retailprice / p_size), 6) + 0.0 AS fold FROM part")
def log2_fold(spark, d):
    """B27"""
    return read(spark, d, "part").select("p_partkey", fn.r6(fn.log2_fold(F.col("p_retailprice"), F.col("p_size"))).alias("fold"))


@query("fixed_effects", "SELECT l_suppkey, l_linenumber, round(sum(l_quantity / (l_discount + 0.01)) / sum(1 / (l_discount + 0.01)), 5) AS cope, round(1 / sum(1 / (l_discount + 0.01)), 8) AS var, count(*) AS n FROM lineitem GROUP BY 1, 2")
def fixed_effects(spark, d):
    """M10"""
    e = cl.fixed_effects(read(spark, d, "lineitem").withColumn("v", F.col("l_discount") + 0.01), ["l_suppkey", "l_linenumber"], "l_quantity", "v")
    return e.select("l_suppkey", "l_linenumber", F.round("cope", 5).alias("cope"), F.round("var", 8).alias("var"), "n")


# --- decomposition and similarity -----------------------------------------------------------------------------------
@query("gram_matrix", f"SELECT CAST(a.f AS INT) AS i, CAST(b.f AS INT) AS j, round(sum(a.x * b.x), 5) + 0.0 AS g FROM {LONG} a JOIN {LONG} b ON a.subid = b.subid AND a.f >= b.f GROUP BY 1, 2")
def gram_matrix(spark, d):
    """M1"""
    return r(cp.gram(vectors(spark, d), "x", 64), ["i", "j"], ["g"])


@query("gram_pca")
def gram_pca(spark, d):
    """M1 M8: as many directions are kept as there are positions, so the values are exact"""
    m = io.checkpointed(cp.merged_pca(vectors(spark, d), "x", 64, internal=64, rank=64, checkpoint=io.checkpointed))
    return r(cp.directions(m.where("comp < 5")), ["comp", "i"], ["value", "eigenvalue"]).crossJoin(F.broadcast(cp.effective_rank(m)))


@query("noise_std_tail")
def noise_std_tail(spark, d):
    """M9"""
    v = cp.directions(cp.merged_pca(vectors(spark, d), "x", 64, internal=64, rank=5, checkpoint=io.checkpointed))
    return r(cp.noise_deviation(vectors(spark, d), "x", v), ["i"], ["noise_std"], 6)


@query("merged_pca")
def merged_pca(spark, d):
    """M1: bounded internal rank"""
    return r(cp.merged_pca(vectors(spark, d), "x", 64, internal=20, rank=5, checkpoint=io.checkpointed), ["comp", "i"], ["value", "eigenvalue"])


@query("merged_pca_energy", f"SELECT CAST(f AS INT) AS i, round(sum(x * x), 5) + 0.0 AS energy FROM {LONG} GROUP BY 1")
def merged_pca_energy(spark, d):
    """M1: with as many directions as positions nothing is lost, so components hold each position's sum of squares"""
    v = cp.merged_pca(vectors(spark, d), "x", 64, internal=64, rank=64, checkpoint=io.checkpointed)
    return r(v.groupBy("i").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), ["i"], ["energy"])


@query("resumed_pca_energy", f"SELECT CAST(f AS INT) AS i, round(sum(x * x), 5) + 0.0 AS energy FROM {LONG} GROUP BY 1")
def resumed_pca_energy(spark, d):
    """M1: a run of two batches, and one that goes on from its committed state to the last; nothing is lost with as many directions as positions"""
    v, path = vectors(spark, d), io.scratch(spark, "pca")
    run = lambda most: cp.resumable_pca(v, "label", "x", 64, 64, 64, path, io.checkpointed, most=most)
    run(2)
    return r(run(None).groupBy("i").agg(F.sum(F.col("value") * F.col("value")).alias("energy")), ["i"], ["energy"])


_TPL = f"(SELECT label AS template, f, avg(x) AS x FROM {LONG} GROUP BY 1, 2)"


def templates(spark, d):
    return long_vectors(spark, d).groupBy(F.col("label").alias("template"), "f").agg(F.avg("x").alias("x"))


@query("eta_squared", f"SELECT subid, template, round(1 - (sum(power(a.x - b.x, 2)) / 2) / (sum(a.x * a.x + b.x * b.x) - power(sum(a.x + b.x), 2) / (2 * count(*))), 6) + 0.0 AS eta2 FROM {LONG} a JOIN {_TPL} b USING (f) GROUP BY 1, 2")
def eta_squared(spark, d):
    """M2 (trap T20)"""
    return r(cp.eta_squared(long_vectors(spark, d), F.broadcast(templates(spark, d)), "subid", "template", "f", "x"), ["subid", "template"], ["eta2"], 6)


def _estimates(spark, d):
    """Estimates to cluster: mean vectors by label and fifth of the vectors; a few dozen, whatever the table."""
    return long_vectors(spark, d).groupBy((F.col("label") * 5 + F.col("subid") % 5).alias("item"), F.col("label").alias("label"), "f").agg(F.avg("x").alias("x"))


def _sims(spark, d):
    e = _estimates(spark, d)
    return cp.cosine_pairs(e, "item", "f", "x"), e.select("item", "label").distinct()


_EST = f"(SELECT label * 5 + subid % 5 AS item, label, f, avg(x) AS x FROM {LONG} GROUP BY 1, 2, 3)"
_SIMS = f"(SELECT a.item AS a, b.item AS b, any_value(a.label) AS la, any_value(b.label) AS lb, abs(sum(a.x * b.x)) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS sim FROM {_EST} a JOIN {_EST} b ON a.f = b.f AND a.item <> b.item GROUP BY 1, 2)"


@query("cosine_pairs", f"SELECT a, b, round(sim, 6) + 0.0 AS sim FROM {_SIMS} WHERE a < b")
def cosine_pairs(spark, d):
    """M3"""
    return r(_sims(spark, d)[0], ["a", "b"], ["sim"], 6)


@query("cluster_stability", f"SELECT la AS cluster, " + ", ".join(f"round({g}(sim) FILTER (WHERE la {op} lb), 5) + 0.0 AS {n}_{m}" for n, op in (("within", "="), ("between", "<>")) for g, m in (("min", "min"), ("avg", "mean"), ("max", "max"), ("sum", "sum"))) + f", round(avg(sim) FILTER (WHERE la = lb) - avg(sim) FILTER (WHERE la <> lb), 5) + 0.0 AS iq FROM {_SIMS} GROUP BY 1")
def cluster_stability(spark, d):
    """M4 M5"""
    s = cp.cluster_statistics(*_sims(spark, d), "item", "label")
    return r(s, ["cluster"], [c for c in s.columns if c != "cluster"])


@query("r_index", f"WITH d AS (SELECT la, lb, avg(1 - sim) AS dist FROM {_SIMS} GROUP BY 1, 2), c AS (SELECT la, max(dist) FILTER (WHERE la = lb) AS i, min(dist) FILTER (WHERE la <> lb) AS o FROM d GROUP BY 1) SELECT round(avg(i / o), 6) AS r_index FROM c")
def r_index(spark, d):
    """M6"""
    return r(cp.r_index(*_sims(spark, d), "item", "label"), [], ["r_index"], 6)


@query("centrotype", f"SELECT cluster, a AS centrotype, round(s, 5) AS sum_sim FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(s, 9) DESC, a) AS k FROM (SELECT la AS cluster, a, sum(sim) AS s FROM {_SIMS} WHERE la = lb GROUP BY 1, 2)) WHERE k = 1")
def centrotype(spark, d):
    """M7"""
    return r(cp.centrotypes(*_sims(spark, d), "item", "label"), ["cluster", "centrotype"], ["sum_sim"])


@query("component_order_sign", f"SELECT roi, round(stddev_samp(x), 6) AS std, CASE WHEN max(x) >= abs(min(x)) THEN 1 ELSE -1 END AS sign, row_number() OVER (ORDER BY stddev_samp(x) DESC, roi) AS rank FROM (SELECT roi, t, x - avg(x) OVER (PARTITION BY roi) AS x FROM {_BM}) GROUP BY 1")
def component_order_sign(spark, d):
    """F18"""
    b = brand_month(spark, d).withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("roi")))
    return cp.order_and_sign(b, "roi", "x").withColumn("std", fn.r6(F.col("std")))


# --- component features and votes ------------------------------------------------------------------------------------
@query("mask_ratio_features", f"SELECT subid, round(sum(abs(x)) FILTER (WHERE f < 16) / sum(abs(x)) FILTER (WHERE f >= 16 AND f < 48), 6) AS edge_over_core, round(sum(abs(x)) FILTER (WHERE f >= 48) / sum(abs(x)) FILTER (WHERE f < 16), 6) AS csf_over_edge FROM {LONG} GROUP BY 1")
def mask_ratio_features(spark, d):
    """N1"""
    x = long_vectors(spark, d)
    f = F.col("f")
    masks = x.select("f").distinct().select("f", F.when(f < 16, "edge").when(f < 48, "core").otherwise("csf").alias("mask"))
    m = cp.mask_ratios(x, F.broadcast(masks), ["subid"], "f", "x", [("edge", "core"), ("csf", "edge")])
    return r(m, ["subid"], ["edge_over_core", "csf_over_edge"], 6)


@query("band_power_ratio", f"SELECT subid, round(sum(x * x) FILTER (WHERE f < 8) / sum(x * x) FILTER (WHERE f >= 8 AND f < 40), 6) AS band_ratio FROM {LONG} GROUP BY 1")
def band_power_ratio(spark, d):
    """N2"""
    return r(cp.band_power(long_vectors(spark, d).withColumn("p", F.col("x") * F.col("x")), ["subid"], "f", "p", (0, 8), (8, 40)), ["subid"], ["band_ratio"], 6)


@query("noisy_points", "WITH c AS (SELECT user_id, quantile_cont(abs(value - 50), 0.875) AS cut FROM events GROUP BY 1) SELECT user_id, round(coalesce(sum(abs(value)) FILTER (WHERE abs(value - 50) > cut), 0) / sum(abs(value)), 6) AS noisy_ratio FROM events JOIN c USING (user_id) GROUP BY 1")
def noisy_points(spark, d):
    """N3"""
    return r(cp.noisy_points_ratio(read(spark, d, "events").withColumn("n", F.abs(F.col("value") - 50)), ["user_id"], "ts", "value", "n", io.checkpointed), ["user_id"], ["noisy_ratio"], 6)


_OUT = f"""(SELECT *, abs(x - med) > 3 * 1.4826 * quantile_cont(abs(x - med), 0.5) OVER (PARTITION BY g) AND (lo <= (n + 9) // 20 OR n - lo + 1 <= (n + 9) // 20) AS outlier FROM
(SELECT g, id, x, quantile_cont(x, 0.5) OVER (PARTITION BY g) AS med, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY x, id) AS lo FROM (SELECT event_type AS g, event_id AS id, value AS x FROM events)))"""


@query("outlier_influence", f"WITH s AS (SELECT g, avg(x) AS mean, stddev_samp(x) AS std, avg(CASE WHEN outlier THEN 1.0 ELSE 0.0 END) AS o, stddev_samp(x) FILTER (WHERE NOT outlier) AS i, sum(abs(x)) AS m FROM {_OUT} GROUP BY 1) SELECT g, round(mean, 5) AS mean, round(std, 5) AS std, round(o, 5) AS outlier_share, round(1 - i / std, 5) AS influence, round(m / sum(m) OVER (), 5) AS mass_share FROM s")
def outlier_influence(spark, d):
    """N4 N5 N6"""
    e = read(spark, d, "events").select(F.col("event_type").alias("g"), F.col("event_id").alias("id"), F.col("value").alias("x"))
    return r(cp.outlier_influence(e, ["g"], "x", "id", io.checkpointed), ["g"], ["mean", "std", "outlier_share", "influence", "mass_share"])


_L = ", ".join(f"lag(c, {k}) OVER (PARTITION BY roi ORDER BY t) AS l{k}" for k in range(1, 9))
_R = ", ".join(f"coalesce(sum(c * l{k}), 0) / count(*)" for k in range(1, 9))
_BM_OUT = _OUT.replace("SELECT event_type AS g, event_id AS id, value AS x FROM events", f"SELECT roi AS g, t AS id, x FROM {_BM}")


@query("series_stats", f"""WITH RECURSIVE c AS (SELECT g AS roi, id AS t, x, outlier, x - avg(x) OVER (PARTITION BY g) AS c FROM {_BM_OUT}), l AS (SELECT *, {_L} FROM c),
r AS (SELECT roi, max(abs(x)) AS max_abs, avg(x) AS mean, stddev_samp(x) AS std, kurtosis_pop(x) + 3 AS kurtosis, 1 - stddev_samp(x) FILTER (WHERE NOT outlier) / stddev_samp(x) AS influence, [avg(c * c), {_R}] AS r FROM l GROUP BY 1),
v AS (SELECT roi, 0 AS k, r[1] AS e, CAST([] AS DOUBLE[]) AS a, r FROM r UNION ALL
  SELECT roi, k + 1, e * (1 - g * g), list_concat(list_transform(list_zip(a, list_reverse(a)), lambda z: z[1] - g * z[2]), [g]), r
  FROM (SELECT *, (r[k + 2] - CASE WHEN k = 0 THEN 0 ELSE list_dot_product(a, list_reverse(r[2:k + 1])) END) / e AS g FROM v WHERE k < 8)),
y AS (SELECT roi, regr_slope(e, k) AS yw_slope, regr_intercept(e, k) AS yw_offset, max(e) FILTER (WHERE k = 1) AS yw1, max(e) FILTER (WHERE k = 2) AS yw2, any_value(a) FILTER (WHERE k = 1) AS a1, any_value(a) FILTER (WHERE k = 2) AS a2 FROM v WHERE k > 0 GROUP BY 1)
SELECT roi, round(max_abs, 5) AS max_abs, round(mean, 5) AS mean, round(std, 5) AS std, round(kurtosis, 4) AS kurtosis, round(influence, 5) + 0.0 AS influence, round(-a1[1], 5) + 0.0 AS ar1, round(-a2[1], 5) + 0.0 AS ar2_1, round(-a2[2], 5) + 0.0 AS ar2_2,
  round(yw1, 4) AS yw1, round(yw2, 4) AS yw2, round(yw_slope, 4) + 0.0 AS yw_slope, round(yw_offset, 4) AS yw_offset FROM r JOIN y USING (roi)""")
def series_stats(spark, d):
    """N7"""
    s = cp.series_statistics(brand_month(spark, d), ["roi"], "t", "x", io.checkpointed)
    e = {f"yw{k + 1}": F.col("yw_error")[k] for k in (0, 1)} | {f"ar2_{k + 1}": F.col("ar2")[k] for k in (0, 1)}
    s = s.withColumns(e)
    return s.select("roi", *(F.round(c, 4).alias(c) for c in ("kurtosis", "yw1", "yw2", "yw_slope", "yw_offset")), *(F.round(c, 5).alias(c) for c in ("max_abs", "mean", "std", "influence", "ar1", "ar2_1", "ar2_2")))


_CENTRED = f"(SELECT roi, t, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, sqrt(var_pop(x) OVER w * var_pop(y) OVER w) * count(*) OVER w AS d FROM (SELECT roi, t, x, x * x / 50 AS y FROM {_BM}) WINDOW w AS (PARTITION BY roi))"
_XC = f"(SELECT a.roi, a.t - b.t AS lag, sum(a.x * b.y) / any_value(a.d) AS xcorr FROM {_CENTRED} a JOIN {_CENTRED} b ON a.roi = b.roi AND a.t - b.t BETWEEN -5 AND 5 GROUP BY 1, 2)"


def _xc(spark, d, lags):
    return cp.lag_correlations(brand_month(spark, d).withColumn("y", F.col("x") * F.col("x") / 50), ["roi"], "t", "x", "y", lags)


@query("xcorr_lags", f"SELECT roi, CAST(lag AS INT) AS lag, round(xcorr, 5) + 0.0 AS xcorr FROM {_XC}")
def xcorr_lags(spark, d):
    """F15"""
    return r(_xc(spark, d, 5), ["roi", "lag"], ["xcorr"])


@query("lag_symmetry", f"""WITH x AS (SELECT substr(roi, 7, 1) AS comp, * FROM {_XC.replace("BETWEEN -5 AND 5", "BETWEEN -400 AND 400")}), n AS (SELECT comp, count(DISTINCT roi) AS parcels FROM x GROUP BY 1),
m AS (SELECT a.comp, a.lag, a.xcorr AS p, coalesce(b.xcorr, 0) AS m FROM x a LEFT JOIN x b ON a.roi = b.roi AND b.lag = -a.lag),
s AS (SELECT comp, w, sum(power(p - m, 2)) AS d, sum(p * p + m * m) AS q, sum(p + m) AS l FROM m, (SELECT unnest([5, 50, 100, 200, 400]) AS w) WHERE abs(lag) <= w GROUP BY 1, 2),
e AS (SELECT comp, w, abs(2 * (1 - d / 2 / (q - l * l / (2 * (2 * w + 1) * parcels))) - 1) AS symmetry FROM s JOIN n USING (comp)),
f AS (SELECT comp, regr_slope(symmetry, w) AS slope, regr_intercept(symmetry, w) AS intercept FROM e GROUP BY 1)
SELECT comp, CAST(w AS INT) AS "window", round(symmetry, 5) + 0.0 AS symmetry, round(slope, 7) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept FROM e JOIN f USING (comp)""")
def lag_symmetry(spark, d):
    """A component is the brands of a maker, its parcels are the brands"""
    x = _xc(spark, d, 400).withColumn("comp", F.substring("roi", 7, 1))
    out = cp.lag_symmetry(x, ["comp"], "roi")
    return out.select("comp", "window", F.round("symmetry", 5).alias("symmetry"), F.round("slope", 7).alias("slope"), F.round("intercept", 5).alias("intercept"))


@query("complexity", f"SELECT roi, round(sqrt(sum(power(d, 2))), 5) AS complexity FROM (SELECT roi, x - lag(x) OVER (PARTITION BY roi ORDER BY t) AS d FROM {_BM}) GROUP BY 1")
def complexity(spark, d):
    """F16"""
    return r(cp.complexity(brand_month(spark, d), ["roi"], "t", "x"), ["roi"], ["complexity"])


@query("peak_stats")
def peak_stats(spark, d):
    """F17"""
    b = brand_month(spark, d).withColumn("x", F.col("x") - 25.5)
    return r(cp.peaks(b, ["roi"], "t", "x", 10.0, 10), ["roi", "height", "n_peaks"], ["mean_height", "sum_area", "mean_area"], 6)


@query("gs_covariance", f"WITH b AS (SELECT *, avg(x) OVER (PARTITION BY t) AS g FROM {_BM}) SELECT roi, round(abs(covar_samp(x, g)), 5) AS gs_cov, round(var_samp(x), 5) AS var FROM b GROUP BY 1")
def gs_covariance(spark, d):
    """N8"""
    b = brand_month(spark, d)
    return r(cp.signal_covariance(b.join(motion.mean_signal(b, ["t"], "x", "g"), "t"), ["roi"], "x", "g"), ["roi"], ["gs_cov", "var"])


@query("polarity_index", f"SELECT subid, round(2.0 * greatest(count(*) FILTER (WHERE x > 0), count(*) FILTER (WHERE x < 0)) / nullif(count(*) FILTER (WHERE x <> 0), 0) - 1, 6) + 0.0 AS polarity FROM {LONG} GROUP BY 1")
def polarity_index(spark, d):
    """N9"""
    return r(cp.polarity(long_vectors(spark, d), ["subid"], "x"), ["subid"], ["polarity"], 6)


@query("high_dvars_share", f"WITH b AS (SELECT *, avg(x) OVER (PARTITION BY t) - 25.5 AS v FROM {_BM}) SELECT roi, round(coalesce(var_samp(x) FILTER (WHERE abs(v) > 0.3), 0) / var_samp(x), 5) AS share FROM b GROUP BY 1")
def high_dvars_share(spark, d):
    """N10"""
    b = brand_month(spark, d)
    g = motion.mean_signal(b, ["t"], "x", "g").withColumn("v", F.col("g") - 25.5)
    return r(cp.high_dvars_share(b.join(g, "t"), ["roi"], "x", "v", 0.3), ["roi"], ["share"])


@query("spectrum_scale", f"SELECT label, CAST(f AS INT) AS f, round(x / max(x) OVER (PARTITION BY label), 5) + 0.0 AS by_max, round(coalesce((x - avg(x) OVER (PARTITION BY f)) / nullif(stddev_samp(x) OVER (PARTITION BY f), 0), 0), 5) + 0.0 AS z FROM (SELECT label, f, avg(x * x) AS x FROM {LONG} GROUP BY 1, 2)")
def spectrum_scale(spark, d):
    """N11"""
    s = long_vectors(spark, d).groupBy("label", "f").agg(F.avg(F.col("x") * F.col("x")).alias("x"))
    return r(cp.scaled_spectrum(s, "label", "f", "x"), ["label", "f"], ["by_max", "z"])


@query("outlier_fill_distance")
def outlier_fill_distance(spark, d):
    """N15"""
    e = motion.frame_index(read(spark, d, "events"), ["event_type"], ["ts", "event_id"])
    return r(cp.outlier_fill_distance(e, ["event_type"], "t", "value", io.checkpointed), ["event_type"], ["distance"], 3)


_PROB = "(SELECT doc_id, m, CAST(('0x' || substr(md5(concat_ws('|', 'vote', m, doc_id)), 1, 4))::BIGINT AS DOUBLE) / 65536 AS prob, CAST(quality AS DOUBLE) AS baseline FROM labels, (SELECT unnest(range(5)) AS m))"


def model_votes(spark, d):
    """(doc_id, m, prob, baseline): derived probabilities of five models beside the label."""
    x = read(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("baseline"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("m"))
    return x.withColumn("prob", F.conv(F.substring(fn.seeded("vote", F.col("m"), F.col("doc_id")), 1, 4), 16, 10).cast("double") / 65536)


@query("vote_reclassify", f"SELECT doc_id, count(*) FILTER (WHERE (prob >= 0.5) <> (baseline >= 0.5)) AS n_votes, any_value(baseline >= 0.5) AS was_signal, count(*) FILTER (WHERE (prob >= 0.5) <> (baseline >= 0.5)) >= 3 AS reclassify FROM {_PROB} GROUP BY 1")
def vote_reclassify(spark, d):
    """N13"""
    return cp.votes(model_votes(spark, d), ["doc_id"], "m", "prob", "baseline", 0.5, 3)


@query("reclass_sets", f"SELECT doc_id, (was AND NOT flip) OR (NOT was AND flip) AS is_signal FROM (SELECT doc_id, any_value(baseline >= 0.5) AS was, count(*) FILTER (WHERE (prob >= 0.5) <> (baseline >= 0.5)) >= 3 AS flip FROM {_PROB} GROUP BY 1)")
def reclass_sets(spark, d):
    """H5 H6"""
    v = vote_reclassify(spark, d)
    orig = v.select("doc_id", F.when(F.col("was_signal"), "signal").otherwise("noise").alias("list"))
    new = v.where("reclassify").select("doc_id", F.when(F.col("was_signal"), "as_noise").otherwise("as_signal").alias("list"))
    return cp.reclassified(orig.union(new), ["doc_id"])


@query("ensemble_score")
def ensemble_score(spark, d):
    """N14"""
    x = vectors(spark, d).join(read(spark, d, "labels").select(F.col("doc_id").alias("subid"), "quality"), "subid")
    return r(cp.balanced_ensemble(x.select("subid", "x", "quality"), "subid", "x", "quality", "bag"), ["subid"], ["probability"], 6)


# --- scans and sinks: a slice written as text, read back and compared with its source -------------------------------
@query("scan_sniffed_motion", f"SELECT subid, run_key, CAST(row_number() OVER (PARTITION BY subid, run_key ORDER BY ts, event_id) - 1 AS INT) AS t, round(fd, 6) AS fd FROM {FRAMES}")
def scan_sniffed_motion(spark, d):
    """A1 A2: all runs, dealt to two dozen files of one of three delimiters, each with its header"""
    f = motion.frame_index(frames(spark, d), ["subid", "run_key"], ["ts", "event_id"])
    shard = F.pmod(F.col("subid"), F.lit(24)).cast("int")
    rows = f.select(shard.alias("shard"), F.lit(1).alias("o"), F.concat_ws("\x01", F.col("subid").cast("string"), "run_key", F.col("t").cast("string"), F.format_string("%.8f", F.col("fd"))).alias("v"))
    heads = rows.select("shard").distinct().select("shard", F.lit(0).alias("o"), F.lit("subject\x01run\x01t\x01framewise_displacement").alias("v"))
    path = io.scratch(spark, "motion")
    lines = rows.unionByName(heads).withColumn("value", F.expr("replace(v, '\x01', case shard % 3 when 0 then '\t' when 1 then ',' else ' ' end)"))
    lines.repartition("shard").sortWithinPartitions("shard", "o").select("value", "shard").write.partitionBy("shard").text(path)
    m = io.scan_motion(spark, path, keys={"shard": "shard=([0-9]+)"}, glob="*.txt", also=("subject", "run", "t"))
    return m.select(F.col("subject").cast("bigint").alias("subid"), F.col("run").alias("run_key"), F.col("t").cast("int").alias("t"), fn.r6(F.col("fd")).alias("fd"))


@query("discover_files", f"SELECT DISTINCT run_key FROM {FRAMES}")
def discover_files(spark, d):
    """A2: files found below a root, their keys recovered from the paths"""
    path = io.scratch(spark, "found")
    frames(spark, d).select("run_key", F.format_string("%.8f", F.col("fd")).alias("value")).write.partitionBy("run_key").text(path)
    return io.discover(spark, path, "*.txt", {"run_key": "run_key=([^/]+)"}).where("length > 0").select("run_key").distinct()


@query("scan_params_12col", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS p1, l_quantity + 11 AS p12 FROM lineitem")
def scan_params_12col(spark, d):
    """A3"""
    li = read(spark, d, "lineitem")
    cells = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), *(F.col("l_quantity") + i for i in range(12))]
    path = io.scratch(spark, "params")
    li.select(F.concat_ws("  ", *(c.cast("string") for c in cells)).alias("value")).write.text(path)
    m = io.scan_matrix(spark, path, ["a", "b", "c", *(f"p{i + 1}" for i in range(12))])
    return m.select(F.col("a").cast("bigint").alias("l_orderkey"), F.col("b").cast("int").alias("l_linenumber"), F.col("c").cast("bigint").alias("l_partkey"), "p1", "p12")


for _name, _sep in (("scan_csv_event", ","), ("scan_tsv", "\t")):

    @query(_name, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
    def _scan_csv(spark, d, sep=_sep):
        """A4 A5 C1"""
        path = io.scratch(spark, "orders")
        read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.csv(path, header=True, sep=sep)
        return io.scan_csv(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string", ["o_custkey", "o_orderkey", "o_totalprice"], ("o_orderpriority", "1-URGENT"), sep)


@query("scan_bom_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def scan_bom_csv(spark, d):
    """A6"""
    path = io.scratch(spark, "bom")
    read(spark, d, "customer").select(F.col("c_custkey").alias("﻿c_custkey"), "c_name").write.csv(path, header=True)
    return io.scan_bom_csv(spark, path).select("c_custkey", "c_name")


@query("scan_auto_header", "SELECT c_custkey AS subid, c_acctbal AS age FROM customer")
def scan_auto_header(spark, d):
    """A7"""
    path = io.scratch(spark, "headers")
    read(spark, d, "customer").select("c_name", F.col("c_custkey").alias("src_subject_key"), F.col("c_acctbal").alias("interview_age")).write.csv(path, header=True)
    found = io.scan_auto_header(spark, path, {"subid": ("participant", "subject"), "age": ("age",)})
    return found.select(F.col("subid").cast("bigint").alias("subid"), F.col("age").cast("double").alias("age"))


_IDS = "(SELECT user_id, row_number() OVER (ORDER BY md5(concat('list|', user_id)), user_id) - 1 AS pos FROM (SELECT DISTINCT user_id FROM events))"
for _name in ("scan_id_list", "sink_id_list"):

    @query(_name, f"SELECT CAST(pos AS BIGINT) AS pos, CAST(user_id AS VARCHAR) AS subid FROM {_IDS}")
    def _id_list(spark, d):
        """A8 A15"""
        from synapta.plans.screening import subject_list

        path = io.scratch(spark, "ids")
        io.write_id_list(subject_list(spark, d), path, "c_custkey", "pos")
        return io.scan_id_list(spark, path).select(F.col("pos").cast("bigint").alias("pos"), "subid")


@query("scan_json_sidecar", "SELECT CASE n_regionkey % 2 WHEN 0 THEN 'j' ELSE 'j-' END AS direction, CASE n_regionkey % 2 WHEN 0 THEN 'PA' ELSE 'AP' END AS suffix, count(*) AS n FROM nation GROUP BY ALL")
def scan_json_sidecar(spark, d):
    """A13 B21"""
    path = io.scratch(spark, "sidecars")
    n = read(spark, d, "nation").select("n_nationkey", F.when(F.col("n_regionkey") % 2 == 0, "j").otherwise("j-").alias("PhaseEncodingDirection"))
    n.repartition("n_nationkey").write.partitionBy("n_nationkey").json(path)
    return io.scan_sidecars(spark, path + "/*/*.json", {"j": "PA", "j-": "AP"}).groupBy("direction", "suffix").agg(F.count("*").alias("n"))


_RECORDS = "(SELECT CAST(l_suppkey % 10 AS INT) AS time_id, CAST(l_partkey % 5 AS INT) AS fold, avg(l_discount) AS corr FROM lineitem WHERE NOT (l_suppkey % 10 = 3 AND l_partkey % 5 = 2) GROUP BY 1, 2)"


def _write_records(spark, d):
    path = io.scratch(spark, "records")
    li = read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("time_id"), (F.col("l_partkey") % 5).cast("int").alias("fold"), "l_discount").where("not (time_id = 3 and fold = 2)")
    li.groupBy("time_id", "fold").agg(F.avg("l_discount").alias("corr")).write.partitionBy("time_id").parquet(path)
    return io.scan_records(spark, path, "fold int, corr double, time_id int")


@query("scan_results_partitioned", f"SELECT time_id, fold, round(corr, 6) AS corr FROM {_RECORDS} WHERE time_id < 5")
def scan_results_partitioned(spark, d):
    """A9"""
    return _write_records(spark, d).where("time_id < 5").select("time_id", "fold", fn.r6(F.col("corr")).alias("corr"))


@query("scan_folds_complete", f"SELECT time_id, fold, round(corr, 6) AS corr FROM {_RECORDS} WHERE time_id IN (SELECT time_id FROM {_RECORDS} GROUP BY 1 HAVING count(DISTINCT fold) = 5)")
def scan_folds_complete(spark, d):
    """A10"""
    from synapta.operators.inference import complete_runs

    return complete_runs(_write_records(spark, d), ["time_id"], "fold", 5).select("time_id", "fold", fn.r6(F.col("corr")).alias("corr"))


@query("scan_holdout", f"SELECT time_id, round(corr, 6) AS corr FROM {_RECORDS} WHERE fold = 0")
def scan_holdout(spark, d):
    """A11"""
    return _write_records(spark, d).where("fold = 0").select("time_id", fn.r6(F.col("corr")).alias("corr"))


@query("matrix_fallback", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'raw' ELSE 'z' END AS source FROM customer")
def matrix_fallback(spark, d):
    """Every key has the plain matrix, some the transformed one, which goes first"""
    c = read(spark, d, "customer").select("c_custkey", F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("GG_FC"))).otherwise(F.array(F.lit("GG_FC"), F.lit("GG_FC_Z")))).alias("name"))
    found = io.lookup_named(c.withColumn("source", F.when(F.col("name") == "GG_FC", "raw").otherwise("z")), ["c_custkey"], "name", ["GG_FC_Z", "GG_FC"])
    return found.select("c_custkey", "source")


@query("matrix_complete", "SELECT l_orderkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3")
def matrix_complete(spark, d):
    """C13"""
    return cohort.complete_blocks(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])[0]


@query("matrix_missing", "SELECT o.l_orderkey, f.l_returnflag FROM (SELECT DISTINCT l_orderkey FROM lineitem) o, (SELECT unnest(['A', 'N', 'R']) AS l_returnflag) f WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.l_orderkey AND l.l_returnflag = f.l_returnflag)")
def matrix_missing(spark, d):
    """What is missing"""
    return cohort.complete_blocks(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])[1]


@query("sink_summary_csv", f"SELECT subid, run_key, count(*) AS n_frames, round(avg(fd), 6) AS mean_fd FROM {FRAMES} GROUP BY 1, 2")
def sink_summary_csv(spark, d):
    """A14 G1"""
    path = io.scratch(spark, "summary")
    s = motion.run_summary(frames(spark, d), ["subid", "run_key"], "fd")
    io.write_sorted_csv(s, path, ["subid", "run_key", "n_frames", "mean_fd"], ["subid", "run_key"])
    return spark.read.csv(path, header=True, schema="subid bigint, run_key string, n_frames bigint, mean_fd double")


@query("first_differences", "SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 1998 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997) ORDER BY 1 LIMIT 10")
def first_differences(spark, d):
    """A preview of ten"""
    o = read(spark, d, "orders")
    diff = cohort.list_difference(o.where("year(o_orderdate) = 1997"), o.where("year(o_orderdate) = 1998"), "o_custkey")
    return diff.where("change = 'added'").select("o_custkey").orderBy("o_custkey").limit(10)


@query("sink_feature_matrix", "SELECT CAST(label AS VARCHAR) AS feature_set, count(*) AS n_subjects, 64 AS n_features FROM embeddings GROUP BY 1")
def sink_feature_matrix(spark, d):
    """A16"""
    path = io.scratch(spark, "features")
    info = io.write_features(vectors(spark, d).select("subid", F.col("label").cast("string").alias("feature_set"), "x"), path)
    lines = spark.read.schema("value string, feature_set string").option("basePath", f"{path}/vectors").text(f"{path}/vectors")
    back = lines.groupBy("feature_set").agg(F.count("*").alias("n_subjects"), F.max(F.size(F.split("value", " "))).alias("n_features"))
    return info.join(back, ["feature_set", "n_subjects", "n_features"])  # what is read back agrees with the counts


@query("sink_tsv_fixed", "SELECT event_id, printf('%.10f', value / 7) AS v FROM events")
def sink_tsv_fixed(spark, d):
    """A17"""
    path = io.scratch(spark, "tsv")
    io.write_fixed_tsv(read(spark, d, "events").select("event_id", (F.col("value") / 7).alias("v")), path, ["v"])
    return spark.read.csv(path, sep="\t", header=True, schema="event_id bigint, v string")


@query("stage_manifest", r"""SELECT page_id, CASE WHEN regexp_matches(url, '/[a-z]+/[0-9]+$') THEN 'bold' ELSE 'other' END AS kind, CASE WHEN regexp_matches(url, '/[a-z]+/[0-9]+$') THEN 'task-' || regexp_extract(url, '/([a-z]+)/([0-9]+)$', 1) || '_run-' || regexp_extract(url, '/([a-z]+)/([0-9]+)$', 2) ELSE 'page' END AS name FROM pages""")
def stage_manifest(spark, d):
    """A18 B32"""
    files = read(spark, d, "pages").select("page_id", F.col("url").alias("path"))
    return io.staging_manifest(files, [("/([a-z]+)/([0-9]+)$", "bold", "task-{0}_run-{1}"), (".*", "other", "page")]).select("page_id", "kind", "name")
