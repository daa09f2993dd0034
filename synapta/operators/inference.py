"""Inference on result tables: permutation p-values, summaries, paired tests, false discovery control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions import pearson, stars
from synapta.operators.quantiles import LIMIT, exact_percentiles
from synapta.operators.scans import scan


def right_tail_p(observed: DataFrame, null: DataFrame, keys: list[str], x: str, plus_one: bool = True) -> DataFrame:
    """K1 (with the +1 correction) and K2 (without): share of null values at or above the observed one; ``observed`` has one row a key."""
    joined = observed.select(*keys, F.col(x).alias("observed")).join(null.select(*keys, F.col(x).alias("_n")), keys)
    one = 1 if plus_one else 0
    return joined.groupBy(*keys).agg(F.first("observed").alias("observed"), F.count("_n").alias("n_null"), F.try_divide(F.count_if(F.col("_n") >= F.col("observed")) + one, F.count("_n") + one).alias("p"))


def null_summary(df: DataFrame, keys: list[str], x: str, is_observed: Column) -> DataFrame:
    """Observed value (median), null moments, z, p and stars, in one aggregation for each key."""
    obs = df.where(is_observed).groupBy(*keys).agg(F.percentile(x, F.lit(0.5)).alias("observed"))
    null = df.where(~is_observed).select(*keys, F.col(x).alias("_n"))
    s = obs.join(null, keys).groupBy(*keys).agg(F.first("observed").alias("observed"), F.count("_n").alias("n_null"), F.avg("_n").alias("null_mean"), F.percentile("_n", F.lit(0.5)).alias("null_median"), F.stddev_samp("_n").alias("null_std"), ((F.count_if(F.col("_n") >= F.col("observed")) + 1) / (F.count("_n") + 1)).alias("p"))
    return s.withColumn("z", F.try_divide(F.col("observed") - F.col("null_mean"), F.nullif("null_std", F.lit(0.0)))).withColumn("label", stars(F.col("p")))


def with_status(targets: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """K4: a row for each target; one without a null keeps NULL statistics and says so."""
    out = targets.join(summary, keys, "left")
    return out.withColumn("status", F.when(F.col("n_null").isNull(), "missing_null").otherwise("ok"))


def deltas(df: DataFrame, on: list[str], set_col: str, x: str, a: str, b: str) -> DataFrame:
    """Paired difference a - b of two feature sets; a pair that is not one to one is an error."""
    side = lambda name: df.where(F.col(set_col) == name).groupBy(*on).agg(F.first(x).alias(name), F.count("*").alias(f"_{name}"))
    both = side(a).join(side(b), on)
    ok = (F.col(f"_{a}") == 1) & (F.col(f"_{b}") == 1)
    return both.withColumn("delta", F.when(ok, F.col(a) - F.col(b)).otherwise(F.raise_error(F.lit("pairs are not one to one")))).select(*on, a, b, "delta")


def paired_t(df: DataFrame, keys: list[str], d: str, test_to_train: float | None = None) -> DataFrame:
    """K6: paired t statistic. K7: with ``test_to_train`` the corrected resampled one, scale sqrt(1/J + ratio), J - 1 degrees of
    freedom. No variance: t is 0 for a mean of 0, else infinite."""
    n, mean, std = F.count(d), F.avg(d), F.stddev_samp(d)
    scale = F.sqrt(1 / n) if test_to_train is None else F.sqrt(1 / n + test_to_train)
    t = F.when(std == 0, F.when(mean == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(mean, scale * std))
    return df.groupBy(*keys).agg(n.alias("n"), mean.alias("mean_delta"), t.alias("t"), (n - 1).alias("dof"))


def _beta_tail(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b) by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(front + a * np.log(x) + b * np.log1p(-x)) / a
    c, tiny = np.ones_like(x), 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 200):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + step / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, front * h))
    return np.where(flip, 1 - out, out)


def t_two_sided(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """K9: two-sided tail of Student's t."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    x = dof / (dof + np.where(np.isinf(t), 0, t) ** 2)
    return np.where(np.isinf(t), 0.0, _beta_tail(dof / 2, np.full_like(dof, 0.5), x))


def f_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Right tail of the F distribution."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return _beta_tail(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def with_t_p(df: DataFrame, t: str = "t", dof: str = "dof") -> DataFrame:
    """K9: p column; a vectorised function over the few rows of a table of statistics. NULL t or no degrees of freedom: NULL."""

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        ok = t.notna() & (dof > 0)
        out = pd.Series(np.nan, index=t.index)
        out[ok] = t_two_sided(t[ok].to_numpy(), dof[ok].to_numpy())
        return out

    return df.withColumn("p", F.nullif(p(F.col(t).cast("double"), F.col(dof).cast("double")), F.lit(float("nan"))))


def anova(df: DataFrame, keys: list[str], group: str, x: str) -> DataFrame:
    """One-way analysis of variance of the groups of each key: F, its degrees of freedom and p."""
    g = df.where(F.col(x).isNotNull()).groupBy(*keys, group).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.count("*") - 1).alias("d1"), (F.sum("n") - F.count("*")).alias("d2"))
    s = s.withColumn("f", F.try_divide(F.col("between") / F.col("d1"), F.nullif(F.try_divide("within", "d2"), F.lit(0.0))))

    @F.pandas_udf("double")
    def p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        ok = f.notna() & (d1 > 0) & (d2 > 0)
        out = pd.Series(np.nan, index=f.index)
        out[ok] = f_tail(f[ok].to_numpy(), d1[ok].to_numpy(), d2[ok].to_numpy())
        return out

    return s.withColumn("p", F.nullif(p("f", "d1", "d2"), F.lit(float("nan"))))


def bh_fdr(df: DataFrame, p: str, family: list[str] | None = None, tie: list[str] = (), strict: int | None = None, checkpoint=None) -> DataFrame:
    """Benjamini-Hochberg q by a running minimum from the largest p. NULL p stays NULL and is not counted, unless
    ``strict`` asks for exactly so many p-values: then another number or a NULL is an error. The few tests of one report are windows;
    with ``checkpoint`` ranks and minima are scans over ranges, for families of any size (voxels, edges); ``tie`` must then order equal p fully."""
    keys = family or []
    if checkpoint:
        of = [*keys, "_none"]
        ranked = scan(df.withColumn("_none", F.col(p).isNull()), of, [F.asc(p), *map(F.asc, tie)], checkpoint, number="_rank", total="_n")
        ranked = ranked.withColumn("_step", F.col(p) * F.col("_n") / F.col("_rank"))
        out = scan(ranked, of, [F.desc("_rank")], checkpoint, least={"_least": "_step"}).drop("_none", "_step")
        out = out.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), "_least"))).drop("_least")
    else:
        every = Window.partitionBy(*keys, F.col(p).isNull())
        w = Window.partitionBy(*keys, F.col(p).isNull()).orderBy(F.col(p), *tie)
        back = w.rowsBetween(0, Window.unboundedFollowing)
        out = df.withColumn("_rank", F.row_number().over(w)).withColumn("_n", F.count("*").over(every))
        out = out.withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(back))))
    if strict is not None:
        bad = F.col(p).isNull() | (F.col("_n") != strict)
        out = out.withColumn("q", F.when(bad, F.raise_error(F.lit(f"expected {strict} p-values"))).otherwise(F.col("q")))
    return out.drop("_rank", "_n")


def fdr_wide(df: DataFrame, ids: list[str], columns: list[str], strict: int | None = None) -> DataFrame:
    """K8: q columns beside the p columns of a wide report, over all of its tests."""
    long = df.unpivot(ids, columns, "metric", "p")
    q = bh_fdr(long, "p", tie=[*ids, "metric"], strict=strict)
    back = q.groupBy(*ids).pivot("metric", columns).agg(F.first("q"))
    return df.join(back.withColumnsRenamed({c: f"{c}_q" for c in columns}), ids)


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, z: str, least: int = 3) -> DataFrame:
    """Correlation of x and y given z over complete rows; NULL for fewer rows than ``least`` or a zero denominator."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()
    c = df.where(ok).groupBy(*keys).agg(pearson(F.col(x), F.col(y)).alias("xy"), pearson(F.col(x), F.col(z)).alias("xz"), pearson(F.col(y), F.col(z)).alias("yz"), F.count("*").alias("n"))
    den = F.sqrt(F.greatest((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz")), F.lit(0.0)))
    return c.select(*keys, "n", F.when((F.col("n") >= least) & (den > 1e-12), (F.col("xy") - F.col("xz") * F.col("yz")) / den).alias("partial_r"))


def rank_matched(df: DataFrame, set_col: str, run: str, x: str, a: str, b: str) -> DataFrame:
    """The k-th best run of one set beside the k-th best of another; missing values rank last, ties by run."""
    w = Window.partitionBy(set_col).orderBy(F.desc_nulls_last(x), run)
    r = df.where(F.col(set_col).isin(a, b)).withColumn("rank", F.row_number().over(w))
    side = lambda s: r.where(F.col(set_col) == s).select("rank", F.col(run).alias(f"{s}_run"), F.col(x).alias(f"{s}_value"))
    return side(a).join(side(b), "rank")


def complete_runs(folds: DataFrame, keys: list[str], fold: str, n_folds: int) -> DataFrame:
    """A10: rows of runs that have all folds."""
    ok = folds.groupBy(*keys).agg(F.count_distinct(fold).alias("n")).where(F.col("n") == n_folds).select(*keys)
    return folds.join(ok, keys, "left_semi")


def index_mismatches(a: DataFrame, b: DataFrame, run: str, idx: str) -> DataFrame:
    """For each run the test indices that only one side has; 0 means aligned."""
    x = a.select(run, idx, F.lit(1).alias("_a")).join(b.select(run, idx, F.lit(1).alias("_b")), [run, idx], "full")
    return x.groupBy(run).agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("n_mismatch"), F.count("*").alias("n"))


def distribution(df: DataFrame, keys: list[str], x: str, checkpoint, observed: Column | None = None, limit: int = LIMIT) -> DataFrame:
    """N, moments, quantiles (found by counts, see `quantiles`), and the share at or above ``observed`` (an expression of
    the keys' columns)."""
    q = checkpoint(exact_percentiles(df, keys, x, [0.05, 0.25, 0.5, 0.75, 0.95], checkpoint, limit).drop("n"))
    aggs = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    if observed is not None:
        aggs.append(F.avg((F.col(x) >= observed).cast("int")).alias("exceedance"))
    out = df.groupBy(*keys).agg(*aggs).join(q, keys, "left")
    return out.select(*keys, "n", "mean", "std", "min", "max", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))), *(["exceedance"] if observed is not None else []))


def shared_histogram(df: DataFrame, keys: list[str], x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts and densities over shared edges; the top edge belongs to the last bin, values outside are left out."""
    width = (hi - lo) / bins
    inside = df.where((F.col(x) >= lo) & (F.col(x) <= hi)).withColumn("bin", F.least(F.floor((F.col(x) - lo) / width), F.lit(bins - 1)).cast("int"))
    h = inside.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    return h.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) / width)


def against_best(df: DataFrame, keys: list[str], set_col: str, x: str) -> DataFrame:
    """Median of each set, the best set of the key (ties: the least name) and the difference from it."""
    m = df.groupBy(*keys, set_col).agg(F.percentile(x, F.lit(0.5)).alias("median"))
    best = m.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("median"), set_col))).where("_r = 1")
    best = best.select(*keys, F.col(set_col).alias("best"), F.col("median").alias("best_median"))
    return m.join(best, keys).withColumn("delta", F.col("median") - F.col("best_median"))


def weight_median(df: DataFrame, keys: list[str], w: str, source: str | None = None) -> DataFrame:
    """Median over records of each place of a weight array; with ``source`` also the number of datasets pooled."""
    long = df.select(*keys, *([source] if source else []), F.posexplode(w).alias("f", "_w"))
    aggs = [F.percentile("_w", F.lit(0.5)).alias("median"), F.count("_w").alias("n")]
    return long.groupBy(*keys, "f").agg(*aggs, *([F.count_distinct(source).alias("n_sources")] if source else []))


def dataset_counts(df: DataFrame, keys: list[str], w: str, source: str) -> DataFrame:
    """Records of each dataset for each place of a weight array."""
    return df.select(*keys, source, F.posexplode(w).alias("f", "_w")).groupBy(*keys, source, "f").agg(F.count("_w").alias("n"))


def first_valid(df: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """The first value that is there."""
    return df.groupBy(*keys).agg(F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias("first_valid"))


def least_score(df: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """The item of the least score (ties: the least item)."""
    return df.groupBy(*keys).agg(F.min_by(item, F.struct(score, item)).alias("best"), F.min(score).alias("best_score"))


def regression_t(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """T of a slope from the residual sum of squares, for each location."""
    n, sxx = F.regr_count(F.col(y), F.col(x)), F.regr_sxx(F.col(y), F.col(x))
    sse = F.regr_syy(F.col(y), F.col(x)) - F.try_divide(F.pow(F.regr_sxy(F.col(y), F.col(x)), F.lit(2)), sxx)
    s = df.groupBy(*keys).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), n.alias("n"), sxx.alias("sxx"), sse.alias("sse"))
    return s.select(*keys, "slope", (F.col("n") - 2).alias("dof"), F.try_divide(F.col("slope"), F.sqrt(F.nullif(F.try_divide(F.col("sse"), (F.col("n") - 2) * F.col("sxx")), F.lit(0.0)))).alias("t"))
