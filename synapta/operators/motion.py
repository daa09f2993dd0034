"""Motion screening and ordered series: run summaries, validity, differences, detrending, normalising, confounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions import motion_valid
from synapta.operators.scans import scan


def run_summary(frames: DataFrame, keys: list[str], fd: str, low: float = 0.2) -> DataFrame:
    """Frames, mean of the parsable cells, their number, share below ``low``, for each run. No parsable cell: NULL."""
    return frames.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.round(F.avg(fd), 6).alias("mean_fd"), F.count(fd).alias("n_valid"),
        F.round(F.avg((F.col(fd) < low).cast("int")), 6).alias("low_ratio"),
    )


def pooled_summary(frames: DataFrame, keys: list[str], fd: str, low: float = 0.2) -> DataFrame:
    """As run_summary over all files of a key, from sums (partial and final form)."""
    sums = frames.groupBy(*keys).agg(F.count("*").alias("n_frames"), F.sum(fd).alias("s"), F.count(fd).alias("n_valid"), F.count_if(F.col(fd) < low).alias("n_low"))
    return sums.select(*keys, "n_frames", F.round(F.try_divide("s", "n_valid"), 6).alias("mean_fd"), F.round(F.try_divide("n_low", "n_valid"), 6).alias("low_ratio"))


def screen(summary: DataFrame, subject: list[str], min_runs: int = 2, **rule) -> DataFrame:
    """Valid runs of each subject and whether they suffice."""
    ok = motion_valid(F.col("mean_fd"), F.col("low_ratio"), F.col("n_frames"), **rule)
    n = F.count_if(ok)
    return summary.groupBy(*subject).agg(n.alias("valid_num"), (n >= min_runs).alias("valid_subject"))


def wide_summary(summary: DataFrame, subject: str, run: str, runs: list[str]) -> DataFrame:
    """One row a subject with the columns of each listed run; an absent run has NULLs and valid false."""
    ok = motion_valid(F.col("mean_fd"), F.col("low_ratio"))
    aggs = []
    for r in runs:
        here = F.col(run) == r
        aggs += [F.max(F.when(here, F.col("n_frames"))).alias(f"{r}_frame"), F.max(F.when(here, F.col("mean_fd"))).alias(f"{r}_fd"), F.coalesce(F.bool_or(here & ok), F.lit(False)).alias(f"{r}_valid")]
    return summary.groupBy(subject).agg(*aggs)


def weighted_fd(summary: DataFrame, subject: str, valid_only: bool) -> DataFrame:
    """E5 (all runs with data) and E6 (valid runs only): mean FD weighted by frames."""
    use = F.col("mean_fd").isNotNull()
    if valid_only:
        use &= motion_valid(F.col("mean_fd"), F.col("low_ratio"))
    n = F.when(use, F.col("n_frames"))
    return summary.groupBy(subject).agg(F.round(F.try_divide(F.sum(n * F.col("mean_fd")), F.sum(n)), 6).alias("weighted_fd"))


def frame_index(df: DataFrame, keys: list[str], order: list[str], name: str = "t") -> DataFrame:
    """A run's frames numbered from 0 in the given order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def backward_difference(df: DataFrame, keys: list[str], order: list[str], x: str, out: str, checkpoint=None) -> DataFrame:
    """x minus the value before, 0 in the first row. A run is a window; with ``checkpoint`` a scan over ranges, for keys of any size."""
    if checkpoint:
        return scan(df, keys, [F.asc(c) for c in order], checkpoint, before={"_before": x}).withColumn(out, F.coalesce(F.col(x) - F.col("_before"), F.lit(0.0))).drop("_before")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.coalesce(F.col(x) - F.lag(x).over(w), F.lit(0.0)))


def unbiased_difference(df: DataFrame, keys: list[str], order: list[str], x: str, out: str) -> DataFrame:
    """forward in the first row, backward in the last, half the central difference between; 0 for a single row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    c, before, after = F.col(x), F.lag(x).over(w), F.lead(x).over(w)
    has_b, has_a = F.lag(F.lit(1)).over(w).isNotNull(), F.lead(F.lit(1)).over(w).isNotNull()
    return df.withColumn(out, F.when(has_b & has_a, (after - before) / 2).when(has_a, after - c).when(has_b, c - before).otherwise(0.0))


def linear_detrend(df: DataFrame, keys: list[str], t: str, x: str, out: str) -> DataFrame:
    """Residual of least squares on time; the mean is taken out too. A run of one time point gives 0."""
    w = Window.partitionBy(*keys)
    slope = F.regr_slope(F.col(x), F.col(t)).over(w)
    mt, mx = F.avg(F.when(F.col(x).isNotNull(), F.col(t))).over(w), F.avg(x).over(w)
    return df.withColumn(out, F.col(x) - mx - F.coalesce(slope, F.lit(0.0)) * (F.col(t) - mt))


def polynomial_detrend(df: DataFrame, keys: list[str], t: str, x: str, out: str, order: int = 2) -> DataFrame:
    """residual on polynomials of time. The powers are made orthogonal one after another (three-term recurrence), so a run
    with fewer time points than powers loses only the powers that it can hold."""
    w = Window.partitionBy(*keys)
    scale = F.greatest(F.max(F.abs(F.col(t))).over(w), F.lit(1)).cast("double")
    out_df = df.withColumn("_b0", F.lit(1.0)).withColumn("_u", F.col(t) / scale).withColumn(out, F.col(x) - F.avg(x).over(w))
    basis = ["_b0"]
    for k in range(1, order + 1):
        raw, name = F.col("_u") * F.col(basis[-1]), f"_b{k}"
        out_df = out_df.withColumn("_raw", raw)
        new = F.col("_raw")
        for b in basis:
            new = new - F.coalesce(F.try_divide(F.sum(F.col("_raw") * F.col(b)).over(w), F.sum(F.col(b) * F.col(b)).over(w)), F.lit(0.0)) * F.col(b)
        out_df = out_df.withColumn(name, new)
        norm = F.sum(F.col(name) * F.col(name)).over(w)
        fit = F.when(norm > 1e-9, F.sum(F.col(out) * F.col(name)).over(w) / norm).otherwise(0.0)
        out_df = out_df.withColumn(out, F.col(out) - fit * F.col(name))
        basis.append(name)
    return out_df.drop("_raw", "_u", *basis)


def normalise(df: DataFrame, keys: list[str], x: str, out: str, floor: float = 1e-5) -> DataFrame:
    """demeaned, divided by the sample deviation or the floor."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, (F.col(x) - F.avg(x).over(w)) / F.greatest(F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(floor)))


def concatenate_runs(df: DataFrame, subject: list[str], run: str, t: str, out: str = "t_global") -> DataFrame:
    """F8: time within a run plus the lengths of the subject's runs before it. Lengths are aggregated first, so the window holds
    one row a run."""
    length = df.groupBy(*subject, run).agg((F.max(t) + 1).alias("_n"))
    w = Window.partitionBy(*subject).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    before = length.select(*subject, run, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return df.join(before, [*subject, run]).withColumn(out, F.col(t) + F.col("_before")).drop("_before")


def equalise_runs(df: DataFrame, comp: list[str], run: str, x: str, out: str) -> DataFrame:
    """each run scaled to its component's overall deviation."""
    each, whole = Window.partitionBy(*comp, run), Window.partitionBy(*comp)
    return df.withColumn(out, F.try_divide(F.col(x), F.nullif(F.stddev_samp(x).over(each), F.lit(0.0))) * F.stddev_samp(x).over(whole))


def dvars(df: DataFrame, run: list[str], loc: str, t: str, x: str) -> DataFrame:
    """root mean square over locations of the backward difference in time, 0 at a run's start, minus the run's median."""
    d = backward_difference(df, [*run, loc], [t], x, "_d")
    per_t = d.groupBy(*run, t).agg(F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("dvars"))
    return per_t.withColumn("dvars_centred", F.col("dvars") - F.percentile("dvars", F.lit(0.5)).over(Window.partitionBy(*run)))


def motion_expansion(df: DataFrame, keys: list[str], order: list[str], params: list[str], rotations: list[str]) -> DataFrame:
    """Rotations in radians, the parameters, their backward differences and the squares of both (24 of 6)."""
    for c in rotations:
        df = df.withColumn(c, F.radians(c))
    for c in params:
        df = backward_difference(df, keys, order, c, f"d_{c}")
    squares = {f"{c}_sq": F.col(c) * F.col(c) for p in params for c in (p, f"d_{p}")}
    return df.withColumns(squares)


def signal_expansion(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """derivative1, power2 and derivative1_power2 of a signal."""
    df = backward_difference(df, keys, order, x, f"{x}_derivative1")
    return df.withColumns({f"{x}_power2": F.pow(x, F.lit(2)), f"{x}_derivative1_power2": F.pow(f"{x}_derivative1", F.lit(2))})


def motion_confounds(df: DataFrame, keys: list[str], order: list[str], params: list[str]) -> DataFrame:
    """L1: parameters and backward differences, normalised, their squares appended and normalised."""
    names = []
    for c in params:
        df = backward_difference(df, keys, order, c, f"d_{c}")
        names += [c, f"d_{c}"]
    for c in names:
        df = normalise(df, keys, c, f"n_{c}")
    for c in names:
        df = normalise(df.withColumn("_sq", F.col(f"n_{c}") * F.col(f"n_{c}")), keys, "_sq", f"n_{c}_sq")
    return df.drop("_sq")


def mean_signal(df: DataFrame, keys: list[str], x: str | Column, out: str = "mean_signal") -> DataFrame:
    """Mean over locations at each time point of ``keys``."""
    return df.groupBy(*keys).agg(F.avg(x).alias(out))


def mask_mean_signal(df: DataFrame, keys: list[str], x: str, mask: Column) -> DataFrame:
    """Mean signal inside a mask; a key without any location inside is an error."""
    out = df.groupBy(*keys).agg(F.avg(F.when(mask, F.col(x))).alias("mean_signal"), F.count_if(mask).alias("_n"))
    return out.withColumn("mean_signal", F.when(F.col("_n") > 0, F.col("mean_signal")).otherwise(F.raise_error(F.lit("empty mask")))).drop("_n")
