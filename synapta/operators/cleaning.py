"""Time-series cleaning, variance decomposition, map averages, echoes, directions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from synapta.functions import safe_ratio
from synapta.operators.models import fitted, least_squares, residuals
from synapta.operators.scans import scan


def full_cleanup(df: DataFrame, loc: list[str], confounds: list[str], x: str, out: str) -> DataFrame:
    """L2: residual on all confounds."""
    return residuals(df, loc, confounds, x, out)


def partial_cleanup(df: DataFrame, loc: list[str], components: list[str], noise: list[str], x: str, out: str) -> DataFrame:
    """L3: all components are fitted, only the noise part is taken out."""
    return residuals(df, loc, components, x, out, only=noise)


def mean_signal_regression(df: DataFrame, loc: list[str], t: str, x: str) -> DataFrame:
    """L4: slope on the mean signal, variance left, and the share explained, for each location."""
    g = df.groupBy(t).agg(F.avg(x).alias("_g"))
    d = df.join(g, t)
    beta, r2 = F.regr_slope(F.col(x), F.col("_g")), F.regr_r2(F.col(x), F.col("_g"))
    return d.groupBy(*loc).agg(beta.alias("beta"), (F.var_samp(x) * (1 - r2)).alias("var_resid"), r2.alias("r2"))


def variance_normaliser(df: DataFrame, loc: list[str], signal: list[str], x: str, floor: float = 0.001) -> DataFrame:
    """Deviation left after the signal components, at least ``floor``."""
    r = residuals(df, loc, signal, x, "_r")
    return r.groupBy(*loc).agg(F.greatest(F.coalesce(F.stddev_samp("_r"), F.lit(0.0)), F.lit(floor)).alias("vn"))


def variance_partition(df: DataFrame, loc: list[str], stages: list[str]) -> DataFrame:
    """Variance of each step between consecutive stages and its share of the first stage's variance; unexplained
    variance is what the steps share."""
    aggs = [F.var_samp(stages[0]).alias("total")]
    for a, b in zip(stages, stages[1:]):
        aggs.append(F.var_samp(F.col(a) - F.col(b)).alias(f"{a}_to_{b}"))
    aggs.append(F.var_samp(stages[-1]).alias("unstructured"))
    v = df.groupBy(*loc).agg(*aggs)
    parts = [f"{a}_to_{b}" for a, b in zip(stages, stages[1:])] + ["unstructured"]
    shared = F.col("total")
    for p in parts:
        shared = shared - F.col(p)
    return v.withColumns({f"{p}_share": safe_ratio(F.col(p), F.col("total")) for p in parts}).withColumn("shared_share", safe_ratio(shared, F.col("total")))


def temporal_moments(df: DataFrame, loc: list[str], x: str) -> DataFrame:
    """Mean, deviation, variance, coefficient of variation and signal to noise of each location."""
    m, s = F.avg(x), F.stddev_samp(x)
    return df.groupBy(*loc).agg(m.alias("mean"), s.alias("std"), F.var_samp(x).alias("var"), safe_ratio(s, m).alias("cov"), safe_ratio(m, s).alias("tsnr"))


#: Series of ``variance_sources`` of which the mean over locations is fitted.
SERIES = ("orig", "high_pass", "post_motion", "cleaned", "unstructured", "noise")
#: Statistics of ``variance_sources`` for each location.
SOURCE_STATISTICS = (
    "mean", "std", "cov", "tsnr", "cnr", "orig_var", "high_pass_var", "motion_var", "structured_var", "bold_var", "unstructured_var", "shared_var",
    *(f"{s}_{n}" for n in ("mean_signal_var", "mean_signal_beta", "mean_signal_r2") for s in SERIES),
    *(f"{s}_share" for s in ("high_pass", "motion", "structured", "bold", "unstructured")), *(f"{s}_mean_signal_share" for s in SERIES), "cleaned_mean_signal_vs_bold",
)


def source_series(df: DataFrame, run: list[str], loc: str, t: str, orig: str, high_pass: str, confounds: list[str], signal: list[str], noise: list[str], checkpoint=lambda d: d) -> DataFrame:
    """(run, loc, t) with the series of each stage of cleaning, as `variance_sources` has them: a column _name for each of SERIES."""
    keys = [*run, loc]
    d = df.withColumns({"_orig": F.col(orig).cast("double"), "_high_pass": F.col(high_pass).cast("double")})
    d = checkpoint(residuals(d, keys, confounds, "_high_pass", "_post_motion").select(*keys, t, *signal, *noise, "_orig", "_high_pass", "_post_motion"))
    b = least_squares(d, keys, [*signal, *noise], "_post_motion")
    of_signal, of_noise = fitted("beta", [*signal, *noise], only=signal), fitted("beta", [*signal, *noise], only=noise)
    d = d.join(b, keys).withColumns({"_cleaned": F.col("_post_motion") - of_noise, "_noise": F.col("_post_motion") - of_signal, "_unstructured": F.col("_post_motion") - of_signal - of_noise})
    return checkpoint(d.select(*keys, t, *(f"_{s}" for s in SERIES)))


#: Courses that `tissue_variances` takes out, alone and together, and its statistics of each.
TISSUES = {"wm": ("wm",), "csf": ("csf",), "wm_csf": ("wm", "csf")}
TISSUE_STATISTICS = tuple(f"{s}_{n}" for s in TISSUES for n in ("var", "bold_var", "mean_signal_var", "mean_signal_beta", "mean_signal_r2"))


def tissue_courses(courses: DataFrame, run: list[str], t: str, confounds: list[str], signal: list[str], noise: list[str], wm: str, csf: str) -> DataFrame:
    """(run, t, wm, csf): white-matter and CSF courses cleaned as the data are (confounds out, then what the noise components take
    beside the signal ones), demeaned. ``courses``: one row a (run, t), high-passed."""
    both = F.explode(F.array(*(F.struct(F.lit(n).alias("tissue"), F.col(c).cast("double").alias("v")) for n, c in (("wm", wm), ("csf", csf)))))
    c = courses.select(*run, t, *confounds, *signal, *noise, both.alias("x")).select("*", "x.tissue", "x.v").drop("x")
    keys = [*run, "tissue"]
    c = residuals(c, keys, confounds, "v", "_pm").select(*keys, t, *signal, *noise, "_pm")
    c = c.join(least_squares(c, keys, [*signal, *noise], "_pm"), keys).withColumn("_clean", F.col("_pm") - fitted("beta", [*signal, *noise], only=noise))
    c = c.join(c.groupBy(*keys).agg(F.avg("_clean").alias("_m")), keys).withColumn("_clean", F.col("_clean") - F.col("_m"))
    return c.groupBy(*run, t).agg(*(F.max(F.when(F.col("tissue") == n, F.col("_clean"))).alias(n) for n in ("wm", "csf")))


def tissue_variances(series: DataFrame, cleaned: DataFrame, run: list[str], loc: str, t: str, checkpoint=lambda d: d) -> DataFrame:
    """One row a location of a run with TISSUE_STATISTICS: for white matter, CSF and both, the variance that their courses take
    out of the cleaned series, the BOLD variance left, and the fit of the mean of what is left. ``series``: `source_series`;
    ``cleaned``: `tissue_courses`. Fits have no intercept. One round of sums by location for each set of courses, one by time point."""
    keys = [*run, loc]
    d = checkpoint(series.join(cleaned, [*run, t]).select(*keys, t, "_cleaned", "_unstructured", "wm", "csf"))
    for name, courses in TISSUES.items():
        d = residuals(d, keys, list(courses), "_cleaned", f"_{name}")
    d = checkpoint(d.drop("wm", "csf"))
    d = d.join(d.groupBy(*run, t).agg(*(F.avg(f"_{s}").alias(f"_g_{s}") for s in TISSUES)), [*run, t])
    aggs = []
    for s in TISSUES:
        x, g = F.col(f"_{s}"), F.col(f"_g_{s}")
        aggs += [F.var_samp(F.col("_cleaned") - x).alias(f"{s}_var"), F.var_samp(x - F.col("_unstructured")).alias(f"{s}_bold_var"), F.regr_slope(x, g).alias(f"{s}_mean_signal_beta")]
        aggs += [F.coalesce(F.regr_r2(x, g), F.lit(0.0)).alias(f"{s}_mean_signal_r2"), (F.pow(F.regr_slope(x, g), F.lit(2)) * F.var_samp(g)).alias(f"{s}_mean_signal_var")]
    return d.groupBy(*keys).agg(*aggs).select(*keys, *TISSUE_STATISTICS)


def variance_sources(df: DataFrame, run: list[str], loc: str, t: str, orig: str, high_pass: str, confounds: list[str], signal: list[str], noise: list[str], checkpoint=lambda d: d) -> DataFrame:
    """One row a location of a run with SOURCE_STATISTICS.

    The variance of ``orig`` is split into what the high-pass filter takes (orig - high_pass), motion (the fit of ``confounds``),
    structured noise (what the ``noise`` components take beside the ``signal`` ones), BOLD (the same of the signal components) and
    unstructured noise (what no component explains); the rest is shared. Fits have no intercept. For each series its mean over
    locations is fitted to each location. Two rounds of sums by location, one by time point; all combine before they are shuffled.
    ``checkpoint`` keeps the series of either round, which the next sums and the join back both read.
    """
    keys = [*run, loc]
    d = source_series(df, run, loc, t, orig, high_pass, confounds, signal, noise, checkpoint)
    g = d.groupBy(*run, t).agg(*(F.avg(f"_{s}").alias(f"_g_{s}") for s in SERIES))
    d = d.join(g, [*run, t])

    col = lambda s: F.col(f"_{s}")
    aggs = {"mean": F.avg("_orig"), "orig_var": F.var_samp("_orig"), "unstructured_var": F.var_samp("_unstructured")}
    parts = {"high_pass_var": ("orig", "high_pass"), "motion_var": ("high_pass", "post_motion"), "structured_var": ("noise", "unstructured"), "bold_var": ("cleaned", "unstructured")}
    aggs |= {n: F.var_samp(col(a) - col(b)) for n, (a, b) in parts.items()}
    aggs |= {f"{s}_mean_signal_beta": F.regr_slope(col(s), F.col(f"_g_{s}")) for s in SERIES}
    aggs |= {f"{s}_mean_signal_r2": F.coalesce(F.regr_r2(col(s), F.col(f"_g_{s}")), F.lit(0.0)) for s in SERIES}
    aggs |= {f"_v_{s}": F.var_samp(f"_g_{s}") for s in SERIES}
    v = d.groupBy(*keys).agg(*(c.alias(n) for n, c in aggs.items()))
    v = v.withColumns({f"{s}_mean_signal_var": F.pow(f"{s}_mean_signal_beta", F.lit(2)) * F.col(f"_v_{s}") for s in SERIES})
    left = F.col("orig_var")
    for n in (*parts, "unstructured_var"):
        left = left - F.col(n)
    rest = F.sqrt("unstructured_var")
    more = {"std": F.sqrt("orig_var"), "cov": safe_ratio(rest, F.col("mean")), "tsnr": safe_ratio(F.col("mean"), rest), "cnr": F.sqrt(safe_ratio(F.col("bold_var"), F.col("unstructured_var"))), "shared_var": left}
    more |= {f"{n}_share": safe_ratio(F.col(f"{n}_var"), F.col("orig_var")) for n in ("high_pass", "motion", "structured", "bold", "unstructured")}
    more |= {f"{s}_mean_signal_share": safe_ratio(F.col(f"{s}_mean_signal_var"), F.col("orig_var")) for s in SERIES}
    more["cleaned_mean_signal_vs_bold"] = safe_ratio(F.col("cleaned_mean_signal_var"), F.col("bold_var"))
    return v.withColumns(more).select(*keys, *SOURCE_STATISTICS)


def map_report(df: DataFrame, run: list[str], statistics: list[str]) -> DataFrame:
    """One row a run with the mean of each map."""
    return df.groupBy(*run).agg(*(F.avg(c).alias(f"mean_{c}") for c in statistics))


def component_maps(df: DataFrame, loc: list[str], components: list[str], x: str) -> DataFrame:
    """Weights of the components with an intercept, which is dropped."""
    b = least_squares(df.withColumn("_one", F.lit(1.0)), loc, ["_one", *components], x)
    return b.select(*loc, *(F.col("beta")[i + 1].alias(c) for i, c in enumerate(components)))


def dual_regression(df: DataFrame, maps: DataFrame, subject: list[str], loc: str, t: str, x: str, components: list[str], weight: str | None = None, checkpoint=lambda d: d) -> tuple[DataFrame, DataFrame]:
    """Time courses of the maps (a fit over locations for each time point, maps and data weighted by the square root of
    ``weight`` and demeaned over locations), demeaned over time; then the subject's maps: the demeaned data of each location fitted
    over time on the courses scaled to a deviation of 1. ``maps``: by location, or by subject and location. ``checkpoint`` keeps the
    courses, which are used three times."""
    d = df.join(maps, [*(c for c in subject if c in maps.columns), loc])
    s = F.sqrt(weight) if weight else F.lit(1.0)
    spatial = d.select(*subject, loc, t, F.lit(1.0).alias("_one"), (F.col(x) * s).alias("_x"), *((F.col(c) * s).alias(c) for c in components))
    b = least_squares(spatial, [*subject, t], ["_one", *components], "_x")  # the intercept demeans both sides
    tc = checkpoint(b.select(*subject, t, *(F.col("beta")[i + 1].alias(c) for i, c in enumerate(components))))
    moments = tc.groupBy(*subject).agg(*(f(c).alias(f"{n}{c}") for c in components for n, f in (("_m", F.avg), ("_s", F.stddev_samp))))
    tc = tc.join(moments, subject)
    scaled = tc.select(*subject, t, F.lit(1.0).alias("_one"), *(F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{c}"), F.nullif(f"_s{c}", F.lit(0.0))), F.lit(0.0)).alias(c) for c in components))
    out = least_squares(df.join(scaled, [*subject, t]), [*subject, loc], ["_one", *components], x)
    maps_out = out.select(*subject, loc, *(F.col("beta")[i + 1].alias(c) for i, c in enumerate(components)))
    return tc.select(*subject, t, *((F.col(c) - F.col(f"_m{c}")).alias(c) for c in components)), maps_out


def normalised_maps(maps: DataFrame, keys: list[str], components: list[str]) -> DataFrame:
    """Maps demeaned over locations and scaled to a deviation of 1, for each key."""
    m = maps.groupBy(*keys).agg(*(f(c).alias(f"{n}{c}") for c in components for n, f in (("_m", F.avg), ("_s", F.stddev_samp))))
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{c}"), F.nullif(f"_s{c}", F.lit(0.0))), F.lit(0.0)) for c in components}
    return maps.join(m, keys).withColumns(scaled).select(*maps.columns)


def alignment_quality(df: DataFrame, low: list[tuple[DataFrame, list[str]]], neighbours: DataFrame, subject: list[str], loc: str, t: str, x: str, area: str | None = None, checkpoint=lambda d: d) -> DataFrame:
    """(subject, loc, quality). For each low-dimensional set of maps, dual regression is run twice, the second time on the maps
    of the first; Fisher's z of the correlation over components with the set's maps is averaged over the sets. What stands out
    from the smoothed values (``neighbours``: loc, other, w) around their mean, negatives as 0, is cubed."""
    from synapta.functions import fisher_z, pearson

    zs = None
    for maps, components in low:
        with_area = [area] if area else []
        once = checkpoint(dual_regression(df, maps, subject, loc, t, x, components, area, checkpoint)[1])
        again = once.join(maps.select(loc, *with_area), loc) if area else once
        twice = dual_regression(df, again, subject, loc, t, x, components, area, checkpoint)[1]
        pairs = F.explode(F.array(*(F.struct(F.col(f"l.{c}").alias("a"), F.col(f"m.{c}").alias("b")) for c in components)))
        z = twice.alias("m").join(maps.alias("l"), loc).select(*(F.col(f"m.{c}").alias(c) for c in subject), loc, pairs.alias("p"))
        z = z.groupBy(*subject, loc).agg(fisher_z(pearson(F.col("p.a"), F.col("p.b"))).alias("z"))
        zs = z if zs is None else zs.unionByName(z)
    q = checkpoint(zs.groupBy(*subject, loc).agg(F.avg("z").alias("q")))
    smooth = q.withColumnRenamed(loc, "other").join(neighbours, "other").groupBy(*subject, loc).agg((F.sum(F.col("q") * F.col("w")) / F.sum("w")).alias("_smooth"))
    mean = q.groupBy(*subject).agg(F.avg("q").alias("_mean"))
    out = q.join(smooth, [*subject, loc]).join(mean, subject)
    return out.select(*subject, loc, F.pow(F.greatest(F.col("_mean") + F.col("q") - F.col("_smooth"), F.lit(0.0)), F.lit(3)).alias("quality"))


def weighted_dual_regression(df: DataFrame, maps: DataFrame, quality: DataFrame, subject: list[str], loc: str, t: str, x: str, components: list[str], area: str | None = None, checkpoint=lambda d: d) -> tuple[DataFrame, DataFrame]:
    """Dual regression weighted by area and alignment quality, then once more on its normalised maps, weighted by area only."""
    a = F.col(area) if area else F.lit(1.0)
    weighted = quality.join(maps, loc).withColumn("_w", a * F.col("quality"))
    once = checkpoint(dual_regression(df, weighted, subject, loc, t, x, components, "_w", checkpoint)[1])
    again = normalised_maps(once, subject, components)
    if area:
        again = again.join(maps.select(loc, area), loc)
    return dual_regression(df, again, subject, loc, t, x, components, area, checkpoint)


def unmix(df: DataFrame, mixing: list[list[float]], inputs: list[str], subject: list[str], run: str) -> DataFrame:
    """Every run's input series are scaled to the deviation over all runs (not finite: 0) and unmixed by the pseudo-inverse of
    the mixing matrix; a component is rescaled by the deviation, over inputs, of its column of the matrix divided by the inputs'
    deviations."""
    a = np.asarray(mixing, float)
    inv, n = np.linalg.pinv(a), len(inputs)
    s = df.groupBy(*subject).agg(*(F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(inputs)))
    of_run = df.groupBy(*subject, run).agg(*(F.stddev_samp(c).alias(f"_r{i}") for i, c in enumerate(inputs)))
    d = df.join(of_run, [*subject, run]).join(s, subject)
    even = [F.coalesce(F.try_divide(F.col(c), F.nullif(f"_r{i}", F.lit(0.0))) * F.col(f"_s{i}"), F.lit(0.0)) for i, c in enumerate(inputs)]
    out = {}
    for k in range(a.shape[1]):
        column = [F.try_divide(F.lit(float(a[i, k])), F.nullif(f"_s{i}", F.lit(0.0))) for i in range(n)]
        mean = sum(column[1:], column[0]) / n
        scale = F.sqrt(sum(((x - mean) * (x - mean) for x in column), F.lit(0.0)) / (n - 1))
        out[f"component{k + 1}"] = sum((float(inv[k, i]) * even[i] for i in range(n)), F.lit(0.0)) * scale
    return d.withColumns(out).drop(*(f"_{p}{i}" for p in "sr" for i in range(n)))


def temporal_cleanup(df: DataFrame, loc: list[str], run: str, t: str, x: str, vn: str, components: list[str], noise: list[str], out: str) -> DataFrame:
    """Each run is demeaned and divided by its variance normalisation ``vn`` (over its mean over locations, at least 0.001), all
    are put back to the mean normalisation over runs, and the noise part of a fit on the normalised courses of all runs is taken out.
    The result stays by run. (loc, run, t, out, and vn as used.)"""
    mean_vn = df.groupBy(*loc, run).agg(F.first(vn).alias("_vn"), F.avg(x).alias("_m"))
    level = mean_vn.groupBy(run).agg(F.avg("_vn").alias("_level"))
    used = mean_vn.join(F.broadcast(level), run).withColumn("_vn", F.greatest(F.col("_vn") / F.col("_level"), F.lit(0.001))).drop("_level")
    back = used.groupBy(*loc).agg(F.avg("_vn").alias("_back"))
    d = df.join(used, [*loc, run]).join(back, loc).withColumn("_x", (F.col(x) - F.col("_m")) / F.col("_vn") * F.col("_back"))
    courses = df.select(run, t, *components).distinct()
    m = courses.agg(*(f(c).alias(f"{n}{c}") for c in components for n, f in (("_m_", F.avg), ("_s_", F.stddev_samp))))
    courses = courses.crossJoin(F.broadcast(m)).select(run, t, *(F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.nullif(f"_s_{c}", F.lit(0.0))), F.lit(0.0)).alias(c) for c in components))
    d = d.drop(*components).join(courses, [run, t]).withColumn("_one", F.lit(1.0))
    return residuals(d, loc, ["_one", *components], "_x", out, only=noise).select(*loc, run, t, out, F.col("_vn").alias("vn"))


def grand_mean_scale(df: DataFrame, keys: list[str], x: str, mask: Column, target: float = 10_000.0) -> DataFrame:
    """Scaled so that the mean of the positive values inside the mask is ``target``; negatives become 0. The mean is aggregated
    first and joined back."""
    m = df.groupBy(*keys).agg(F.avg(F.when(mask, F.col(x))).alias("_m"))
    return df.join(m, keys).withColumn("scaled", F.greatest(F.lit(0.0), F.col(x) * F.try_divide(F.lit(target), "_m"))).drop("_m")


def rescale_to_first(df: DataFrame, series: str, x: str) -> DataFrame:
    """Each series scaled to the mean of the first one."""
    m = df.groupBy(series).agg(F.avg(x).alias("_m"))
    first = m.agg(F.min_by("_m", series).alias("_first"))
    return df.join(m, series).crossJoin(F.broadcast(first)).withColumn("scaled", F.col(x) * F.try_divide("_first", F.nullif("_m", F.lit(0.0)))).drop("_m", "_first")


def mean_without_outliers(df: DataFrame, loc: list[str], x: str, sigmas: float = 3.0) -> DataFrame:
    """Plain mean, and mean and deviation of the values within ``sigmas`` deviations of it."""
    m = df.groupBy(*loc).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("_s"))
    kept = df.join(m, loc).where(F.abs(F.col(x) - F.col("mean")) <= sigmas * F.coalesce("_s", F.lit(0.0)))
    return kept.groupBy(*loc).agg(F.first("mean").alias("mean"), F.avg(x).alias("mean_kept"), F.stddev_samp(x).alias("std_kept"), F.count(x).alias("n_kept"))


def group_sums(df: DataFrame, keys: list[str], x: str, is_full: str) -> DataFrame:
    """Mean over subjects with any data, over those of full length, and of absolute values."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean_any"), F.avg(F.when(F.col(is_full), F.col(x))).alias("mean_full"), F.avg(F.abs(x)).alias("mean_abs"))


def percent_variance(df: DataFrame, comp: str, x: str) -> DataFrame:
    """Share of each component in the sum of variances, in percent. The window runs over one row a component."""
    v = df.groupBy(comp).agg(F.var_samp(x).alias("var"))
    return v.withColumn("percent", 100 * F.try_divide("var", F.sum("var").over(Window.partitionBy(F.lit(1)))))


def parcel_mean(df: DataFrame, labels: DataFrame, loc: str, keys: list[str], x: str) -> DataFrame:
    """E23."""
    return df.join(labels, loc).groupBy(*keys).agg(F.avg(x).alias("mean"))


def mean_vn(df: DataFrame, loc: list[str], run: str, x: str) -> DataFrame:
    """Mean over runs of the deviation of each run (a true mean, trap T9)."""
    return df.groupBy(*loc, run).agg(F.stddev_samp(x).alias("_s")).groupBy(*loc).agg(F.avg("_s").alias("vn"))


def shell(df: DataFrame, b: str, wanted: list[float], delta: float) -> DataFrame:
    """C14: volumes within ``delta`` of any wanted b-value."""
    near = F.lit(False)
    for w in wanted:
        near = near | (F.abs(F.col(b) - w) < delta)
    return df.where(near)


def mad_filter(df: DataFrame, series: list[str], volume: str, loc: str, x: str, passes: int = 3, checkpoint=lambda d: d) -> DataFrame:
    """(series, volume, score) of the volumes that stay. A score is the mean squared difference of a volume from the average of
    those that stay; in every pass all volumes are judged again, against the new average: below median + 2 * MAD they stay. Medians
    run over one score a volume."""
    kept = df.select(*series, volume).distinct()
    for _ in range(passes):
        average = df.join(kept.select(*series, volume), [*series, volume]).groupBy(*series, loc).agg(F.avg(x).alias("_a"))
        d = df.join(average, [*series, loc])
        score = checkpoint(d.groupBy(*series, volume).agg(F.avg((F.col(x) - F.col("_a")) * (F.col(x) - F.col("_a"))).alias("score")))
        m = score.groupBy(*series).agg(F.percentile("score", F.lit(0.5)).alias("_med"))
        score = score.join(m, series)
        a = score.groupBy(*series).agg(F.percentile(F.abs(F.col("score") - F.col("_med")), F.lit(0.5)).alias("_mad"))
        kept = score.join(a, series).where(F.col("score") < F.col("_med") + 2 * F.col("_mad")).drop("_med", "_mad")
    return kept


def combine_echoes(df: DataFrame, voxel: str, echo: str, te: str, y: str, cap: float = 2240.0, weighted: bool = False) -> DataFrame:
    """Echoes are used up to the first rise of the signal; T2* from a log-linear fit over them (``weighted``: each echo
    by 1 / y), capped; the weighted sum of all echoes
    with weights te * exp(-te / T2*). Fewer than two usable echoes, or no decay: the cap."""
    w = Window.partitionBy(voxel).orderBy(echo)
    d = df.withColumn("_up", F.coalesce((F.col(y) > F.lag(y).over(w)).cast("int"), F.lit(0)))
    d = d.withColumn("_use", (F.sum("_up").over(w) == 0) & (F.col(y) > 0))
    if weighted:
        w1, log = F.when(F.col("_use"), 1 / F.col(y)), F.log(F.when(F.col(y) > 0, F.col(y)))
        sw, sx, sy, sxx, sxy = (F.sum(w1 * v) for v in (F.lit(1.0), F.col(te), log, F.col(te) * F.col(te), F.col(te) * log))
        slope = F.when(F.count_if("_use") > 1, F.try_divide(sw * sxy - sx * sy, sw * sxx - sx * sx))
    else:
        slope = F.regr_slope(F.when(F.col("_use"), F.log(F.when(F.col(y) > 0, F.col(y)))), F.when(F.col("_use"), F.col(te)))
    fit = d.groupBy(voxel).agg(slope.alias("_b"), F.count_if("_use").alias("n_used"))
    t2 = F.when(F.col("_b") < 0, F.least(-1 / F.nullif("_b", F.lit(0.0)), F.lit(cap))).otherwise(F.lit(cap))
    j = d.join(fit.select(voxel, "n_used", t2.alias("t2star")), voxel)
    weight = F.col(te) * F.exp(-F.col(te) / F.col("t2star"))
    return j.groupBy(voxel).agg(F.first("t2star").alias("t2star"), F.first("n_used").alias("n_used"), F.try_divide(F.sum(weight * F.col(y)), F.sum(weight)).alias("combined"))


def direction_tensors(df: DataFrame, keys: list[str], b: str, v: str) -> DataFrame:
    """Mean of b * v v' over the volumes of a pair, as six sums."""
    c = lambda i: F.col(v)[i]
    pairs = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))
    return df.groupBy(*keys).agg(*(F.avg(F.col(b) * c(i) * c(j)).alias(f"d{i}{j}") for i, j in pairs))


def average_directions(df: DataFrame, keys: list[str], b: str, v: str) -> DataFrame:
    """Principal direction of the mean tensor (first non-zero part positive) and its b-value (largest eigenvalue; of the
    average of b-weighted unit vectors)."""
    t = direction_tensors(df, keys, b, v)

    @F.pandas_udf("struct<bval: double, bvec: array<double>>")
    def eigen(d00: pd.Series, d01: pd.Series, d02: pd.Series, d11: pd.Series, d12: pd.Series, d22: pd.Series) -> pd.DataFrame:
        m = np.stack([d00, d01, d02, d01, d11, d12, d02, d12, d22], axis=1).astype(float).reshape(-1, 3, 3)
        val, vec = np.linalg.eigh(np.nan_to_num(m))
        top = vec[:, :, 2]
        lead = np.take_along_axis(top, np.argmax(np.abs(top) > 1e-9, axis=1)[:, None], axis=1)
        return pd.DataFrame({"bval": val[:, 2], "bvec": list(top * np.where(lead < 0, -1, 1))})

    return t.withColumn("_e", eigen("d00", "d01", "d02", "d11", "d12", "d22")).select(*keys, "_e.bval", "_e.bvec")


def spectrum(df: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """(keys, freq, amplitude) of the whole demeaned series, padded with zeros to the longest of all; the first round(n / 2)
    bins. No series is cut. A series is one array; the transform is a vectorised function over arrays."""
    s = df.groupBy(*keys).agg(F.expr(f"transform(array_sort(collect_list(struct({t}, {x}))), s -> s.{x})").alias("_s"))
    longest = df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("_n"))  # one row
    s = s.crossJoin(F.broadcast(longest))

    @F.pandas_udf("array<double>")
    def amplitude(series: pd.Series, lengths: pd.Series) -> pd.Series:
        out = []
        for v, n in zip(series, lengths):
            v = np.nan_to_num(np.asarray(v, float))
            out.append(np.abs(np.fft.rfft(v - v.mean(), int(n)))[: (int(n) + 1) // 2])
        return pd.Series(out, dtype=object)

    return s.select(*keys, F.posexplode(amplitude("_s", "_n")).alias("freq", "amplitude"))


def welch_spectrum(df: DataFrame, keys: list[str], t: str, x: str, checkpoint, tail: int = 10) -> DataFrame:
    """(keys, freq, amplitude): the power of a series by eight half-overlapping Hamming segments, each padded to the whole series' length,
    one-sided and without its last bin, over the mean of its last ``tail`` bins.

    Rows are numbered by a scan and dealt to their segments (a row is in two), each of which is transformed in a task of its own;
    bins are averaged over segments. NULL values count as 0.
    """
    rows = scan(df.select(*keys, t, x), keys, [F.asc(t)], checkpoint, number="_i", total="_n")
    size = F.greatest(F.floor(F.col("_n") / 4.5), F.lit(1))
    step = size - F.floor(size / 2)
    at = F.col("_i") - 1
    first, last = F.greatest(F.ceil((at - size + 1) / step), F.lit(0)), F.least(F.floor(at / step), F.floor((F.col("_n") - size) / step))
    dealt = rows.where(first <= last).select(*keys, at.alias("_i"), "_n", F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("_x"), F.explode(F.sequence(first, last)).alias("_seg"))

    def power(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        part = part.sort_by("_i")
        v, n = part["_x"].to_numpy(), part["_n"][0].as_py()
        window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(len(v)) / max(len(v) - 1, 1))
        p = np.abs(np.fft.rfft(v * window, n)) ** 2
        p[1:] *= 2
        fixed = {k: pa.array([s.as_py()] * (len(p) - 1), s.type) for k, s in zip(keys, key)}
        return pa.table({**fixed, "freq": pa.array(range(len(p) - 1), pa.int32()), "p": p[:-1]})

    schema = StructType([*(dealt.schema[k] for k in keys), *StructType.fromDDL("freq int, p double")])
    bins = checkpoint(dealt.groupBy(*keys, "_seg").applyInArrow(power, schema).groupBy(*keys, "freq").agg(F.avg("p").alias("p")))
    top = bins.groupBy(*keys).agg(F.max("freq").alias("_top"))
    base = bins.join(top, keys).where(F.col("freq") > F.col("_top") - tail).groupBy(*keys).agg(F.avg("p").alias("_base"))
    return bins.join(base, keys).select(*keys, "freq", F.when(F.col("_base") > 0, F.col("p") / F.col("_base")).otherwise(F.col("p")).alias("amplitude"))


def bias_correct(df: DataFrame, run: list[str], x: str, factor: str, slope: Column, intercept: Column, template: str) -> DataFrame:
    """X / (factor * slope + intercept), scaled so that its median where the factor rounds to 1.0 is the template's there."""
    d = df.withColumn("_c", F.try_divide(F.col(x), F.nullif(F.col(factor) * slope + intercept, F.lit(0.0))))
    at = F.round(factor, 1) == 1.0
    m = d.groupBy(*run).agg(F.percentile(F.when(at, F.col(template)), F.lit(0.5)).alias("_mt"), F.percentile(F.when(at, F.col("_c")), F.lit(0.5)).alias("_mc"))
    return d.join(m, run).withColumn("corrected", F.col("_c") * F.try_divide("_mt", F.nullif("_mc", F.lit(0.0)))).drop("_c", "_mt", "_mc")


def template_cost(df: DataFrame, run: list[str], loc: list[str], x: str, template: str) -> DataFrame:
    """Summed relative deviation from a template of the mean, over maps, of the corrected values of a location."""
    m = df.groupBy(*run, *loc).agg(F.avg(x).alias("_x"), F.first(template).alias("_t"))
    return m.groupBy(*run).agg(F.sum(F.abs(F.try_divide(F.col("_x") - F.col("_t"), F.nullif("_t", F.lit(0.0))))).alias("cost"))


def fixed_effects(df: DataFrame, keys: list[str], cope: str, var: str) -> DataFrame:
    """Inverse-variance mean and its variance; rows without a positive variance are left out."""
    d = df.where(F.col(var) > 0)
    return d.groupBy(*keys).agg((F.sum(F.col(cope) / F.col(var)) / F.sum(1 / F.col(var))).alias("cope"), (1 / F.sum(1 / F.col(var))).alias("var"), F.count("*").alias("n"))
