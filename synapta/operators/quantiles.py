"""Exact quantiles of keys of any size: the range that holds a rank is narrowed by counts, never a key sorted in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of a key, or of a range in the end, that one task may sort.
LIMIT = 20_000
#: Parts that a range is cut into in each pass.
BINS = 512
#: Rows of a table of ranges or of a key's numbers that may be broadcast.
SMALL = 100_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """A written table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= rows else df


def exact_percentiles(df: DataFrame, keys: list[str], x: str, shares: list[float], checkpoint, limit: int = LIMIT, bins: int = BINS) -> DataFrame:
    """(keys, n, q): the quantiles of ``shares`` (0 to 1) of each key's values, interpolated between neighbours by `_between`, as an
    array. NULL and NaN are left out; keys without a value do not occur; values must be finite. Keys must not be NULL.

    Keys of up to ``limit`` values are one aggregation. For others the two ranks beside each quantile are found by counting: a pass
    counts the values of each range in ``bins`` parts (with map-side combining, all keys and ranks at once), and the part that holds a rank is
    the next range, shrunk to its least and greatest value. A range ends with equal values or with no more than ``limit``, which
    are sorted. Doubles end after a few passes; a key of a third of all rows is a few hundred counts a task.
    """
    rows = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).select(*keys, F.col(x).cast("double").alias("_x"))
    sizes = checkpoint(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    last = F.col("n") - 1

    def held(d: DataFrame) -> DataFrame:
        every = d.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("_x")).alias("_all"))  # ``limit`` at most
        return every.select(*keys, "n", _between(last, shares, lambda at: F.get("_all", at.cast("int"))))

    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= limit:
        return held(rows)
    large = checkpoint(sizes.where(F.col("n") > limit))
    tagged = small(large.select(*keys)) if keys else None
    few = held(rows.join(tagged, keys, "left_anti")) if keys else None
    rows = rows.join(tagged, keys, "left_semi") if keys else rows

    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(last * s), F.ceil(last * s)) for s in shares))))
    # rank: place among the values of the range; c: how many these are
    state = checkpoint(large.select(*keys, F.explode(ranks).alias("at"), "_lo", "_hi", F.col("n").alias("c")).withColumn("rank", F.col("at")))
    found = []
    ranged = [*keys, "_lo", "_hi"]
    while True:
        found.append(state.where("_lo = _hi").select(*keys, "at", F.col("_lo").alias("v")))
        found.append(_sorted(rows, state.where((F.col("_lo") < F.col("_hi")) & (F.col("c") <= limit)), keys, ranged))
        state = checkpoint(state.where((F.col("_lo") < F.col("_hi")) & (F.col("c") > limit)))
        if not state.count():
            break
        place = F.floor((F.col("_x") / 4 - F.col("_lo") / 4) / (F.col("_hi") / 4 - F.col("_lo") / 4) * bins)
        inside = _within(rows, state, keys, ranged).withColumn("b", F.least(place, F.lit(bins - 1)))
        parts = inside.groupBy(*ranged, "b").agg(F.count("*").alias("m"), F.min("_x").alias("l"), F.max("_x").alias("h"))
        before = F.sum("m").over(Window.partitionBy(*ranged).orderBy("b").rowsBetween(Window.unboundedPreceding, -1))  # bins rows a range
        parts = parts.withColumn("s", F.coalesce(before, F.lit(0)))
        state = state.join(parts, ranged).where("rank >= s and rank < s + m")
        state = checkpoint(state.select(*keys, "at", F.col("l").alias("_lo"), F.col("h").alias("_hi"), F.col("m").alias("c"), (F.col("rank") - F.col("s")).alias("rank")))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    values = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("_v"))  # two ranks a share
    out = large.join(values, keys) if keys else large.crossJoin(values)
    out = out.select(*keys, "n", _between(last, shares, lambda at: F.col("_v")[at]))
    return out.unionByName(few) if few is not None else out


def _between(last: Column, shares: list[float], value) -> Column:
    """The quantiles from the values of two ranks each. lo * (1 - part) + hi * part with a fused product, as DuckDB has it: a cut that is off by a
    bit stands on the other side of a value close to it."""
    out = []
    for s in shares:
        p = last * s
        lo, hi, part = value(F.floor(p)), value(F.ceil(p)), p - F.floor(p)
        mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lo, 1 - part, hi * part).cast("double")
        out.append(F.when((part == 0) | lo.isNull(), lo).otherwise(mixed))
    return F.array(*out).alias("q")


def _within(rows: DataFrame, state: DataFrame, keys: list[str], ranged: list[str]) -> DataFrame:
    """Rows with each distinct range they lie in."""
    ranges = state.select(*ranged).distinct()
    inside = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
    few = state.count() <= SMALL
    ranges = F.broadcast(ranges) if few else ranges
    return (rows.join(ranges, keys) if keys else rows.crossJoin(ranges)).where(inside)  # without keys: two ranges a share


def _sorted(rows: DataFrame, state: DataFrame, keys: list[str], ranged: list[str]) -> DataFrame:
    held = _within(rows, state, keys, ranged).groupBy(*ranged).agg(F.array_sort(F.collect_list("_x")).alias("_all"))  # ``limit`` at most
    return state.join(held, ranged).select(*keys, "at", F.get("_all", F.col("rank").cast("int")).alias("v"))
