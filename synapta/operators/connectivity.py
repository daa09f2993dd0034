"""Connectivity: region means, pairwise correlation, Fisher z, vectors and matrices, similarity, tissue labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions import fisher_z, nan_to_zero, pearson
from synapta.operators.tiles import column_correlations


def tissue_labels(df: DataFrame, ribbon: str, wmparc: str, gm: list[int], wm: list[int], wm_parc: list[int], csf_parc: list[int]) -> DataFrame:
    """Grey from the ribbon is 1, white 2; the parcellation's white matter overrides both; CSF (3) only where still 0."""
    base = F.when(F.col(ribbon).isin(gm), 1).when(F.col(ribbon).isin(wm), 2).otherwise(0)
    label = F.when(F.col(wmparc).isin(wm_parc), 2).when((base == 0) & F.col(wmparc).isin(csf_parc), 3).otherwise(base)
    return df.withColumn("tissue", label)


def csf_mask(df: DataFrame, keys: list[str], label: str, csf: list[int]) -> DataFrame:
    """Label 3 where a subject's labels lie in 0..3, else membership in a set. The verdict is aggregated first."""
    plain = df.groupBy(*keys).agg(F.bool_and(F.col(label).between(0, 3)).alias("_plain"))
    return df.join(plain, keys).withColumn("is_csf", F.when(F.col("_plain"), F.col(label) == 3).otherwise(F.col(label).isin(csf))).drop("_plain")


def tissue_masks(df: DataFrame, config: DataFrame, dataset: str, label: str) -> DataFrame:
    """Grey and white masks by the codes of each dataset; ``config``: dataset, gm, wm (a few rows)."""
    out = df.join(F.broadcast(config), dataset)
    return out.withColumn("is_gm", F.col(label) == F.col("gm")).withColumn("is_wm", F.col(label) == F.col("wm"))


def roi_means(voxels: DataFrame, labels: DataFrame, voxel: str, keys: list[str], x: str, mask: Column) -> DataFrame:
    """Mean over all voxels of a region, those outside the tissue counting as 0 (trap T8)."""
    return voxels.join(labels, voxel).groupBy(*keys).agg((F.sum(F.when(mask, F.col(x)).otherwise(0.0)) / F.count("*")).alias("mean"))


def pair_correlations(arrays: DataFrame, key: str, x: str, size: int) -> DataFrame:
    """(key, i, j, r) for i > j over the rows of a key, each an array of ``size`` regions. Constant regions give r NULL. Sums of
    dense tiles (see `tiles`), so the shuffle does not grow with the rows of a key."""
    return column_correlations(arrays, [key], x, size)


def with_z(edges: DataFrame) -> DataFrame:
    """R with missing values as 0, and its Fisher z."""
    return edges.withColumn("z", fisher_z(F.col("r"))).withColumn("r", nan_to_zero(F.col("r")))


def lower_index(i: Column, j: Column) -> Column:
    """Place of (i, j), i > j, in the row-major strict lower triangle."""
    return (i * (i - 1) / 2).cast("int") + j


def upper_index(i: Column, j: Column, n: int) -> Column:
    """Place of (i, j), i < j, in the row-major strict upper triangle of n regions."""
    return (i * (2 * n - i - 1) / 2).cast("int") + j - i - 1


def rectangle_index(i: Column, j: Column, m: int) -> Column:
    """Place of (i, j) in a row-major matrix of m columns."""
    return i * m + j


def dimension(length: Column) -> Column:
    """Regions of a triangle of ``length`` places; another length is an error."""
    n = ((1 + F.sqrt(1 + 8 * length)) / 2).cast("int")
    return F.when(n * (n - 1) / 2 == length, n).otherwise(F.raise_error(F.lit("not the length of a triangle")))


def rebuild(vector: DataFrame, f: str, x: str) -> DataFrame:
    """Symmetric edges (i, j, x), both directions, from places in the lower triangle."""
    i = F.floor((1 + F.sqrt(1 + 8 * F.col(f).cast("double"))) / 2).cast("int")
    one = vector.withColumn("i", i).withColumn("j", (F.col(f) - F.col("i") * (F.col("i") - 1) / 2).cast("int"))
    keep = [c for c in vector.columns if c not in (f, x)]
    return one.select(*keep, "i", "j", x).union(one.select(*keep, "j", "i", x))


def reorder(edges: DataFrame, order: DataFrame) -> DataFrame:
    """I8: regions renumbered by (old_idx, new_idx)."""
    a, b = order.select(F.col("old_idx").alias("i"), F.col("new_idx").alias("ni")), order.select(F.col("old_idx").alias("j"), F.col("new_idx").alias("nj"))
    out = edges.join(F.broadcast(a), "i").join(F.broadcast(b), "j")
    return out.drop("i", "j").withColumnsRenamed({"ni": "i", "nj": "j"})


def subject_vectors(edges: DataFrame, subject: str, f: str, x: str) -> DataFrame:
    """One array a subject, in feature order."""
    return edges.groupBy(subject).agg(F.expr(f"transform(array_sort(collect_list(struct({f}, {x}))), s -> s.{x})").alias("x"))


def merged_sets(df: DataFrame, gg: str, gw: str, ww: str) -> DataFrame:
    """GG_GW, GG_WW, GW_WW and GG_GW_WW from the three block arrays of a row."""
    pairs = {"GG_GW": (gg, gw), "GG_WW": (gg, ww), "GW_WW": (gw, ww), "GG_GW_WW": (gg, gw, ww)}
    return df.withColumns({name: F.concat(*cols) for name, cols in pairs.items()})


def group_mean(edges: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Mean over subjects, with the number of subjects (traps T25, T28)."""
    return edges.groupBy(*keys).agg(F.avg(x).alias("mean"), F.count(x).alias("n_subjects"))


def matrix_summary(edges: DataFrame, keys: list[str], x: str) -> DataFrame:
    """E13."""
    return edges.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))


def similarity(a: DataFrame, b: DataFrame, on: list[str], keys: list[str], x: str) -> DataFrame:
    """R, cells, mean absolute difference and sign agreement of two matrices, for each of ``keys``; cells that only one
    side has are an error."""
    both = a.select(*on, F.col(x).alias("_a")).join(b.select(*on, F.col(x).alias("_b")), on, "full")
    both = both.withColumn("_b", F.when(F.col("_a").isNull() != F.col("_b").isNull(), F.raise_error(F.lit("matrices differ in shape"))).otherwise(F.col("_b")))
    return both.groupBy(*keys).agg(pearson(F.col("_a"), F.col("_b")).alias("r"), F.count("*").alias("n"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("mad"), F.avg((F.signum("_a") == F.signum("_b")).cast("int")).alias("sign_agreement"))


def similarity_report(per_subject: DataFrame, r: str) -> DataFrame:
    """Spread of the subjects' r."""
    q = F.percentile(r, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return per_subject.agg(F.avg(r).alias("mean"), q[1].alias("median"), q[0].alias("q25"), q[2].alias("q75"), F.min(r).alias("min"), F.max(r).alias("max"), F.count(r).alias("n"))


def difference(a: DataFrame, b: DataFrame, on: list[str], x: str) -> DataFrame:
    """B minus a, cell by cell."""
    return a.select(*on, F.col(x).alias("_a")).join(b.select(*on, F.col(x).alias("_b")), on).select(*on, (F.col("_b") - F.col("_a")).alias("diff"))


def nearest_template(items: DataFrame, templates: DataFrame, item: str, template: str, f: str, x: str) -> DataFrame:
    """The template of the highest correlation with each item (ties: the least name). Templates are a few rows an f."""
    pairs = items.select(item, f, x).join(F.broadcast(templates.select(template, f, F.col(x).alias("_t"))), f)
    r = pairs.groupBy(item, template).agg(pearson(F.col(x), F.col("_t")).alias("r"))
    return r.withColumn("_k", F.row_number().over(Window.partitionBy(item).orderBy(F.desc_nulls_last("r"), template))).where("_k = 1").drop("_k")


def fill_grid(df: DataFrame, keys: list[str], t: str, x: str, lo: int, hi: int) -> DataFrame:
    """Each key on the whole time grid, gaps as 0, with coverage of each cell and of the whole key."""
    grid = df.select(*keys).distinct().withColumn(t, F.explode(F.sequence(F.lit(lo), F.lit(hi))))
    out = grid.join(df.select(*keys, t, x), [*keys, t], "left").withColumn("covered", F.col(x).isNotNull())
    return out.withColumn("is_full", F.bool_and("covered").over(Window.partitionBy(*keys))).withColumn(x, F.coalesce(x, F.lit(0.0)))
