"""Component decomposition, similarity, features and classification votes."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from synapta.functions import safe_ratio
from synapta.operators.quantiles import LIMIT, exact_percentiles, small
from synapta.operators.scans import scan
from synapta.operators.tiles import column_products


def order_and_sign(df: DataFrame, comp: str, x: str) -> DataFrame:
    """rank of each component by deviation (descending, ties by name) and the sign that makes its larger tail positive."""
    s = df.groupBy(comp).agg(F.stddev_samp(x).alias("std"), F.when(F.max(x) >= F.abs(F.min(x)), 1).otherwise(-1).alias("sign"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("std"), comp)))  # one row a component


def gram(df: DataFrame, x: str, size: int) -> DataFrame:
    """M1: sums of products of all position pairs i >= j over all rows, as dense tiles."""
    return column_products(df, [], x, size)


def _leading(w: np.ndarray, rank: int) -> np.ndarray:
    """The ``rank`` leading directions of the rows of w, each scaled by its singular value, the larger tail positive."""
    val, vec = np.linalg.eigh(w @ w.T)
    out = vec[:, ::-1][:, :rank].T @ w
    return out * np.where(out.max(axis=1) >= -out.min(axis=1), 1.0, -1.0)[:, None]


def _rows_of(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(lists) and set(pc.unique(pc.list_value_length(lists)).to_pylist()) != {size}:
        raise ValueError(f"an array is not of length {size}")
    return np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(-1, size)


def _block(number: int, w: np.ndarray) -> pa.RecordBatch:
    n = len(w)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array(range(n), pa.int32()), lists], names=["block", "comp", "v"])


BLOCK = "block int, comp int, v array<double>"


def _merge(size: int, internal: int):
    """Blocks of directions that share a number, as one block of at most ``internal``."""

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        w = _rows_of(t.sort_by([("block", "ascending"), ("comp", "ascending")]).column("v"), size)
        return pa.Table.from_batches([_block(int(key[0].as_py()), _leading(w, internal))])

    return merge


def _reduced(df: DataFrame, x: str, size: int, internal: int, fan: int, checkpoint) -> DataFrame:
    """All rows of ``df`` as one block of directions."""

    def local(batches):
        w = np.zeros((0, size))
        for b in batches:
            rows = _rows_of(b.column(0), size)
            for lo in range(0, len(rows), internal):
                w = np.concatenate([w, rows[lo : lo + internal]])
                if len(w) >= 2 * internal:
                    w = _leading(w, internal)
        if len(w):
            yield _block(TaskContext.get().partitionId(), _leading(w, internal))

    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("v"))
    blocks = checkpoint(rows.mapInArrow(local, BLOCK))
    last = blocks.agg(F.max("block")).first()[0] or 0
    while last:
        blocks = checkpoint(blocks.groupBy((F.col("block") / fan).cast("int").alias("into")).applyInArrow(_merge(size, internal), BLOCK))
        last //= fan
    return blocks


def _components(block: DataFrame, rank: int) -> DataFrame:
    square = F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)
    return block.where(F.col("comp") < rank).select("comp", F.posexplode("v").alias("i", "value"), square.alias("eigenvalue"))


def merged_pca(df: DataFrame, x: str, size: int, internal: int, rank: int, fan: int = 4, checkpoint=lambda d: d) -> DataFrame:
    """M1: incremental PCA with a bounded internal rank. (comp, i, value, eigenvalue): the first ``rank`` components over ``size`` positions,
    scaled by their singular values.

    Each task adds its rows to a block and reduces it to ``internal`` directions whenever it holds twice as many; blocks are merged
    ``fan`` at a time, in as many rounds as their number asks for, so a task holds at most fan * internal rows of any input. Exact up to
    directions below the internal rank, whatever the partitions. ``checkpoint`` keeps each round, from which a lost job goes on. NULL
    elements count as 0, NULL arrays are left out, arrays of another length are an error, and no rows give none.
    """
    return _components(_reduced(df, x, size, internal, fan, checkpoint), rank)


MANIFEST = "step int, batch string, n_batches int, batches string, size int, internal int"


def resumable_pca(df: DataFrame, batch: str, x: str, size: int, internal: int, rank: int, path: str, checkpoint, fan: int = 4, most: int | None = None) -> DataFrame:
    """M1, with a state that outlives the application: `merged_pca` batch by batch (subjects or groups of them, in order of ``batch``), the
    block so far and a manifest row committed below ``path`` after each.

    A run goes on after the last committed batch. The manifest holds what changes the result (a digest of all batches in order, size, internal rank); a
    run with others is refused. A block is written before its manifest row, so a block without one was cut short and is written again;
    only the newest block is read. ``most``: batches of this run at most. NULL batches are an error; otherwise as `merged_pca`.
    """
    spark = df.sparkSession
    name = F.when(F.col(batch).isNull(), F.raise_error(F.lit("a row without a batch"))).otherwise(F.col(batch).cast("string"))
    rows = df.select(name.alias("_batch"), F.col(x).alias("_x"))
    names = sorted(r[0] for r in rows.select("_batch").distinct().collect())  # one short name a batch
    asked = (len(names), hashlib.sha256("\n".join(names).encode()).hexdigest(), size, internal)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    done = -1
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        for r in spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{path}/manifest").collect():  # one row a batch
            if (r.n_batches, r.batches, r.size, r.internal) != asked:
                raise ValueError("the state was made from other batches or parameters; take another path")
            done = max(done, r.step)
    stop = len(names) if most is None else min(len(names), done + 1 + most)
    for step in range(done + 1, stop):
        block = _reduced(rows.where(F.col("_batch") == names[step]), "_x", size, internal, fan, checkpoint)
        if step:
            block = spark.read.schema(BLOCK).parquet(f"{path}/blocks/{step - 1}").union(block.withColumn("block", F.lit(1)))
            block = block.groupBy((F.col("block") * 0).alias("into")).applyInArrow(_merge(size, internal), BLOCK)
        block.write.mode("overwrite").parquet(f"{path}/blocks/{step}")
        fact = spark.createDataFrame([(step, names[step], *asked)], MANIFEST)
        fact.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/{step}")
    if not stop:
        return _components(spark.createDataFrame([], BLOCK), rank)
    return _components(spark.read.schema(BLOCK).parquet(f"{path}/blocks/{stop - 1}"), rank)


def directions(components: DataFrame) -> DataFrame:
    """(comp, i, value, eigenvalue) of unit length from `merged_pca`."""
    return components.withColumn("value", F.try_divide("value", F.nullif(F.sqrt("eigenvalue"), F.lit(0.0))))


def effective_rank(components: DataFrame, share: float = 0.1) -> DataFrame:
    """M8: one row, the number of singular values above a share of their deviation. ``components``: `merged_pca` with all directions
    that it keeps; the values are one short row a component."""
    s = components.where("i = 0").select(F.sqrt(F.greatest("eigenvalue", F.lit(0.0))).alias("s"))
    cut = s.agg((share * F.stddev_samp("s")).alias("cut"))
    return s.crossJoin(F.broadcast(cut)).agg(F.count_if(F.col("s") > F.col("cut")).cast("int").alias("effective_rank"))


def noise_deviation(df: DataFrame, x: str, vectors: DataFrame) -> DataFrame:
    """M9: deviation over rows of each position after taking out the leading vectors (a few rows, broadcast)."""
    v = vectors.groupBy("comp").agg(F.expr("transform(array_sort(collect_list(struct(i, value))), s -> s.value)").alias("v"))
    all_v = v.agg(F.collect_list("v").alias("_vs"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, y: s + y)
    d = df.crossJoin(F.broadcast(all_v)).withColumn("_coef", F.transform("_vs", lambda w: dot(w, F.col(x))))
    fit = F.aggregate(F.arrays_zip("_vs", "_coef"), F.transform(x, lambda y: F.lit(0.0)), lambda acc, z: F.zip_with(acc, z["_vs"], lambda p, q: p + z["_coef"] * q))
    r = d.withColumn("_r", F.zip_with(x, fit, lambda a, b: a - b))
    return r.select(F.posexplode("_r").alias("i", "r")).groupBy("i").agg(F.stddev_samp("r").alias("noise_std"))


def eta_squared(a: DataFrame, b: DataFrame, a_key: str, b_key: str, loc: str, x: str) -> DataFrame:
    """M2: 1 - within / total sum of squares of each pair of maps (trap T20). One set of maps is small and broadcast by the caller."""
    p = a.select(a_key, loc, F.col(x).alias("_a")).join(b.select(b_key, loc, F.col(x).alias("_b")), loc)
    s = p.groupBy(a_key, b_key).agg(F.sum(F.pow(F.col("_a") - F.col("_b"), F.lit(2))).alias("_d"), F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"), F.sum(F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")).alias("_q"), F.count("*").alias("_n"))
    total = F.col("_q") - F.pow(F.col("_sa") + F.col("_sb"), F.lit(2)) / (2 * F.col("_n"))
    return s.select(a_key, b_key, (1 - F.try_divide(F.col("_d") / 2, F.nullif(total, F.lit(0.0)))).alias("eta2"))


def cosine_pairs(df: DataFrame, item: str, loc: str, x: str) -> DataFrame:
    """M3: absolute cosine of each pair of estimates, a < b. Estimates number a few hundred (components times runs)."""
    n = df.groupBy(item).agg(F.sqrt(F.sum(F.col(x) * F.col(x))).alias("_n"))
    u = df.join(n, item).select(item, loc, F.try_divide(x, F.nullif("_n", F.lit(0.0))).alias("_u"))
    p = u.alias("p").join(u.alias("q"), (F.col(f"p.{loc}") == F.col(f"q.{loc}")) & (F.col(f"p.{item}") < F.col(f"q.{item}")))
    return p.groupBy(F.col(f"p.{item}").alias("a"), F.col(f"q.{item}").alias("b")).agg(F.abs(F.sum(F.col("p._u") * F.col("q._u"))).alias("sim"))


def cluster_statistics(sim: DataFrame, labels: DataFrame, item: str, label: str) -> DataFrame:
    """M4, M5: least, mean, largest and sum of similarities within and between clusters, and the stability index (mean within less
    mean between). ``sim``: a, b, sim for unordered pairs."""
    both = sim.union(sim.select("b", "a", "sim"))
    la, lb = labels.select(F.col(item).alias("a"), F.col(label).alias("cluster")), labels.select(F.col(item).alias("b"), F.col(label).alias("_other"))
    d = both.join(F.broadcast(la), "a").join(F.broadcast(lb), "b")
    inside, v = F.col("cluster") == F.col("_other"), F.col("sim")
    aggs = []
    for name, rule in (("within", inside), ("between", ~inside)):
        x = F.when(rule, v)
        aggs += [F.min(x).alias(f"{name}_min"), F.avg(x).alias(f"{name}_mean"), F.max(x).alias(f"{name}_max"), F.sum(x).alias(f"{name}_sum")]
    return d.groupBy("cluster").agg(*aggs).withColumn("iq", F.col("within_mean") - F.col("between_mean"))


def r_index(sim: DataFrame, labels: DataFrame, item: str, label: str) -> DataFrame:
    """M6: mean over clusters of within distance / distance to the nearest other cluster (1 - similarity); NULL with a singleton."""
    both = sim.union(sim.select("b", "a", "sim"))
    la, lb = labels.select(F.col(item).alias("a"), F.col(label).alias("ca")), labels.select(F.col(item).alias("b"), F.col(label).alias("cb"))
    d = both.join(F.broadcast(la), "a").join(F.broadcast(lb), "b").groupBy("ca", "cb").agg(F.avg(1 - F.col("sim")).alias("dist"))
    c = d.groupBy("ca").agg(F.max(F.when(F.col("ca") == F.col("cb"), F.col("dist"))).alias("_in"), F.min(F.when(F.col("ca") != F.col("cb"), F.col("dist"))).alias("_out"))
    singles = labels.groupBy(label).count().agg(F.min("count").alias("_least"))
    r = c.agg(F.avg(F.try_divide("_in", "_out")).alias("_r")).crossJoin(singles)
    return r.select(F.when(F.col("_least") > 1, F.col("_r")).alias("r_index"))


def centrotypes(sim: DataFrame, labels: DataFrame, item: str, label: str) -> DataFrame:
    """M7: the member of the largest summed similarity to its cluster (ties: the least member)."""
    both = sim.union(sim.select("b", "a", "sim"))
    la, lb = labels.select(F.col(item).alias("a"), F.col(label).alias("cluster")), labels.select(F.col(item).alias("b"), F.col(label).alias("_c"))
    s = both.join(F.broadcast(la), "a").join(F.broadcast(lb), "b").where("cluster = _c").groupBy("cluster", "a").agg(F.sum("sim").alias("s"))
    return s.groupBy("cluster").agg(F.max_by("a", F.struct(F.round("s", 9), -F.col("a"))).alias("centrotype"), F.max("s").alias("sum_sim"))


def mask_ratios(df: DataFrame, masks: DataFrame, comp: list[str], loc: str, x: str, pairs: list[tuple[str, str]], mean: bool = False) -> DataFrame:
    """Summed (or mean) absolute weight in one mask over another, for each listed pair. An empty denominator: NULL; 0/0: 0."""
    agg = F.avg if mean else F.sum
    names = sorted({m for p in pairs for m in p})
    s = df.join(masks, loc).groupBy(*comp).agg(*(F.coalesce(agg(F.when(F.col("mask") == m, F.abs(x))), F.lit(0.0)).alias(f"_{m}") for m in names))
    return s.select(*comp, *(safe_ratio(F.col(f"_{a}"), F.col(f"_{b}")).alias(f"{a}_over_{b}") for a, b in pairs))


def band_power(df: DataFrame, comp: list[str], freq: str, power: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Power of one band over another."""
    part = lambda b: F.coalesce(F.sum(F.when((F.col(freq) >= b[0]) & (F.col(freq) < b[1]), F.col(power))), F.lit(0.0))
    return df.groupBy(*comp).agg(safe_ratio(part(low), part(high)).alias("band_ratio"))


def noisy_points_ratio(df: DataFrame, comp: list[str], t: str, x: str, noise: str, checkpoint, share: float = 0.125, limit: int = LIMIT) -> DataFrame:
    """Summed absolute value at the noisiest share of time points over that at all."""
    cut = checkpoint(exact_percentiles(df, comp, noise, [1 - share], checkpoint, limit).select(*comp, F.col("q")[0].alias("_cut")))
    noisy = F.col(noise) > F.col("_cut")
    return df.join(small(cut), comp).groupBy(*comp).agg(safe_ratio(F.coalesce(F.sum(F.when(noisy, F.abs(x))), F.lit(0.0)), F.sum(F.abs(x))).alias("noisy_ratio"))


def mark_outliers(df: DataFrame, keys: list[str], x: str, tie: str, checkpoint, out: str = "outlier", limit: int = LIMIT) -> DataFrame:
    """Beyond 3 * 1.4826 * MAD of the median and among the extreme floor((n + 9) / 20) at either end, ties by ``tie``. Medians are found by
    counts and places by a scan over ranges, so a key may hold any share of the rows. Rows without a value are no outliers."""
    med = checkpoint(exact_percentiles(df, keys, x, [0.5], checkpoint, limit).select(*keys, "n", F.col("q")[0].alias("_med")))
    d = df.where(F.col(x).isNotNull()).join(small(med), keys).withColumn("_far", F.abs(F.col(x) - F.col("_med")))
    mad = checkpoint(exact_percentiles(d, keys, "_far", [0.5], checkpoint, limit).select(*keys, F.col("q")[0].alias("_mad")))
    placed = scan(d.withColumnRenamed("n", "_n_all"), keys, [F.asc(x), F.asc(tie)], checkpoint, number="_lo").join(small(mad), keys)
    cut = F.floor((F.col("_n_all") + 9) / 20)
    tail = (F.col("_lo") <= cut) | (F.col("_n_all") - F.col("_lo") + 1 <= cut)
    marked = placed.withColumn(out, (F.col("_far") > 3 * 1.4826 * F.col("_mad")) & tail).drop("_med", "_mad", "_far", "_n_all", "_lo")
    return marked.unionByName(df.where(F.col(x).isNull()).withColumn(out, F.lit(False)))


def outlier_influence(df: DataFrame, keys: list[str], x: str, tie: str, checkpoint, limit: int = LIMIT) -> DataFrame:
    """Mean, deviation, share of outliers, share of absolute mass, and 1 - std(inliers) / std(all)."""
    d = mark_outliers(df, keys, x, tie, checkpoint, limit=limit)
    s = d.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg(F.col("outlier").cast("int")).alias("outlier_share"), F.stddev_samp(F.when(~F.col("outlier"), F.col(x))).alias("_in"), F.sum(F.abs(x)).alias("_mass"))
    return s.select(*keys, "mean", "std", "outlier_share", (1 - F.try_divide("_in", F.nullif("std", F.lit(0.0)))).alias("influence"), F.try_divide("_mass", F.sum("_mass").over(Window.partitionBy(F.lit(1)))).alias("mass_share"))


def series_statistics(df: DataFrame, keys: list[str], t: str, x: str, checkpoint, order: int = 8) -> DataFrame:
    """Largest absolute value, mean, deviation, kurtosis (3 for a normal series), 1 - std(inliers) / std(all), the AR(1) and
    both AR(2) coefficients as those of the prediction polynomial (1, a1, a2, ...), so with the sign turned against the regression on
    the past, the prediction error of Yule-Walker models of order 1 to ``order``, and the line of these errors over the order. Autocovariances are lagged sums;
    Levinson's recursion runs on the few of a row."""
    w = Window.partitionBy(*keys).orderBy(t)
    d = mark_outliers(df, keys, x, t, checkpoint).withColumn("_c", F.col(x) - F.avg(x).over(Window.partitionBy(*keys)))
    lags = {f"_l{k}": F.lag("_c", k).over(w) for k in range(1, order + 1)}
    d = d.withColumns(lags)
    kept = (1 - F.try_divide(F.stddev_samp(F.when(~F.col("outlier"), F.col(x))), F.nullif(F.stddev_samp(x), F.lit(0.0)))).alias("influence")
    s = d.groupBy(*keys).agg(F.max(F.abs(x)).alias("max_abs"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (F.kurtosis(x) + 3).alias("kurtosis"), kept, F.array(F.avg(F.col("_c") * F.col("_c")), *(F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)) / F.count("*") for k in range(1, order + 1))).alias("_r"))
    r = lambda k: F.col("_r")[k]
    square = F.nullif(r(0) * r(0) - r(1) * r(1), F.lit(0.0))
    ar1 = -F.try_divide(r(1), F.nullif(r(0), F.lit(0.0)))
    ar2 = F.array(-F.try_divide(r(1) * (r(0) - r(2)), square), -F.try_divide(r(2) * r(0) - r(1) * r(1), square))

    @F.pandas_udf("array<double>")
    def errors(rs: pd.Series) -> pd.Series:
        out = []
        for v in rs:
            v = np.asarray(v, float)
            e, a, errs = v[0], np.zeros(0), []
            for k in range(1, order + 1):
                g = (v[k] - (a @ v[k - 1 : 0 : -1] if k > 1 else 0)) / e if e > 0 else 0.0
                a = np.concatenate([a - g * a[::-1], [g]])
                e = max(e * (1 - g * g), 0.0)
                errs.append(e)
            out.append(errs)
        return pd.Series(out, dtype=object)

    s = s.select(*keys, "max_abs", "mean", "std", "kurtosis", "influence", ar1.alias("ar1"), ar2.alias("ar2"), errors("_r").alias("yw_error"))
    total = F.aggregate("yw_error", F.lit(0.0), lambda a, e: a + e)
    along = F.aggregate(F.zip_with("yw_error", F.sequence(F.lit(1), F.lit(order)), lambda e, k: e * k), F.lit(0.0), lambda a, e: a + e)
    mid, spread = (order + 1) / 2, order * (order * order - 1) / 12
    slope = (along - mid * total) / spread
    return s.withColumn("yw_slope", slope).withColumn("yw_offset", total / order - F.col("yw_slope") * mid)


#: Time points of a piece of a series, at least.
PIECE = 4096


def lag_correlations(df: DataFrame, keys: list[str], t: str, x: str, y: str, lags: int, piece: int = PIECE) -> DataFrame:
    """correlation of x(t + lag) and y(t) for each lag of -lags to lags, both demeaned, zero where a series has no point, over the root of
    the product of both sums of squares. Lags without a pair of points are left out; NULL values count as 0; t is an integer.

    A series is cut into pieces of y with the x within ``lags`` of them, so that a row goes to one piece, or two near an end. A
    task transforms a piece (all its lags at once) and gives one sum a lag; pieces are summed.
    """
    piece = max(piece, 4 * lags)
    m = df.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.sqrt(F.var_pop(x) * F.var_pop(y)) * F.count("*")).alias("_d"))
    d = df.join(m, keys) if keys else df.crossJoin(F.broadcast(m))  # one row
    near = F.explode(F.sequence(F.floor((F.col(t) - lags) / piece), F.floor((F.col(t) + lags) / piece)))
    d = d.select(*keys, F.col(t).cast("bigint").alias("_t"), F.coalesce(F.col(x) - F.col("_mx"), F.lit(0.0)).alias("_x"), F.coalesce(F.col(y) - F.col("_my"), F.lit(0.0)).alias("_y"), near.alias("_p"))
    size = 1 << (piece + 2 * lags - 1).bit_length()

    def transformed(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        at, vx, vy = (rows[c].to_numpy() for c in ("_t", "_x", "_y"))
        at = at - key[-1].as_py() * piece
        own = (at >= 0) & (at < piece)
        a, b, c, e = (np.zeros(size) for _ in range(4))
        np.add.at(a, at + lags, vx), np.add.at(b, at[own], vy[own])
        np.add.at(c, at + lags, 1.0), np.add.at(e, at[own], 1.0)
        product = lambda u, v: np.fft.irfft(np.fft.rfft(u) * np.conj(np.fft.rfft(v)), size)[: 2 * lags + 1]
        n = 2 * lags + 1
        fixed = {k: pa.array([v.as_py()] * n, v.type) for k, v in zip(keys, key)}
        return pa.table({**fixed, "lag": pa.array(range(-lags, lags + 1), pa.int32()), "_s": product(a, b), "_n": np.rint(product(c, e)).astype(np.int64)})

    schema = StructType([*(d.schema[k] for k in keys), *StructType.fromDDL("lag int, _s double, _n bigint")])
    s = d.groupBy(*keys, "_p").applyInArrow(transformed, schema).groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")).where("_n > 0")
    s = s.join(m, keys) if keys else s.crossJoin(F.broadcast(m))
    return s.select(*keys, "lag", F.coalesce(F.try_divide("_s", F.nullif("_d", F.lit(0.0))), F.lit(0.0)).alias("xcorr"))


def lag_symmetry(xc: DataFrame, keys: list[str], parcel: str, windows: tuple[int, ...] = (5, 50, 100, 200, 400)) -> DataFrame:
    """For each window of lags abs(2 * eta squared - 1) of the lag correlations of all parcels and their mirror image, and the line
    over the windows. ``xc``: lag_correlations up to the largest window; lags without a row count as 0."""
    d = xc.join(xc.select(*keys, parcel, (-F.col("lag")).alias("lag"), F.col("xcorr").alias("_m")), [*keys, parcel, "lag"], "full")
    d = d.select(*keys, parcel, "lag", F.coalesce("xcorr", F.lit(0.0)).alias("_p"), F.coalesce("_m", F.lit(0.0)).alias("_m"))
    d = d.withColumn("window", F.explode(F.array(*map(F.lit, windows)))).where("abs(lag) <= window")
    n = (2 * F.col("window") + 1) * F.col("_parcels")
    parcels = xc.groupBy(*keys).agg(F.count_distinct(parcel).alias("_parcels"))
    sums = d.groupBy(*keys, "window").agg(F.sum(F.pow(F.col("_p") - F.col("_m"), F.lit(2))).alias("_d"), F.sum(F.col("_p") * F.col("_p") + F.col("_m") * F.col("_m")).alias("_q"), F.sum(F.col("_p") + F.col("_m")).alias("_l"))
    eta = 1 - F.try_divide(F.col("_d") / 2, F.nullif(F.col("_q") - F.col("_l") * F.col("_l") / (2 * n), F.lit(0.0)))
    e = (sums.join(parcels, keys) if keys else sums.crossJoin(parcels)).withColumn("symmetry", F.abs(2 * eta - 1))
    line = e.groupBy(*keys).agg(F.regr_slope(F.col("symmetry"), F.col("window")).alias("slope"), F.regr_intercept(F.col("symmetry"), F.col("window")).alias("intercept"))
    e = e.select(*keys, "window", "symmetry")
    return e.join(line, keys) if keys else e.crossJoin(line)


def complexity(df: DataFrame, keys: list[str], t: str, x: str) -> DataFrame:
    """F16: root of the summed squared differences."""
    d = df.withColumn("_d", F.col(x) - F.lag(x).over(Window.partitionBy(*keys).orderBy(t)))
    return d.groupBy(*keys).agg(F.sqrt(F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0))).alias("complexity"))


class _Least:
    """Least values of a series over ranges of 1, 2, 4, ... points: the nearest point at or below a level in log(n) steps."""

    def __init__(self, v: np.ndarray):
        self.levels = [v]
        while len(self.levels[-1]) > 1:
            a = self.levels[-1]
            self.levels.append(np.minimum(a[::2], np.append(a[1::2], np.inf if len(a) % 2 else [])))

    def last(self, i: int, level: float) -> int:
        """The last point before i that is at or below the level, or -1."""
        k = 0
        while i > 0:
            if i & 1 and self.levels[k][i - 1] <= level:
                i -= 1
                break
            i >>= 1
            k += 1
        else:
            return -1
        while k:
            k -= 1
            i = 2 * i + (2 * i + 1 < len(self.levels[k]) and self.levels[k][2 * i + 1] <= level)
        return i

    def between(self, lo: int, hi: int) -> float:
        """The least value of points lo to hi (inclusive)."""
        k, least, hi = 0, np.inf, hi + 1
        while lo < hi:
            if lo & 1:
                least, lo = min(least, self.levels[k][lo]), lo + 1
            if hi & 1:
                hi -= 1
                least = min(least, self.levels[k][hi])
            lo, hi, k = lo >> 1, hi >> 1, k + 1
        return least


def peak_table(v: np.ndarray, height: float, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights and widths of the local maxima of at least ``height``, more than ``distance`` apart (the highest first). A width is taken
    at half the prominence, between linear crossings. Kept peaks are an ordered list, searches go through `_Least`: n log n."""
    n = len(v)
    change = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if n else np.zeros(0, int)  # the first point of each plateau
    u = v[change]
    top = change[1:-1][(u[1:-1] > u[:-2]) & (u[1:-1] > u[2:])] if len(u) > 2 else np.zeros(0, int)
    top = top[v[top] >= height]
    kept: list[int] = []
    for i in top[np.lexsort((top, -v[top]))].tolist():
        at = bisect.bisect_left(kept, i)
        if (not at or i - kept[at - 1] > distance) and (at == len(kept) or kept[at] - i > distance):
            kept.insert(at, i)
    if not kept:
        return np.zeros(0), np.zeros(0)
    least, back = _Least(v), _Least(v[::-1])
    most, most_back = _Least(-v), _Least(-v[::-1])
    widths = []
    for i in kept:
        above = np.nextafter(-v[i], -np.inf)  # strictly higher
        lo, hi = most.last(i, above), n - 1 - most_back.last(n - 1 - i, above)
        level = v[i] - (v[i] - max(least.between(max(lo, 0), i), least.between(i, min(hi, n - 1)))) / 2
        a, b = least.last(i, level), n - 1 - back.last(n - 1 - i, level)
        widths.append(b - (level - v[b]) / (v[b - 1] - v[b]) - (a + (level - v[a]) / (v[a + 1] - v[a])))
    return v[kept], np.array(widths)


def peaks(df: DataFrame, keys: list[str], t: str, x: str, factor: float = 1.0, distance: int = 100, heights: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """(keys, height, n_peaks, mean_height, sum_area, mean_area) for each least height times ``factor``: the mean height of the
    peaks, and the sum and mean of height times width; zeros without a peak. A key is one series of bounded length."""
    s = df.groupBy(*keys).agg(F.expr(f"transform(array_sort(collect_list(struct({t}, {x}))), s -> cast(s.{x} as double))").alias("_s"))

    @F.pandas_udf("array<struct<height: double, n_peaks: int, mean_height: double, sum_area: double, mean_area: double>>")
    def found(series: pd.Series) -> pd.Series:
        out = []
        for v in series:
            v, rows = np.nan_to_num(np.asarray(v, float)), []
            for h in heights:
                p, w = peak_table(v, h * factor, distance)
                area = p * w
                rows.append((h, len(p), float(p.mean()), float(area.sum()), float(area.mean())) if len(p) else (h, 0, 0.0, 0.0, 0.0))
            out.append([dict(zip(("height", "n_peaks", "mean_height", "sum_area", "mean_area"), row)) for row in rows])
        return pd.Series(out, dtype=object)

    return s.select(*keys, F.inline(found("_s")))


def signal_covariance(df: DataFrame, keys: list[str], x: str, g: str) -> DataFrame:
    """Absolute covariance with the global signal, and variance."""
    return df.groupBy(*keys).agg(F.abs(F.covar_samp(x, g)).alias("gs_cov"), F.var_samp(x).alias("var"))


def polarity(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """2 * max(share positive, share negative) - 1, among non-zero values."""
    n = F.nullif(F.count_if(F.col(x) != 0), F.lit(0))
    return df.groupBy(*keys).agg((2 * F.try_divide(F.greatest(F.count_if(F.col(x) > 0), F.count_if(F.col(x) < 0)), n) - 1).alias("polarity"))


def high_dvars_share(df: DataFrame, keys: list[str], x: str, dvars: str, limit: float) -> DataFrame:
    """Variance at time points of high DVARS over the whole variance."""
    return df.groupBy(*keys).agg(safe_ratio(F.coalesce(F.var_samp(F.when(F.abs(dvars) > limit, F.col(x))), F.lit(0.0)), F.var_samp(x)).alias("share"))


def scaled_spectrum(df: DataFrame, comp: str, freq: str, x: str) -> DataFrame:
    """By the component's largest value, and as z across components at each frequency."""
    wc, wf = Window.partitionBy(comp), Window.partitionBy(freq)
    return df.withColumn("by_max", F.try_divide(F.col(x), F.nullif(F.max(x).over(wc), F.lit(0.0)))).withColumn("z", F.coalesce(F.try_divide(F.col(x) - F.avg(x).over(wf), F.nullif(F.stddev_samp(x).over(wf), F.lit(0.0))), F.lit(0.0)))


def spline_fill(t: np.ndarray, v: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """v with the marked points taken from a cubic spline through the others: second derivatives from one banded solve, the third
    derivative the same on both sides of the second and of the last but one knot (so of two or three knots a line or parabola), carried on
    beyond the ends. Without another point nothing is filled."""
    keep = ~gone
    x, y, at = t[keep], v[keep], t[gone]
    out, n = v.copy(), len(x)
    if not len(at) or not n:
        return out
    if n < 4:
        scale = max(float(np.ptp(x)), 1.0)
        out[gone] = np.polyval(np.polyfit((x - x[0]) / scale, y, n - 1), (at - x[0]) / scale)
        return out
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    # rows of a tridiagonal system for the second derivatives of the inner knots, the outer ones expressed by them
    low, mid, up, rhs = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy(), 6 * np.diff(d)
    a, b = h[0] / h[1], h[-1] / h[-2]
    mid[0], up[0] = mid[0] + low[0] * (1 + a), up[0] - low[0] * a
    mid[-1], low[-1] = mid[-1] + up[-1] * (1 + b), low[-1] - up[-1] * b
    m = np.zeros(n)
    m[1:-1] = _tridiagonal(low, mid, up, rhs)
    m[0], m[-1] = m[1] + a * (m[1] - m[2]), m[-2] + b * (m[-2] - m[-3])
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    s, w = at - x[i], x[i + 1] - x[i]
    out[gone] = y[i] + s * (d[i] - w * (2 * m[i] + m[i + 1]) / 6 + s * (m[i] / 2 + s * (m[i + 1] - m[i]) / (6 * w)))
    return out


def _tridiagonal(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Forward elimination and substitution back."""
    n = len(rhs)
    c, r = [0.0] * n, [0.0] * n
    last = prior = 0.0
    for i, (lo, di, hi, b) in enumerate(zip(low.tolist(), mid.tolist(), up.tolist(), rhs.tolist())):
        pivot = di - (lo * last if i else 0.0)
        last, prior = hi / pivot, (b - (lo * prior if i else 0.0)) / pivot
        c[i], r[i] = last, prior
    for i in range(n - 2, -1, -1):
        r[i] -= c[i] * r[i + 1]
    return np.array(r)


def outlier_fill_distance(df: DataFrame, keys: list[str], t: str, x: str, checkpoint) -> DataFrame:
    """Root of the summed squares of a series minus itself with its outliers filled by a cubic spline of the other points (see
    spline_fill). Outliers are marked by scans; the spline of a key takes its points in one task, 17 bytes each."""
    d = mark_outliers(df, keys, x, t, checkpoint).where(F.col(x).isNotNull()).select(*keys, F.col(t).cast("double").alias("_t"), F.col(x).cast("double").alias("_x"), "outlier")

    def distance(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_t")
        at, v, gone = (rows[c].to_numpy() for c in ("_t", "_x", "outlier"))
        e = v - spline_fill(at, v, gone.astype(bool))
        return pa.table({**{k: pa.array([s.as_py()], s.type) for k, s in zip(keys, key)}, "distance": pa.array([float(np.sqrt(e @ e))])})

    schema = StructType([*(d.schema[k] for k in keys), StructField("distance", DoubleType())])
    return d.groupBy(*keys).applyInArrow(distance, schema)


def votes(df: DataFrame, comp: list[str], model: str, prob: str, baseline: str, threshold: float, needed: int) -> DataFrame:
    """Components for which at least ``needed`` models disagree with the baseline class."""
    other = (F.col(prob) >= threshold) != (F.col(baseline) >= threshold)
    return df.groupBy(*comp).agg(F.count_if(other).alias("n_votes"), F.first(F.col(baseline) >= threshold).alias("was_signal")).withColumn("reclassify", F.col("n_votes") >= needed)


def reclassified(lists: DataFrame, comp: list[str]) -> DataFrame:
    """H5, H6: (comp, is_signal) from lists (signal, noise, as_signal, as_noise). A component that is re-classed both ways, or stands
    in neither or both original lists, is an error; the noise list is the complement of the signal."""
    has = lambda k: F.bool_or(F.col("list") == k)
    g = lists.groupBy(*comp).agg(has("signal").alias("s"), has("noise").alias("n"), has("as_signal").alias("ts"), has("as_noise").alias("tn"))
    bad = (F.col("s") == F.col("n")) | (F.col("ts") & F.col("tn"))
    return g.select(*comp, F.when(bad, F.raise_error(F.lit("inconsistent component lists"))).otherwise((F.col("s") & ~F.col("tn")) | F.col("ts")).alias("is_signal"))


def boosted_trees(x: np.ndarray, y: np.ndarray, depth: int, iterations: int, step: float, subsample: float, seed: int, bins: int = 32, ridge: float = 1.0) -> tuple[np.ndarray, ...]:
    """Gradient-boosted trees for the logistic loss: (feature, threshold) of each inner node and the value of each leaf, by tree.

    Full trees by levels; the children of node i are 2 i + 1 (x up to the threshold) and 2 i + 2. Splits are sought among ``bins``
    quantiles of each feature, by sums of first and second derivatives with an L2 penalty; a node without a gain sends all rows left.
    """
    rng, (n, p), inner = np.random.default_rng(seed), x.shape, (1 << depth) - 1
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0)  # bins - 1 by features
    code = np.array([np.searchsorted(edges[:, f], x[:, f]) for f in range(p)]).T  # x <= edge k if code <= k
    cell = np.arange(p) * bins + code
    feature, threshold, leaf = np.zeros((iterations, inner), np.int32), np.full((iterations, inner), np.inf), np.zeros((iterations, inner + 1))
    raw = np.zeros(n)
    for it in range(iterations):
        prob = 1 / (1 + np.exp(-raw))
        used = rng.random(n) < subsample
        g, h = np.where(used, prob - y, 0.0), np.where(used, prob * (1 - prob), 0.0)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (p * bins) + cell).ravel()
            left = [np.bincount(at, np.repeat(v, p), width * p * bins).reshape(width, p, bins).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = left, (v[:, :1, -1:] for v in left)
            gain = (gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge))[:, :, :-1].reshape(width, -1)
            best = gain.argmax(1)
            found = gain[np.arange(width), best] > 1e-9
            f, k = best // (bins - 1), best % (bins - 1)
            feature[it, first : first + width] = f
            threshold[it, first : first + width] = np.where(found, edges[k, f], np.inf)
            of = node - first
            node = 2 * node + 1 + (found[of] & (code[np.arange(n), f[of]] > k[of]))
        of = node - inner
        leaf[it] = -step * np.bincount(of, g, inner + 1) / (np.bincount(of, h, inner + 1) + ridge)
        raw += leaf[it, of]
    return feature, threshold, leaf


def boosted_probability(model: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    feature, threshold, leaf = model
    rows, raw = np.arange(len(x)), np.zeros(len(x))
    for f, t, v in zip(feature, threshold, leaf):
        node = np.zeros(len(x), np.int64)
        while len(node) and node[0] < len(f):  # all rows are on one level
            node = 2 * node + 1 + (x[rows, f[node]] > t[node])
        raw += v[node - len(f)]
    return 1 / (1 + np.exp(-raw))


def balanced_ensemble(
    df: DataFrame, key: str, features: str, label: str, seed: str, bags: int = 100, depth: int = 4, iterations: int = 200, step: float = 0.3, subsample: float = 0.5, ratio: float = 0.7,
    most: int = 5_000,
) -> DataFrame:
    """Mean probability of gradient-boosted trees, each learnt on a sample, balanced by a hash of the id, that takes ``ratio`` of
    the smaller class from either class, about ``most`` rows of a class at most. A sample is one task; the models, of a size
    fixed by the parameters, are broadcast and score all rows in one narrow pass. Labels are 0 and 1; a class without rows is an error."""
    from synapta.functions import seeded

    spark = df.sparkSession
    n = {int(r[label]): r["count"] for r in df.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if len(n) < 2:
        raise ValueError("balanced samples need rows of both classes")
    take = min(ratio * min(n.values()), most)
    share = F.when(F.col(label) == 0, F.lit(take / n[0])).otherwise(F.lit(take / n[1]))
    data = df.where(F.col(label).isin(0, 1)).select(F.col(key).alias("_key"), F.col(features).cast("array<double>").alias("_x"), F.col(label).cast("int").alias("_y"), share.alias("_share"))
    part = lambda b: F.conv(F.substring(seeded(F.concat(F.lit(seed), b.cast("string")), F.col("_key")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    bagged = data.select("_key", "_x", "_y", F.explode(F.filter(F.sequence(F.lit(0), F.lit(bags - 1)), lambda b: part(b) < F.col("_share"))).alias("bag"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        x = np.nan_to_num(np.array(pdf["_x"].tolist(), float))
        feature, threshold, leaf = boosted_trees(x, pdf["_y"].to_numpy(float), depth, iterations, step, subsample, int(pdf["bag"].iloc[0]))
        return pd.DataFrame({"bag": [pdf["bag"].iloc[0]], "feature": [feature.tobytes()], "threshold": [threshold.tobytes()], "leaf": [leaf.tobytes()]})

    fitted = bagged.repartition(bags, "bag").groupBy("bag").applyInPandas(fit, "bag int, feature binary, threshold binary, leaf binary").collect()  # bags rows
    inner = (1 << depth) - 1
    read = lambda v, kind, width: np.frombuffer(bytes(v), kind).reshape(-1, width)
    models = spark.sparkContext.broadcast([(read(r["feature"], np.int32, inner), read(r["threshold"], float, inner), read(r["leaf"], float, inner + 1)) for r in sorted(fitted, key=lambda r: r["bag"])])

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        v = np.nan_to_num(np.array(x.tolist(), float))
        return pd.Series(np.mean([boosted_probability(m, v) for m in models.value], axis=0) if len(v) else [])

    return df.select(key, score(F.col(features).cast("array<double>")).alias("probability"))
