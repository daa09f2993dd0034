"""Products of columns as dense tiles: partial sums in each task, merged tile by tile; rows are never exploded into pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_schema

#: Columns of a tile.
TILE = 128
#: Bytes of sums that a task holds; more columns are dealt in bands of rows of the matrix, each band to tasks of its own.
TASK_BYTES = 96 << 20
#: Tasks that share a band.
SPREAD = 32


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows by columns of arrays of numbers, NULL elements as NaN."""
    if len(column) and set(pc.unique(pc.list_value_length(column)).to_pylist()) != {size}:
        raise ValueError(f"an array is not of length {size}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def _add(x: np.ndarray, lo: int, hi: int, pairs: bool, out: np.ndarray) -> None:
    """Adds the sums of columns lo to hi by columns 0 to hi. ``pairs``: also, over rows that have both, the number, the
    sums of either column and of its squares."""
    missing = np.isnan(x)
    x = np.where(missing, 0.0, x) if missing.any() else x
    a, b = x[:, lo:hi], x[:, :hi]
    out[0] += a.T @ b
    if not pairs:
        return
    if missing.any():
        have = (~missing).astype(float)
        ma, mb = have[:, lo:hi], have[:, :hi]
        out[1] += ma.T @ mb
        out[2], out[3] = out[2] + a.T @ mb, out[3] + ma.T @ b
        out[4], out[5] = out[4] + (a * a).T @ mb, out[5] + ma.T @ (b * b)
    else:
        out[1] += len(x)
        out[2], out[3] = out[2] + a.sum(0)[:, None], out[3] + b.sum(0)
        out[4], out[5] = out[4] + (a * a).sum(0)[:, None], out[5] + (b * b).sum(0)


def _cells(df: DataFrame, keys: list[str], x: str, size: int, pairs: bool, finish, names: list[str], shift: list[float] | None, tile: int, task_bytes: int) -> DataFrame:
    """(keys, i, j, names) for i >= j; ``finish`` gives the values of a tile from its sums."""
    kinds = 6 if pairs else 1
    band = max(tile, min(size, task_bytes // (8 * kinds * size)) // tile * tile)
    bands = [(lo, min(lo + band, size)) for lo in range(0, size, band)]
    zero = np.array(shift) if shift is not None else None
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("array<double>").alias("_x"))
    if len(bands) > 1:
        rows = rows.withColumn("_salt", F.monotonically_increasing_id() % SPREAD).withColumn("_band", F.explode(F.sequence(F.lit(0), F.lit(len(bands) - 1))))
        rows = rows.repartition(len(bands) * SPREAD, "_band", "_salt").drop("_salt")
    else:
        rows = rows.withColumn("_band", F.lit(0))
    of_keys = StructType([df.schema[k] for k in keys])
    types = list(to_arrow_schema(of_keys))

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}
        size_held = 0

        def flush():
            for (*key, at), sums in held.items():
                lo, hi = bands[at]
                out = [
                    (i // tile, j // tile, sums[:, i - lo : min(i + tile, hi) - lo, j : min(j + tile, hi)].tobytes())
                    for i in range(lo, hi, tile) for j in range(0, i + 1, tile)
                ]
                for lo_ in range(0, len(out), 16):
                    part = out[lo_ : lo_ + 16]
                    cols = [pa.array([k] * len(part), f.type) for k, f in zip(key, types)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([p[0] for p in part], pa.int32()), pa.array([p[1] for p in part], pa.int32()), pa.array([p[2] for p in part], pa.binary())], names=[*keys, "ti", "tj", "sums"])
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column(b.schema.get_field_index("_x")), size)
            m = m - zero if zero is not None else m
            tags = list(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in [*keys, "_band"])))
            where: dict[tuple, list[int]] = {}
            for i, tag in enumerate(tags):
                where.setdefault(tag, []).append(i)
            for tag, at in where.items():
                lo, hi = bands[tag[-1]]
                if tag not in held:
                    more = 8 * kinds * (hi - lo) * hi
                    if held and size_held + more > task_bytes:
                        yield from flush()
                        size_held = 0
                    held[tag] = np.zeros((kinds, hi - lo, hi))
                    size_held += more
                _add(m[at] if len(at) < len(m) else m, lo, hi, pairs, held[tag])
        yield from flush()

    schema = StructType([*of_keys, *StructType.fromDDL("ti int, tj int, sums binary")])
    parts = rows.mapInArrow(partial, schema)
    by = [*keys, "ti", "tj"]
    result = StructType([*of_keys, StructField("i", IntegerType()), StructField("j", IntegerType()), *(StructField(n, DoubleType()) for n in names)])

    def merge(batches):
        last, total = None, None

        def cells():
            *key, ti, tj = last
            shape = (kinds, min(tile, size - ti * tile), min(tile, size - tj * tile))
            values = finish(total.reshape(shape))
            i, j = np.mgrid[ti * tile : ti * tile + shape[1], tj * tile : tj * tile + shape[2]]
            keep = i >= j
            cols = [pa.array([k] * int(keep.sum()), f.type) for k, f in zip(key, types)]
            cells_ = [pa.array(v[keep], pa.float64(), mask=np.isnan(v[keep])) for v in values]
            return pa.RecordBatch.from_arrays([*cols, pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *cells_], names=[*keys, "i", "j", *names])

        for b in batches:
            for *key, sums in zip(*(b.column(c).to_pylist() for c in [*by, "sums"])):
                if key != last:
                    if last is not None:
                        yield cells()
                    last, total = key, np.zeros(len(sums) // 8)
                total += np.frombuffer(sums, float)
        if last is not None:
            yield cells()

    return parts.repartition(*by).sortWithinPartitions(*by).mapInArrow(merge, result)


def column_products(df: DataFrame, keys: list[str], x: str, size: int, tile: int = TILE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(keys, i, j, g) for i >= j, the sums of x[i] * x[j] over the rows of each key, NULL elements as 0.

    A task adds its rows to a dense block of sums and sends its tiles at the end, or whenever blocks of more keys than ``task_bytes`` holds
    came by; a tile's sums pass one task as a stream. The shuffle is tasks times tiles, whatever the rows. Where size * size sums
    do not fit a task, rows go once to each band of the matrix. NULL arrays are left out, other lengths are an error.
    """
    return _cells(df, keys, x, size, False, lambda s: [s[0]], ["g"], None, tile, task_bytes)


def column_correlations(df: DataFrame, keys: list[str], x: str, size: int, tile: int = TILE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(keys, i, j, r) for i > j, Pearson's r over the rows of each key that have both elements; NULL without variance or
    with fewer than two rows. As `column_products`; sums are taken around the first row, so that large means cost no digits."""
    first = df.where(F.col(x).isNotNull()).select(F.col(x).cast("array<double>").alias("x")).first()
    shift = [v or 0.0 for v in first["x"]] if first else None

    def r(s: np.ndarray) -> list[np.ndarray]:
        p, n, si, sj, qi, qj = s
        with np.errstate(invalid="ignore", divide="ignore"):
            vi, vj, c = qi - si * si / n, qj - sj * sj / n, p - si * sj / n
            ok = (n > 1) & (vi > 1e-13 * np.maximum(qi, 1e-300)) & (vj > 1e-13 * np.maximum(qj, 1e-300))
            return [np.where(ok, c / np.sqrt(np.where(ok, vi * vj, 1.0)), np.nan)]

    return _cells(df, keys, x, size, True, r, ["r"], shift, tile, task_bytes).where("i > j")
