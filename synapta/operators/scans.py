"""Ordered scans over ranges: row numbers, running sums and minima and the row before, with no task that holds a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan(
    df: DataFrame, keys: list[str], order: list[Column], checkpoint, number: str | None = None, sums: dict[str, str] | None = None,
    least: dict[str, str] | None = None, before: dict[str, str] | None = None, total: str | None = None,
) -> DataFrame:
    """``df`` with running columns of each key by ``order``, which must order the rows of a key fully.

    ``number``: the row's number from 1; ``sums`` and ``least``: name to the column whose running sum or minimum it is, the row
    included, NULLs passed over; ``before``: name to the column whose value in the row before it is; ``total``: rows of the key.

    Rows are dealt by sorted ranges of (keys, order), so a key of any size spreads over tasks, and written once by
    ``checkpoint``, which fixes the ranges. Each range is scanned for itself; what a range carries over from those before it is one row
    a range at most (only the key at its start goes on), which is broadcast. Without keys all rows are one series.
    """
    sums, least, before = sums or {}, least or {}, before or {}
    dealt = checkpoint(df.repartitionByRange(*(F.col(k) for k in keys), *order).withColumn("_scan_part", F.spark_partition_id()))
    inside = Window.partitionBy("_scan_part", *keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumn("_scan_n", F.row_number().over(inside))

    ends = [F.max("_scan_n").alias("_scan_c")]
    ends += [F.sum(c).alias(f"_scan_s_{o}") for o, c in sums.items()] + [F.min(c).alias(f"_scan_m_{o}") for o, c in least.items()]
    ends += [F.max_by(F.struct(c), "_scan_n").alias(f"_scan_b_{o}") for o, c in before.items()]
    earlier = Window.partitionBy(*keys).orderBy("_scan_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum("_scan_c").over(earlier).alias("_scan_c")]
    carried += [F.sum(f"_scan_s_{o}").over(earlier).alias(f"_scan_s_{o}") for o in sums] + [F.min(f"_scan_m_{o}").over(earlier).alias(f"_scan_m_{o}") for o in least]
    carried += [F.last(f"_scan_b_{o}").over(earlier).alias(f"_scan_b_{o}") for o in before]
    each = local.groupBy("_scan_part", *keys).agg(*ends)
    carry = each.select(F.col("_scan_part").alias("_scan_at"), *(F.col(k).alias(f"_scan_k{i}") for i, k in enumerate(keys)), *carried).where("_scan_c is not null")

    for o, c in sums.items():
        local = local.withColumn(o, F.sum(c).over(so_far))
    for o, c in least.items():
        local = local.withColumn(o, F.min(c).over(so_far))
    for o, c in before.items():
        local = local.withColumn(o, F.lag(c).over(inside))
    same = F.col("_scan_part") == F.col("_scan_at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_scan_k{i}"))
    out = local.join(F.broadcast(carry), same, "left")
    if number:
        out = out.withColumn(number, F.col("_scan_n") + F.coalesce("_scan_c", F.lit(0)))
    for o in sums:
        out = out.withColumn(o, F.when(F.col(o).isNull(), F.col(f"_scan_s_{o}")).otherwise(F.col(o) + F.coalesce(F.col(f"_scan_s_{o}"), F.lit(0))))
    for o in least:
        out = out.withColumn(o, F.least(o, f"_scan_m_{o}"))
    for o, c in before.items():
        out = out.withColumn(o, F.when(F.col("_scan_n") == 1, F.col(f"_scan_b_{o}")[c]).otherwise(F.col(o)))
    if total:
        all_rows = each.groupBy(*keys).agg(F.sum("_scan_c").alias(total)) if keys else each.agg(F.sum("_scan_c").alias(total))
        if keys:
            sizes = all_rows.select(*(F.col(k).alias(f"_scan_t{i}") for i, k in enumerate(keys)), total)
            same = F.lit(True)
            for i, k in enumerate(keys):
                same = same & F.col(k).eqNullSafe(F.col(f"_scan_t{i}"))
            out = out.join(sizes, same)
        else:
            out = out.crossJoin(F.broadcast(all_rows))  # one row
    return out.select(*df.columns, *([number] if number else []), *sums, *least, *before, *([total] if total else []))
