"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.llm.common import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with v < u. Each node points its larger (large) or smaller (small) neighbours at the least node it sees."""
    if large:
        seen = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).union(edges.select(F.col("v"), F.col("u")))
        least = seen.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("least"))
        # neighbours above n; n itself keeps its edge to the least node through its own smaller neighbours' turn
        out = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).join(least, "n").select(F.col("m").alias("u"), F.col("least").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("least"))
        pairs = edges.join(least, "u")
        out = pairs.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v bigint); the root is the least node of its component.

    Each round is two aggregations with map-side combining and two joins on a node, written to the shared scratch folder;
    a node of very many neighbours meets one row on the other side of the join, so such a join can be split.
    The number of rounds grows with the logarithm of the graph's size.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = materialise(e, f"{name}-edges"), None
    while True:
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            break
        before = sign
        e = materialise(_stars(_stars(e, True), False), f"{name}-edges")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
