"""Scans over ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from synapta.operators.scans import scan
from synapta.sources.io import checkpointed


def loop(rows):
    out, state = {}, {}
    for k, o, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n, s, m, b = state.get(k, (0, None, None, None))
        s2 = s if x is None else (s or 0) + x
        m2 = m if x is None else min(x, m) if m is not None else x
        out[k, o] = (n + 1, s2, m2, b)
        state[k] = (n + 1, s2, m2, x)
    return out, {k: v[0] for k, v in state.items()}


@pytest.mark.parametrize("hot", [False, True])
def test_scan_equals_loop(spark, hot):
    rng = random.Random(3)
    rows = [(None if rng.random() < 0.05 else 7 if hot and rng.random() < 0.6 else rng.randrange(40), i, None if rng.random() < 0.2 else rng.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, x bigint").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scan(df, ["k"], [F.asc("o")], checkpointed, number="n", sums={"s": "x"}, least={"m": "x"}, before={"b": "x"}, total="t").collect()
        alone = scan(df, [], [F.desc("o")], checkpointed, number="n", total="t").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, totals = loop(rows)
    assert {(r.k, r.o): (r.n, r.s, r.m, r.b) for r in got} == want and len(got) == len(rows)
    assert all(r.t == totals[r.k] for r in got)
    assert all(r.n == 3000 - r.o and r.t == 3000 for r in alone)


def test_scan_of_nothing(spark):
    df = spark.createDataFrame([], "k bigint, o bigint, x bigint")
    assert scan(df, ["k"], [F.asc("o")], checkpointed, number="n", sums={"s": "x"}, before={"b": "x"}).collect() == []
