"""Tiled products and correlations against numpy."""

import numpy as np
import pytest

from synapta.operators import tiles


def table(spark, n=400, p=11, seed=0, holes=0.1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 1e6 * (np.arange(p) == 4)
    x[:, 7] = 3.0
    x[rng.random((n, p)) < holes] = np.nan
    key = rng.integers(0, 3, n)
    rows = [(f"k{k}", [None if np.isnan(v) else float(v) for v in r]) for k, r in zip(key, x)] + [("k0", None), ("alone", [1.0] * p)]
    return spark.createDataFrame(rows, "key string, x array<double>").repartition(5), x, key


@pytest.mark.parametrize(("tile", "task_bytes"), [(128, 96 << 20), (4, 96 << 20), (4, 8 * 6 * 11 * 4)])
def test_products_and_correlations(spark, tile, task_bytes):
    df, x, key = table(spark)
    z = np.nan_to_num(x)
    got = {(r.key, r.i, r.j): r.g for r in tiles.column_products(df, ["key"], "x", 11, tile, task_bytes).collect()}
    assert len(got) == 4 * 66
    for k in range(3):
        g = z[key == k].T @ z[key == k]
        assert all(got[f"k{k}", i, j] == pytest.approx(g[i, j], rel=1e-9, abs=1e-6) for i in range(11) for j in range(i + 1))
    cor = {(r.key, r.i, r.j): r.r for r in tiles.column_correlations(df, ["key"], "x", 11, tile, task_bytes).collect()}
    assert len(cor) == 4 * 55
    for k in range(3):
        m = x[key == k]
        for i in range(11):
            for j in range(i):
                both = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
                if 7 in (i, j):
                    assert cor[f"k{k}", i, j] is None
                else:
                    assert cor[f"k{k}", i, j] == pytest.approx(np.corrcoef(m[both, i], m[both, j])[0, 1], abs=1e-8)
    assert all(v is None for (k, *_), v in cor.items() if k == "alone")


def test_no_keys_no_rows_other_lengths(spark):
    df, x, _ = table(spark, holes=0.0)
    got = {(r.i, r.j): r.g for r in tiles.column_products(df, [], "x", 11, 4).collect()}
    full = np.vstack([x, np.ones(11)])
    assert all(v == pytest.approx((full.T @ full)[k], rel=1e-9, abs=1e-6) for k, v in got.items()) and len(got) == 66
    assert tiles.column_correlations(df.where("x is null"), ["key"], "x", 11).collect() == []
    with pytest.raises(Exception, match="not of length"):
        tiles.column_products(df, [], "x", 10).collect()


def test_shuffle_does_not_grow_with_rows(spark):
    df, *_ = table(spark, n=3000, holes=0.0)
    sent = df.coalesce(2).select("key", "x")
    parts = tiles.column_products(sent, ["key"], "x", 11)
    plan = parts._jdf.queryExecution().executedPlan()
    parts.collect()
    assert "Generate" not in plan.toString()
