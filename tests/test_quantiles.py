"""Exact quantiles by counting, outliers of hot keys and spline filling, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synapta.operators import components as cp
from synapta.operators.quantiles import exact_percentiles
from synapta.sources.io import checkpointed

SHARES = [0.0, 0.05, 0.25, 0.5, 0.813, 0.95, 1.0]


def values(seed=0, n=6000):
    """One key holds most rows; ties, two signs, a wide range of sizes, a key of one value and keys of few."""
    rng = np.random.default_rng(seed)
    hot = np.concatenate([rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.normal(size=200) * 1e100, np.full(n // 2, 0.25)])
    return {"hot": hot, "same": np.full(3000, -2.5), "few": rng.normal(size=37), "one": np.array([4.0])}


def frame(spark, seed=0):
    rows = [(k, i, float(v)) for k, vs in values(seed).items() for i, v in enumerate(vs)] + [("few", -1, None), ("few", -2, float("nan"))]
    return spark.createDataFrame(rows, "k string, i int, x double").repartition(4)


@pytest.mark.parametrize(("limit", "bins"), [(100_000, 512), (500, 512)])
def test_quantiles_are_exact(spark, limit, bins):
    got = {r.k: r for r in exact_percentiles(frame(spark), ["k"], "x", SHARES, checkpointed, limit, bins).collect()}
    for k, v in values().items():
        assert got[k].n == len(v) and np.allclose(got[k].q, np.quantile(v, SHARES), rtol=1e-12), k


@pytest.mark.parametrize("limit", [100, 40])
def test_noisy_points_at_cuts_between_neighbouring_doubles(spark, limit):
    """The cut lies between two values a bit apart: (value - 50) from above and from below."""
    import duckdb

    from synapta.plans import ORACLES

    rng = np.random.default_rng(6)
    low, high, rows = (np.array([2.38, 2.1, 0.74, 2.23, 1.46, 2.54, 0.65]), np.array([97.62, 97.9, 99.26, 97.77, 98.54, 97.46, 99.35]), [])
    for user, n in enumerate([62, 78, 60, 67, 59, 67, 66] * 3):
        i = int((n - 1) * 0.875)
        a, b = low[user % 7], high[user % 7]
        v = np.concatenate([np.round(rng.uniform(40, 60, i), 2), [a, b], np.round(rng.uniform(120, 200, n - i - 2), 2)])
        rows += [(user, float(x)) for x in v]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (user_id BIGINT, value DOUBLE)")
    con.executemany("INSERT INTO events VALUES (?, ?)", rows)
    want = {u: r for u, r in con.execute(ORACLES["noisy_points"]).fetchall()}
    df = spark.createDataFrame(rows, "user_id bigint, value double").withColumn("n", F.abs(F.col("value") - 50))
    got = {r.user_id: r.noisy_ratio for r in cp.noisy_points_ratio(df, ["user_id"], "ts", "value", "n", checkpointed, limit=limit).collect()}
    assert {u: round(x, 6) for u, x in got.items()} == pytest.approx(want, abs=1.5e-6)


def test_quantiles_without_keys_or_rows(spark):
    df = frame(spark)
    every = np.concatenate(list(values().values()))
    assert np.allclose(exact_percentiles(df, [], "x", SHARES, checkpointed, 3000).first().q, np.quantile(every, SHARES), rtol=1e-12)
    assert exact_percentiles(df.where("x is null"), ["k"], "x", SHARES, checkpointed).collect() == []


@pytest.mark.parametrize("limit", [100_000, 200])
def test_outliers_of_a_hot_key(spark, limit):
    rng = np.random.default_rng(4)
    data = {"hot": np.concatenate([rng.normal(size=4000), rng.normal(size=60) * 30]), "small": np.array([1.0, 1, 1, 2, 50])}
    rows = [(k, i, float(v)) for k, vs in data.items() for i, v in enumerate(vs)] + [("small", 9, None)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(4)
    got = {(r.k, r.i) for r in cp.mark_outliers(df, ["k"], "x", "i", checkpointed, limit=limit).where("outlier").collect()}
    want = set()
    for k, v in data.items():
        med = np.median(v)
        mad = np.median(abs(v - med))
        order = np.argsort(v, kind="stable")
        tail = set(order[: (len(v) + 9) // 20]) | set(order[len(v) - (len(v) + 9) // 20 :])
        want |= {(k, int(i)) for i in tail if abs(v[i] - med) > 3 * 1.4826 * mad}
    assert got == want and len(want) > 20
    assert cp.mark_outliers(df, ["k"], "x", "i", checkpointed, limit=limit).count() == len(rows)


def dense_spline(x, y, at):
    """Not-a-knot cubic spline by one dense system for all coefficients."""
    n = len(x) - 1
    a, b, row = np.zeros((4 * n, 4 * n)), np.zeros(4 * n), 0
    p = lambda s, k: np.array([[1, s, s * s, s**3], [0, 1, 2 * s, 3 * s * s], [0, 0, 2, 6 * s], [0, 0, 0, 6]][k], float)
    for i in range(n):
        h = x[i + 1] - x[i]
        for s, v in ((0.0, y[i]), (h, y[i + 1])):
            a[row, 4 * i : 4 * i + 4], b[row], row = p(s, 0), v, row + 1
        if i + 1 < n:
            for k in (1, 2):
                a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8], row = p(h, k), -p(0.0, k), row + 1
    for i in (0, n - 2):
        a[row, 4 * i : 4 * i + 4], a[row, 4 * i + 4 : 4 * i + 8], row = p(0.0, 3), -p(0.0, 3), row + 1
    c = np.linalg.lstsq(a, b, rcond=None)[0].reshape(n, 4)
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 1)
    return np.array([c[j] @ p(t - x[j], 0) for j, t in zip(i, at)])


def test_spline_filling():
    rng = np.random.default_rng(5)
    for n in (4, 5, 6, 9, 40):
        t = np.cumsum(rng.integers(1, 4, n + 3)).astype(float)
        v, gone = rng.normal(size=n + 3), np.zeros(n + 3, bool)
        gone[[0, (n + 3) // 2, n + 2]] = True
        got = cp.spline_fill(t, v, gone)
        assert np.allclose(got[gone], dense_spline(t[~gone], v[~gone], t[gone]), rtol=1e-6) and np.array_equal(got[~gone], v[~gone])
    t = np.arange(5.0)
    assert np.allclose(cp.spline_fill(t, t**2, np.array([0, 1, 0, 1, 0], bool)), t**2)  # three knots: a parabola
    assert np.allclose(cp.spline_fill(t, 3 * t, np.array([1, 0, 1, 0, 1], bool)), 3 * t)  # two: a line
    assert np.allclose(cp.spline_fill(t, t, np.array([1, 0, 1, 1, 1], bool)), 1)
    assert np.array_equal(cp.spline_fill(t, t, np.ones(5, bool)), t)


def test_fill_distance(spark):
    v = np.sin(np.arange(60) / 5)
    v[[10, 30]] += [9, -7]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "k string, t int, x double")
    gone = np.zeros(60, bool)
    gone[[10, 30]] = True
    want = np.sqrt(((v - cp.spline_fill(np.arange(60.0), v, gone)) ** 2).sum())
    assert cp.outlier_fill_distance(df, ["k"], "t", "x", checkpointed).first().distance == pytest.approx(want)
