"""Operators on small frames: traps, errors and numerical kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from synapta.sources.io import checkpointed
from synapta import functions as fn
from synapta.operators import cleaning, cohort, connectivity, inference, models, motion
from synapta.operators import components as cp
from synapta.sources import io


def one(df):
    return df.collect()[0]


def test_na_parse_and_ids(spark):
    df = spark.createDataFrame([("n/a", "NDAR_INV1"), ("", "sub-A_B"), (" 1.5 ", "x"), ("abc", None), (None, "a_b")], "c string, i string")
    rows = df.select(fn.na_parse(F.col("c")), fn.canonical_subid(F.col("i"))).collect()
    assert [r[0] for r in rows] == [None, None, 1.5, None, None]
    assert [r[1] for r in rows] == ["sub-NDARINV1", "sub-A_B", "sub-x", None, "sub-ab"]
    assert one(spark.createDataFrame([("['a', \"b\"]",)], "s string").select(fn.clean_id(F.col("s"))))[0] == "ab"


def test_validity_rounds_first(spark):
    df = spark.createDataFrame([(0.5000004, 0.41, 180), (0.5, 0.4, 180), (0.5, 0.4000006, 179), (None, 0.9, 180)], "m double, r double, n int")
    assert [r[0] for r in df.select(fn.motion_valid(F.col("m"), F.col("r"))).collect()] == [True, False, True, False]
    assert [r[0] for r in df.select(fn.motion_valid(F.col("m"), F.col("r"), F.col("n"), (None, 180))).collect()] == [True, False, False, False]


def test_fisher_ratio_labels(spark):
    df = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0005), (float("nan"), 2.0, 0.0, 0.04), (None, 0.0, 4.0, 0.05)], "r double, a double, b double, p double")
    rows = df.select(fn.fisher_z(F.col("r")), fn.safe_ratio(F.col("a"), F.col("b")), fn.stars(F.col("p")), fn.stars_plot(F.col("p"))).collect()
    assert rows[0][0] == pytest.approx(math.atanh(1 - 1e-6)) and rows[1][0] == 0 and rows[2][0] == 0
    assert [r[1] for r in rows] == [0.0, None, 0.0] and [r[2] for r in rows] == ["***", "*", "ns"] and [r[3] for r in rows] == ["**", "*", "ns"]


def test_differences_at_edges(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 9.0), ("b", 0, 5.0)], "k string, t int, x double")
    u = {(r.k, r.t): r.d for r in motion.unbiased_difference(df, ["k"], ["t"], "x", "d").collect()}
    assert u == {("a", 0): 2.0, ("a", 1): 4.0, ("a", 2): 6.0, ("b", 0): 0.0}
    r = {(r.k, r.t): r.d for r in motion.polynomial_detrend(df, ["k"], "t", "x", "d").collect()}
    assert all(abs(v) < 1e-9 for v in r.values())


def test_age_floor_keeps_unknown(spark):
    df = spark.createDataFrame([(5.9,), (6.0,), (None,)], "age double")
    assert [r[0] for r in cohort.age_floor(df, "age", 6).collect()] == [6.0, None]


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(ValueError):
        cohort.require_columns(df, ["k", "absent"])
    for bad in (lambda: cohort.require_unique(df, ["k"]), lambda: df.select(fn.recode_strict(F.col("v"), {"a": 1})), lambda: df.select(connectivity.dimension(F.lit(4))), lambda: models.check_split(df.withColumn("side", F.col("v")), "k"), lambda: cohort.align(df, df.where("k = 2").select("k"), "k", strict=True)):
        with pytest.raises(Exception, match="(?i)null or repeated|unknown code|triangle|both sides|without a row"):
            bad().collect()
    with pytest.raises(Exception, match="inconsistent"):
        cp.reclassified(spark.createDataFrame([(1, "signal"), (1, "noise")], "comp int, list string"), ["comp"]).collect()


def test_missing_summary_keeps_all_runs(spark):
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "subid string, run int")
    summary = spark.createDataFrame([("a", 1, False), ("a", 2, True)], "subid string, run int, valid boolean")
    assert sorted(map(tuple, cohort.select_runs(runs, summary, "subid", "run").collect())) == [("a", 2), ("b", 1)]


def test_triangle_indices_round_trip(spark):
    n = 9
    pairs = spark.createDataFrame([(i, j) for i in range(n) for j in range(i)], "i int, j int")
    rows = pairs.select("i", "j", connectivity.lower_index(F.col("i"), F.col("j")).alias("f"), connectivity.upper_index(F.col("j"), F.col("i"), n).alias("u")).collect()
    assert sorted(r.f for r in rows) == list(range(n * (n - 1) // 2)) == sorted(r.u for r in rows)
    back = connectivity.rebuild(pairs.select(connectivity.lower_index(F.col("i"), F.col("j")).alias("f"), F.col("i").alias("x")), "f", "x").collect()
    assert {(r.i, r.j) for r in back} == {(i, j) for i in range(n) for j in range(n) if i != j}
    assert [one(spark.range(1).select(connectivity.dimension(F.lit(x))))[0] for x in (4950, 2278)] == [100, 68]


def test_constant_region_gives_zero(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0]), ("s", [1.0, 3.0])], "k string, x array<double>")
    r = one(connectivity.with_z(connectivity.pair_correlations(df, "k", "x", 2)))
    assert r.r == 0 and r.z == 0


def test_least_squares_against_numpy(spark):
    rng = np.random.default_rng(0)
    c, y = rng.normal(size=(80, 3)), rng.normal(size=80)
    rows = [(i % 2, i, 1.0, *map(float, c[i]), float(c[i, 0]), float(y[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, i int, one double, a double, b double, c double, copy double, y double")
    got = {r.i: r.e for r in models.residuals(df, ["g"], ["one", "a", "b", "c", "copy"], "y", "e").collect()}  # singular: copy equals a
    for g in (0, 1):
        at = np.arange(80) % 2 == g
        x = np.column_stack([np.ones(40), c[at]])
        want = y[at] - x @ np.linalg.lstsq(x, y[at], rcond=None)[0]
        assert np.allclose([got[i] for i in np.flatnonzero(at)], want, atol=1e-7)


def test_pls_nested_components():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    y = x @ rng.normal(size=8) + 0.01 * rng.normal(size=60)
    coef, icpt = models.pls1_fit(x, y, 8)
    full = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert np.allclose(coef[-1], full[1:], atol=1e-6) and np.isclose(icpt[-1], full[0])
    assert np.allclose(models.pls1_fit(x, y, 3)[0], coef[:3])
    assert np.allclose(models.pls1_fit(np.ones((5, 2)), np.arange(5.0), 2)[0], 0)


def test_path_a_equals_path_b(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 5))
    y = x @ np.array([1.0, 0, 2, 0, 1]) + rng.normal(size=30)
    long = spark.createDataFrame([(i, f, float(x[i, f]), float(y[i])) for i in range(30) for f in range(5)], "s int, f int, x double, y double")
    scores, _ = models.pls1_long(long, "s", "f", "x", "y", 2, io.checkpointed)
    coef, icpt = models.pls1_fit(x, y, 2)
    want = (x @ coef[1] + icpt[1] - y.mean()) / y.std(ddof=1)
    got = {r.s: r.fit1 + r.fit2 for r in scores.collect()}
    assert np.allclose([got[i] for i in range(30)], want, atol=1e-8)


@pytest.mark.parametrize("n", [10, 11, 13])
def test_fold_sizes(spark, n):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(n)], "subid int, y double")
    f = models.block_folds(df, "y", "subid", 5, "s", checkpointed).groupBy("fold").count().collect()
    assert {r["count"] for r in f} <= {n // 5, n // 5 + 1} and sum(r["count"] for r in f) == n


def test_family_split_invariants(spark):
    df = spark.createDataFrame([(i, i // 3, float(i % 7)) for i in range(90)], "k int, fam int, y double")
    s = models.family_half_split(models.quantile_strata(df, "y", 10, 2), "fam", "stratum", "k", "seed")
    assert s.groupBy("fam").agg(F.count_distinct("side").alias("n")).where("n > 1").count() == 0
    sizes = {r.side: r["count"] for r in s.groupBy("side").count().collect()}
    assert abs(sizes["train"] - sizes["test"]) <= 18


def test_permutation_keeps_test_labels(spark):
    df = spark.createDataFrame([(p, i, i % 3 != 0, float(i)) for p in range(3) for i in range(12)], "perm_id int, k int, train boolean, y double")
    rows = models.permute_labels(df, "y", "k", "s", ["perm_id"], "train").collect()
    assert all(r.y == r.y_perm for r in rows if not r.train or r.perm_id == 0)
    for p in (1, 2):
        part = [r for r in rows if r.perm_id == p and r.train]
        assert sorted(r.y for r in part) == sorted(r.y_perm for r in part) and any(r.y != r.y_perm for r in part)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_permuted_copies_equal_permute_labels_without_a_broadcast(spark, most):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(rng.integers(0, 9)), bool(rng.integers(0, 5))) for i in rng.permutation(200)]
    df = spark.createDataFrame(rows, "subid bigint, y int, is_train boolean").repartition(3)
    copies = models.repeats(df, 7, "perm")
    drawn = models.permute_labels(copies, "y", "subid", "s", ["perm"], "is_train")
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan  # the driver would hold all copies
    want = {(r.perm, r.subid): r.y_perm for r in drawn.collect()}
    got = models.permuted_copies(df, "y", "subid", "s", 7, "is_train", checkpointed, "perm", most).collect()
    assert len(got) == len(want) == 1400 and {(r.perm, r.subid): r.y_perm for r in got} == want


def test_tails():
    # published critical values: t(0.975; 10) = 2.228139, t(0.975; 1) = 12.7062, F(0.95; 3, 20) = 3.098391
    assert np.allclose(inference.t_two_sided([2.228139, 12.7062, 0.0, float("inf")], [10, 1, 5, 5]), [0.05, 0.05, 1.0, 0.0], atol=1e-5)
    assert np.allclose(inference.f_tail([3.098391, 0.0], [3, 3], [20, 20]), [0.05, 1.0], atol=1e-5)


def test_bh_strict_and_tolerant(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    q = {r.i: r.q for r in inference.bh_fdr(df, "p", tie=["i"]).collect()}
    assert q[1] == pytest.approx(0.03) and q[2] == pytest.approx(0.04) and q[3] == pytest.approx(0.04) and q[4] is None
    with pytest.raises(Exception, match="expected 4"):
        inference.bh_fdr(df, "p", tie=["i"], strict=4).collect()


def test_paired_t_without_variance(spark):
    df = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("c", 1.0), ("c", 1.0)], "k string, d double")
    t = {r.k: r.t for r in inference.paired_t(df, ["k"], "d", 0.25).collect()}
    assert t["z"] == 0 and t["c"] == math.inf


def test_nested_cv_by_sums_equals_whole_tables(spark):
    rng = np.random.default_rng(4)
    n, sets = 143, {"a": (0, 5), "all": (0, 8)}
    x, c = rng.normal(size=(n, 8)), np.column_stack([np.ones(n), rng.normal(size=n)])
    x += c[:, 1:] * rng.normal(size=8)
    y = x @ rng.normal(size=8) + rng.normal(size=n)
    df = spark.createDataFrame([(i, float(y[i]), c[i].tolist(), x[i].tolist()) for i in range(n)], "subid long, y double, c array<double>, x array<double>")
    got = {(r.time_id, r.feature_set, r.fold): r for r in models.nested_cv(df, sets, io.checkpointed, times=2, k=4, inner_repeats=3, chunk=50, groups=2).collect()}
    assert len(got) == 20
    folds = models.block_folds(models.repeats(df.select("subid", "y"), 2), "y", "subid", 5, "split", checkpointed, by=["time_id"]).collect()
    fold = {(r.time_id, r.subid): r.fold for r in folds}
    order = np.argsort(-y, kind="stable")
    for t in range(2):
        outer = np.array([fold[t, int(i)] for i in order])
        for f in range(5):
            train, tr = order[outer != f], outer != f
            inner = np.array([np.concatenate([models.inner_split(int(tr[lo : lo + 50].sum()), 5, [0, t, f, r, lo // 50]) for lo in range(0, n, 50)]) for r in range(3)])
            free = x - c @ (np.linalg.pinv(c[train]) @ x[train])
            for name, (first, count) in sets.items():
                v = free[:, first : first + count]
                v = (v - v[train].min(0)) / np.ptp(v[train], axis=0)
                comp, _ = models.inner_choice(v[train], y[train], inner, 4)
                coef, icpt = models.pls1_fit(v[train], y[train], comp)
                test = order[outer == f]
                pred = v[test] @ coef[-1] + icpt[-1]
                cov = np.cov(v[train].T) @ coef[-1]
                r = got[t, name, f]
                assert r.n_comp == comp and r.n_test == len(test)
                assert r.corr == pytest.approx(np.corrcoef(pred, y[test])[0, 1]) and r.mae == pytest.approx(np.abs(pred - y[test]).mean())
                assert np.allclose(r.w, coef[-1] / np.linalg.norm(coef[-1])) and np.allclose(r.w_haufe, cov / np.linalg.norm(cov))


def test_registered_grids_are_those_of_the_reference(spark, monkeypatch):
    import dataclasses

    from synapta.operators import crossval
    from synapta.plans import QUERIES
    from synapta.plans import models as plans

    seen, whole = [], crossval.nested_cv_scores

    def record(subjects, sets, checkpoint, plan, **named):
        seen.append((plan.times, plan.k, plan.inner_repeats, plan.inner_folds, plan.permute is not None))
        return whole(subjects, sets, checkpoint, dataclasses.replace(plan, times=1, inner_repeats=1, k=2), **named)

    monkeypatch.setattr(plans.cv, "nested_cv_scores", record)
    rows = QUERIES["pls1_grid"](spark, "/root/testdata/sf0.001").collect()
    QUERIES["nested_cv_score"](spark, "/root/testdata/sf0.001")
    null = QUERIES["permutation_null"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.feature_set for r in null) == sorted(plans.SETS) and all(r.n_null == 1 and r.p in (0.5, 1.0) for r in null)
    assert {r.fold for r in rows} == set(range(5))
    grid = (101, 10, 20, 5, False)
    assert seen == [(1, *grid[1:]), grid, grid, (1000, 10, 20, 5, True)]


def test_principal_direction_and_spectrum(spark):
    df = spark.createDataFrame([(1, 1000.0, [0.6, 0.8, 0.0]), (1, 1000.0, [-0.6, -0.8, 0.0])], "k int, b double, v array<double>")
    r = one(cleaning.average_directions(df, ["k"], "b", "v"))
    assert r.bval == pytest.approx(1000) and np.allclose(r.bvec, [0.6, 0.8, 0])
    wave = spark.createDataFrame([(1, t, math.sin(2 * math.pi * 4 * t / 32)) for t in range(32)], "k int, t int, x double")
    s = {r.freq: r.amplitude for r in cleaning.spectrum(wave, ["k"], "t", "x").collect()}
    assert max(s, key=s.get) == 4


def test_spectrum_uses_whole_series(spark):
    x = np.random.default_rng(5).normal(size=83)
    rows = [(1, t, float(v)) for t, v in enumerate(x)] + [(2, t, float(v)) for t, v in enumerate(x[:20])]
    df = spark.createDataFrame(rows, "k int, t int, x double")
    got = {(r.k, r.freq): r.amplitude for r in cleaning.spectrum(df, ["k"], "t", "x").collect()}
    for k, v in ((1, x), (2, x[:20])):  # both on the grid of the longest
        want = np.abs(np.fft.fft(v - v.mean(), 83))[:42]
        assert np.allclose([got[k, f] for f in range(42)], want) and (k, 42) not in got


@pytest.mark.parametrize("n", [83, 90])
def test_welch_by_definition(spark, n):
    """Eight Hamming segments of floor(n / 4.5) points, half overlapping, transformed at the frequencies of the whole series."""
    x = np.random.default_rng(6).normal(size=n)
    size = int(n / 4.5)
    w = [0.54 - 0.46 * math.cos(2 * math.pi * i / (size - 1)) for i in range(size)]
    starts = [k * (size - size // 2) for k in range(8)]
    want = []
    for f in range(n // 2 + 1):
        p = [abs(sum(w[i] * x[a + i] * np.exp(-2j * np.pi * f * i / n) for i in range(size))) ** 2 for a in starts]
        want.append(np.mean(p) * (1 if f == 0 else 2))
    assert starts[-1] + size <= n < starts[-1] + size + (size - size // 2)
    want = np.array(want[:-1])
    df = spark.createDataFrame([(k, 3 * i, float(v)) for k in "ab" for i, v in enumerate(x)], "k string, t int, x double").repartition(3)
    got = {(r.k, r.freq): r.amplitude for r in cleaning.welch_spectrum(df, ["k"], "t", "x", checkpointed).collect()}
    assert len(got) == 2 * len(want) and np.allclose([got["b", i] for i in range(len(want))], want / want[-10:].mean())


def wdr(maps, data, weights):
    """Weighted dual regression of maps (locations x components) on data (locations x time): (maps, courses)."""
    demean = lambda a: a - a.mean(0)
    root = np.sqrt(weights)[:, None]
    courses = demean((np.linalg.pinv(demean(maps * root)) @ demean(data * root)).T)
    scaled = courses / courses.std(0, ddof=1)
    return (np.linalg.pinv(scaled) @ demean(data.T)).T, courses


def test_weighted_dual_regression(spark):
    rng = np.random.default_rng(8)
    n_loc, n_t = 24, 15
    data, area = rng.normal(size=(n_loc, n_t)), rng.uniform(0.5, 2, n_loc)
    group, low = rng.normal(size=(n_loc, 2)), [rng.normal(size=(n_loc, 3)), rng.normal(size=(n_loc, 4))]
    for m in low:
        data[:, : m.shape[1]] += 3 * m
    kernel = np.exp(-np.abs(np.subtract.outer(range(n_loc), range(n_loc))) / 2.0)
    zs = []
    for m in low:
        twice = wdr(wdr(m, data, area)[0], data, area)[0]
        zs.append([np.arctanh(np.clip(np.corrcoef(a, b)[0, 1], -1 + 1e-6, 1 - 1e-6)) for a, b in zip(twice, m)])
    q = np.mean(zs, axis=0)
    quality = np.maximum(q.mean() + q - (kernel * q).sum(1) / kernel.sum(1), 0) ** 3
    once = wdr(group, data, area * quality)[0]
    want, courses = wdr((once - once.mean(0)) / once.std(0, ddof=1), data, area)

    frame = lambda m: spark.createDataFrame([(i, float(area[i]), *map(float, m[i])) for i in range(n_loc)], "loc int, area double, " + ", ".join(f"c{k} double" for k in range(m.shape[1])))
    df = spark.createDataFrame([("s", i, j, float(data[i, j])) for i in range(n_loc) for j in range(n_t)], "sub string, loc int, t int, x double").cache()
    near = spark.createDataFrame([(i, j, float(kernel[i, j])) for i in range(n_loc) for j in range(n_loc)], "loc int, other int, w double")
    sets = [(frame(m), [f"c{k}" for k in range(m.shape[1])]) for m in low]
    got_q = cleaning.alignment_quality(df, sets, near, ["sub"], "loc", "t", "x", "area", checkpoint=io.checkpointed)
    assert np.allclose([r.quality for r in got_q.orderBy("loc").collect()], quality)
    tc, maps = cleaning.weighted_dual_regression(df, frame(group), io.checkpointed(got_q), ["sub"], "loc", "t", "x", ["c0", "c1"], "area", checkpoint=io.checkpointed)
    assert np.allclose([(r.c0, r.c1) for r in maps.orderBy("loc").collect()], want)
    assert np.allclose([(r.c0, r.c1) for r in tc.orderBy("t").collect()], courses)


def test_unmix(spark):
    rng = np.random.default_rng(9)
    a, x = rng.normal(size=(3, 2)), rng.normal(size=(3, 20)) * [[1], [5], [9]]
    run = np.arange(20) // 12
    sd = x.std(1, ddof=1, keepdims=True)
    even = np.hstack([x[:, run == k] / x[:, run == k].std(1, ddof=1, keepdims=True) for k in (0, 1)]) * sd
    want = np.linalg.pinv(a) @ even * (a / sd).std(0, ddof=1)[:, None]
    df = spark.createDataFrame([("s", int(run[j]), j, *map(float, x[:, j])) for j in range(20)], "sub string, run int, t int, p double, q double, r double")
    got = cleaning.unmix(df, a.tolist(), ["p", "q", "r"], ["sub"], "run").orderBy("t").collect()
    assert np.allclose([(r.component1, r.component2) for r in got], want.T)


def test_mad_filter_judges_all_volumes_again(spark):
    x = np.random.default_rng(10).normal(size=(30, 8)) * 0.1
    x[3] += 5
    x[7] += 1.2  # far from the rest only once volume 3 is out of the average
    kept = np.arange(30)
    for _ in range(3):
        sc = ((x - x[kept].mean(0)) ** 2).mean(1)
        kept = np.flatnonzero(sc < np.median(np.abs(sc - np.median(sc)) * 2 + np.median(sc)))
    df = spark.createDataFrame([("s", i, j, float(x[i, j])) for i in range(30) for j in range(8)], "s string, v int, loc int, x double")
    got = cleaning.mad_filter(df, ["s"], "v", "loc", "x").orderBy("v").collect()
    assert [r.v for r in got] == kept.tolist() and np.allclose([r.score for r in got], sc[kept])


def test_peaks(spark):
    v = [0, 1, 4, 1, 0, 0, 2, 2, 0, 0.5, 0, 3, 1, 2, 0]
    p, w = cp.peak_table(np.array(v, float), 1.0, 1)
    # prominences 4, 2, 3 and 1: half of each down, by linear crossings
    assert p.tolist() == [4, 2, 3, 2] and np.allclose(w, [2 + 2 / 3 - (1 + 1 / 3), 7.5 - 5.5, 11.75 - 10.5, 13.25 - 12.5])
    assert cp.peak_table(np.array(v, float), 1.0, 2)[0].tolist() == [4, 2, 3]  # 2 apart is too close to the higher one
    df = spark.createDataFrame([("s", t, float(x)) for t, x in enumerate(v)], "k string, t int, x double")
    rows = cp.peaks(df, ["k"], "t", "x", 10.0, 1).orderBy("height").collect()
    assert [r.n_peaks for r in rows] == [5, 4, 3 + 1, 2]
    assert rows[3].mean_height == 3.5 and rows[3].sum_area == pytest.approx(float((p * w)[[0, 2]].sum())) and rows[3].mean_area == pytest.approx(rows[3].sum_area / 2)
    assert cp.peaks(df, ["k"], "t", "x", 100.0, 1).where("n_peaks > 0").count() == 0


def test_registered_ensemble_is_that_of_the_reference(spark, monkeypatch):
    import inspect

    from synapta.plans import QUERIES, tables

    signature, seen, whole = inspect.signature(cp.balanced_ensemble), [], cp.balanced_ensemble

    def record(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        seen.append(bound.arguments)
        return whole(*args, **{**named, "bags": 2, "iterations": 2})

    monkeypatch.setattr(tables.cp, "balanced_ensemble", record)
    rows = QUERIES["ensemble_score"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len({r.subid for r in rows}) > 0 and all(0 <= r.probability <= 1 for r in rows)
    assert [seen[0][k] for k in ("bags", "depth", "iterations", "step", "subsample", "ratio")] == [100, 4, 200, 0.3, 0.5, 0.7]


def test_boosted_trees_learn():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 6))
    y = ((x[:, 1] > 0) ^ (x[:, 4] > 0.3)).astype(float)  # no single feature tells the classes apart
    model = cp.boosted_trees(x[:400], y[:400], 4, 60, 0.3, 0.5, 1)
    assert ((cp.boosted_probability(model, x[400:]) > 0.5) == y[400:]).mean() > 0.93
    # one stump by hand: no step but the best one, its leaves by Newton's rule
    f, t, v = cp.boosted_trees(np.array([[0.0], [1.0], [2.0], [3.0]]), np.array([0.0, 0, 1, 1]), 1, 1, 1.0, 1.1, 0)
    assert f[0, 0] == 0 and 1 <= t[0, 0] < 2 and np.allclose(v[0], [-1 / 1.5, 1 / 1.5])


def test_echo_fit(spark):
    rows = [(1, e, 10.0 * e, 100 * math.exp(-10 * e / 50)) for e in (1, 2, 3)] + [(2, 1, 10.0, 5.0), (2, 2, 20.0, 9.0)]
    out = {r.v: r for r in cleaning.combine_echoes(spark.createDataFrame(rows, "v int, e int, te double, y double"), "v", "e", "te", "y").collect()}
    assert out[1].t2star == pytest.approx(50) and out[2].t2star == 2240 and out[2].n_used == 1
    noisy = [(1, e, 10.0 * e, y) for e, y in ((1, 90.0), (2, 60.0), (3, 20.0))]
    got = one(cleaning.combine_echoes(spark.createDataFrame(noisy, "v int, e int, te double, y double"), "v", "e", "te", "y", weighted=True))
    y = np.array([90.0, 60.0, 20.0])
    root = np.sqrt(1 / y)
    slope = (np.linalg.pinv(np.column_stack([[10.0, 20.0, 30.0] * root, root])) @ (np.log(y) * root))[0]
    assert got.t2star == pytest.approx(-1 / slope)


def test_group_pca_is_exact(spark):
    x = np.random.default_rng(3).normal(size=(60, 6))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    m = cp.merged_pca(df, "x", 6, internal=6, rank=6).cache()
    val = np.linalg.eigvalsh(x.T @ x)[::-1]
    assert np.allclose([r.eigenvalue for r in m.where("i = 0").orderBy("comp").collect()], val)
    s = np.sqrt(val)
    assert cp.effective_rank(m).first()[0] == (s > 0.1 * s.std(ddof=1)).sum() == 6
    unit = cp.directions(m).groupBy("comp").agg(F.sum(F.col("value") * F.col("value")).alias("n")).collect()
    assert np.allclose([r.n for r in unit], 1)
    top = np.zeros((2, 6))
    for r in cp.directions(m.where("comp < 2")).collect():
        top[r.comp, r.i] = r.value
    want = (x - x @ top.T @ top).std(0, ddof=1)
    got = {r.i: r.noise_std for r in cp.noise_deviation(df, "x", cp.directions(m.where("comp < 2"))).collect()}
    assert np.allclose([got[i] for i in range(6)], want)


def test_scans(spark, tmp_path):
    (tmp_path / "sub-1").mkdir()
    (tmp_path / "sub-1" / "a_motion.tsv").write_text("t\tframewise_displacement\n0\tn/a\n1\t0.2\n2\t\n3\tabc\n")
    (tmp_path / "sub-1" / "b_motion.tsv").write_text("framewise_displacement t\n 0.5 0\n")
    rows = io.scan_motion(spark, str(tmp_path), keys={"run": "([ab])_motion"}, glob="*_motion.tsv").orderBy("run", "frame").collect()
    assert [(r.run, r.frame, r.fd) for r in rows] == [("a", 0, None), ("a", 1, 0.2), ("a", 2, None), ("a", 3, None), ("b", 0, 0.5)]
    assert io.discover(spark, str(tmp_path), "*_motion.tsv", {"sub": "sub-([0-9]+)"}).where("sub = '1'").count() == 2
    (tmp_path / "m.par").write_text("1 2 3\n4 5\n")
    with pytest.raises(Exception, match="fewer than 3"):
        io.scan_matrix(spark, str(tmp_path / "m.par"), ["a", "b", "c"]).collect()
    (tmp_path / "ids.txt").write_text("z\n\na\n")
    assert [tuple(r) for r in io.scan_id_list(spark, str(tmp_path / "ids.txt")).collect()] == [(0, "z"), (1, "a")]


def test_outliers_and_votes(spark):
    df = spark.createDataFrame([("g", i, float(i % 5)) for i in range(40)] + [("g", 99, 1000.0)], "g string, i int, x double")
    assert [r.i for r in cp.mark_outliers(df, ["g"], "x", "i", checkpointed).where("outlier").collect()] == [99]
    v = spark.createDataFrame([(1, "a", 0.5, 0.9), (1, "b", 0.49, 0.9), (1, "c", 0.1, 0.9)], "comp int, m string, p double, b double")
    assert one(cp.votes(v, ["comp"], "m", "p", "b", 0.5, 2)).reclassify


def test_merged_sets_lengths(spark):
    df = spark.createDataFrame([([1.0] * 3, [2.0] * 2, [3.0])], "a array<double>, b array<double>, c array<double>")
    r = one(connectivity.merged_sets(df, "a", "b", "c"))
    assert [len(r[n]) for n in ("GG_GW", "GG_WW", "GW_WW", "GG_GW_WW")] == [5, 4, 3, 6]


def test_variance_sources_by_definition(spark):
    rng = np.random.default_rng(5)
    n, locs = 60, 4
    c, ica = rng.normal(size=(n, 2)), rng.normal(size=(n, 3))
    orig = 100 + rng.normal(size=(locs, n)) + rng.normal(size=(locs, 3)) @ ica.T + np.linspace(0, 3, n)
    hp = orig - orig.mean(1, keepdims=True) - np.linspace(-1.5, 1.5, n)
    rows = [(1, k, t, float(orig[k, t]), float(hp[k, t]), *map(float, c[t]), *map(float, ica[t])) for k in range(locs) for t in range(n)]
    df = spark.createDataFrame(rows, "run int, loc int, t int, x double, hp double, c1 double, c2 double, s1 double, s2 double, n1 double")
    got = {r.loc: r for r in cleaning.variance_sources(df, ["run"], "loc", "t", "x", "hp", ["c1", "c2"], ["s1", "s2"], ["n1"]).collect()}
    post = hp - (c @ (np.linalg.pinv(c) @ hp.T)).T
    beta = np.linalg.pinv(ica) @ post.T
    cleaned, noise, rest = post - (ica[:, 2:] @ beta[2:]).T, post - (ica[:, :2] @ beta[:2]).T, post - (ica @ beta).T
    var = lambda x: x.var(axis=1, ddof=1)
    want = {"high_pass_var": var(orig - hp), "motion_var": var(hp - post), "structured_var": var(noise - rest), "bold_var": var(cleaned - rest), "unstructured_var": var(rest)}
    want["shared_var"] = var(orig) - sum(want.values())
    want |= {"cnr": np.sqrt(want["bold_var"] / want["unstructured_var"]), "tsnr": orig.mean(1) / np.sqrt(want["unstructured_var"])}
    for name, series in (("cleaned", cleaned), ("noise", noise), ("unstructured", rest)):
        g = series.mean(0) - series.mean(0).mean()
        b = series @ g / (g @ g)
        want[f"{name}_mean_signal_var"] = b**2 * g.var(ddof=1)
        want[f"{name}_mean_signal_r2"] = 1 - var(series - np.outer(b, g)) / var(series)
    for k in range(locs):
        for name, v in want.items():
            assert got[k][name] == pytest.approx(v[k], abs=1e-9), name


def test_merged_pca(spark):
    rng = np.random.default_rng(6)
    low = rng.normal(size=(300, 3)) @ (rng.normal(size=(3, 12)) * [[9], [4], [2]])
    df = spark.createDataFrame([(list(map(float, v)),) for v in low] + [(None,)], "x array<double>")
    s = np.linalg.svd(low)[1] ** 2
    for parts, internal in ((1, 12), (7, 3), (5, 40)):  # three directions hold everything, whatever the blocks
        got = cp.merged_pca(df.repartition(parts), "x", 12, internal, 3, fan=2).collect()
        assert sorted({(r.comp, round(r.eigenvalue, 6)) for r in got}) == [(i, round(float(s[i]), 6)) for i in range(3)]
        w = np.zeros((3, 12))
        for r in got:
            w[r.comp, r.i] = r.value
        assert np.allclose(w.T @ w, low.T @ low)
    assert cp.merged_pca(df.where("x is null"), "x", 12, 4, 3).count() == 0
    with pytest.raises(Exception, match="not of length"):
        cp.merged_pca(df, "x", 11, 4, 3).collect()


def test_resumed_pca_equals_uninterrupted(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(f"s{i % 5}", list(map(float, rng.normal(size=8)))) for i in range(200)]
    df = spark.createDataFrame(rows, "s string, x array<double>").repartition(3, "s").sortWithinPartitions("s", "x")
    run = lambda name, most=None, internal=4: sorted(tuple(r) for r in cp.resumable_pca(df, "s", "x", 8, internal, 3, f"file://{tmp_path}/{name}", lambda d: d, most=most).collect())
    whole = run("whole")
    assert run("cut", 0) == []
    run("cut", 2)
    before = sorted(p.name for p in (tmp_path / "cut" / "blocks").iterdir())
    # a block whose manifest row was not committed is written again
    (tmp_path / "cut" / "blocks" / "2").mkdir()
    assert before == ["0", "1"] and run("cut") == whole and run("cut") == whole
    assert len(whole) == 24
    with pytest.raises(ValueError, match="other batches or parameters"):
        run("cut", internal=5)
    with pytest.raises(ValueError, match="other batches or parameters"):
        cp.resumable_pca(df.where("s <> 's1'"), "s", "x", 8, 4, 3, f"file://{tmp_path}/cut", lambda d: d)


def slow_peaks(v, height, distance):
    """Peaks by plain scans: every kept peak against all others, bases and crossings by walking."""
    top, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i - 1] < v[i] and j + 1 < len(v) and v[j + 1] < v[i] and v[i] >= height:
            top.append(i)
        i = j + 1
    kept = []
    for i in sorted(top, key=lambda i: (-v[i], i)):
        if all(abs(i - j) > distance for j in kept):
            kept.append(i)
    rows = []
    for i in sorted(kept):
        lo = next((j for j in range(i - 1, -1, -1) if v[j] > v[i]), 0)
        hi = next((j for j in range(i + 1, len(v)) if v[j] > v[i]), len(v) - 1)
        level = v[i] - (v[i] - max(min(v[lo : i + 1]), min(v[i : hi + 1]))) / 2
        a = next(j for j in range(i - 1, -1, -1) if v[j] <= level)
        b = next(j for j in range(i + 1, len(v)) if v[j] <= level)
        rows.append((v[i], b - (level - v[b]) / (v[b - 1] - v[b]) - (a + (level - v[a]) / (v[a + 1] - v[a]))))
    return rows


def test_peaks_equal_plain_scans():
    rng = np.random.default_rng(12)
    for n in (0, 1, 2, 3, 10, 64, 200):
        for _ in range(20):
            v = rng.integers(0, 6, n).astype(float) if rng.random() < 0.5 else np.cumsum(rng.normal(size=n))
            for height, distance in ((-100.0, 0), (0.5, 3), (2.0, 1)):
                p, w = cp.peak_table(v, height, distance)
                want = slow_peaks(v.tolist(), height, distance)
                assert np.allclose(np.column_stack([p, w]) if len(p) else np.zeros((0, 2)), np.array(want).reshape(-1, 2))


def test_peaks_of_a_long_series():
    import time

    v = np.concatenate([np.arange(300_000) % 2 + np.linspace(9, 1, 300_000), np.random.default_rng(1).normal(size=700_000)])  # a falling comb: every base reaches far
    t = time.time()
    assert len(cp.peak_table(v, 0.5, 1)[0]) > 100_000 and time.time() - t < 30


@pytest.mark.parametrize("piece", [1, 4096])
def test_lag_correlations_by_loops(spark, piece):
    rng = np.random.default_rng(13)
    at = {k: np.sort(rng.choice(150, 60 + 30 * i, replace=False)) - 40 for i, k in enumerate("ab")}
    rows = [(k, int(t), float(rng.normal()), float(rng.normal())) for k, ts in at.items() for t in ts]
    df = spark.createDataFrame(rows, "k string, t int, x double, y double").repartition(3)
    got = {(r.k, r.lag): r.xcorr for r in cp.lag_correlations(df, ["k"], "t", "x", "y", 7, piece).collect()}
    for k, ts in at.items():
        x, y = (np.array([r[c] for r in rows if r[0] == k]) for c in (2, 3))
        x, y, where = x - x.mean(), y - y.mean(), {int(t): i for i, t in enumerate(ts)}
        for lag in range(-7, 8):
            pairs = [x[where[t + lag]] * y[i] for t, i in where.items() if t + lag in where]
            assert got[k, lag] == pytest.approx(sum(pairs) / np.sqrt((x @ x) * (y @ y)), abs=1e-12)
    far = spark.createDataFrame([("a", 0, 1.0, 2.0), ("a", 5, 3.0, 1.0)], "k string, t int, x double, y double")
    assert sorted(r.lag for r in cp.lag_correlations(far, ["k"], "t", "x", "y", 7, piece).collect()) == [-5, 0, 5]
