"""Nested cross-validation by scores against the form by sums, against single fits and with permuted labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from synapta.operators import crossval as cv
from synapta.operators import models as md
from synapta.sources.io import checkpointed

SETS = {"A": (0, 7), "B": (7, 5), "AB": (0, 12)}


def cohort(spark, n=83, p=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    x[:, 3] = 1.5
    c = np.column_stack([np.ones(n), rng.integers(0, 2, n), rng.normal(size=n)])
    y = x[:, 0] - 0.5 * x[:, 8] + 0.3 * c[:, 2] + rng.normal(size=n)
    rows = [(int(i), float(y[i]), c[i].tolist(), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "subid bigint, y double, c array<double>, x array<double>").repartition(3), x, c, y


def records(df):
    return {(r.time_id, r.feature_set, r.fold): r for r in df.collect()}


def same(a, b, z):
    assert set(a) == set(b)
    for k, r in a.items():
        s = b[k]
        assert (r.n_comp, r.n_test) == (s.n_comp, s.n_test), k
        for c in ("corr", "mae"):
            assert r[c] == pytest.approx(s[c], abs=1e-7), (k, c)
        for c in ("w", "w_haufe"):
            assert np.allclose(r[c], s[c], atol=1e-6), (k, c)
        # an intercept may lie in the covariates' or in a constant feature's part
        assert np.allclose(z @ r.coef, z @ s.coef, atol=1e-6), k


PLAN = cv.Plan(times=2, k=4, folds=4, inner_repeats=3, inner_folds=3)


def test_scores_equal_sums(spark):
    df, x, c, _ = cohort(spark)
    sums = md.nested_cv(df, SETS, checkpointed, times=2, k=4, folds=4, inner_repeats=3, inner_folds=3, groups=2)
    same(records(cv.nested_cv_scores(df, SETS, checkpointed, PLAN, groups=3)), records(sums), np.column_stack([np.ones(len(x)), c, x]))


@pytest.mark.parametrize("permute", [None, "perm"])
def test_blocks_equal_one_cell(spark, permute):
    plan = cv.Plan(times=2, k=3, folds=4, inner_repeats=3, inner_folds=3, permute=permute)
    df, x, c, _ = cohort(spark)
    # 8 * 83 * 13 bytes hold all features but the columns of one inner repeat only
    batches = records(cv.nested_cv_scores(df, SETS, checkpointed, plan, cell_bytes=8 * 83 * 13, whole_bytes=1 << 20))
    blocks, cell = (records(cv.nested_cv_scores(df, SETS, checkpointed, plan, cell_bytes=b, whole_bytes=b)) for b in (8 * 83 * 5, 1 << 20))
    same(batches, cell, np.column_stack([np.ones(len(x)), c, x]))
    same(blocks, cell, np.column_stack([np.ones(len(x)), c, x]))


def test_permuted_labels_as_a_plain_loop(spark):
    plan = cv.Plan(times=3, k=3, folds=4, inner_repeats=2, inner_folds=3, permute="perm")
    df, x, c, y = cohort(spark)
    got = records(cv.nested_cv_scores(df, SETS, checkpointed, plan))
    order = sorted(range(len(y)), key=lambda i: (-y[i], i))
    pos = np.array(order)
    rows = df.select("subid", "y").withColumn("perm", F.explode(F.array(*map(F.lit, range(3))))).withColumn("fold", F.explode(F.array(*map(F.lit, range(4)))))
    outer = {t: dict(zip(pos.tolist(), md.outer_folds(pos, t, 4, "split").tolist())) for t in range(3)}
    where = spark.createDataFrame([(t, i, f) for t, v in outer.items() for i, f in v.items()], "perm int, subid bigint, mine int")
    rows = rows.join(where, ["perm", "subid"]).withColumn("is_train", F.col("mine") != F.col("fold"))
    # permutation 0 of permute_labels is the identity, here every repeat is drawn
    shifted = md.permute_labels(rows.withColumn("perm", F.col("perm") + 1), "y", "subid", "perm", ["perm", "fold"], "is_train")
    labels = {(r.perm - 1, r.fold, r.subid): r.y_perm for r in shifted.collect()}
    for t in range(3):
        for f in range(4):
            train = np.array([outer[t][i] != f for i in pos])
            drawn = cv.permuted(y[pos], pos, train, "perm", t, f)
            assert np.array_equal(np.sort(drawn), np.sort(y)) and np.array_equal(drawn[~train], y[pos][~train])
            assert [labels[t, f, int(i)] for i in pos] == cv.permuted(y[pos], pos, train, "perm", t + 1, f).tolist()
            tr, te = pos[train], pos[~train]
            b = np.linalg.lstsq(c[tr], x[tr], rcond=None)[0]
            free = x - c @ b
            free[:, 3] = 0.0  # constant but for rounding
            for name, (lo, n) in SETS.items():
                r = got[t, name, f]
                lab = np.empty(len(y))
                lab[pos] = drawn
                folds = []
                for rep in range(2):
                    folds.append(md.inner_split(len(tr), 3, [0, t, f, rep, 0]))
                k, _ = md.inner_choice(free[tr][:, lo : lo + n], lab[tr], np.array(folds), 3)
                coef, icpt = md.pls1_fit(free[tr][:, lo : lo + n], lab[tr], 3)
                pred = free[te][:, lo : lo + n] @ coef[k - 1] + icpt[k - 1]
                assert r.n_comp == k
                assert r.corr == pytest.approx(md._corr(pred, y[te]), abs=1e-7) and r.mae == pytest.approx(np.abs(pred - y[te]).mean(), abs=1e-7)


def test_no_subjects_and_too_many(spark):
    df, *_ = cohort(spark)
    assert cv.nested_cv_scores(df.where("subid < 0"), SETS, checkpointed, PLAN).collect() == []
    with pytest.raises(ValueError, match="too many subjects"):
        cv.nested_cv_scores(df, SETS, checkpointed, PLAN, cell_bytes=1000)


@pytest.mark.parametrize("permute", [None, "perm"])
def test_sums_by_pieces_equal_scores(monkeypatch, permute):
    """The fits of a fold by sums over pieces of rows against those by scores of whole columns."""
    monkeypatch.setattr(cv, "PIECE", 16)
    rng = np.random.default_rng(2)
    n, sets = 97, {"A": (0, 5), "AB": (0, 9)}
    x, c, y = rng.normal(size=(n, 9)), np.column_stack([np.ones(n), rng.normal(size=n)]), np.sort(rng.integers(0, 9, n))[::-1].astype(float)
    x[:, 2], x[:, 4] = 7.0, c[:, 1] * 3  # explained by the covariates
    ids, plan = np.arange(n), cv.Plan(k=4, folds=4, inner_repeats=3, inner_folds=3, permute=permute)
    outer = md.outer_folds(ids, 1, 4, "split")
    got = cv.Sums(plan, sets, ids, y, c, x, outer, 1, 2, range(3)).run()
    fold = cv.Fold(plan, ids, y, c, 1, 2, range(3))
    free, _ = fold.freed(x)
    mean, inverse = fold.scales(free)
    for i, (lo, count) in enumerate(sets.values()):
        at, s = slice(lo, lo + count), fold.start()
        for _ in range(4):
            fold.step(s, fold.share(free[:, at], mean[at], inverse[at], s["f"][0]))
        corr, error = np.array(s["corr"]), np.array(s["error"])
        assert np.allclose(got["corr"][i], corr[:, 1:], atol=1e-9) and np.allclose(got["error"][i], error[:, 1:], atol=1e-9)
        assert np.allclose(got["outer"][:, i], [corr[:, 0], error[:, 0]], atol=1e-9)


def test_more_subjects_than_columns_of_fits_hold(spark):
    """150,000 subjects with the usual sizes of cells; a constant feature."""
    n = 150_000
    h = lambda s: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 500 - 1
    df = spark.range(n).select(F.col("id").alias("subid"), (h(1) + h(2)).alias("y"), F.array(F.lit(1.0)).alias("c"), F.array(h(1), h(3), F.lit(2.0)).alias("x"))
    got = records(cv.nested_cv_scores(df, {"A": (0, 3)}, checkpointed, cv.Plan(times=1, k=2, folds=2, inner_repeats=2)))
    assert len(got) == 2 and sum(r.n_test for r in got.values()) == n
    assert all(r.corr == pytest.approx(np.sqrt(0.5), abs=0.01) for r in got.values())


def test_rounds_hold_no_column_of_subjects(spark):
    """Blocks of rows where a cell has only room for ids and labels, and whole features in tasks, equal sums."""
    plan = cv.Plan(times=1, k=2, folds=2, inner_repeats=2, inner_folds=3)
    df, x, c, _ = cohort(spark)
    cell = records(cv.nested_cv_scores(df, SETS, checkpointed, plan))
    rows, tasks = (records(cv.nested_cv_scores(df, SETS, checkpointed, plan, cell_bytes=b, whole_bytes=w)) for b, w in ((16 * 83, 1000), (1 << 20, 8000)))
    same(rows, cell, np.column_stack([np.ones(len(x)), c, x]))
    same(tasks, cell, np.column_stack([np.ones(len(x)), c, x]))
