"""Regression, resampling and partial least squares: residuals, scaling, splits, permutation, nested cross-validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from synapta.functions import seeded
from synapta.operators.scans import scan

# --- ordered positions, folds and permutation ---------------------------------------------------------------------


def block_folds(df: DataFrame, y: str, key: str, k: int, seed: str, checkpoint, by: list[str] = ()) -> DataFrame:
    """Subjects by descending y in blocks of k, each block dealt to the folds in seeded order (trap T12). ``by``: repeats.
    Positions are a scan over ranges; a window holds a block."""
    inside = Window.partitionBy(*by, "_block").orderBy(seeded(seed, *(F.col(c) for c in by), F.col(key)), key)
    out = scan(df, list(by), [F.desc(y), F.asc(key)], checkpoint, number="_pos").withColumn("_block", F.floor((F.col("_pos") - 1) / k))
    return out.withColumn("fold", (F.row_number().over(inside) - 1).cast("int")).drop("_block", "_pos")


def repeats(df: DataFrame, n: int, name: str = "time_id") -> DataFrame:
    """The task table, one copy of each row for each repeat; 0 is the observed one where repeats are permutations (trap T26)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def quantile_strata(df: DataFrame, y: str, bins: int, least: int) -> DataFrame:
    """quantile bins with equal edges dropped; fewer bins until each has ``least`` rows. All bin numbers are judged in one
    pass over the counts; a table that no number of bins fits is an error."""
    tries = list(range(bins, 1, -1))
    flat = sorted({i / b for b in tries for i in range(b + 1)})
    edges = df.agg(F.percentile(y, F.array(*map(F.lit, flat))).alias("q"))
    out = df.crossJoin(F.broadcast(edges))  # one row
    for b in tries:
        e = F.array_distinct(F.array(*(F.col("q")[flat.index(i / b)] for i in range(b + 1))))
        place = F.greatest(F.size(F.filter(e, lambda x: x < F.col(y))) - 1, F.lit(0))  # right-closed bins, the lowest value in the first
        out = out.withColumn(f"_s{b}", place)
    counts = out.select(F.explode(F.array(*(F.struct(F.lit(b).alias("b"), F.col(f"_s{b}").alias("s")) for b in tries))).alias("x")).groupBy("x.b", "x.s").count()
    fits = counts.groupBy("b").agg(F.min("count").alias("m"), F.count("*").alias("n")).where(f"m >= {least} and n >= 2").agg(F.max("b").alias("_use"))
    out = out.crossJoin(F.broadcast(fits))
    pick = F.raise_error(F.lit("no number of bins fits")).cast("int")
    for b in tries:
        pick = F.when(F.col("_use") == b, F.col(f"_s{b}")).otherwise(pick)
    return out.withColumn("stratum", pick.cast("int")).drop("q", "_use", *(f"_s{b}" for b in tries))


def half_split(df: DataFrame, stratum: str, key: str, seed: str) -> DataFrame:
    """Sides alternate within each stratum in seeded order."""
    w = Window.partitionBy(stratum).orderBy(seeded(seed, F.col(key)), key)
    return df.withColumn("side", F.when(F.row_number().over(w) % 2 == 1, "train").otherwise("test"))


def family_half_split(df: DataFrame, family: str, stratum: str, key: str, seed: str) -> DataFrame:
    """No family on both sides. Families are cut into strata by their median stratum; in each, large families first, they
    alternate in pairs (first to one side, next two to the other, and so on), which keeps sides within the largest family of
    each other."""
    fam = df.groupBy(family).agg(F.count(key).alias("_n"), F.percentile(stratum, F.lit(0.5)).cast("int").alias("_s"))
    w = Window.partitionBy("_s").orderBy(F.desc("_n"), seeded(seed, F.col(family)), family)
    side = fam.withColumn("_r", F.row_number().over(w)).withColumn("side", F.when((F.col("_r") % 4).isin(1, 0), "train").otherwise("test"))
    return df.join(side.select(family, "side"), family)


def check_split(df: DataFrame, key: str) -> DataFrame:
    """Each subject on one side only, else an error."""
    w = Window.partitionBy(key)
    return df.withColumn("side", F.when(F.min("side").over(w) == F.max("side").over(w), F.col("side")).otherwise(F.raise_error(F.lit("subject on both sides"))))


def permute_labels(df: DataFrame, y: str, key: str, seed: str, by: list[str], train: str) -> DataFrame:
    """Labels of the training rows exchanged within each of ``by`` (permutation, fold), the same for all feature sets of
    it (trap T15); other rows keep theirs. Permutation 0 is the identity."""
    w = Window.partitionBy(*by, train)
    rows = df.withColumn("_pos", F.row_number().over(w.orderBy(key)))
    order = F.when(F.col(by[0]) == 0, F.lit("")).otherwise(seeded(seed, *(F.col(c) for c in by), F.col(key)))
    drawn = df.select(*by, train, key, F.col(y).alias("y_perm")).withColumn("_pos", F.row_number().over(w.orderBy(order, key))).drop(key)
    out = rows.join(drawn.hint("merge"), [*by, train, "_pos"]).drop("_pos")  # Spark takes the copies for as few rows as they were made of
    return out.withColumn("y_perm", F.when(F.col(train), F.col("y_perm")).otherwise(F.col(y)))


#: Rows of the table of places that may be broadcast, two numbers each.
PLACES = 1_000_000


def permuted_copies(df: DataFrame, y: str, key: str, seed: str, n: int, train: str, checkpoint, name: str = "perm_id", most: int = PLACES) -> DataFrame:
    """`repeats` and `permute_labels` at once, for a ``train`` that is the same in all permutations: (name, key, y_perm). A key's place among
    the training rows is found once, the labels are drawn by one window a permutation, and only the places are joined to them."""
    learn = df.where(F.col(train)).select(key, y)
    places = checkpoint(scan(learn.select(key), [], [F.asc(key)], checkpoint, number="_pos"))
    places = F.broadcast(places) if places.count() <= most else places.hint("merge")
    order = F.when(F.col(name) == 0, F.lit("")).otherwise(seeded(seed, F.col(name), F.col(key)))
    # dealt before the window, so that the digests are made after the shuffle
    drawn = repeats(learn, n, name).repartition(name).withColumn("_pos", F.row_number().over(Window.partitionBy(name).orderBy(order, key)))
    out = drawn.select(name, F.col("_pos").cast("bigint").alias("_pos"), F.col(y).alias("y_perm")).join(places, "_pos").select(name, key, "y_perm")
    kept = df.where(~F.coalesce(F.col(train), F.lit(False))).select(key, F.col(y).alias("y_perm"))
    return out.unionByName(repeats(kept, n, name).select(name, key, "y_perm"))


# --- covariates and scaling ----------------------------------------------------------------------------------------


#: Levels of a category, each a column of the design.
LEVELS = 1_000


def design(df: DataFrame, categorical: list[str], numeric: list[str]) -> tuple[DataFrame, list[str]]:
    """An intercept, dummies of the categories but the first in sorted order, and the numbers, as columns. Levels are those of
    the whole cohort (trap T11); there are few of them."""
    names, df = ["_1"], df.withColumn("_1", F.lit(1.0))
    for c in categorical:
        levels = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().limit(LEVELS + 1).collect())
        if len(levels) > LEVELS:
            raise ValueError(f"{c} has more than {LEVELS} levels: not a category")
        for i, v in enumerate(levels[1:]):
            name = f"_{c}_{i}"
            df, names = df.withColumn(name, (F.col(c) == F.lit(v)).cast("double")), [*names, name]
    for c in numeric:
        df, names = df.withColumn(f"_{c}", F.col(c).cast("double")), [*names, f"_{c}"]
    return df, names


def least_squares(long: DataFrame, keys: list[str], regressors: list[str], y: str, tolerance: float = 1e-6, where: str | None = None) -> DataFrame:
    """(keys, beta) by normal equations with a pseudo-inverse: singular directions below ``tolerance`` are left out.

    The sums for each key are one aggregation with map-side combining; the k x k solve is a vectorised function over one
    row a key. ``where`` limits the rows that are fitted.
    """
    k = len(regressors)
    src = long.where(where) if where else long
    sums = [F.sum(F.col(a) * F.col(b)) for i, a in enumerate(regressors) for b in regressors[i:]] + [F.sum(F.col(a) * F.col(y)) for a in regressors]
    s = src.groupBy(*keys).agg(F.array(*sums).alias("_s"))
    upper = np.triu_indices(k)

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        if not len(s):
            return pd.Series([], dtype=object)
        v = np.nan_to_num(np.array([np.asarray(x, float) for x in s]))
        gram = np.zeros((len(v), k, k))
        gram[:, upper[0], upper[1]] = v[:, : len(upper[0])]
        gram = gram + np.transpose(np.triu(gram, 1), (0, 2, 1))
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", gram), 1e-300))
        unit = gram / scale[:, :, None] / scale[:, None, :]
        beta = np.einsum("nij,nj->ni", np.linalg.pinv(unit, rcond=tolerance * tolerance, hermitian=True), v[:, len(upper[0]) :] / scale) / scale
        return pd.Series(list(beta))

    return s.select(*keys, solve("_s").alias("beta"))


def fitted(beta: str, regressors: list[str], only: list[str] | None = None):
    """Column of the fit, or of the part of the regressors in ``only`` (L3)."""
    out = F.lit(0.0)
    for i, r in enumerate(regressors):
        if only is None or r in only:
            out = out + F.col(beta)[i] * F.col(r)
    return out


def residuals(long: DataFrame, keys: list[str], regressors: list[str], y: str, out: str, only: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Y minus its fit on the regressors (or on ``only`` those), fitted for each key on the rows of ``where``.
    beta is one short row a key, so the join back is on the same key as the sums."""
    b = least_squares(long, keys, regressors, y, where=where)
    joined = long.join(b, keys) if keys else long.crossJoin(F.broadcast(b))  # one row
    return joined.withColumn(out, F.col(y) - fitted("beta", regressors, only)).drop("beta")


def minmax(long: DataFrame, keys: list[str], x: str, train: str, out: str) -> DataFrame:
    """Scaled to the training rows' range, not clipped; a constant feature gives 0."""
    r = long.where(train).groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    scaled = F.coalesce(F.try_divide(F.col(x) - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))), F.lit(0.0))
    return long.join(r, keys).withColumn(out, scaled).drop("_lo", "_hi")


def zscore_or_zero(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """Population z-score, 0 where there is no variance (trap T13)."""
    m = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    return df.join(m, keys).withColumn(out, F.coalesce(F.try_divide(F.col(x) - F.col("_m"), F.nullif("_s", F.lit(0.0))), F.lit(0.0))).drop("_m", "_s")


# --- partial least squares -----------------------------------------------------------------------------------------


def pls1_fit(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and intercepts of PLS1 with 1 to k components (nested: one fit gives all). Columns and y are centred and scaled
    by the sample deviation, 0 by 1."""
    n, p = x.shape
    mx, my = x.mean(0), y.mean()
    sx, sy = (x.std(0, ddof=1), y.std(ddof=1)) if n > 1 else (np.ones(p), 1.0)
    sx = np.where(sx == 0, 1, sx)
    sy = sy if sy else 1.0
    e, f = (x - mx) / sx, (y - my) / sy
    w_all, p_all, q_all, coef = [], [], [], np.zeros((k, p))
    for a in range(k):
        w = e.T @ f
        norm = np.linalg.norm(w)
        if norm > 1e-12:
            w = w / norm
            t = e @ w
            tt = t @ t
            load, q = e.T @ t / tt, f @ t / tt
            e, f = e - np.outer(t, load), f - q * t
            w_all.append(w), p_all.append(load), q_all.append(q)
        if w_all:
            ww, pp = np.array(w_all).T, np.array(p_all).T
            coef[a] = ww @ np.linalg.solve(pp.T @ ww, np.array(q_all)) * sy / sx
    return coef, my - coef @ mx


def _corr(a: np.ndarray, b: np.ndarray) -> float:
    sa, sb = a.std(), b.std()
    return float(((a - a.mean()) * (b - b.mean())).mean() / (sa * sb)) if sa > 0 and sb > 0 else 0.0


def _scaled(x: np.ndarray, train: np.ndarray) -> np.ndarray:
    lo, hi = x[train].min(0), x[train].max(0)
    return np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0.0)


def inner_choice(x: np.ndarray, y: np.ndarray, folds: np.ndarray, k: int) -> tuple[int, np.ndarray]:
    """The number of components, by the summed z-scores of mean correlation and mean 1/MAE over repeats and folds.
    ``folds``: repeats by rows. Ties go to fewer components."""
    corr, inverse = [], []
    for rep in folds:
        c, m = [], []
        for j in np.unique(rep):
            train = rep != j
            xs = _scaled(x, train)  # refit on top of the outer scaling (trap T14)
            coef, icpt = pls1_fit(xs[train], y[train], k)
            pred = xs[~train] @ coef.T + icpt
            c.append([_corr(pred[:, a], y[~train]) for a in range(k)])
            mae = np.abs(pred - y[~train][:, None]).mean(0)
            m.append(np.where(mae > 0, 1 / np.where(mae > 0, mae, 1), 0))
        corr.append(c), inverse.append(m)
    z = np.zeros(k)
    for v in (np.mean(corr, axis=0).mean(0), np.mean(inverse, axis=0).mean(0)):
        z += (v - v.mean()) / v.std() if v.std() > 0 else 0
    return int(np.argmax(z)) + 1, z


RESULT = "time_id int, feature_set string, fold int, n_comp int, corr double, mae double, n_test bigint, w array<double>, w_haufe array<double>, coef array<double>"


def pls1_from_sums(gram: np.ndarray, k: int, columns: np.ndarray) -> np.ndarray:
    """Coefficients on (1, c, x) of PLS1 with 1 to k components, for a stack of sums over the rows to learn from, ``gram``: Z'Z of
    Z = (1, c, x, y) with x freed from c (see `freed`); ``columns``: those of x that take part.
    Scaling to a range needs no pass of its own here: columns are standardised, so any such scale cancels."""
    n = gram[:, 0, 0]
    at = np.r_[columns, gram.shape[1] - 1]
    m = gram[:, 0, at] / n[:, None]
    cov = gram[:, at[:, None], at[None, :]] - n[:, None, None] * m[:, :, None] * m[:, None, :]
    var = np.diagonal(cov, axis1=1, axis2=2)
    raw = np.diagonal(gram, axis1=1, axis2=2)[:, at]
    flat = (var <= 1e-12 * np.maximum(raw, 1e-300)) | (n[:, None] < 2)
    sd = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, var) / np.maximum(n - 1, 1)[:, None]))
    cov = np.where(flat[:, :, None] | flat[:, None, :], 0.0, cov / (sd[:, :, None] * sd[:, None, :]))
    g, v = cov[:, :-1, :-1].copy(), cov[:, :-1, -1].copy()
    first = np.linalg.norm(v, axis=1)
    coef, loads, turns = np.zeros(v.shape), [], []
    out = np.zeros((len(gram), k, gram.shape[1] - 1))
    for a in range(k):
        norm = np.linalg.norm(v, axis=1)
        go = norm > np.maximum(1e-10 * first, 1e-12)
        w = v / np.where(go, norm, 1)[:, None]
        gw = np.einsum("bij,bj->bi", g, w)
        tt = np.einsum("bi,bi->b", w, gw)
        go &= tt > 0
        tt = np.where(go, tt, 1.0)
        load, q = gw / tt[:, None], np.where(go, np.einsum("bi,bi->b", v, w) / tt, 0.0)
        turn = w.copy()
        for pj, rj in zip(loads, turns):
            turn -= np.einsum("bi,bi->b", pj, w)[:, None] * rj
        loads.append(np.where(go[:, None], load, 0.0)), turns.append(np.where(go[:, None], turn, 0.0))
        coef = coef + q[:, None] * turns[-1]
        v = v - (q * tt)[:, None] * loads[-1]
        g = g - tt[:, None, None] * loads[-1][:, :, None] * loads[-1][:, None, :]
        out[:, a, columns] = coef * sd[:, -1:] / sd[:, :-1]
        out[:, a, 0] = m[:, -1] - np.einsum("bi,bi->b", out[:, a, columns], m[:, :-1])
    return out


def freed(gram: np.ndarray, nc: int) -> np.ndarray:
    """The map T from (1, c, x, y) to (1, c, x freed from c, y), by the sums of the training rows (c holds its intercept). Features that c
    explains but for rounding become 0."""
    t, c, x = np.eye(len(gram)), slice(1, 1 + nc), slice(1 + nc, len(gram) - 1)
    # the same cut of singular values as a pseudo-inverse of c itself at 1e-6
    t[c, x] = -np.linalg.pinv(gram[c, c], rcond=1e-12, hermitian=True) @ gram[c, x]
    left = np.einsum("ij,ik,kj->j", t[:, x], gram, t[:, x])
    t[:, x] *= left > 1e-12 * np.diagonal(gram)[x]
    return t


def _sums_corr(gram: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """Correlation of predictions and y from the sums over the rows they are made for; ``coef``: models by columns. 0 without variance."""
    n = max(gram[0, 0], 1)
    cov = gram / n - np.outer(gram[0], gram[0]) / n**2
    vy, vp = cov[-1, -1], np.einsum("mi,ij,mj->m", coef, cov[:-1, :-1], coef)
    ok = (vy > 1e-12 * max(gram[-1, -1] / n, 1e-300)) & (vp > 1e-12)
    return np.where(ok, (coef @ cov[:-1, -1]) / np.sqrt(np.where(ok, vp * vy, 1.0)), 0.0)


#: Subjects of a chunk, the unit of work, at most, and its bytes; whole blocks of outer and inner folds.
CHUNK, CHUNK_BYTES = 60_000, 64 << 20
#: Tasks that share the repeats over one chunk.
GROUPS = 34


def outer_folds(subid: np.ndarray, time_id: int, folds: int, seed: str) -> np.ndarray:
    """`block_folds` with ``by`` time_id, of subjects in their order by descending y from a block's start."""
    import hashlib

    n = len(subid)
    h = [hashlib.md5(f"{seed}|{time_id}|{i}".encode()).hexdigest() for i in subid.tolist()] + ["g"] * (-n % folds)
    return np.array(h, "S32").reshape(-1, folds).argsort(axis=1, kind="stable").argsort(axis=1).ravel()[:n]


def inner_split(n: int, folds: int, key: list[int]) -> np.ndarray:
    """Inner folds of n training rows, dealt at random; the remainder goes to the first folds."""
    return np.random.default_rng(key).permutation(np.arange(n) % folds)


def nested_cv(
    subjects: DataFrame, sets: dict[str, tuple[int, int]], checkpoint, times: int = 101, k: int = 10, folds: int = 5, inner_repeats: int = 20, inner_folds: int = 5,
    fold_seed: str = "split", seed: int = 0, chunk: int = CHUNK, groups: int = GROUPS,
) -> DataFrame:
    """One result record for each (time_id, feature_set, fold).

    ``subjects``: subid, y, covariates c (array with intercept), x (array); ``sets``: name to first column of x and their number.
    In each model covariates are regressed out by the training rows, the number of components is chosen inside, weights and
    activation patterns (on features scaled to the training rows' range) have unit length; ``coef`` on (1, c, x) predicts a row.

    For many subjects with few features; `crossval.nested_cv_scores` is the form for up to 2 million subjects with any number of
    features. No task holds the cohort. Chunks of it give sums of products by (time_id, fold, inner repeat, inner fold); training sums are
    differences of these, and models are solved from them; errors and ranges come from a second pass of the models over the
    chunks. Both passes are spread over chunks and groups of repeats. A row of the models is one part and feature set (8 * k * columns bytes).
    """
    most = subjects.agg(F.max(F.size("c") + F.size("x") + 2)).first()[0] or 1
    size = max(1, min(chunk, CHUNK_BYTES // (8 * most)) // (folds * inner_folds)) * folds * inner_folds

    def matrix(row) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["z"], float).reshape(int(row["n"]), -1)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        z = np.column_stack([np.ones(len(pdf)), np.array(pdf["c"].tolist(), float), np.array(pdf["x"].tolist(), float), pdf["y"].to_numpy(float)])
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "n": [len(pdf)], "nc": [len(pdf["c"].iloc[0])], "ids": [pdf["subid"].to_numpy(np.int64).tobytes()], "z": [z.tobytes()]})

    placed = scan(subjects.select("subid", "y", "c", "x"), [], [F.desc("y"), F.asc("subid")], checkpoint, number="pos").withColumn("chunk", F.floor((F.col("pos") - 1) / size).cast("int"))
    packed = checkpoint(placed.groupBy("chunk").applyInPandas(pack, "chunk int, n int, nc int, ids binary, z binary"))
    spread = packed.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(min(groups, times) - 1))))
    times_of = lambda g: range(g, times, min(groups, times))

    def splits(row, time_id: int):
        """(fold, repeat, rows of each part); repeat -1: (test, training)."""
        ids, z = matrix(row)
        outer = outer_folds(ids, time_id, folds, fold_seed)
        for f in range(folds):
            train = np.flatnonzero(outer != f)
            yield f, -1, z, [np.flatnonzero(outer == f), train]
            for r in range(inner_repeats):
                part = inner_split(len(train), inner_folds, [seed, time_id, f, r, int(row["chunk"])])
                yield f, r, z, [train[part == j] for j in range(inner_folds)]

    def sums(batches):
        for row in (row for pdf in batches for _, row in pdf.iterrows()):
            for t in times_of(int(row["grp"])):
                out = []
                for f, r, z, parts in splits(row, t):
                    grams = np.array([z[i].T @ z[i] for i in parts])
                    up = np.triu_indices(z.shape[1])
                    out.append((t, f, r, int(row["nc"]), z.shape[1], grams[:, up[0], up[1]].tobytes()))
                yield pd.DataFrame(out, columns=["time_id", "fold", "rep", "nc", "width", "sums"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        width, nc, rep = int(row["width"]), int(row["nc"]), int(row["rep"])
        up = np.triu_indices(width)
        flat = sum(np.frombuffer(x, float) for x in pdf["sums"]).reshape(-1, len(up[0]))
        parts = np.zeros((len(flat), width, width))
        parts[:, up[0], up[1]] = flat
        parts[:, up[1], up[0]] = flat
        total = parts[1] if rep < 0 else parts.sum(0)
        t = freed(total, nc)
        fr = t.T @ parts @ t
        test = fr[:1] if rep < 0 else fr
        train = fr[1:] if rep < 0 else fr.sum(0) - fr
        coefs, corrs, patterns = [], [], []
        for first, count in sets.values():
            columns = 1 + nc + first + np.arange(count)
            co = pls1_from_sums(train, k, columns)
            corrs.append([_sums_corr(test[j], co[j]) for j in range(len(test))])
            if rep < 0:
                m = train[0][0] / train[0][0, 0]
                cov = (train[0] - train[0][0, 0] * np.outer(m, m)) / max(train[0][0, 0] - 1, 1)
                patterns.append(co[0] @ cov[:-1, :-1])
            coefs.append(co @ t[:-1, :-1].T)
        coef = np.array(coefs).transpose(1, 0, 2, 3)  # part, set, components, column
        corr = np.array(corrs).transpose(1, 0, 2)
        count = test[:, 0, 0]
        known = {"time_id": row["time_id"], "fold": row["fold"], "rep": rep}
        rows = [{**known, "part": j, "set": s, "coef": coef[j, s].tobytes()} for j in range(len(coef)) for s in range(len(coef[j]))]
        outer = {"coef": coef.tobytes(), "pattern": np.array(patterns).tobytes(), "free": t.tobytes()} if rep < 0 else {}
        return pd.DataFrame([{**known, "part": -1, "set": -1, "counts": count.tobytes(), "corr": corr.tobytes(), **outer}, *rows], columns=made)

    made = ["time_id", "fold", "rep", "part", "set", "counts", "corr", "coef", "pattern", "free"]
    grams = spread.repartition("chunk", "grp").mapInPandas(sums, "time_id int, fold int, rep int, nc int, width int, sums binary")
    solved = checkpoint(grams.groupBy("time_id", "fold", "rep").applyInPandas(solve, "time_id int, fold int, rep int, part int, set int, counts binary, corr binary, coef binary, pattern binary, free binary"))
    facts = solved.where("part < 0")

    def score(rows: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        row, out = rows.iloc[0], []
        m = m.sort_values(["part", "set"])
        free, model = {}, {}
        for a, b, c, j, x, y in zip(m["time_id"], m["fold"], m["rep"], m["part"], m["coef"], m["free"]):
            if j < 0:
                free[a, b] = y
            else:
                model.setdefault((a, b, c), []).append(np.frombuffer(x, float))
        for t in times_of(int(row["grp"])):
            for f, r, z, parts in splits(row, t):
                held = parts[:1] if r < 0 else parts
                co = np.concatenate(model[t, f, r]).reshape(len(held), -1, z.shape[1] - 1)
                error = np.array([np.abs(z[i, :-1] @ c.T - z[i, -1:]).sum(0) for i, c in zip(held, co)])
                lo = hi = b""
                if r < 0:
                    x = z[parts[1]] @ np.frombuffer(free[t, f], float).reshape(z.shape[1], -1)
                    if len(x):
                        lo, hi = x.min(0).tobytes(), x.max(0).tobytes()
                out.append((t, f, r, error.tobytes(), lo, hi))
        return pd.DataFrame(out, columns=["time_id", "fold", "rep", "error", "lo", "hi"])

    chunks = packed.count()
    known = solved.where("part >= 0 or rep < 0").select("time_id", "fold", "rep", "part", "set", F.when(F.col("part") >= 0, F.col("coef")).alias("coef"), "free", (F.col("time_id") % min(groups, times)).alias("grp"))
    known = known.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(max(chunks, 1) - 1))))
    scored = spread.groupBy("chunk", "grp").cogroup(known.groupBy("at", "grp")).applyInPandas(score, "time_id int, fold int, rep int, error binary, lo binary, hi binary")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums over chunks; a few numbers each."""
        first = pdf.iloc[0]
        read = lambda c: [np.frombuffer(x, float) for x in pdf[c] if len(x)]
        lo, hi = read("lo"), read("hi")
        return pd.DataFrame([{"time_id": first["time_id"], "fold": first["fold"], "rep": first["rep"], "error": sum(read("error")).tobytes(), "lo": np.min(lo, axis=0).tobytes() if lo else b"", "hi": np.max(hi, axis=0).tobytes() if hi else b""}])

    errors = scored.groupBy("time_id", "fold", "rep").applyInPandas(merge, "time_id int, fold int, rep int, error binary, lo binary, hi binary")
    kept = facts.select("time_id", "fold", "rep", "counts", "corr", "coef", "pattern").join(errors, ["time_id", "fold", "rep"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        n_sets, inverse, corr, held = len(sets), [], [], None
        for _, row in pdf.iterrows():
            n, shape = np.frombuffer(row["counts"], float), (-1, n_sets, k)
            mae = np.frombuffer(row["error"], float).reshape(shape) / np.maximum(n, 1)[:, None, None]
            c = np.frombuffer(row["corr"], float).reshape(shape)
            if row["rep"] < 0:
                held = row, n[0], mae[0], c[0]
            else:
                corr.append(c)
                inverse.append(np.where(mae > 0, 1 / np.where(mae > 0, mae, 1), 0))
        row, n, mae, c = held
        coef = np.frombuffer(row["coef"], float).reshape(n_sets, k, -1)
        pattern = np.frombuffer(row["pattern"], float).reshape(n_sets, k, -1)
        width = (np.frombuffer(row["hi"], float) - np.frombuffer(row["lo"], float))[:-1]
        unit = lambda v: (v / np.linalg.norm(v)).tolist() if np.linalg.norm(v) > 0 else v.tolist()
        out = []
        for s, (name, (first, count)) in enumerate(sets.items()):
            z = np.zeros(k)
            for v in (np.mean(corr, axis=0).mean(0)[s], np.mean(inverse, axis=0).mean(0)[s]):
                z += (v - v.mean()) / v.std() if v.std() > 0 else 0
            a = int(np.argmax(z))
            x = slice(len(width) - x_width + first, len(width) - x_width + first + count)
            w, h = coef[s, a, x] * width[x], np.where(width[x] > 0, pattern[s, a, x] / np.where(width[x] > 0, width[x], 1), 0)
            out.append({"time_id": row["time_id"], "feature_set": name, "fold": row["fold"], "n_comp": a + 1, "corr": c[s, a], "mae": mae[s, a], "n_test": int(n), "w": unit(w), "w_haufe": unit(h), "coef": coef[s, a].tolist()})
        return pd.DataFrame(out)

    x_width = max(first + count for first, count in sets.values())
    return kept.groupBy("time_id", "fold").applyInPandas(choose, RESULT)


def pls1_long(long: DataFrame, subject: str, f: str, x: str, y: str, k: int, checkpoint=lambda d: d) -> tuple[DataFrame, list[DataFrame]]:
    """J4, path A: one large model over (subject, f, x, y) by two aggregations a component; (scores, weights of each component).

    x and y are standardised first. Each round: w from sums over subjects, t from sums over features, loadings from sums over
    subjects again; deflation is a projection. ``checkpoint`` cuts the lineage of a round (see synapta.sources.io.checkpointed).
    """
    moments = long.groupBy(f).agg(F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    ys = long.select(subject, y).distinct()
    ys = ys.crossJoin(F.broadcast(ys.agg(F.avg(y).alias("_m"), F.stddev_samp(y).alias("_s")))).select(subject, ((F.col(y) - F.col("_m")) / F.col("_s")).alias("_y"))
    e = long.join(moments, f).select(subject, f, F.coalesce(F.try_divide(F.col(x) - F.col("_m"), F.nullif("_s", F.lit(0.0))), F.lit(0.0)).alias("_x"))
    e = checkpoint(e.join(ys, subject))
    scores, weights = ys, []
    for a in range(k):
        w = e.groupBy(f).agg(F.sum(F.col("_x") * F.col("_y")).alias("_w"))
        norm = w.agg(F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_n"))
        w = w.crossJoin(F.broadcast(norm)).select(f, F.coalesce(F.try_divide("_w", F.nullif("_n", F.lit(0.0))), F.lit(0.0)).alias("_w"))
        t = checkpoint(e.join(w, f).groupBy(subject).agg(F.sum(F.col("_x") * F.col("_w")).alias("_t"), F.first("_y").alias("_y")))
        tt = t.agg(F.sum(F.col("_t") * F.col("_t")).alias("_tt"), F.sum(F.col("_t") * F.col("_y")).alias("_ty"))
        joined = e.drop("_y").join(t, subject).crossJoin(F.broadcast(tt))
        load = joined.groupBy(f).agg(F.try_divide(F.sum(F.col("_x") * F.col("_t")), F.nullif(F.first("_tt"), F.lit(0.0))).alias("_p"))
        q = F.coalesce(F.try_divide("_ty", F.nullif("_tt", F.lit(0.0))), F.lit(0.0))
        scores = scores.join(t.crossJoin(F.broadcast(tt)).select(subject, F.col("_t").alias(f"t{a + 1}"), (q * F.col("_t")).alias(f"fit{a + 1}")), subject)
        weights.append(w)
        if a + 1 < k:
            e = checkpoint(joined.join(load, f).select(subject, f, (F.col("_x") - F.col("_t") * F.coalesce("_p", F.lit(0.0))).alias("_x"), (F.col("_y") - q * F.col("_t")).alias("_y")))
    return scores, weights


def haufe(long: DataFrame, scores: DataFrame, subject: str, f: str, x: str, score: str) -> DataFrame:
    """Covariance of each feature with the score, of unit length over the features; no feature-by-feature matrix."""
    c = long.join(scores.select(subject, score), subject).groupBy(f).agg(F.covar_samp(x, score).alias("_c"))
    n = c.agg(F.sqrt(F.sum(F.col("_c") * F.col("_c"))).alias("_n"))
    return c.crossJoin(F.broadcast(n)).select(f, F.try_divide("_c", F.nullif("_n", F.lit(0.0))).alias("w_haufe"))


def fold_metrics(pred: DataFrame, run: list[str], fold: str, y: str, yhat: str) -> DataFrame:
    """MAE, 1/MAE and correlation of each fold, then their means over folds (trap T16)."""
    from synapta.functions import pearson

    mae = F.avg(F.abs(F.col(yhat) - F.col(y)))
    each = pred.groupBy(*run, fold).agg(mae.alias("mae"), F.try_divide(F.lit(1.0), F.nullif(mae, F.lit(0.0))).alias("mae_inv"), pearson(F.col(y), F.col(yhat)).alias("corr"))
    return each.groupBy(*run).agg(F.avg("corr").alias("mean_corr"), F.avg("mae").alias("mean_mae"), F.avg("mae_inv").alias("mean_mae_inv"), F.count("*").alias("n_folds"))
