"""Nested cross-validation of PLS1: few features by sums of products, many by scores.

With few features a fit needs only sums of products over its training rows, and those of an inner fit are the fold's without the inner test part.
So a task that holds an outer fold goes twice over the rows: for the sums of all inner parts, and for the absolute errors of all fits (`Sums`).
Subjects may be any number that a task can hold the ids and labels of.

With many features the whole of which a task can hold, all fits of a fold advance together, as columns of one matrix (`Fold`). A component of PLS1 is
t = X D X' f, made orthogonal to the components before it, where f is what of y is not explained yet and D the inverse variances of the features over
the training rows. So no coefficients and no matrix of features by features are needed.

With more features than that, t = X r with r by the loadings so far, as in `_fits`: each component is a pass of tasks over blocks of rows, which give X' t
over each fit's training rows (and the errors of the components before); states have a row a feature and none a subject.
"""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import pickle
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synapta.operators.models import RESULT, inner_split, outer_folds
from synapta.operators.scans import scan

#: Bytes of the ids and labels that a task holds, at most.
CELL_BYTES = 32 << 20
#: Bytes of the states of a fold where a task advances all its fits.
STATE_BYTES = 8 << 20
#: Bytes of the sums of a fold's inner parts up to which fits go by sums; bytes of the features that a task keeps in memory.
WHOLE_BYTES = 64 << 20
#: Tasks that share the repeats where fits go by sums, and bytes that they all read at most (a dozen tasks at least).
GROUPS, SPREAD_BYTES = 64, 4 << 30
#: Rows of a piece of the features, which stays near the processor.
PIECE = 2_048
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@dataclasses.dataclass(frozen=True)
class Plan:
    """What a run of nested cross-validation is; everything random follows from it."""

    times: int = 101
    k: int = 10
    folds: int = 5
    inner_repeats: int = 20
    inner_folds: int = 5
    fold_seed: str = "split"
    seed: int = 0
    #: Seed of permuted training labels (J16, J17); none: the labels as they are.
    permute: str | None = None


def permuted(y: np.ndarray, ids: np.ndarray, train: np.ndarray, seed: str, time_id: int, fold: int) -> np.ndarray:
    """`permute_labels` of one (time_id, fold): the labels of the training rows exchanged, those of the others kept."""
    rows = np.flatnonzero(train)
    to = rows[np.argsort(ids[rows], kind="stable")]
    head = f"{seed}|{time_id}|{fold}|"
    digests = b"".join(hashlib.md5(f"{head}{i}".encode()).digest() for i in ids[rows].tolist())
    high, low = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2).T
    drawn = rows[np.lexsort((ids[rows], low, high))]
    out = y.copy()
    out[to] = y[drawn]
    return out


#: The parts of a state (see Fold.start).
STATE = ["f", "p", "t", "tt", "first", "r", "a", "yhat", "corr", "error"]


class Fold:
    """The fits of one outer fold. Column 0 learns on the fold's training rows, the others on those of inner folds; ``repeats`` are the
    inner repeats that take part."""

    def __init__(self, plan: Plan, ids: np.ndarray, y: np.ndarray, c: np.ndarray, time_id: int, fold: int, repeats: range):
        self.plan, self.c, n = plan, c, len(ids)
        self.train = outer_folds(ids, time_id, plan.folds, plan.fold_seed) != fold
        rows = np.flatnonzero(self.train)
        self.y = permuted(y, ids, self.train, plan.permute, time_id, fold) if plan.permute else y
        width = 1 + len(repeats) * plan.inner_folds
        self.mask, self.test = np.zeros((n, width)), np.zeros((n, width))
        self.mask[:, 0], self.test[:, 0] = self.train, ~self.train
        for i, r in enumerate(repeats):
            part = inner_split(len(rows), plan.inner_folds, [plan.seed, time_id, fold, r, 0])
            for j in range(plan.inner_folds):
                at = 1 + i * plan.inner_folds + j
                self.mask[rows[part != j], at], self.test[rows[part == j], at] = 1.0, 1.0
        self.n, self.n_test = self.mask.sum(0), self.test.sum(0)
        self.mean = self.y @ self.mask / np.maximum(self.n, 1)
        self.sd = np.sqrt(np.maximum(((self.y[:, None] - self.mean) ** 2 * self.mask).sum(0) / np.maximum(self.n - 1, 1), 0))
        self.sd[self.sd == 0] = 1.0
        t = np.maximum(self.n_test, 1)
        self.vy = ((y := self.y)[:, None] - y @ self.test / t) ** 2 * self.test
        self.vy = self.vy.sum(0) / t
        gram = c[self.train].T @ c[self.train]
        self.project = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ c[self.train].T

    def freed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features without what the covariates explain on the training rows, and the covariates' coefficients. A feature that they
        explain but for rounding is 0."""
        b = self.project @ x[self.train]
        free = x - self.c @ b
        left, whole = (np.einsum("ij,ij->j", v[self.train], v[self.train]) for v in (free, x))
        free[:, left <= 1e-20 * whole] = 0.0
        return free, b

    def scales(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Means and inverse variances of freed features over the training rows of each fit; 0 for a constant feature."""
        n = np.maximum(self.n, 1)
        mean, raw = x.T @ self.mask / n, (x * x).T @ self.mask
        var = raw - n * mean * mean
        flat = (var <= 1e-12 * np.maximum(raw, 1e-300)) | (self.n < 2)
        return mean, np.where(flat, 0.0, (n - 1) / np.where(flat, 1.0, var))

    def start(self) -> dict[str, list[np.ndarray]]:
        """Matrices f (unexplained, 0 but on training rows) and p (predicted); lists with an entry a component: t (components), tt (their
        squares), corr and error; first (norms of the first round); of column 0 alone: r (weights of rows that give a component), a
        and yhat (of coefficients and predictions)."""
        return {"f": [(self.y[:, None] - self.mean) * self.mask], "p": [np.tile(self.mean, (len(self.y), 1))], **{k: [] for k in STATE[2:]}}

    def share(self, x: np.ndarray, mean: np.ndarray, inverse: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Part of these features of X D X' f, over all rows, centred on each fit's training rows."""
        u = (x.T @ f) * inverse
        return x @ u - (mean * u).sum(0)

    def step(self, s: dict[str, list[np.ndarray]], z: np.ndarray) -> None:
        """One more component, from the sum of all shares."""
        f, p, dot, other = s["f"][0], s["p"][0], functools.partial(np.einsum, "nm,nm->m"), np.empty_like(z)
        explained = dot(f, z)  # f has nothing of the components before, so they may go from z later
        norm = np.sqrt(np.maximum(explained, 0)) / self.sd
        if not s["first"]:
            s["first"].append(norm)
        go = norm > np.maximum(1e-10 * s["first"][0], 1e-12)
        r = f[:, 0].copy()
        for t, tt, old in zip(s["t"], s["tt"], s["r"]):
            np.multiply(t, self.mask, out=other)
            c = dot(other, z) / tt
            np.multiply(t, c, out=other)
            z -= other
            r -= c[0] * old
        np.multiply(z, self.mask, out=other)
        tt = dot(other, z)
        go &= tt > 0
        tt = np.where(go, tt, 1.0)
        z *= go
        other *= go
        q = np.where(go, explained / tt, 0.0)
        other *= q
        f -= other
        np.multiply(z, q, out=other)
        p += other
        corr, error = self.judge(p)
        s["a"].append((s["a"][-1] if s["a"] else 0) + q[0] * r)
        for k, v in {"t": z, "tt": tt, "r": r * go[0], "yhat": p[:, 0].copy(), "corr": corr, "error": error}.items():
            s[k].append(v)

    def judge(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Correlation (0 without variance) and mean absolute error on each fit's test rows."""
        n, y = np.maximum(self.n_test, 1), self.y
        my = y @ self.test / n
        d = p - my
        dt = d * self.test
        mp, vp = dt.sum(0) / n, np.einsum("nm,nm->m", dt, d) / n
        cov, vy = y @ dt / n - mp * my, self.vy
        vp = vp - mp * mp
        ok = (vy > 1e-12 * np.maximum((y * y) @ self.test / n, 1e-300)) & (vp > 1e-12)
        corr = np.where(ok, cov / np.sqrt(np.where(ok, vp * vy, 1.0)), 0.0)
        np.subtract(p, y[:, None], out=d)
        np.abs(d, out=d)
        return corr, np.einsum("nm,nm->m", d, self.test) / n

    def weights(self, x: np.ndarray, b: np.ndarray, mean: np.ndarray, inverse: np.ndarray, a: np.ndarray, yhat: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the outer fit: coefficients, their covariates' part and mean part, range and pattern of each feature."""
        coef = (x.T @ a) * inverse[:, 0]
        pattern = x[self.train].T @ (yhat - yhat[self.train].mean())[self.train] / max(self.n[0] - 1, 1)
        spread = x[self.train].max(0) - x[self.train].min(0)
        return coef, -b @ coef, mean[:, 0] @ coef, spread, pattern


def chosen(corr: np.ndarray, error: np.ndarray, plan: Plan) -> int:
    """Components (from 0) of the largest sum of z-scores of mean correlation and mean 1 / MAE over the inner fits; ties to fewer."""
    z = np.zeros(plan.k)
    inverse = np.where(error > 0, 1 / np.where(error > 0, error, 1), 0)
    for v in (corr.mean(1), inverse.mean(1)):
        z += (v - v.mean()) / v.std() if v.std() > 0 else 0
    return int(np.argmax(np.round(z, 9)))


def _unit(v: np.ndarray) -> list[float]:
    norm = np.linalg.norm(v)
    return (v / norm).tolist() if norm > 0 else v.tolist()


def _result(time_id: int, name: str, fold: int, a: int, corr: float, error: float, n_test: float, intercept: float, on_c: np.ndarray, parts: list[tuple], width: int) -> dict:
    """A record of RESULT; ``parts``: (first feature, coefficients, ranges, patterns) in order."""
    coef, spread, pattern = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
    full = np.zeros(width)
    for first, v, *_ in parts:
        full[first : first + len(v)] = v
    haufe = np.where(spread > 0, pattern / np.where(spread > 0, spread, 1), 0)
    return {
        "time_id": time_id, "feature_set": name, "fold": fold, "n_comp": a + 1, "corr": float(corr), "mae": float(error), "n_test": int(n_test),
        "w": _unit(coef * spread), "w_haufe": _unit(haufe), "coef": [float(intercept), *on_c.tolist(), *full.tolist()],
    }


def _cohort(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["y"], float), np.frombuffer(row["c"], float).reshape(len(ids), -1)


def nested_cv_scores(subjects: DataFrame, sets: dict[str, tuple[int, int]], checkpoint, plan: Plan = Plan(), cell_bytes: int = CELL_BYTES, groups: int = GROUPS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """One result record for each (time_id, feature_set, fold), as `models.nested_cv` gives them.

    ``subjects``: subid, y, covariates c (array with intercept), x (array); ``sets``: name to first feature and their number.
    With ``plan.permute`` each repeat learns on permuted training labels and is judged on true ones.

    Where the sums of products of a fold's inner parts take up to ``whole_bytes``, fits go by sums in tasks that share the repeats; a task reads all
    features once (float32 if nothing is lost by that), in a file of its own beyond ``whole_bytes``. More features travel whole to the tasks up to
    ``whole_bytes``; beyond that each component is a pass over blocks of rows, whose state is written by ``checkpoint`` (`_in_rounds`). Subjects are
    bounded by their ids and labels in a cell (2 million at 32 MB), else an error.
    """
    one = subjects.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"), F.max(F.size("c")).alias("nc")).first()
    n, used = one["n"], max(first + count for first, count in sets.values())
    if not n:
        return subjects.sparkSession.createDataFrame([], RESULT)
    if n * 16 > cell_bytes:
        raise ValueError("too many subjects for a task's ids and labels; use models.nested_cv")
    placed = checkpoint(scan(subjects.select("subid", "y", "c"), [], [F.desc("y"), F.asc("subid")], checkpoint, number="pos"))  # without the wide rows
    if 8 * (used + 2) ** 2 * plan.inner_repeats * plan.inner_folds <= whole_bytes:
        return _in_tasks(subjects, placed, sets, plan, n, one["nc"], used, groups, checkpoint, cell_bytes, whole_bytes)
    if 8 * n * used > whole_bytes:
        return _in_rounds(subjects, placed, sets, plan, n, one["nc"], used, checkpoint, cell_bytes)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        v = {"ids": pdf["subid"].to_numpy(np.int64), "y": pdf["y"].to_numpy(float), **{k: np.array(pdf[k].tolist(), float) for k in "cx"}}
        return pd.DataFrame([{k: x.tobytes() for k, x in v.items()}])

    rows = subjects.select("subid", F.slice("x", 1, used).alias("x")).join(placed, "subid")
    cell = checkpoint(rows.groupBy(F.col("pos") < 0).applyInPandas(whole, "ids binary, y binary, c binary, x binary"))  # up to ``whole_bytes``
    return _scores_in_tasks(cell, sets, plan, used, groups, _batches(plan, n, min(cell_bytes, STATE_BYTES)))


def _fits(sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (fits, k, features) and intercepts of PLS1 with 1 to k components, for a stack of sums of products of (features, y, 1) over
    the rows to learn from. Features and y are standardised; constant ones give 0. Scores' weights r give t = X r, so the matrix of
    products is never deflated."""
    n = sums[:, -1, -1]
    mean = sums[:, -1, :-1] / np.maximum(n, 1)[:, None]
    cov = sums[:, :-1, :-1] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    var, raw = (np.diagonal(v, axis1=1, axis2=2)[:, : len(sums[0]) - 1] for v in (cov, sums))
    flat = (var <= 1e-12 * np.maximum(raw, 1e-300)) | (n[:, None] < 2)
    sd = np.sqrt(np.where(flat, 1.0, var) / np.maximum(n - 1, 1)[:, None])
    scale = np.where(flat, 0.0, 1 / sd)
    g, v = cov[:, :-1, :-1] * scale[:, :-1, None] * scale[:, None, :-1], cov[:, :-1, -1] * scale[:, :-1] * scale[:, -1:]
    dot, first = functools.partial(np.einsum, "bi,bi->b"), np.linalg.norm(v, axis=1)
    loads, turns, coef, out = [], [], np.zeros(v.shape), []
    for _ in range(k):
        norm = np.linalg.norm(v, axis=1)
        go = norm > np.maximum(1e-10 * first, 1e-12)
        w = v / np.where(go, norm, 1)[:, None]
        r = w.copy()
        for load, turn in zip(loads, turns):
            r -= dot(load, w)[:, None] * turn
        gr = np.matmul(g, r[:, :, None])[:, :, 0]
        tt = dot(r, gr)
        go &= tt > 0
        load, r = np.where(go[:, None], gr / np.where(go, tt, 1.0)[:, None], 0.0), r * go[:, None]
        q = dot(v, w) * go / np.where(go, tt, 1.0)  # v has nothing of the components before
        v = v - (q * tt)[:, None] * load
        coef = coef + q[:, None] * r
        loads.append(load), turns.append(r), out.append(coef)
    beta = np.stack(out, 1) * (np.where(flat[:, -1:], 1.0, sd[:, -1:]) * scale[:, :-1])[:, None]
    return beta, mean[:, None, -1] - np.einsum("bkp,bp->bk", beta, mean[:, :-1])


def _sums_judge(sums: np.ndarray, beta: np.ndarray, y_mean: float) -> np.ndarray:
    """Correlations (fits, k) of predictions and y from the sums over each fit's test rows, y without ``y_mean``; 0 without variance."""
    n = np.maximum(sums[:, -1, -1], 1)
    mean = sums[:, -1, :-1] / n[:, None]
    cov = sums[:, :-1, :-1] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    vp = (np.matmul(beta, cov[:, :-1, :-1]) * beta).sum(2)
    vy, raw = cov[:, -1, -1], sums[:, -2, -2] / n + 2 * y_mean * mean[:, -1] + y_mean * y_mean
    ok = (vy > 1e-12 * np.maximum(raw, 1e-300))[:, None] & (vp > 1e-12)
    return np.where(ok, np.einsum("bkp,bp->bk", beta, cov[:, :-1, -1]) / np.sqrt(np.where(ok, vp * vy[:, None], 1.0)), 0.0)


class Sums:
    """The fits of one outer fold and some inner repeats by sums of products of (features, y, 1) over the inner parts. Two passes over pieces of
    rows: sums of all parts, then errors of all fits."""

    def __init__(self, plan: Plan, sets: dict[str, tuple[int, int]], ids: np.ndarray, y: np.ndarray, c: np.ndarray, x: np.ndarray, outer: np.ndarray, time_id: int, fold: int, repeats: range):
        self.plan, self.sets, self.c, self.x = plan, sets, c, x
        train = outer != fold
        self.rows, self.held = np.flatnonzero(train), np.flatnonzero(~train)
        y = permuted(y, ids, train, plan.permute, time_id, fold) if plan.permute else y
        self.y_mean = float(y[self.rows].mean()) if len(self.rows) else 0.0
        self.y = y - self.y_mean
        kind = np.min_scalar_type(plan.inner_folds)
        self.part = [inner_split(len(self.rows), plan.inner_folds, [plan.seed, time_id, fold, r, 0]).astype(kind) for r in repeats]
        gram, cx, self.whole = np.zeros((c.shape[1],) * 2), np.zeros((c.shape[1], x.shape[1])), np.zeros(x.shape[1])
        for at in self.pieces(self.rows):
            u, v = c[at], x[at].astype(float, copy=False)
            gram += u.T @ u
            cx += u.T @ v
            self.whole += np.einsum("ij,ij->j", v, v)
        self.b = np.linalg.pinv(gram, rcond=1e-12, hermitian=True) @ cx

    @staticmethod
    def pieces(rows: np.ndarray):
        for lo in range(0, len(rows), PIECE):
            yield rows[lo : lo + PIECE]

    def block(self, at: np.ndarray) -> np.ndarray:
        """Features without what the covariates explain, y, 1."""
        p = self.x.shape[1]
        z = np.ones((len(at), p + 2))
        np.subtract(self.x[at], self.c[at] @ self.b, out=z[:, :p])
        z[:, p] = self.y[at]
        return z

    def dealt(self):
        """(rows of a piece, [the rows by inner part and where the parts end, for each repeat]), in the same memory each time."""
        room = np.empty((min(PIECE, len(self.rows)), self.x.shape[1] + 2))
        for lo, at in zip(range(0, len(self.rows), PIECE), self.pieces(self.rows)):
            z = self.block(at)

            def repeats(z=z, lo=lo):
                for i, part in enumerate(self.part):
                    part = part[lo : lo + PIECE]
                    by = z.take(np.argsort(part, kind="stable"), 0, out=room[: len(z)], mode="clip")
                    yield i, by, np.cumsum(np.bincount(part, minlength=self.plan.inner_folds)).tolist()

            yield z, repeats()

    def run(self) -> dict:
        folds, p = self.plan.inner_folds, self.x.shape[1]
        parts, total, test = np.zeros((len(self.part), folds, p + 2, p + 2)), np.zeros((p + 2, p + 2)), np.zeros((p + 2, p + 2))
        low, high = np.full(p, np.inf), np.full(p, -np.inf)
        for z, repeats in self.dealt():
            total += z.T @ z
            low, high = np.minimum(low, z[:, :p].min(0)), np.maximum(high, z[:, :p].max(0))
            for i, by, ends in repeats:
                for j, (a, b) in enumerate(zip([0, *ends], ends[:-1])):
                    v = by[a:b]
                    parts[i, j] += v.T @ v
        parts[:, -1] = total - parts[:, :-1].sum(1)  # the last part is what the others leave
        for at in self.pieces(self.held):
            z = self.block(at)
            test += z.T @ z
        gone = np.flatnonzero(np.diagonal(total)[:p] <= 1e-20 * self.whole)  # explained by the covariates but for rounding
        for v in (total, test, parts):
            v[..., gone, :] = 0.0
            v[..., :, gone] = 0.0
        parts = parts.reshape(-1, p + 2, p + 2)
        learn = np.concatenate([total[None], total - parts])
        judge = np.concatenate([test[None], parts])
        models, corr, betas = [], [], []
        for first, count in self.sets.values():
            at = np.r_[first : first + count, p, p + 1]
            beta, icpt = _fits(learn[:, at[:, None], at], self.plan.k)
            corr.append(_sums_judge(judge[:, at[:, None], at], beta, self.y_mean))
            w = np.zeros((len(learn), p + 2, self.plan.k))  # a column gives the error of a row
            w[:, first : first + count], w[:, p], w[:, p + 1] = beta.transpose(0, 2, 1), -1.0, icpt
            models.append(w), betas.append(beta[0])
        w = np.ascontiguousarray(np.concatenate(models, 2))
        error = self.errors(w) / np.maximum(judge[:, -1, -1], 1)[:, None]
        error = error.reshape(len(judge), len(self.sets), -1).transpose(1, 2, 0)
        corr = np.array(corr).transpose(0, 2, 1)  # set, components, fit
        mean = total[-1, :p] / max(total[-1, -1], 1)
        cov = (total[:p, :p] - total[-1, -1] * np.outer(mean, mean)) / max(total[-1, -1] - 1, 1)
        spread = np.where(high > low, high - low, 0.0)
        spread[gone] = 0.0
        free = self.b.copy()
        free[:, gone] = 0.0
        pattern = [beta @ cov[first : first + count, first : first + count] for beta, (first, count) in zip(betas, self.sets.values())]
        return {
            "corr": corr[:, :, 1:], "error": error[:, :, 1:], "outer": np.stack([corr[:, :, 0], error[:, :, 0]]), "coef": np.hstack(betas), "pattern": np.hstack(pattern),
            "spread": spread, "b": free, "mean": mean, "y_mean": np.array([self.y_mean + total[-1, p] / max(total[-1, -1], 1), test[-1, -1]]),
        }

    def errors(self, w: np.ndarray) -> np.ndarray:
        """Summed absolute errors (fits, columns) over each fit's test rows."""
        out, room, ones = np.zeros((len(w), w.shape[2])), np.empty((PIECE, w.shape[2])), np.ones(PIECE)

        def add(fit: int, z: np.ndarray) -> None:
            e = np.matmul(z, w[fit], out=room[: len(z)])
            np.abs(e, out=e)
            out[fit] += ones[: len(z)] @ e

        for at in self.pieces(self.held):
            add(0, self.block(at))
        for _, repeats in self.dealt():
            for i, by, ends in repeats:
                for j, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
                    add(1 + i * self.plan.inner_folds + j, by[a:b])
        return out


#: What a unit of work gives (see Sums.run), as bytes.
GIVEN = ["corr", "error", "outer", "coef", "pattern", "spread", "b", "mean", "y_mean"]


def _held(shape: tuple[int, ...], kind, whole_bytes: int) -> np.ndarray:
    """An empty array, of over ``whole_bytes`` in a file of the task."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size <= whole_bytes:
        return np.empty(shape, kind)
    with tempfile.TemporaryFile() as f:
        f.truncate(size)
        return np.memmap(f, kind, "r+", shape=shape)


def _in_tasks(subjects: DataFrame, placed: DataFrame, sets: dict[str, tuple[int, int]], plan: Plan, n: int, nc: int, width: int, groups: int, checkpoint, cell_bytes: int, whole_bytes: int) -> DataFrame:
    spark, per = subjects.sparkSession, max(1, min(PIECE, cell_bytes // (8 * (width + nc + 2))))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = np.array(pdf["x"].tolist(), float)
        short = x.astype(np.float32)
        x = short if np.array_equal(short, x, equal_nan=True) else x  # half the bytes where nothing is lost
        ids, y, c = pdf["subid"].to_numpy(np.int64), pdf["y"].to_numpy(float), np.array(pdf["c"].tolist(), float)
        return pd.DataFrame([{"chunk": int(pdf["chunk"].iloc[0]), "ids": ids.tobytes(), "y": y.tobytes(), "c": c.tobytes(), "x": x.tobytes(), "short": x.dtype == np.float32}])

    chunk = F.floor((F.col("pos") - 1) / per).cast("int").alias("chunk")
    rows = subjects.select("subid", F.slice("x", 1, width).alias("x")).join(placed.select("subid", "y", "c", "pos", chunk), "subid")
    cells = checkpoint(rows.groupBy("chunk").applyInPandas(cut, "chunk int, ids binary, y binary, c binary, x binary, short boolean"))
    short = cells.where("not short").isEmpty()
    size = n * (width * (4 if short else 8) + 8 * nc + 16)  # what each task reads
    share = min(groups, max(12, SPREAD_BYTES // size), plan.times * plan.folds * plan.inner_repeats)
    steps = max(1, min(plan.inner_repeats, share // (plan.times * plan.folds)))  # tasks that share the inner repeats of a fold
    repeats = [range(i * plan.inner_repeats // steps, (i + 1) * plan.inner_repeats // steps) for i in range(steps)]
    units = plan.times * plan.folds * steps
    share = min(share, units)

    def run(batches):
        ids, y, c = np.empty(n, np.int64), np.empty(n), np.empty((n, nc))
        x, groups_here = _held((n, width), np.float32 if short else float, whole_bytes), set()
        for pdf in batches:
            for _, row in pdf.iterrows():
                v = np.frombuffer(row["ids"], np.int64)
                at = slice(int(row["chunk"]) * per, int(row["chunk"]) * per + len(v))
                ids[at], y[at], c[at] = v, np.frombuffer(row["y"], float), np.frombuffer(row["c"], float).reshape(-1, nc)
                x[at] = np.frombuffer(row["x"], np.float32 if row["short"] else float).reshape(-1, width)
                groups_here.add(int(row["grp"]))
        outer = functools.lru_cache(1)(lambda t: outer_folds(ids, t, plan.folds, plan.fold_seed))
        for g in sorted(groups_here):
            for unit in range(g * units // share, (g + 1) * units // share):
                job, step = divmod(unit, steps)
                t, f = divmod(job, plan.folds)
                got = Sums(plan, sets, ids, y, c, x, outer(t), t, f, repeats[step]).run()
                out = pd.DataFrame([{"time_id": t, "fold": f, "step": step, **{k: got[k].tobytes() for k in GIVEN}}])
                yield finish(out) if steps == 1 else out

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        """All inner fits of a fold: the number of components for each set, and the outer fit with it."""
        pdf = pdf.sort_values("step")
        read = lambda name, *shape: [np.frombuffer(v, float).reshape(shape) for v in pdf[name]]
        corr, error = (np.concatenate(read(name, len(sets), plan.k, -1), 2) for name in ("corr", "error"))
        outer, coef, pattern, spread, b, mean = (read(*v)[0] for v in (("outer", 2, len(sets), plan.k), ("coef", plan.k, -1), ("pattern", plan.k, -1), ("spread", -1), ("b", nc, -1), ("mean", -1)))
        y_mean, n_test = read("y_mean", -1)[0]
        out, past = [], 0
        for i, (name, (lo, count)) in enumerate(sets.items()):
            a, at, here = chosen(corr[i], error[i], plan), slice(lo, lo + count), slice(past, past + count)
            w, past = coef[a, here], past + count
            parts = [(lo, w, spread[at], pattern[a, here])]
            out.append(_result(int(pdf["time_id"].iloc[0]), name, int(pdf["fold"].iloc[0]), a, outer[0, i, a], outer[1, i, a], n_test, y_mean - mean[at] @ w, -b[:, at] @ w, parts, width))
        return pd.DataFrame(out)

    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(8 << 20))
    spread = cells.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
    spread = spread.repartitionByRange(share, "grp")
    if steps == 1:
        return spread.mapInPandas(run, RESULT)
    given = spread.mapInPandas(run, "time_id int, fold int, step int, " + ", ".join(f"{k} binary" for k in GIVEN))
    return given.groupBy("time_id", "fold").applyInPandas(finish, RESULT)


def _batches(plan: Plan, n: int, cell_bytes: int) -> list[range]:
    """Inner repeats that go together: a state is some k + 3 matrices of a column a fit, which fit a cell."""
    step = max(1, min(plan.inner_repeats, (cell_bytes // (8 * n * (plan.k + 3)) - 1) // plan.inner_folds))
    return [range(lo, min(lo + step, plan.inner_repeats)) for lo in range(0, plan.inner_repeats, step)]


def _scores_in_tasks(cells: DataFrame, sets: dict[str, tuple[int, int]], plan: Plan, width: int, groups: int, batches_of: list[range]) -> DataFrame:
    share = min(groups, plan.times * plan.folds)

    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                ids, y, c = _cohort(row)
                x = np.frombuffer(row["x"], float).reshape(len(ids), -1)
                for job in range(int(row["grp"]), plan.times * plan.folds, share):
                    t, f = divmod(job, plan.folds)
                    outer: dict[str, tuple] = {}
                    inner: dict[str, list[tuple]] = {name: [] for name in sets}
                    free = b = None
                    for repeats in batches_of:
                        fold = Fold(plan, ids, y, c, t, f, repeats)
                        free, b = fold.freed(x) if free is None else (free, b)
                        mean, inverse = fold.scales(free)
                        for name, (lo, count) in sets.items():
                            at = slice(lo, lo + count)
                            s = fold.start()
                            for _ in range(plan.k):
                                fold.step(s, fold.share(free[:, at], mean[at], inverse[at], s["f"][0]))
                            corr, error = np.array(s["corr"]), np.array(s["error"])
                            inner[name].append((corr[:, 1:], error[:, 1:]))
                            if name not in outer:  # column 0 is the same in each batch
                                outer[name] = fold, mean[at, :1], inverse[at, :1], s["a"], s["yhat"], corr[:, 0], error[:, 0]
                    out = []
                    for name, (lo, count) in sets.items():
                        fold, mean, inverse, alphas, fits, corr, error = outer[name]
                        at, a = slice(lo, lo + count), chosen(*(np.hstack(v) for v in zip(*inner[name])), plan)
                        coef, on_c, shift, spread, pattern = fold.weights(free[:, at], b[:, at], mean, inverse, alphas[a], fits[a])
                        out.append(_result(t, name, f, a, corr[a], error[a], fold.n_test[0], fold.mean[0] - shift, on_c, [(lo, coef, spread, pattern)], width))
                    yield pd.DataFrame(out)

    spread = cells.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(share - 1))))
    return spread.repartitionByRange(share, "grp").mapInPandas(run, RESULT)


def _in_rounds(subjects: DataFrame, placed: DataFrame, sets: dict[str, tuple[int, int]], plan: Plan, n: int, nc: int, width: int, checkpoint, cell_bytes: int) -> DataFrame:
    spark, size = subjects.sparkSession, max(count for _, count in sets.values())
    # fits (columns) of a job, whose state of some 2 k + 4 matrices of a row a feature fits a cell
    some = max(1, min(plan.inner_repeats, (cell_bytes // (8 * size * (2 * plan.k + 4)) - 1) // plan.inner_folds))
    batches = [range(lo, min(lo + some, plan.inner_repeats)) for lo in range(0, plan.inner_repeats, some)]
    jobs = plan.times * plan.folds * len(batches)
    fits = lambda job: 1 + len(batches[job % len(batches)]) * plan.inner_folds
    together = max(1, cell_bytes // (8 * (width + nc) * (1 + some * plan.inner_folds) * len(sets)))  # jobs that go through the rows at once
    per = max(1, min(PIECE, cell_bytes // (4 * 8 * (width + nc + 2))))
    kind = np.min_scalar_type(plan.inner_folds + 1)
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(8 << 20))

    def cohort(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"ids": [pdf["subid"].to_numpy(np.int64).tobytes()], "y": [pdf["y"].to_numpy(float).tobytes()]})

    def deal(pieces):
        """Of each job and chunk: labels (permuted ones on training rows), and the inner part of each row in each repeat (inner_folds: held out)."""
        for pdf in pieces:
            for _, row in pdf.iterrows():
                ids, y, job = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["y"], float), int(row["job"])
                tf, batch = divmod(job, len(batches))
                t, f = divmod(tf, plan.folds)
                train = outer_folds(ids, t, plan.folds, plan.fold_seed) != f
                part = np.full((len(batches[batch]), n), plan.inner_folds, kind)
                for i, r in enumerate(batches[batch]):
                    part[i, train] = inner_split(int(train.sum()), plan.inner_folds, [plan.seed, t, f, r, 0])
                drawn = permuted(y, ids, train, plan.permute, t, f) if plan.permute else y
                for at in range(0, n, per):
                    here = slice(at, at + per)
                    yield pd.DataFrame([{"chunk": at // per, "job": job, "train": train[here].tobytes(), "part": part[:, here].tobytes(), "y": drawn[here].tobytes()}])

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        c = np.column_stack([np.array(pdf["c"].tolist(), float), np.ones(len(pdf))])
        return pd.DataFrame([{"chunk": int(pdf["chunk"].iloc[0]), "c": c.tobytes(), "x": np.array(pdf["x"].tolist(), float).tobytes()}])

    people = placed.groupBy(F.col("pos") < 0).applyInPandas(cohort, "ids binary, y binary")  # a few numbers a subject, bounded above
    dealt = spark.range(0, jobs, 1, min(jobs, 64)).select(F.col("id").cast("int").alias("job")).crossJoin(F.broadcast(people)).mapInPandas(deal, "chunk int, job int, train binary, part binary, y binary")
    dealt = checkpoint(dealt)
    chunk = F.floor((F.col("pos") - 1) / per).cast("int").alias("chunk")
    rows = subjects.select("subid", F.slice("x", 1, width).alias("x")).join(placed.select("subid", "c", "pos", chunk), "subid")
    cells = checkpoint(rows.repartition(F.col("chunk")).groupBy("chunk").applyInPandas(cut, "chunk int, c binary, x binary"))

    def masks(d, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that each fit learns on and is judged on."""
        train = np.frombuffer(d["train"], bool)
        part = np.frombuffer(d["part"], kind).reshape(-1, len(train))
        learn, judge = np.empty((len(train), m)), np.empty((len(train), m))
        learn[:, 0], judge[:, 0] = train, ~train
        for i, v in enumerate(part):
            for j in range(plan.inner_folds):
                at = 1 + i * plan.inner_folds + j
                judge[:, at] = v == j
                learn[:, at] = train & (v != j)
        return learn, judge

    def passed(group: range, work, models: DataFrame | None) -> DataFrame:
        """Sums over all rows of what ``work`` gives for each job: a dict of arrays, summed by name (low, high: least and greatest)."""
        merge = lambda a, b: {k: (np.minimum if k == "low" else np.maximum if k == "high" else np.add)(a[k], v) for k, v in b.items()} if a else b

        fitted = models is not None

        def over(pieces):
            held: dict[int, dict] = {}
            for pdf in pieces:
                for _, row in pdf.iterrows():
                    c = np.frombuffer(row["c"], float).reshape(-1, nc + 1)
                    x = np.frombuffer(row["x"], float).reshape(len(c), -1)
                    known = pickle.loads(row["models"]) if fitted else {}
                    for d in row["deals"]:
                        job = d["job"]
                        held[job] = merge(held.get(job), work(x, c, np.frombuffer(d["y"], float), *masks(d, fits(job)), known.get(job)))
            for job, v in held.items():
                yield pd.DataFrame([{"job": job, "sums": pickle.dumps(v)}])

        def add(pieces):
            held: dict[int, dict] = {}
            for pdf in pieces:
                for job, v in zip(pdf["job"], pdf["sums"]):
                    held[job] = merge(held.get(job), pickle.loads(v))
            for job, v in held.items():
                yield pd.DataFrame([{"job": job, "sums": pickle.dumps(v)}])

        mine = dealt.where((F.col("job") >= group.start) & (F.col("job") < group.stop)).groupBy("chunk").agg(F.collect_list(F.struct("job", "train", "part", "y")).alias("deals"))
        both = cells.join(F.broadcast(mine) if n * len(group) * (some + 9) <= cell_bytes else mine, "chunk")
        both = both if models is None else both.crossJoin(F.broadcast(models))
        return checkpoint(both.mapInPandas(over, "job int, sums binary").repartition(len(group), "job").mapInPandas(add, "job int, sums binary"))

    def gathered(states: DataFrame, name: str) -> DataFrame:
        """One row with what the next pass needs of all jobs."""
        one = lambda pdf: pd.DataFrame({"models": [pickle.dumps({int(j): pickle.loads(v) for j, v in zip(pdf["job"], pdf[name])})]})
        return states.groupBy(F.col("job") < 0).applyInPandas(one, "models binary")

    def moments(x, c, y, learn, judge, _):
        train = learn[:, :1]
        return {"cc": c.T @ (c * train), "cx": c.T @ (x * train), "xx": (train[:, 0] @ (x * x)), "n": learn.sum(0), "y": y @ learn, "n_test": judge.sum(0), "y_test": y @ judge, "yy_test": (y * y) @ judge}

    def spreads(x, c, y, learn, judge, m):
        free = x - c @ m["b"]
        at = free[learn[:, 0] > 0]
        ends = {"low": at.min(0), "high": at.max(0)} if len(at) else {"low": np.full(width, np.inf), "high": np.full(width, -np.inf)}
        f = (y[:, None] - m["y_mean"]) * learn
        return {"sum": free.T @ learn, "square": (free * free).T @ learn, "xf": free.T @ f, "ff": (f * f).sum(0), "vy": (((y[:, None] - m["y_test"]) ** 2) * judge).sum(0), **ends}

    def advance(x, c, y, learn, judge, m):
        """Products of the scores of the next component with all columns; sums of what the components so far predict."""
        out = {}
        for name, (lo, count) in sets.items():
            at = x[:, lo : lo + count]
            if "turn" in m:
                v = m["turn"][name]
                t = (at @ v[:count] + c @ v[count:]) * learn
                out[f"x {name}"], out[f"c {name}"] = at.T @ t, c.T @ t
            if "fit" in m:
                v = m["fit"][name]
                e = (at @ v[:count] + c @ v[count:]) * judge  # predictions without the mean of y
                out[f"p {name}"], out[f"pp {name}"], out[f"py {name}"] = e.sum(0), (e * e).sum(0), np.einsum("ij,ij->j", e, (y[:, None] - m["y_test"]) * judge)
                out[f"error {name}"] = (np.abs(e + m["y_mean"] - y[:, None]) * judge).sum(0)
        return out

    def free_of(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pickle.loads(pdf["sums"].iloc[0])
        b = np.zeros((nc + 1, width))
        b[:nc] = np.linalg.pinv(s["cc"][:nc, :nc], rcond=1e-12, hermitian=True) @ s["cx"][:nc]
        m = {"b": b, "y_mean": s["y"] / np.maximum(s["n"], 1), "y_test": s["y_test"] / np.maximum(s["n_test"], 1)}
        facts = {**m, "n": s["n"], "n_test": s["n_test"], "yy_test": s["yy_test"], "xx": s["xx"]}
        return pd.DataFrame([{"job": pdf["job"].iloc[0], "facts": pickle.dumps(facts), "models": pickle.dumps(m)}])

    def turned(facts: dict, name: str, v: np.ndarray) -> np.ndarray:
        """Weights of standardised features as those of (features, covariates, 1)."""
        lo, count = sets[name]
        v = v * facts["scale"][lo : lo + count]
        on_c = -facts["b"][:, lo : lo + count] @ v
        on_c[-1] -= (facts["mean"][lo : lo + count] * v).sum(0)
        return np.concatenate([v, on_c])

    def next_turn(s: dict) -> np.ndarray:
        norm = np.linalg.norm(s["v"], axis=0)
        s["first"] = s.get("first", norm)
        s["go"] = norm > np.maximum(1e-10 * s["first"], 1e-12)
        s["w"] = s["v"] / np.where(s["go"], norm, 1)
        r = s["w"].copy()
        for load, turn in zip(s["loads"], s["turns"]):
            r -= (load * s["w"]).sum(0) * turn
        return r

    def packed(job: int, facts: dict, states: dict, last: bool) -> pd.DataFrame:
        m = {k: facts[k] for k in ("y_mean", "y_test")}
        if not last:
            for name, s in states.items():
                s["r"] = next_turn(s)
            m["turn"] = {name: turned(facts, name, s["r"]) for name, s in states.items()}
        if any(len(s["turns"]) for s in states.values()):
            m["fit"] = {name: turned(facts, name, s["coef"] * facts["sd"]) for name, s in states.items()}
        return pd.DataFrame([{"job": job, "facts": pickle.dumps(facts), "state": pickle.dumps(states), "models": pickle.dumps(m)}])

    def begin(before: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        facts, s = pickle.loads(before["facts"].iloc[0]), pickle.loads(got["sums"].iloc[0])
        n_, mean = facts["n"], s["sum"] / np.maximum(facts["n"], 1)
        var = s["square"] - n_ * mean * mean
        flat = (var <= 1e-12 * np.maximum(s["square"], 1e-300)) | (n_ < 2)
        flat |= (s["square"][:, 0] <= 1e-20 * facts["xx"])[:, None]  # explained by the covariates but for rounding
        sd = np.sqrt(s["ff"] / np.maximum(n_ - 1, 1))
        facts |= {"mean": mean, "scale": np.where(flat, 0.0, np.sqrt((n_ - 1) / np.where(flat, 1.0, var))), "sd": np.where(sd == 0, 1.0, sd), "spread": np.where(flat[:, 0] | (s["high"] <= s["low"]), 0.0, s["high"] - s["low"]), "vy": s["vy"]}
        states = {name: {"v": s["xf"][lo : lo + c] * facts["scale"][lo : lo + c] / facts["sd"], "loads": [], "turns": [], "coef": np.zeros((c, len(n_))), "pattern": np.zeros(c), "corr": [], "error": [], "outer": []} for name, (lo, c) in sets.items()}
        return packed(int(before["job"].iloc[0]), facts, states, False)

    def step(before: pd.DataFrame, got: pd.DataFrame, last: bool) -> pd.DataFrame:
        facts, states, sums = (pickle.loads(v) for v in (before["facts"].iloc[0], before["state"].iloc[0], got["sums"].iloc[0]))
        for name, s in states.items():
            lo, count = sets[name]
            if f"p {name}" in sums:
                judged(facts, s, *(sums[f"{k} {name}"] for k in ("p", "pp", "py", "error")))
            if f"x {name}" not in sums:
                continue
            on_c = sums[f"c {name}"]
            gr = facts["scale"][lo : lo + count] * (sums[f"x {name}"] - facts["b"][:, lo : lo + count].T @ on_c - facts["mean"][lo : lo + count] * on_c[-1])
            tt = (s["r"] * gr).sum(0)
            go = s["go"] & (tt > 0)
            load, r = np.where(go, gr / np.where(go, tt, 1.0), 0.0), s["r"] * go
            q = (s["v"] * s["w"]).sum(0) * go / np.where(go, tt, 1.0)
            s["v"] = s["v"] - (q * tt) * load
            s["coef"], s["pattern"] = s["coef"] + q * r, s["pattern"] + q[0] * gr[:, 0] * go[0]
            s["loads"].append(load), s["turns"].append(r)
            at = slice(lo, lo + count)
            scale = facts["scale"][at, 0]
            coef = s["coef"][:, 0] * scale * facts["sd"][0]
            s["outer"].append((coef, np.where(scale > 0, s["pattern"] / np.where(scale > 0, scale, 1), 0) * facts["sd"][0] / max(facts["n"][0] - 1, 1)))
        return packed(int(before["job"].iloc[0]), facts, states, last)

    def judged(facts: dict, s: dict, p: np.ndarray, pp: np.ndarray, py: np.ndarray, error: np.ndarray) -> None:
        n_ = np.maximum(facts["n_test"], 1)
        vp, vy = pp / n_ - (p / n_) ** 2, facts["vy"] / n_
        ok = (vy > 1e-12 * np.maximum(facts["yy_test"] / n_, 1e-300)) & (vp > 1e-12)
        s["corr"].append(np.where(ok, py / n_ / np.sqrt(np.where(ok, vp * vy, 1.0)), 0.0)), s["error"].append(error / n_)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        """All inner fits of a fold: the number of components for each set, and the outer fit (column 0 of the first batch) with it."""
        pdf = pdf.sort_values("job")
        t, f = divmod(int(pdf["job"].iloc[0]) // len(batches), plan.folds)
        facts, states, out = pickle.loads(pdf["facts"].iloc[0]), [pickle.loads(v) for v in pdf["state"]], []
        for name, (lo, count) in sets.items():
            corr, error = (np.hstack([np.array(s[name][k])[:, 1:] for s in states]) for k in ("corr", "error"))
            a, s, at = chosen(corr, error, plan), states[0][name], slice(lo, lo + count)
            coef, pattern = s["outer"][a]
            b = facts["b"][:nc, at]
            parts = [(lo, coef, facts["spread"][at], pattern)]
            out.append(_result(t, name, f, a, s["corr"][a][0], s["error"][a][0], facts["n_test"][0], facts["y_mean"][0] - facts["mean"][at, 0] @ coef, -b @ coef, parts, width))
        return pd.DataFrame(out)

    def go_on(before: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return step(before, got, False)

    def final(before: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        return step(before, got, True)

    done, schema = None, "job int, facts binary, state binary, models binary"
    for lo in range(0, jobs, together):
        group = range(lo, min(lo + together, jobs))
        pair = lambda a, b, f: checkpoint(a.groupBy("job").cogroup(b.groupBy("job")).applyInPandas(f, schema))
        known = checkpoint(passed(group, moments, None).groupBy("job").applyInPandas(free_of, "job int, facts binary, models binary"))
        states = pair(known, passed(group, spreads, gathered(known, "models")), begin)
        for k in range(plan.k + 1):
            states = pair(states, passed(group, advance, gathered(states, "models")), final if k >= plan.k - 1 else go_on)
        part = states.drop("models")
        done = part if done is None else done.unionByName(part)
    return done.groupBy(F.floor(F.col("job") / len(batches))).applyInPandas(finish, RESULT)
