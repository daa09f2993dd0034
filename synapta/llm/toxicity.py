"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from synapta.llm.common import CACHE_BYTES, ENTRY_BYTES, table, worker_cache
from synapta.llm.linear import Ftrl, fit_in_task, labelled_sample, scores

BITS = 21
SIZES = (3, 4, 5, 6)
SAMPLE_ROWS = 6_000
EPOCHS = 4
#: The L1 penalty is high on purpose: it leaves a few hundred n-grams, so that long texts do not add up noise.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 60.0, 1e-3
SMOOTHING = 1.0
THRESHOLD = 0.3

_word = re.compile(r"\w+")


class CharFeatures:
    """Ids of the character n-grams that a text has (each once): n-grams of its lower-case words with a blank at either end.

    ``useful`` limits them to ids of interest, such as those of non-zero weight; words without any then cost a look-up only.
    """

    def __init__(self, bits: int = BITS, sizes: tuple[int, ...] = SIZES, useful: np.ndarray | None = None):
        self.width, self.sizes, self.useful = 1 << bits, sizes, useful
        self.known: dict[str, np.ndarray | None] = {}
        self.held = 0  # estimated bytes

    def _learn(self, words: list[str]) -> None:
        """The n-grams of many words at once: hashes of all windows of their joined characters that stay in one word."""
        raw = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        word = np.repeat(np.arange(len(words)), size)
        grams, owner = [], []
        for n in self.sizes:
            m = len(raw) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ raw[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            g = (h % np.uint64(self.width)).astype(np.int32)
            keep = word[:m] == word[n - 1 :]
            if self.useful is not None:
                keep &= self.useful[g]
            grams.append(g[keep])
            owner.append(word[:m][keep])
        grams, owner = np.concatenate(grams), np.concatenate(owner)
        grams = grams[np.argsort(owner, kind="stable")]
        count = np.bincount(owner, minlength=len(words))
        ends = np.cumsum(count)
        self.known.update((w, grams[e - c : e].copy() if c else None) for w, c, e in zip(words, count.tolist(), ends.tolist()))
        self.held += sum(size.tolist()) + ENTRY_BYTES * len(words) + 120 * int((count > 0).sum()) + 4 * len(grams)

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        known = self.known
        if self.held > CACHE_BYTES:
            known.clear()
            self.held = 0
        words = [set(_word.findall(t.lower())) for t in texts]
        new = {w for ws in words for w in ws if w not in known}
        if new:
            self._learn(sorted(new))
        out = []
        for ws in words:
            parts = [g for g in map(known.__getitem__, ws) if g is not None]
            out.append(np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32))
        return out


def log_count_ratio(rows: list[tuple[np.ndarray, int]], width: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """log of (share of an n-gram among the toxic texts' n-grams / share among the others'), smoothed."""
    p, q = np.full(width, smoothing), np.full(width, smoothing)
    for at, y in rows:
        (p if y else q)[at] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit(rows, bits: int = BITS, epochs: int = EPOCHS) -> bytes:
    """Effective weights (ratio times learnt weight; float32, bias last) from (text, label) pairs."""
    features, data = CharFeatures(bits), []
    for text, y in rows:
        data.append((features.rows([text])[0], y))
    ratio = log_count_ratio(data, 1 << bits)
    model = Ftrl(1 << bits, ALPHA, BETA, L1, L2)
    for _ in range(epochs):
        for at, y in data:
            model.learn(at, ratio[at], y)
    w = model.weights()
    w[:-1] *= ratio
    return w.astype("<f4").tobytes()


def _scorer(model: bytes, bits: int) -> tuple[np.ndarray, CharFeatures]:
    weights = np.frombuffer(model, "<f4")
    return worker_cache(("n-grams", model, bits), lambda: (weights, CharFeatures(bits, useful=weights[:-1] != 0)))


def score_rows(model: bytes, texts: list[str], bits: int = BITS) -> list[float]:
    weights, features = _scorer(model, bits)
    return [float(1 / (1 + np.exp(-np.clip(float(weights[at].sum()) + float(weights[-1]), -35, 35)))) for at in features.rows(texts)]


def classify_toxicity(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a higher score means toxic is likelier.

    Learns from at most ``bound`` labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2). A null text
    is ''. Repeated rows and null ids are scored each; very long texts are scored whole; other columns are
    ignored. An empty table gives no rows. Without any example every score is 0.5. Scoring is narrow.
    """
    model = fit_in_task(labelled_sample(docs, labels, "toxic", bound), functools.partial(fit, bits=bits)) or bytes(4 * (1 << bits) + 4)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        return score_rows(shared.value, texts, bits)

    return scores(docs, score, threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
