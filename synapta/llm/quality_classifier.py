"""Quality classifier: hashed word n-gram logistic regression, learnt by follow-the-regularised-leader updates."""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from synapta.llm.common import CACHE_BYTES, ENTRY_BYTES, table, worker_cache
from synapta.llm.linear import Ftrl, fit_in_task, labelled_sample, scores

BITS = 18
#: At most so many labelled documents are learnt from.
SAMPLE_ROWS = 6_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-4
THRESHOLD = 0.7

_token = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Marks that stand beside words: a word in capitals, a token that repeats the one before it.
CAPITALS, SAME = (np.uint32(zlib.crc32(x)) for x in (b"<capitals>", b"<same>"))


class WordFeatures:
    """Sparse rows of hashed word 1-grams and 2-grams, scaled to length 1. Words and punctuation runs are tokens."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known, self.chars = np.uint32((1 << bits) - 1), {}, 0

    def hashes(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if self.chars + ENTRY_BYTES * len(known) > CACHE_BYTES:
            known.clear()
            self.chars = 0
        got = list(map(known.get, tokens))
        if None in got:
            for i, h in enumerate(got):
                if h is None:
                    t = tokens[i]
                    self.chars += len(t)
                    # bit 32: in capitals
                    got[i] = known[t] = zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) | (len(t) > 1 and t.isupper()) << 32
        return np.array(got, np.uint64)

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        full = self.hashes(_token.findall(text))
        if not len(full):
            return np.zeros(0, np.int64), np.zeros(0)
        h = full.astype(np.uint32)
        two = (h[:-1] * np.uint32(2654435761)) ^ (h[1:] + np.uint32(0x9E3779B9))
        two[h[:-1] == h[1:]] = SAME
        two ^= two >> np.uint32(15)
        marks = np.full(int((full >> np.uint64(32)).sum()), CAPITALS, np.uint32)
        one = h ^ (h >> np.uint32(16))
        at, count = np.unique(np.concatenate([one, two, marks]) & self.mask, return_counts=True)
        return at.astype(np.int64), count / np.sqrt(float(count @ count))


def fit(rows, bits: int = BITS, epochs: int = EPOCHS) -> bytes:
    """Weights (float32, bias last) from (text, label) pairs. The sample's rows stay in memory as sparse rows."""
    features, model = WordFeatures(bits), Ftrl(1 << bits, ALPHA, BETA, L1, L2)
    data = [(features.row(text), y) for text, y in rows]
    for _ in range(epochs):
        for (at, x), y in data:
            model.learn(at, x, y)
    return model.weights().astype("<f4").tobytes()


def _features(bits: int) -> WordFeatures:
    return worker_cache(("word features", bits), lambda: WordFeatures(bits))


def score_rows(weights: np.ndarray, texts: list[str], bits: int = BITS) -> list[float]:
    """Sparse dot products through the logistic function."""
    features, out = _features(bits), []
    for t in texts:
        at, x = features.row(t)
        out.append(float(1 / (1 + np.exp(-np.clip(weights[at] @ x + weights[-1], -35, 35)))))
    return out


def classify_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS, threshold: float = THRESHOLD, bits: int = BITS, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; a higher score means good quality is likelier.

    With ``carry`` a struct ``document`` of all input columns comes along.

    Learns from at most ``bound`` labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2). A null text
    is ''; it gets the score of a row without features. Repeated rows and null ids are scored each; very long texts are scored whole; other columns of clashing names do no harm. An
    empty table gives no rows. Without any example every score is 0.5. Scoring is narrow: the model (4 * 2**bits bytes) goes to the tasks, no text is shuffled.
    """
    model = fit_in_task(labelled_sample(docs, labels, "quality", bound), functools.partial(fit, bits=bits)) or bytes(4 * (1 << bits) + 4)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        return score_rows(np.frombuffer(shared.value, "<f4"), texts, bits)

    return scores(docs, score, threshold, carry)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
