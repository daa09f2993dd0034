"""Follow-the-regularised-leader logistic regression on sparse rows, and the bounded sample of labelled texts it learns from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from synapta.llm.common import held_out, map_batches


class Ftrl:
    """Per-coordinate FTRL-proximal for the logistic loss with L1 and L2 penalties."""

    def __init__(self, width: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(width + 1), np.zeros(width + 1)  # the last coordinate is the bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x * weight
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, y) of at most ``bound`` labelled documents outside the held-out fold, chosen by a hash of their id.

    Conflicting labels of one id count as the larger; null labels and ids give no example. The chosen ids are
    at most ``bound`` rows, so they are broadcast to the scan of the texts. Of repeated rows of one id the least text is taken.
    """
    y = labels.where(f"doc_id is not null and {label} in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = y.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(bound)
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "coalesce(cast(text as string), '') as text")
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))


def fit_in_task(sample: DataFrame, fit) -> bytes | None:
    """Runs ``fit`` over the rows of the bounded sample, in one task and one order, and returns the packed model.

    ``fit`` takes an iterator of (text, y) and returns bytes; the model's size is fixed by its parameters. None without examples.
    """

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(b.column("text").to_pylist(), b.column("y").to_pylist())

        yield pa.RecordBatch.from_arrays([pa.array([fit(rows())], pa.binary())], names=["model"])

    ordered = sample.repartition(1).sortWithinPartitions("h", "doc_id", "text")
    row = map_batches(ordered.select("text", "y"), run, "model binary").first()  # no row from a plan that is known to be empty
    return row["model"] if row else None


def scores(docs: DataFrame, score_texts, threshold: float, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ``score_texts`` maps a list of texts (null: '') to scores.

    With ``carry`` a struct ``document`` of all columns of ``docs`` comes along.
    """
    out = ["doc_id", "held_out", "score", "predicted"] + ["document"] * carry

    def run(batches):
        for b in batches:
            got = []
            for lo in range(0, b.num_rows, 256):
                got += score_texts([t or "" for t in b.column("text").slice(lo, 256).to_pylist()])
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols + ([b.column("document")] if carry else []), names=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), *[F.struct("*").alias("document")] * carry)
    schema = StructType().add("doc_id", LongType()).add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    if carry:
        schema = schema.add("document", docs.schema)
    return map_batches(rows, run, schema)
