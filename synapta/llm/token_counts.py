"""Token counts of whole texts; huge texts are encoded as overlapping chunks that are spliced where both sides agree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from synapta.llm.common import map_batches, table
from synapta.llm.tokens import PieceCounter, piece_counter, vocabulary

VOCABULARY = "piece_bpe_32k.model"
LIMIT = 4096
CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512


def spliced_count(counter: PieceCounter, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of a long text by overlap resynchronisation.

    Each chunk starts ``overlap`` characters before the end of the one before it, or earlier, so that the overlap holds a
    position which no token can span: two neighbouring characters that stand side by side in no piece of the vocabulary. What
    stands on either side of such a position is encoded alike with or without the other side, so both chunks have a token
    start there, and the counts are joined at it. A chunk without such a position grows to the next one.
    """
    n = len(text)
    if n <= chunk or counter.apart is None:
        return counter.whole(text)
    stable, total, lo, joint = counter.stable(text), 0, 0, 0
    while True:
        hi = min(n, max(joint + 1, lo) + chunk)
        k = int(np.searchsorted(stable, hi))  # the position of the next joint: the last one below hi
        if hi < n and (not k or stable[k - 1] <= joint):
            hi = min(n, int(stable[k]) + overlap) if k < len(stable) else n
            k += k < len(stable)
        starts = counter.starts(text, lo, hi)
        if joint and joint not in starts:
            raise RuntimeError(f"no token starts at {joint}")
        if hi == n:
            return total + int((starts >= joint).sum())
        cut = int(stable[k - 1])
        if cut not in starts:
            raise RuntimeError(f"no token starts at {cut}")
        total += int(((starts >= joint) & (starts < cut)).sum())
        joint, lo = cut, max(1, min(hi - overlap, cut - 1))


def count_tokens(
    docs: DataFrame, vocabulary_path: str, limit: int = LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_chunks) per row of ``docs`` (doc_id, text).

    A null text counts as empty: 0 bytes, 0 tokens. Rows are independent: repeated rows and null ids give a row each,
    other columns are ignored. A very long text is encoded chunk by chunk; one in which every pair of neighbours stands in some
    piece is encoded whole. An empty table gives no rows. Narrow: no shuffle, memory bounded by a batch of texts.
    """

    def run(batches):
        counter = piece_counter(vocabulary_path)
        for b in batches:
            n_bytes, n_tokens, chunks = [], [], []
            for text in b.column("text").to_pylist():
                text = text or ""
                n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                long = len(text) > chunk
                n_tokens.append(spliced_count(counter, text, chunk, overlap) if long else counter.count(text))
                chunks.append(-(-len(text) // chunk))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens], pa.bool_()), pa.array(chunks, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
            )

    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    return map_batches(rows, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY))
