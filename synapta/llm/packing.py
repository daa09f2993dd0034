"""Cost-balanced packing of documents into training sequences.

The cost of a piece is linear in its tokens plus quadratic for attention. Each task packs what it holds, window by window:
descending pieces go to the cheapest open sequence that has room; a piece that fits nowhere whole is cut, so that less than a
sequence is left at the end of a window. That goes into the next window; at a task's end it is closed at powers of two, which
need no padding. A window bounds a task's memory; descending order and lowest cost hold within it.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import map_batches, table
from synapta.llm.tokens import CACHE_BYTES, vocabulary, word_encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
#: Tokens packed together; bounds a task's memory whatever the partition's size.
WINDOW_TOKENS = 2_000_000
#: Attention cost of a token pair against the linear cost of a token.
QUADRATIC = 1 / 2048


def pack(sizes: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of ``sizes`` tokens (each at least 1)."""
    return place(sizes, capacity, quadratic)[0]


def place(sizes: list[int], capacity: int = CAPACITY, quadratic: float = QUADRATIC, close: bool = True) -> tuple[list, list, int]:
    """The pieces of ``pack``, the rest (document, start, length) of less than a sequence, and the number of sequences.

    Whole sequences are cut off documents longer than one. The rest goes, largest first, to the sequence of the lowest cost
    among all with room: pieces descend, so a sequence without room waits until one is as small as its room. A piece that fits
    into none is cut to fill the roomiest ones (the fewest cuts; all get full, so there is no cost to balance by tokens). What is
    left is cut into sequences of powers of two if ``close``.
    """
    pieces: list[list[int]] = []  # document, start, length
    out, sequence = [], 0
    for d, n in enumerate(sizes):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            pieces.append([d, full * capacity, n % capacity])
    pieces.sort(key=lambda p: (-p[2], p[0]))
    total = sum(p[2] for p in pieces)
    n_open = total // capacity
    room = [capacity] * n_open
    ready = [(0.0, s) for s in range(n_open)]  # by cost: room for the piece at hand, so for all later ones
    short: list[tuple[int, float, int]] = []  # the others, the largest room first
    content: list[list[tuple[int, int, int]]] = [[] for _ in range(n_open)]
    cut: list[list[int]] = []

    for p in pieces:
        while short and -short[0][0] >= p[2]:
            _, cost, s = heapq.heappop(short)
            heapq.heappush(ready, (cost, s))
        if not ready:
            cut.append(p)
            continue
        cost, s = heapq.heappop(ready)
        content[s].append((p[0], p[1], p[2]))
        room[s] -= p[2]
        cost += p[2] + quadratic * p[2] * p[2]
        if room[s] >= p[2]:
            heapq.heappush(ready, (cost, s))
        elif room[s]:
            heapq.heappush(short, (-room[s], cost, s))
    gaps = sorted((s for s in range(n_open) if room[s]), key=lambda s: (-room[s], s))
    g = 0
    rest: list[tuple[int, int, int]] = []
    for d, start, n in cut:
        while n and g < len(gaps):
            s = gaps[g]
            k = min(n, room[s])
            content[s].append((d, start, k))
            room[s] -= k
            start, n = start + k, n - k
            g += not room[s]
        if n:
            rest.append((d, start, n))
    left = sum(n for _, _, n in rest) if close else 0
    while left:  # powers of two, largest first
        width = 1 << (left.bit_length() - 1)
        content.append([])
        left -= width
        while width:
            d, start, n = rest.pop()
            k = min(n, width)
            content[-1].append((d, start, k))
            width -= k
            if k < n:
                rest.append((d, start + k, n - k))
    for c in content:
        offset = 0
        for d, start, n in c:
            out.append((d, start, n, sequence, offset))
            offset += n
        sequence += 1
    return out, rest, sequence


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence bigint, offset bigint, ids binary"


def _pack_batches(vocabulary_path: str, end_id: int, capacity: int, window: int, quadratic: float, with_ids: bool, cache_bytes: int):
    def run(batches):
        encoder, sequence = word_encoder(vocabulary_path, cache_bytes), 0
        held: list[tuple] = []  # doc_id, ids, ids of the document before them, ids of the document
        n = 0

        def flush(close: bool):
            nonlocal held, n, sequence
            pieces, rest, used = place([len(h[1]) for h in held], capacity, quadratic, close)
            of = [held[p[0]] for p in pieces]
            raw = [h[1][s : s + k].astype("<u4").tobytes() for h, (_, s, k, _, _) in zip(of, pieces)]
            cols = [
                pa.array([h[0] for h in of], pa.int64()), pa.array([h[2] + p[1] for h, p in zip(of, pieces)], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([h[3] for h in of], pa.int64()),
                pa.array([sequence + p[3] for p in pieces], pa.int64()), pa.array([p[4] for p in pieces], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary()),
            ]
            sequence += used
            held = [(held[d][0], held[d][1][s : s + k].copy(), held[d][2] + s, held[d][3]) for d, s, k in rest]
            n = sum(k for _, _, k in rest)
            return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset", "ids"])

        end = np.array([end_id], np.uint32)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, got = encoder.encode(part.column("text").to_pylist())
                ends = np.cumsum(got)
                for doc, e, k in zip(part.column("doc_id").to_pylist(), ends, got):
                    held.append((doc, np.concatenate([ids[e - k : e], end]), 0, int(k) + 1))
                    n += int(k) + 1
                    if n >= window:
                        yield flush(False)
        if held:
            yield flush(True)

    return run


def pack_documents(
    docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, capacity: int = CAPACITY, window: int = WINDOW_TOKENS,
    quadratic: float = QUADRATIC, with_ids: bool = True, cache_bytes: int = CACHE_BYTES,
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and the ids (uint32, binary).

    Every row of ``docs`` (doc_id, text) gives its ids and the end id; a null or empty text gives the end id alone. Repeated
    rows are packed each; a null doc_id stays null; other columns are ignored. Ties of size go by the order of the rows. A very long text
    is held whole by its task. Narrow: partitions pack by themselves, so nothing is shuffled and no sequence spans two tasks;
    the sequence id holds the partition in its high bits. An empty table gives no rows. ``cache_bytes`` bounds what a worker keeps of
    tokenised words, and changes no result.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    out = map_batches(rows, _pack_batches(vocabulary_path, end_id, capacity, window, quadratic, with_ids, cache_bytes), PIECES)
    out = out.withColumn("sequence_id", F.expr("shiftleft(cast(spark_partition_id() as bigint), 33) + sequence")).drop("sequence")
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(VOCABULARY), with_ids=False)
