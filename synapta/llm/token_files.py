"""Token-id files in Simple-8b coding: 64-bit words that each pack as many ids as fit their selector.

File format (Parquet rows, so that any store Spark can reach will do). ``blocks`` has one row a block, in ascending id order: ``part``
and ``block`` (order within the corpus), ``first_id`` (ids of the part before it), ``n_ids``, ``payload`` (little-endian 64-bit
words), ``doc_ids``, ``doc_sizes`` and ``doc_words`` (the documents of the block, their numbers of ids and the word at which each
starts). ``parts`` has one row a part: ``part``, ``n_ids`` and ``first_id`` (ids of the corpus before it). A document starts at a
word of its own, and a block holds whole documents, about BLOCK_IDS ids, so a block or a document of it can be decoded alone and
in one vectorised pass.

Word: the top 4 bits are the selector, the low 60 bits the values, first value lowest. Selector 15 is the escape: the word
is followed by nothing else and holds one value of up to 60 bits.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import map_batches, scratch_root, table
from synapta.llm.tokens import vocabulary, word_encoder

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 65_536
#: Values a word and bits a value, by selector (the published Simple-8b table; selectors 0 and 1 are runs of zeros).
PACK = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15


def _widths(v: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if int(v.max()) < 1 << 16:
        return _WIDTH_16[v]
    return np.searchsorted(np.uint64(1) << np.arange(60, dtype=np.uint64), v, side="right").astype(np.uint8)


_WIDTH_16 = np.array([x.bit_length() for x in range(1 << 16)], np.uint8)


def simple8b_encode(values: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray | tuple[np.ndarray, np.ndarray]:
    """Packs non-negative integers below 2**60 into 64-bit words. With ``ends`` (ascending, the last is the number of values) no word
    spans an end, and the first word of each piece comes along.

    Each word takes the longest run that its selector can hold. The run that could start at every position is found for
    all positions at once, one selector after another; then the chain of starts is followed.
    """
    v = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64) if ends is None else (np.zeros(0, np.uint64), np.zeros(len(ends), np.int64))
    if int(v.max()) >> 60:
        raise ValueError("Simple-8b holds values below 2**60")
    bounds = np.array([n]) if ends is None else np.asarray(ends, np.int64)
    sizes = np.diff(np.concatenate([[0], bounds]))
    left = np.repeat(bounds, sizes) - np.arange(n)  # values up to the end of the piece
    widths = np.zeros(n, np.uint8) if not v.any() else _widths(v)
    choice, most, span = np.full(n, ESCAPE, np.uint8), widths, 1
    for s in range(ESCAPE - 1, 1, -1):  # widest values first; most[i] is the largest width of the next ``span`` values
        count, bits = PACK[s]
        if count > n:
            break
        while span < count:
            step = min(span, count - span)
            most, span = np.maximum(most[: len(most) - step], most[step:]), span + step
        np.copyto(choice[: len(most)], np.uint8(s), where=(most <= bits) & (left[: len(most)] >= count))
    zero = np.flatnonzero(widths == 0) if n >= 120 else ()
    if len(zero) >= 120:  # runs of zeros
        upto = np.concatenate([[0], np.cumsum(widths != 0)])
        for s in (1, 0):
            if (count := PACK[s][0]) <= n:
                np.copyto(choice[: n - count + 1], np.uint8(s), where=(upto[count:] == upto[:-count]) & (left[: n - count + 1] >= count))
    counts = np.array([c for c, _ in PACK], np.int64)
    step = counts[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    sel = choice[starts]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in range(2, 16):
        count, bits = PACK[s]
        rows = np.flatnonzero(sel == s)
        if len(rows):
            at, packed = starts[rows], np.zeros(len(rows), np.uint64)
            for k in range(count):
                packed |= v[at + k] << np.uint64(k * bits)
            words[rows] |= packed
    return words if ends is None else (words, np.searchsorted(starts, bounds - sizes))


def simple8b_decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of ``words``; one vectorised pass for each selector that occurs."""
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in PACK], np.int64)[sel]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s in np.unique(sel):
        count, bits = PACK[s]
        if bits:
            rows = np.flatnonzero(sel == s)
            body = words[rows, None] >> (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            out[(ends[rows] - count)[:, None] + np.arange(count)] = body & np.uint64((1 << bits) - 1)
    return out[:n]


BLOCK_SCHEMA = "block int, first_id bigint, n_ids bigint, payload binary, doc_ids array<bigint>, doc_sizes array<bigint>, doc_words array<bigint>"
_BLOCK_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 3]
#: Parts up to which their table is broadcast.
BROADCAST_PARTS = 1_000_000


def _packed(batches, vocabulary_path: str, end_id: int):
    """(doc_id, number of ids, packed ids) of each document."""
    encoder = word_encoder(vocabulary_path)
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            ids, got = encoder.encode(part.column("text").to_pylist())
            words, first = simple8b_encode(np.insert(ids, np.cumsum(got), end_id), np.cumsum(got + 1))
            raw, at = words.astype("<u8").tobytes(), np.append(8 * first, 8 * len(words)).tolist()
            yield from zip(part.column("doc_id").to_pylist(), (got + 1).tolist(), (raw[x:y] for x, y in zip(at, at[1:])))


def _blocks(vocabulary_path: str, end_id: int, block_ids: int):
    names = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]

    def run(batches):
        block, first, held, docs, sizes, words, n = 0, 0, [], [], [], [0], 0

        def flush():
            row = [block, first, n, b"".join(held), docs, sizes, words[:-1]]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _BLOCK_TYPES)], names=names)

        for doc, k, payload in _packed(batches, vocabulary_path, end_id):
            held.append(payload)
            docs.append(doc)
            sizes.append(k)
            words.append(words[-1] + len(payload) // 8)
            n += k
            if n >= block_ids:
                yield flush()
                block, first, held, docs, sizes, words, n = block + 1, first + n, [], [], [], [0], 0
        if docs:
            yield flush()

    return run


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all rows of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order, null ids first.

    Rows are dealt by ranges of doc_id, as many as the input has splits, sorted within them, encoded and packed where they lie;
    one range is one part. Ties of doc_id are ordered by the text, so a doc_id of very many rows is split over ranges. A null
    or empty text gives the end id only. Repeated rows are written as often as they occur. Other columns are ignored. A very
    long text is one block; its packed ids have to fit a cell of Spark (2 GB). An empty table gives no blocks.
    """
    spark = docs.sparkSession
    rows = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    dealt = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    blocks = map_batches(ordered, _blocks(vocabulary_path, end_id, block_ids), BLOCK_SCHEMA).withColumn("part", F.spark_partition_id())
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")
    parts = spark.read.schema(f"{BLOCK_SCHEMA}, part int").parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts.selectExpr("part", "n_ids", "sum(n_ids) over (order by part) - n_ids as first_id").write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks, each with ``start``, the ids of the corpus before it."""
    blocks = spark.read.schema(f"{BLOCK_SCHEMA}, part int").parquet(f"{path}/blocks")
    parts = spark.read.schema("part int, n_ids bigint, first_id bigint").parquet(f"{path}/parts").select("part", F.col("first_id").alias("part_first"))
    if parts.count() <= BROADCAST_PARTS:  # a row a file
        parts = F.broadcast(parts)
    return blocks.join(parts, "part").withColumn("start", F.col("part_first") + F.col("first_id")).drop("part_first")


def document_ids(block, i: int) -> np.ndarray:
    """The ids of the i-th document of a block, from its own words only."""
    ends = [*block["doc_words"], len(block["payload"]) // 8]
    return simple8b_decode(np.frombuffer(block["payload"], "<u8")[ends[i] : ends[i + 1]], block["doc_sizes"][i])


def _read_documents(batches):
    for b in batches:
        doc, start, size, crc = [], [], [], []
        for r in b.to_pylist():
            ids = simple8b_decode(np.frombuffer(r["payload"], "<u8"), r["n_ids"]).astype("<u4")
            at = 0
            for d, k in zip(r["doc_ids"], r["doc_sizes"]):
                doc.append(d)
                start.append(r["start"] + at)
                size.append(k)
                crc.append(zlib.crc32(ids[at : at + k].tobytes()))
                at += k
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, size, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    return map_batches(read_token_files(spark, path), _read_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), path, vocabulary(VOCABULARY))
    return read_documents(spark, path)
