"""Conversation prefix trie: padded turn-id matrices of range shards give the nodes of every depth.

Equal sequences of turns are counted first. The distinct ones are dealt by ranges, so that those with a common prefix lie side by side.
A shard is a matrix of turn ids, shorter rows padded with 0: numpy's lexsort orders it, masks of changed columns, OR-ed from column to
column, mark where nodes start, reduceat sums every depth. A node that touches the first or last row of its shard may go on in the
next one: such boundary nodes (two paths a shard) are put together by their keys, and what they lack is added to their ancestors.

A conversation longer than BLOCK turns is cut into blocks. A block is the root of a trie of its own below a key of all turns
before it; its totals are added to the nodes above through its smallest member, which passes through all of them.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import CRC_TABLE, NOT_SPACE, crc32_sql, map_batches, materialise, table
from synapta.operators.scans import scan

#: Turns of a block, the columns of a matrix.
BLOCK = 64
#: Distinct sequences of a shard, about.
SHARD_ROWS = 5_000
#: Boundary nodes that may be broadcast.
SMALL = 200_000
#: Characters of ids that are joined before they are sent on.
PIECE = 1 << 20
ID = 16

NOTHING = hashlib.sha256(b"").hexdigest()


def narrow(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words, tie) without texts: id is the md5 of role and text (null as ''), words counts the text's words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.md5(F.concat_ws(":", F.char_length(role).cast("string"), role, text).cast("binary"))
    return turns.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), same.alias("id"), F.regexp_count(text, F.lit(NOT_SPACE)).alias("words"), F.monotonically_increasing_id().alias("tie"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, id, words, pos, n): turns in order (nulls first, ties by id), numbered from 1 by a scan over ranges."""
    order = [F.asc_nulls_first("turn"), F.asc("id"), F.asc("tie")]
    return scan(narrow(turns), ["conv_id"], order, lambda d: materialise(d, "turns"), number="pos", total="n").select("conv_id", "id", "words", "pos", "n")


def rebuilt(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, length, depth, id, words): each conversation c starts with the first crc32(c) % heads turns of the first of its group
    of ids, then come its own turns after as many. A conversation without turns is a row of depth 0."""
    of = materialise(numbered(turns), "numbered")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h")
    base = (F.col("conv_id") - F.col("conv_id") % group).alias("base")
    head = F.array_sort(F.collect_list(F.struct("pos", "id", "words")))  # at most heads - 1
    first = of.where((F.col("pos") < heads) & (F.col("conv_id") % group == 0)).groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    convs = of.where("pos = 1").select("conv_id", "n", h, base).join(first, "base", "left")
    convs = convs.withColumn("head", F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast(first.schema["head"].dataType)).otherwise(F.slice("head", 1, F.greatest("h", F.lit(1)))))
    convs = convs.withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    front = convs.select("conv_id", "length", F.explode("head").alias("x")).select("conv_id", "length", F.col("x.pos").alias("depth"), "x.id", "x.words")
    own = of.drop("n").join(convs.select("conv_id", "length", "h", F.size("head").alias("k")), "conv_id").where("pos > h")
    own = own.select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "id", "words")
    bare = convs.where("length = 0").select("conv_id", "length", F.lit(0).alias("depth"), F.lit("").alias("id"), F.lit(0).alias("words"))
    return front.unionByName(own).unionByName(bare).select("conv_id", F.col("length").cast("bigint").alias("length"), F.col("depth").cast("bigint").alias("depth"), "id", F.col("words").cast("bigint").alias("words"))


def _blocks(sequences: DataFrame, block: int) -> DataFrame:
    """(conv_id, length, block, seq, words): ids joined, at most ``block`` of them a row."""
    at = F.greatest(F.floor((F.col("depth") - 1) / block), F.lit(0)).cast("bigint").alias("block")
    rows = sequences.groupBy("conv_id", "length", at).agg(F.array_sort(F.collect_list(F.struct("depth", "id", "words"))).alias("x"))
    words = F.transform(F.filter("x", lambda x: x["depth"] > 0), lambda x: x["words"])
    return rows.select("conv_id", "length", "block", F.unhex(F.array_join("x.id", "")).alias("seq"), words.alias("words"))


def _md5(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*(p.cast("string").cast("binary") if i == 0 else p for i, p in enumerate(parts)))))


def _chained(rows: DataFrame) -> DataFrame:
    """Blocks of long conversations with ``prefix``, a key of all blocks before, and ``next``, a key of these and the block itself: sums
    of four 32-bit parts of the md5 of each block and its number."""
    digest = F.md5(F.concat(F.col("block").cast("string").cast("binary"), F.lit(b":"), "seq"))
    parts = {f"l{i}": F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)}
    sums = scan(rows.withColumns(parts), ["conv_id"], [F.asc("block")], lambda d: materialise(d, "chain"), sums={f"s{i}": f"l{i}" for i in range(4)})
    key = lambda *c: F.unhex(F.md5(F.concat_ws(",", *(x.cast("string") for x in c)).cast("binary")))
    before = F.when(F.col("block") == 0, F.lit(b"")).otherwise(key(*(F.col(f"s{i}") - F.col(f"l{i}") for i in range(4))))
    return sums.withColumn("prefix", before).withColumn("next", key(*(F.col(f"s{i}") for i in range(4)))).drop(*parts, *(f"s{i}" for i in range(4)))


# --- one shard ------------------------------------------------------------------------------------------------------

SEQS = "block bigint, prefix binary, seq binary, words array<bigint>, n bigint, low bigint, more boolean, s_leaves bigint, s_saved bigint, s_kids bigint, top bigint, sha string"
NODES = (
    "root boolean, edge boolean, node binary, parent binary, path array<binary>, block bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, words bigint, deeper boolean, sha string"
)
_KINDS = {"boolean": pa.bool_(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "bigint": pa.int64(), "string": pa.string()}
_NODES = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in NODES.split(", ")])


def _pairs(column, n: int) -> np.ndarray:
    """16-byte values (or none: zeros) as two numbers."""
    return np.frombuffer(b"".join(x if x else bytes(ID) for x in column), ">u8").reshape(n, 2).astype(np.uint64)


def matrix(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Turn ids of sequences as ranks from 1, padded with 0, and the lengths."""
    lens = np.array([len(s) // ID for s in seqs])
    flat = np.frombuffer(b"".join(seqs), ">u8").reshape(-1, 2).astype(np.uint64)
    order = np.lexsort((flat[:, 1], flat[:, 0]))
    new = np.ones(len(flat), bool)
    new[1:] = (flat[order][1:] != flat[order][:-1]).any(axis=1)
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.cumsum(new)
    out = np.zeros((len(seqs), max(lens.max(initial=0), 1)), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = rank
    return out, lens


def shard_nodes(t: pa.Table, block: int):
    """Record batches of the nodes of one shard, a batch a depth."""
    n = t.num_rows
    seqs, prefixes = t["seq"].to_pylist(), t["prefix"].to_pylist()
    ids, lens = matrix(seqs)
    at, pre = t["block"].to_numpy(), _pairs(prefixes, n)
    order = np.lexsort((*ids.T[::-1], pre[:, 1], pre[:, 0], at))
    ids, lens, at, pre = ids[order], lens[order], at[order], pre[order]
    col = lambda c: t[c].to_numpy(zero_copy_only=False)[order]
    count, low, more, s_leaves, s_saved, kids, top = (col(c) for c in ("n", "low", "more", "s_leaves", "s_saved", "s_kids", "top"))
    sha, words = t["sha"].to_pylist(), np.zeros_like(ids)
    words[np.arange(ids.shape[1]) < lens[:, None]] = np.fromiter((w for i in order for w in t["words"][int(i)].as_py()), np.int64)

    changed = np.ones(n, bool)
    changed[1:] = (at[1:] != at[:-1]) | (pre[1:] != pre[:-1]).any(axis=1)
    masks = [changed]
    for j in range(ids.shape[1]):
        changed = changed.copy()
        changed[1:] |= ids[1:, j] != ids[:-1, j]
        masks.append(changed)

    def key(i: int, depth: int) -> bytes:
        row = order[i]
        return hashlib.md5(struct.pack("<qq", at[i], depth) + (prefixes[row] or b"") + b":" + seqs[row][: ID * depth]).digest()

    #: What the nodes below a row are worth, gathered from the deepest column up; nodes at the edges are left out.
    leaves, saved = s_leaves.copy(), s_saved.copy()
    below = np.zeros(n, np.int64)  # starts of the next deeper nodes but those at the edges
    out = []
    for depth in range(ids.shape[1], -1, -1):
        all_starts = np.flatnonzero(masks[depth])
        all_stops = np.append(all_starts[1:], n)
        keep = lens[all_starts] >= depth
        starts, stops = all_starts[keep], all_stops[keep]
        if not len(starts):
            continue
        total = lambda x: np.add.reduceat(x, all_starts)[keep]  # noqa: E731, B023
        n_convs, conv = total(count), np.minimum.reduceat(low, all_starts)[keep]
        full = lens[starts] == depth
        here = full & (depth == block)
        deeper = (stops - starts > 1) | ~full | (here & more[starts])
        own = words[starts, depth - 1] if depth else np.zeros(len(starts), np.int64)
        edge = (starts == 0) | (stops == n)
        inner = ~edge
        leaves[starts[inner]] += ~deeper[inner]
        saved[starts[inner]] += (n_convs[inner] - 1) * own[inner]
        children = total(below) + np.where(here, kids[starts], 0)
        if depth:
            above = np.flatnonzero(masks[depth - 1])
            parent = np.searchsorted(above, starts, "right") - 1
            p_start, p_stop = above[parent], np.append(above[1:], n)[parent]
            p_edge = (p_start == 0) | (p_stop == n)
            p_conv = np.minimum.reduceat(low, above)[parent]
        else:
            p_start = p_edge = p_conv = None
        rows = {
            "root": [depth == 0] * len(starts), "edge": edge.tolist(), "block": at[starts], "depth": at[starts] * block + depth, "conv_id": conv, "n_convs": n_convs, "n_children": children,
            "n_leaves": total(leaves), "saved_tokens": total(saved), "words": own, "deeper": deeper.tolist(),
            "sha": [sha[order[i]] if f else None for i, f in zip(starts, full)],
            "node": [key(i, depth) if e else None for i, e in zip(starts, edge)],
            "path": [[key(i, d) for d in range(depth + 1)] if e else None for i, e in zip(starts, edge)],
        }
        if not depth:
            rows |= {"parent": [None] * len(starts), "parent_conv_id": [None] * len(starts)}
        elif depth == 1:  # the node that a block hangs from is known from the block before
            rows |= {"parent": [key(i, 0) if e else None for i, e in zip(starts, edge)], "parent_conv_id": top[starts]}
        else:
            rows |= {"parent": [key(i, depth - 1) if e else None for i, e in zip(starts, p_edge)], "parent_conv_id": [None if e else int(c) for c, e in zip(p_conv, p_edge)]}
        out.append(pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in _NODES], schema=_NODES))
        below = np.zeros(n, np.int64)
        below[starts[inner]] = 1
    return out


def _nodes(seqs: DataFrame, block: int, shard_rows: int) -> DataFrame:
    """(root, block, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha, prefix's node) of every node."""
    shards = max(1, -(-seqs.count() // shard_rows))
    names = [x.split()[0] for x in SEQS.split(", ")]

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if batches else None
        return shard_nodes(t, block)

    def task(batches):
        held = [b for b in batches if b.num_rows]
        yield from run(held) if held else ()

    made = materialise(map_batches(seqs.select(*names).repartitionByRange(shards, "block", "prefix", "seq"), task, NODES), "nodes")
    edges = made.where("edge").groupBy("node").agg(
        *(F.first(c).alias(c) for c in ("root", "block", "depth", "parent", "path", "words")), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("top"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("deeper").alias("deeper"), F.max("sha").alias("sha"),
    )
    edges = materialise(edges, "edges")
    # an edge node counts for itself and for all above it, which are edge nodes too
    worth = edges.select(F.explode("path").alias("node"), F.when(F.col("deeper"), 0).otherwise(1).alias("l"), ((F.col("n_convs") - 1) * F.col("words")).alias("s"))
    worth = worth.groupBy("node").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    kids = edges.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("k"))
    lows = edges.select(F.col("node").alias("parent"), F.col("conv_id").alias("low"))
    small = F.broadcast if edges.count() <= SMALL else lambda d: d
    whole = edges.join(worth, "node").join(kids, "node", "left").join(small(lows), "parent", "left")
    number = lambda c, more: (F.col(c) + F.coalesce(more, F.lit(0))).cast("bigint").alias(c)
    parent = F.coalesce("top", "low").alias("parent_conv_id")
    whole = whole.select("root", "block", "depth", "conv_id", parent, "n_convs", number("n_children", F.col("k")), number("n_leaves", F.col("l")), number("saved_tokens", F.col("s")), "sha")
    inner = made.where("not edge").join(small(lows), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "low"))
    return inner.select(*whole.columns).unionByName(whole)


# --- whole tries ----------------------------------------------------------------------------------------------------


def _pieces(batches):
    key = first = None
    ids, size = [], 0
    names = ["key", "first", "data"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, (pa.binary(), pa.int64(), pa.string()))], names=names)

    for b in batches:
        rows = []
        for k, c in zip(b["key"].to_pylist(), b["conv_id"].to_pylist()):
            if ids and (k != key or size > PIECE):
                rows.append((key, first, ",".join(ids)))
                ids, size = [], 0
            if not ids:
                key, first = k, c
            ids.append(str(c))
            size += 1 + len(ids[-1])
        yield batch(rows)
    yield batch([(key, first, ",".join(ids))] if ids else [])


def _hashed(batches):
    key, sha = None, None

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 2, (pa.binary(), pa.string()))], names=["key", "sha"])

    for b in batches:
        rows = []
        for k, data in zip(b["key"].to_pylist(), b["data"].to_pylist()):
            if sha is not None and k == key:
                sha.update(b",")
            else:
                if sha is not None:
                    rows.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
            sha.update(data.encode())
        yield batch(rows)
    yield batch([(key, sha.hexdigest())] if sha is not None else [])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of each key's conv_ids in ascending order. Ranges of (key, conv_id) join ids into pieces, so a key of any size
    spreads over tasks; only the pieces of a key meet in one task, as a stream, for a SHA-256 goes through its input in order."""
    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = map_batches(dealt, _pieces, "key binary, first bigint, data string")
    return map_batches(pieces.repartition("key").sortWithinPartitions("key", "first").select("key", "data"), _hashed, "key binary, sha string")


def prefix_trie(sequences: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a node of the trie of ``sequences`` (conv_id, length, depth from 1, id of 32 hex digits, words; a row of depth 0 for a
    conversation without turns): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Each conv_id occurs once. Nothing gives no rows. Shards hold about ``shard_rows`` distinct sequences, however many copies there are
    and however long conversations are.
    """
    rows = materialise(_blocks(sequences, block), "blocks")
    short = rows.where(F.col("length") <= block).withColumn("prefix", F.lit(b"")).withColumn("next", F.lit(None).cast("binary"))
    rest = rows.where(F.col("length") > block)
    if rest.limit(1).count():
        rest = materialise(_chained(rest), "long")
        every = short.unionByName(rest)
    else:
        rest, every = None, short
    nothing = {"s_leaves": F.lit(0).cast("bigint"), "s_saved": F.lit(0).cast("bigint"), "s_kids": F.lit(0).cast("bigint")}

    def distinct(blocks: DataFrame) -> DataFrame:
        more = F.max(F.col("length") > (F.col("block") + 1) * block).alias("more")
        return blocks.groupBy("block", "prefix", "seq", "words").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), more, F.max("next").alias("next"), *(F.sum(c).alias(c) for c in nothing))

    if rest is not None:
        seqs = materialise(distinct(rest.where("block > 0").withColumns(nothing)), "deep").withColumn("top", F.lit(0).cast("bigint")).withColumn("sha", F.lit(None).cast("string"))
        roots = _nodes(seqs, block, shard_rows).where("root").select("conv_id", "block", F.col("n_leaves").alias("t_leaves"), F.col("saved_tokens").alias("t_saved"), F.col("n_children").alias("t_kids"))
        worth = rest.join(roots, ["conv_id", "block"], "left").na.fill(0, ["t_leaves", "t_saved", "t_kids"])
        worth = scan(worth, ["conv_id"], [F.desc("block")], lambda d: materialise(d, "worth"), sums={"s_leaves": "t_leaves", "s_saved": "t_saved"}, before={"s_kids": "t_kids"})
        worth = worth.withColumns({"s_leaves": F.col("s_leaves") - F.col("t_leaves"), "s_saved": F.col("s_saved") - F.col("t_saved"), "s_kids": F.coalesce("s_kids", F.lit(0))})
        seqs = distinct(short.withColumns(nothing).unionByName(worth.drop("t_leaves", "t_saved", "t_kids")))
    else:
        seqs = distinct(short.withColumns(nothing))
    key = _md5(F.col("block"), F.lit(b":"), F.col("prefix"), F.lit(b":"), F.col("seq"))
    seqs = materialise(seqs.withColumn("key", key), "sequences")
    last = every.where(F.col("length") <= (F.col("block") + 1) * block)
    seqs = seqs.join(ends_digest(last.select(key.alias("key"), "conv_id")), "key", "left")
    least = seqs.agg(F.min("low").alias("top"))
    front = seqs.where("block = 0").crossJoin(F.broadcast(least))  # one row
    if rest is not None:
        tops = seqs.where("more").select((F.col("block") + 1).alias("block"), F.col("next").alias("prefix"), F.col("low").alias("top"))
        front = front.unionByName(seqs.where("block > 0").join(tops, ["block", "prefix"]))
    nodes = _nodes(materialise(front, "shards"), block, shard_rows).where("not root or block = 0")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are ordered by turn (nulls first), ties by md5 of role and text; repeated rows are turns of their own; null roles and texts are
    ''; rows of a null conv_id belong to no conversation and are left out; texts of any length are read where they lie."""
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM t), crc_table),
r AS (SELECT c.conv_id, pos AS o, id, words FROM c JOIN t ON t.conv_id = base WHERE pos <= h UNION ALL SELECT c.conv_id, pos + 10 AS o, id, words FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, words, md5(string_agg(id, '') OVER w) AS node, lag(md5(o::VARCHAR)) OVER w AS x FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY o)),
q AS (SELECT conv_id, depth, words, node, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS parent FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM q GROUP BY 1),
n AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(q.conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN depth = len THEN q.conv_id::VARCHAR END, ',' ORDER BY q.conv_id) AS ends FROM q JOIN l ON l.conv_id = q.conv_id GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k USING (node)),
s AS (SELECT q.node, count(*) FILTER (WHERE m.n_children = 0) AS leaves, sum((m.n_convs - 1) * m.words) AS saved FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY 1)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN s ON s.node = m.node LEFT JOIN m up ON up.node = m.parent"""
