"""Substring deduplication by suffix automata of reference shards, with exact candidates found by content-chosen anchors.

A word goes if a window of W consecutive words that covers it starts anywhere else too. Streaming every document past
automata of the whole corpus would cost the corpus times its shards, and broadcasting them would grow with it. So the
reference is cut by content: a window's anchor is the least hash among its runs of K words. Equal windows have equal anchors.

1. One pass cuts each text into segments, runs of windows of one anchor, and writes their anchors and hashes, not their words.
2. Anchors met once end here. An anchor of which all segments are equal is settled: each of its windows occurs again.
3. For the rest the words are fetched and equal segments counted together. The shards of these reference segments, dealt by anchor,
   each become a generalised suffix automaton with the number of occurrences of every state. The segments stream through it for
   their matching statistics: the longest suffix at each word that occurs twice or more. Windows inside those spans go.
4. An anchor of too many different segments for one task is settled by counting its windows' digests across tasks instead.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from synapta.llm.common import map_batches, map_groups, materialise, table, with_row_key, worker_cache
from synapta.llm.ngram_join import hasher, windows

WINDOW, ANCHOR_WORDS = 35, 8
#: Different segments of one anchor that one automaton takes; about so many are put in a shard. An automaton takes some 15 kB a segment.
SHARD_SEGMENTS = 2_048
#: An anchor of more segments is hot; the BROADCAST_IDS hottest at most are broadcast.
HOT_SEGMENTS = 512
#: A list of ids is broadcast up to this many, and shuffled beyond.
BROADCAST_IDS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers_cache() -> dict:
    return {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest text so far."""
    c = _powers_cache()
    if c["n"] < n:
        m = max(n, 4096)
        up, down = np.full(m, np.uint64(_BASE)), np.full(m, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        c.update(n=m, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return c["up"], c["down"]


def segments(h: np.ndarray, window: int = WINDOW, k: int = ANCHOR_WORDS) -> tuple[np.ndarray, ...]:
    """(anchor, content hash, first window, windows, anchor's occurrences) of the segments of one text's word hashes."""
    n = len(h)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32))
    g = windows(h, k)
    reach = window - k + 1
    least, span = g, 1
    while span < reach:
        step = min(span, reach - span)
        least, span = np.minimum(least[: len(least) - step], least[step:]), span + step
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    run = np.diff(np.concatenate([change, [len(least)]]))
    pieces = -(-run // reach)  # a run is cut into pieces of at most ``reach`` windows
    if (pieces > 1).any():
        ends = np.cumsum(pieces)
        inside = np.arange(ends[-1]) - np.repeat(ends - pieces, pieces)
        first = np.repeat(change, pieces) + inside * reach
        count = np.minimum(reach, np.repeat(change + run, pieces) - first)
    else:
        first, count = change, run
    anchor = least[first]
    look = first[:, None] + np.arange(2 * reach - 1)
    seen = (g[np.minimum(look, len(g) - 1)] == anchor[:, None]) & (np.arange(2 * reach - 1) < (count + reach - 1)[:, None])
    up, down = _powers(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up[:n], dtype=np.uint64)])
    last = first + count + window - 1
    content = (total[last] - total[first]) * down[first]
    content = (content ^ (content >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64)
    return anchor.view(np.int64), content.view(np.int64), first.astype(np.int32), count.astype(np.int32), seen.sum(1).astype(np.int32)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _cut(window: int, k: int):
    def run(batches):
        for b in batches:
            keys, parts = b.column("key").to_numpy(), []
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 512):
                got = [segments(hasher().words(_words(t)), window, k) for t in texts[lo : lo + 512]]
                key = np.repeat(keys[lo : lo + 512], [len(x[0]) for x in got])
                parts = [np.concatenate(x) for x in zip(*got)]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), *map(pa.array, parts)], names=["key", "anchor", "content", "first", "n", "occ"])

    return run


def _fetch(window: int):
    def run(batches):
        for b in batches:
            out = []
            for text, segs in zip(b.column("text").to_pylist(), b.column("segs").to_pylist()):
                words = _words(text)
                out += [(s["anchor"], s["content"], s["n"], b" ".join(words[s["first"] : s["first"] + s["n"] + window - 1])) for s in segs]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["anchor", "content", "n", "words"])

    return run


class Automaton:
    """Generalised suffix automaton with, for each state, how often its strings occur (weighted by their text's number)."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the strings of q that are one longer than p's."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: list[int], times: int) -> list[int]:
        """Adds a text; the states of its prefixes."""
        last, states, follow = 0, [], self.next
        for c in text:
            if c in follow[last]:
                last = self._split(last, c, follow[last][c])
            else:
                p, new = last, self._state(self.length[last] + 1, {}, 0)
                while p >= 0 and c not in follow[p]:
                    follow[p][c] = new
                    p = self.link[p]
                self.link[new] = 0 if p < 0 else self._split(p, c, follow[p][c])
                last = new
            self.count[last] += times
            states.append(last)
        return states

    def repeated(self) -> list[int]:
        """For each state the length of its longest suffix that occurs at least twice."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]
        best = [0] * len(self.length)
        for s in order:
            best[s] = self.length[s] if self.count[s] > 1 else best[self.link[s]]
        return best


def repeated_windows(texts: list[tuple[list[bytes], int]], window: int = WINDOW) -> list[int]:
    """For each (words, times it occurs) a bit mask of its windows that occur twice or more among all."""
    ids: dict[bytes, int] = {}
    automaton = Automaton()
    states = [automaton.add([ids.setdefault(w, len(ids)) for w in words], times) for words, times in texts]
    best = automaton.repeated()
    masks = []
    for path in states:
        at = [i for i, s in enumerate(path[window - 1 :]) if min(best[s], window + i) >= window]
        masks.append(sum(1 << i for i in at))
    return masks


def _automata(window: int):
    def run(t: pa.Table) -> pa.Table:
        worker_cache(("automata",), dict)  # the words' hashes are not needed any more
        texts = [(w.split(b" "), n) for w, n in zip(t.column("words").to_pylist(), t.column("times").to_pylist())]
        masks = repeated_windows(texts, window)
        return pa.table({"anchor": t.column("anchor"), "content": t.column("content"), "mask": pa.array(masks, pa.int64())})

    return run


def _digests(window: int):
    def run(batches):
        for b in batches:
            out = []
            for anchor, content, n, words, times in zip(*(b.column(c).to_pylist() for c in ("anchor", "content", "n", "words", "times"))):
                w = words.split(b" ")
                out += [(anchor, content, i, hashlib.blake2b(b" ".join(w[i : i + window]), digest_size=16).digest(), times) for i in range(n)]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["anchor", "content", "i", "digest", "times"])

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """(key, spans) of the documents with windows that occur elsewhere; spans: array of (first, mask), bit i of mask standing
    for the window at word first + i. ``rows``: unique key and text."""
    if not 0 < k <= window or window - k + 1 > 63:
        raise ValueError(f"a segment has at most 63 windows, one for each bit of its mask: window {window} and anchors of {k} words give {window - k + 1}")
    cut = materialise(map_batches(rows.select("key", "text"), _cut(window, k), "key bigint, anchor bigint, content bigint, first int, n int, occ int"), "segments")
    met = cut.groupBy("anchor").agg(F.sum("occ").alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi"), F.max("occ").alias("most")).where("c > 1")
    met = met.select("anchor", "c", F.expr("lo = hi and most = 1").alias("settled"))
    # the anchors of most segments are broadcast, so that what is shuffled for the others has no hot key
    met = materialise(met, "met-anchors")
    hot = met.where(f"c > {HOT_SEGMENTS}").orderBy(F.desc("c"), "anchor").limit(BROADCAST_IDS)
    hot = materialise(hot.select("anchor", "settled"), "hot-anchors")
    others = cut.join(F.broadcast(hot.select("anchor")), "anchor", "left_anti")
    found = cut.join(F.broadcast(hot), "anchor").unionByName(others.join(met.drop("c"), "anchor"))
    found = materialise(found.drop("occ"), "repeated-anchors")
    settled = found.where("settled").select("key", "first", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    open_ = found.where("not settled")

    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "first", "n")).alias("segs"))
    texts = rows.select("key", "text")
    ids = materialise(open_.select("key").distinct(), "open-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = texts.join(F.broadcast(ids) if few else ids, "key", "left_semi")
    fetched = map_batches(texts.join(wanted, "key"), _fetch(window), "anchor bigint, content bigint, n int, words binary")
    different = fetched.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.first("n").alias("n"), F.first("words").alias("words"))
    different = materialise(different, "reference-segments")
    load = different.groupBy("anchor").count()
    heavy = load.where(F.col("count") > SHARD_SEGMENTS).select("anchor")
    shards = max(1, -(-different.count() // SHARD_SEGMENTS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    light = different.join(heavy, "anchor", "left_anti")
    masks = map_groups(light.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")), rows.sparkSession, _automata(window), "anchor bigint, content bigint, mask bigint")
    each = map_batches(different.join(heavy, "anchor", "left_semi"), _digests(window), "anchor bigint, content bigint, i int, digest binary, times bigint")
    twice = each.groupBy("digest").agg(F.sum("times").alias("c")).where("c > 1").select("digest")
    by_digest = each.join(twice, "digest").groupBy("anchor", "content").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    masks = masks.union(by_digest).where("mask <> 0")
    opened = open_.join(masks, ["anchor", "content"]).select("key", "first", "mask")
    return settled.union(opened).groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("spans"))


def removed_words(n: int, spans: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which of n words the windows of the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        mask, first = s["mask"], s["first"]
        while mask:
            low = (mask & -mask).bit_length() - 1
            run = (~(mask >> low) & -(~(mask >> low))).bit_length() - 1  # length of the run of ones from there
            edge[first + low] += 1
            edge[first + low + run + window - 1] -= 1
            mask &= ~(((1 << run) - 1) << low)
    return np.cumsum(edge[:-1]) > 0


def _strip(window: int, carry: bool):
    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = _words(text)
                gone = removed_words(len(words), spans or [], window)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone) if not g) if spans else b" ".join(words))
            cols = [b.column("key"), b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([b.column("document")] if carry else []), names=["key", "doc_id", "n_words", "n_removed", "kept_text"] + ["document"] * carry)

    return run


def deduplicate_substrings(rows: DataFrame, window: int = WINDOW, k: int = ANCHOR_WORDS, carry: bool = False) -> DataFrame:
    """(key, doc_id, n_words, n_removed, kept_text) of every row of ``rows`` (with_row_key of documents); kept words joined by
    one space. With ``carry`` a struct ``document`` of all input columns comes along.

    Windows are judged on the input. A null or empty text has no words; texts shorter than a window keep all. Repeated rows
    are copies of each other and lose their windows; rows of null ids are documents of their own; other columns are
    ignored.
    """
    joined = rows.join(repeated_spans(rows, window, k), "key", "left").select("key", "doc_id", "text", "spans", *["document"] * carry)
    schema = StructType().add("key", LongType()).add("doc_id", LongType()).add("n_words", LongType()).add("n_removed", LongType()).add("kept_text", "string")
    if carry:
        schema = schema.add("document", rows.schema["document"].dataType)
    return map_batches(joined, _strip(window, carry), schema)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_substrings(with_row_key(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM dup),
w AS (SELECT r, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n FROM w ANTI JOIN gone USING (r, j) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
