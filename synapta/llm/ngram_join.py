"""n-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

Exact for its threshold. A document's shingles are put in one order for all documents, rare ones first. A prefix of
``n - ceil(t * n) + m`` shingles holds at least m of those shared with any partner. m is chosen for each document: where a first
estimate of its candidates is high, its prefix grows. Two documents of prefixes p and q that reach the threshold share o =
ceil(t * (n + l) / (1 + t)) shingles or more, so that at most n - o and l - o come between the shared ones, and at least
min(p - (n - o), q - (l - o)) of the shared ones stand in both prefixes: so many have to match before a pair is checked.

1. One pass takes each text's shingles: a hash of its set, and how often shingles fall into each of a fixed number of buckets.
2. Documents of equal sets form a class; its least key stands for it. Classes of copies of any size end here.
3. A second pass gives each class its prefix. Shingles of at most PAIR_DF prefixes give pairs of fitting sizes, which stay if they share as
   many as they have to; classes that share a more frequent one are tied to the least of them without being paired. Any candidate
   pair is then inside one connected family.
4. Families are joined where they lie, many small ones in a task; one too large for a task is cut into blocks of which each
   pair is a task. There shared prefix shingles are counted, candidates are checked exactly, and a candidate that is already
   known to be in the same component is not checked again. Only links that join components leave the task.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import CACHE_BYTES, ENTRY_BYTES, map_batches, map_groups, keyed, materialise, table, without_keys, worker_cache
from synapta.llm.components import components

SHINGLE = 5
#: Buckets of the sketch are two to the power of SKETCH_BITS, or of more for a larger input: about a bucket for each 64 shingles, at most 2**22.
SKETCH_BITS, MOST_SKETCH_BITS = 18, 22
#: Shingles that one task of the last step holds.
TASK_SHINGLES = 1_500_000
#: A document of more than this many expected candidates asks for one more shared shingle, and again at each eightfold.
CHEAP_CANDIDATES = 8
#: Prefixes that may hold a shingle that is paired; beyond them it only ties.
PAIR_DF = 256
BROADCAST_IDS = 1_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """64-bit hashes of words (cached) and of shingles."""

    def __init__(self):
        import xxhash

        self.digest, self.known, self.chars = xxhash.xxh3_64_intdigest, {}, 0

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if self.chars + ENTRY_BYTES * len(known) > CACHE_BYTES:
            known.clear()
            self.chars = 0
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            new = {w for w in words if w not in known}
            known.update((w, self.digest(w)) for w in new)
            self.chars += sum(map(len, new))
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` word hashes."""
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MULT
        out ^= out >> np.uint64(31)
    return out


def hasher() -> Hasher:
    return worker_cache(("hashes",), Hasher)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes of a text: A-Z lower-cased, words of non-space characters; a shorter text is one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hasher().words(words), min(k, len(words))))


class Sketch:
    """By bucket, the shingles of all documents beyond what a bucket holds without a frequent shingle in it (four deviations):
    however full the buckets are, what is not frequent counts nothing."""

    def __init__(self, raw: bytes):
        counts = np.frombuffer(raw, "<i8")
        usual = float(np.median(counts))
        self.excess = np.maximum(counts - int(usual + 4 * usual**0.5), 0).astype(np.int32 if len(raw) and counts.max() < 1 << 31 else np.int64)
        self.shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def of(self, s: np.ndarray) -> np.ndarray:
        return self.excess[s >> self.shift]


@functools.lru_cache(maxsize=2)
def _sketch(raw: bytes) -> Sketch:
    return Sketch(raw)


def prefix(s: np.ndarray, sketch: Sketch, percent: int) -> tuple[np.ndarray, int]:
    """The prefix of a set, rare shingles first, and the number of shared ones it asks for."""
    n = len(s)
    seen = sketch.of(s)
    order = np.lexsort((s, seen))
    free = n - -(-percent * n // 100)  # shingles that a partner may lack
    # one accidental partner for each shingle of the prefix, and those that the sketch shows
    expected = free + 1 + float(seen[order[: free + 1]].sum())
    matches = 1
    while matches < n - free and expected > CHEAP_CANDIDATES * 8 ** (matches - 1):
        matches += 1
    return s[order[: free + matches]], matches


def sketch_bits(n_rows: int) -> int:
    """Bits of the sketch for a table of so many documents, of some 256 shingles each."""
    return min(MOST_SKETCH_BITS, max(SKETCH_BITS, (4 * n_rows).bit_length()))


def _survey(k: int, bits: int):
    def run(batches):
        sketch = np.zeros(1 << bits, np.int64)
        for b in batches:
            sizes, digests = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, k)
                np.add.at(sketch, s >> np.uint64(64 - bits), 1)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], names=_SURVEY)
        parts = sketch.astype("<i8").reshape(64, -1)
        used = [i for i in range(64) if parts[i].any()]
        none = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(used), pa.binary()), pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())], names=_SURVEY)

    return run


_SURVEY = ["key", "doc_id", "n", "digest", "part", "counts"]


def _add_counts(t: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), "<i8") for x in t.column("counts")], axis=0)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<i8").tobytes()], pa.binary())})


def _prefixes(k: int, percent: int, shared):
    def run(batches):
        sketch = _sketch(shared.value)
        for b in batches:
            prefixes, sizes = [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, k)
                prefixes.append((prefix(s, sketch, percent)[0] if len(s) else s).view(np.int64))
                sizes.append(len(s))
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64), pa.int64())
            at = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(at, flat)], names=["key", "n", "prefix"])

    return run


def join_locally(keys: np.ndarray, sets: list[np.ndarray], sketch: Sketch, percent: int, halves: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions) that join components, for the documents of one task, smaller sets first.

    ``halves``: with two blocks, 0 or 1 for each document; then only pairs across them are looked at.
    """
    order = np.lexsort((keys, [len(s) for s in sets]))
    chosen = [prefix(sets[i], sketch, percent) for i in range(len(sets))]
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, ids = np.unique(flat, return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    start = np.cumsum(size) - size
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    parent = list(range(len(sets)))
    posting: dict[int, array] = {}
    spare = np.array([len(p) for p, _ in chosen], np.int64) - size  # plus the overlap: matches to be found in this prefix
    links = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def overlaps(x: int, cand: np.ndarray) -> np.ndarray:
        mine = ids[start[x] : start[x] + size[x]]
        mark[mine] = True
        n = size[cand]
        ends = np.cumsum(n)
        hit = mark[ids[np.repeat(start[cand] - ends + n, n) + np.arange(ends[-1])]]
        mark[mine] = False
        return np.add.reduceat(hit, ends - n, dtype=np.int64)

    def joins(x: int, cand: np.ndarray) -> np.ndarray:
        both = overlaps(x, cand)
        return 100 * both >= percent * (size[x] + size[cand] - both)

    for x in order:
        tokens = chosen[x][0].tolist()
        met = [posting[t] for t in tokens if t in posting]
        if met:
            every = np.concatenate([np.frombuffer(m, np.int32) for m in met])
            if len(every) * 8 < len(sets):
                cand, count = np.unique(every, return_counts=True)
            else:
                count = np.bincount(every, minlength=len(sets))
                cand = np.flatnonzero(count)
                count = count[cand]
            overlap = -(-percent * (size[cand] + size[x]) // (100 + percent))
            keep = (count >= overlap + np.minimum(spare[cand], spare[x])) & (100 * size[cand] >= percent * size[x])
            if halves is not None:
                keep &= halves[cand] != halves[x]
            cand, count = cand[keep], count[keep]
            by = np.array([root(y) for y in cand.tolist()], np.int64)
            # the most promising document of each component first; the others only if it does not link
            best = np.lexsort((-count, by))
            first = best[np.concatenate([[True], by[best][1:] != by[best][:-1]])] if len(best) else best
            while len(first):
                ok = joins(x, cand[first])
                linked = set(by[first][ok].tolist())
                for y in cand[first][ok]:
                    links.append((int(x), int(y)))
                    parent[root(int(y))] = root(int(x))
                left = np.ones(len(cand), bool)
                left[first] = False
                left &= ~np.isin(by, list(linked))
                cand, by = cand[left], by[left]
                first = np.arange(len(cand))
        for t in tokens:
            posting.setdefault(t, array("i")).append(x)
    return links


def _join_group(k: int, percent: int, shared):
    def run(t: pa.Table) -> pa.Table:
        keys = t.column("key").to_numpy()
        sets = [shingles(x, k) for x in t.column("text").to_pylist()]
        blocks = t.column("block").to_numpy()
        two = len(set(blocks.tolist())) > 1
        links = join_locally(keys, sets, _sketch(shared.value), percent, blocks if two else None)
        return pa.table({"u": pa.array([keys[a] for a, _ in links], pa.int64()), "v": pa.array([keys[b] for _, b in links], pa.int64())})

    return run


def near_duplicates(rows: DataFrame, k: int = SHINGLE, percent: int = 80) -> DataFrame:
    """(key, doc_id, n_shingles, root) of every row of ``rows`` (with_row_key of documents); ``root`` is the least key of its
    component.

    Rows are linked where 100 * shared >= percent * united shingles. A null or empty text, or one without words, has no shingles
    and is linked with nothing. Rows of one id or of null ids are documents of their own (see with_row_key); other columns
    are ignored. An empty table gives no rows.
    """
    spark = rows.sparkSession
    bits = sketch_bits(rows.count())
    survey = materialise(map_batches(rows.select("key", "doc_id", "text"), _survey(k, bits), "key bigint, doc_id bigint, n bigint, digest binary, part int, counts binary"), "survey")
    counts = map_groups(survey.where("part is not null").select("part", "counts").groupBy("part"), spark, _add_counts, "part int, counts binary")
    parts = {r["part"]: bytes(r["counts"]) for r in counts.collect()}  # at most 2**MOST_SKETCH_BITS numbers, whatever the input
    width = 8 * (1 << bits) // 64
    shared = spark.sparkContext.broadcast(b"".join(parts.get(i, bytes(width)) for i in range(64)))

    sized = survey.where("part is null").select("key", "doc_id", "n", "digest")
    classes = sized.where("n > 0").groupBy("digest").agg(F.min("key").alias("cls"))
    member = materialise(sized.join(classes, "digest", "left").selectExpr("key", "doc_id", "n", "case when n > 0 then cls else key end as cls"), "member")

    copies = member.where("key <> cls or n = 0").select("key")
    prefixes = map_batches(rows.select("key", "text"), _prefixes(k, percent, shared), "key bigint, n int, prefix array<bigint>")
    prefixes = without_keys(prefixes, copies)
    prefixes = materialise(prefixes, "prefixes")
    tokens = prefixes.select("key", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("token"))
    hubs = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("key").alias("hub")).where("df > 1")
    met = materialise(tokens.join(hubs, "token"), "shared-shingles")
    tied = met.where(f"df > {PAIR_DF} and key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
    few = met.where(f"df <= {PAIR_DF}").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("n", "key", "p"))).alias("m"))
    fitting = f"filter(slice(m, i + 2, size(m)), y -> 100L * x.n >= {percent}L * y.n)"  # y is not smaller than x
    couples = few.selectExpr(f"inline(flatten(transform(m, (x, i) -> transform({fitting}, y -> struct(x.key as u, x.n as n, x.p as p, y.key as v, y.n as l, y.p as q)))))")
    couples = couples.groupBy("u", "v", "n", "p", "l", "q").agg(F.count("*").alias("shared"))
    couples = couples.withColumn("o", F.expr(f"cast(ceil({percent}L * (n + l) / {100 + percent}) as bigint)")).where("shared >= least(p + o - n, q + o - l)")
    ties = tied.union(couples.select("u", "v"))
    families = materialise(components(ties, "families").select(F.col("node").alias("key"), F.col("root").alias("family")), "families")

    weighed = families.join(member.select("key", "n"), "key")
    large = weighed.groupBy("family").agg(F.sum("n").alias("total")).where(F.col("total") > TASK_SHINGLES)
    large = large.select("family", F.ceil(F.col("total") / (TASK_SHINGLES // 2)).cast("int").alias("blocks"))
    total = weighed.agg(F.sum("n")).first()[0] or 0
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // TASK_SHINGLES))
    placed = weighed.join(large, "family", "left").withColumn("block", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int")))
    # a group: a bin of small families, or two blocks of a large one (or one block with itself)
    other = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.expr("sequence(0, blocks - 1)"))
    groups = placed.withColumn("other", F.explode(other)).selectExpr(
        "key", "block",
        f"case when blocks is null then pmod(xxhash64(family), {bins}) else family end as g",
        "case when blocks is null then -1 else least(block, other) end as lo",
        "case when blocks is null then -1 else greatest(block, other) end as hi",
    )
    ids = families.select("key")  # broadcast up to a checked number, so that other texts are not shuffled
    texts = rows.select("key", "text").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "key", "left_semi")
    links = map_groups(groups.join(texts, "key").groupBy("g", "lo", "hi"), spark, _join_group(k, percent, shared), "u bigint, v bigint")
    roots = components(links, "links")
    out = member.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    return out.selectExpr("key", "doc_id", "n as n_shingles", "coalesce(root, cls) as root")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ids_are_keys = keyed(table(spark, sf_dir, "documents"))
    found = near_duplicates(rows)
    if ids_are_keys:
        return found.select("doc_id", "n_shingles", F.col("root").alias("component_id"))
    # made-up keys do not follow the ids: the least id of each component that has more than its root, broadcast up to a checked number
    found = materialise(found, "components")
    least = materialise(found.where("key <> root").groupBy("root").agg(F.min("doc_id").alias("other")), "least-ids")
    if least.count() <= BROADCAST_IDS:
        least = F.broadcast(least)
    ids = found.where("key = root").join(least, "root", "left").selectExpr("root", "least(doc_id, other) as component_id")  # nulls are skipped
    return found.join(ids, "root").select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
"""
