"""Benchmark decontamination in DataFrame functions only: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A window of as many words as an item has is contaminated if the multisets of 5-word shingles (lower-cased; an item of fewer words
is one shingle) have a similarity of 0.8 or more: shared occurrences / (occurrences of both - shared). Occurrence counts are
the weights.

1. A window of similarity s shares at least s * m of the item's m shingles. So shingle hashes of the texts meet the benchmark's
   (a broadcast table, size checked), and only windows that hold enough of them are looked at. This loses no window.
2. Windows and items get SimHash fingerprints of 27 blocks of 18 bits. Two within RADIUS differ in at most FREE = 3 bits of some block,
   hence in at most one bit of a half of it. Items probe all values within one bit of their halves; the join on (words, half,
   value) tests the block's FREE bits, so that it finds all pairs within the radius and about a tenth of unrelated ones.
3. Pairs within the radius are checked by the exact similarity of their shingle strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import materialise, table, with_row_key

SHINGLE, PERCENT = 5, 80
#: A fingerprint is LONGS numbers of LANES lanes of WIDTH bits; a lane is a block. Counters of a lane hold up to 2**WIDTH - 1 shingles.
LONGS, LANES, WIDTH = 9, 3, 18
#: Bits of 486 that may differ. At a similarity of 0.8 about 74 do (deviation 8): 107 is past four deviations.
RADIUS = 107
#: Benchmark shingles, probes and candidate documents up to which a side is broadcast; beyond them it is shuffled.
BROADCAST_ROWS = 500_000
#: Parts of a shingle's documents where the benchmark's shingles are shuffled.
SALTS = 16
_ONES = sum(1 << WIDTH * lane for lane in range(LANES))


def _words(text: str) -> str:
    return rf"array_remove(split(lower(coalesce({text}, '')), '[\\x20\\x09-\\x0D]+'), '')"


def _shingle_hashes(words: str, k: int) -> str:
    """Hashes of the k-word shingles of an array of words, in order."""
    parts = ", ".join(f"{words}[i + {j}]" for j in range(k))
    empty = "cast(array() as array<bigint>)"
    return f"case when size({words}) < {k} then {empty} else transform(sequence(0, size({words}) - {k}), i -> xxhash64({parts})) end"


def _shingle_texts(words: str, k: str) -> str:
    empty = "cast(array() as array<string>)"
    return f"case when size({words}) < {k} then {empty} else transform(sequence(1, size({words}) - {k} + 1), i -> array_join(slice({words}, i, {k}), ' ')) end"


def _simhash(shingles: str) -> str:
    """SimHash of an array of shingles, each occurrence counting once: LONGS numbers, whose bits say which hash bits at most half of
    the shingles have. The bits of all lanes are counted by one addition for each shingle."""
    count = f"aggregate(hj, 0L, (a, h) -> a + (shiftrightunsigned(h, b) & {_ONES}L))"
    few = f"(shiftrightunsigned(({1 << (WIDTH - 1)}L + size(hj) div 2) * {_ONES}L - {count}, {WIDTH - 1}) & {_ONES}L)"
    long = f"aggregate(sequence(0, {WIDTH - 1}), 0L, (a, b) -> a | shiftleft({few}, b))"
    # arrays of one element bind the hashes once
    longs = f"transform(sequence(1, {LONGS}), j -> transform(array(transform(hs, h -> xxhash64(h, j))), hj -> {long})[0])"
    return f"transform(array(transform({shingles}, s -> xxhash64(s))), hs -> {longs})[0]"


def _distance(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x)"


def _halves(rows: DataFrame, *keep: str) -> DataFrame:
    """(keep..., part, half, block): the two halves of each block of a fingerprint, numbered by ``part``, and the block."""
    longs = rows.selectExpr(*keep, "posexplode(fingerprint) as (j, f)")
    lanes = longs.selectExpr(*keep, "j", "f", f"explode(sequence(0, {2 * LANES - 1})) as h")
    blocks = lanes.selectExpr(*keep, f"j * {2 * LANES} + h as part", "h", f"shiftrightunsigned(f, {WIDTH} * (h div 2)) & {(1 << WIDTH) - 1}L as block")
    return blocks.selectExpr(*keep, "part", f"shiftrightunsigned(block, {WIDTH // 2} * (h % 2)) & {(1 << WIDTH // 2) - 1}L as half", "block")


def block_pairs(windows: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(key, start, n_words, item): windows and items of equal length that differ in few enough bits of some block, so all within
    the radius. The probes are some 540 for an item, and broadcast up to BROADCAST_ROWS."""
    free = radius // (LONGS * LANES)
    if free > 3:
        raise ValueError(f"a radius of {radius} leaves {free} free bits a block; the probes cover 3")
    probes = _halves(items, "item", "n_words").selectExpr("item", "n_words", "part", "half", "block as item_block", f"explode(sequence(-1, {WIDTH // 2 - 1})) as bit")
    probes = probes.selectExpr("item", "n_words", "part", "item_block", "case when bit < 0 then half else half ^ shiftleft(1L, bit) end as half")
    if items.count() * 2 * LONGS * LANES * (WIDTH // 2 + 1) <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    left = _halves(windows, "key", "start", "n_words").alias("w")
    near = F.expr(f"w.n_words = i.n_words and w.part = i.part and w.half = i.half and bit_count(w.block ^ i.item_block) <= {free}")
    return left.join(probes.alias("i"), near).select("key", "start", "w.n_words", "item").distinct()


def _shared(a: str, b: str) -> str:
    """Occurrences that two arrays of shingles share."""
    both = f"least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x)))"
    return f"aggregate(array_distinct({a}), 0, (n, x) -> n + {both})"


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, n_words, k, m, shingles, fingerprint) of the items that have words; item ids may repeat or be null."""
    rows = benchmark.selectExpr("cast(item_id as bigint) as item_id", f"{_words('cast(text as string)')} as words").where("size(words) > 0")
    rows = rows.selectExpr("item_id", "words", "size(words) as n_words", f"least({shingle}, size(words)) as k").distinct()
    rows = rows.selectExpr("item_id", "words", "n_words", "k", f"{_shingle_texts('words', 'k')} as shingles")
    return rows.selectExpr("item_id", "xxhash64(words) as item", "words", "n_words", "k", "size(shingles) as m", "shingles", f"{_simhash('shingles')} as fingerprint")


def contaminated(rows: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """The best window for each document and item that reach the threshold: key, doc_id, item_id, start (words before the window),
    n_words, similarity, distance (differing fingerprint bits). Ties go to the earliest window.

    ``rows``: with_row_key of documents; ``benchmark``: item_id, text; other columns are ignored. Null or empty texts and items match
    nothing. A document shorter than an item is one window. Repeated rows are documents of their own.
    """
    items = materialise(benchmark_items(benchmark, shingle), "items")
    sizes = items.groupBy("k").agg(F.max("m").alias("m")).collect()  # at most ``shingle`` rows
    if not sizes:
        empty = "key bigint, doc_id bigint, item_id bigint, start int, n_words int, similarity double, distance int"
        return rows.sparkSession.createDataFrame([], empty)
    if max(r["m"] for r in sizes) >= 1 << WIDTH:
        raise ValueError(f"an item of more than {(1 << WIDTH) - 1} shingles does not fit the counters of a fingerprint")
    ks = sorted(r["k"] for r in sizes)
    hashes = ", ".join(f"transform({_shingle_hashes('words', k)}, (h, i) -> struct({k} as k, i as at, h as hash))" for k in ks)  # of all lengths in one pass
    wanted = items.selectExpr("item", "n_words", "k", "m", f"inline(concat({hashes})) as (of_k, at, hash)").where("k = of_k")
    wanted = materialise(wanted.select("item", "n_words", "k", "m", "hash").distinct(), "item-shingles")
    worded = rows.selectExpr("key", f"{_words('text')} as words").selectExpr("key", f"inline(concat({hashes})) as (k, at, hash)")
    if wanted.count() <= BROADCAST_ROWS:
        met = worded.join(F.broadcast(wanted), ["k", "hash"])
    else:  # a shingle of very many documents is dealt by their keys too
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = worded.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["k", "hash", "salt"])
    # windows: the first of their hits at p, enough hits before p + m, and at most m - enough other shingles before p
    enough = f"cast(ceil({percent} * m / 100) as int)"
    hits = met.groupBy("key", "item", "n_words", "m").agg(F.array_sort(F.collect_set("at")).alias("at"))
    hits = hits.selectExpr("*", f"{enough} as enough").where("size(at) >= enough")
    starts = hits.selectExpr("key", "item", "n_words", "m - enough as slack", "filter(at, (p, i) -> i + enough <= size(at) and at[i + enough - 1] - p < m) as firsts").where("size(firsts) > 0")
    windows = starts.selectExpr("key", "n_words", "array_distinct(flatten(transform(firsts, p -> sequence(p - slack, p)))) as starts")
    windows = windows.groupBy("key").agg(F.collect_list(F.struct("n_words", "starts")).alias("windows"))
    windows = materialise(windows, "windows")
    bounds = windows.agg(F.count("*"), F.sum(F.expr("aggregate(windows, 0L, (n, w) -> n + size(w.starts))"))).first()
    if bounds[0] <= BROADCAST_ROWS // 10 and (bounds[1] or 0) <= BROADCAST_ROWS:  # documents, and the places of windows in all
        windows = F.broadcast(windows)

    # only documents with such windows are read again; windows that would leave the text are moved inside it
    found = rows.join(windows, "key").selectExpr("key", "doc_id", f"{_words('text')} as words", "explode(windows) as w")
    found = found.selectExpr("key", "doc_id", "words", "w.n_words as n_words", "explode(array_distinct(transform(w.starts, s -> greatest(0, least(s, size(words) - w.n_words))))) as start")
    found = found.selectExpr("key", "doc_id", "n_words", "start", "slice(words, start + 1, n_words) as words").distinct()
    found = found.selectExpr("*", f"{_shingle_texts('words', f'least({shingle}, n_words)')} as shingles").drop("words")
    found = materialise(found.selectExpr("*", f"{_simhash('shingles')} as fingerprint"), "window-fingerprints")

    # the blocks are met by narrow rows; fingerprints and shingles join again for the pairs found
    both = block_pairs(found, items, radius).join(found, ["key", "start", "n_words"])
    both = both.join(items.selectExpr("item", "item_id", "m", "fingerprint as item_fingerprint", "shingles as item_shingles"), "item")
    both = both.withColumn("distance", F.expr(_distance("fingerprint", "item_fingerprint"))).where(f"distance <= {radius}")
    # a generator, so that the count is made once for each pair
    counted = f"inline(array(struct({_shared('shingles', 'item_shingles')} as both)))"
    checked = both.selectExpr("key", "doc_id", "item_id", "start", "n_words", "distance", "size(shingles) + m as of_both", counted)
    checked = checked.withColumn("united", F.expr("of_both - both")).where(f"100 * both >= {percent} * united").withColumn("similarity", F.expr("both / united"))
    best = checked.groupBy("key", "doc_id", "item_id").agg(F.max_by(F.struct("start", "n_words", "similarity", "distance"), F.struct("similarity", F.expr("-start"), F.expr("-n_words"))).alias("w"))
    return best.select("key", "doc_id", "item_id", "w.start", "w.n_words", "w.similarity", "w.distance")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(with_row_key(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "similarity")


#: Brute force: every window of every document that shares a shingle with an item, without fingerprints.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
bs AS (SELECT item_id, len(ws) AS n, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) AS sh FROM b WHERE len(ws) >= 5),
ds AS (SELECT r, doc_id, len(ws) AS len_d, list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) AS sh FROM d WHERE len(ws) >= 5),
be AS (SELECT item_id, n, len(sh) AS m, unnest(sh) AS s FROM bs),
bc AS (SELECT item_id, n, m, s, count(*) AS c FROM be GROUP BY ALL),
de AS (SELECT r, unnest(range(0, len(sh))) AS p, unnest(sh) AS s FROM ds),
hit AS (SELECT r, item_id, n, m, p, s, c FROM de JOIN bc USING (s)),
st AS (SELECT DISTINCT r, item_id, n, m, greatest(0, least(t, len_d - n)) AS start, len_d
  FROM (SELECT r, item_id, n, m, unnest(range(p - m + 1, p + 1)) AS t FROM hit) JOIN ds USING (r)),
inw AS (SELECT st.r, st.item_id, st.n, st.m, start, len_d, s, any_value(c) AS c, count(*) AS k FROM st JOIN hit USING (r, item_id)
  WHERE p >= start AND p <= start + least(st.n, len_d) - 5 GROUP BY ALL),
sim AS (SELECT r, item_id, n, start, sum(least(c, k)) AS i, m + least(n, len_d) - 4 AS t FROM inw GROUP BY r, item_id, n, m, start, len_d),
ok AS (SELECT *, i / (t - i) AS similarity FROM sim WHERE 100 * i >= 80 * (t - i)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, item_id ORDER BY similarity DESC, start) AS k FROM ok)
SELECT doc_id, item_id, CAST(start AS INT) AS start, CAST(n AS INT) AS n_words, CAST(similarity AS DOUBLE) AS similarity
FROM best JOIN d USING (r) WHERE k = 1
"""
