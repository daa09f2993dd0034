"""Each method against brute force, an exact round trip or held-out accuracy."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from synapta.llm import decontaminate, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, token_files, tokens, toxicity
from synapta.llm.common import with_row_key

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in t}


NASTY = ["", " ", "  ", "a ", " a", "a  b   ", "\t\n", "<|endoftext|>x <|startoftext|>", "İstanbul ΣΑΣ ſ ﬁ ①²³", "é café ́x", "it's 'S don't 'RE !!'s", "a\xa0b　c\x85d", "</s> <s> <0x0A>", "▁a▁ b", "日本語 🙂🙂", "a\rb\r\n c", "x" * 5000, " " * 3000, "ß ẞ ŉ ǅ Œ", "\x1c\x1d a"]


def test_word_tokens_equal_library(texts):
    e = tokens.word_encoder(tokens.vocabulary("word_bpe_49k.json"))
    every = [*texts.values(), *NASTY]
    ids, n = e.encode(every)
    want = [e.lib.encode(t or "", add_special_tokens=False).ids for t in every]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("chunk,overlap", [(50, 4), (400, 16), (5000, 64)])
def test_spliced_counts_equal_library(texts, chunk, overlap):
    c = tokens.piece_counter(tokens.vocabulary("piece_bpe_32k.model"))
    assert c.words_apart
    for t in [*list(texts.values())[:150], *NASTY]:
        want = len(c.lib.encode(t or ""))
        assert c.count(t or "") == want and token_counts.spliced_count(c, t or "", chunk, overlap) == want


def test_splices_in_texts_without_spaces():
    c = tokens.piece_counter(tokens.vocabulary("piece_bpe_32k.model"))
    rng, encoded, starts = random.Random(2), [0], c.starts

    def counted(text, lo, hi):
        encoded[0] += hi - lo
        return starts(text, lo, hi)

    c.starts = counted
    try:
        for letters in ("abcdefghijklmnopqrstuvwxyz", "日本語文章的一是不了人我在有他这🙂é"):
            text = "".join(rng.choice(letters) for _ in range(1_000_000))
            encoded[0] = 0
            assert token_counts.spliced_count(c, text) == len(c.lib.encode(text)) and encoded[0] < 1.5 * len(text)
        for text in ["x" * 3000, "ab\n" * 900, "  a " * 800, " " * 2000 + "a", "".join(rng.choice("ab日é🙂\t ") for _ in range(3000))]:
            assert token_counts.spliced_count(c, text, 100, 8) == len(c.lib.encode(text))
    finally:
        del c.starts


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 119, 120, 121, 240, 241, 3000):
        for high in (1, 2, 9, 300, 49408, 2**20, 2**31, 2**60 - 1):
            v = rng.integers(0, high, n, dtype=np.uint64)
            v[rng.random(n) < 0.3] = 0
            w = token_files.simple8b_encode(v)
            assert (token_files.simple8b_decode(w, n) == v).all()
    assert len(token_files.simple8b_encode(np.zeros(480, np.uint64))) == 2
    with pytest.raises(ValueError):
        token_files.simple8b_encode(np.array([1 << 60], np.uint64))


def test_simple8b_words_end_with_documents():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 400, 60)
    v = rng.integers(0, 50_000, sizes.sum(), dtype=np.uint64)
    v[: sizes[:9].sum()] = 0
    ends = np.cumsum(sizes)
    words, first = token_files.simple8b_encode(v, ends)
    at = [*first.tolist(), len(words)]
    assert (token_files.simple8b_decode(words, len(v)) == v).all()
    assert all((token_files.simple8b_decode(words[x:y], k) == v[e - k : e]).all() for x, y, k, e in zip(at, at[1:], sizes, ends))


class Calls:
    """The library, noting how many texts it is given."""

    def __init__(self, lib):
        self.lib, self.given = lib, 0

    def encode_batch_fast(self, parts, **options):
        self.given += len(parts)
        return self.lib.encode_batch_fast(parts, **options)


def test_new_words_are_encoded_together():
    coder = tokens.WordEncoder(tokens.vocabulary("word_bpe_49k.json"))
    lib = coder.lib
    coder.lib = calls = Calls(lib)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeéß", k=8)) for _ in range(50)) + "it's 12½ ''re!" for _ in range(200)]
    ids, n = coder.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert calls.given < 20  # of some 10,000 different words
    coder.encode(texts)
    assert calls.given < 20


def test_new_words_beside_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "JOINED", 7)
    path, rng = tokens.vocabulary("word_bpe_49k.json"), random.Random(4)
    coder, unmarked = tokens.WordEncoder(path), tokens.WordEncoder(path)
    unmarked.last[:] = False  # as a vocabulary that does not mark the ends of words
    signs = [*"abcÄéß''’.,!?-<>|/w½¡—  \t\n\x0b1", "'s", "</w>", " the", " of"]
    for _ in range(40):
        more = ["<|endoftext|>", "日本", "🙂", "e\u0301", "İ", "ſ", "\x1c", "\xa0"] * rng.randrange(2)
        texts = [None, *("".join(rng.choices(signs + more, k=rng.choice([0, 1, 2, 5, 30, 300]))) for _ in range(20))]
        for c in (coder, unmarked):
            ids, n = c.encode(texts)
            assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [c.lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_layout(spark, texts, tmp_path):
    docs = spark.createDataFrame([(d % 50, t) for d, t in texts.items()], "doc_id bigint, text string")  # repeated ids
    token_files.write_token_files(docs, str(tmp_path), tokens.vocabulary("word_bpe_49k.json"), block_ids=3000)
    lib, at, seen = tokens.word_encoder(tokens.vocabulary("word_bpe_49k.json")).lib, 0, []
    blocks = token_files.read_token_files(spark, str(tmp_path)).orderBy("part", "block").collect()
    for b in blocks:
        assert b.start == at
        at += b.n_ids
        seen += [(d, tuple(token_files.document_ids(b, i).tolist())) for i, d in enumerate(b.doc_ids)]
    assert len(blocks) > 20 and [d for d, _ in seen] == sorted(d for d, _ in seen)
    assert Counter(seen) == Counter((d % 50, (*lib.encode(t or "", add_special_tokens=False).ids, 1)) for d, t in texts.items())


def test_token_files_follow_ids(spark, texts):
    from synapta.llm.registry import QUERIES

    lib = tokens.word_encoder(tokens.vocabulary("word_bpe_49k.json")).lib
    at = 0
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, SF).collect()}
    for doc in sorted(texts):
        a = np.array(lib.encode(texts[doc] or "", add_special_tokens=False).ids + [1], "<u4")
        r = got[doc]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(a), zlib.crc32(a.tobytes()))
        at += len(a)


@pytest.mark.parametrize("seed", range(4))
def test_packing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 5, 900, 4095, 4096, 4097, 20000, rng.randrange(1, 3000)]) for _ in range(rng.randrange(1, 400))]
    pieces = packing.pack(sizes)
    by_doc, by_seq = {}, {}
    for d, start, n, s, offset in pieces:
        by_doc.setdefault(d, []).append((start, n))
        by_seq.setdefault(s, []).append((offset, n))
    for d, size in enumerate(sizes):
        at = 0
        for start, n in sorted(by_doc[d]):
            assert start == at
            at += n
        assert at == size
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0


def test_packed_pieces_are_the_librarys_ids(spark, texts):
    """Over small windows, so that open sequences go from one to the next."""
    path = tokens.vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(2)
    pieces = packing.pack_documents(docs, path, window=20_000).collect()
    lib, by_doc, by_seq = tokens.word_encoder(path).lib, {}, {}
    for p in pieces:
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_doc.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for d, t in texts.items():
        assert b"".join(x for _, x in sorted(by_doc[d])) == np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
    sizes = []
    for parts in by_seq.values():
        assert all(o == sum(n for _, n in sorted(parts)[:i]) for i, (o, _) in enumerate(sorted(parts)))
        sizes.append(sum(n for _, n in parts))
    assert sum(s != 4096 for s in sizes) <= 2 * 12 and all(s & (s - 1) == 0 for s in sizes)  # the tails of two tasks


def test_packing_takes_the_cheapest_of_all_with_room():
    rng = random.Random(1)  # one window: short and long documents mixed, hundreds of sequences open at once
    sizes = [rng.randrange(1, 400) if rng.random() < 0.8 else rng.randrange(1500, 4000) for _ in range(2500)]
    room, cost, whole, cut = [4096] * (sum(sizes) // 4096), [0.0] * (sum(sizes) // 4096), {}, set()
    for d in sorted(range(len(sizes)), key=lambda d: (-sizes[d], d)):  # plain scan
        fits = [s for s in range(len(room)) if room[s] >= sizes[d]]
        if fits:
            s = min(fits, key=lambda s: (cost[s], s))
            room[s] -= sizes[d]
            cost[s] += sizes[d] + packing.QUADRATIC * sizes[d] ** 2
            whole[d] = s
        else:
            cut.add(d)
    assert len(room) > 300
    pieces = packing.pack(sizes)
    assert {d: s for d, _, _, s, _ in pieces if d in whole} == whole
    assert sum(d in whole for d, *_ in pieces) == len(whole)
    assert {d for d, *_ in pieces} - set(whole) == cut


def brute_windows(words_of, width=35):
    seen = Counter(tuple(w[i : i + width]) for w in words_of.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in words_of.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def passages(seed):
    rng = random.Random(seed)
    word = lambda k=400: f"w{rng.randrange(k)}"
    shared = [[word() for _ in range(rng.choice([34, 35, 36, 60, 150]))] for _ in range(6)]
    docs = {}
    for d in range(60):
        w = []
        for _ in range(rng.randrange(1, 6)):
            w += rng.choice([lambda: [word() for _ in range(rng.randrange(80))], lambda: list(rng.choice(shared)), lambda: ["a"] * rng.choice([10, 36, 80]), lambda: ["p", "q"] * rng.choice([10, 18, 40])])()
        docs[d] = w
    docs[60] = list(docs[3])
    return docs


@pytest.mark.parametrize("heavy", [2048, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", heavy)  # 1: every open anchor is settled by digests
    docs = passages(1)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id bigint, text string").repartition(4)
    want = brute_windows(docs)
    got = {r.doc_id: r.kept_text for r in substring_dedup.deduplicate_substrings(with_row_key(df)).collect()}
    assert got == {d: " ".join(w) for d, w in want.items()}


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("task", [1_500_000, 300])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, task):
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", task)  # 300: families are cut into blocks
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 40, 90]))] for _ in range(6)]
    common = [f"c{i}" for i in range(60)]
    texts = {}
    for d in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
        texts[d] = " ".join(w + (common if rng.random() < 0.3 else []))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.root) for r in ngram_join.near_duplicates(with_row_key(df)).collect()}
    assert got == brute_components(texts)


def test_components_of_repeated_ids(spark, tmp_path):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "x y z"), (None, "x y z"), (None, None), (2, "q")]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op10_ngram_join(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([(5, 3, 3), (3, 3, 3), (3, 1, 3), (None, 1, 3), (None, 0, None), (2, 1, 2)], key=repr)


def test_adaptive_prefix_grows():
    counts = np.full(1 << ngram_join.SKETCH_BITS, 900, "<i8")  # full buckets, none of a frequent shingle
    sketch = ngram_join.Sketch(counts.tobytes())
    s = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 100).astype(np.uint64))
    assert len(ngram_join.prefix(s, sketch, 80)[0]) == 22 and ngram_join.prefix(s, sketch, 80)[1] == 2
    counts[s[:90] >> sketch.shift] += 1000
    p, m = ngram_join.prefix(s, ngram_join.Sketch(counts.tobytes()), 80)
    assert m == 5 and len(p) == 25 and set(s[90:]) <= set(p)  # more candidates, more matches; frequent shingles last


def at_threshold(n, rng, i):
    """A text of n words and a copy of it with a similarity between 0.8 and 0.86: as many edits from the ends as that takes."""
    item = [f"w{i}x{rng.randrange(10**6)}" for _ in range(n)]
    m, copy = n - 4, list(item)
    lost = m // 9  # shingles that may go
    if lost > 5:
        copy[-1 - (lost - 6)] = f"e{i}"
        lost = 5
    if lost:
        copy[lost - 1] = f"f{i}"
    return item, copy


def test_simhash_finds_pairs_at_the_threshold(spark):
    """Recall by item length, over pairs of a similarity just at the threshold: all have to be found."""
    rng, items, docs = random.Random(3), {}, {}
    for n in (14, 16, 24, 32, 40, 50, 59):
        for j in range(40):
            i = n * 100 + j
            items[i], copy = at_threshold(n, rng, i)
            docs[i] = [f"x{i}y{k}" for k in range(20)] + copy + [f"y{i}z{k}" for k in range(20)]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(with_row_key(d), b).collect()}
    found = {n: sum((n * 100 + j, n * 100 + j) in got for j in range(40)) / 40 for n in (14, 16, 24, 32, 40, 50, 59)}
    assert found == dict.fromkeys(found, 1.0)
    assert all(0.8 <= r.similarity < 0.87 and r.start in (19, 20) for r in got.values())  # 19: an edited last word is as good outside


def test_blocks_leave_out_unrelated_pairs(spark):
    """Of pairs of equal length beyond the radius, at most a fifth is joined; all within it are."""
    rng = random.Random(4)
    item = lambda i: (i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)))
    items = decontaminate.benchmark_items(spark.createDataFrame([item(i) for i in range(60)], "item_id bigint, text string"))
    windows = decontaminate.benchmark_items(spark.createDataFrame([item(i) for i in range(60)], "item_id bigint, text string"))
    windows = windows.selectExpr("item_id as key", "0 as start", "n_words", "fingerprint")
    joined = decontaminate.block_pairs(windows, items).count()
    assert joined <= 60 * 60 / 5
    four = 15 * decontaminate._ONES  # four bits of each block, but three of one: as many as the radius allows
    flipped = items.selectExpr("item as key", "0 as start", "n_words", f"transform(fingerprint, (f, j) -> f ^ if(j = 4, {four - (8 << 18)}L, {four}L)) as fingerprint")
    far = flipped.join(items.selectExpr("item as key", "fingerprint as g"), "key").selectExpr(f"{decontaminate._distance('fingerprint', 'g')} as d").distinct().collect()
    assert [r.d for r in far] == [decontaminate.RADIUS]
    assert decontaminate.block_pairs(flipped, items).where("key = item").count() == 60


@pytest.fixture(scope="module")
def labelled():
    d = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    d = d.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in d.doc_id])
    return d[~held], d[held]


def test_quality_held_out(labelled):
    train, test = labelled
    w = np.frombuffer(quality_classifier.fit(zip(train.text, train.quality)), "<f4")
    p = np.array(quality_classifier.score_rows(w, test.text.tolist())) >= quality_classifier.THRESHOLD
    y = test.quality.to_numpy() == 1
    assert (p == y).mean() > 0.98 and p[y].mean() > 0.995


def test_toxicity_held_out(labelled):
    train, test = labelled
    model = toxicity.fit(zip(train.text, train.toxic))
    p = np.array(toxicity.score_rows(model, test.text.tolist())) >= toxicity.THRESHOLD
    y = test.toxic.to_numpy() == 1
    assert (p == y).mean() > 0.96 and p[y].mean() > 0.78 and p[~y].mean() < 0.02


def test_line_rules():
    assert quality_rules.bad_line("a*** b&&& c###")[1] and quality_rules.bad_line("HOME | NEWS | ABOUT | HELP")[1]
    assert quality_rules.bad_line("All rights reserved.")[1] and quality_rules.bad_line("der der der der der der der.")[1]
    assert quality_rules.bad_line("A!! B!! C!! D!!")[1] and quality_rules.bad_line(" ".join("abcdefghijkl"))[1]
    assert quality_rules.bad_line("Tous droits réservés.")[1] and quality_rules.bad_line("Bitte HIER KLICKEN.")[1]
    assert not quality_rules.bad_line("A plain sentence, with words.")[1] and quality_rules.bad_line(" \t")[0] == 0


def test_space_marks_in_texts_count_as_the_library_does():
    c = tokens.piece_counter(tokens.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(5)
    parts = ["▁", "▁▁", " ", "  ", "a", "word", "the", "🙂", "\n", "é", "▁the", "日"]
    for _ in range(10_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert c.count(t) == len(c.lib.encode(t)), repr(t)
    for t in ["▁ ", " ▁", "▁" * 40, " ▁ ▁ " * 300]:
        assert c.count(t) == token_counts.spliced_count(c, t, 50, 4) == len(c.lib.encode(t)), repr(t)


def test_stems_stand_for_all_phrases():
    rng = random.Random(6)
    for phrase in ["All RIGHTS reserved", "terms of service", "TERMS OF USE", "accept all cookies", "accept cookies", "subscribe to our", "share on ", "aceptar las cookies", "Suscríbete", "SUSCRÍBETE", "l\u0131cen\u017fed under", "terms of u\u017fe", "Datenschutzerklärung"]:
        assert quality_rules._boilerplate.search(phrase) and quality_rules.may_hold_phrase(phrase)
    for _ in range(3000):
        t = "".join(rng.choice(["all ", "rights ", "Reserved", "click ", "here", "K", "İ", "ı", "ſ", "share ", "this", "COOKIES", "accept "]) for _ in range(6))
        assert quality_rules.may_hold_phrase(t) or not quality_rules._boilerplate.search(t)

def test_decontamination_with_shuffled_tables_is_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    found = lambda: sorted(map(tuple, decontaminate.contaminated(with_row_key(docs), items).collect()))
    whole = found()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert found() == whole and whole
