"""Registered queries of classifiers and tokenizers against plain Python over whole tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from synapta.llm import quality_classifier as qc
from synapta.llm import toxicity as tx
from synapta.llm.registry import QUERIES
from synapta.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
WRAP = 1 << 32


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def examples(spark, texts, label):
    """Labelled texts outside the held-out fold, in the order of the ids' hashes."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label, F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted((r.h, r.doc_id, r[label]) for r in labels if r[label] is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2)
    return [(texts[i], y) for _, i, y in rows if i in texts]


def ftrl(rows, epochs, alpha, beta, l1, l2):
    """Weights by plain dictionaries; rows: ({feature: value}, label)."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            x = {**x, "bias": 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def logistic(s):
    return 1 / (1 + math.exp(-max(-35, min(35, s))))


def word_features(text):
    tokens = re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", text)
    h = [zlib.crc32(t.lower().encode()) for t in tokens]
    ids = [x ^ x >> 16 for x in h] + [zlib.crc32(b"<capitals>")] * sum(len(t) > 1 and t.isupper() for t in tokens)
    for a, b in zip(h, h[1:]):
        two = zlib.crc32(b"<same>") if a == b else a * 2654435761 % WRAP ^ (b + 0x9E3779B9) % WRAP
        ids.append(two ^ two >> 15)
    count = Counter(i % (1 << qc.BITS) for i in ids)
    norm = math.sqrt(sum(c * c for c in count.values()))
    return {i: c / norm for i, c in count.items()}


def test_quality_scores_equal_plain_loops(spark, texts):
    w = ftrl([(word_features(t), y) for t, y in examples(spark, texts, "quality")], qc.EPOCHS, qc.ALPHA, qc.BETA, qc.L1, qc.L2)
    got = QUERIES["op5_quality_classifier"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        s = logistic(sum(w.get(i, 0.0) * v for i, v in word_features(texts[r.doc_id]).items()) + w["bias"])
        assert r.score == pytest.approx(s, abs=1e-5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)


def ngrams(text):
    out = set()
    for word in set(re.findall(r"\w+", text.lower())):
        c = [ord(x) for x in f" {word} "]
        for n in tx.SIZES:
            for i in range(len(c) - n + 1):
                h = n
                for x in c[i : i + n]:
                    h = (h ^ x) * 0x9E3779B97F4A7C15 % (1 << 64)
                    h ^= h >> 29
                out.add(h % (1 << tx.BITS))
    return out


def test_toxicity_scores_equal_plain_loops(spark, texts):
    rows = [(ngrams(t), y) for t, y in examples(spark, texts, "toxic")]
    p, q = Counter(), Counter()
    for x, y in rows:
        (p if y else q).update(x)
    width = 1 << tx.BITS
    all_p, all_q = sum(p.values()) + width, sum(q.values()) + width
    ratio = lambda i: math.log((p[i] + 1) / all_p) - math.log((q[i] + 1) / all_q)
    w = ftrl([({i: ratio(i) for i in x}, y) for x, y in rows], tx.EPOCHS, tx.ALPHA, tx.BETA, tx.L1, tx.L2)
    got = QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        s = logistic(sum(w.get(i, 0.0) * ratio(i) for i in ngrams(texts[r.doc_id])) + w["bias"])
        assert r.score == pytest.approx(s, abs=1e-4) and r.predicted == (r.score >= 0.3)


def word_ids(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query_equals_library(spark, texts):
    got, start = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, SF).collect()}, 0
    for i, ids in sorted(word_ids(texts).items()):
        ids = [*ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert set(got) == set(texts)


def test_token_counts_query_equals_library(spark, texts):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in QUERIES["op4_token_counts"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        n = len(lib.encode(t))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 4096)


def test_packing_query_equals_library(spark, texts):
    rows = QUERIES["op7_packing"](spark, SF).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in word_ids(texts).items():
        ids, at = [*ids, 2], 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
        total += at
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.02 * total + 4096
