"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from synapta.llm import chat_format, decontaminate, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, token_files, toxicity
from synapta.llm.common import scratch_root, with_row_key
from synapta.llm.tokens import vocabulary

PROSE = " ".join(f"w{i % 97}x{i % 89}." for i in range(120))
LONG = " ".join(f"a{i % 5003}b{i % 4999}" for i in range(60_000))
# clashing names: score, key, n_words, sequence_id, document
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, n_words int, sequence_id string, document string, spans int"
ROWS = [
    (1, PROSE, "en", "s", 1, None, "k", None, None, "d", 3),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", "s", 0, 1.0, None, 1, "q", "d", 1),
    (4, PROSE, "en", "s", 1, 1.0, None, 1, "q", "d", 1),
    (4, PROSE, "en", "s", 1, 1.0, None, 1, "q", "d", 1),
    (None, PROSE + " tail", "en", "s", 1, 1.0, None, 1, "q", "d", 1),
    (None, " \n\t ", "en", "s", 1, 1.0, None, 1, "q", "d", 1),
    (7, LONG, "en", "s", 1, 1.0, None, 1, "q", "d", 1),
    (8, "one two", "en", "s", 1, 1.0, None, 1, "q", "d", 1),
    (9, "x" * 200_000, "en", "s", 1, 1.0, None, 1, "q", "d", 1),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, None, None), (4, 1, 0), (4, 0, 1), (None, 1, 1), (99, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def run_all(spark, docs, labels, n):
    path = f"{scratch_root(spark)}/test-{hashlib.md5(str((n, id(docs))).encode()).hexdigest()}"
    items = spark.createDataFrame([(1, PROSE), (2, None), (None, "one two"), (4, ""), (4, PROSE)], "item_id bigint, text string")
    token_files.write_token_files(docs, path, vocabulary("word_bpe_49k.json"))
    return {
        "op1": quality_rules.clean_lines(docs).collect(),
        "op2": substring_dedup.deduplicate_substrings(with_row_key(docs), carry=True).collect(),
        "op3": token_files.read_documents(spark, path).collect(),
        "op4": token_counts.count_tokens(docs, vocabulary("piece_bpe_32k.model")).collect(),
        "op5": quality_classifier.classify_quality(docs, labels, bound=50, carry=True).collect(),
        "op6": toxicity.classify_toxicity(docs, labels, bound=50).collect(),
        "op7": packing.pack_documents(docs, vocabulary("word_bpe_49k.json")).collect(),
        "op9": decontaminate.contaminated(with_row_key(docs), items).collect(),
        "op10": ngram_join.near_duplicates(with_row_key(docs)).collect(),
    }


def test_edge_rows(spark, docs, labels):
    out = run_all(spark, docs, labels, 1)
    for op in ("op1", "op2", "op3", "op4", "op5", "op6", "op10"):
        assert len(out[op]) == len(ROWS), op
        assert sorted(r.doc_id for r in out[op] if r.doc_id is not None) == [1, 2, 3, 4, 4, 7, 8, 9], op
    one = {r.doc_id: r for r in out["op1"] if r.doc_id is not None}
    assert (one[2].n_words, one[2].base_failed, one[2].kept, one[2].clean_text) == (0, True, False, "")
    assert one[1].n_words == 120 and one[1].kept
    # the text of 1 occurs four times (the longer null-id one included), so all of it goes; unique texts keep all
    two = {r.doc_id: r for r in out["op2"] if r.doc_id is not None}
    assert two[1].n_removed == 120 and two[1].kept_text == "" and two[8].n_removed == 0 and two[7].n_removed == 0
    starts = [r.start for r in sorted(out["op3"], key=lambda r: r.start)]
    assert starts[0] == 0 and len(set(starts)) == len(ROWS)
    assert {r.doc_id: r.n_tokens for r in out["op3"]}[2] == 1
    four = {r.doc_id: r for r in out["op4"] if r.doc_id is not None}
    assert (four[2].n_bytes, four[2].n_tokens, four[2].over_limit) == (0, 0, False) and four[7].over_limit
    assert all(0 <= r.score <= 1 for op in ("op5", "op6") for r in out[op])
    held = {str(i): zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3, 4, 7, 8, 9)}
    assert all(r.held_out == held[str(r.doc_id)] for r in out["op5"] if r.doc_id is not None)
    assert sum(r.length for r in out["op7"]) == sum(r.n_tokens for r in out["op3"])
    # an item without words matches nothing; equal items both match; a two-word item matches its text
    assert {(r.doc_id, r.item_id) for r in out["op9"]} >= {(1, 1), (1, 4), (8, None)}
    assert not {r.doc_id for r in out["op9"]} & {2, 3, 7}
    ten = {r.key: r for r in out["op10"]}
    groups = {}
    for r in ten.values():
        groups.setdefault(r.root, []).append(r.n_shingles)
    assert sorted(len(g) for g in groups.values()) == [1, 1, 1, 1, 1, 1, 4]


def test_empty_tables(spark, empty, labels):
    out = run_all(spark, empty, labels.limit(0), 2)
    assert all(not rows for rows in out.values())


@pytest.mark.parametrize("rows", [ROWS, []])
def test_pipeline_stages_take_any_rows(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        got = out.collect()
        if name == "packing":
            assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
        else:
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        if name == "n-gram Jaccard join":  # four texts of one group: one of them stays
            assert len(got) == len(rows) - 3 * bool(rows)
        if name in ("substring dedup", "benchmark decontamination"):
            assert len(got) == len(rows)
        if name == "substring dedup" and rows:
            text = {r.doc_id: r.text for r in got}
            assert text[2] is None and text[3] == "" and text[1] == "" and text[8] == "one two"


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (2, None, "assistant", "y" * 200_000), (3, 1, "a: b\\", "### user: </turn>\n<|image:0|> \\")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    assert out[1].n_turns == 2 and out[1].loss_chars == 0 and out[None].n_turns == 2 and out[None].loss_chars == 2 and out[2].loss_chars == 200_000
    assert out[3].turns_sha256 == hashlib.sha256("a: b\\\n### user: </turn>\n<|image:0|> \\\n".encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).collect() == []


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "s3-like/1.png", "n_tokens": None}, {"type": "audio", "ref": None, "n_tokens": 7}, {"type": None, "text": None}]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "ok", None)], "conv_id bigint, turn bigint, role string, text string, parts array<struct<type: string, text: string, ref: string, n_tokens: bigint>>")
    a, b = chat_format.format_conversations(df).orderBy("position").collect()
    assert a.formatted == "### user: see \\<|image:0|> <|image:0|><|audio:1|></turn>\n"
    assert [(x.number, x.kind, x.n_tokens) for x in a.attachments] == [(0, "image", 576), (1, "audio", 7)] and a.placeholder_tokens == 583
    assert b.attachments == [] and b.formatted[b.loss_start : b.loss_start + b.loss_length] == "ok"
