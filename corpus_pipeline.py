"""Corpus preparation: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes the documents that the stage before it kept and returns documents of the same columns; the last returns
packed pieces with their token ids. ``run`` writes each stage's result to the shared folder and reads it back for the next.

Every stage takes any rows: repeated rows and rows of null ids are documents of their own, null and empty texts have no words,
very long texts are read whole, other columns come along whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synapta.llm.common import materialise, table, with_row_key, without_keys
from synapta.llm.decontaminate import contaminated
from synapta.llm.ngram_join import near_duplicates
from synapta.llm.packing import VOCABULARY, pack_documents
from synapta.llm.quality_classifier import classify_quality
from synapta.llm.substring_dedup import deduplicate_substrings
from synapta.llm.tokens import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null or empty text is judged like a row without features; without any label all
    scores are 0.5, so nothing is kept."""
    return classify_quality(docs, table(spark, sf_dir, "labels"), carry=True).where("predicted = 1").select("document.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of the least key (doc_id, where ids are unique; else the key made up
    for the row, so that one of the repeated rows stays). Texts without words are alone and stay."""
    rows = with_row_key(docs)
    return without_keys(rows, near_duplicates(rows).where("key <> root")).select("document.*")


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text that loses nothing stays as it is (null stays null),
    one that loses all is ''. n_chars follows the text."""
    rows = deduplicate_substrings(with_row_key(docs), carry=True)
    rows = rows.withColumn("text", F.expr("case when n_removed = 0 then document.text else kept_text end"))
    new = {"text": F.col("text"), "n_chars": F.expr("case when n_removed = 0 then document.n_chars else char_length(text) end") if "n_chars" in docs.columns else None}
    return rows.select(*(new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"document.`{c}`").alias(c) for c in docs.columns))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Texts and items without words match nothing."""
    rows = with_row_key(docs)
    return without_keys(rows, contaminated(rows, table(spark, sf_dir, "benchmark"))).select("document.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences, one row a piece, with token ids. A null or empty text is one end id. Workers keep fewer words than packing
    alone would let them, as executors come here with a heap that the joins before have grown."""
    return pack_documents(docs, vocabulary(VOCABULARY), cache_bytes=48 << 20)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_leaks),
    ("packing", packed),
]

#: The classifier is learnt, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
