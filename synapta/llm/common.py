"""Shared helpers: table access, scratch tables on the shared folder, row keys and word splitting."""

from __future__ import annotations

import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of the word contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a character class for Spark SQL and DuckDB regular expressions.
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table of a data directory with Spark's own reader (any path Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """This application's folder in the shared folder of the cluster (spark.checkpoint.dir); deleted when the driver's JVM ends.

    Without that setting a local folder serves a local master; on a cluster it is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    path = f"{root}/synapta/{spark.sparkContext.applicationId}"
    _delete_at_end(spark, path)
    return path


@functools.lru_cache(maxsize=64)
def _delete_at_end(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)  # only what exists can be marked
    fs.deleteOnExit(where)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared scratch folder and reads it back.

    Cuts lineage: a lost executor costs a re-read of Parquet, not a recomputation, and row order keys such as
    monotonically_increasing_id become stable. The table stays until the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, bool]:
    """with_row_key, and whether the ids are the keys."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct("*").alias("document"))
    bad = docs.groupBy(F.col(id_col).cast("bigint").alias("id")).count().where("count > 1 or id is null").limit(1).count()
    if not bad:
        return rows.withColumn("key", F.col("doc_id")), True
    return materialise(rows.withColumn("key", F.monotonically_increasing_id()), "keyed"), False


def with_row_key(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(key, doc_id, text, document) with one unique non-null bigint key per input row; document holds all its columns.

    The id serves as the key if it is unique and never null (one cheap pass over the id column). Otherwise rows are
    written once with a generated key, so that repeated rows and null ids stay separate documents. Keys follow the ids'
    order in the first case only.
    """
    return keyed(docs, id_col)[0]


def without_keys(rows: DataFrame, gone: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``rows`` whose key is not in ``gone`` (key). The keys are broadcast up to ``limit`` of them, and shuffled beyond."""
    gone = materialise(gone.select("key").distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= limit else gone, "key", "left_anti")


#: Bytes of rows that a Python task gets at once, unless the session says otherwise.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Returns the memory that a Python worker has freed to the machine; workers are kept between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _bounded(spark: SparkSession) -> None:
    """Long texts make batches of Spark's usual 10,000 rows large; the session's own limit of bytes goes first."""
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of bounded size, after which the worker gives its memory back."""
    _bounded(df.sparkSession)

    def task(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(task, schema)


def map_groups(grouped, spark: SparkSession, run, schema) -> DataFrame:
    """applyInArrow; the worker gives its memory back after each group."""
    _bounded(spark)

    def task(t: pa.Table) -> pa.Table:
        out = run(t)
        give_back()
        return out

    return grouped.applyInArrow(task, schema)


#: A worker's cache of words is emptied when it is estimated to hold more bytes than this.
CACHE_BYTES = 48 << 20
#: Bytes of a cached word besides its characters: the string, its number and its place in the dictionary.
ENTRY_BYTES = 150

_kept: dict = {}


def worker_cache(kind: tuple, make):
    """The large cache that a Python worker holds. Workers outlive stages, so a cache of another kind replaces the last one:
    a pipeline of several operators needs the memory of one."""
    if kind not in _kept:
        _kept.clear()
        give_back()
        _kept[kind] = make()
    return _kept[kind]


def held_out(id_col: str = "doc_id"):
    """The evaluation rows: crc32 of the id's decimal text is 2 modulo 4 (a null id counts as the text '')."""
    return F.expr(f"crc32(cast(coalesce(cast({id_col} as string), '') as binary)) % 4 = 2")


#: For DuckDB, which lacks crc32: the table of its 256 bytes as a common table expression, and the checksum of an ASCII text with it.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crcs)"


def crc32_sql(text: str) -> str:
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"
