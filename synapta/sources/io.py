"""Scans and sinks of the domain's text and record files, through Spark's readers and writers only."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from synapta.functions import na_parse, recode_strict


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of the cluster (spark.checkpoint.dir), deleted when the driver's JVM ends. Without that
    setting a local folder serves a local master; on a cluster it is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    folder = f"{root}/tables/{spark.sparkContext.applicationId}"
    _delete_at_end(spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@functools.lru_cache(maxsize=64)
def _delete_at_end(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # only what exists can be marked
    fs.deleteOnExit(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder, so that a lost executor costs a re-read."""
    path = scratch(df.sparkSession, "checkpoint")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discover(spark: SparkSession, root: str, glob: str, keys: dict[str, str]) -> DataFrame:
    """A2: the files below ``root`` with keys recovered from their paths; ``keys``: name to pattern with one group. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    return files.select("path", "length", *(F.regexp_extract("path", p, 1).alias(k) for k, p in keys.items()))


def read_lines(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"))


def split_cells(value) -> F.Column:
    """A1: cells of a line: by tabs or commas where it has any (empty cells stay), else by blanks."""
    return F.when(value.rlike("[\t,]"), F.split(value, "[\t,]", -1)).otherwise(F.split(F.trim(value), r"\s+"))


def scan_motion(spark: SparkSession, path: str, column: str = "framewise_displacement", keys: dict[str, str] | None = None, glob: str = "*", also: tuple[str, ...] = ()) -> DataFrame:
    """A1: (path, keys, frame, fd) of motion files of any of three delimiters; the column is found by each file's header; cells that
    are not numbers give NULL. A file without the column gives NULLs. ``also``: further columns, as text."""
    lines = read_lines(spark, path, glob).withColumn("cells", split_cells(F.col("value")))
    head = lines.groupBy("path").agg(F.min_by("cells", "line").alias("header"), F.min("line").alias("first"))
    rows = lines.join(head, "path").where("line > first and trim(value) <> ''")
    place = lambda name: F.array_position(F.transform("header", lambda c: F.lower(F.trim(c))), F.lit(name))
    cell = lambda name: F.when(place(name) > 0, F.try_element_at("cells", place(name).cast("int")))
    fd = na_parse(cell(column))
    frame = F.row_number().over(Window.partitionBy("path").orderBy("line")) - 1
    return rows.select("path", *(F.regexp_extract("path", p, 1).alias(k) for k, p in (keys or {}).items()), frame.alias("frame"), fd.alias("fd"), *(F.trim(cell(c)).alias(c) for c in also))


def scan_matrix(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """A3: a headerless matrix by positions; a line of fewer cells is an error."""
    a = F.split(F.trim("value"), r"\s+")
    ok = F.when(F.size(a) >= len(names), a).otherwise(F.raise_error(F.lit(f"fewer than {len(names)} columns")))
    return read_lines(spark, path).where("trim(value) <> ''").withColumn("a", ok).select("path", "line", *(F.col("a")[i].cast("double").alias(n) for i, n in enumerate(names)))


def scan_csv(spark: SparkSession, path: str, schema: str, columns: list[str], event: tuple[str, str] | None = None, sep: str = ",") -> DataFrame:
    """A4, A5: a table with an explicit schema, its event filter and pruned columns."""
    df = spark.read.csv(path, schema=schema, header=True, sep=sep)
    if event:
        df = df.where(F.col(event[0]) == event[1])
    return df.select(*columns)


def scan_bom_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings whose first header may begin with a byte order mark."""
    df = spark.read.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def resolve_column(columns: list[str], *parts: str) -> str:
    """The first column whose name contains one of the parts; none is an error."""
    for p in parts:
        for c in columns:
            if p in c.lower():
                return c
    raise ValueError(f"no column like {parts} among {columns}")


def scan_auto_header(spark: SparkSession, path: str, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns of a table of strings, each found in the file's header by the first part that fits; ``wanted``: name to parts."""
    df = spark.read.csv(path, header=True)
    return df.select(*(F.col(f"`{resolve_column(df.columns, *parts)}`").alias(name) for name, parts in wanted.items()))


def scan_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, subid) of a list of one or more files in the order of their names and lines, blank lines left out. Lines are
    numbered within their split; only the splits' counts are summed in one place."""
    split = ["_metadata.file_path", "_metadata.file_block_start"]
    ids = spark.read.text(path).select(F.trim("value").alias("subid"), *(F.col(c).alias(n) for c, n in zip(split, ("_f", "_b"))), F.monotonically_increasing_id().alias("_line")).where("subid <> ''")
    starts = ids.groupBy("_f", "_b").count().withColumn("_before", F.sum("count").over(Window.orderBy("_f", "_b")) - F.col("count")).drop("count")
    at = F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_line")) - 1
    return ids.withColumn("_at", at).join(F.broadcast(starts), ["_f", "_b"]).select((F.col("_before") + F.col("_at")).alias("pos"), "subid")


def scan_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result records partitioned by their keys, found by partition discovery."""
    return spark.read.schema(schema).parquet(path)


def lookup_named(matrices: DataFrame, keys: list[str], name: str, candidates: list[str]) -> DataFrame:
    """Of the matrices that a key has, the one whose name comes first among ``candidates``; keys without any are left out."""
    rank = F.array_position(F.array(*map(F.lit, candidates)), F.col(name))
    best = matrices.where(rank > 0).groupBy(*keys).agg(F.min_by(F.struct(*(c for c in matrices.columns if c not in keys)), rank).alias("_m"))
    return best.select(*keys, "_m.*")


def with_fallback(preferred: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the preferred source, and those of the other for keys that it lacks."""
    return preferred.unionByName(other.join(preferred.select(*keys).distinct(), keys, "left_anti"))


def scan_sidecars(spark: SparkSession, path: str, codes: dict[str, str]) -> DataFrame:
    """(path, direction, suffix) of JSON sidecars; an unknown direction is an error."""
    j = spark.read.schema("PhaseEncodingDirection string").option("multiLine", "true").json(path)
    d = F.col("PhaseEncodingDirection")
    return j.select(F.col("_metadata.file_path").alias("path"), d.alias("direction"), recode_strict(d, codes).alias("suffix"))


def write_sorted_csv(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """A report with a fixed header, sorted; a large one is several files, in order of their names."""
    df.select(*columns).orderBy(*order).write.csv(path, header=True)


def write_id_list(df: DataFrame, path: str, key: str = "subid", pos: str = "pos") -> None:
    """One id a line in list order; a long list is several files, in order of their names."""
    df.orderBy(pos).select(F.col(key).cast("string")).write.text(path)


def write_features(df: DataFrame, path: str, feature_set: str = "feature_set") -> DataFrame:
    """Features by set as a table (``matrix``), as text with one subject's vector a line (``vectors``), and the counts of
    subjects and features of each set (``info``, JSON), which are returned."""
    df.write.partitionBy(feature_set).parquet(f"{path}/matrix")
    df.select(feature_set, F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))).alias("value")).write.partitionBy(feature_set).text(f"{path}/vectors")
    df.groupBy(feature_set).agg(F.count("*").alias("n_subjects"), F.max(F.size("x")).alias("n_features")).write.json(f"{path}/info")
    return df.sparkSession.read.schema(f"{feature_set} string, n_subjects bigint, n_features int").json(f"{path}/info")


def write_fixed_tsv(df: DataFrame, path: str, numbers: list[str], places: int = 10) -> None:
    """Tab-separated, numbers with a fixed number of places."""
    df.select(*(F.format_string(f"%.{places}f", F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns)).write.csv(path, sep="\t", header=True)


def staging_manifest(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(path, kind, name) of staged files. A rule is a pattern, a kind and a name template with {0}, {1} for the pattern's
    groups; the first rule that fits counts, files without one are left out."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, k, template in reversed(rules):
        hit, made = F.col("path").rlike(pattern), F.lit(template)
        for g in range(2):
            if f"{{{g}}}" in template:
                made = F.replace(made, F.lit(f"{{{g}}}"), F.regexp_extract("path", pattern, g + 1))
        kind, name = F.when(hit, F.lit(k)).otherwise(kind), F.when(hit, made).otherwise(name)
    return files.withColumn("kind", kind).withColumn("name", name).where("kind is not null")
