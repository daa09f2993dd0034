"""Registration of queries and their DuckDB equivalents; readers of the provided tables in their roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame-level motion: events as (subid, run_key, ts, event_id, fd)."""
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("subid"), F.col("event_type").alias("run_key"), "ts", "event_id", (F.col("value") / 100).alias("fd"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subject by feature arrays: embeddings as (subid, label, x array<double>)."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("subid"), "label", F.col("embedding").cast("array<double>").alias("x"))


def long_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subid, label, f, x) with the position f from 0."""
    return vectors(spark, sf_dir).select("subid", "label", F.posexplode("x").alias("f", "x"))


#: The same as DuckDB sub-queries.
FRAMES = "(SELECT user_id AS subid, event_type AS run_key, ts, event_id, value / 100 AS fd FROM events)"
RUNS = f"(SELECT subid, run_key, count(*) AS n_frames, round(avg(fd), 6) AS mean_fd, count(fd) AS n_valid, round(avg(CASE WHEN fd < 0.2 THEN 1.0 WHEN fd >= 0.2 THEN 0.0 END), 6) AS low_ratio FROM {FRAMES} GROUP BY 1, 2)"
LONG = "(SELECT vec_id AS subid, label, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS x FROM embeddings)"
