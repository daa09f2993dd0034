"""Cohort algebra: filters, joins in list order, family rules, set comparison, priorities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_cases(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows without NULL in those of the wanted columns that exist."""
    return df.na.drop(subset=[c for c in wanted if c in df.columns])


def members(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """C4: rows whose key is in a list."""
    return df.join(ids.select(key), key, "left_semi")


def excluded(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in a list of exclusions."""
    return df.join(ids.select(key), key, "left_anti")


def age_floor(df: DataFrame, age: str, least: float) -> DataFrame:
    """Rows not below an age; an unknown age is kept (trap T22)."""
    return df.where(~F.coalesce(F.col(age) < least, F.lit(False)))


def required_runs(df: DataFrame, subject: str, run: str, needed: list) -> DataFrame:
    """Subjects that have all required runs."""
    found = df.where(F.col(run).isin(needed)).groupBy(subject).agg(F.count_distinct(run).alias("n"))
    return found.where(F.col("n") == len(needed)).select(subject)


def select_runs(runs: DataFrame, summary: DataFrame, subject: str, run: str) -> DataFrame:
    """Runs to use; a subject without a summary keeps all of its runs (trap T6)."""
    known = summary.select(subject, run, F.col("valid").alias("_valid"))
    any_known = summary.select(subject).distinct().withColumn("_known", F.lit(True))
    out = runs.join(known, [subject, run], "left").join(any_known, subject, "left")
    return out.where(F.when(F.col("_known").isNull(), True).otherwise(F.coalesce("_valid", F.lit(False)))).drop("_valid", "_known")


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """C11: the frame itself, or an error that names the missing columns."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The frame itself; a NULL or repeated key is an error when the rows are read."""
    n = F.count("*").over(Window.partitionBy(*keys))
    bad = (n > 1) | reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    return df.withColumn("_ok", F.when(bad, F.raise_error(F.lit(f"key is null or repeated: {keys}"))).otherwise(True)).where("_ok").drop("_ok")


def complete_blocks(df: DataFrame, subject: str, block: str, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Subjects that have all blocks, and the missing (subject, block) pairs of the others."""
    have = df.where(F.col(block).isin(needed)).select(subject, block).distinct()
    complete = have.groupBy(subject).agg(F.count("*").alias("n")).where(F.col("n") == len(needed)).select(subject)
    all_pairs = df.select(subject).distinct().withColumn(block, F.explode(F.array(*map(F.lit, needed))))
    return complete, all_pairs.join(have, [subject, block], "left_anti")


def inner_chain(tables: list[DataFrame], key: str) -> DataFrame:
    """Inner joins on one key; a column that the left side has already is dropped from the right."""
    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(b.select(key, *(c for c in b.columns if c not in a.columns)), key)
    return reduce(join, tables)


def left_chain(listed: DataFrame, tables: list[DataFrame], key: str) -> DataFrame:
    """Left joins from an ordered list."""
    return reduce(lambda a, b: a.join(b, key, "left"), tables, listed)


def overlay(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The old table with the new values where there are any; its columns and their order stay."""
    joined = old.join(new.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns)), key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else c for c in old.columns))


def align(listed: DataFrame, df: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """Rows for the listed keys with their position; keys without a row are left out, or an error if strict."""
    if not strict:
        return listed.join(df, key)
    out = listed.join(df.withColumn("_there", F.lit(True)), key, "left")
    # a filter, as a column that is dropped again would not be computed
    return out.where(F.when(F.col("_there").isNull(), F.raise_error(F.lit("listed key without a row"))).otherwise(True)).drop("_there")


def missing_keys(listed: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Listed keys without a row."""
    return listed.join(df.select(key), key, "left_anti")


def family_lookup(df: DataFrame, families: DataFrame, key: str, family: str) -> DataFrame:
    """Family of each row; a missing one is an error."""
    out = df.join(families.select(key, family).dropDuplicates([key]), key, "left")
    return out.withColumn(family, F.when(F.col(family).isNotNull(), F.col(family)).otherwise(F.raise_error(F.lit("no family"))))


def best_source(df: DataFrame, keys: list[str], priority: list[str], whole: list[str] | None = None) -> DataFrame:
    """Rows of the source with the least priority. With ``whole`` the least is taken over those keys, so that all
    rows of a subject come from one source; otherwise one row a key stays."""
    if whole:
        return df.withColumn("_p", F.min(F.struct(*priority)).over(Window.partitionBy(*whole))).where(F.struct(*priority) == F.col("_p")).drop("_p")
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*priority))).where("_r = 1").drop("_r")


def attrition(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Rows before and after each filter, in one pass over the table."""
    keep, aggs, before = F.lit(True), [], F.count("*")
    for i, (name, rule) in enumerate(steps):
        keep = keep & F.coalesce(rule, F.lit(False))
        after = F.count_if(keep)
        aggs.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), before.alias("n_in"), after.alias("n_out")))
        before = after
    return df.agg(F.array(*aggs).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def na_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs of each column."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    return one.unpivot([], columns, "column", "n_null")


def first_of_family(df: DataFrame, family: list[str], order: list[str]) -> DataFrame:
    """the first row of each family in list order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*family).orderBy(*order))).where("_r = 1").drop("_r")


def repeated_families(df: DataFrame, family: list[str]) -> DataFrame:
    """families of more than one row."""
    return df.groupBy(*family).agg(F.count("*").alias("n_members")).where("n_members > 1")


def list_difference(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """H1, H2, H3: each distinct key as added, removed or common."""
    o, n = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    both = o.join(n, key, "full")
    return both.select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("common").alias("change"))


def session_overlap(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Full join of two acquisitions; an unmatched volume pairs with itself and gets index -1 for the other side."""
    left = a.select(*keys, F.col("idx").alias("idx_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    right = b.select(*keys, F.col("idx").alias("idx_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    out = left.join(right, keys, "full")
    picked = [F.coalesce(f"{c}_{s}", f"{c}_{o}").alias(f"{c}_{s}") for c in columns for s, o in (("a", "b"), ("b", "a"))]
    return out.select(*keys, F.coalesce("idx_a", F.lit(-1)).alias("idx_a"), F.coalesce("idx_b", F.lit(-1)).alias("idx_b"), *picked)


def site_codes(df: DataFrame, site: str, out: str = "site_code") -> DataFrame:
    """Sites numbered from 0 in sorted order. The window runs over the distinct sites only."""
    codes = df.select(site).where(F.col(site).isNotNull()).distinct().withColumn(out, F.row_number().over(Window.orderBy(site)) - 1)
    return df.join(F.broadcast(codes), site, "left")


def ensure_id(df: DataFrame, sources: list[str], out: str = "subid") -> DataFrame:
    """B2: the id column, from the first of the listed columns that exists."""
    if out in df.columns:
        return df
    for c in sources:
        if c in df.columns:
            return df.withColumn(out, F.col(c).cast("string"))
    raise ValueError(f"no id column among {sources}")
