"""Aggregates over traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_stats(rows: DataFrame, rec: str, kind: str, kinds: list[str], cost: str) -> DataFrame:
    """Per recording: rows, count of each kind, summed cost (null: 0), distinct kinds sorted and joined."""
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds]
    return rows.groupBy(rec).agg(
        F.count("*").alias("n_entries"), *counts, F.round(F.sum(F.coalesce(F.col(cost), F.lit(0.0))), 4).alias("cost"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds")
    )


def context_hogs(rows: DataFrame, text: str, order: list[str], limit: int = 15) -> DataFrame:
    """The rows of most characters, with a token estimate; ties by order."""
    chars = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    d = rows.select(*order, chars.alias("chars"), F.round(chars / 4).cast("long").alias("tokens"))
    return d.orderBy(F.desc("chars"), *order).limit(limit)


def tool_weights(rows: DataFrame, tool: str, text: str) -> DataFrame:
    chars = F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).cast("long")
    d = rows.groupBy(F.col(tool).alias("tool")).agg(F.count("*").alias("calls"), chars.alias("chars"))
    return d.withColumn("tokens", F.round(F.col("chars") / 4).cast("long"))


def outcomes(results: DataFrame, keys: list[str], order: list[str], is_error: Column, is_verification: Column, verified_error: Column) -> DataFrame:
    """Status of each run: its last verification decides; else errors with a good last result are unknown, other errors failed, none unknown."""
    at = F.struct(*order)
    d = results.groupBy(*keys).agg(
        F.max_by(F.when(is_verification, verified_error), F.when(is_verification, at)).alias("verified_bad"),
        F.count_if(is_verification).alias("n_verified"),
        F.count_if(is_error).alias("n_errors"),
        F.max_by(is_error, at).alias("last_bad"),
    )
    status = (
        F.when((F.col("n_verified") > 0) & F.col("verified_bad"), "failed")
        .when(F.col("n_verified") > 0, "success")
        .when((F.col("n_errors") > 0) & ~F.col("last_bad"), "unknown")
        .when(F.col("n_errors") > 0, "failed")
        .otherwise("unknown")
    )
    return d.select(*keys, status.alias("status"), "n_errors", "n_verified")


def combined_outcome(outcome: DataFrame, keys: list[str]) -> DataFrame:
    good, bad = F.count_if(F.col("status") == "success"), F.count_if(F.col("status") == "failed")
    d = outcome.groupBy(*keys).agg(F.count("*").alias("runs"), good.alias("good"), bad.alias("bad"))
    status = F.when(F.col("bad") == F.col("runs"), "failed").when(F.col("good") == F.col("runs"), "success").when(F.col("good") + F.col("bad") > 0, "mixed").otherwise("unknown")
    return d.select(*keys, "runs", status.alias("status"))


def string_pool(rows: DataFrame, text: str, order: str, least: int = 256) -> DataFrame:
    """Distinct long strings: digest, first row that has each, references, characters that pooling saves."""
    long_ = rows.where(F.length(text) >= least)
    d = long_.groupBy(F.md5(text).alias("digest")).agg(F.min(order).alias("first_seen"), F.count("*").alias("refs"), F.first(F.length(text)).cast("long").alias("chars"))
    return d.withColumn("saved", (F.col("refs") - 1) * F.col("chars"))


def covary(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Whether two columns are in bijection: one row with the exact distinct counts."""
    d = rows.agg(F.count_distinct(a).alias("n_a"), F.count_distinct(b).alias("n_b"), F.count_distinct(a, b).alias("n_ab"), F.count("*").alias("n"))
    return d.withColumn("together", (F.col("n") >= 2) & (F.col("n_a") >= 2) & (F.col("n_a") == F.col("n_b")) & (F.col("n_a") == F.col("n_ab")))
