"""Procedures: templates filled with values, and segments of their steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLOT = r"\{\{([^{}]+)\}\}"


def fill(template: Column, values: Column) -> Column:
    """template with each {{name}} replaced from a map; names without a value stay."""
    return F.aggregate(F.map_entries(values), template, lambda t, e: F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), F.coalesce(e["value"], F.lit(""))))


def missing_names(text: Column) -> Column:
    """Names of the slots that are left, in order, once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_SLOT), F.lit(1)), lambda x: F.trim(x)))


def uncovered(cuts: DataFrame, proc: str, begin: str, end: str, last: DataFrame) -> DataFrame:
    """Step ranges that no cut covers: proc, begin, end. last: proc, last_step (steps count from 1)."""
    edges = cuts.select(proc, F.col(begin).alias("b"), F.col(end).alias("e")).unionByName(last.select(proc, (F.col("last_step") + 1).alias("b"), (F.col("last_step") + 1).alias("e")))
    w = Window.partitionBy(proc).orderBy("b", "e").rowsBetween(Window.unboundedPreceding, -1)
    d = edges.withColumn("reach", F.coalesce(F.max("e").over(w), F.lit(0)))
    return d.where(F.col("b") > F.col("reach") + 1).select(proc, (F.col("reach") + 1).alias("begin"), (F.col("b") - 1).alias("end"))


def first_by_priority(rows: DataFrame, name: str, priority: str, order: str) -> DataFrame:
    """One row of each name: that of the highest priority (least number), then the first by order."""
    w = Window.partitionBy(name).orderBy(priority, order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
