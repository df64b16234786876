"""Requirements and what provides them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def link_requirements(steps: DataFrame, target: str, order: list[str], provides: Column, requires: Column, name: str) -> DataFrame:
    """Each requirement with the first step before it that provides the same target; null: a gap.

    One running window instead of a non-equi join: the first provider so far is a running minimum.
    """
    w = Window.partitionBy(target).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = steps.withColumn("provider", F.first(F.when(provides, F.col(name)), ignorenulls=True).over(w))
    return d.where(requires).select(target, F.col(name).alias("requirement"), "provider")


def unconsumed(steps: DataFrame, target: str, order: list[str], provides: Column, requires: Column, name: str) -> DataFrame:
    """Provisions that no later step requires."""
    w = Window.partitionBy(target).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    d = steps.withColumn("used", F.max(F.when(requires, 1)).over(w))
    return d.where(provides & F.col("used").isNull()).select(target, F.col(name).alias("provision"))


def status_fold(steps: DataFrame, run: str, order: list[str], failed: Column) -> DataFrame:
    """Steps as a stop-on-first-failure run would leave them: ok, failed, or skipped after a failure."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max(failed.cast("int")).over(w), F.lit(0))
    return steps.withColumn("status", F.when(before == 1, "skipped").when(failed, "failed").otherwise("ok"))
