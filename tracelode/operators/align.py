"""Alignment of step sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from ..plans.lineage import python_path


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence. A row of the table is one number, a bit for each place of a; nulls equal nothing."""
    at: dict = {}
    for k, x in enumerate(a):
        if x is not None:
            at[x] = at.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for x in b:
        if hit := row & at.get(x, 0):
            row = (row + hit | row - hit) & whole
    return len(a) - row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two arrays of strings; 0 for an empty one, null for null."""
    return pd.Series([None if x is None or y is None else common_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="Int32")


def sequences(steps: DataFrame, run: str, order: list[str], key: str) -> DataFrame:
    """Per run its keys in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(key).alias("key"))))
    return steps.groupBy(run).agg(F.transform(ordered, lambda s: s["key"]).alias("keys"))


def step_support(steps: DataFrame, run: str, order: list[str], key: str, least: float = 0.6) -> DataFrame:
    """Share of runs that have the n-th occurrence of each key, where it reaches the least support."""
    w = Window.partitionBy(run, key).orderBy(*order)
    nth = steps.select(F.col(run), F.col(key).alias("key"), F.row_number().over(w).cast("long").alias("nth"))
    total = steps.agg(F.count_distinct(run).alias("k"))
    d = nth.groupBy("key", "nth").agg(F.count("*").alias("runs")).join(F.broadcast(total))
    return d.where(F.col("runs") >= least * F.col("k")).select("key", "nth", "runs", F.round(F.col("runs") / F.col("k"), 6).alias("support"))


def family_pairs(runs: DataFrame, family: str, run: str, keys: str) -> DataFrame:
    """Each pair of runs of a family (a < b) with the length of their alignment and of both.

    A family is the handful of recordings of one task; its pairs are what medoid and orthogonality
    are defined on.
    """
    python_path(runs.sparkSession)
    a = runs.select(F.col(family).alias("family"), F.col(run).alias("a"), F.col(keys).alias("x"))
    b = runs.select(F.col(family).alias("family"), F.col(run).alias("b"), F.col(keys).alias("y"))
    p = a.join(b, "family").where("a < b").repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "family", "a", "b")
    return p.select("family", "a", "b", lcs_length(F.col("x"), F.col("y")).cast("long").alias("lcs"), F.size("x").alias("n_a"), F.size("y").alias("n_b"))


def medoids(pairs: DataFrame) -> DataFrame:
    """Per family the run with the largest summed alignment to the others; ties: the least run."""
    both = pairs.select("family", F.col("a").alias("run"), "lcs").union(pairs.select("family", "b", "lcs"))
    total = both.groupBy("family", "run").agg(F.sum("lcs").alias("total"))
    best = F.max_by(F.struct("run", "total"), F.struct("total", -F.col("run"))).alias("m")
    return total.groupBy("family").agg(best).select("family", "m.run", "m.total")


def orthogonality(pairs: DataFrame) -> DataFrame:
    """Per family the mean share of the shorter sequence that aligns; empty sequences are left out."""
    share = F.col("lcs") / F.least("n_a", "n_b")
    return pairs.where("n_a > 0 and n_b > 0").groupBy("family").agg(F.round(F.avg(share), 6).alias("orthogonality"))


def varying_words(commands: DataFrame, text: str) -> DataFrame:
    """Commands of one verb and word count: at each place, how many words occur, and whether it is a slot (more than one)."""
    words = commands.select(F.split(text, " ").alias("w")).where(F.size("w") > 0)
    at = words.select(F.get("w", F.lit(0)).alias("verb"), F.size("w").cast("long").alias("n_words"), F.posexplode("w").alias("place", "word"))
    at = at.withColumn("place", F.col("place").cast("long"))
    d = at.groupBy("verb", "n_words", "place").agg(F.count_distinct("word").alias("n_values"))
    return d.withColumn("slot", F.col("n_values") > 1)


def discriminating(rows: DataFrame, run: str, variant: str, slots: list[str]) -> DataFrame:
    """variant, slot, is_condition: the runs with the variant have one value of the slot and no other run has it.

    rows: a row for each run and variant that it has, with the run's slot values.
    """
    values = rows.select(run, F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col(s).cast("string").alias("value")) for s in slots])).alias("x")).select(run, "x.*").distinct()
    inside = rows.select(run, F.col(variant).alias("variant")).distinct().join(values, run).groupBy("variant", "slot", "value").agg(F.count("*").alias("n_in"))
    total = values.groupBy("slot", "value").agg(F.count("*").alias("n_all"))
    runs = values.groupBy("slot").agg(F.count("*").alias("n_runs"))
    d = inside.join(total, ["slot", "value"]).join(F.broadcast(runs), "slot")
    d = d.groupBy("variant", "slot").agg(F.count("*").alias("n_values"), F.sum("n_in").alias("n_in"), F.sum("n_all").alias("n_all"), F.first("n_runs").alias("n_runs"))
    return d.select("variant", "slot", ((F.col("n_values") == 1) & (F.col("n_in") == F.col("n_all")) & (F.col("n_in") < F.col("n_runs"))).alias("is_condition"))
