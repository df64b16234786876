"""Plans that no single key can hold up: running sums by ranges, joins that split hot keys, components of hubs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .lineage import cut

#: A key that holds more than this part of all rows is hot, so there are fewer hot keys than this, whatever the input.
HOT_SHARE = 256
#: Fewer rows than this are no load for a task.
HOT_ROWS = 64


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dealt(df: DataFrame) -> DataFrame:
    """df over as many tasks as shuffles have: a file's rows of one row group are read by one task, whatever work follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(counts: DataFrame, keys: list[str], total: int, k: str = "k") -> DataFrame | None:
    """Of the rows of counts (keys and how many rows each has, in k), those that are hot, with the splits that they need; None: none is."""
    least = max(total // HOT_SHARE, HOT_ROWS)
    found = counts.where(F.col(k) > least).select(*keys, F.least(F.ceil(F.col(k) / least), F.lit(HOT_SHARE)).cast("int").alias("splits")).collect()  # HOT_SHARE rows at most
    if not found:
        return None
    schema = StructType([*(counts.schema[c] for c in keys), StructField("splits", IntegerType())])
    return counts.sparkSession.createDataFrame(found, schema)


def split_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner", by: list[str] | None = None) -> DataFrame:
    """big joined with small (few rows a key) on keys; rows of a hot key are dealt over its splits by the columns in by, and small's are repeated for each."""
    if hot is None:
        return big.join(small, keys, how)
    slot, splits = fresh(big, "slot"), fresh(big, "splits")
    hot = F.broadcast(hot.withColumnRenamed("splits", splits))
    deal = F.pmod(F.xxhash64(F.lit(7), *(F.col(c) for c in (by or big.columns))), F.coalesce(splits, F.lit(1))).cast("int")
    big = big.join(hot, keys, "left").withColumn(slot, deal).drop(splits)
    every = F.sequence(F.lit(0), F.coalesce(splits, F.lit(1)) - 1)
    small = small.join(hot, keys, "left").withColumn(slot, F.explode(every)).drop(splits)
    return big.join(small, [*keys, slot], how).drop(slot)


def before_in_order(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, most: int | None = None) -> DataFrame:
    """rows with name: the sum of value over the rows of the same keys before each, by order (which tells them apart).

    Rows are dealt by ranges of (keys, order), so a key of any size is spread over tasks; a range adds
    what the ranges before it have in all, a table of a row for each range and key. With most, rows
    of ranges before which the sum is already greater are left out.
    """
    own, block, start = fresh(rows, "own_value"), fresh(rows, "range_no"), fresh(rows, "range_start")
    d = rows.withColumn(own, value).repartitionByRange(*(F.col(c) for c in (*keys, *order))).withColumn(block, F.spark_partition_id())
    d = cut(d)
    ranges = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(*keys, block).agg(F.sum(own).alias(start)).withColumn(start, F.coalesce(F.sum(start).over(ranges), F.lit(0)))
    if most is not None:
        starts = starts.where(F.col(start) <= most)
    d = d.join(starts, [*keys, block])
    within = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return d.withColumn(name, F.col(start) + F.coalesce(F.sum(own).over(within), F.lit(0))).drop(own, block, start)


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows u, v with m of least (u, m, k: how many rows u has); the rows of a hub are dealt over tasks."""
    return split_join(rows, least.drop("k"), ["u"], hot_keys(least, ["u"], total))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root for every node of an edge; root is the least node of its component.

    Alternating star contraction: each round points every node's larger neighbours, then its smaller
    ones, at the least of them. Both are a partial aggregation and an equi-join, in which the rows of a
    node with very many neighbours are split. The state is cut after each round. Null ends are ignored;
    an empty graph gives an empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    last, total = None, e.count()
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("k")))
        large = _with_least(both, least, 2 * total).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")))
        small = _with_least(large, least, large.count()).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last, total = now, now[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
