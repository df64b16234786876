"""Comparing recordings and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def positional_diff(pairs: DataFrame, left: DataFrame, right: DataFrame, block: int = 1024) -> DataFrame:
    """For pairs (l, r) of recordings: common prefix length, and where and how they first differ.

    left and right have rec, pos, fp. Blocks of positions are compared by digests (sums of two 64-bit hashes of position and fingerprint,
    which partial aggregation shrinks), a row for each block and pair; only of the first block that differs do both
    sides' rows meet, so a pair costs a block however long its recordings are.
    """
    no = F.floor(F.col("pos") / block)
    hashed = lambda seed: F.sum(F.xxhash64(F.lit(seed), "pos", "fp").cast("decimal(38,0)"))

    def digests(rows: DataFrame, side: str, name: str) -> DataFrame:
        d = rows.groupBy("rec", no.alias("block")).agg(F.struct(hashed(0), hashed(1), F.count("*")).alias(name), F.max("pos").alias(f"last_{name}"))
        return pairs.join(d.withColumnRenamed("rec", side), side).select("l", "r", "block", name, f"last_{name}")

    both = digests(left, "l", "da").join(digests(right, "r", "db"), ["l", "r", "block"], "full")
    found = both.groupBy("l", "r").agg(F.min(F.when(~F.col("da").eqNullSafe(F.col("db")), F.col("block"))).alias("block"), F.max(F.greatest("last_da", "last_db")).alias("last_pos"))
    found = cut(found)
    at = found.where("block is not null").select("l", "r", "block")
    near = lambda rows, side, name: at.join(rows.select(F.col("rec").alias(side), no.alias("block"), "pos", F.col("fp").alias(name)), [side, "block"]).select("l", "r", "pos", name)
    rows = near(left, "l", "fa").join(near(right, "r", "fb"), ["l", "r", "pos"], "full")
    reason = F.when(F.col("fb").isNull(), "left-only").when(F.col("fa").isNull(), "right-only").otherwise("content")
    first = rows.where(~F.col("fa").eqNullSafe(F.col("fb"))).groupBy("l", "r").agg(F.min("pos").alias("first_diff"), F.min_by(reason, "pos").alias("reason"))
    d = found.join(first, ["l", "r"], "left")
    return d.select("l", "r", F.coalesce(F.col("first_diff"), F.col("last_pos") + 1).alias("common_prefix"), F.coalesce("reason", F.lit("identical")).alias("reason"))


def answer_divergence(answers: DataFrame, rec: str, seq: str, text: str) -> DataFrame:
    """Consecutive answers of a recording: identical, reworded (white space only) or different."""
    w = Window.partitionBy(rec).orderBy(seq)
    d = answers.withColumn("before", F.lag(text).over(w)).where("before is not null")
    plain = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    kind = F.when(F.col("before") == F.col(text), "identical").when(plain(F.col("before")) == plain(F.col(text)), "wording").otherwise("text")
    return d.select(rec, seq, kind.alias("kind"))


def digest_delta(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digests were added, removed or changed between two snapshots."""
    both = old.select(key, F.col(digest).alias("was")).join(new.select(key, F.col(digest).alias("is")), key, "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return both.select(key, state.alias("state")).where("state is not null")
