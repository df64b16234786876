"""Folding the outcomes of validators into how fresh a procedure is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what tells that a check could not be made.
INCONCLUSIVE = r"(?i)ENOTFOUND|EAI_AGAIN|ETIMEDOUT|network|offline|command not found|ENOENT|EACCES"


def freshness(procedures: DataFrame, results: DataFrame, key: str, max_age_days: float = 30) -> DataFrame:
    """key, status for procedures (key, age_days) and validator results (key, exit_code, stderr).

    A result is fresh at exit 0, unknown where it can't be told, stale otherwise. Any stale one makes
    the procedure stale; without results it is unchecked, or unknown when old; with unknown ones only,
    unknown; an old one with some unknown is unknown too.
    """
    code = F.col("exit_code")
    one = F.when(code == 0, "fresh").when(code.isin(126, 127) | F.coalesce(F.col("stderr"), F.lit("")).rlike(INCONCLUSIVE), "unknown").otherwise("stale")
    n = results.select(key, one.alias("one")).groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("one") == "stale").alias("stale"), F.count_if(F.col("one") == "unknown").alias("unknown"))
    old = F.col("age_days") > max_age_days
    status = (
        F.when(F.col("n").isNull(), F.when(old, "unknown").otherwise("unchecked"))
        .when(F.col("stale") > 0, "stale")
        .when((F.col("unknown") == F.col("n")) | (old & (F.col("unknown") > 0)), "unknown")
        .otherwise("fresh")
    )
    return procedures.join(n, key, "left").select(key, status.alias("status"))


def validators(steps: DataFrame, key: str, order: list[str], most: int = 12) -> DataFrame:
    """key, nth, command for the packages and templates that a procedure's steps (templates.STEP) name, each once, in order.

    A procedure has at most so many validators, as each costs a request; those first named count.
    """
    own = steps.where(F.col("verb").rlike("^(npm|pnpm|yarn|bun|npx|bunx|cargo|go) ")).select(key, F.struct(*order).alias("__at"), F.posexplode("slots").alias("__place", "__slot"))
    own = own.where(F.col("__slot.name").rlike(r"^(package|template)\d*$")).withColumn("__name", F.split("__slot.value", "@")[0])
    first = own.where((F.col("__name") != "") & ~F.col("__name").startswith("-")).groupBy(key, "__name").agg(F.min(F.struct("__at", "__place")).alias("__first"))
    d = first.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy("__first")))
    return d.where(F.col("nth") <= most).select(key, "nth", F.concat(F.lit("npm view "), "__name", F.lit(" version")).alias("command"))
