"""Ordered traces: prefix hashes, running context, trees and their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import comparable_text
from ..plans.lineage import cut

UNIT, RECORD = "\x1f", "\x1e"


def prefix_hashes(messages: DataFrame, rec: str, seq: str, role: str, text: str, last: int | None = None, skip_system: bool = False) -> DataFrame:
    """messages with prefix_hash: SHA-256 over the messages strictly before each one (or the last few of them).

    The digest of an unbounded prefix needs the prefix itself, so one recording is one window.
    """
    d = messages.where(F.col(role) != "system") if skip_system else messages
    w = Window.partitionBy(rec).orderBy(seq).rowsBetween(-last if last else Window.unboundedPreceding, -1)
    line = F.concat_ws(UNIT, F.col(role), F.col(text))
    return d.withColumn("prefix_hash", F.sha2(F.array_join(F.collect_list(line).over(w), RECORD), 256))


def prefix_digests(messages: DataFrame, rec: list[str], seq: str, role: str, text: str, block: int = 4096) -> DataFrame:
    """messages with prefix_digest: equal prefixes (the messages before each, in order) have equal digests.

    Each message's own hash is hashed with its position (so its text is not shuffled for the digest), and the hashes are added, so a prefix has a sum that is
    found from the sums of blocks of ``seq`` (an integer) and those within a block. A recording of any
    length is spread over tasks, at linear cost; four sums of 60 bits hold the digest.
    """
    d = messages.withColumns({"__block": F.floor(F.col(seq) / block), "__line": F.sha2(F.concat_ws(UNIT, F.col(role), F.col(text)), 256)})
    key = [*rec, "__block"]
    within = Window.partitionBy(*key).orderBy(seq)
    blocks = Window.partitionBy(*rec).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    first = d.groupBy(*key).agg(F.count("*").alias("__n")).withColumn("__at", F.coalesce(F.sum("__n").over(blocks), F.lit(0))).drop("__n")
    d = d.join(first, key).withColumn("__at", F.col("__at") + F.row_number().over(within) - 1)
    own = F.sha2(F.concat_ws(UNIT, F.col("__at").cast("string"), "__line"), 256)
    parts = [f"__p{k}" for k in range(4)]
    d = d.withColumn("__h", own).withColumns({p: F.conv(F.substring("__h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)") for k, p in enumerate(parts)})
    none = F.lit(0).cast("decimal(30,0)")
    whole = d.groupBy(*key).agg(*[F.sum(p).alias(p) for p in parts])
    whole = whole.select(*key, *[F.coalesce(F.sum(p).over(blocks), none).alias(f"{p}b") for p in parts])
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({p: F.coalesce(F.sum(p).over(before), none) for p in parts}).join(whole, key)
    total = [(F.col(p) + F.col(f"{p}b")).cast("decimal(38,0)").cast("string") for p in parts]
    return d.select(*messages.columns, F.sha2(F.concat_ws(",", F.col("__at").cast("string"), *total), 256).alias("prefix_digest"))


def compacted_views(messages: DataFrame, compactions: DataFrame, rec: str, seq: str, role: str, text: str) -> DataFrame:
    """Per compaction the history as it reads from there on: rec, view, seq, role, text.

    compactions: rec, at (its place), kept (place of the first kept message), summary. A view is the
    summary, the kept messages and what follows up to the next compaction; a recording has few of them.
    """
    w = Window.partitionBy("rec").orderBy("at")
    c = compactions.select(F.col("rec"), F.col("at").alias("view"), "kept", "summary", F.lead("at").over(w).alias("until"))
    head = c.select("rec", "view", (F.col("kept") - 1).alias("seq"), F.lit("compactionSummary").alias("role"), F.trim("summary").alias("text"))
    m = messages.select(F.col(rec).alias("rec"), F.col(seq).alias("seq"), F.col(role).alias("role"), F.col(text).alias("text"))
    rest = m.join(c, "rec").where((F.col("seq") >= F.col("kept")) & (F.col("until").isNull() | (F.col("seq") < F.col("until"))))
    return head.unionByName(rest.select("rec", "view", "seq", "role", "text"))


def running_last(rows: DataFrame, rec: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the latest value that is not null among the rows before each."""
    w = Window.partitionBy(rec).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def leaves(entries: DataFrame, rec: str, node: str, parent: str) -> DataFrame:
    """Entries that are no other's parent."""
    parents = entries.where(F.col(parent).isNotNull()).select(F.col(rec), F.col(parent).alias(node)).distinct()
    return entries.join(parents, [rec, node], "left_anti")


def branch_points(entries: DataFrame, rec: str, parent: str) -> DataFrame:
    """Parents of more than one entry, with the number of children."""
    return entries.where(F.col(parent).isNotNull()).groupBy(rec, F.col(parent).alias("node")).agg(F.count("*").alias("children")).where("children > 1")


def depths(entries: DataFrame, rec: str, node: str, parent: str, rounds: int = 40) -> DataFrame:
    """rec, node, depth: number of ancestors of every entry, by pointer doubling; a dangling parent is a root.

    Each round doubles the reach of the pointers, so a path of length n takes log2(n) rounds of one
    self-join, not n. Cycles are refused.
    """
    known = entries.select(rec, F.col(node).alias("p"))
    state = entries.select(rec, F.col(node).alias("node"), F.col(parent).alias("p")).join(known.distinct(), [rec, "p"], "left_semi")
    roots = entries.select(rec, F.col(node).alias("node")).join(state.select(rec, "node"), [rec, "node"], "left_anti")
    state = state.withColumn("depth", F.lit(1).cast("long")).unionByName(roots.select(rec, "node", F.lit(None).cast(dict(state.dtypes)["p"]).alias("p"), F.lit(0).cast("long").alias("depth")))
    for _ in range(rounds):
        if state.where("p is not null").isEmpty():
            return state.select(rec, "node", "depth")
        up = state.select(rec, F.col("node").alias("p"), F.col("p").alias("pp"), F.col("depth").alias("more"))
        state = state.join(up, [rec, "p"], "left").select(rec, "node", F.col("pp").alias("p"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = cut(state)
    raise ValueError("the parents of some entries form a cycle")


def fingerprint(role: Column, text: Column) -> Column:
    """Of a message that is a role and a text."""
    return F.md5(F.concat(role, F.lit(":text:"), text))


def message_fingerprint(message: Column) -> Column:
    """Of a whole message as JSON text: thinking, calls and images too, without what tells how it came about. Null for what is no object."""
    return F.md5(comparable_text(message))
