"""Looking things up in recordings: answers without using them up, tool results, turns, prompts, declared tools, and whether a recording replays itself.

A recording is a key ``rec``, its answers and results are numbered by ``seq``, requests by ``req``.
Hashes are those of the history before (see trace.prefix_digests). All but ``tool_results``, whose
consumption depends on the order, are joins and windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_line
from .replay import replay


def look_up(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """rec, req, seq: the first answer of the recording with the request's hash, or null; nothing is used up, so requests may share it."""
    first = answers.groupBy("rec", "hash").agg(F.min("seq").alias("seq"))
    return requests.select("rec", "req", "hash").join(first, ["rec", "hash"], "left").select("rec", "req", "seq")


def peek(requests: DataFrame, answers: DataFrame, used: DataFrame) -> DataFrame:
    """rec, req, via, seq: what would be served now, if used (rec, seq) is gone: the first answer left of the hash, else the first left ('cursor'), else 'miss'."""
    left = answers.join(used.select("rec", "seq").distinct(), ["rec", "seq"], "left_anti")
    exact = left.groupBy("rec", "hash").agg(F.min("seq").alias("own"))
    other = left.groupBy("rec").agg(F.min("seq").alias("next"))
    d = requests.select("rec", "req", "hash").join(exact, ["rec", "hash"], "left").join(other, "rec", "left")
    via = F.when(F.col("own").isNotNull(), "hash").when(F.col("next").isNotNull(), "cursor").otherwise("miss")
    return d.select("rec", "req", via.alias("via"), F.coalesce("own", "next").alias("seq"))


def tool_results(requests: DataFrame, results: DataFrame, fall_back: bool = True) -> DataFrame:
    """rec, tool, req, via, seq for requests (rec, req, tool, hash) and results (rec, seq, tool, hash): as replay(), among results of the same tool."""
    return replay(requests, results, fall_back, ("rec", "tool"))


def results_by_id(requests: DataFrame, results: DataFrame) -> DataFrame:
    """rec, req, seq for requests (rec, req, call_id) and results (rec, seq, call_id): the n-th request of an id takes its n-th result, or none."""
    nth = lambda d, order: d.withColumn("nth", F.row_number().over(Window.partitionBy("rec", "call_id").orderBy(order)))
    asked = nth(requests.select("rec", "req", "call_id"), "req")
    return asked.join(nth(results.select("rec", "seq", "call_id"), "seq"), ["rec", "call_id", "nth"], "left").select("rec", "req", "seq")


def repeated_calls(calls: DataFrame, recorded: DataFrame, served: DataFrame, read_only: Column, overrides: DataFrame | None = None) -> DataFrame:
    """rec, req, seq, text, overridden for live calls (rec, req, tool, arguments) that a recorded one answers again.

    recorded: rec, seq, call_id, tool, arguments, text (null: it has no result). Only read-only tools
    are answered (read_only is asked of ``tool``), and only from before the recording's horizon, its
    first call that changes something and that served (rec, seq) doesn't have. The first equal call
    that has a result answers; an override (rec, call_id, new_text) of it wins over its text. Arguments are compared
    as they are: give them in canonical form (canonical.canonical_text).
    """
    changing = recorded.where(~read_only).join(served.select("rec", "seq").distinct(), ["rec", "seq"], "left_anti")
    horizon = changing.groupBy("rec").agg(F.min("seq").alias("horizon"))
    known = recorded.where(read_only & F.col("text").isNotNull()).join(horizon, "rec", "left").where(F.col("horizon").isNull() | (F.col("seq") < F.col("horizon")))
    first = known.groupBy("rec", "tool", "arguments").agg(F.min_by(F.struct("seq", "call_id", "text"), "seq").alias("x")).select("rec", "tool", "arguments", "x.*")
    d = calls.where(read_only).select("rec", "req", "tool", "arguments").join(first, ["rec", "tool", "arguments"])
    if overrides is None:
        return d.select("rec", "req", "seq", "text", F.lit(False).alias("overridden"))
    own = overrides.groupBy("rec", "call_id").agg(F.max("new_text").alias("new_text"))
    return d.join(own, ["rec", "call_id"], "left").select("rec", "req", "seq", F.coalesce("new_text", "text").alias("text"), F.col("new_text").isNotNull().alias("overridden"))


def call_points(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls (rec, seq, block, call_id, tool) with turn (from 1, the number of the answer with calls) and has_result."""
    turn = F.dense_rank().over(Window.partitionBy("rec").orderBy("seq")).cast("long")
    known = results.select("rec", "call_id").distinct().withColumn("has_result", F.lit(True))
    return calls.withColumn("turn", turn).join(known, ["rec", "call_id"], "left").withColumn("has_result", F.coalesce("has_result", F.lit(False)))


def at_place(points: DataFrame, places: DataFrame) -> DataFrame:
    """rec, place, call_id: the first call of the turn that a place names ('2', 'turn-2'), or the call of that id; null for none."""
    number = F.regexp_extract("place", r"^(?:turn-)?(\d+)$", 1).try_cast("long")
    p = places.select("rec", "place", number.alias("number"))
    first = points.groupBy("rec", F.col("turn").alias("number")).agg(F.min_by("call_id", F.struct("seq", "block")).alias("by_turn"))
    ids = points.select("rec", F.col("call_id").alias("place"), F.col("call_id").alias("by_id")).distinct()
    return p.join(first, ["rec", "number"], "left").join(ids, ["rec", "place"], "left").select("rec", "place", F.coalesce("by_id", "by_turn").alias("call_id"))


def transcript(messages: DataFrame) -> DataFrame:
    """messages of users, assistants and tools."""
    return messages.where(F.col("role").isin("user", "assistant", "toolResult"))


def prompts(messages: DataFrame) -> DataFrame:
    """rec, seq, prompt: trimmed texts of users that aren't empty, without the summaries that stand for compacted history."""
    said = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    return messages.where((F.col("role") == "user") & (said != "") & ~said.rlike(r"<summary>[\s\S]*</summary>")).select("rec", "seq", said.alias("prompt"))


def turn_label(number: Column, tools: Column, text: Column, width: int = 70) -> Column:
    """One line for a turn: #number, its tools, the first line of its text."""
    first = F.substring(one_line(F.substring_index(F.trim(text), "\n", 1)), 1, width)
    named = F.when(F.size(tools) > 0, F.concat(F.lit("["), F.array_join(tools, ", "), F.lit("]")))
    return F.concat_ws(" ", F.concat(F.lit("#"), number.cast("string")), named, F.when(first != "", first))


def tool_names(calls: DataFrame) -> DataFrame:
    """rec, tool, place: the tools of a recording in the order in which they were first called."""
    first = calls.groupBy("rec", "tool").agg(F.min(F.struct("seq", "block")).alias("first"))
    return first.select("rec", "tool", F.row_number().over(Window.partitionBy("rec").orderBy("first")).alias("place"))


def declarations(added: DataFrame) -> DataFrame:
    """rec, name, declaration, seq: the first declaration of each tool, from added (rec, seq, nth, name, declaration)."""
    first = F.min_by(F.struct("declaration", "seq"), F.struct("seq", "nth")).alias("x")
    return added.groupBy("rec", "name").agg(first).select("rec", "name", "x.declaration", "x.seq")


def tools_at(points: DataFrame, added: DataFrame) -> DataFrame:
    """rec, seq, tools: names and declarations known before each point (rec, seq), by name; the first declaration of a name counts.

    A recording declares few tools, at few places: they join its points.
    """
    known = points.select("rec", "seq").distinct().join(declarations(added).withColumnRenamed("seq", "from"), "rec", "left")
    mine = F.when(F.col("from") < F.col("seq"), F.struct("name", "declaration"))
    return known.groupBy("rec", "seq").agg(F.array_sort(F.array_compact(F.collect_list(mine))).alias("tools"))


def verified(answers: DataFrame) -> DataFrame:
    """Per recording whether it replays itself: answers, hits (served in place by hash), gaps (hashes that bring another answer, or none), ok."""
    asked = answers.select(F.col("rec").alias("rec"), F.col("seq").alias("req"), F.col("hash").alias("hash"))
    got = replay(asked, answers.select("rec", "seq", "hash"), fall_back=False)
    hit = F.coalesce(F.col("seq") == F.col("req"), F.lit(False))
    d = got.groupBy("rec").agg(F.count("*").alias("answers"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("gaps"))
    return d.withColumn("ok", F.col("gaps") == 0)


def as_entries(messages: DataFrame) -> DataFrame:
    """messages (rec, seq, ...) as a linear trace: id (m0, m1, ... in order) and parent_id."""
    w = Window.partitionBy("rec").orderBy("seq")
    d = messages.withColumn("place", F.row_number().over(w) - 1)
    return d.withColumn("id", F.concat(F.lit("m"), F.col("place").cast("string"))).withColumn("parent_id", F.when(F.col("place") > 0, F.concat(F.lit("m"), (F.col("place") - 1).cast("string")))).drop("place")


def as_trace_lines(entries: DataFrame) -> DataFrame:
    """rec, line, value: recorded entries (rec, seq, entry as JSON text) as the lines of a trace file, with a header first."""
    header = F.to_json(F.struct(F.lit("session").alias("type"), F.lit(3).alias("version"), F.col("rec").cast("string").alias("id")))
    heads = entries.select("rec").distinct().select("rec", F.lit(1).cast("long").alias("line"), header.alias("value"))
    place = F.row_number().over(Window.partitionBy("rec").orderBy("seq")) + 1
    return heads.unionByName(entries.where("entry is not null").select("rec", place.cast("long").alias("line"), F.col("entry").alias("value")))
