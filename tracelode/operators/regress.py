"""Comparing recorded answers with new ones: what differs in action, and what only in words or in looking around."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.canonical import _json, blocks_of, canonical
from ..functions.shell import READ_ONLY_TOOLS, shape
from ..functions.text import one_line
from ..plans.lineage import python_path
from .extract import sequence

ANSWER = StructType([StructField(n, StringType()) for n in ("text", "calls", "actions", "stop_reason", "error")] + [StructField("tools", ArrayType(StringType()))])
#: Kinds of differences that change nothing of what is done.
SURFACE = ("text", "inspection")


def actions(calls: list[tuple[str, dict]]) -> list[str]:
    """The calls that act, in order: without read-only tools, moves between folders and commands that only look around."""
    out = []
    for tool, args in calls:
        if tool in READ_ONLY_TOOLS:
            continue
        if tool == "bash" and isinstance(args.get("command"), str):
            lines = [re.sub(r"\s+", " ", s).strip() for s in sequence(args["command"])]
            out += [f"bash {s}" for s in lines if not re.match(r"cd(\s|$)", s) and not shape(s)["noise"]]
        else:
            out.append(f"{tool} {canonical(args, True)}")
    return out


def answer(message: dict) -> dict:
    """What of an answer is compared: its texts, its calls with their arguments, what acts among them, and how it ended."""
    blocks = blocks_of(message)
    texts = [b["text"].strip() for b in blocks if b.get("type") == "text" and isinstance(b.get("text"), str)]
    calls = [(str(b.get("name") or ""), b["arguments"] if isinstance(b.get("arguments"), dict) else {}) for b in blocks if b.get("type") == "toolCall"]
    said = lambda k: message[k] if isinstance(message.get(k), str) else None
    shown = ", ".join(f"{t}({canonical(a, True)})" for t, a in calls) or "(no tool call)"
    return {"text": "\n".join(t for t in texts if t), "calls": shown, "actions": json.dumps(actions(calls)), "stop_reason": said("stopReason"), "error": said("errorMessage"), "tools": [t for t, _ in calls]}


@F.pandas_udf(ANSWER)
def answer_of(messages: pd.Series) -> pd.DataFrame:
    """answer() of a column of messages as JSON; what is no object is an empty answer."""
    return pd.DataFrame([answer(v if isinstance(v := _json(t), dict) else {}) for t in messages], columns=ANSWER.names)


def differences(recorded: Column, live: Column) -> Column:
    """Kinds in which two answers (ANSWER) differ, gravest first: error, inspection or toolCalls, text, stopReason."""
    same_calls = recorded["calls"] == live["calls"]
    same_actions = recorded["actions"] == live["actions"]
    plain = lambda a: one_line(a["text"])
    none = lambda c: F.coalesce(c, F.lit(""))
    return F.array_compact(
        F.array(
            F.when((none(live["error"]) != "") & (none(recorded["error"]) == ""), "error"),
            F.when(~same_calls, F.when(same_actions, "inspection").otherwise("toolCalls")),
            F.when(plain(recorded) != plain(live), "text"),
            F.when(none(recorded["stop_reason"]) != none(live["stop_reason"]), "stopReason"),
        )
    )


def compare(recorded: DataFrame, live: DataFrame, keys: list[str], message: str = "message") -> DataFrame:
    """keys, recorded, live (ANSWER), kinds for requests that both tables answer."""
    python_path(recorded.sparkSession)
    a = recorded.select(*keys, answer_of(message).alias("recorded"))
    b = live.select(*keys, answer_of(message).alias("live"))
    return a.join(b, keys).withColumn("kinds", differences(F.col("recorded"), F.col("live")))


def summarise(compared: DataFrame, by: list[str]) -> DataFrame:
    """Requests that are identical, differ on the surface only, or in what is done."""
    grave = F.exists("kinds", lambda k: ~k.isin(*SURFACE))
    return compared.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.size("kinds") == 0).alias("identical"), F.count_if((F.size("kinds") > 0) & ~grave).alias("surface"), F.count_if(grave).alias("structural"))
