"""Recordings from traces: the path to a leaf, what a profile drops, credentials masked, statistics, outcome, and files."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import outcome_of
from ..functions.names import recording_id
from ..functions.templates import masked
from ..plans.lineage import cut, python_path
from ..sources.traces import MAGIC_GZIP, TraceFormatError, pack, unpack
from .trace import depths, leaves

PROFILES = ("full", "normal", "minimal")
# Kinds of entries and fields that the minimal profile drops, and the length it cuts results to.
SIDE_TYPES = ("usage", "label", "session_info")
SIDE_FIELDS = {"toolResult": ("details", "nestedCalls", "usage"), "assistant": ("diagnostics",)}
RESULT_CHARS = 4000


def active_paths(entries: DataFrame, leaf: DataFrame | None = None) -> DataFrame:
    """Entries (trace, line, id, parent_id, ...) on the way to a leaf of each trace (trace, id; default: the leaf of the last line), with depth.

    Found downwards by pointer doubling: an entry is on the way if the leaf's 2^k-th ancestors reach it,
    so a path of n entries takes log2(n) rounds. A dangling parent ends it.
    """
    keys = entries.select("trace", "id", "parent_id")
    if leaf is None:
        own = leaves(entries, "trace", "id", "parent_id")
        leaf = own.groupBy("trace").agg(F.max_by("id", "line").alias("id"))
    depth = depths(entries, "trace", "id", "parent_id").withColumnRenamed("node", "id")
    longest = depth.agg(F.max("depth")).first()[0] or 0
    jump = keys.join(keys.select("trace", F.col("id").alias("parent_id")), ["trace", "parent_id"], "left_semi").select("trace", "id", F.col("parent_id").alias("up"))
    on = leaf.select("trace", "id")
    for _ in range(max(int(longest).bit_length(), 1)):
        on = cut(on.unionByName(on.join(jump, ["trace", "id"]).select("trace", F.col("up").alias("id"))).distinct())
        further = jump.select("trace", F.col("id").alias("up"), F.col("up").alias("next"))
        jump = cut(jump.join(further, ["trace", "up"]).select("trace", "id", F.col("next").alias("up")))
    return entries.join(on, ["trace", "id"]).join(depth, ["trace", "id"])


def _strings(value, change):
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [_strings(v, change) for v in value]
    return {k: _strings(v, change) for k, v in value.items()} if isinstance(value, dict) else value


def trimmed(entries: list[dict], result_chars: int = RESULT_CHARS) -> tuple[list[dict], list[str]]:
    """Entries as the minimal profile keeps them, and what was dropped."""
    out, thoughts, cut = [], 0, 0
    for e in entries:
        if e.get("type") in SIDE_TYPES:
            continue
        m = e.get("message")
        if isinstance(m, dict) and isinstance(m.get("content"), list):
            role, content = m.get("role"), []
            for b in m["content"]:
                block = b if isinstance(b, dict) else {}
                text = block.get("text")
                if block.get("type") == "thinking":
                    thoughts += 1
                elif role == "toolResult" and block.get("type") == "text" and isinstance(text, str) and len(text) > result_chars:
                    cut += 1
                    content.append({**b, "text": f"{text[:result_chars]}\n\n[{len(text) - result_chars} characters dropped]"})
                else:
                    content.append(b)
            e = {**e, "message": {**{k: v for k, v in m.items() if k not in SIDE_FIELDS.get(role, ())}, "content": content}}
        out.append(e)
    told = [(len(entries) - len(out), "entries beside the messages"), (thoughts, "thinking blocks"), (cut, f"tool results cut to {result_chars} characters")]
    return out, [f"{n} {what}" for n, what in told if n]


def summary(entries: list[dict]) -> dict:
    """Counts of a recording: entries, turns by role, tool calls, errors, tokens, cost, tools and models."""
    messages = [e["message"] for e in entries if e.get("type") == "message" and isinstance(e.get("message"), dict)]
    blocks = [b for m in messages if m.get("role") == "assistant" and isinstance(m.get("content"), list) for b in m["content"] if isinstance(b, dict)]
    calls = [b for b in blocks if b.get("type") == "toolCall"]
    used = [m.get("usage") or {} for m in messages if m.get("role") == "assistant"]
    role = lambda r: sum(m.get("role") == r for m in messages)
    return {
        "entries": len(entries), "userTurns": role("user"), "assistantTurns": role("assistant"), "toolCalls": len(calls), "toolErrors": sum(m.get("role") == "toolResult" and m.get("isError") is True for m in messages),
        "inputTokens": sum(u.get("input") or 0 for u in used), "outputTokens": sum(u.get("output") or 0 for u in used), "totalTokens": sum(u.get("totalTokens") or 0 for u in used),
        "costUsd": sum((u.get("cost") or {}).get("total") or 0 for u in used), "tools": sorted({str(b.get("name")) for b in calls}), "models": sorted({m["model"] for m in messages if m.get("role") == "assistant" and m.get("model")}),
    }


def observed(entries: list[dict]) -> list[tuple[str | None, bool]]:
    """Tool results in order, each as the command that it answers (null: no shell call) and whether it is an error."""
    commands: dict[str, str] = {}
    out = []
    for e in entries:
        m = e.get("message") if isinstance(e.get("message"), dict) else {}
        if m.get("role") == "assistant" and isinstance(m.get("content"), list):
            for b in m["content"]:
                args = b.get("arguments") if isinstance(b, dict) and b.get("type") == "toolCall" and b.get("name") == "bash" else None
                if isinstance(args, dict) and isinstance(args.get("command"), str) and isinstance(b.get("id"), str):
                    commands[b["id"]] = args["command"]
        elif m.get("role") == "toolResult":
            out.append((commands.get(m["toolCallId"]) if isinstance(m.get("toolCallId"), str) else None, m.get("isError") is True))
    return out


def recording(entries: list[dict], source: dict, profile: str = "normal", redact: bool = False, name: str | None = None, result_chars: int = RESULT_CHARS) -> bytes:
    """A recording's file from entries in order. Its id is that of the entries that it keeps; its outcome is told by what checked the run."""
    if profile not in PROFILES:
        raise ValueError(f"profile is one of {', '.join(PROFILES)}")
    dropped: list[str] = []
    outcome = outcome_of(observed(entries))
    outcome["evidence"] = [masked(line) for line in outcome["evidence"]]
    if profile == "minimal":
        entries, dropped = trimmed(entries, result_chars)
    if redact:
        hidden = 0

        def hide(text: str) -> str:
            nonlocal hidden
            out = masked(text)
            hidden += out != text
            return out

        entries = [_strings(e, hide) for e in entries]
        dropped += [f"{hidden} credentials masked"] if hidden else []
    return pack({"id": recording_id(entries), "name": name, "outcome": outcome, "profile": profile, "lossy": bool(dropped), "dropped": dropped, "source": source, "stats": summary(entries)}, entries)


def record(paths: DataFrame, profile: str = "normal", redact: bool = False, result_chars: int = RESULT_CHARS) -> DataFrame:
    """trace, content: a recording's file for each trace of active_paths(); a recording is one file, so one group. The minimal profile cuts longer tool results than result_chars."""
    python_path(paths.sparkSession)

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = [json.loads(e) for e in rows.sort_values("depth").entry]
        return pd.DataFrame({"trace": [key[0]], "content": [recording(own, {"sessionFile": key[0], "leafId": own[-1].get("id")}, profile, redact, result_chars=result_chars)]})

    return paths.select("trace", "depth", F.to_json("raw").alias("entry")).groupBy("trace").applyInPandas(of, "trace string, content binary")


def write_recordings(files: DataFrame, folder: str) -> str:
    """Recordings as rows of a table below folder; one written file of content per trace would flood a store with small files. Gives its path."""
    at = f"{folder}/recordings-{uuid.uuid4().hex}"
    files.write.parquet(at)
    return at


def read_packed(spark: SparkSession, at: str) -> DataFrame:
    """trace, header and entries (JSON text, in order) of a table of recordings; one that can't be read has its fault instead."""
    python_path(spark)

    def of(batches):
        for b in batches:
            out = []
            for trace, content in zip(b["trace"], b["content"], strict=True):
                try:
                    body = unpack(bytes(content) if content is not None else b"")
                    out.append((trace, json.dumps({k: v for k, v in body.items() if k not in ("entries", "dict")}), len(body["entries"]), len(body["dict"]), bytes(content)[:2] == MAGIC_GZIP, None))
                except TraceFormatError as e:
                    out.append((trace, None, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["trace", "header", "entries", "pooled", "gzip", "fault"]).astype({"entries": "Int64", "pooled": "Int64"})

    return spark.read.parquet(at).select("trace", "content").mapInPandas(of, "trace string, header string, entries long, pooled long, gzip boolean, fault string")
