"""Canonical JSON: one text for values that mean the same, for hashing and comparing messages and arguments."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fields of messages and of content blocks that say how a turn came about, not what it says.
VOLATILE = frozenset(
    "timestamp usage cost responseId responseModel providerThinkingLevel diagnostics errorMessage rawStopReason endTurn details nestedCalls "
    "toolCallId isError api model provider durationMs thinkingLevel".split()
)
VOLATILE_BLOCK = frozenset("textSignature thinkingSignature".split())
# Fixed value: how a message that carries a compaction's summary begins.
COMPACTED = "The conversation history before this point was compacted into the following summary:"


def _number(v: float | int) -> str:
    """A number as ECMAScript prints it: doubles, plain up to 21 digits and down to 1e-6."""
    v = float(v)
    if v != v or v in (float("inf"), float("-inf")):
        return "null"
    if v == 0:
        return "0"
    if 1e-6 <= abs(v) < 1e21:
        return format(Decimal(repr(v)), "f").removesuffix(".0")
    return repr(v).replace("e-0", "e-")


def canonical(value, drop_nulls: bool = False) -> str:
    """JSON with sorted keys and no spaces; with drop_nulls, without the fields of objects that are null (items of lists stay)."""
    if isinstance(value, dict):
        keys = sorted((k for k in value if not (drop_nulls and value[k] is None)), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k], drop_nulls)}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(v, drop_nulls) for v in value) + "]"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def blocks_of(message: dict) -> list[dict]:
    """Content blocks; a text is one block, an empty one none."""
    content = message.get("content")
    if isinstance(content, str):
        return [{"type": "text", "text": content}] if content else []
    return [b for b in content if isinstance(b, dict)] if isinstance(content, list) else []


def compaction_summary(message: dict) -> str | None:
    """The summary that a message stands for, if it does."""
    if message.get("role") == "compactionSummary" and isinstance(message.get("summary"), str):
        return message["summary"].strip()
    if message.get("role") != "user":
        return None
    text = "".join(b["text"] for b in blocks_of(message) if isinstance(b.get("text"), str))
    _, opened, rest = text.partition("<summary>")
    body, closed, _ = rest.rpartition("</summary>")
    return body.strip() if text.startswith(COMPACTED) and opened and closed else None


def comparable(message: dict, thinking: bool = True, calls: bool = True, images: bool = False) -> str:
    """A message as canonical JSON of what it says: without volatile fields, images as their type only."""
    if (said := compaction_summary(message)) is not None:
        return canonical({"role": "compactionSummary", "summary": said})
    content = []
    for b in blocks_of(message):
        kind = b.get("type")
        if (kind == "thinking" and not thinking) or (kind == "toolCall" and not calls):
            continue
        content.append({"type": "image", "mimeType": b.get("mimeType")} if kind == "image" and not images else {k: v for k, v in b.items() if k not in VOLATILE_BLOCK})
    return canonical({**{k: v for k, v in message.items() if k not in VOLATILE}, "content": content})


def _json(text):
    try:
        return json.loads(text) if text is not None else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def canonical_text(values: pd.Series) -> pd.Series:
    """canonical() of a JSON column, without null fields; null for null and for what isn't JSON."""
    return pd.Series([None if (v := _json(t)) is None else canonical(v, True) for t in values], dtype=object)


@F.pandas_udf(StringType())
def comparable_text(messages: pd.Series) -> pd.Series:
    """comparable() of a column of messages as JSON; null for what is no object."""
    return pd.Series([comparable(v) if isinstance(v := _json(t), dict) else None for t in messages], dtype=object)
