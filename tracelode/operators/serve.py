"""What replay hands out and takes in: messages and tool results as they are served, failures, runs over recorded prompts, shadows.

A live model is a port, a callable that the caller hands in; without one every request is refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.canonical import _json, blocks_of, canonical
from ..plans.lineage import python_path
from ..plans.reports import regression_text
from ..plans.spread import before_in_order
from .regress import SURFACE, summarise

#: What a run costs that is served from a recording.
NO_COST = {"input": 0, "output": 0, "cacheRead": 0, "cacheWrite": 0, "total": 0}


def refuse(prompt: str) -> dict:
    raise PermissionError("no model was given")


def without_cost(message: dict) -> dict:
    """A message as it is served: what it used stays, what it cost is nothing."""
    used = message.get("usage")
    return {**message, "usage": {**used, "cost": dict(NO_COST)}} if isinstance(used, dict) else message


def result_payload(message: dict, recording: str | None = None, entry: str | None = None) -> dict:
    """A recorded tool result as it is served; with where it comes from, if it is served to another call."""
    out = {"content": message.get("content") or [], "details": message.get("details") or {}, "isError": message.get("isError") is True}
    return out | ({"details": {**out["details"], "recording": recording, "from": entry}} if recording is not None else {})


def failure(model: dict, details: str, stop: str = "error") -> dict:
    """A message of an assistant that says why there is no answer."""
    return {
        "role": "assistant", "content": [{"type": "text", "text": details}], "api": model.get("api"), "provider": model.get("provider"), "model": model.get("id"),
        "usage": {"input": 0, "output": 0, "cacheRead": 0, "cacheWrite": 0, "totalTokens": 0, "cost": dict(NO_COST)}, "stopReason": stop, "errorMessage": details,
    }


def events_of(message: dict) -> list[tuple[str, int | None, str | None]]:
    """(event, block, text) of an answer as a stream would bring it: its start, each block's start, content and end, and how it ends."""
    out: list[tuple[str, int | None, str | None]] = [("start", None, None)]
    for k, b in enumerate(blocks_of(message)):
        kind = str(b.get("type") or "unknown")
        said = canonical(b.get("arguments") or {}) if kind == "toolCall" else b.get("text") if kind == "text" else b.get("thinking")
        out += [(f"{kind}_start", k, str(b.get("name") or "") or None), (f"{kind}_delta", k, said if isinstance(said, str) else None), (f"{kind}_end", k, None)]
    return [*out, ("error" if message.get("stopReason") in ("error", "aborted") else "done", None, message.get("errorMessage") or message.get("stopReason"))]


EVENTS = ArrayType(StructType([StructField("event", StringType()), StructField("block", IntegerType()), StructField("text", StringType())]))


@F.pandas_udf(EVENTS)
def answer_events(messages: pd.Series) -> pd.Series:
    """events_of() of a column of messages as JSON; none for what is no object."""
    return pd.Series([[dict(zip(("event", "block", "text"), e, strict=True)) for e in events_of(v)] if isinstance(v := _json(t), dict) else [] for t in messages])


def served_events(answers: DataFrame) -> DataFrame:
    """rec, req, nth, event, block, text: answers (rec, req, message as JSON) as the events of a stream, in order."""
    python_path(answers.sparkSession)
    return answers.select("rec", "req", F.posexplode(answer_events("message")).alias("nth", "e")).select("rec", "req", "nth", "e.*")


def within_fork_budget(misses: DataFrame, budget: int) -> DataFrame:
    """misses (rec, req, tokens: what each is reckoned to use) with used (by the misses before it) and allowed: whether a live answer may still be asked for."""
    d = before_in_order(misses, ["rec"], ["req"], F.coalesce("tokens", F.lit(0)), "used")
    return d.withColumn("allowed", F.col("used") < budget)


def fork_batch(ask: Callable[[str], dict] = refuse, most: int = 1000) -> Callable[[DataFrame, int], list[tuple]]:
    """For foreachBatch: live answers (rec, req, message as JSON) for the allowed misses (rec, req, prompt, allowed) of a batch; the others have none.

    The port is on the driver, so a batch of more than most allowed misses is refused as a whole.
    """

    def answer(batch: DataFrame, _: int) -> list[tuple]:
        rows = batch.where("allowed").select("rec", "req", "prompt").orderBy("rec", "req").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} live answers in a batch")
        return [(r.rec, r.req, json.dumps(ask(r.prompt))) for r in rows]

    return answer


def last_messages(parts: DataFrame) -> DataFrame:
    """rec, req, message: the last that a stream of parts (rec, req, seq, message) says of each request."""
    return parts.where("message is not null").groupBy("rec", "req").agg(F.max_by("message", "seq").alias("message"))


@dataclass
class Driven:
    answers: list[dict] = field(default_factory=list)
    compacted: list[int] = field(default_factory=list)
    stopped: str | None = None


def drive(prompts: Iterable[str], ask: Callable[[str], dict] = refuse, compact: Callable[[], None] | None = None, points: Iterable[int] = (), budget: int | None = None) -> Driven:
    """Put recorded prompts to a port, in order; before the prompts at points (from 0) the history is compacted.

    Stops at the first answer that ends in an error or is aborted, and before a prompt once the tokens
    used reach the budget.
    """
    out, due, used = Driven(), set(points), 0
    for k, prompt in enumerate(prompts):
        if budget is not None and used >= budget:
            out.stopped = f"{used} of {budget} tokens are used"
            break
        if k in due and compact is not None:
            compact()
            out.compacted.append(k)
        answer = ask(prompt)
        out.answers.append(answer)
        used += (answer.get("usage") or {}).get("totalTokens") or 0
        if answer.get("stopReason") in ("error", "aborted"):
            out.stopped = answer.get("errorMessage") or answer["stopReason"]
            break
    return out


def shadow(compared: DataFrame, label: str, shown: int = 50) -> tuple[dict, str]:
    """Of answers compared with a shadow's (regress.compare): how many there are of each sort and the first that differs in what is done, and a report."""
    s = summarise(compared, []).first()
    grave = compared.where(F.exists("kinds", lambda k: ~k.isin(*SURFACE)))
    counts = {"requests": 0, "identical": 0, "surface": 0, "structural": 0} if s is None else s.asDict()
    return counts | {"first": grave.agg(F.min(label)).first()[0]}, regression_text(compared, label, shown)


def empty_procedure(name: str) -> dict:
    """A procedure that nothing is known of."""
    return {"name": name, "status": "unknown", "observations": 0, "successes": 0, "failures": 0, "noise": 0, "orthogonality": 0.0} | {k: [] for k in ("steps", "slots", "parameters", "optional", "contracts")}
