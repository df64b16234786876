"""Replaying recordings: requests served by prefix hash, by position, or missed; overrides and reconnecting."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import python_path

SERVED = "rec long, req long, via string, seq long"


def serve(rec: int, requests: list[tuple[int, str]], answers: list[tuple], fall_back: bool = True, used: set[int] | None = None) -> list[tuple]:
    """Requests (number, hash) of one recording against its answers (seq, hash and, if there is one, another hash), each answer once.

    The first unused answer of the request's hash; else, where falling back, the first unused answer
    ('cursor', counted as a miss of the hash); else 'miss'. In order, as each use changes what is left.
    used holds the places of answers that are gone, and gets those that go now.
    """
    by_hash: dict[str, list[int]] = {}
    for k, (_, *hashes) in enumerate(answers):
        for h in {h for h in hashes if h is not None}:
            by_hash.setdefault(h, []).append(k)
    for own in by_hash.values():
        own.reverse()
    used, cursor, out = set() if used is None else used, 0, []
    for number, h in requests:
        own = by_hash.get(h, [])
        while own and own[-1] in used:
            own.pop()
        if own:
            k, via = own.pop(), "hash"
        else:
            while cursor < len(answers) and cursor in used:
                cursor += 1
            k, via = (cursor, "cursor") if fall_back and cursor < len(answers) else (None, "miss")
        if k is not None:
            used.add(k)
        out.append((rec, number, via, None if k is None else answers[k][0]))
    return out


def replay(requests: DataFrame, answers: DataFrame, fall_back: bool = True, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """rec, req, via, seq for requests (rec, req, hash) and answers (rec, seq, hash); a recording is one group, or what keys name.

    A further column ``alt`` of answers is a second hash they go by, that of their history as a
    compaction left it. Consumption is order-dependent, so a recording is served in one place; recordings are independent.
    """

    python_path(requests.sparkSession)
    side = lambda d, asked, number: d.select(*keys, F.lit(asked).alias("asked"), F.col(number).cast("long").alias("number"), "hash", *(["alt"] if "alt" in d.columns else []))
    # Answers come before requests, each in order, so a task serves recording after recording as their rows pass.
    rows = side(answers, False, "seq").unionByName(side(requests.drop("alt"), True, "req"), allowMissingColumns=True)
    rows = rows.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "asked", "number")
    own = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(_served(len(keys), fall_back), f"{own}, req long, via string, seq long")


def _served(n_keys: int, fall_back: bool, most: int = 10_000):
    """Serves groups of sorted rows (keys, asked, number, hashes); what it gives is in batches of about most rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [c.type for c in b.columns[:n_keys]]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            types = [*kinds, pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f"c{k}" for k in range(len(types))])

        out: list[tuple] = []
        for key, group in groupby(rows(), key=lambda r: r[:n_keys]):
            answers, asked = [], []
            for r in group:
                (asked if r[n_keys] else answers).append(r[n_keys + 1 :])
            out += [(*key, *row[1:]) for row in serve(0, [r[:2] for r in asked], answers, fall_back)]
            if len(out) >= most:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return run


def take_compactions(points: list[int], served: list[int]) -> list[int | None]:
    """For requests that follow so many served answers: the number of the compaction each takes, or None.

    Compactions (answers before each) are taken in order, each at its own point only.
    """
    out, nth = [], 0
    for n in served:
        hit = nth < len(points) and points[nth] == n
        out.append(nth if hit else None)
        nth += hit
    return out


def compactions_due(requests: DataFrame, points: DataFrame) -> DataFrame:
    """rec, req, compaction for requests (rec, req, served) and points (rec, nth, answers_before)."""

    def run(key, req: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        req, own = req.sort_values("req"), own.sort_values("nth")
        got = take_compactions(own.answers_before.tolist(), req.served.tolist())
        return pd.DataFrame({"rec": key[0], "req": req.req.tolist(), "compaction": pd.array([None if k is None else own.nth.iloc[k] for k in got], "Int64")})

    python_path(requests.sparkSession)
    return requests.groupBy("rec").cogroup(points.groupBy("rec")).applyInPandas(run, "rec long, req long, compaction long")


def progress(served: DataFrame, answers: DataFrame) -> DataFrame:
    """Per recording: answers, consumed, misses (positional hits count as such) and whether all is used."""
    s = served.groupBy("rec").agg(F.count("seq").alias("consumed"), F.count_if(F.col("via") != "hash").alias("misses"))
    d = answers.groupBy("rec").agg(F.count("*").alias("answers")).join(s, "rec", "left").na.fill(0, ["consumed", "misses"])
    return d.withColumn("finished", F.col("consumed") == F.col("answers"))


def override(messages: DataFrame, overrides: DataFrame, keys: list[str], text: str) -> DataFrame:
    """messages with the text replaced where overrides (keys, new_text) has one."""
    return messages.join(overrides, keys, "left").withColumn(text, F.coalesce("new_text", text)).drop("new_text")


def reconnect(calls: DataFrame, rec: str, order: list[str], tool: str, arguments: str, read_only: Column) -> DataFrame:
    """Whether each call can take the result of an earlier equal one: read-only, and before the recording's first change.

    One running window per recording and one per (recording, tool, arguments); no range join.
    """
    w = Window.partitionBy(rec).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(rec, tool, arguments).orderBy(*order)
    d = calls.withColumn("changed", F.coalesce(F.max((~read_only).cast("int")).over(w), F.lit(0)) == 1)
    return d.withColumn("reconnects", read_only & ~F.col("changed") & (F.row_number().over(same) > 1)).drop("changed")
