"""Fingerprints of whole messages, and shared skeletons against a plain table of alignments."""

import json

from pyspark.sql import functions as F

from tracelode import registry
from tracelode.operators import trace

SF = "/root/testdata/sf0.001"


def test_a_message_differs_in_any_part_that_counts(spark):
    python = {"role": "assistant", "content": [{"type": "text", "text": "x"}, {"type": "toolCall", "id": "a", "name": "read", "arguments": {"path": "p"}}], "usage": {"input": 1}}
    other = lambda **change: json.dumps({**python, **change})
    call = {**python["content"][1], "arguments": {"path": "q"}}
    texts = [other(), other(usage={"input": 9}), other(content=[python["content"][0], call]), other(content=[*python["content"], {"type": "thinking", "thinking": "t"}]), "no JSON", None]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "k int, m string").orderBy("k").select(trace.message_fingerprint(F.col("m"))).collect()]
    assert got[0] == got[1] and len(set(got[:4])) == 3 and got[4:] == [None, None]


def _longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    return size


def test_shared_skeleton_against_plain_tables(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    runs = {}
    for r in rows:
        runs.setdefault(r.user_id // 5, {}).setdefault(r.user_id, []).append(r.event_type)
    want = set()
    for family, own in runs.items():
        users = sorted(own)
        total = {u: sum(_longest(own[u], own[v])[0][0] for v in users if v != u) for u in users}
        medoid = min(users, key=lambda u: (-total[u], u))
        count = [0] * len(own[medoid])
        for u in users:
            a, b, size, i, j = own[medoid], own[u], _longest(own[medoid], own[u]), 0, 0
            while i < len(a) and j < len(b):
                if a[i] == b[j]:
                    count[i] += 1
                    i, j = i + 1, j + 1
                elif size[i + 1][j] >= size[i][j + 1]:
                    i += 1
                else:
                    j += 1
        want |= {(family, k, own[medoid][k], round(n / len(users), 6)) for k, n in enumerate(count) if n >= 0.6 * len(users)}
    got = {tuple(r) for r in registry.queries()["shared_skeleton"](spark, SF).select("family", "step", "key", "support").collect()}
    assert got == want and got
