"""Many small recordings: sessions that share files, and groups that share a task."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracelode.operators import replay
from tracelode.sources import traces


def _lines(spark, sessions, n):
    d = spark.range(sessions).select(F.col("id").alias("rec"))
    head = d.select("rec", F.lit(-1).cast("long").alias("line"), F.format_string('{"type": "session", "id": "%d"}', "rec").alias("value"))
    entry = F.format_string('{"type": "message", "id": "%d", "message": {"role": "user", "content": "some words of a user"}}', "line")
    lines = d.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("line"))
    return head.unionByName(lines.select("rec", "line", entry.alias("value")))


def test_sessions_share_files_that_are_split_anywhere(spark, tmp_path):
    at = str(tmp_path / "many")
    traces.write_sessions(_lines(spark, 60, 9), at)
    assert len(list((tmp_path / "many").glob("*.txt"))) <= 4
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "333")  # splits within sessions and within lines
    try:
        got = traces.read_sessions(spark, at).select(F.regexp_extract("trace", r"#(\d+)@\d+$", 1).cast("long").alias("rec"), "trace", "line", "id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r.rec, r.line, r.id) for r in got) == [(rec, k + 2, str(k)) for rec in range(60) for k in range(9)]
    assert len({r.trace for r in got}) == 60


def test_lines_before_a_header_and_bad_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"type": "message", "id": "0"}\n\n{"type": "session", "id": "s"}\nno json\n{"type": "message", "id": "1"}\n{"type": "session", "id": "s"}\n{"type": "message", "id": "1"}\n')
    got = traces.read_sessions(spark, str(tmp_path), strict=False).collect()
    assert sorted((r.trace.rpartition("/")[2], r.line, r.id) for r in got) == [("a.txt#s@3", 3, "1"), ("a.txt#s@6", 2, "1")]
    with pytest.raises(PySparkException, match="line 2: invalid JSON|line 1: no session header"):
        traces.read_sessions(spark, str(tmp_path)).collect()


def test_groups_share_a_task_and_span_batches(spark):
    asked = [(rec, tool, k, "abcd"[k % 4]) for rec in (1, 2, 3, None) for tool in ("x", None) for k in range(9)]
    answers = [(r, t, k, h) for r, t, k, h in ((r, t, k, "abc"[((r or 0) + k) % 3]) for r in (1, 2, None) for t in ("x", None) for k in range(7))]
    q = spark.createDataFrame(asked, "rec long, tool string, req long, hash string")
    a = spark.createDataFrame(answers, "rec long, tool string, seq long, hash string")
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        d = replay.replay(q, a, True, ("rec", "tool"))
        got = {(r.rec, r.tool, r.req): (r.via, r.seq) for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want = {}
    for rec in (1, 2, 3, None):
        for tool in ("x", None):
            own = [(k, h) for r, t, k, h in answers if (r, t) == (rec, tool)]
            want |= {(rec, tool, n): (via, seq) for _, n, via, seq in replay.serve(0, [(k, h) for r, t, k, h in asked if (r, t) == (rec, tool)], own)}
    assert got == want
    assert "CoGroup" not in d._jdf.queryExecution().toString()
