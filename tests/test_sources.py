import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions import shell
from tracelode.operators import replay
from tracelode.sources import traces


def _write(path, rows):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in rows))
    return str(path)


def test_read_entries(spark, tmp_path):
    at = _write(tmp_path / "a.jsonl", [{"type": "session", "id": "h", "cwd": "/w"}, {"type": "message", "id": "1", "message": {"role": "user", "content": [{"type": "text", "text": "hi  there"}]}, "odd": 1}, {"id": "2", "parentId": "1", "timestamp": "t"}, {"id": "2", "parentId": "1", "v": 2}])
    got = {r.id: r for r in traces.read_entries(spark, at).collect()}
    assert sorted(got) == ["1", "2"]
    assert (got["1"].role, got["1"].parent_id, got["1"].ts, got["2"].type, got["2"].line) == ("user", None, "", "unknown", 4)
    assert json.loads(got["1"].raw.toJson())["odd"] == 1
    listed = traces.list_traces(spark, str(tmp_path / "*.jsonl"))
    r = traces.resolve_trace(listed, "h").first()
    assert (r.id, r.cwd, r.first_text) == ("h", "/w", "hi there")


@pytest.mark.parametrize("bad", ["{", "[1]", '{"type": "x"}'])
def test_bad_lines_raise_with_their_number(spark, tmp_path, bad):
    at = _write(tmp_path / "b.jsonl", [{"type": "session", "id": "h"}, bad, {"id": "1"}])
    with pytest.raises(Exception, match="line 2"):
        traces.read_entries(spark, at).collect()
    assert [r.id for r in traces.read_entries(spark, at, strict=False).collect()] == ["1"]


def test_recording_round_trip(spark, tmp_path):
    entries = [{"id": "1", "text": "x" * 300}, {"id": "2", "text": ["x" * 300, "y"]}]
    (tmp_path / "r.rec").write_bytes(traces.pack({"profile": "full"}, entries))
    assert traces.unpack((tmp_path / "r.rec").read_bytes())["dict"] == ["x" * 300]
    got = traces.read_recordings(spark, str(tmp_path / "r.rec")).orderBy("seq").select(F.to_json("entry").alias("e")).collect()
    assert [json.loads(r.e) for r in got] == entries
    with pytest.raises(traces.TraceFormatError):
        traces.unpack(b"\x1f\x8bnot gzip")


def test_shell_shapes(spark):
    want = {
        "npm install vue@3.4.1 > out.log 2>&1": ("npm install vue@<*>", "npm install", False),
        "ls -la; git commit -m 'a && b'": ("ls -la && git commit -m a && b", "ls", True),
        "cd $HOME/x && node src/main.ts 8080": ("cd <*> && node src/<*>.ts <*>", "cd <*>", False),
        "A_TOKEN=abcd1234 run": ("A_TOKEN=<*> run", "A_TOKEN=<*> run", False),
        "": ("", "", False),
    }
    d = spark.createDataFrame([(c,) for c in want], "c string").select("c", shell.shell_shape("c").alias("s"))
    assert {r.c: (r.s.key, r.s.verb, r.s.noise) for r in d.collect()} == want


def test_serve_uses_each_answer_once():
    assert replay.serve(1, [(0, "a"), (1, "a"), (2, "z"), (3, "z")], [(10, "b"), (11, "a")]) == [(1, 0, "hash", 11), (1, 1, "cursor", 10), (1, 2, "miss", None), (1, 3, "miss", None)]


def test_stream_goes_on_where_it_was(spark, tmp_path):
    from tracelode.streaming.replay import serve_stream

    answers = spark.createDataFrame([(1, 10, "a"), (1, 11, "a"), (1, 12, "b")], "rec long, seq long, hash string")
    schema = "rec long, req long, hash string"
    got = []
    for batch in ([(1, 0, "a"), (2, 0, "a")], [(1, 1, "a"), (1, 2, "z"), (1, 3, "a")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        served = serve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), answers)
        q = served.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "hash", 10), (1, 1, "hash", 11), (1, 2, "cursor", 12), (1, 3, "miss", None), (2, 0, "miss", None)]
