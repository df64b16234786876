"""Traces of many splits, recordings as a data source with pushed filters, and files that grow as a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelode.sources import recordings, traces
from tracelode.streaming import tail


def _write_traces(at, seed, files):
    rng = random.Random(seed)
    for k in range(files):
        rows = [{"type": "session", "id": f"s{k}"}]
        for i in range(rng.randint(1, 60)):
            rows.append({"type": "message", "id": str(rng.randrange(50)), "n": i, "message": {"role": "user", "content": "é" * rng.randrange(80)}})
        lines = [json.dumps(r, ensure_ascii=False) for r in rows]
        for _ in range(rng.randrange(4)):  # empty lines count, too
            lines.insert(rng.randrange(1, len(lines) + 1), rng.choice(("", "  ")))
        (at / f"t{k}.jsonl").write_text("\n".join(lines) + rng.choice(("", "\n")))


def _plain(at):
    out = []
    for p in at.glob("*.jsonl"):
        own = {}
        for n, line in enumerate(p.read_text().split("\n"), 1):
            if line.strip():
                e = json.loads(line)
                if e["type"] != "session":
                    own[e["id"]] = (p.name, n, e["id"], e["n"])
        out += own.values()
    return sorted(out)


@pytest.mark.parametrize("most", [100_000, 0])
def test_lines_keep_their_numbers_over_many_splits(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(traces, "MOST_FILES", most)
    _write_traces(tmp_path, 1, 7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("67", "1000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            d = traces.read_entries(spark, str(tmp_path / "*.jsonl"))
            got = sorted((r.trace.rpartition("/")[2], r.line, r.id, r.n) for r in d.select("trace", "line", "id", F.try_variant_get("raw", "$.n", "int").alias("n")).collect())
            assert got == _plain(tmp_path)
            if size == "67":
                assert spark.read.option("lineSep", "\n").text(str(tmp_path / "*.jsonl")).select("_metadata.file_path", "_metadata.file_block_start").distinct().count() > 50
        # An error says its line, however many splits lie before it.
        spark.conf.set("spark.sql.files.maxPartitionBytes", "67")
        lines = ['{"type": "session", "id": "h"}', *['{"id": "%d", "x": "yyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyyy"}' % k for k in range(40)], "{"]
        (tmp_path / "bad.txt").write_text("\n".join(lines))
        with pytest.raises(Exception, match="line 42: invalid JSON"):
            traces.read_entries(spark, str(tmp_path / "bad.txt")).collect()
        assert traces.read_entries(spark, str(tmp_path / "bad.txt"), strict=False).count() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


ROWS = [("a", "one", "full", False, k, json.dumps({"id": str(k), "text": "x" * 300})) for k in range(5)] + [("b", "two", "minimal", True, 0, json.dumps({"id": "0"})), ("c", None, "full", False, None, None)]


def test_recordings_come_back_and_filters_are_pushed(spark, tmp_path):
    at = str(tmp_path / "recs")
    entries = spark.createDataFrame(ROWS, "path string, name string, profile string, lossy boolean, seq int, entry string")
    recordings.write_recordings(entries.repartition(5), at)
    assert sorted(p.name for p in (tmp_path / "recs").iterdir()) == ["a.rec", "b.rec", "c.rec"]
    d = recordings.read_recordings_table(spark, at, taskBytes="1")
    got = sorted(((r.path.rpartition("/")[2][:-4], r["name"], r.profile, r.lossy, r.seq, r.entry) for r in d.collect()), key=repr)
    assert got == sorted(ROWS, key=repr)
    # A file that a filter on the path leaves out is not opened, one left out by its header makes no rows.
    (tmp_path / "recs" / "bad.rec").write_bytes(b"\x1f\x8bbad")
    d = recordings.read_recordings_table(spark, at, taskBytes="1")
    with pytest.raises(Exception, match="bad.rec: unreadable"):
        d.collect()
    one = d.where(F.col("path") == f"{at}/a.rec")
    assert one.count() == 5 and one.rdd.getNumPartitions() == 1
    assert d.where(F.col("path").isin(f"{at}/a.rec", f"{at}/b.rec") & (F.col("profile") == "minimal")).count() == 1
    assert d.where(F.col("path").endswith("/c.rec")).first().entry is None
    faults = recordings.read_recordings_table(spark, at, faults="true").where("fault is not null").collect()
    assert [(r.path, r.entry) for r in faults] == [(f"{at}/bad.rec", None)] and "unreadable" in faults[0].fault


def test_pushed_filters_skip_files_at_planning():
    r = recordings.RecordingReader({"path": "/x"})
    path, name, other = recordings.EqualTo(("path",), "/x/a.rec"), recordings.StringStartsWith(("name",), "o"), recordings.EqualTo(("seq",), 1)
    assert list(r.pushFilters([path, name, other])) == [other] and r.pushed == [path, name]


def test_a_failed_write_leaves_nothing_and_overwrite_replaces(spark, tmp_path):
    at = str(tmp_path / "recs")
    entries = spark.createDataFrame(ROWS, "path string, name string, profile string, lossy boolean, seq int, entry string")
    recordings.write_recordings(entries, at)
    bad = entries.unionByName(spark.createDataFrame([("z", None, None, None, 0, "{")], entries.schema))
    with pytest.raises(Exception):  # noqa: B017
        recordings.write_recordings(bad, at)
    with pytest.raises(Exception, match="needs a path"):
        recordings.write_recordings(entries.withColumn("path", F.lit("")), at)
    assert sorted(p.name for p in (tmp_path / "recs").iterdir()) == ["a.rec", "b.rec", "c.rec"]
    recordings.write_recordings(entries.where("path = 'b'").withColumn("name", F.lit("new")), at, "overwrite")
    assert [(r["name"], r.seq) for r in recordings.read_recordings_table(spark, at).collect()] == [("new", 0)]
    recordings.write_recordings(entries.limit(0), at, "overwrite")
    assert recordings.read_recordings_table(spark, at).count() == 0


def test_every_appended_line_comes_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    seen = {}

    def run():
        lines = tail.stream_lines(spark, str(folder), taskBytes="7")
        out = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        out.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.path.rpartition("/")[2], r["at"], r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    def add(name, text):
        with (folder / name).open("a", encoding="utf-8") as f:
            f.write(text)

    def want():
        for p in folder.iterdir():
            whole, at = p.read_bytes(), 0
            for line in whole.split(b"\n")[:-1]:
                seen[p.name, at] = line.decode()
                at += len(line) + 1
        return sorted((n, at, v) for (n, at), v in seen.items())

    add("a", "one\ntwo\n\nthr")
    add("b", "")
    assert run() == want()
    add("a", "ee\nvier é " + "x" * 50 + "\n")
    add("b", "b1\n")
    add("c", "no end of line yet")
    assert run() == want()
    assert run() == want()
    add("c", "\nlast\n")
    (folder / "b").write_text("n\n")  # written anew, shorter
    seen_b = [k for k in seen if k[0] == "b"]
    assert len(seen_b) == 1
    got = run()
    assert ("b", 0, "n") in got and ("b", 0, "b1") in got and len(got) == len(want()) + 1


def test_ranges_of_any_size_give_each_line_once(tmp_path):
    rng = random.Random(3)
    for _ in range(40):
        body = bytes(rng.choice(b"ab\n") for _ in range(rng.randrange(80)))
        (tmp_path / "f").write_bytes(body)
        reader = tail.GrowingReader({"path": str(tmp_path), "taskbytes": str(rng.randint(1, 30))})
        end = reader.latestOffset()
        middle = {"f": body.rfind(b"\n", 0, rng.randrange(len(body) + 1)) + 1}
        got = [(r[1], r[2]) for a, b in (({}, middle), (middle, end)) for p in reader.partitions(a, b) for r in reader.read(p)]
        want, at = [], 0
        for line in body.split(b"\n")[:-1]:
            want.append((at, line.decode()))
            at += len(line) + 1
        assert got == want


def test_stream_of_entries(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "t.jsonl").write_text('{"type": "session", "id": "s"}\n{"id": "1", "message": {"role": "user"}}\n[1]\n{\n{"x": 1}\n')
    d = tail.stream_entries(spark, str(folder), suffix=".jsonl").drop("raw")
    d.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [(r.type, r.id, r.role, r.fault) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == [("session", "s", None, None), ("unknown", "1", "user", None), ("unknown", None, None, "not an object"), ("unknown", None, None, "invalid JSON"), ("unknown", None, None, "entry without id")]
