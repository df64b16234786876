import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions import checks
from tracelode.operators import carry_out as C
from tracelode.operators import record as R
from tracelode.operators import stats
from tracelode.sources import traces


def message(role, content, **more):
    return {"type": "message", "message": {"role": role, "content": content, **more}}


@pytest.fixture()
def session(tmp_path):
    rows = [
        {"type": "session", "version": 3, "id": "S", "cwd": "/w"},
        {"id": "s", "parentId": None, **message("system", "be good")},
        {"id": "u", "parentId": "s", **message("user", [{"type": "text", "text": "go token=abcdefghijklmn1234"}])},
        {"id": "a", "parentId": "u", **message("assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "toolCall", "id": "c", "name": "read", "arguments": {}}], model="m", usage={"input": 3, "output": 2, "totalTokens": 5, "cost": {"total": 0.5}})},
        {"id": "t", "parentId": "a", **message("toolResult", [{"type": "text", "text": "x" * 5000}], isError=True, details={"k": 1})},
        {"id": "old", "parentId": "t", **message("assistant", "no")},
        {"id": "new", "parentId": "t", **message("assistant", "yes")},
        {"id": "l", "parentId": "new", "type": "label", "label": "done"},
    ]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return str(tmp_path)


def test_path_and_recording(spark, session):
    paths = R.active_paths(traces.read_entries(spark, f"{session}/*.jsonl"))
    assert [r.id for r in paths.orderBy("depth").collect()] == ["s", "u", "a", "t", "new", "l"]
    body = traces.unpack(bytes(R.record(paths).first().content))
    assert [e["id"] for e in body["entries"]] == ["s", "u", "a", "t", "new", "l"] and not body["lossy"] and len(body["dict"]) == 1
    assert body["stats"] | {"tools": ["read"], "models": ["m"], "toolErrors": 1, "totalTokens": 5, "costUsd": 0.5, "assistantTurns": 2} == body["stats"]
    small = traces.unpack(bytes(R.record(paths, "minimal", redact=True).first().content))
    assert [e["id"] for e in small["entries"]] == ["s", "u", "a", "t", "new"] and small["lossy"]
    assert "abcdefghijklmn1234" not in json.dumps(small) and "thinking" not in json.dumps(small["entries"]) and len(small["dropped"]) == 4
    at = R.write_recordings(R.record(paths).union(spark.createDataFrame([("bad", bytearray(b"zz"))], "trace string, content binary")), session)
    got = {r.trace == "bad": (r.entries, r.pooled, r.fault is None) for r in R.read_packed(spark, at).collect()}
    assert got == {False: (6, 1, True), True: (None, None, False)}
    with pytest.raises(ValueError, match="profile"):
        R.recording([], {}, "huge")


def test_command_line_keeps_results_of_up_to_4000_characters(spark, tmp_path):
    from tracelode import cli

    for n in (3000, 4000, 4001):
        rows = [{"type": "session", "version": 3, "id": "S"}, {"id": "t", "parentId": None, **message("toolResult", [{"type": "text", "text": "x" * n}])}]
        (tmp_path / f"{n}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    cli.result(spark, cli._arguments().parse_args(["record", str(tmp_path / "*.jsonl"), str(tmp_path / "r"), "--profile", "minimal"]))
    (at,) = (tmp_path / "r").glob("recordings-*")
    got = {r.trace.rsplit("/", 1)[-1]: traces.unpack(bytes(r.content)) for r in spark.read.parquet(str(at)).collect()}
    text = {k: b["dict"][0] for k, b in got.items()}
    assert text["3000.jsonl"] == "x" * 3000 and text["4000.jsonl"] == "x" * 4000 and text["4001.jsonl"].startswith("x" * 4000 + "\n")
    assert {k: b["lossy"] for k, b in got.items()} == {"3000.jsonl": False, "4000.jsonl": False, "4001.jsonl": True}


def test_chosen_leaf(spark, session):
    e = traces.read_entries(spark, f"{session}/*.jsonl")
    leaf = e.where("id = 'old'").select("trace", "id")
    assert [r.id for r in R.active_paths(e, leaf).orderBy("depth").collect()] == ["s", "u", "a", "t", "old"]


def shell(command):
    return {"make": C.Result(0, "done\n"), "bad": C.Result(3, "", "no")}.get(command, C.Result(0 if command == "command -v 'git'" else 1, "/bin/git"))


def test_carry_out():
    statuses = lambda *a, **k: [s for _, s, _, _ in C.carry_out(*a, **k)]
    steps = [("command", "make"), ("command", "bad"), ("command", "make")]
    assert statuses(steps, shell) == ["ok", "failed", "skipped"] and statuses(steps, shell, go_on=True) == ["ok", "failed", "ok"]
    assert C.carry_out(steps, shell)[1] == ("bad", "failed", 3, "no")
    assert statuses([("write", "w"), ("command", "make")], shell) == ["agent", "skipped"]
    assert statuses([("write", "w"), ("command", "make")], shell, commands_only=True) == ["skipped", "ok"]
    assert statuses([("command", "sudo make"), ("command", "make")], shell) == ["refused", "skipped"]
    assert statuses([("command", "make")]) == ["failed"]
    assert C.probe(["git", "git", "nope", "a;b"], shell) == {"git": "available", "nope": "missing", "a;b": "unknown"} and C.probe(["git"]) == {"git": "unknown"}


def test_outcome_of_steps(spark):
    rows = [(1, 0, "command", "a", 0), (1, 1, "write", "b", None), (1, 2, "command", "c", 0), (2, 0, "command", "sudo x", 0), (3, 0, "command", "x", 1)]
    d = spark.createDataFrame(rows, "r int, k int, kind string, t string, code int")
    got = C.outcome_of_steps(d, "r", ["k"], F.col("kind"), F.col("t"), F.col("code"))
    assert {(x.r, x.k): x.status for x in got.collect()} == {(1, 0): "ok", (1, 1): "agent", (1, 2): "skipped", (2, 0): "refused", (3, 0): "failed"}


def test_check_conditions(spark):
    c = spark.createDataFrame([("file", "./a"), ("dir", "a"), ("dir", "/d"), ("file", "{{x}}"), ("image", "i"), ("file", "~/h"), ("file", "./a")], "kind string, target string")
    p = spark.createDataFrame([("/w/a", False), ("/d", True), ("/me/h", False)], "path string, is_dir boolean")
    got = {(r.kind, r.target): r.status for r in C.check_conditions(c, p, "/w", "/me").collect()}
    assert got == {("file", "./a"): "met", ("dir", "a"): "unmet", ("dir", "/d"): "met", ("file", "{{x}}"): "unverifiable", ("image", "i"): "unverifiable", ("file", "~/h"): "met"}


def test_outcome_and_id_of_a_recording(spark, tmp_path):
    call = lambda k, command: {"id": f"a{k}", **message("assistant", [{"type": "toolCall", "id": f"c{k}", "name": "bash", "arguments": {"command": command}}])}
    result = lambda k, bad: {"id": f"t{k}", **message("toolResult", [], toolCallId=f"c{k}", isError=bad)}
    runs = {
        "fixed": ([("npm test", True), ("edit x", False), ("npm test", False)], "success"),
        "broken": ([("npm run build", False), ("cargo test --all", True), ("ls", False)], "failed"),
        "got over": ([("mvn clean", True), ("npm run dev", False)], "unknown"),
        "last bad": ([("ls", False), ("npm run dev", True)], "failed"),
        "quiet": ([("ls", False)], "unknown"),
        "secret": ([("make TOKEN=abcdefgh12345678", True)], "failed"),
    }
    rows, ids = [], set()
    for name, (steps, want) in runs.items():
        entries = [x for k, (command, bad) in enumerate(steps) for x in (call(k, command), result(k, bad))]
        body = traces.unpack(R.recording(entries, {}))
        assert body["outcome"]["status"] == want and "abcdefgh12345678" not in json.dumps(body["outcome"]), name
        assert body["id"] == traces.unpack(R.recording(json.loads(json.dumps(entries)), {"x": 1}))["id"]
        ids.add(body["id"])
        rows += [(name, k, command, bad) for k, (command, bad) in enumerate(steps)]
    assert len(ids) == len(runs)
    d = spark.createDataFrame(rows, "run string, seq long, command string, bad boolean")
    got = stats.outcomes(d, ["run"], ["seq"], F.col("bad"), checks.checks(F.col("command")), F.col("bad"))
    assert {r.run: r.status for r in got.collect()} == {name: want for name, (_, want) in runs.items()}


def test_what_checks_is_told_by_words(spark):
    good = ["npm test", " yarn  run lint", "bun run verify --x", "jest", "vitest run", "ctest -V", "rspec", "go vet ./...", "cargo check", "make", "make all", "tsc --noEmit", "./gradlew build", "mvn verify", "dotnet test"]
    bad = ["npm run dev", "npm run build:prod", "npm", "npm run", "mvn clean", "gradle run", "cargo clippy", "cargo", "dotnet build", "makefile", "python -m pytest", "", "echo npm test", "go"]
    d = spark.createDataFrame([(c, True) for c in good] + [(c, False) for c in bad] + [(None, False)], "c string, want boolean")
    assert d.where(checks.checks(F.col("c")) != F.col("want")).count() == 0
    assert all(map(checks.is_check, good)) and not any(map(checks.is_check, bad))
