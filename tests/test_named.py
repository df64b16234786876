"""Procedures by a part of their names, their age and their search; traces by their names."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tests.test_chain import write
from tracelode import cli
from tracelode.operators import procedures
from tracelode.sources import traces


def test_names_of_traces(spark, tmp_path):
    head = {"type": "session", "id": "abc"}
    named = lambda n: {"type": "session_info", "id": n, "name": n}
    user = lambda content: {"type": "message", "id": "u", "message": {"role": "user", "content": content}}
    rows = {
        "a": [head, named("first name"), named("release of May"), user([]), user([{"type": "image"}, {"text": "one"}, {"text": " two"}]), named("later")],
        "b": [head, {"type": "session_info", "name": 7}, user("")],
        "c": [[1], "x", {"type": "message", "message": None}],
    }
    for k, own in rows.items():
        (tmp_path / f"{k}.jsonl").write_text("\n".join(map(json.dumps, own)) + "\n{broken")
    listed = traces.list_traces(spark, str(tmp_path / "*.jsonl"))
    got = {r.path[-7]: (r.id, r.name, r.first_text) for r in listed.collect()}
    assert got == {"a": ("abc", "release of May", "one two"), "b": ("abc", None, ""), "c": (None, None, None)}
    assert traces.resolve_trace(listed, "of May").first().path.endswith("a.jsonl")
    assert traces.resolve_trace(listed, "of June").first() is None


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("named")
    sh = lambda c: ("bash", {"command": c}, False)
    write(at, {n: [sh(f"npm create {f}@latest {n}"), sh(f"npm install {f}-router")] for n, f in (("one", "vue"), ("two", "react"), ("three", "vue"))})
    cli.main(["learn", str(at / "*.jsonl"), "Web app", "--save", str(at / "web")])
    made = procedures.load(spark, str(at / "web"), ("global",), dated=True)[0]
    both = made.unionByName(made.withColumn("name", F.lit("web"))).unionByName(made.withColumn("name", F.lit("A webhook")).withColumn("saved_at", F.lit(datetime.datetime(2020, 1, 1))))
    procedures.save(both, str(at / "all"), "global")
    return str(at / "all")


def test_by_part_of_a_name(spark, stored):
    own = procedures.load(spark, stored, ("global",), dated=True)[0]
    got = {r.wanted: r.name for r in procedures.find(own, ["web", "WEB", "APP", "hook", "none", "web"]).collect()}
    assert got == {"web": "web", "WEB": "A webhook", "APP": "Web app", "hook": "A webhook"}
    assert procedures.find(own, []).count() == 0 and procedures.find(own.limit(0), ["web"]).count() == 0


def test_age_stays_and_counts(spark, stored, tmp_path, capsys):
    ages = {r.name: r.saved_at for r in procedures.load(spark, stored, ("global",), dated=True)[0].collect()}
    assert ages["A webhook"] == datetime.datetime(2020, 1, 1) and ages["web"].year > 2020
    # A row of an earlier form doesn't tell: its file does.
    (tmp_path / "global").mkdir()
    (tmp_path / "global" / "p.json").write_text(json.dumps({"name": "old form", "steps": []}))
    (row,) = procedures.load(spark, str(tmp_path), ("global",), dated=True)[0].collect()
    assert abs((row.saved_at - datetime.datetime.now(datetime.UTC).replace(tzinfo=None)).total_seconds()) < 86400
    # Without checks of its own a procedure is unchecked, and unknown when it is old.
    cut = procedures.load(spark, stored, ("global",), dated=True)[0].withColumn("steps", F.filter("steps", lambda s: F.lit(False)))
    procedures.save(cut, str(tmp_path / "bare"), "global")
    capsys.readouterr()
    cli.main(["check", str(tmp_path / "bare")])
    assert sorted(tuple(json.loads(x)["text"].split(None, 1)) for x in capsys.readouterr().out.splitlines()) == [("unchecked", "Web app"), ("unchecked", "web"), ("unknown", "A webhook")]


def test_find_and_compose_from_the_command_line(spark, stored, capsys):
    capsys.readouterr()
    cli.main(["find", stored, "router", "webhook"])
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert got[0]["name"] == "A webhook" and [g["name"] for g in got[1:]] == ["web", "Web app"] and got[0]["matched"] == 2
    cli.main(["find", stored, "router", "--budget", "1"])
    assert len(capsys.readouterr().out.splitlines()) == 1  # the first is always told
    cli.main(["compose", stored, "web APP", "template=vue@latest", "name=x"])
    assert [json.loads(x)["text"] for x in capsys.readouterr().out.splitlines()] == ["npm create vue@latest x", "npm install vue-router"]
    with pytest.raises(SystemExit, match="no procedure nothing"):
        cli.main(["procedure", stored, "nothing"])
