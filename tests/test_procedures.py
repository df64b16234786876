import pytest
from pyspark.sql import functions as F

from tracelode.functions import templates as T
from tracelode.operators import procedures as P


def run(name, *commands, outcome=None):
    made = [T.command_step(c) for c in commands]
    return name, outcome, [{**s, "values": {x["name"]: x["value"] for x in s["slots"]}, "kinds": {x["name"]: x["kind"] for x in s["slots"]}} for s in made]


FRAMEWORKS = [run(f"r{k}", f"npm create {f}@latest {n}", "ls", f"npm install {r}", "npm run build") for k, (f, r, n) in enumerate((("vue", "vue-router", "a"), ("react", "react-router", "b"), ("vue", "vue-router", "c"), ("react", "react-router", "d")))]


def test_frameworks_and_their_routers_vary_together():
    p = P.generalise("web", FRAMEWORKS)
    assert [s["template"] for s in p["steps"]] == ["npm create {{template}} {{name}}", "npm install {{package}}", "npm run build"]
    both, name = p["parameters"]
    assert both["enumerated"] and both["members"] == [{"step": 0, "slot": "template"}, {"step": 1, "slot": "package"}]
    assert [v["label"] for v in both["variants"]] == ["vue@latest", "react@latest"] and len(name["variants"]) == 4
    assert p["noise"] == 4 and p["status"] == "unknown" and p["orthogonality"] == 1
    assert P.composed(p, {"template": "React@latest", "name": "it's"}, quote=True) == ["npm create 'React@latest' 'it'\\''s'", "npm install 'react-router'", "npm run build"]
    assert P.composed(p, {"package": "pinia"})[1] == "npm install pinia"
    with pytest.raises(ValueError, match="template: one of"):
        P.composed(p, {"template": "svelte"})


def test_optional_step_has_its_condition():
    runs = [run(f"r{k}", f"shipit build {s}", *([f"shipit bump {s}"] if e == "prod" else []), f"shipit deploy {s} --env {e}") for k, (s, e) in enumerate((("api", "dev"), ("web", "stage"), ("billing", "prod")))]
    p = P.generalise("ship", runs)
    assert [s["template"] for s in p["steps"]] == ["shipit build {{arg}}", "shipit deploy {{arg}} --env {{env}}"]
    (o,) = p["optional"]
    assert o["observed_in"] == 1 and o["of"] == 3 and o["before"] == 1 and {"name": "env", "value": "prod"} in o["conditions"]


def test_failed_runs_are_counted_and_left_out():
    p = P.generalise("x", [run("a", "make", outcome="success"), run("b", "make", outcome="success"), run("c", "rm x", outcome="failed")])
    assert (p["observations"], p["successes"], p["failures"], p["status"]) == (2, 2, 1, "mixed")
    assert [s["template"] for s in p["steps"]] == ["make"]
    assert P.generalise("x", [run("c", "rm x", outcome="failed")])["status"] == "failed"
    assert P.generalise("x", [run("c")])["steps"] == []


def test_secrets_and_absolute_paths_stay_open():
    p = P.generalise("x", [run("a", "cat2 /home/a/x.py --token abcdef", "do src/x.py"), run("b", "cat2 /home/a/x.py --token ghijkl", "do src/x.py")])
    assert [s["template"] for s in p["steps"]] == ["cat2 {{path}} --token {{token}}", "do src/x.py"]
    assert "abcdef" not in str(p)


@pytest.fixture(scope="module")
def stored(spark):
    rows = [("web", r, None, k, s["key"], s["verb"], s["kind"], s["template"], s["noise"], [(x["name"], x["value"], x["kind"]) for x in s["slots"]]) for r, _, steps in FRAMEWORKS for k, s in enumerate(steps)]
    kind = "family string, run string, outcome string, seq int, key string, verb string, kind string, template string, noise boolean, slots array<struct<name: string, value: string, kind: string>>"
    return P.procedures(spark.createDataFrame(rows, kind)).cache()


def test_columns_agree_with_the_plain_function(stored):
    got = stored.first().asDict(recursive=True)
    assert got == P.generalise("web", FRAMEWORKS)


def test_compose_and_gaps(spark, stored):
    asked = stored.withColumn("assigned", F.create_map(F.lit("name"), F.lit("x")))
    texts = P.compose(asked)
    assert [r.text for r in texts.orderBy("step").collect()] == ["npm create {{template}} x", "npm install {{package}}", "npm run build"]
    assert {r.slot: (r.kind, "choose one of vue@latest" in r.hint) for r in P.gaps(asked, texts).collect()} == {"template": ("choice", True), "package": ("choice", True)}


def test_bind(spark):
    p = spark.createDataFrame([P.generalise("x", [run("a", "go2 --token abcdef --port 8000"), run("b", "go2 --token ghijkl --port 8000")])], P.PROCEDURE).withColumn("assigned", F.lit(None).cast("map<string,string>"))
    got = P.bind(p, {"TOKEN": "t", "PORT": ""}).first()
    assert got.assigned == {"token": "t"}


def test_segments(spark, stored):
    cuts = spark.createDataFrame([("web", "head", "scaffold", 0, 0), ("web", "tail", None, 1, 2)], "name string, segment string, intent string, begin int, end int")
    got = {r.name: r for r in P.cut_segments(stored, cuts).collect()}
    assert [s.template for s in got["tail"].steps] == ["npm install {{package}}", "npm run build"]
    assert got["tail"].slots[0].step == 0 and got["tail"].dropped == ["template"] and [p.name for p in got["head"].parameters] == ["name"]
    bad = spark.createDataFrame([("web", "a", "", 0, 1), ("web", "b", "", 1, 2)], cuts.schema)
    with pytest.raises(Exception, match="overlapping"):
        P.cut_segments(stored, bad).collect()


def test_files(spark, stored, tmp_path):
    P.save(stored, str(tmp_path), "global")
    P.save(stored.withColumn("status", F.lit("success")), str(tmp_path), "project")
    (tmp_path / "global" / "part-x.json").write_text('not json\n{"name": "old", "steps": []}\n')
    good, broken = P.load(spark, str(tmp_path))
    assert {(r.name, r.scope) for r in good.collect()} == {("web", "project"), ("old", "global")}
    assert [r.value for r in broken.collect()] == ["not json"]
    assert good.where("name = 'web'").drop("scope", "status").first().asDict(recursive=True) == stored.drop("status").first().asDict(recursive=True)


def test_context_for_a_prompt(spark, stored):
    from tracelode.plans import reports

    full = reports.context_text(stored, ["vue", "router"])
    assert full.startswith("web: unknown, from 4 runs") and "2 slots move together" in full
    assert reports.context_text(stored, ["vue", "router"], budget=200).startswith("- web (4 runs): template=vue@latest|react@latest, name=a|b|c|d")
    assert reports.context_text(stored, ["cobol"], budget=10).endswith("\n[cut]") and reports.context_text(stored.limit(0), ["vue"]) == ""


def test_validators_and_freshness(spark):
    from tracelode.operators import carry_out, freshness

    rows = [("web", k, s["verb"], [(x["name"], x["value"], x["kind"]) for x in s["slots"]]) for k, s in enumerate(FRAMEWORKS[0][2])]
    v = freshness.validators(spark.createDataFrame(rows, "k string, seq int, verb string, slots array<struct<name: string, value: string, kind: string>>"), "k", ["seq"])
    assert [r.command for r in v.orderBy("nth").collect()] == ["npm view vue version", "npm view vue-router version"]
    p = spark.createDataFrame([("web", 1)], "k string, age_days int")
    status = lambda *port: freshness.freshness(p, carry_out.run_validators(v, "k", *port), "k").first().status
    assert status(lambda c: carry_out.Result(0)) == "fresh" and status() == "unknown"
    assert status(lambda c: carry_out.Result(int("router" in c), "", "404")) == "stale"


def test_recording_text():
    from tracelode.plans import reports

    text = reports.recording_text({"profile": "normal", "lossy": True, "dropped": ["1 x"], "stats": {"tools": ["a"], "costUsd": 0.5}}, 3, 1, 2048)
    assert text.startswith("recording (profile normal, lossy), 2.0 KiB, 3 entries") and "tools: a" in text and text.endswith("dropped: 1 x")
