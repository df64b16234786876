import json

from tracelode import cli


def test_commands(spark, tmp_path, capsys):
    rows = [{"type": "session", "id": "s1"}, {"type": "message", "id": "1", "message": {"role": "user", "content": "deploy service"}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    at = str(tmp_path / "*.jsonl")

    def said(*argv):
        cli.main(list(argv))
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert said("sessions", at)[0]["id"] == "s1"
    assert said("show", at, "s1")[0]["role"] == "user"
    assert said("search", at, "deploy")[0]["matched"] == 1
    assert said("kinds", at)[0]["calls"] == 1
    assert {x["pack"] for x in said("rules")} >= {"node", "docker"}
    assert len(said("--limit", "3", "query", "slug", "/root/testdata/sf0.001")) == 3


def test_all_rows_but_of_listings(spark, tmp_path, capsys):
    for k in range(27):
        rows = [{"type": "session", "id": f"trace-{k}-"}, *({"type": "message", "id": str(i), "message": {"role": "user", "content": f"deploy {i}"}} for i in range(40 if k == 0 else 1))]
        (tmp_path / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    at = str(tmp_path / "*.jsonl")

    def said(*argv):
        cli.main(list(argv))
        out, err = capsys.readouterr()
        return len(out.splitlines()), [x for x in err.splitlines() if x.endswith(" more")]

    assert said("show", at, "trace-0-") == (40, []) and said("entries", str(tmp_path / "0.jsonl")) == (40, [])
    assert said("query", "slug", "/root/testdata/sf0.001")[0] > 25
    assert said("sessions", at) == said("search", at, "deploy") == (25, ["... 2 more"])
    assert said("--limit", "5", "show", at, "trace-0-") == (5, []) and said("--limit", "26", "sessions", at) == (26, ["... 1 more"])


def test_record_learn_compose(spark, tmp_path, capsys):
    from tests.test_chain import write

    sh = lambda c: ("bash", {"command": c}, False)
    write(tmp_path, {n: [sh(f"npm create {f}@latest {n}"), sh(f"npm install {f}-router")] for n, f in (("one", "vue"), ("two", "react"), ("three", "vue"))})
    at = str(tmp_path / "*.jsonl")

    def said(*argv):
        cli.main(list(argv))
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert {r["entries"] for r in said("record", at, str(tmp_path / "r"), "--profile", "minimal", "--redact")} == {4}
    (p,) = said("learn", at, "web", "--save", str(tmp_path / "p"))
    assert [s["template"] for s in p["steps"]] == ["npm create {{template}} {{name}}", "npm install {{package}}"]
    assert [x["text"] for x in said("compose", str(tmp_path / "p"), "web", "template=vue@latest", "name=my app", "--quote")] == ["npm create 'vue@latest' 'my app'", "npm install 'vue-router'"]
