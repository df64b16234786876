from tracelode.operators import extract, skeleton


def test_alignment():
    assert skeleton.alignment(list("abcd"), list("acd")) == [(0, 0), (2, 1), (3, 2)]
    assert skeleton.alignment(list("abcd"), list("xabyd")) == [(0, 1), (1, 2), (3, 4)]
    assert skeleton.alignment([], ["a"]) == []


def test_shared_steps():
    runs = [["create", "install", "build"], ["ls", "create", "install", "build"], ["create", "install", "bump", "build"]]
    assert [k for _, k, _ in skeleton.shared_steps(runs)] == ["create", "install", "build"]
    assert skeleton.shared_steps([]) == []


def test_skeletons(spark):
    d = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["a", "c", "b"]), (2, 3, ["z"])], "f long, r long, keys array<string>")
    assert sorted(tuple(r) for r in skeleton.skeletons(d, "f", "r", "keys").collect()) == [(1, 0, "a", 1.0), (1, 1, "b", 1.0), (2, 0, "z", 1.0)]


def test_parameter_groups(spark):
    rows = [(r, s, v) for r, t, p, n in ((1, "vue", "vr", "x"), (2, "react", "rr", "y"), (3, "vue", "vr", "z"), (4, "react", "rr", "w")) for s, v in (("template", t), ("package", p), ("name", n))]
    got = skeleton.parameter_groups(spark.createDataFrame(rows, "run int, slot string, value string"), "run", "slot", "value").collect()
    assert {r.slot: (r.parameter, r.variants) for r in got} == {"template": ("package", 2), "package": ("package", 2), "name": ("name", 4)}


def test_extract_steps(spark):
    calls = spark.createDataFrame([(1, 0, "c0", "cd app && npm install vue@3; ls | wc"), (1, 1, "c1", "bad"), (1, 2, "c2", "echo 'a && b'")], "rec int, seq int, call_id string, command string")
    results = spark.createDataFrame([(1, "c1", True), (1, "c0", False)], "rec int, call_id string, is_error boolean")
    got = [(r.seq, r.part, r.key, r.noise) for r in extract.extract_steps(calls, results).orderBy("seq", "part").collect()]
    assert got == [(0, 0, "cd app", False), (0, 1, "npm install vue@<*>", False), (0, 2, "ls && wc", True), (2, 0, "echo a && b", True)]
