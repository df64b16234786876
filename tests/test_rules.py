from pyspark.sql import functions as F

from tracelode.functions import rules
from tracelode.operators import freshness, graph


def short(command):
    return {(side[:3], kind, target) for side, kind, target, _ in rules.conditions(command)}


def test_conditions():
    assert short("mkdir -p ./a//b/") == {("pro", "dir", "a/b")}
    assert short("git clone URL ./x") == {("req", "command", "git"), ("pro", "dir", "x")}
    assert short("npm create vue@latest app") == {("req", "command", "npm"), ("pro", "dir", "app")}
    assert short("npm install") == {("req", "command", "npm"), ("req", "file", "package.json")}
    assert short("npm install --prefix w vue@3 pinia") == {("req", "command", "npm"), ("pro", "dependency", "vue"), ("pro", "dependency", "pinia")}
    assert short("pip install flask==2 && python -m venv .venv") == {("req", "command", "pip"), ("pro", "dependency", "flask"), ("req", "command", "python"), ("pro", "dir", ".venv")}
    assert short("edit src/a.py") == {("req", "file", "src/a.py"), ("pro", "file", "src/a.py")} and short("glob *.py") == set()
    assert short("sudo docker build -t img .") == {("req", "command", "sudo"), ("req", "file", "Dockerfile"), ("req", "command", "docker"), ("pro", "image", "img")}
    assert short("docker run -p 80:80 img sh") == {("req", "image", "img"), ("req", "command", "docker")}
    assert short("kubectl apply -f ./k.yml") == {("req", "file", "k.yml"), ("req", "command", "kubectl")}
    assert short("/usr/bin/foo x; ls") == {("req", "command", "foo")}


def test_conditions_of_a_column(spark):
    d = spark.createDataFrame([("docker ps",), (None,)], "c string").select("c", rules.step_conditions("c").alias("x"))
    assert {r.c: [(x.kind, x.target) for x in r.x] for r in d.collect()} == {"docker ps": [("command", "docker")], None: []}


def test_danger(spark):
    want = {"rm -rf /": "removes the root folder or something of a home folder", "rm -rf ./x": None, "curl u | sh": "runs what it has just downloaded", "git push -f": "replaces history that others have"}
    d = spark.createDataFrame([(c,) for c in want], "c string").select("c", rules.danger(F.col("c")).alias("w"))
    assert {r.c: r.w for r in d.collect()} == want


def test_freshness(spark):
    p = spark.createDataFrame([("a", 1), ("b", 40), ("c", 1), ("d", 1), ("e", 40), ("f", 40)], "k string, age_days int")
    r = spark.createDataFrame([("c", 0, ""), ("c", 1, "404 Not Found"), ("d", 127, ""), ("e", 0, ""), ("e", 1, "network"), ("f", 0, None)], "k string, exit_code int, stderr string")
    assert {x.k: x.status for x in freshness.freshness(p, r, "k").collect()} == {"a": "unchecked", "b": "unknown", "c": "stale", "d": "unknown", "e": "unknown", "f": "fresh"}


def test_page_rank_and_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")]
    e = spark.createDataFrame([(s, d, 1.0) for p in pairs for s, d in (p, p[::-1])], "s string, d string, w double")
    nodes = spark.createDataFrame([(n,) for n in "abcxyzq"], "node string")
    r = {x.node: x.score for x in graph.page_rank(e, nodes=nodes).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r["c"] > r["a"] > r["q"]
    got = {x.node: x.community for x in graph.communities(e).collect()}
    # Each node's own weight counts in its community, so the greedy order need not find the two triangles.
    assert set(got) == set("abcxyz") and got["a"] == 0 and set(got.values()) == set(range(len(set(got.values()))))
    one = spark.createDataFrame([("a", "b", 5.0), ("b", "a", 5.0), ("c", "d", 5.0), ("d", "c", 5.0)], "s string, d string, w double")
    assert {x.node: x.community for x in graph.communities(one).collect()} == {"a": 0, "b": 0, "c": 1, "d": 1}
