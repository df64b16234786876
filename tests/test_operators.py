import hashlib

from pyspark.sql import functions as F

from tracelode.functions import text as T
from tracelode.operators import align, compare, graph, link, search, stats, trace


def test_prefix_hash_is_of_the_messages_before(spark):
    m = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a")], "rec int, seq int, role string, text string")
    got = {(r.rec, r.seq): r.prefix_hash for r in trace.prefix_hashes(m, "rec", "seq", "role", "text").collect()}
    digest = lambda *x: hashlib.sha256("\x1e".join(x).encode()).hexdigest()
    assert got[1, 0] == got[2, 0] == digest("")
    assert got[1, 2] == digest("user\x1fa", "assistant\x1fb")


def test_tree(spark):
    # s - u - a - t with two children of t; a dangling parent is a root
    rows = [(1, "s", None), (1, "u", "s"), (1, "a", "u"), (1, "t", "a"), (1, "a2", "t"), (1, "a2b", "t"), (1, "x", "gone")]
    e = spark.createDataFrame(rows, "rec int, node string, parent string")
    assert {r.node for r in trace.leaves(e, "rec", "node", "parent").collect()} == {"a2", "a2b", "x"}
    assert [(r.node, r.children) for r in trace.branch_points(e, "rec", "parent").collect()] == [("t", 2)]
    assert {r.node: r.depth for r in trace.depths(e, "rec", "node", "parent").collect()} == {"s": 0, "u": 1, "a": 2, "t": 3, "a2": 4, "a2b": 4, "x": 0}


def test_redaction_masks_every_credential(spark):
    d = spark.createDataFrame([("A_TOKEN=abcd1234 B_TOKEN=efgh5678",), ("see https://u:pw@h/x",), ("--prefix /usr",), ("-----BEGIN PRIVATE KEY-----\nabc",)], "t string")
    got = [r[0] for r in d.select(T.redacted(F.col("t"))).collect()]
    assert got == ["A_TOKEN=[redacted] B_TOKEN=[redacted]", "see https://[redacted]@h/x", "--prefix /usr", "[redacted]"]
    assert [r[0] for r in d.select(T.secret_label(F.col("t"))).collect()] == ["assignment", "url_credentials", None, "private_key"]


def test_text_functions(spark):
    d = spark.createDataFrame([("parseHTTPRequest_v2 a",)], "t string")
    assert d.select(T.terms(F.col("t"))).first()[0] == ["parse", "http", "request", "v2"]
    p = spark.createDataFrame([("src/a.test.ts",), ("package.json",), ("Dockerfile",), (".github/workflows/x.yml",), ("x.zig",)], "t string")
    assert [r[0] for r in p.select(T.file_kind(F.col("t"))).collect()] == ["test", "manifest", "container", "ci", "other"]


def test_outcome_branches(spark):
    rows = [("a", 1, "err", 0), ("a", 2, "ok", 0), ("b", 1, "err", 0), ("c", 1, "ver", 1), ("c", 2, "ver", 0), ("d", 1, "ver", 1), ("e", 1, "ok", 0)]
    r = spark.createDataFrame(rows, "run string, seq int, kind string, bad int")
    k = F.col("kind")
    got = stats.outcomes(r, ["run"], ["seq"], k == "err", k == "ver", F.col("bad") == 1)
    assert {x.run: x.status for x in got.collect()} == {"a": "unknown", "b": "failed", "c": "success", "d": "failed", "e": "unknown"}
    assert stats.combined_outcome(got.withColumn("g", F.lit(1)), ["g"]).first().status == "mixed"


def test_positional_diff(spark):
    f = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (2, 0, "x"), (2, 1, "z"), (3, 0, "x"), (4, 0, "x")], "rec int, pos int, fp string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (3, 1), (3, 4)], "l int, r int")
    got = {(r.l, r.r): (r.common_prefix, r.reason) for r in compare.positional_diff(pairs, f, f).collect()}
    assert got == {(1, 2): (1, "content"), (1, 3): (1, "left-only"), (3, 1): (1, "right-only"), (3, 4): (1, "identical")}


def test_alignment(spark):
    d = spark.createDataFrame([(list("abcd"), list("acd")), (list("abcd"), list("xabyd")), ([], list("a"))], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(align.lcs_length(F.col("a"), F.col("b"))).collect()] == [3, 3, 0]


def test_links_and_fold(spark):
    rows = [(1, 1, "need"), (1, 2, "give"), (1, 3, "need"), (1, 4, "give"), (2, 1, "give")]
    s = spark.createDataFrame(rows, "t int, seq int, kind string")
    give, need = F.col("kind") == "give", F.col("kind") == "need"
    assert {(r.requirement, r.provider) for r in link.link_requirements(s, "t", ["seq"], give, need, "seq").collect()} == {(1, None), (3, 2)}
    assert {(r.t, r.provision) for r in link.unconsumed(s, "t", ["seq"], give, need, "seq").collect()} == {(1, 4), (2, 1)}
    assert [r.status for r in link.status_fold(s.where("t = 1"), "t", ["seq"], F.col("seq") == 2).orderBy("seq").collect()] == ["ok", "failed", "skipped", "skipped"]


def test_search_and_budget(spark):
    d = spark.createDataFrame([(1, "deploy service"), (2, "deploy"), (3, "other words"), (4, "")], "id int, t string")
    got = search.search(d, "id", "t", ["deploy"]).collect()
    assert [r.doc for r in got] == [2, 1] and got[0].score == 1.0
    b = search.within_budget(d.withColumn("g", F.lit(1)), "g", ["id"], "t", 6)
    assert [r.id for r in b.orderBy("id").collect()] == [1, 2]


def test_graph(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "b")], "run int, seq int, k string")
    e = graph.transitions(s, "run", ["seq"], "k")
    assert {(r.s, r.d): float(r.w) for r in e.collect()} == {("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 1.0}
    assert {r.node: float(r.degree) for r in graph.degrees(e).collect()} == {"a": 0.5, "b": 1.5}
