from tracelode import registry
from tracelode.operators import graph, replay, trace


def test_prefix_digests_bind_order_and_text(spark):
    rows = [("a", 0, "user", "x"), ("a", 5, "assistant", "y"), ("a", 9, "user", "z"), ("b", 1, "user", "x"), ("b", 2, "assistant", "y"), ("b", 3, "user", None), ("c", 0, "assistant", "y"), ("c", 1, "user", "x"), ("c", 2, "user", "z")]
    d = trace.prefix_digests(spark.createDataFrame(rows, "r string, s long, role string, text string"), ["r"], "s", "role", "text", block=4)
    got = {(r.r, r.s): r.prefix_digest for r in d.collect()}
    assert len(got) == 9 and got["a", 0] == got["b", 1] == got["c", 0]
    assert got["a", 5] == got["b", 2] != got["c", 1] and got["a", 9] == got["b", 3] != got["c", 2]


def test_compacted_views_give_a_second_hash(spark):
    m = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", f"m{k}") for k in (0, 1, 2, 4, 5)], "rec long, seq long, role string, text string")
    c = spark.createDataFrame([(1, 3, 2, " sum ")], "rec long, at long, kept long, summary string")
    v = trace.compacted_views(m, c, "rec", "seq", "role", "text")
    assert [(r.seq, r.role, r.text) for r in v.orderBy("seq").collect()] == [(1, "compactionSummary", "sum"), (2, "assistant", "m2"), (4, "assistant", "m4"), (5, "user", "m5")]
    assert replay.serve(7, [(0, "long"), (1, "short"), (2, "none")], [(4, "long", None), (6, "l2", "short")], fall_back=False) == [(7, 0, "hash", 4), (7, 1, "hash", 6), (7, 2, "miss", None)]


def test_compactions_are_taken_at_their_point(spark):
    assert replay.take_compactions([1, 3, 3], [0, 1, 1, 2, 3, 3, 4]) == [None, 0, None, None, 1, 2, None]
    assert replay.take_compactions([1], [0, 2]) == [None, None]
    q = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 0, 0)], "rec long, req long, served long")
    p = spark.createDataFrame([(1, 10, 1)], "rec long, nth long, answers_before long")
    assert {(r.rec, r.req): r.compaction for r in replay.compactions_due(q, p).collect()} == {(1, 0): None, (1, 1): 10, (2, 0): None}


def test_progress(spark):
    s = spark.createDataFrame([(1, 0, "hash", 4), (1, 1, "cursor", 6)], replay.SERVED)
    a = spark.createDataFrame([(1, 4), (1, 6), (2, 1)], "rec long, seq long")
    assert {r.rec: (r.answers, r.consumed, r.misses, r.finished) for r in replay.progress(s, a).collect()} == {1: (2, 2, 1, True), 2: (1, 0, 0, False)}


def test_alike_finds_every_pair(spark):
    import random

    from tracelode.operators.skeleton import alignment

    rng = random.Random(3)
    runs = {f"n{k}": [rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))] for k in range(25)}
    want = {(a, b): round(n, 9) for a in runs for b in runs if a < b and (n := len(alignment(runs[a], runs[b])) / min(len(runs[a]), len(runs[b]))) >= 0.3}
    d = spark.createDataFrame([*runs.items(), ("none", [])], "name string, keys array<string>")
    assert {(r.a, r.b): round(r.share, 9) for r in graph.alike(d).collect()} == want


def test_procedure_graph(spark):
    kind = "name string, steps array<struct<key: string, verb: string>>, parameters array<struct<name: string, members: array<struct<step: long, slot: string>>>>"
    p = spark.createDataFrame([("x", [("a", "A"), ("b", "B"), ("b", "B")], [("q", [(1, "s")])]), ("y", [("a", "A")], [])], kind)
    nodes, edges = graph.procedure_graph(p)
    w = {(r.s, r.d): r.w for r in edges.collect()}
    half = {("procedure:x", "step:a"): 1, ("procedure:x", "step:b"): 2, ("procedure:y", "step:a"): 1, ("step:a", "step:b"): 0.5, ("procedure:x", "slot:x#1#s"): 2, ("slot:x#1#s", "step:b"): 1, ("procedure:x", "procedure:y"): 4}
    assert w == half | {(d, s): x for (s, d), x in half.items()}
    assert {(r.node, r.kind) for r in nodes.collect()} == {("procedure:x", "procedure"), ("procedure:y", "procedure"), ("step:a", "step"), ("step:b", "step"), ("slot:x#1#s", "slot")}


def test_hub_steps_converge(spark):
    sf = "/root/testdata/sf0.001"
    near: dict[str, dict[str, int]] = {}
    for p, s in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        for a, b in ((f"p{p}", f"s{s}"), (f"s{s}", f"p{p}")):
            near.setdefault(a, {})[b] = near.setdefault(a, {}).get(b, 0) + 1
    n = len(near)
    score = dict.fromkeys(near, 1 / n)
    for rounds in range(1, 101):
        new = dict.fromkeys(near, 0.15 / n)
        for a, to in near.items():
            for b, w in to.items():
                new[b] += 0.85 * score[a] * w / sum(to.values())
        change, score = sum(abs(new[a] - score[a]) for a in near), new
        if change < n * 1e-6:
            break
    got, early = ({r.node: r.score for r in registry.queries()[q](spark, sf).collect()} for q in ("hub_steps_converged", "hub_steps"))
    assert rounds > 5 and got.keys() == score.keys() and max(abs(got[a] - score[a]) for a in score) < 1e-6
    assert max(abs(early[a] - score[a]) for a in score) > 1e-4
