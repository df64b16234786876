"""Running sums by ranges, alignment by bits, communities of parts, groups of parameters that are joined by others."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import align, carry_out, graph, search, skeleton
from tracelode.plans import spread


def test_before_in_order(spark):
    rng = random.Random(1)
    rows = [("hot" if k % 3 else f"k{k % 7}", k, rng.randint(0, 9)) for k in range(900)]
    d = spark.createDataFrame(rows, "key string, at int, n int")
    got = {r.at: r.before for r in spread.before_in_order(d, ["key"], ["at"], F.col("n"), "before").collect()}
    run = {}
    for k, at, n in rows:
        assert got[at] == run.get(k, 0)
        run[k] = run.get(k, 0) + n
    few = spread.before_in_order(d, ["key"], ["at"], F.col("n"), "before", 20).where("before <= 20").count()
    assert few == sum(v <= 20 for v in got.values())
    assert spread.before_in_order(d.limit(0), ["key"], ["at"], F.col("n"), "before").count() == 0


def test_budget_with_nulls_and_long_first_rows(spark):
    rows = [("a", 1, "x" * 4000), ("a", 2, "x" * 40), ("b", 1, None), ("b", 2, "x" * 400), ("b", 3, "x" * 4000), ("c", 5, "x" * 4)]
    d = spark.createDataFrame(rows, "source string, id int, text string")
    got = search.within_budget(d, "source", ["id"], "text", 200).collect()
    assert sorted((r.source, r.id, r.used) for r in got if r.source != "b" or r.id != 1) == [("a", 1, 1000), ("b", 2, 100), ("c", 5, 1)]
    assert {(r.source, r.id) for r in got} == {("a", 1), ("b", 1), ("b", 2), ("c", 5)}


def test_alignment_by_bits(spark):
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert align.common_length(a, b) == len(skeleton.alignment(a, b))
    assert align.common_length([None, "a"], [None, "a"]) == 1
    d = spark.createDataFrame([(["a", "b"], ["b"]), ([], ["a"]), (None, ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in d.select(align.lcs_length("a", "b")).collect()] == [1, 0, None]


def plain_communities(edges, passes=40):
    near = {}
    for s, d, w in edges:
        near.setdefault(s, {})[d] = near.setdefault(s, {}).get(d, 0.0) + w
    ids = sorted(near)
    degree = {i: sum(near[i].values()) for i in ids}
    m2 = sum(degree.values())
    own = {i: i for i in ids}
    total = dict(degree)
    for _ in range(passes):
        moved = False
        for i in ids:
            into = {}
            for j in sorted(near[i]):
                into[own[j]] = into.get(own[j], 0.0) + near[i][j]
            gain = lambda c: into.get(c, 0.0) / m2 - total[c] * degree[i] * 2 / (m2 * m2)  # noqa: B023, E731
            best = max([own[i], *into], key=lambda c: (gain(c), c == own[i]))
            top = gain(own[i])
            best = own[i]
            for c in into:
                if gain(c) > top:
                    best, top = c, gain(c)
            if best != own[i]:
                total[own[i]] -= degree[i]
                total[best] += degree[i]
                own[i], moved = best, True
        if not moved:
            break
    number = {}
    return {i: number.setdefault(own[i], len(number)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_of_several_parts_equal_one_sequential_pass(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{min(a, b):02}", f"n{max(a, b):02}") for _ in range(60) for g in (rng.randrange(4),) for a, b in ((g * 10 + rng.randrange(10), g * 10 + rng.randrange(10)),)}
    edges = [(x, y, float(rng.randint(1, 3))) for x, y in sorted(pairs)]
    both = edges + [(y, x, w) for x, y, w in edges if x != y]
    got = graph.communities(spark.createDataFrame(both, "s string, d string, w double")).collect()
    assert {r.node: r.community for r in got} == plain_communities(both)
    assert graph.communities(spark.createDataFrame([], "s string, d string, w double")).count() == 0


def test_parameter_groups_join_over_missing_values(spark):
    rows = [(r, s, v) for r, a, b, c in ((1, "x", "p", None), (2, "y", "q", None), (3, None, "r", "m"), (4, None, "s", "n")) for s, v in (("a", a), ("b", b), ("c", c)) if v]
    got = skeleton.parameter_groups(spark.createDataFrame(rows, "run int, slot string, value string"), "run", "slot", "value").collect()
    assert {r.slot: (r.parameter, r.variants) for r in got} == {"a": ("a", 2), "b": ("a", 4), "c": ("a", 2)}


def test_each_command_is_run_once(spark):
    asked = []

    def port(c):
        asked.append(c)
        if c == "bad":
            raise OSError("no network")
        return carry_out.Result(0)

    v = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "bad"), ("q", None)], "name string, command string")
    got = {(r.name, r.exit_code) for r in carry_out.run_validators(v.where("command is not null"), "name", port).collect()}
    assert asked == ["bad", "x"] and got == {("p", 0), ("q", 0), ("q", 127)}
    with pytest.raises(ValueError, match="more than 1"):
        carry_out.run_validators(v, "name", port, most=1)


def test_texts_in_one_row_group_are_split_by_many_tasks(spark, tmp_path):
    """Their terms are the work, so it isn't left to the one task that reads them."""
    from tracelode.operators import index, postings, search

    at = str(tmp_path / "docs")
    spark.range(400).selectExpr("id AS doc", "concat('token word', id % 7, ' license') AS text").coalesce(1).write.parquet(at)
    docs, tasks = spark.read.parquet(at), []
    for module in (search, postings, index):
        was = module.dealt
        try:
            module.dealt = lambda d, was=was: tasks.append((out := was(d)).select(F.spark_partition_id()).distinct().count()) or out
            if module is search:
                want = search.search(docs, "doc", "text", ["token", "license"]).collect()
            elif module is postings:
                postings.write_postings(docs, "doc", "text", str(tmp_path / "p"))
                assert postings.search_postings(spark, str(tmp_path / "p"), ["token", "license"]).collect() == want
            else:
                index.update(docs, "doc", "text", str(tmp_path / "i"))
                assert index.search_index(spark, str(tmp_path / "i"), ["token", "license"]).collect() == want
        finally:
            module.dealt = was
    assert tasks == [4, 4, 4, 4]
