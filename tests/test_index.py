"""An index that follows its documents: the same as one written anew after any edits, and what an update reads and writes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracelode.operators import index, search

WORDS = ["deploy", "deployment", "redeploys", "to", "tokens", "token", "TokenList", "a", "xy", "docker", "é", "x1", "build2Go"]
MIXED = ["deploy", "none", "oy", "token", "xy"]
QUERIES = (["deploy"], None), (["docker", "docker"], 3), (["none"], None), (["to"], 3)


def _frame(spark, docs):
    rows = [(k, t, 1, "z", 5) for k, own in docs.items() for t in own]
    return spark.createDataFrame(rows, "id long, t string, term int, tf string, generation int")


def _same(spark, at, docs, queries=((MIXED, None),)):
    joined = spark.createDataFrame([(k, " ".join(x or "" for x in own)) for k, own in docs.items()], "id long, t string")
    for query, limit in queries:
        want = [tuple(r) for r in search.search(joined, "id", "t", query, limit).collect()]
        assert [tuple(r) for r in index.search_index(spark, at, query, limit).collect()] == want, (query, limit)
    want = {(r.term, r.df, r.idf) for r in search.term_statistics(joined, "t").collect()}
    assert {(r.term, r.df, r.idf) for r in index.frequencies(spark, at).withColumn("idf", F.round("idf", 6)).collect()} == want


@pytest.mark.parametrize("listed", [1000, 1])
def test_random_edits(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(index, "LISTED", listed)
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))
    at = str(tmp_path)
    docs = {k: [text()] for k in range(40)} | {90: [None], 91: [""], 92: ["deploy " * 500], 93: ["docker", "docker"], 94: ["docker docker"]}
    assert index.update(_frame(spark, docs), "id", "t", at) == len(docs)
    _same(spark, at, docs)
    for step in range(3):
        was = dict(docs)
        for k in rng.sample(sorted(docs), 6):
            if rng.random() < 0.5:
                del docs[k]
            else:
                docs[k] = [text()]
        docs |= {100 + 10 * step + k: [text()] for k in range(3)}
        if step == 2:
            docs |= {k: own for k, own in was.items() if k not in docs}  # what went comes back
        differ = sum(docs.get(k) != was.get(k) for k in docs.keys() | was.keys())
        assert index.update(_frame(spark, docs), "id", "t", at) == differ
        _same(spark, at, docs)
        if step == 1:
            index.compacted(spark, at)
            index.vacuum(spark, at)
            _same(spark, at, docs)
            assert [r.generation for r in spark.read.parquet(f"{at}/commits").collect()] == [3]
    assert index.update(_frame(spark, docs), "id", "t", at) == 0
    _same(spark, at, docs, QUERIES)


def test_what_an_update_writes_and_half_of_one(spark, tmp_path):
    at = str(tmp_path)
    docs = {k: [f"w{k:05d} common"] for k in range(3000)}
    index.update(_frame(spark, docs), "id", "t", at)
    docs[17] = ["new words here"]
    del docs[18]
    assert index.update(_frame(spark, docs), "id", "t", at) == 2
    own = {p: spark.read.parquet(f"{at}/{p}/generation=1").count() for p in ("documents", "by_term", "by_doc", "gone", "frequencies")}
    assert own == {"documents": 1, "by_term": 3, "by_doc": 4, "gone": 2, "frequencies": 7}
    # An update that stopped before its commit isn't seen, and the next one writes its generation anew.
    spark.createDataFrame([(19,)], "doc long").write.parquet(f"{at}/gone/generation=2")
    assert [r.doc for r in index.search_index(spark, at, ["w00019"]).collect()] == [19]
    docs[20] = ["w00020 other"]
    assert index.update(_frame(spark, docs), "id", "t", at) == 1
    assert [r.doc for r in index.search_index(spark, at, ["w00019"]).collect()] == [19]
    assert index.search_index(spark, at, ["w00018"]).count() == 0


def test_empty_tables_null_ids_and_string_ids(spark, tmp_path):
    none = spark.createDataFrame([], "id string, t string")
    at = str(tmp_path)
    assert index.update(none, "id", "t", at) == 0
    assert index.search_index(spark, at, ["deploy"]).count() == 0 and index.search_index(spark, at, []).count() == 0
    some = spark.createDataFrame([("x", "deploy"), (None, "deploy deploy"), ("y", None)], "id string, t string")
    assert index.update(some, "id", "t", at) == 2
    assert [tuple(r) for r in index.search_index(spark, at, ["deploy"]).collect()] == [("x", 1.0, 1)]
    assert index.update(none, "id", "t", at) == 2
    assert index.search_index(spark, at, ["deploy"]).count() == 0 and index.frequencies(spark, at).count() == 0


@pytest.mark.parametrize("sent", [1_000_000, 2])
def test_stored_terms_stay_where_they_are(spark, tmp_path, monkeypatch, sent):
    """Terms are counted where texts are split, and stored rows by document are shuffled for an update only where more documents changed than are sent to tasks."""
    monkeypatch.setattr(index, "SENT", sent)
    monkeypatch.setattr(index, "LISTED", 1)
    monkeypatch.setattr(search, "TASK_TEXTS", (8, 4096))
    written, put = {}, index._put

    def noted(rows, at, part, generation, **how):
        written[part, generation] = rows._jdf.queryExecution().executedPlan().toString()
        return put(rows, at, part, generation, **how)

    monkeypatch.setattr(index, "_put", noted)
    at, docs = str(tmp_path), {k: [f"w{k} token tokenLists r{k % 5}"] for k in range(30)} | {40: ["token", "lists again"], 41: [None]}
    index.update(_frame(spark, docs), "id", "t", at)
    assert written["by_doc", 0].count("Generate") == 2  # ids of several texts have a path of their own
    docs |= {k: [f"w{k} token changed"] for k in range(20)}
    del docs[29], docs[40]
    assert index.update(_frame(spark, docs), "id", "t", at) == 22
    dealt_by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", written["by_doc", 1])
    assert dealt_by and (len(dealt_by) == 1) == (sent > 2) and not any("term" in keys for keys in dealt_by)
    _same(spark, at, docs)
    index.compacted(spark, at)
    assert ("ShuffledHashJoin" in written["by_doc", 2]) == (sent == 2) and "SortMergeJoin" not in written["by_doc", 2]
    _same(spark, at, docs)
