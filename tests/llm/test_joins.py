"""Joins that split hot keys, components of hubs, and pairs that are verified once."""

import random

from pyspark.sql import functions as F

from tracelode.llm import common, jaccard_join
from tracelode.plans import spread

from .test_ops import DOCS, rows


def test_split_join_equals_a_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 900).cast("long").alias("k"), F.col("id").alias("v"), F.lit("s").alias("slot"))
    small = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    hot = common.hot_keys(big.groupBy("k").agg(F.count("*").alias("n")), ["k"], 5000, "n")
    assert [r.k for r in hot.collect()] == [1] and hot.first().splits > 10
    for how in ("inner", "left"):
        got = common.split_join(big, small, ["k"], hot, how)
        assert sorted(got.columns) == ["k", "slot", "v", "w"]
        assert sorted(got.select("k", "v", "w").collect(), key=repr) == sorted(big.join(small, "k", how).select("k", "v", "w").collect(), key=repr)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    dealt = common.split_join(big, small, ["k"], hot).where("k = 1").select(F.spark_partition_id()).distinct().count()
    for k, v in before.items():
        spark.conf.set(k, v)
    assert dealt > 1


def test_components_of_a_hub_and_a_path(spark):
    hub = [(0, i) for i in range(1, 400)]
    path = [(1000 + i, 1001 + i) for i in range(60)]
    edges = spark.createDataFrame([*hub, *path, (None, 1), (5, 5), (2, 1), (0, 1)], "a long, b long")
    got = {r.node: r.root for r in spread.components(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(400)} | {1000 + i: 1000 for i in range(61)}
    assert spread.components(edges.limit(0), "a", "b").count() == 0


def _near_copies(n, seed):
    """One large group of near copies that share their n-grams, a second one close to it, and others."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    other = base[:48] + [f"x{k}" for k in range(12)]
    texts = []
    for k in range(n):
        own = list(base if k % 3 else other)
        own[rng.randrange(len(own))] = f"u{k}"
        texts.append(" ".join(own))
    return [*texts, *texts[:5], None, "", "w1", "w1"]


def test_no_pair_is_verified_twice(spark, monkeypatch):
    seen, real = [], jaccard_join._Join.verified

    def counted(self, pairs):
        seen.extend(tuple(sorted((bytes(r.a), bytes(r.b)))) for r in pairs.collect())
        return real(self, pairs)

    monkeypatch.setattr(jaccard_join._Join, "verified", counted)
    texts = _near_copies(150, 3)
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows(texts), DOCS), n=3, threshold=0.8, counters=1 << 12).collect()
    assert seen and len(seen) == len(set(seen))
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 10 * len(x & sets[j]) >= 8 * len(x | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert sorted((r.id, r.component_id) for r in got) == list(enumerate(root))


def test_counters_are_summed_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_BRANCH", 3)
    docs = spark.createDataFrame(rows(_near_copies(60, 4)), DOCS)
    one = jaccard_join._Join(docs.coalesce(1), "doc_id", "text", 3, 0.8, 1 << 12)
    many = jaccard_join._Join(docs.repartition(20), "doc_id", "text", 3, 0.8, 1 << 12)
    kept = lambda j: sorted((r.gram, bytes(r.sig), r.n, r.pos) for r in j.posted.collect())
    assert kept(one) == kept(many) and kept(one)


def test_postings_that_cannot_be_hot_are_dealt_once(spark, monkeypatch):
    written, real = [], jaccard_join.cut_table

    def counted(df):
        written.append(df.columns)
        return real(df)

    monkeypatch.setattr(jaccard_join, "cut_table", counted)
    texts = _near_copies(60, 6)
    docs = spark.createDataFrame(rows(texts), DOCS).repartition(5)
    found = lambda: sorted((r.id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n=3, threshold=0.8).collect())
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 1000)
    once = found()
    assert [c for c in written if "k" in c] == [] and "sig" not in written[0]  # no table of met n-grams, and no signature in each row
    monkeypatch.setattr(jaccard_join, "HOT_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "HOT_SHARE", 1 << 30)
    written.clear()
    assert found() == once and any("k" in c for c in written)
    monkeypatch.setattr(spread, "HOT_ROWS", 10)  # some are hot as well
    assert found() == once
