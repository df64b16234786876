"""Repeated rows weigh as often as they come, once each, in the quality fit; where joins shuffle, rows that stand for documents are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import decontaminate, quality

from .test_quality_chat import _rows


def test_repeated_rows_have_a_weight_and_no_more(spark):
    rows, times = _rows(400, 4), 5
    vector = {i: quality.statistics([t.encode()])[0] for i, t, _ in rows}
    stats = spark.createDataFrame([(i, vector[i].tolist()) for i, _, _ in rows] * times, "id long, x array<double>").repartition(6)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, y int")
    model = quality.fit(stats, labels)
    chosen = spark.range(400).select("id", (quality._fold("id") != 0).alias("learnt"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0).alias("back")).where("learnt").collect()
    y_of = {i: float(y) for i, _, y in rows}
    own, held = ([r.id for r in chosen if r.back == b] for b in (False, True))
    every = np.vstack([vector[r.id] for r in chosen])
    assert model.mean == pytest.approx(every.mean(axis=0)) and model.scale == pytest.approx(np.maximum(every.std(axis=0), 1e-6), abs=1e-9)
    f = model.features(np.vstack([vector[i] for i in own]))
    penalty = quality.RIDGE * np.eye(f.shape[1]) / quality.FEATURES
    penalty[-1, -1] = 0
    plain = f @ np.linalg.solve(times * f.T @ f + penalty, times * f.T @ np.array([y_of[i] for i in own]))
    assert f @ model.weights == pytest.approx(plain, abs=1e-4)
    # The levels, from counts in which each row is there as often as it comes.
    raw = model.raw(np.vstack([vector[i] for i in held]))
    cells: dict[int, list[float]] = {}
    for s, i in zip(raw, held, strict=True):
        cell = cells.setdefault(int(np.floor((s + 1) / 3 * quality.BINS)), [0.0, 0.0])
        cell[0] += times
        cell[1] += times * y_of[i]
    n, y = (np.array([cells[k][j] for k in sorted(cells)]) for j in (0, 1))
    base = y.sum() / n.sum()
    level = quality.isotonic(y / n, n)
    block = np.cumsum(np.r_[0, np.diff(level) > 0])
    want = quality.isotonic(((np.bincount(block, y) + base) / (np.bincount(block, n) + 1))[block], n)
    assert model.levels == pytest.approx(want)


def test_the_bound_counts_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 100)
    rows = _rows(2000, 5)
    stats = spark.createDataFrame([(i % 20, quality.statistics([t.encode()])[0].tolist()) for i, t, _ in rows], "id long, x array<double>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    seen = []
    real = quality.cut
    monkeypatch.setattr(quality, "cut", lambda d: seen.append(real(d)) or seen[-1])
    quality.fit(stats, labels)
    known = next(d for d in seen if "w" in d.columns)
    assert 40 < known.agg(F.sum("w")).first()[0] < 180  # ids come a hundred times each


def test_documents_are_spread_where_joins_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(k, f"a{k} b{k} c d e f g h i j k l m n o p") for k in range(400)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "c d e f g h i j k l m n o"), (2, "q r")], "item_id long, text string")
    lefts, kind = [], type(docs)
    real = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: lefts.append((self, on)) or real(self, other, on, how))
    assert decontaminate.contamination(docs, bench).where("contaminated").count() == 400
    monkeypatch.undo()
    for keys in (["len", "fp"], ["len", "hash"]):
        (left,) = [d for d, on in lefts if on == keys]
        stand = left.where("len = 0")
        assert stand.count() == 400
        dealt = [r[1] for r in stand.repartition(4, *keys).groupBy(F.spark_partition_id()).count().collect()]
        assert len(dealt) == 4 and max(dealt) < 200


def test_the_driver_gets_the_sums_of_few_tasks(spark, monkeypatch):
    rows, gathered = _rows(600, 3), []
    stats = spark.createDataFrame([(i, quality.statistics([t.encode()])[0].tolist()) for i, t, _ in rows], "id long, x array<double>")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "id long, y int")
    kind = type(stats)
    collect = kind.collect

    def counted(self):
        got = collect(self)
        gathered.append(sum(len(v) for r in got for v in r if isinstance(v, (bytes, bytearray))))
        return got

    plain = quality.fit(stats, labels)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    monkeypatch.setattr(kind, "collect", counted)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spread = quality.fit(stats, labels)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert 0 < max(gathered) < 2 << 20  # those of 64 tasks were 46 MB
    x = np.array([quality.statistics([t.encode()])[0] for _, t, _ in rows])
    assert spread.score(x) == pytest.approx(plain.score(x), abs=1e-6)
