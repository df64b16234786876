"""The quality fit against plain normal equations, isotonic levels against all partitions, and chats of any size and names."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelode.llm import chat_format, quality


def _rows(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    make = lambda good: " ".join(word() + ("" if good else rng.choice(("!!", "", "#"))) for _ in range(rng.randint(1, 60)))
    return [(i, make(i % 3 > 0), int(i % 3 > 0)) for i in range(n)]


def test_fit_equals_plain_normal_equations(spark):
    import zlib

    rows = _rows(500, 1)
    stats = spark.createDataFrame([(i, quality.statistics([t.encode()])[0].tolist()) for i, t, _ in rows], "id long, x array<double>").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 1), (3, None), (None, 1)], "id long, y int")
    model = quality.fit(stats, labels)
    # Plain: rows of folds 1 to 4, a quarter held back for the levels.
    y_of = {i: float(y) for i, _, y in rows} | {0: (rows[0][2] + 1) / 2}
    back = {r.id for r in spark.range(500).where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0).collect()}
    ids = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 != 0]
    x = np.vstack([quality.statistics([rows[i][1].encode()])[0] for i in ids])
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(np.maximum(x.std(axis=0), 1e-6), abs=1e-9)
    own = [k for k, i in enumerate(ids) if i not in back]
    f = model.features(x[own])
    y = np.array([y_of[ids[k]] for k in own])
    penalty = quality.RIDGE * np.eye(f.shape[1]) / quality.FEATURES
    penalty[-1, -1] = 0
    plain = f @ np.linalg.solve(f.T @ f + penalty, f.T @ y)
    assert f @ model.weights == pytest.approx(plain, abs=1e-4)
    assert (np.diff(model.levels) >= 0).all() and (model.levels >= 0).all() and (model.levels <= 1).all()


def test_isotonic_is_the_nearest_of_all_rising_sequences():
    rng = np.random.default_rng(3)
    for _ in range(40):
        n = rng.integers(1, 8)
        value, weight = rng.integers(0, 4, n).astype(float), rng.integers(1, 4, n).astype(float)
        got = quality.isotonic(value, weight)
        cost = lambda s: float((weight * (value - s) ** 2).sum())  # noqa: B023, E731
        best = None
        for cuts in itertools.product((0, 1), repeat=n - 1):  # every way to pool neighbours
            block = np.cumsum([0, *cuts])
            level = np.bincount(block, value * weight) / np.bincount(block, weight)
            if (np.diff(level) >= -1e-12).all():
                best = min(cost(level[block]), best if best is not None else np.inf)
        assert (np.diff(got) >= -1e-12).all() and cost(got) == pytest.approx(best)


def test_scores_of_long_repeated_and_odd_rows(spark):
    rows = _rows(300, 2)
    long = "word " * 200_000
    docs = [(i, t) for i, t, _ in rows] + [(1000, long), (1000, long), (None, "x"), (1001, None), (1002, "")]
    d = spark.createDataFrame([(i, t, 9, 9.0, 9, "x") for i, t in docs], "doc_id long, text string, id int, score double, held_out int, x string")
    labels = spark.createDataFrame([(i, y, "q") for i, _, y in rows], "doc_id long, quality int, text string")
    got = quality.quality_scores(d, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    score = {}
    for r in got:
        assert score.setdefault(r.id, r.score) == r.score
    assert score[1001] == score[1002] and [r.held_out for r in got if r.id is None] == [False]
    assert {r.score for r in quality.quality_scores(d, labels.limit(0)).collect()} == {0.5}


def test_chats_of_any_size_with_clashing_columns(spark):
    long = "\\" * 200_000 + "<s>" * 50_000 + "é[INST]" * 10_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (2, None, "user", "x")]
    d = spark.createDataFrame([(*r, "q", 5, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string, segments int, formatted string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(d)).withColumn("loss", chat_format.loss_text(F.col("segments"))).collect()}
    # Turns of one place are ordered by role and text; a row that comes twice is two turns.
    assert [(t.role, t.text) for t in got[1].turns] == [("user", long), ("assistant", long), ("assistant", "a"), ("assistant", "a")]
    assert got[1].loss == long + "aa" and got[1].n_violations == 2 and got[2].loss == ""
    plain = 0
    for t in got[1].turns:
        plain += len(t.text) + t.text.count("\\") + t.text.count("<s>") + t.text.count("[INST]") + (15 if t.role == "user" else 10)
    assert len(got[1].formatted) == plain
