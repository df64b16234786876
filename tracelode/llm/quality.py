"""Quality classifier: a ridge fit on random Fourier features of document statistics, calibrated.

Statistics of the whole text (shares of character classes, word and line repetition, lengths) are
standardised and mapped to cosines of random projections, which approximate a Gaussian kernel.
Each partition sums its rows' normal equations; a tree of tasks adds these sums, of fixed size, so that the
driver gets those of a few tasks only, and solves for the ridge weights. A held-back fold gives an isotonic (pool-adjacent-violators) map from
raw scores to probabilities, from counts in a fixed number of bins.

Only ``FIT_ROWS`` labelled rows, give or take what a hash does, are fitted on, chosen by hash of id and statistics; every row is scored.

Defined results: null text is empty, and empty texts are scored like any other. A row with a null
id is scored, is not held out and never learnt from. Null labels are ignored, several labels of an
id are averaged. Without any usable label every score is 0.5. Texts of any length are read whole, and
rows that repeat an id are scored one by one; equal texts have equal scores, and a score at the threshold
is predicted 1. An empty table gives an empty result. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, cut, hot_keys, split_join

#: Bound on the labelled rows that the fit uses.
FIT_ROWS = 200_000
#: Random features, ridge penalty (for standardised targets), bins of the calibration.
FEATURES, RIDGE, BINS = 300, 1.0, 1000
THRESHOLD = 0.3
#: Partitions whose normal equations (a third of a MB) one task adds, so the driver gets those of a 16th of the partitions.
_BRANCH = 16

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"?", b"|", b"#", b"$%&*@^~", b"\"'`", b"()[]{}<>", b"=+-_/\\:;", b" ", b"\n\r", b"\t\x0b\x0c", bytes(range(128, 256))]
_OF_BYTE = np.zeros((256, len(_CLASSES)))
for _k, _c in enumerate(_CLASSES):
    _OF_BYTE[list(_c), _k] = 1
_LETTERS = _CLASSES[0] + _CLASSES[1] + _CLASSES[-1]
_OWN = 16
WIDTH = len(_CLASSES) + _OWN


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of WIDTH numbers for each UTF-8 text."""
    out = np.zeros((len(texts), WIDTH))
    for i, b in enumerate(texts):
        if not b:
            continue
        counts = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        share = counts / len(b)
        words = b.split()
        n = max(len(words), 1)
        seen = Counter(words)
        lines = [x for x in b.split(b"\n") if x]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
        present = share[share > 0]
        out[i, : len(_CLASSES)] = np.sqrt(share @ _OF_BYTE)
        out[i, len(_CLASSES) :] = [
            np.log1p(len(b)),
            np.log1p(n),
            lengths.mean(),
            lengths.std(),
            np.log1p(lengths.max()),
            len(seen) / n,
            max(seen.values(), default=0) / n,
            sum(1 for c in seen.values() if c == 1) / n,
            len(set(lines)) / max(len(lines), 1),
            np.log1p(len(b) / max(len(lines), 1)),
            sum(c for w, c in seen.items() if w[-1:] in b"!#$%&*|@~^") / n,
            sum(c for w, c in seen.items() if w[-1:] == b".") / n,
            sum(c for w, c in seen.items() if w.isupper()) / n,
            sum(c for w, c in seen.items() if len(w.translate(None, _LETTERS)) == len(w)) / n,
            -(present * np.log(present)).sum(),
            sum(c for w, c in seen.items() if w[:1].isupper()) / n,
        ]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.project + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.levels is None:
            return np.full(len(x), 0.5)
        return np.interp(self.raw(x), self.knots, self.levels)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to value, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _vectors(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column(k).flatten().to_numpy().reshape(b.num_rows, WIDTH)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = statistics([t or b"" for t in b.column(1).to_pylist()])
        lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * WIDTH, x.ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "x"])


_HALF = np.triu_indices(FEATURES + 1)  # of a symmetric matrix


def _sums(shared):
    """One row for each partition: the sums of its rows' outer products (a half of the matrix) and of its targets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, gram, target = shared.value, np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
        for b in batches:
            f, w = model.features(_vectors(b, 0)), b.column(2).to_numpy()
            gram += f.T @ (f * w[:, None])
            target += f.T @ (b.column(1).to_numpy() * w)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.r_[gram[_HALF], target].tobytes()])], ["part", "sums"])

    return run


def _add_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each group of _BRANCH partitions, which are added in their order, so that a run gives the same sums again."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    for b in batches:
        for part, sums in zip(*(x.to_pylist() for x in b.columns), strict=True):
            found.setdefault(part // _BRANCH, []).append((part, sums))
    total = [sum(np.frombuffer(x) for _, x in sorted(own)).tobytes() for own in found.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(total, pa.binary())], ["part", "sums"])


def _normal_equations(rows: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """The sums over rows (x, y, w), of at most some hundred partitions."""
    sums = rows.mapInArrow(_sums(shared), "part int, sums binary").repartition(F.floor(F.col("part") / _BRANCH))
    got = sorted((r.part, r.sums) for r in sums.mapInArrow(_add_sums, "part int, sums binary").collect())
    total = sum((np.frombuffer(x) for _, x in got), np.zeros(len(_HALF[0]) + FEATURES + 1))
    gram = np.zeros((FEATURES + 1, FEATURES + 1))
    gram[_HALF] = total[: len(_HALF[0])]
    return gram + np.triu(gram, 1).T, total[len(_HALF[0]) :]


def _raw_scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.raw(_vectors(b, 1))), b.column(0), b.column(2)], ["score", "y", "w"])

    return run


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(_vectors(b, 1)))], ["id", "score"])

    return run


def _fold(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    """stats: id, x; labels: id, y. Rows of fold 0 (by crc32 of the id) are never learnt from; equal rows of an id are one with a weight."""
    spark = stats.sparkSession
    rng = np.random.default_rng(20)
    labels = labels.where("id is not null and y is not null").groupBy("id").agg(F.avg("y").cast("double").alias("y")).where(_fold("id") != 0)
    rows = cut(stats.groupBy("id").agg(F.count("*").alias("k")).join(labels, "id"))
    total = rows.agg(F.sum("k")).first()[0] or 0
    part = min(1.0, FIT_ROWS / max(total, 1))
    slot = F.pmod(F.xxhash64("id", "x", F.lit(1)), F.lit(1_000_000))
    chosen = stats.where(slot < int(part * 1_000_000))
    known = split_join(chosen, labels, ["id"], hot_keys(rows, ["id"], total)).groupBy("id", "x", "y").agg(F.count("*").alias("w"))
    known = cut(known.coalesce(64))
    places = known.select("w", F.posexplode("x").alias("k", "v")).groupBy("k")
    means = places.agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m")).collect()
    model = Model(np.zeros(WIDTH), np.ones(WIDTH), rng.normal(size=(WIDTH, FEATURES)) / np.sqrt(WIDTH) * 0.7, rng.uniform(0, 2 * np.pi, FEATURES))
    if not means:
        return model
    for r in means:
        model.mean[r.k] = r.m
    mean = F.get(F.array(*[F.lit(float(m)) for m in model.mean]), F.col("k"))
    for r in places.agg(F.sqrt(F.sum(F.col("w") * (F.col("v") - mean) ** 2) / F.sum("w")).alias("s")).collect():
        model.scale[r.k] = max(r.s, 1e-6)
    back = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0
    shared = spark.sparkContext.broadcast(model)
    gram, target = _normal_equations(known.where(~back).select("x", "y", "w"), shared)
    penalty = RIDGE * np.eye(FEATURES + 1) / FEATURES
    penalty[-1, -1] = 0
    model.weights = np.linalg.lstsq(gram + penalty, target, rcond=None)[0]
    shared = spark.sparkContext.broadcast(model)
    raw = known.where(back).select("y", "x", "w").mapInArrow(_raw_scores(shared), "score double, y double, w long")
    cell = F.floor((F.col("score") + 1) / 3 * BINS)
    cells = raw.groupBy(cell.alias("cell")).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("y")).orderBy("cell").collect()
    if not cells:
        return model
    n = np.array([r.n for r in cells], float)
    y = np.array([r.y for r in cells], float)
    base = y.sum() / n.sum()
    model.knots = (np.array([r.cell for r in cells]) + 0.5) * 3 / BINS - 1
    level = isotonic(y / n, n)
    block = np.cumsum(np.r_[0, np.diff(level) > 0])
    own_y, own_n = np.bincount(block, y), np.bincount(block, n)
    # Each block is shrunk a little to the base rate, so that one of few rows is never sure.
    model.levels = isotonic(((own_y + base) / (own_n + 1))[block], n)
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD
) -> DataFrame:
    """Per row of docs: id, held_out, score, predicted."""
    spark = docs.sparkSession
    arrow_limits(spark)
    body = F.encode(F.col(text_col), "UTF-8")
    stats = cut(docs.select(F.col(id_col).cast("long").alias("id"), body.alias("body")).mapInArrow(_stats, "id long, x array<double>"))
    model = fit(stats, labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("y")))
    shared = spark.sparkContext.broadcast(model)
    scored = stats.mapInArrow(_scores(shared), "id long, score double")
    return scored.select("id", F.coalesce(_fold("id") == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that the classifier rejects; rows that repeat an id go together."""
    bad = quality_scores(docs, labels, id_col, text_col).where("predicted = 0").select(F.col("id").alias("__id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")
