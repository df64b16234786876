"""Centroid clustering of whole-number vectors, with partition-local ball trees as filters.

Each component becomes the integer floor(scale * x). Every partition packs its vectors, some thousands at a
time, into metric trees: a node has the radius, the number and the integer sum of the vectors below it. The trees
are written once and met in every round. By the triangle inequality a ball of centre m and radius r lies
nearest to centroid i as a whole if |m - i| + r < |m - j| - r for all others; then its number and sum count for i
at once. Any other ball is left for its children, and a leaf's vectors are compared one by one, in whole
numbers. Bounds are taken with a margin over what rounding can do, so they decide nothing that integers would
decide otherwise; ties go to the smaller centroid.

Centroids start as the k kept vectors of smallest SHA-256 of "1:<id>" and move to the floor of sum / number
of their vectors, exactly; one without vectors stays. A task holds one tree; per partition k rows of sums go on,
which Spark adds up, and k rows reach the driver in a round.

Defined results: a vector of another number of components, or with a null, NaN or infinite one, is left out,
as is one with a component of 2^21 or more in size: squared distances would no longer fit a long. A row with
a null id is assigned but starts no centroid; rows that repeat an id count one by one and, where their hashes
tie, start in the order of their components. With fewer than k vectors all are centroids. An empty table gives an
empty result. Only the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, cut

#: Vectors of a tree, at most, and of a leaf unless they are equal.
TREE_ROWS, LEAF_ROWS = 8192, 32
#: Components of this size or more are left out.
LIMIT = 1 << 21
#: Up to this size of components a product of vectors is exact in floating point.
_EXACT = 1 << 22
_SLACK = 1e-9


@dataclass
class Tree:
    """Nodes of a ball tree over rows of x: each is the rows from begin to end; children -1: a leaf."""

    x: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def build(x: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over whole-number rows x, and the order in which it holds them."""
    points, order = x.astype(np.float64), np.arange(len(x))
    begin, end, left, right, radius, sums = [], [], [], [], [], []

    def add(a: int, b: int) -> int:
        own = points[order[a:b]]
        begin.append(a)
        end.append(b)
        left.append(-1)
        right.append(-1)
        sums.append(x[order[a:b]].sum(axis=0, dtype=np.int64))
        away = ((own - sums[-1] / (b - a)) ** 2).sum(axis=1)
        radius.append(np.sqrt(away.max()))
        return len(begin) - 1

    todo = [add(0, len(x))]
    while todo:
        k = todo.pop()
        a, b = begin[k], end[k]
        if b - a <= LEAF_ROWS or radius[k] == 0:
            continue
        own = points[order[a:b]]
        one = own[((own - sums[k] / (b - a)) ** 2).sum(axis=1).argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        along = own @ (other - one)
        side = along > (one + other) @ (other - one) / 2
        least, n = max((b - a) // 10, 1), int(side.sum())
        if not least <= n <= b - a - least:  # far from even: halves
            side = np.zeros(b - a, bool)
            side[np.argpartition(along, (b - a) // 2)[(b - a) // 2 :]] = True
        order[a:b] = np.r_[order[a:b][~side], order[a:b][side]]
        middle = b - int(side.sum())
        left[k], right[k] = add(a, middle), add(middle, b)
        todo += [left[k], right[k]]
    as_int = lambda v: np.array(v, np.int32)
    return Tree(x[order], as_int(begin), as_int(end), as_int(left), as_int(right), np.array(radius), np.array(sums)), order


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, by exact squared distance; ties: the first."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    else:
        x = x.astype(np.int64)
    return ((centroids * centroids).sum(axis=1) - 2 * (x @ centroids.T)).argmin(axis=1)


def assign(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[np.ndarray, np.ndarray]]]:
    """Balls that lie whole with one centroid, as (node, centroid), and the other rows, as (rows, centroid of each)."""
    whole, single, todo = [], [], np.zeros(1, np.int64)
    c = centroids.astype(np.float64)
    while len(todo):
        centre = tree.sums[todo] / (tree.end[todo] - tree.begin[todo])[:, None]
        away = np.sqrt(np.stack([((centre - own) ** 2).sum(axis=1) for own in c], axis=1))
        best = away.argmin(axis=1)
        near = away[np.arange(len(todo)), best]
        away[np.arange(len(todo)), best] = np.inf
        second, r = away.min(axis=1), tree.radius[todo]
        sure = near + r + _SLACK * (1 + near + r) < second - r - _SLACK * (1 + second + r) if len(c) > 1 else np.ones(len(todo), bool)
        whole += zip(todo[sure].tolist(), best[sure].tolist(), strict=True)
        rest = todo[~sure]
        leaf = tree.left[rest] < 0
        if leaf.any():
            rows = np.concatenate([np.arange(tree.begin[k], tree.end[k]) for k in rest[leaf]])
            single.append((rows, nearest(tree.x[rows], centroids)))
        rest = rest[~leaf]
        todo = np.r_[tree.left[rest], tree.right[rest]].astype(np.int64)
    return whole, single


def _plant(scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = np.floor(values * scale).astype(np.int32).reshape(-1, width)
            if len(x):
                tree, order = build(x)
                fields = (tree.x, tree.begin, tree.end, tree.left, tree.right, tree.radius, tree.sums)
                packed = [pa.array([v.tobytes()], pa.binary()) for v in fields]
                ids = pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), b.column(0).take(pa.array(order)))
                yield pa.RecordBatch.from_arrays([ids, *packed], ["ids", "x", "begin", "end", "left", "right", "radius", "sums"])

    return run


def _trees(b: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Scalar, Tree]]:
    for k in range(b.num_rows):
        raw = [b.column(c)[k].as_py() for c in range(1, 8)]
        x, begin, end, left, right = (np.frombuffer(v, np.int32) for v in raw[:5])
        yield b.column(0)[k], Tree(x.reshape(-1, width), begin, end, left, right, np.frombuffer(raw[5]), np.frombuffer(raw[6], np.int64).reshape(-1, width))


def _sums(centroids: np.ndarray):
    """A row for each centroid with vectors in the partition: their number and sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, width = centroids.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for b in batches:
            for _, tree in _trees(b, width):
                whole, single = assign(tree, centroids)
                for node, c in whole:
                    count[c] += tree.end[node] - tree.begin[node]
                    total[c] += tree.sums[node]
                for rows, own in single:
                    count += np.bincount(own, minlength=k)
                    for c in np.unique(own):
                        total[c] += tree.x[rows[own == c]].sum(axis=0, dtype=np.int64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _members(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, tree in _trees(b, centroids.shape[1]):
                whole, single = assign(tree, centroids)
                cluster = np.zeros(len(tree.x), np.int32)
                for node, c in whole:
                    cluster[tree.begin[node] : tree.end[node]] = c
                for rows, own in single:
                    cluster[rows] = own
                distance = ((tree.x.astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def starting_centroids(kept: DataFrame, k: int, scale: int) -> np.ndarray:
    """The vectors of the k smallest hashes of "1:<id>", in order."""
    q = F.transform("v", lambda x: F.floor(scale * x).cast("long"))
    named = kept.where("id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("hash"), q.alias("q"))
    rows = named.orderBy("hash", "q").limit(k).collect()
    return np.array([r.q for r in rows], np.int64)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, scale: int = 64, width: int = 64) -> DataFrame:
    """Per kept row of vectors: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid (its final components)."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    usable = F.forall(v, lambda x: x.isNotNull() & F.coalesce(F.abs(x) < LIMIT, F.lit(False)))
    kept = vectors.where((F.size(v) == width) & usable).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    centroids = starting_centroids(kept, k, scale)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    arrow_limits(spark, TREE_ROWS)
    packed = ", ".join(f"{c} binary" for c in ("x", "begin", "end", "left", "right", "radius", "sums"))
    trees = cut(kept.mapInArrow(_plant(scale, width), f"ids array<long>, {packed}"))
    arrow_limits(spark, 16)  # a row is a tree now
    for _ in range(rounds):
        sums = trees.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
        sums = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)])
        moved = centroids.copy()
        for r in sums.collect():  # k rows
            moved[r.cluster] = [int(r[f"s{i}"]) // r.n for i in range(width)]
        centroids = moved
    members = cut(trees.mapInArrow(_members(centroids), "vec_id long, cluster int, distance long"))
    spread = {r.cluster: r.d for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    inertia = int(sum(spread.values()))
    known = [(c, int(d), inertia, centroids[c].tolist()) for c, d in spread.items()]
    of_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return members.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")

