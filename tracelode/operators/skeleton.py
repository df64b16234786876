"""The procedure that several runs of one task share: aligned steps with support, and parameters that vary together."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, python_path
from ..plans.spread import components
from .align import common_length


def alignment(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence; where either side may be skipped, a is.

    A row of the table of common lengths of the lists' ends is a whole number with a bit for each place of b: of its lowest k bits as many are
    0 as the last k of b have in common with the end of a. A row follows from the one below by a few operations on whole numbers. Some
    sqrt(len(a)) rows are kept, and those between two of them are made again when the way down passes there, so memory is that many rows.
    """
    n, full = len(a), (1 << len(b)) - 1
    where: dict = {}
    for k, x in enumerate(reversed(b)):
        where[x] = where.get(x, 0) | 1 << k

    def above(v: int, x) -> int:
        met = v & where.get(x, 0)
        return ((v + met) | (v - met)) & full

    every, row, kept = max(math.isqrt(n), 1), full, [full]
    for k in range(n):
        row = above(row, a[n - 1 - k])
        if (k + 1) % every == 0:
            kept.append(row)
    common = lambda v, low: low - (v & ((1 << low) - 1)).bit_count()
    first, rows = n + 1, []  # the rows of the ends from first items on
    i = j = 0
    pairs = []
    while i < n and j < len(b):
        if n - i - 1 < first:
            first = (n - i - 1) // every * every
            rows = [kept[first // every]]
            for k in range(first, min(first + every, n)):
                rows.append(above(rows[-1], a[n - 1 - k]))
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif common(rows[n - i - 1 - first], len(b) - j) >= common(rows[n - i - first], len(b) - j - 1):
            i += 1
        else:
            j += 1
    return pairs


def aligned_to_medoid(runs: list[list[str]]) -> tuple[int, list[list[tuple[int, int]]]]:
    """The run with the largest summed alignment to the others (ties: the first), and its alignment with each run.

    Lengths alone choose it, one for each pair; only the medoid itself is aligned.
    """
    total = [0] * len(runs)
    for i, a in enumerate(runs):
        for j, b in enumerate(runs[:i]):
            n = common_length(a, b)
            total[i] += n
            total[j] += n
    m = total.index(max(total))
    return m, [[(i, i) for i in range(len(b))] if k == m else alignment(runs[m], b) for k, b in enumerate(runs)]


def shared_steps(runs: list[list[str]], least: float = 0.6) -> list[tuple[int, str, float]]:
    """(index in the medoid, key, support) of the medoid's steps that enough runs have, itself included."""
    if not runs:
        return []
    m, aligned = aligned_to_medoid(runs)
    count = [0] * len(runs[m])
    for pairs in aligned:
        for i, _ in pairs:
            count[i] += 1
    return [(i, key, n / len(runs)) for i, (key, n) in enumerate(zip(runs[m], count, strict=True)) if n >= least * len(runs)]


def skeletons(sequences: DataFrame, family: str, run: str, keys: str, least: float = 0.6) -> DataFrame:
    """family, step, key, support for sequences of steps; a family is the few recordings of one task and one group."""
    python_path(sequences.sparkSession)

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("run")
        got = shared_steps([list(k) for k in rows["keys"]], least)
        return pd.DataFrame([(key[0], i, k, round(s, 6)) for i, k, s in got], columns=["family", "step", "key", "support"])

    d = sequences.select(F.col(family).alias("family"), F.col(run).alias("run"), F.col(keys).alias("keys"))
    return d.groupBy("family").applyInPandas(of, "family long, step long, key string, support double")


def parameter_groups(values: DataFrame, run: str, slot: str, value: str) -> DataFrame:
    """slot, parameter (the first slot of its group), variants, for slots of at least two values that vary together.

    Two slots do if over the runs that have both (two at least) their values are in bijection, and so
    do slots that others join; variants are the most of any of a slot's pairs. The number of pairs is
    that of slots squared within a run, not of runs.
    """
    a = values.select(F.col(run).alias("run"), F.col(slot).alias("a"), F.col(value).alias("x"))
    b = values.select(F.col(run).alias("run"), F.col(slot).alias("b"), F.col(value).alias("y"))
    p = a.join(b, "run").groupBy("a", "b").agg(F.count_distinct("run").alias("n"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"), F.count_distinct("x", "y").alias("nxy"))
    p = p.where((F.col("n") >= 2) & (F.col("nx") >= 2) & (F.col("nx") == F.col("ny")) & (F.col("nx") == F.col("nxy")))
    p = cut(p.select("a", "b", "nx"))
    groups = components(p, "a", "b").select(F.col("node").alias("slot"), F.col("root").alias("parameter"))
    own = p.groupBy(F.col("a").alias("slot")).agg(F.max("nx").alias("variants"))
    return own.join(groups, "slot", "left").select("slot", F.coalesce("parameter", "slot").alias("parameter"), "variants")
