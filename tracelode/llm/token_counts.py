"""Token counts of byte-pair encoding by rank-synchronous array merging.

The distinct pre-tokens of a batch are one ragged array of symbols, linked to their neighbours. In
every step each sequence takes its pair of lowest rank and merges its occurrences from the left, all
sequences at once: an occurrence that overlaps the one before is no pair any more, and after one that
makes a new pair of a rank no higher the sequence waits for the next step, so the order is that of
merging one by one. Runs of spaces, whose pieces share one rank, are sequences of a block each. Only the pairs that a merge touched are looked up again, and what is merged or
done is dropped from the arrays when it is half of them. The surviving symbols are counted, a
character outside the vocabulary as its UTF-8 bytes.

Defined results: null text is empty and has 0 bytes and tokens. Texts of any length are counted
whole, by this one path. Of equal ranks the leftmost pair is merged first. Rows that repeat an id are
counted one by one, an empty table gives an empty result, and columns other than the named ones are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits
from .pieces import SPACE, Model, breaks, code_points, in_slices, pre_tokens, read_model, utf8_lengths

#: Pre-tokens whose counts a task remembers.
REMEMBERED = 1_000_000
_NONE = np.iinfo(np.int64).max


class MergeTable:
    """Ranks and results of all pairs of pieces that make a piece."""

    def __init__(self, model: Model):
        if not model.merges:
            raise ValueError("the library doesn't merge with this model")
        usable = model.id_of
        score = np.unique(-model.scores, return_inverse=True)[1]
        pairs = {}
        for p, i in usable.items():
            for k in range(1, len(p)):
                a, b = usable.get(p[:k]), usable.get(p[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (score[i], i)
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        single = {ord(p): i for p, i in usable.items() if len(p) == 1}
        self.chars = np.array(sorted(single), np.int64)
        self.char_ids = np.array([single[c] for c in self.chars.tolist()], np.int64)
        self.bigrams = model.bigrams
        self.block = self._space_block(model)

    def _space_block(self, model: Model) -> int:
        """How many spaces of a long run are merged before the next ones are, and with nothing else; 0 if that can't be told.

        Pieces of spaces alone share one rank, so a run is merged from its left, until a piece can't grow.
        """
        runs = {len(p): model.scores[i] for p, i in model.id_of.items() if set(p) == {SPACE}}
        others = max((len(p) - len(p.lstrip(SPACE)) for p in model.id_of if set(p) != {SPACE}), default=0)
        longest = max(runs, default=0)
        if longest < 2 or others > 1 or len({s for k, s in runs.items() if k > 1}) > 1:
            return 0
        run = [1] * (3 * longest)
        while (at := next((k for k in range(len(run) - 1) if run[k] + run[k + 1] in runs), None)) is not None:
            run[at : at + 2] = [run[at] + run[at + 1]]
        return longest if run[:2] == [longest, longest] else 0

    def cuts(self, cps: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Where a sequence begins: where no piece can lie across, and at each whole block of a run of spaces, which leads its pre-token."""
        first = breaks(cps, owner, self.bigrams)
        if self.block and len(cps):
            fresh = np.r_[True, owner[1:] != owner[:-1]]
            space = cps == ord(SPACE)
            begin = np.flatnonzero(fresh | ~space)
            place = np.arange(len(cps)) - np.repeat(begin, np.diff(np.r_[begin, len(cps)]))
            first |= space & (place % self.block == 0)
        return first

    def symbols(self, cps: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chars, cps), len(self.chars) - 1)
        return np.where(self.chars[at] == cps, self.char_ids[at], -1)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = (self.keys[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(found, self.ranks[at], _NONE), self.made[at]


class _Sequences:
    """Ragged symbols of sequences: each with its neighbours, and rank and result of the pair that it begins."""

    def __init__(self, sym: np.ndarray, first: np.ndarray, table: MergeTable):
        n = len(sym)
        self.table, self.sym, self.start = table, sym, np.flatnonzero(first)
        self.before, self.after = np.arange(-1, n - 1), np.arange(1, n + 1)
        self.before[self.start] = -1
        self.after[np.r_[self.start[1:], n] - 1] = -1
        self.rank, self.made = self.pairs(sym, np.where(self.after >= 0, sym[self.after], -1))
        self.alive = np.ones(n, bool)
        self.merged = 0

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.table.look_up(left, right)

    def step(self) -> np.ndarray:
        """Merge once in each sequence; the symbols that went away. Empty: nothing is left to merge."""
        low = np.minimum.reduceat(self.rank, self.start)
        sizes = np.diff(np.r_[self.start, len(self.sym)])
        at = np.flatnonzero(self.rank == np.repeat(np.where(low == _NONE, -1, low), sizes))
        if not len(at):
            return at
        # Of pairs that overlap one after the other, each second one stays.
        run = np.flatnonzero(np.r_[True, self.after[at[:-1]] != at[1:]])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[place % 2 == 0]
        gone, made, rank = self.after[at], self.made[at], self.rank[at]
        left, right = self.before[at], self.after[gone]
        # The neighbours as they are when the pairs before are merged and those behind are not.
        joined = np.r_[False, left[1:] == gone[:-1]]
        left_sym = np.where(joined, np.r_[-1, made[:-1]], np.where(left >= 0, self.sym[left], -1))
        left_rank, left_made = self.pairs(left_sym, made)
        right_rank, right_made = self.pairs(made, np.where(right >= 0, self.sym[right], -1))
        bad = (left_rank <= rank) | (right_rank <= rank)
        if bad.any():
            seq = np.searchsorted(self.start, at, "right")
            seen = np.cumsum(bad) - bad
            first = np.r_[True, seq[1:] != seq[:-1]]
            keep = seen == np.repeat(seen[first], np.diff(np.r_[np.flatnonzero(first), len(at)]))
            at, gone, made, right, left_rank, left_made, right_rank, right_made = (x[keep] for x in (at, gone, made, right, left_rank, left_made, right_rank, right_made))
        self.sym[at], self.after[at] = made, right
        self.before[right[right >= 0]] = at[right >= 0]
        self.rank[gone], self.alive[gone] = _NONE, False
        self.rank[at], self.made[at] = right_rank, right_made
        left = self.before[at]
        own = left >= 0
        self.rank[left[own]], self.made[left[own]] = left_rank[own], left_made[own]
        self.merged += len(at)
        return gone

    def compact(self) -> np.ndarray | None:
        """Drop merged symbols and finished sequences if they are half of all; the places that stay."""
        sizes = np.diff(np.r_[self.start, len(self.sym)])
        done = np.minimum.reduceat(self.rank, self.start) == _NONE
        if self.merged + sizes[done].sum() < len(self.sym) / 2:
            return None
        stay = np.flatnonzero(self.alive & np.repeat(~done, sizes))
        place = np.cumsum(self.alive & np.repeat(~done, sizes)) - 1
        self.before, self.after = (np.where(x[stay] >= 0, place[x[stay]], -1) for x in (self.before, self.after))
        self.sym, self.rank, self.made = self.sym[stay], self.rank[stay], self.made[stay]
        self.start, self.alive, self.merged = np.flatnonzero(self.before < 0), np.ones(len(stay), bool), 0
        return stay


def count_tokens(tokens: list[str], table: MergeTable) -> np.ndarray:
    """Number of tokens of each pre-token."""
    if not tokens:
        return np.zeros(0, np.int64)
    cps, owner = code_points(tokens)
    sym = table.symbols(cps)
    out = np.bincount(owner, np.where(sym < 0, utf8_lengths(cps), 1), len(tokens)).astype(np.int64)
    seqs = _Sequences(sym, table.cuts(cps, owner), table)
    while len(gone := seqs.step()):
        out -= np.bincount(owner[gone], minlength=len(tokens))
        stay = seqs.compact()
        if stay is not None:
            owner = owner[stay]
            if not len(stay):
                break
    return out


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = shared.value, {}
        for b in batches:
            counts: list[int] = []
            for texts in in_slices([t or "" for t in b.column(1).to_pylist()]):
                pre = [pre_tokens(t) for t in texts]
                if len(known) > REMEMBERED:
                    known.clear()
                new = [w for w in set().union(*pre) if w not in known]
                known.update(zip(new, count_tokens(new, table).tolist(), strict=True))
                counts.extend(sum(map(known.__getitem__, p)) for p in pre)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """Per row of docs: id, n_bytes, n_tokens, over_limit."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(MergeTable(read_model(model_path)))  # as large as the vocabulary
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return d.mapInArrow(_counter(shared), "id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
