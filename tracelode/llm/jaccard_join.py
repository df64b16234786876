"""N-gram Jaccard join with rare-first prefix, length, positional and suffix filters.

Sets: the distinct word n-grams of a whole lower-cased text, as 64-bit hashes. Texts with equal
sets form one class; only classes are joined. Counts of all n-grams over all texts, in a fixed
number of hashed counters, order each set rare first (ties: by hash), and a class posts the
n-grams of its prefix. Two classes can reach the threshold only if they share a posted n-gram;
of the pairs that do, one goes on if

- length: the smaller set is at least threshold times the larger;
- position: what follows the shared n-gram in both sets suffices for the overlap needed, with
  d more n-grams to spare, and d + 1 posted n-grams are shared that satisfy this (d is as large
  as both prefixes allow, 4 at most: two sets that reach the threshold always do share them);
- suffix: splitting both sets into fixed parts of the hash space, the sum of size differences
  between 8 parts, and the number of 256 parts whose sizes differ in parity, leave that overlap
  possible (both are lower bounds of the symmetric difference).

What is left is made distinct and verified once, on whole sets: a pair that the leaders' pass has
verified doesn't come up again in the later one.

Whatever holds more than a fixed part of a join's rows (an n-gram, a leader, a hub of links, a class
of copies) is dealt over several tasks, the other side's row repeated for each; there are fewer such
keys than that part's inverse, so their list is bounded. An n-gram has no more postings than its counter says, so those of
small counters are known not to be hot and are dealt once. Counters are summed by a tree of tasks.

A group of many near copies shares its n-grams, and all its pairs are links, so listing pairs
would be quadratic. For components that isn't needed: each posted n-gram names a leader (the member
in which it stands foremost), members are compared with leaders first, what these links join is
contracted, and only then are the remaining pairs of *different* components compared. That loses
no link between components; ``jaccard_links`` lists all links for those who need them.

Defined results: null text is empty; a text without words has an empty set and no link; one of
fewer than n words has its whole sequence as its only n-gram. Texts of any length are read whole. A pair
at exactly the threshold is a link. Rows that repeat an id, or have a
null id, are rows like any other; a component's name is the least id that is not null (null if all are).
What is left in the checkpoint folder is removed by lineage.clean().
An empty table gives an empty result. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spread import HOT_ROWS, HOT_SHARE, components
from .common import arrow_limits, cut, cut_table, drop_table, hot_keys, split_join

#: Hashed counters of n-grams (4 bytes each, so the broadcast is 8 MB at any size of input); a parameter. With T n-grams in all,
#: those of more than about T / COUNTERS occurrences are told from rare ones, so this bounds the rows of an n-gram in prefixes.
COUNTERS = 1 << 21
_CHUNK = 1 << 12
#: Words whose hashes a task remembers (about 170 bytes each).
KNOWN_WORDS = 300_000
#: Tasks whose counters are summed in one.
_BRANCH = 32
#: Most n-grams to spare in the positional filter.
SPARE = 4
#: Bits of the filter (by id) that keeps texts out of the verifying pass which belong to no pair; 2 MB.
FILTER_BITS = 1 << 24
#: What the suffix filter needs to know of a set: sizes of 8 parts, 4 in a number, and parities of 256.
_PARTS = ("p1", "p2")
_PARITY = ("b0", "b1", "b2", "b3")
_FIRST = "id long, n int, sig binary, p1 long, p2 long, b0 long, b1 long, b2 long, b3 long, chunk int, part int, counts binary"
_MUL = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


class _WordHashes(dict):
    """word -> 64-bit hash; starts anew when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return h


def ngram_set(text: bytes, n: int, seen: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a UTF-8 text; of fewer words, one of them all."""
    words = text.lower().split()  # bytes: A-Z only, and white space is [\x20\x09-\x0D]
    if not words:
        return np.empty(0, np.int64)
    w = np.fromiter(map(seen.__getitem__, words), np.int64, len(words)).view(np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ w[i : i + len(h)]) * np.uint64(_MUL[i % 3])
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _signature(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _first_pass(n: int, counters: int) -> Callable:
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]]) for x in _FIRST.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts, part = _WordHashes(), np.zeros(counters, np.uint32), TaskContext.get().partitionId()
        for b in batches:
            k = b.num_rows
            sizes, sigs = np.zeros(k, np.int32), []
            parts, parity = np.zeros((k, 8), np.int64), np.zeros((k, 256), np.uint8)
            for i, t in enumerate(b.column(1).to_pylist()):
                s = ngram_set(t or b"", n, seen)
                sizes[i] = len(s)
                sigs.append(_signature(s))
                np.add.at(counts, s & (counters - 1), np.uint32(1))
                parts[i] = np.bincount((s >> np.int64(61)) + 4, minlength=8)
                parity[i] = np.bincount(s & 255, minlength=256) & 1
            packed = np.bitwise_or.reduce(np.minimum(parts, 0x7FFF).reshape(k, 2, 4) << np.array([0, 16, 32, 48]), axis=2)
            bits = np.packbits(parity, axis=1).view(np.int64)
            cols = [b.column(0), sizes, sigs, *packed.T, *bits.T, [None] * k, [None] * k, [None] * k]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
        chunks = [c for c in range(counters // _CHUNK) if counts[c * _CHUNK : (c + 1) * _CHUNK].any()]
        raw = [zlib.compress(counts[c * _CHUNK : (c + 1) * _CHUNK].tobytes(), 1) for c in chunks]
        cols = [[None] * len(chunks)] * (len(schema) - 3) + [chunks, [part] * len(chunks), raw]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for b in batches:
        for c, part, raw in zip(*(x.to_pylist() for x in b.columns), strict=True):
            own = total.setdefault((c, part), np.zeros(_CHUNK, np.uint64))
            found = zlib.decompress(raw)  # of tasks 4 bytes each, of sums 8
            own += np.frombuffer(found, np.uint32 if len(found) == 4 * _CHUNK else np.uint64)
    keys, raw = list(total), [zlib.compress(x.tobytes(), 1) for x in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(raw, pa.binary())], ["chunk", "part", "counts"])


def _summed(chunks: DataFrame, counters: int) -> np.ndarray:
    """All counters, from the chunks of all tasks; no task sums those of more than _BRANCH others."""
    parts = (chunks.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // _BRANCH)
        chunks = chunks.withColumn("part", F.floor(F.col("part") / _BRANCH).cast("int"))
        chunks = chunks.repartition(F.col("chunk"), F.col("part")).mapInArrow(_sum_chunks, "chunk int, part int, counts binary")
        if parts == 1:
            break
    counts = np.zeros(counters, np.uint64)
    for r in chunks.collect():  # counters numbers, whatever the input
        counts[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] += np.frombuffer(zlib.decompress(r.counts), np.uint64)
    return np.minimum(counts, 2**32 - 1).astype(np.uint32)


def _overlap_needed(t: Fraction, a: int, b: int) -> int:
    return -(-t.numerator * (a + b) // (t.numerator + t.denominator))


def _postings(n: int, t: Fraction, counts) -> Callable:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["gram", "own", "n", "pos", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, frequency, done = _WordHashes(), counts.value, set()
        for b in batches:
            grams, owns, sizes, lengths, most = [], [], [], [], []
            for text in b.column(0).to_pylist():
                s = ngram_set(text or b"", n, seen)
                if not len(s):
                    continue
                sig = _signature(s)
                if sig in done:  # a copy in the same task posts nothing new; copies of other tasks meet below
                    continue
                if len(done) < 200_000:
                    done.add(sig)
                prefix = len(s) - (-(-t.numerator * len(s) // t.denominator)) + 1
                f = frequency[s & (len(frequency) - 1)]
                first = np.lexsort((s, f))[:prefix]
                grams.append(s[first])
                most.append(f[first])
                owns.append(xxhash.xxh64_intdigest(sig, 42))  # as xxhash64() has it
                sizes.append(len(s))
                lengths.append(prefix)
            if not owns:
                continue
            k = np.array(lengths)
            at = np.repeat(np.arange(len(k)), k)
            pos = np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)
            cols = [np.concatenate(grams), np.array(owns, np.uint64).view(np.int64)[at], np.array(sizes)[at], pos, np.concatenate(most)]
            arrays = [pa.array(c.astype(np.int64)).cast(kind) for c, kind in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _sets(n: int, bits) -> Callable:
    """Sets of the rows whose id is in the filter, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, kept = _WordHashes(), bits.value
        for b in batches:
            ids = b.column(0)
            slot = np.mod(ids.fill_null(0).to_numpy(), FILTER_BITS)
            found = (kept[slot >> 3] >> (slot & 7) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            sets = [ngram_set(t or b"", n, seen) for t in b.column(1).filter(pa.array(found)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["sig", "grams"])

    return run


def _spare(t: Fraction, x: str, y: str) -> tuple[Column, Column]:
    """The overlap that a pair needs, and how many n-grams more both prefixes hold than it takes to see one shared."""
    p, q = t.numerator, t.denominator
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    need = F.floor(((nx + ny) * p + (p + q - 1)) / F.lit(p + q))
    most = F.floor((F.greatest(nx, ny) * p + (q - 1)) / F.lit(q))
    return need, F.greatest(F.least(F.lit(SPARE), need - most), F.lit(0))


def _may_reach(t: Fraction, x: str, y: str) -> Column:
    """The three filters for a pair of postings of one n-gram."""
    p, q = t.numerator, t.denominator
    nx, ny = F.col(f"{x}.n").cast("long"), F.col(f"{y}.n").cast("long")
    need, spare = _spare(t, x, y)
    length = (nx * p <= ny * q) & (ny * p <= nx * q)
    rest = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
    apart = F.lit(0)
    for c in _PARTS:
        for shift in (0, 16, 32, 48):
            part = [F.shiftright(F.col(f"{s}.{c}"), shift).bitwiseAND(F.lit(0xFFFF)) for s in (x, y)]
            apart = apart + F.abs(part[0] - part[1])
    odd = F.lit(0)
    for c in _PARITY:
        odd = odd + F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")))
    return length & (rest + spare >= need) & (nx + ny - 2 * need >= F.greatest(apart, odd))


class _Join:
    """Classes and postings of one table."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, threshold: float, counters: int = COUNTERS):
        if counters < _CHUNK or counters & (counters - 1):
            raise ValueError(f"counters must be a power of two, {_CHUNK} at least")
        spark = self.spark = docs.sparkSession
        arrow_limits(spark)
        self.n, self.t = n, Fraction(threshold).limit_denominator(1000)
        body = F.encode(F.col(text_col), "UTF-8").alias("body")
        own = self.texts = docs.select(F.col(id_col).cast("long").alias("id"), body)
        first = cut(own.mapInArrow(_first_pass(n, counters), _FIRST))
        self.rows = first.where("chunk is null").select("id", "n", "sig")
        self.classes = cut(self.rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("id"), F.count("*").alias("k")))
        counts = _summed(first.where("chunk is not null").select("chunk", "part", "counts"), counters)
        shared = spark.sparkContext.broadcast(counts)
        posted = self.texts.select("body").mapInArrow(_postings(n, self.t, shared), "gram long, own long, n int, pos int, most long")
        posted, at = cut_table(posted)
        # An n-gram has no more rows than its counter says, so only those of large counters may be hot; all others are dealt once.
        limit = max(posted.count() // HOT_SHARE, HOT_ROWS)
        rest = self._near(posted.where(F.col("most") <= limit).drop("most").repartition("gram"))
        often, met_at = posted.where(F.col("most") > limit).drop("most"), None
        if not often.isEmpty():
            # N-grams of one class only join nothing: what is left after them is small.
            met = often.groupBy("gram").agg(F.min("own").alias("s0"), F.max("own").alias("s1"), F.count("*").alias("k")).where("s0 <> s1").select("gram", "k")
            met, met_at = cut_table(met)
            hot = hot_keys(met, ["gram"], met.agg(F.sum("k")).first()[0] or 0)
            found = split_join(often, met.drop("k"), ["gram"], hot, by=["own"]).groupBy("gram", "own").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
            if hot is None:
                rest = rest.union(self._near(found.repartition("gram")))
            else:  # hot n-grams are not sorted by size; all their rows stay
                found = found.join(F.broadcast(hot), "gram", "left")
                cool, spread = (found.where(x).drop("splits") for x in ("splits is null", "splits is not null"))
                rest = rest.union(self._near(cool.repartition("gram"))).union(spread)
        # Rows carry a hash of their class so far, which takes a third of its signature's room; should two classes have the same, both get the row.
        known = first.where("n > 0").groupBy("sig").agg(*[F.first(c).alias(c) for c in (*_PARTS, *_PARITY)])
        rest = rest.join(known.withColumn("own", F.xxhash64("sig")), "own").drop("own")
        self.posted, self.at = cut_table(rest)
        self.hot = hot_keys(self.posted.groupBy("gram").agg(F.count("*").alias("k")), ["gram"], self.posted.count())
        drop_table(spark, at)
        if met_at is not None:
            drop_table(spark, met_at)

    def _near(self, posted: DataFrame) -> DataFrame:
        """A row of each class and n-gram (none of them hot), of n-grams of several classes, if a neighbour by size passes the length filter: only such rows have any partner."""
        by_size = Window.partitionBy("gram").orderBy("n", "own")
        every = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rest = posted.withColumn("before", F.lag("own").over(by_size)).withColumn("s0", F.min("own").over(every)).withColumn("s1", F.max("own").over(every))
        rest = rest.where((F.col("s0") != F.col("s1")) & ~F.col("own").eqNullSafe(F.col("before"))).drop("before", "s0", "s1")
        rest = rest.withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
        p, q = self.t.numerator, self.t.denominator
        near = (F.col("below") * q >= F.col("n") * p) | (F.col("n") * q >= F.col("above") * p)
        return rest.where(near).drop("below", "above")

    def pairs_with_leaders(self) -> DataFrame:
        """Each class with the leader of each of its n-grams, if the filters let the pair pass."""
        lead = self.posted.groupBy("gram").agg(F.min(F.struct("pos", "sig", "n", *_PARTS, *_PARITY)).alias("y"))
        both = split_join(self.posted, lead, ["gram"], self.hot, by=["sig"]).select(F.struct("sig", "n", "pos", *_PARTS, *_PARITY).alias("x"), "y")
        both = both.where(F.col("x.sig") != F.col("y.sig")).where(_may_reach(self.t, "x", "y"))
        # A class may share its n-grams with several leaders, so two will do; the last pass is the exact one.
        return cut(self._counted(both, F.lit(2)))

    def _counted(self, both: DataFrame, most: Column) -> DataFrame:
        """The pairs of rows x, y that come up often enough: a, b."""
        spare = _spare(self.t, "x", "y")[1]
        a = F.when(F.col("x.sig") > F.col("y.sig"), F.col("x.sig")).otherwise(F.col("y.sig"))
        b = F.when(F.col("x.sig") > F.col("y.sig"), F.col("y.sig")).otherwise(F.col("x.sig"))
        seen = both.select(a.alias("a"), b.alias("b"), F.least(spare + 1, most).alias("least")).groupBy("a", "b")
        return seen.agg(F.count("*").alias("k"), F.max("least").alias("least")).where("k >= least").select("a", "b")

    def pairs_between(self, label: DataFrame | None, done: DataFrame | None = None) -> DataFrame:
        """All pairs of postings that pass the filters; with labels, only those of different components, and without the pairs in done."""
        p = self.posted
        if label is None:
            p = p.withColumn("c", F.col("sig"))
        else:
            p = p.join(label.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("c", F.coalesce("root", "sig")).drop("root")
            # An n-gram whose classes are all in one component is done.
            own = F.xxhash64("c")
            open_ = p.groupBy("gram").agg(F.min(own).alias("c0"), F.max(own).alias("c1")).where("c0 <> c1").select("gram")
            p = split_join(p, open_, ["gram"], self.hot, by=["sig"])
        p, at = cut_table(p)
        hot = hot_keys(p.groupBy("gram").agg(F.count("*").alias("k")), ["gram"], p.count())
        fields = F.struct("sig", "n", "pos", "c", *_PARTS, *_PARITY)
        both = split_join(p.select("gram", fields.alias("x")), p.select("gram", fields.alias("y")), ["gram"], hot, by=["x"])
        both = both.where((F.col("x.sig") > F.col("y.sig")) & (F.col("x.c") != F.col("y.c"))).where(_may_reach(self.t, "x", "y"))
        found = self._counted(both, F.lit(SPARE + 1))
        if done is not None:
            found = found.join(done, ["a", "b"], "left_anti")
        found = cut(found)
        drop_table(self.spark, at)
        return found

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs (already cut) those whose sets reach the threshold: a, b, overlap, n_union."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(self.classes, "sig").where("id is not null")
        slot = F.pmod("id", F.lit(FILTER_BITS))
        words = (
            ids.select(slot.alias("k"))
            .groupBy(F.shiftright("k", 5).alias("at"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 31 AS int))")).alias("bits"))
        )
        got = words.toArrow()  # at most FILTER_BITS / 32 rows, as batches of numbers: an object for each would take some 200 bytes
        flat = np.zeros(FILTER_BITS // 32, np.uint32)
        flat[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
        shared = self.spark.sparkContext.broadcast(flat.view(np.uint8))
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        sets = self.texts.mapInArrow(_sets(self.n, shared), "sig binary, grams array<bigint>").join(wanted, "sig", "left_semi")
        sets = sets.groupBy("sig").agg(F.first("grams").alias("grams"))
        total = pairs.count()
        both = pairs
        for side, name in (("a", "ga"), ("b", "gb")):  # a leader's set is repeated for the splits of its pairs
            hot = hot_keys(pairs.groupBy(side).agg(F.count("*").alias("k")), [side], total)
            both = split_join(both, sets.select(F.col("sig").alias(side), F.col("grams").alias(name)), [side], hot, by=["a", "b"])
        both = both.select("a", "b", F.size(F.array_intersect("ga", "gb")).cast("long").alias("overlap"), (F.size("ga") + F.size("gb")).cast("long").alias("n"))
        both = both.withColumn("n_union", F.col("n") - F.col("overlap"))
        return both.where(F.col("overlap") * self.t.denominator >= F.col("n_union") * self.t.numerator).drop("n")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Every link between different sets: a, b (least ids of the two classes), overlap, n_union.

    Documents with equal sets are one class; class_members() has them.
    """
    j = _Join(docs, id_col, text_col, n, threshold)
    names = j.classes.drop("k")
    links = cut(j.verified(j.pairs_between(None)))
    drop_table(j.spark, j.at)
    return (
        links.join(names.select(F.col("sig").alias("a"), F.col("id").alias("id_a")), "a")
        .join(names.select(F.col("sig").alias("b"), F.col("id").alias("id_b")), "b")
        .select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"), "overlap", "n_union")
    )


def class_members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """id, class_id (least id with the same set): the membership that goes with jaccard_links."""
    arrow_limits(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("body"))
    rows = cut(own.mapInArrow(_first_pass(n, _CHUNK), _FIRST)).where("chunk is null and n > 0")
    return rows.join(rows.groupBy("sig").agg(F.min("id").alias("class_id")), "sig").select("id", "class_id")


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, counters: int = COUNTERS
) -> DataFrame:
    """Per row of docs: id, n_shingles (size of its set), component_id (least id that links reach)."""
    j = _Join(docs, id_col, text_col, n, threshold, counters)
    pairs = j.pairs_with_leaders()
    links = cut(j.verified(pairs).select("a", "b"))
    label = cut(components(links, "a", "b"))
    rest = cut(j.verified(j.pairs_between(label, pairs)).select("a", "b"))
    drop_table(j.spark, j.at)
    if not rest.isEmpty():
        star = label.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        label = cut(components(star.union(rest), "a", "b"))
    classes = j.classes.join(label.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    names = cut(classes.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("members")).where("members > 1"))
    total = j.classes.count()
    classes = split_join(classes, names.drop("members"), ["root"], hot_keys(names, ["root"], total, "members"), "left", by=["sig"])
    classes = classes.select("sig", F.coalesce("component_id", "id").alias("component_id"))
    rows = split_join(j.rows, classes, ["sig"], hot_keys(j.classes, ["sig"], j.rows.count()), "left", by=["id"])
    return rows.select(
        "id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs, all columns, with one document of each component: that of the least id.

    Rows with a null id, and rows that repeat a kept id, stay.
    """
    keep = jaccard_components(docs, id_col, text_col, n, threshold).where("id <=> component_id or id is null").select(F.col("id").alias("__id")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__id"]), "left_semi")
