"""What each of several filters removes from each part of a corpus, in every order of them, by multilinear extension.

A document's mask has a bit for each filter that it fails. Of a part only the number of documents of
each mask is needed: with x_i the share of filter i that is applied, the expected number of removed
documents is the polynomial R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i)),
linear in each x_i. It is held as a whole coefficient for each set of filters. Its value at a corner
(every x_i 0 or 1) is what that set of filters removes, so corners give survivors and removals of
every step of every order; the integral of its partial derivative along the diagonal is the Shapley value
of a filter, an exact rational, and times n! it is what the filter removes summed over all n! orders.

The filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * letters A to Z > 5 * code points;
D holds one of #$%&*|; E the same text as a row of smaller id, wherever that is. Words are maximal runs of
characters other than \\x20 and \\x09 to \\x0D. Texts are the same if their SHA-256 is.

No text leaves the task that reads it: a row is its id, digest, part and mask. What copies have in common
is aggregated before any shuffle, and the first row of each text is met by (digest, id), a key that no group
of copies makes hot; rows of one id are summed by part and mask before they meet their labels.

Defined results: null text is empty, null part is the empty string. A row with a null id has no labels and is
no copy, nor is anything a copy of it. Rows that repeat an id are judged one by one and aren't copies of each
other. Of several labels of an id one of 1 is enough; null labels are none. Texts of any length are read whole.
A part has n! * n rows, zeros included; an empty table gives an empty result. Only the named columns are
read, whatever others are called.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, cut

FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_fails(text: Column, words: Column) -> list[Column]:
    """Whether a text fails each of A to D."""
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n < 50, 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n, 100 * capitals > 5 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]")]


def failed_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask (bit k: fails the k-th filter), n, good, toxic: how many documents, and how many of them have these labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_fails(F.col("text"), F.col("words")))]
    d = d.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))
    d = cut(d.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("k")))
    first = d.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << (len(FILTERS) - 1)).otherwise(0)
    d = d.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + copy).alias("mask"), "k")
    d = cut(d.groupBy("id", "part", "mask").agg(F.sum("k").alias("k")))
    marked = labels.select(F.col(id_col).alias("id"), *[(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int").alias(n) for c, n in ((good, "good"), (toxic, "toxic"))])
    marked = marked.where("id is not null and (good = 1 or toxic = 1)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    none = F.lit(0).cast("long")
    every = d.select("part", "mask", F.col("k").alias("n"), none.alias("good"), none.alias("toxic"))
    # An inner join, so that rows without an id don't meet in one task.
    lost = d.join(marked, "id").select("part", "mask", none.alias("n"), (F.col("k") * F.col("good")).alias("good"), (F.col("k") * F.col("toxic")).alias("toxic"))
    return every.union(lost).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def removal_polynomial(counts: list[int]) -> list[int]:
    """The coefficient of each product of shares (a set of filters) in the polynomial of removed documents; counts by mask."""
    over = list(counts)
    for bit in _bits(len(over)):
        over = [v + (over[m | bit] if not m & bit else 0) for m, v in enumerate(over)]
    return [0 if not m else v if m.bit_count() % 2 else -v for m, v in enumerate(over)]


def corners(polynomial: list[int]) -> list[int]:
    """The polynomial where the filters of each mask are applied and no others: how many documents they remove."""
    out = list(polynomial)
    for bit in _bits(len(out)):
        out = [v + (out[m ^ bit] if m & bit else 0) for m, v in enumerate(out)]
    return out


def shapley(polynomial: list[int], bit: int) -> Fraction:
    """The partial derivative by the filter of that bit, integrated over equal shares from 0 to 1."""
    return sum((Fraction(a, m.bit_count()) for m, a in enumerate(polynomial) if m & bit), Fraction(0))


def _bits(size: int) -> list[int]:
    return [1 << k for k in range(size.bit_length() - 1)]


def part_rows(masks: list[dict], filters: str = FILTERS) -> Iterator[tuple]:
    """(order, step, then _COUNTS) for every step of every order of the filters."""
    n, full = len(filters), (1 << len(filters)) - 1
    counts = {c: [0] * (full + 1) for c in ("n", "good", "toxic")}
    for m in masks:
        for c, own in counts.items():
            own[m["mask"]] += m[c]
    total, polynomial = sum(counts["n"]), removal_polynomial(counts["n"])
    gone, good, toxic = (corners(removal_polynomial(counts[c])) for c in ("n", "good", "toxic"))
    values = [shapley(polynomial, bit) * math.factorial(n) for bit in _bits(full + 1)]
    for order in itertools.permutations(range(n)):
        name, before = "".join(filters[k] for k in order), 0
        for step, k in enumerate(order, 1):
            bit = 1 << k
            after = before | bit
            removed = gone[after] - gone[before]
            yield name, step, total - gone[after], removed, gone[bit] - removed, gone[full] - gone[full ^ bit], good[after] - good[before], toxic[after] - toxic[before], int(values[k])
            before = after


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["part", "filter_order", "step", *_COUNTS]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(_COUNTS)]
    for b in batches:
        for part, masks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            rows = list(part_rows(masks))
            columns = [[part] * len(rows), *zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def audit(masks: DataFrame) -> DataFrame:
    """part, filter_order, step and counts of every step of every order; masks: part, mask, n, good, toxic."""
    arrow_limits(masks.sparkSession)
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # a row for each mask at most
    return parts.mapInArrow(_audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed, redundant, failed alone and lost, and the filter's Shapley value times n!."""
    return audit(failed_masks(docs, labels, id_col, text_col, part_col))
