"""Benchmark decontamination by winnowing, in DataFrame functions only.

A text is a sequence of words; its k-grams (k = 5) are hashed and, of every ``w = window - k + 1``
consecutive k-grams, the one with the least hash is kept. A span of ``window`` words that a
document shares with a benchmark item holds one such run of k-grams whole, and both sides keep
the same member of it (ties: the leftmost), so their kept fingerprints meet. A met fingerprint is
then extended to the up to w windows of ``window`` words that enclose it, and each of these is
looked up among the benchmark's windows. Items of fewer words are one window of their own length;
for them every n-gram of that length of every document is looked up.

A table of bits of the benchmark's fingerprints, of bounded size, sorts out nearly all fingerprints of
documents before anything is built for them; it lets every true one pass. Document rows never leave
their task before they are aggregated as long as the benchmark's fingerprints and windows (hashes alone)
are few enough to be broadcast (the count is checked); beyond that the joins shuffle. Windows that lie in
the same items have one number for that set of items; a document keeps the numbers, and the items are
joined once for each of them. Windows are compared by 64-bit hashes, on top of the fingerprint's own 64 bits.

Defined results: null or empty text, or text without words, has no words, no hits and is not
contaminated; an item without words matches nothing; a null item_id takes part in hits but not in
n_items and items_sha256. Texts of any length are read whole. Of equal hashes in a run the leftmost is
kept, on both sides. Rows that repeat an id are judged one by one; item rows that repeat an id are one
item. An empty benchmark hits nothing. Columns other than the named ones are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, hot_keys, small, split_join

#: Characters that separate words, after lower-casing A-Z.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
KGRAM = 5
#: Benchmark fingerprints and windows (about 40 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Longs of the table of bits, at least and at most: 128 KB and 2 MB. It has 16 bits for each fingerprint up to a million of them.
BIT_WORDS, MOST_BIT_WORDS = 1 << 14, 1 << 18
#: Items in all sets of items that are broadcast; more are joined by a shuffle.
BROADCAST_ITEMS = 1_000_000
_POS = (1 << 31) - 1


def words(text: str | Column) -> Column:
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.filter(F.split(ascii_lower(c), SEPARATORS), lambda w: w != "")


def _lesser(col: str, step: int):
    return lambda x, i: F.least(x, F.get(F.col(col), i + step))


def _bit_table(marks: DataFrame) -> tuple[Column, int]:
    """An array of longs with a bit for each fingerprint, and its number of longs."""
    size = min(max(1 << (marks.count() // 4).bit_length(), BIT_WORDS), MOST_BIT_WORDS)
    place = F.pmod("fp", F.lit(64 * size))
    word = marks.select(F.shiftright(place, 6).alias("k"), F.expr(f"shiftleft(1L, cast(pmod(fp, {64 * size}) & 63 AS int))").alias("bit"))
    got = word.groupBy("k").agg(F.bit_or("bit").alias("bits")).toArrow()  # MOST_BIT_WORDS rows at most, as batches of numbers
    found = np.zeros(size, np.int64)
    found[got["k"].to_numpy()] = got["bits"].to_numpy()
    return F.split(F.lit(",".join(map(str, found.tolist()))), ",").cast("array<bigint>"), size


def _may_meet(bits: tuple[Column, int], fp: Column) -> Column:
    table, size = bits
    place = F.pmod(fp, F.lit(64 * size))
    bit = F.call_function("shiftright", F.get(table, F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int"))
    return bit.bitwiseAND(F.lit(1)) != 0


def _short_marks(n: int, table: tuple[Column, int]) -> Column:
    absent = F.lit(None).cast("array<bigint>").alias("ctx")
    every = F.transform(_short_windows(n), lambda x, i: F.struct(F.lit(n).alias("len"), x.alias("fp"), i.alias("at"), absent))
    return F.filter(every, lambda x: _may_meet(table, x["fp"]))


def _hashed(df: DataFrame, window: int) -> DataFrame:
    """df with column words, plus wh (a hash a word), h (a hash a k-gram) and kept (positions that winnowing keeps)."""
    w = window - KGRAM + 1
    df = df.withColumn("wh", F.transform("words", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("words"))
    at = lambda name, i: F.get(F.col(name), i)
    grams = F.slice("wh", F.lit(1), F.greatest(F.col("n_words") - KGRAM + 1, F.lit(0)))
    df = df.withColumn("h", F.transform(grams, lambda x, i: F.xxhash64(x, *[at("wh", i + j) for j in range(1, KGRAM)])))
    # The high bits order, the low ones are the position, so a minimum says where it lies.
    df = df.withColumn("v", F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~_POS)).bitwiseOR(i.cast("long"))))
    span, col = 1, "v"
    while span < w:
        step = min(span, w - span)
        nxt = f"m{span + step}"
        rest = F.slice(col, F.lit(1), F.greatest(F.size(col) - step, F.lit(0)))
        df = df.withColumn(nxt, F.transform(rest, _lesser(col, step)))
        span, col = span + step, nxt
    return df.withColumn("kept", F.transform(F.array_distinct(col), lambda m: m.bitwiseAND(F.lit(_POS)).cast("int")))


def _long_window(h: Column, i: Column, window: int) -> Column:
    """Hash of the window that begins at k-gram i: of k-grams that together cover its words."""
    last = window - KGRAM
    steps = sorted({*range(0, last, KGRAM - 1), last})
    return F.xxhash64(*[F.get(h, i + s) for s in steps])


def _short_windows(n: int) -> Column:
    starts = F.slice("wh", F.lit(1), F.greatest(F.col("n_words") - n + 1, F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(F.slice(F.col("wh"), i + 1, F.lit(n))))


def contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    share: int = 20,
) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items (sorted as strings), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    w = window - KGRAM + 1
    b = _hashed(bench.select(F.col(item_col).alias("item"), words(item_text).alias("words")), window)
    lengths = sorted(r[0] for r in b.where(f"n_words between 1 and {window - 1}").select("n_words").distinct().collect())
    starts = F.slice("h", F.lit(1), F.greatest(F.size("h") - (window - KGRAM), F.lit(0)))
    whole = F.transform(starts, lambda x, i: _long_window(F.col("h"), i, window))
    marks = [
        b.select(F.lit(window).alias("len"), F.explode(F.transform("kept", lambda p: F.get(F.col("h"), p))).alias("fp")),
        b.where(f"n_words between 1 and {window - 1}").select(F.col("n_words").alias("len"), F.xxhash64("wh").alias("fp")),
    ]
    marks = marks[0].union(marks[1]).distinct().withColumn("met", F.lit(True))
    spans = b.select("item", F.lit(window).alias("len"), F.explode(whole).alias("hash")).union(
        b.where(f"n_words between 1 and {window - 1}").select("item", F.col("n_words").alias("len"), F.xxhash64("wh").alias("hash"))
    )
    # The items of one window are as many as the benchmark has, at most; windows with the same items share a number.
    spans = spans.groupBy("len", "hash").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("items_no", F.xxhash64(F.size("items"), "items"))
    spans = cut(spans)
    sets = spans.groupBy("items_no").agg(F.first("items").alias("items"))
    spans = spans.select("len", "hash", "items_no")
    # Each fingerprint stands for a few windows, so one check bounds both tables.
    near = (lambda t: F.broadcast(t)) if small(spans, BROADCAST_ROWS) else (lambda t: t)
    few = (sets.agg(F.sum(F.size("items") + 1)).first()[0] or 0) <= BROADCAST_ITEMS
    table = _bit_table(marks)

    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(text_col).alias("words"))
    d = _hashed(d, window)
    around = F.transform(
        F.filter("kept", lambda p: _may_meet(table, F.get(F.col("h"), p))),
        lambda p: F.struct(
            F.lit(window).alias("len"),
            F.get(F.col("h"), p).alias("fp"),
            F.greatest(p - (w - 1), F.lit(0)).alias("at"),
            F.slice(F.col("h"), F.greatest(p - (w - 1), F.lit(0)) + 1, F.lit(w + window - KGRAM) + F.least(p - (w - 1), F.lit(0))).alias("ctx"),
        ),
    )
    none = F.lit(None)
    # A row of length 0 stands for the document itself and meets nothing; its key is its own, so where joins shuffle these rows are spread.
    parts = [
        F.array(F.struct(F.lit(0).alias("len"), F.col("row").alias("fp"), none.cast("int").alias("at"), none.cast("array<bigint>").alias("ctx"))),
        around,
    ]
    parts += [_short_marks(n, table) for n in lengths]
    d = d.select("row", "id", "n_words", F.inline(F.concat(*parts)))
    d = d.join(near(marks), ["len", "fp"], "left").where("len = 0 or met")
    # A met fingerprint, extended to every window that encloses it.
    enclosing = F.transform(
        F.slice("ctx", F.lit(1), F.greatest(F.size("ctx") - (window - KGRAM), F.lit(0))),
        lambda x, i: F.struct((F.col("at") + i).alias("start"), _long_window(F.col("ctx"), i, window).alias("hash")),
    )
    own = F.array(F.struct(F.col("at").alias("start"), F.col("fp").alias("hash")))
    d = d.select("row", "id", "n_words", "len", F.inline(F.when(F.col("ctx").isNotNull(), enclosing).otherwise(own)))
    d = d.join(near(spans), ["len", "hash"], "left").where("len = 0 or items_no is not null")
    d = d.groupBy("row").agg(
        F.first("id").alias("id"),
        F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("items_no").isNotNull(), F.struct("start", (F.col("start") + F.col("len")).alias("end"))))).alias("spans"),
        F.collect_set("items_no").alias("sets"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(a["end"], s["end"]).alias("end")
        ),
        lambda a: a["n"],
    )
    d = cut(d.select("row", "id", F.col("n_words").cast("long").alias("n_words"), covered.alias("n_hit"), "sets"))
    # Only documents with hits have sets; the items of each are joined once.
    hits = d.where("n_hit > 0").select("row", F.explode("sets").alias("items_no"))
    if few:
        hits = hits.join(F.broadcast(sets), "items_no")
    else:
        hits = cut(hits)
        hits = split_join(hits, sets, ["items_no"], hot_keys(hits.groupBy("items_no").agg(F.count("*").alias("k")), ["items_no"], hits.count()))
    items = hits.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    d = d.join(items, "row", "left").withColumn("items", F.coalesce("items", F.array().cast(items.schema["items"].dataType)))
    d = d.select("id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))
    return d.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that contamination() judges contaminated.

    Rows that repeat an id are dropped together if one of them is contaminated.
    """
    bad = contamination(docs, bench, id_col, text_col).where("contaminated").select(F.col("id").alias("__id")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]), "left_anti")
