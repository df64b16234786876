"""Byte-level BPE by folding ranked merges over byte arrays in Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern. A word is an array of symbols, at first its bytes,
with the rank of each pair of neighbours from a literal map (the pairs of each left symbol as a row of ranks, all rows laid
over each other in one array, so that a look-up reads two numbers). A fold takes the leftmost pair of lowest rank, merges it and looks up
the two pairs that this makes, until no pair has a rank. The frequent words of the whole corpus, counted over all of it, are
folded once each and go into further literals, of bounded size; the others are folded where they stand. So no text
leaves its task and nothing but distinct words and their counts is shuffled. These only save work: ids don't depend on them.

Literals come into the plan as results of subqueries, so they are in Spark's binary form and plans as text, which the driver keeps, don't spell them out.

A word of many bytes is first cut between bytes that stand next to each other in no piece, which no merge can cross. In a
part that is still long, all occurrences of the pair are merged in one step where that equals merging one by one: no pair
on the way may rank lower than it, and no other pair of symbols may have its rank. So runs of one character take a few steps.

Ids are decoded by concatenating the pieces that they stand for, from a literal that has each byte as a character.

Defined results: null text is empty and has no ids; null ids decode to null. Texts of any length are encoded whole; the
time for a part that is neither cut nor repetitive grows with the square of its length. Rows that repeat an id are
encoded one by one, an empty table gives an empty result, and columns other than the named ones are ignored, whatever
their names. An id outside the vocabulary raises an error when decoded. The pattern's classes are those of the JVM's Unicode.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, cut_table, drop_table, quoted

#: Frequent words whose ids are kept, at most, and bytes of each of them. Those that are very frequent are in maps, the others packed, a string for some words,
#: which takes less memory and longer to read.
CACHED_WORDS, CACHED_BYTES, DIRECT_WORDS = 1 << 20, 24, 1 << 13
#: Signs that begin an entry of packed words, and part a word from its ids; words with one of them are not packed.
_ENTRY, _IDS = "\x01", "\x02"
#: Parts pieces; no Latin-1 character.
_PIECE = "\u0100"
#: Parts of this many symbols or more are tried with all occurrences of a pair at once.
LONG = 64
_NONE = (1 << 31) - 1
#: Bits of a symbol or rank, and of a place, in a cell of the fold; a cell without a rank is _DONE or more.
_BITS, _PLACE_BITS = 18, 27
_MOST = (1 << _BITS) - 1
_REST = (1 << (_BITS + _PLACE_BITS)) - 1
_IDS_TYPE = "array<int>"
_DONE = _MOST << (_BITS + _PLACE_BITS)
#: Places that are tried for a row of ranks, and how many more where none of them fits.
_TRIES = (64, 1 << 12, 1 << 18)
#: Where the characters that stand for symbols begin, in a part that is merged all at once.
_FIRST = 0x10000


@dataclass
class Vocabulary:
    """Pieces by id, which is the rank of the merge that makes them; every single byte is one."""

    pieces: list[bytes]
    pattern: str
    id_of: dict[bytes, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.id_of = {p: i for i, p in enumerate(self.pieces)}
        if len(self.pieces) >= _MOST:
            raise ValueError(f"a vocabulary has fewer than {_MOST} pieces")
        if len(self.id_of) < len(self.pieces) or any(bytes([b]) not in self.id_of for b in range(256)):
            raise ValueError("pieces must differ, and every byte must be one")

    def pairs(self) -> dict[tuple[int, int], int]:
        """All pairs of pieces that make a piece, with its rank."""
        own = self.id_of
        return {(own[p[:k]], own[p[k:]]): i for p, i in own.items() for k in range(1, len(p)) if p[:k] in own and p[k:] in own}

    def unreachable(self) -> dict[str, list[int]]:
        """Words that are pieces but aren't made by merging: a word that is a piece is that piece."""
        return {p.decode(): [i] for p, i in self.id_of.items() if len(self._merged(p)) > 1 and _is_text(p)}

    def _merged(self, p: bytes) -> list[bytes]:
        parts = [p[k : k + 1] for k in range(len(p))]
        while len(parts) > 1:
            rank, k = min((self.id_of.get(parts[k] + parts[k + 1], _NONE), k) for k in range(len(parts) - 1))
            if rank == _NONE:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts


def _is_text(p: bytes) -> bool:
    try:
        p.decode()
    except UnicodeDecodeError:
        return False
    return True


def read_ranks(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """A file of lines 'base64 rank'; ranks are 0, 1, ... in any order. Default: the public vocabulary of 50,256 pieces and its pattern."""
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    ranks = {int(r): base64.b64decode(p) for p, r in map(bytes.split, Path(path).read_bytes().splitlines())}
    return Vocabulary([ranks[i] for i in range(len(ranks))], pattern)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it: the start and the end of an aggregation of nothing."""
    return F.aggregate(F.array().cast(_IDS_TYPE), value, lambda x, _: x, body)


def _lets(values: list[Column], body: Callable[..., Column]) -> Column:
    """body of all values, each bound by itself."""
    return body() if not values else _let(values[0], lambda x: _lets(values[1:], lambda *more: body(x, *more)))


def _joined(*arrays: Column) -> Column:
    """Arrays one after the other."""
    return F.flatten(F.array(*arrays))


def _bucket(key: Column, buckets: int) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(buckets - 1)).cast("int")


def displaced(pairs: dict[tuple[int, int], int], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of pairs as rows of their left symbols laid over each other in one array: base by symbol, and the array.

    The entry of (a, b) is at base[a] + b and holds a and the rank, so that an entry of another row is told by its a.
    """
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pairs.items():
        rows.setdefault(a, []).append((b, rank))
    size = 1 << (4 * len(pairs) + 1).bit_length()
    base, used, end, rng = np.zeros(symbols + 1, np.int64), np.zeros(size, bool), size, np.random.default_rng(0)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        b = np.array([b for b, _ in row], np.int64)
        width = int(b.max()) + 1
        tries = np.zeros(0, np.int64)
        for n in _TRIES if width < size else ():
            tries = rng.integers(0, size - width, n)
            for x in b.tolist():
                tries = tries[~used[tries + x]]
            if len(tries):
                break
        if len(tries):
            base[a] = tries[0]
            used[tries[0] + b] = True
        else:  # behind all others
            base[a], end = end, end + width
    cells = np.full(end, _MOST << _BITS, np.int64)
    for (a, b), rank in pairs.items():
        cells[base[a] + b] = a << _BITS | rank
    return base.astype(np.int32), cells


def _cell(rank: Column, rest: Column) -> Column:
    return F.shiftleft(rank, _BITS + _PLACE_BITS).bitwiseOR(rest)


def _rank_of(cell: Column) -> Column:
    return F.shiftright(cell, _BITS + _PLACE_BITS)


def _symbol(cell: Column) -> Column:
    return cell.bitwiseAND(F.lit(_MOST).cast("long")).cast("int")


class Codec:
    """Columns that encode words and decode ids by one vocabulary."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.spark, self.vocabulary = spark, vocabulary
        #: A symbol that stands before all others and is in no pair.
        self.front = len(vocabulary.pieces)

    @cached_property
    def tables(self) -> DataFrame:
        """One row with what folding reads: base and ranks of pairs, symbols of bytes, bytes that are neighbours in a piece, signs of symbols."""
        base, ranks = displaced(self.vocabulary.pairs(), self.front)
        near = np.zeros(1 << 16, np.int32)
        for p in self.vocabulary.pieces:
            own = np.frombuffer(p, np.uint8).astype(np.int32)
            near[own[:-1] << 8 | own[1:]] = 1
        signs = [chr(_FIRST + i) for i in range(self.front)]
        arrays = {"base": base, "ranks": ranks, "byte_ids": np.array([self.vocabulary.id_of[bytes([b])] for b in range(256)], np.int32), "near": near, "signs": signs}
        return self.spark.createDataFrame(pa.table({n: pa.array([x]) for n, x in arrays.items()}))

    @staticmethod
    def bound(docs: DataFrame, tables: list[DataFrame], keep: list[Column], use: Column, body: Callable[[dict[str, Column], Column], Column], name: str) -> DataFrame:
        """keep and, by that name, body of the columns of tables, of one row each, and of the column use. The tables are literals in the plan that runs, in Spark's binary form and named once.

        A subquery can't stand in a higher-order function, so it is a column at first; the optimiser puts it where that is read,
        as long as no other column of that step is read twice.
        """
        own = [f"tables{k}" for k in range(len(tables))]
        held = docs.select(*keep, use.alias("used"), *[t.select(F.struct("*")).scalar().alias(n) for t, n in zip(tables, own, strict=True)])
        names = [n for t in tables for n in t.columns]
        fields = lambda *x: _lets([v[n] for v, t in zip(x, tables, strict=True) for n in t.columns], lambda *y: body(dict(zip(names, y, strict=True)), F.col("used")))
        return held.select(*[F.col(quoted(n)) for n in held.columns[: len(keep)]], _lets([F.col(n) for n in own], fields).alias(name))

    def words(self, text: Column) -> Column:
        # (?U): white space as Unicode has it.
        return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + self.vocabulary.pattern), F.lit(0))

    def _rank(self, t: dict[str, Column], a: Column, b: Column) -> Column:
        """The rank of a pair of symbols; a null symbol makes none."""
        # What isn't of this row differs in a, so that more than a rank is left; least() passes over null.
        return F.least(F.get(t["ranks"], F.get(t["base"], a) + b).bitwiseXOR(F.shiftleft(a.cast("long"), _BITS)), F.lit(_MOST).cast("long"))

    def _cells(self, t: dict[str, Column], sym: Column) -> Column:
        """Symbols as cells: the rank of the pair that begins here, the place (from 1), the symbol, in one number; before them the front.

        The least cell is the leftmost pair of lowest rank.
        """
        cell = lambda a, i: _cell(self._rank(t, a, F.get(sym, i + 1)), F.shiftleft((i + 2).cast("long"), _BITS).bitwiseOR(a.cast("long")))
        return _joined(F.array(F.lit(_DONE | self.front).cast("long")), F.transform(sym, cell))

    def _merge_one(self, t: dict[str, Column], cells: Column, x: Column, at: Column, m: Column, behind: Callable[[Column], Column] = lambda c: c) -> Column:
        """The pair of the cell x, at place at, becomes the symbol m; behind of the cells after it."""
        left = lambda c: _cell(self._rank(t, _symbol(c), m), c.bitwiseAND(F.lit(_REST)))
        merged = _cell(self._rank(t, m, _symbol(F.get(cells, at + 1))), x.bitwiseAND(F.lit(_REST - _MOST)).bitwiseOR(m.cast("long")))
        both = F.array(_let(F.get(cells, at - 2), left), merged)
        return _joined(F.slice(cells, F.lit(1), at - 2), both, behind(F.slice(cells, at + 2, F.size(cells))))

    def _merge_all(self, t: dict[str, Column], cells: Column, at: Column, m: Column) -> Column:
        """Every occurrence of that pair, from the left, becomes the symbol m; null where merging one by one might go another way."""
        sign = lambda x: F.get(t["signs"], x)
        a, b = _symbol(F.get(cells, at - 1)), _symbol(F.get(cells, at))
        same = ~F.exists(cells, lambda x: (_rank_of(x) == m) & (_symbol(x) != a))
        # With the same left symbol and rank, the right one is the same too. The front has no sign.
        text = F.replace(F.array_join(F.transform(cells, lambda x: sign(_symbol(x))), ""), F.concat(sign(a), sign(b)), sign(m))
        merged = _let(F.transform(F.split(text, ""), lambda c: F.ascii(c) - _FIRST), lambda x: self._cells(t, x))
        allowed = same & (self._rank(t, m, a) > m)
        return F.when(allowed, _let(merged, lambda x: F.when(_rank_of(F.array_min(x)) > m, x)))

    @staticmethod
    def _symbols(cells: Column) -> Column:
        return F.transform(F.slice(cells, F.lit(2), F.size(cells)), _symbol)

    @staticmethod
    def _lowest(cells: Column, place: Callable[[Column], Column], done: Column, merge: Callable[[Column, Column, Column], Column]) -> Column:
        """merge of the least cell, its place and its rank; done if there is no pair."""
        low = lambda x: _lets([place(x), _rank_of(x).cast("int")], lambda at, m: merge(x, at, m))
        return _let(F.array_min(cells), lambda x: F.when(x >= _DONE, done).otherwise(low(x)))

    def _fold(self, t: dict[str, Column], sym: Column) -> Column:
        """The symbols that are left when no pair has a rank."""
        # Cells keep the place that they have just now: looking for a cell takes longer than telling those behind, which are few.
        place = lambda x: F.shiftright(x, _BITS).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int")
        behind = lambda c: F.transform(c, lambda x: x - F.lit(1 << _BITS))
        step = lambda cells, _: self._lowest(cells, place, cells, lambda x, at, m: self._merge_one(t, cells, x, at, m, behind))
        return F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(sym), F.lit(2))), self._cells(t, sym), step, self._symbols)

    def _fold_all(self, t: dict[str, Column], sym: Column) -> Column:
        """The same, all occurrences of a pair at once where that may be."""
        def step(s: Column, _: Column) -> Column:
            state = lambda c, done: F.struct(c.alias("cells"), F.lit(done).alias("done"))
            place = lambda c: lambda x: F.array_position(c, x).cast("int")
            merged = lambda c: self._lowest(c, place(c), state(c, True), lambda x, at, m: state(F.coalesce(self._merge_all(t, c, at, m), self._merge_one(t, c, x, at, m)), False))
            return F.when(s["done"], s).otherwise(_let(s["cells"], merged))

        # Steps by the dozens: each step that is passed over copies the cells.
        steps = F.sequence(F.lit(1), F.lit(LONG))
        start = F.struct(self._cells(t, sym).alias("cells"), F.lit(False).alias("done"))
        many = lambda s, _: F.when(s["done"], s).otherwise(F.aggregate(steps, s, step))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(sym) / LONG).cast("int")), start, many, lambda s: self._symbols(s["cells"]))

    def _fold_long(self, t: dict[str, Column], sym: Column, codes: Column) -> Column:
        """The same for many bytes: parts that no merge crosses by themselves."""
        parted = lambda i: (i == 0) | (F.get(t["near"], F.get(codes, i - 1) * 256 + F.get(codes, i)) == 0)
        places = F.filter(F.sequence(F.lit(0), F.size(sym) - 1), parted)

        def parts(p: Column) -> Column:
            end = lambda i: F.coalesce(F.get(p, i + 1), F.size(sym))
            fold = lambda x: F.when(F.size(x) < LONG, self._fold(t, x)).otherwise(self._fold_all(t, x))
            return F.flatten(F.transform(p, lambda at, i: _let(F.slice(sym, at + 1, end(i) - at), fold)))

        return _let(places, parts)

    def fold_word(self, t: dict[str, Column], word: Column) -> Column:
        """The ids of a word that isn't empty."""
        # As Latin-1 every byte is a character.
        signs = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
        symbols = lambda s: F.transform(s, lambda c: F.get(t["byte_ids"], F.ascii(c)))
        long = lambda s: _lets([symbols(s), F.transform(s, F.ascii)], lambda sym, codes: self._fold_long(t, sym, codes))
        return _let(signs, lambda s: F.when(F.size(s) < LONG, _let(symbols(s), lambda sym: self._fold(t, sym))).otherwise(long(s)))

    def _counted(self, docs: DataFrame, text_col: str, most: int) -> tuple[DataFrame, list[tuple[int, int]]]:
        """The most frequent words of docs (w, level, ids), and how many each level of frequency has, from the top."""
        spark = self.spark
        words = docs.select(F.explode(self.words(F.col(text_col))).alias("w")).where(F.octet_length("w").between(2, CACHED_BYTES))
        level = F.floor(F.log(F.col("k")) * 16).cast("int")
        counts, at = cut_table(words.groupBy("w").agg(F.count("*").alias("k")).where((F.col("k") > 1) & ~F.col("w").rlike(f"[{_ENTRY}{_IDS}]")).withColumn("level", level))
        levels, total = [], 0
        for level, n in sorted(counts.groupBy("level").agg(F.count("*")).collect(), reverse=True):  # some hundred levels
            total += n
            if total > most:
                break
            levels.append((level, total))
        least = levels[-1][0] if levels else 1 << 30
        own = counts.where(F.col("level") >= least).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "w")
        own = cut(self.bound(own, [self.tables], [F.col("w"), F.col("level")], F.col("w"), self.fold_word, "ids"))
        drop_table(spark, at)
        return own, levels

    @staticmethod
    def _dealt(entries: DataFrame, buckets: int, bucket: Callable[[Column], Column], name: str) -> DataFrame:
        """Entries (w, e) as one row with an array of what bucket makes of each bucket's sorted entries."""
        own = entries.select(_bucket(F.col("w"), buckets).alias("b"), "e")
        empty = own.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"), F.lit(None).cast(own.schema["e"].dataType).alias("e"))
        found = own.unionByName(empty).groupBy("b").agg(F.sort_array(F.collect_list("e")).alias("es"))  # nulls aren't listed
        rows = found.agg(F.sort_array(F.collect_list(F.struct("b", "es"))).alias("all"))  # CACHED_WORDS in all
        return rows.select(F.transform("all", lambda x: bucket(x["es"])).alias(name))

    def frequent(self, docs: DataFrame, text_col: str, most: int) -> dict[str, tuple[DataFrame, int]]:
        """Words with their ids, and numbers of buckets: maps of the very frequent words and of those pieces that merging doesn't make; the others packed."""
        own, levels = self._counted(docs, text_col, most)
        n, direct = max((n, level) for level, n in [*levels, (1 << 30, 0)] if n <= DIRECT_WORDS)
        apart = self.vocabulary.unreachable()
        odd = self.spark.createDataFrame(list(apart.items()), "w string, ids array<int>")
        top = own.where(F.col("level") >= direct).join(odd, "w", "left_anti").select("w", "ids").unionByName(odd)
        rest = own.where(F.col("level") < direct).select("w", F.concat(F.lit(_ENTRY), "w", F.lit(_IDS), F.array_join(F.col("ids").cast("array<string>"), " ")).alias("e"))
        buckets = 1 << ((n + len(apart)) // 3).bit_length()  # some three words each
        more = 1 << ((levels[-1][1] - n if levels else 0) // 8).bit_length()
        known = self._dealt(top.select("w", F.struct("w", "ids").alias("e")), buckets, F.map_from_entries, "known")
        packed = self._dealt(rest, more, lambda es: F.concat(F.array_join(es, ""), F.lit(_ENTRY)), "packed")
        return {"known": (known, buckets), "packed": (packed, more)}

    def encode(self, docs: DataFrame, keep: list[Column], text_col: str, most: int = CACHED_WORDS) -> DataFrame:
        """keep of docs, and token_ids, the ids of its text column."""
        found = self.frequent(docs, text_col, most)
        bucket = lambda t, n, w: F.get(t[n], _bucket(w, found[n][1]))

        def packed(t: dict[str, Column], w: Column) -> Column:
            behind = F.call_function("substring_index", bucket(t, "packed", w), F.concat(F.lit(_ENTRY), w, F.lit(_IDS)), F.lit(-1))
            # Empty: what is behind the word's entry is the bucket's beginning, as there is none. Only a word with that sign could be found across entries.
            ids = lambda x: F.when((x != "") & ~F.contains(w, F.lit(_IDS)), F.split(x, " ").cast(_IDS_TYPE))
            return _let(F.substring_index(behind, _ENTRY, 1), ids)

        of_word = lambda t, w: F.coalesce(bucket(t, "known", w)[w], packed(t, w), self.fold_word(t, w))
        ids = lambda t, text: F.flatten(F.transform(self.words(text), lambda w: of_word(t, w)))
        return self.bound(docs, [self.tables, *(rows for rows, _ in found.values())], keep, F.col(text_col), ids, "token_ids")

    def decode(self, ids: Column) -> Column:
        """The bytes that ids stand for."""
        # As Latin-1, so that pieces are strings though they needn't be whole characters. A literal: folded when the plan is optimised.
        pieces = F.split(F.lit(_PIECE.join(p.decode("latin-1") for p in self.vocabulary.pieces)), _PIECE)
        piece = lambda i: F.coalesce(F.get(pieces, i), F.raise_error(F.lit("an id outside the vocabulary")).cast("string"))
        return F.encode(F.array_join(F.transform(ids, piece), ""), "ISO-8859-1")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: Vocabulary | None = None, most: int = CACHED_WORDS) -> DataFrame:
    """Per row of docs: id, token_ids."""
    return Codec(docs.sparkSession, vocabulary or read_ranks()).encode(docs, [F.col(id_col).alias("id")], text_col, most)


def decode_ids(encoded: DataFrame, ids_col: str = "token_ids", vocabulary: Vocabulary | None = None) -> DataFrame:
    """encoded with decoded: the bytes of its ids."""
    return encoded.withColumn("decoded", Codec(encoded.sparkSession, vocabulary or read_ranks()).decode(F.col(ids_col)))
