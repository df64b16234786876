"""SentencePiece encoding by batched Viterbi, and decoding.

Texts are cut where no piece can lie across (before a run of spaces, and between characters that
no piece has side by side). Distinct parts of equal length are the rows of one array and advance
together: the hashes of all their substrings are probed in the sorted keys of each length, longer ones
only where the shorter begins some piece, and what is hit is compared with the piece itself; then for
each end position one vectorised maximum over the lengths gives the best score and the backpointer
(ties: the longest last piece). Long parts are probed a block of positions at a time. Scores are the
model's; a character that is no piece costs ten below the lowest score and becomes its UTF-8 bytes.

This is the segmentation of highest total score, what the library gives for a unigram model with
these pieces and scores. For a model trained by merging (as the public file is) the library itself
merges instead, so ids can differ from it; decoding is the same and gives the text back.

Defined results: null or empty text has no ids and decodes to ''. The space symbol U+2581 in a text
is read as a space, as the format has it. Texts of any length are encoded whole. Rows that repeat an id
are encoded one by one, an empty table gives an empty result, and other columns are passed on, whatever
their names; only those named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_limits, fresh, map_whole_rows, quoted
from .pieces import SPACE, UNUSED, Model, breaks, code_points, in_slices, pre_tokens, read_model, utf8_lengths

_BASE = np.uint64(0x9E3779B97F4A7C15)
REMEMBERED = 500_000


#: Places (rows times positions) that are probed at once.
PLACES = 1 << 17


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(rows.shape[0], np.uint64)
    for j in range(rows.shape[1]):
        h = (h + rows[:, j].astype(np.uint64) + np.uint64(1)) * _BASE
    return h


class Codec:
    def __init__(self, model: Model):
        normal = model.scores[model.kinds == 1]
        self.unknown = float(normal.min()) - 10.0
        own = {p: i for p, i in model.id_of.items() if model.kinds[i] != UNUSED}
        self.longest, self.bigrams, self.byte_ids = max(map(len, own)), model.bigrams, model.byte_ids
        # For each length: hashes of all beginnings of pieces, sorted, their characters, and the piece's id or -1.
        self.keys, self.chars, self.ids, self.scores = [], [], [], []
        for n in range(1, self.longest + 1):
            begins = sorted({p[:n] for p in own if len(p) >= n})
            rows = np.array([[ord(c) for c in p] for p in begins], np.int64).reshape(-1, n)
            h = _hash(rows)
            order = np.argsort(h)
            ids = np.array([own.get(p, -1) for p in begins], np.int64)[order]
            self.keys.append(h[order])
            self.chars.append(rows[order])
            self.ids.append(ids)
            self.scores.append(np.where(ids >= 0, model.scores[ids], -np.inf))
        whole = [p.replace(SPACE, " ").encode() for p in model.pieces]
        for k in np.flatnonzero((model.kinds == 2) | (model.kinds == 3)).tolist():
            whole[k] = b""
        for b, i in enumerate(model.byte_ids.tolist()):
            whole[i] = bytes([b])
        self.lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(whole), np.uint8)

    def _probe(self, cps: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that end at a + 1 .. b, by end, length (the longest first) and row. cps: positions by rows."""
        n, low = cps.shape[1], max(0, a + 1 - self.longest)
        score = np.full((b - a, self.longest, n), -np.inf)
        token = np.full((b - a, self.longest, n), -1, np.int32)
        start = np.repeat(np.arange(low, b), n)
        row = np.tile(np.arange(n), b - low)
        hashes = np.zeros(len(start), np.uint64)
        for k in range(1, self.longest + 1):
            inside = start + k <= b
            if not inside.all():
                start, row, hashes = start[inside], row[inside], hashes[inside]
            hashes = (hashes + cps[start + k - 1, row].astype(np.uint64) + np.uint64(1)) * _BASE
            keys = self.keys[k - 1]
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == hashes)
            for j in range(k):
                hit = hit[self.chars[k - 1][at[hit], j] == cps[start[hit] + j, row[hit]]]
            start, row, hashes, at = start[hit], row[hit], hashes[hit], at[hit]
            end = start + k - 1 - a
            new = (end >= 0) & (self.ids[k - 1][at] >= 0)
            score[end[new], self.longest - k, row[new]] = self.scores[k - 1][at[new]]
            token[end[new], self.longest - k, row[new]] = self.ids[k - 1][at[new]]
            if not len(start):
                break
        strange = token[:, -1] < 0
        score[:, -1][strange] = self.unknown
        token[:, -1][strange] = -1 - cps[a:b][strange]
        return score, token

    def viterbi(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of code points, one row after the other, and how many each has; -1 - c for a character c that is no piece."""
        n, length = rows.shape
        cps = np.ascontiguousarray(rows.T)
        best = np.zeros((length + 1, n))
        back = np.zeros((length + 1, n), np.int32)
        made = np.zeros((length + 1, n), np.int32)
        each, block = np.arange(n), max(1, PLACES // n)
        for a in range(0, length, block):
            b = min(length, a + block)
            score, token = self._probe(cps, a, b)
            for end in range(a + 1, b + 1):
                m = min(self.longest, end)
                total = best[end - m : end] + score[end - a - 1, self.longest - m :]
                j = total.argmax(axis=0)  # the first of the greatest, so the longest piece
                best[end] = total[j, each]
                back[end] = end - m + j
                made[end] = token[end - a - 1, self.longest - m + j, each]
        ids = np.zeros((n, length), np.int32)
        size = np.zeros(n, np.int64)
        at, row = np.full(n, length), each
        while len(row):
            size[row] += 1
            ids[row, length - size[row]] = made[at[row], row]
            at[row] = back[at[row], row]
            row = row[at[row] > 0]
        return ids[np.arange(length) >= length - size[:, None]], size

    def _as_bytes(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids and sizes of rows, with the ids of a character's UTF-8 bytes for each that is no piece."""
        strange = ids < 0
        if not strange.any():
            return ids, size
        raw = "".join(map(chr, (-1 - ids[strange]).tolist())).encode("utf-8", "surrogatepass")
        times = np.ones(len(ids), np.int64)
        times[strange] = utf8_lengths(-1 - ids[strange])
        out = np.repeat(ids, times)
        out[np.repeat(strange, times)] = self.byte_ids[np.frombuffer(raw, np.uint8)]
        return out, np.add.reduceat(times, np.cumsum(size) - size)

    def encode_tokens(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token, as little-endian 32-bit numbers."""
        cps, owner = code_points(tokens)
        start = np.flatnonzero(breaks(cps, owner, self.bigrams))
        sizes = np.diff(np.r_[start, len(cps)])
        parts: list[bytes] = [b""] * len(start)
        for length in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == length)
            step = max(1, PLACES // length)
            for a in range(0, len(own), step):
                some = own[a : a + step]
                rows = cps[start[some][:, None] + np.arange(length)]
                ids, size = self._as_bytes(*self.viterbi(rows))
                raw, ends = ids.astype("<i4").tobytes(), np.cumsum(size) * 4
                for k, x, y in zip(some.tolist(), (ends - size * 4).tolist(), ends.tolist(), strict=True):
                    parts[k] = raw[x:y]
        ends = np.searchsorted(owner[start], np.arange(len(tokens) + 1))
        return [b"".join(parts[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode_bytes(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 text of each sequence of ids, without the dummy prefix."""
        every = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        sizes = self.lengths[every]
        ends = np.cumsum(sizes)
        whole = self.flat[np.arange(sizes.sum()) + np.repeat(self.begins[every] - (ends - sizes), sizes)].tobytes()
        cut = np.r_[0, ends][np.cumsum([0, *map(len, ids)])].tolist()
        return [whole[a:b].removeprefix(b" ") for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes([np.asarray(ids, np.int64)])[0].decode("utf-8", "replace")


class Encoder:
    """Encodes texts, remembering the ids of pre-tokens."""

    def __init__(self, codec: Codec):
        self.codec, self.known = codec, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        pre = [pre_tokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in set().union(*pre) if w not in self.known]
        if new:
            self.known.update(zip(new, self.codec.encode_tokens(new), strict=True))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, p)), "<i4") for p in pre]


def _encode(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        encoder = Encoder(shared.value)
        for b in batches:
            k = 0
            for texts in in_slices([t or "" for t in b.column(text_at).to_pylist()]):
                ids = encoder(texts)
                trip = [x == t.replace(SPACE, " ").encode() for x, t in zip(encoder.codec.decode_bytes(ids), texts, strict=True)]
                lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids) if ids else np.zeros(0, np.int32))
                yield [*b.slice(k, len(texts)).columns, lists, pa.array([len(x) for x in ids], pa.int64()), pa.array(trip, pa.bool_())]
                k += len(texts)

    return run


def encode_column(docs: DataFrame, text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip (the ids decode to the text); columns of these names are replaced."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(Codec(read_model(model_path)))  # as large as the vocabulary
    text = fresh(docs, "text_of")
    d = docs.withColumn(text, F.coalesce(F.col(quoted(text_col)), F.lit(""))).drop("token_ids", "n_tokens", "round_trip")
    added = [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return map_whole_rows(d, _encode(shared, d.columns.index(text)), added).drop(text)


def decode_column(df: DataFrame, ids_col: str = "token_ids", model_path: str | None = None) -> DataFrame:
    """df with decoded, the text of each row's ids; null ids decode to ''."""
    spark = df.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(Codec(read_model(model_path)))
    d = df if ids_col == "decoded" else df.drop("decoded")
    at = d.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        codec = shared.value
        for b in batches:
            texts = codec.decode_bytes([np.array(x or [], np.int64) for x in b.column(at).to_pylist()])
            yield [*b.columns, pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())]

    return map_whole_rows(d, run, [T.StructField("decoded", T.StringType())])
