"""Token counts against the library and one-by-one merging; segmentation against itself in small blocks; settings of models."""

import random

import numpy as np
import pytest

from tracelode.llm import pieces, sentencepiece_codec, token_counts


@pytest.fixture(scope="module")
def lib():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def counted(texts, table):
    pre = [pieces.pre_tokens(t) for t in texts]
    n = token_counts.count_tokens([w for p in pre for w in p], table).tolist()
    at = np.cumsum([0, *map(len, pre)]).tolist()
    return [sum(n[a:b]) for a, b in zip(at, at[1:])]


def test_long_runs_equal_the_library(lib):
    rng = random.Random(3)
    table = token_counts.MergeTable(pieces.read_model())
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    texts = ["=" * 1_000_000, " " * 1_000_000, "a" * 1_000_000, "haha" * 250_000, "日本" * 50_000, "😀" * 50_000, letters]
    assert counted(texts, table) == [len(x) for x in lib.encode(texts)]
    runs = [" " * r + w + " " * q + "x" for r in range(40) for w in ("the", "Z", "é", "=") for q in (0, 1, 15, 16, 17, 31, 32, 33, 48, 49)]
    assert counted(runs, table) == [len(x) for x in lib.encode(runs)]


@pytest.mark.parametrize("seed", range(12))
def test_any_vocabulary_is_merged_as_one_by_one(seed):
    """Here merges often make pairs of a lower rank, or of the same rank."""
    rng = random.Random(seed)
    names = ["a", "b", "c", *sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(60)})]
    rng.shuffle(names)
    scores = -np.array([k // (1 + seed % 3) for k in range(len(names))], float)
    every = [*names, *(f"<0x{b:02X}>" for b in range(256))]
    model = pieces.Model(every, np.r_[scores, np.zeros(256)], np.r_[np.ones(len(names), int), np.full(256, pieces.BYTE)], merges=True)

    def slow(word):
        own = list(word)
        while True:
            pairs = [(-scores[model.id_of[a + b]], i) for i, (a, b) in enumerate(zip(own, own[1:])) if a + b in model.id_of]
            if not pairs:
                return len(own)
            i = min(pairs)[1]
            own[i : i + 2] = [own[i] + own[i + 1]]

    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(150)]
    assert token_counts.count_tokens(words, token_counts.MergeTable(model)).tolist() == [slow(w) for w in words]


def test_blocks_of_positions_change_nothing(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("the anioré=-_ \n日") for _ in range(rng.randint(1, 400))) for _ in range(100)] + ["x" * 3000, "=" * 3000]
    codec = sentencepiece_codec.Codec(pieces.read_model())
    whole = [x.tolist() for x in sentencepiece_codec.Encoder(codec)(texts)]
    monkeypatch.setattr(sentencepiece_codec, "PLACES", 7)
    assert [x.tolist() for x in sentencepiece_codec.Encoder(codec)(texts)] == whole


def test_other_settings_are_refused(tmp_path):
    from pathlib import Path

    raw = Path(pieces.default_model()).read_bytes()
    for part, number, value in ((3, 4, b"\x01"), (3, 3, b"\x00"), (3, 2, b"\x01x"), (2, 24, b"\x01")):
        wire = 2 if number == 2 else 0
        key = number << 3 | wire
        body = (bytes([key]) if key < 128 else bytes([key & 127 | 128, key >> 7])) + value
        at = tmp_path / "m.model"
        at.write_bytes(raw + bytes([part << 3 | 2, len(body)]) + body)
        with pytest.raises(ValueError, match="isn't supported"):
            pieces.read_model(str(at))


def test_columns_of_any_name_and_repeated_rows(spark, lib):
    texts = ["a b", "a b", None, "é" * 200_000]
    d = spark.createDataFrame([(1, t, "x", "y", 5) for t in texts], "doc_id long, `te``xt` string, text_of string, ids_of string, n_tokens int")
    got = sentencepiece_codec.decode_column(sentencepiece_codec.encode_column(d, "te`xt"))
    rows = got.collect()
    assert got.columns == ["doc_id", "te`xt", "text_of", "ids_of", "token_ids", "n_tokens", "round_trip", "decoded"]
    assert [r.decoded for r in rows] == [t or "" for t in texts] and all(r.round_trip and r.text_of == "x" for r in rows) and rows[0] == rows[1]
    more = spark.createDataFrame([(1, t, 9, 9, 9) for t in texts], "doc_id long, text string, id int, n_bytes int, over_limit int")
    counts = token_counts.token_counts(more).collect()
    assert [(r.n_bytes, r.n_tokens) for r in counts] == [(len((t or "").encode()), len(lib.encode(t or ""))) for t in texts]
