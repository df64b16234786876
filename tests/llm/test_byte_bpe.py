"""Ids against the library's own, decoding as the exact way back, runs and long words, and the map of frequent words that changes nothing."""

import base64
import random
import string

import pytest
import tiktoken

from tracelode.llm import byte_bpe

RNG = random.Random(7)


def _library(vocabulary):
    ranks = {p: i for i, p in enumerate(vocabulary.pieces)}
    return tiktoken.Encoding("own", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})


def _texts():
    any_of = lambda signs, n: "".join(RNG.choice(signs) for _ in range(n))
    texts = [None, "", " ", "  lead", "tail  ", "a\n\n b\r\n\tc", "don't we'll I'D", "\x00\x00\x7f", "😀" * 40, "漢字仮名交じり文" * 30, "<|endoftext|>", " x\x85y\xa0z　", "é" * 200]
    texts += [any_of(string.ascii_letters, n) for n in (3, 63, 64, 65, 400)] + [any_of("ab", n) for n in (7, 64, 300)] + [any_of("the ", n) for n in (50, 400)]
    texts += ["".join(chr(RNG.choice((RNG.randrange(32, 127), RNG.randrange(160, 0x2000), RNG.randrange(0x1F300, 0x1F700), 10, 32))) for _ in range(60)) for _ in range(40)]
    # Words of one pre-token that overlap in every way.
    texts += ["x" * n for n in (1, 2, 3, 63, 64, 65, 1000)] + [" " * n for n in (1, 2, 65, 777)] + ["ha" * 500 + "h", "=-" * 300, "aab" * 200, "abcabcab" * 60, "x" * 100_000 + "y", "\n" * 5000]
    return texts


@pytest.mark.parametrize("cached", [0, 50, 1000])
def test_ids_equal_the_library(spark, cached, monkeypatch):
    monkeypatch.setattr(byte_bpe, "DIRECT_WORDS", 20)
    vocabulary, texts = byte_bpe.read_ranks(), _texts()
    library = _library(vocabulary)
    rows = [(i, t, "w", 1) for i, t in enumerate(texts)] + [(3, texts[3], "w", 1), (None, "null id", "w", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, w int")
    got = byte_bpe.decode_ids(byte_bpe.encode_texts(d, most=cached, vocabulary=vocabulary)).collect()
    assert len(got) == len(rows)
    text_of = dict(enumerate(texts)) | {None: "null id"}
    for r in got:
        t = text_of[r.id] or ""
        assert (r.token_ids, bytes(r.decoded)) == (library.encode_ordinary(t), t.encode()), t[:50]


def test_other_vocabularies(spark, tmp_path):
    import public_tokenizers

    vocabulary = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = ["Übergröße naïve", "один два три", "x = y + 1", "word " * 30]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.token_ids for r in byte_bpe.encode_texts(d, vocabulary=vocabulary).orderBy("id").collect()] == [_library(vocabulary).encode_ordinary(t) for t in texts]
    # A vocabulary whose piece 'abc' no merge makes, with equal bytes by two ways ('aaa') and a longer piece of lower rank than its part.
    pieces = [bytes([b]) for b in range(256)] + [b"aaa", b"aa", b"abc", b"xyz", b"yz", b" a", b" aa", b"aaaa"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(pieces)))
    vocabulary = byte_bpe.read_ranks(str(path))
    assert set(vocabulary.unreachable()) == {"abc"}
    rng = random.Random(2)
    texts = ["abc", "abcabc", " abc", "xyz", "aaa", "a" * 500, *["".join(rng.choice("aaxyzbc ") for _ in range(rng.choice((5, 30, 200)))) for _ in range(60)]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.token_ids for r in byte_bpe.encode_texts(d, vocabulary=vocabulary).orderBy("id").collect()]
    assert got == [_library(vocabulary).encode_ordinary(t) for t in texts]


def test_empty_and_bad(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.encode_texts(none).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "id long, token_ids array<int>")
    assert [r.decoded for r in byte_bpe.decode_ids(ids).orderBy("id").collect()] == [None, b""]
    for bad in ([50256], [-1]):
        with pytest.raises(Exception, match="outside the vocabulary"):
            byte_bpe.decode_ids(spark.createDataFrame([(1, bad)], "id long, token_ids array<int>")).collect()
    with pytest.raises(ValueError, match="every byte"):
        byte_bpe.Vocabulary([b"a"], "a")


def test_tables_are_not_in_plans(spark):
    # Plans are kept by the driver as text, some for each query: what folding reads isn't spelled out there, nor copied into rows.
    d = spark.range(5).selectExpr("id AS doc_id", "concat_ws(' ', 'some words', id, reverse(sha2(cast(id AS string), 256))) AS text")
    plan = byte_bpe.decode_ids(byte_bpe.encode_texts(d))._jdf.queryExecution()
    assert len(plan.executedPlan().toString()) < 1_000_000
    rows = plan.optimizedPlan().toString().split("\n")
    held = [r for r in rows if "scalar-subquery" in r]
    assert held and not any("AS tables" in r for r in held)


def test_ranks_of_displaced_rows():
    rng = random.Random(5)
    # Rows of all sizes: some that fit nowhere between the others.
    pairs = {(a, b): rng.randrange(1 << 17) for a in range(300) for b in rng.sample(range(400), rng.choice((1, 1, 2, 30, 399)))}
    base, cells = byte_bpe.displaced(pairs, 400)
    for a in range(400):
        for b in range(400):
            at = base[a] + b
            own = cells[at] ^ a << 18 if at < len(cells) else 1 << 18
            assert (own if own < 1 << 18 else None) == pairs.get((a, b))
    assert byte_bpe.displaced({}, 3)[0].tolist() == [0, 0, 0, 0]


def test_words_with_the_signs_of_packed_entries(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "DIRECT_WORDS", 0)
    vocabulary = byte_bpe.read_ranks()
    own = byte_bpe.Vocabulary(vocabulary.pieces, r"\S+|\s+")
    texts = ["ab ab cd cd ef ef gh gh " * 3, "ab\x0264\x01cd", "ab\x02", "\x01ab\x02", "\x01", "ab\x02397\x01cd"]
    texts += [f"{a}\x02{' '.join(map(str, _library(own).encode_ordinary(a)))}\x01{b}" for a in ("ab", "cd", "ef", "gh") for b in ("ab", "cd", "ef", "gh")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.token_ids for r in byte_bpe.encode_texts(d, vocabulary=own).orderBy("id").collect()]
    assert got == [_library(own).encode_ordinary(t) for t in texts]
