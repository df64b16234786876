"""Operators against brute force on small tables, with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracelode.llm import chat_format, decontaminate, exact_dedup, html_text, jaccard_join, pii, pieces, quality, sentencepiece_codec, token_counts, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_shingles int, keep int, words int, sig int, row int"


def rows(texts, first=0):
    return [(first + i, t, "en", "s", 0, 1, 2, 3, 4, 5) for i, t in enumerate(texts)]


def random_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 80))] for _ in range(n // 4)]
    out = [None, "", " \n", "One", "one two", "ONE TWO"]
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 5))):
            t[rng.randrange(len(t))] = rng.choice(words)
        out.append(rng.choice((" ", "\n", "  ")).join(t))
    return out + ["long " * 30000]


def sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10), (2, 1, 2)])
def test_jaccard_against_all_pairs(spark, n, num, den):
    texts = random_texts(160, n)
    data = rows(texts) + rows(texts[10:12], 10)
    own = [(r[0], sets(r[1], n)) for r in data]
    root = {i: i for i, _ in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for k, (a, x) in enumerate(own):
        for b, y in own[:k]:
            if x and y and len(x & y) * den >= num * len(x | y):
                if x != y:
                    links.add(1)
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = jaccard_join.jaccard_components(spark.createDataFrame(data, DOCS), n=n, threshold=num / den).collect()
    assert links and len(got) == len(data)
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), find(i)) for i, s in own)


def test_jaccard_links_lists_every_link(spark):
    texts = random_texts(60, 7)
    s = [sets(t, 3) for t in texts]
    least = {}
    for i, x in enumerate(s):
        least.setdefault(frozenset(x), i)
    want = {tuple(sorted((least[frozenset(x)], least[frozenset(y)]))) for x in s for y in s if x and y and x != y and len(x & y) * 10 >= 6 * len(x | y)}
    got = jaccard_join.jaccard_links(spark.createDataFrame(rows(texts), DOCS), n=3, threshold=0.6).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_components(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert token_counts.token_counts(none).count() == 0
    assert sentencepiece_codec.encode_column(none).count() == 0
    assert pii.pseudonymise(none, "k").count() == 0
    assert quality.quality_scores(none, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert chat_format.read_back(chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_main_text(pages).count() == 0
    assert warc.round_trip(pages).count() == 0


def test_exact_groups(spark):
    data = [(3, "a b"), (1, "ab"), (2, "a  b"), (2, "a  b"), (4, None), (5, " "), (None, "ab"), (6, "x")]
    got = exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string"), partitions=5).collect()
    by = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in got), key=repr)
    want = [(3, 2, 5, False), (1, 2, 5, False), (2, 2, 5, True), (2, 2, 5, False), (4, 5, 2, False), (5, 5, 2, True), (None, 2, 5, False), (6, 6, 1, True)]
    assert by == sorted(want, key=repr)
    assert {r.text_sha256 for r in got if r.id == 1} == {hashlib.sha256(b"ab").hexdigest()}
    left = exact_dedup.drop_exact_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in left) == [2, 5, 6]


def test_large_group_over_many_ranges(spark):
    data = [(i, "same text") for i in range(500)] + [(1000 + i, f"t{i}") for i in range(50)]
    got = exact_dedup.exact_groups(spark.createDataFrame(data, "doc_id long, text string"), partitions=16).where("group_size > 1").collect()
    assert len(got) == 500 and {r.keep_id for r in got} == {0} and {r.group_size for r in got} == {500} and [r.id for r in got if r.kept] == [0]


def _words(t):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))) if w]


def test_contamination_against_brute_force(spark):
    rng = random.Random(4)
    v = [f"v{k}" for k in range(9)]
    make = lambda n: [rng.choice(v) for _ in range(n)]
    items = [make(rng.choice((1, 4, 12, 13, 14, 30))) for _ in range(12)] + [[], ["É"], ["a"] * 40]
    docs = [None, "", "!!", "É x", " ".join(["a"] * 60)]
    for _ in range(60):
        t = make(rng.randint(0, 60))
        if rng.random() < 0.6:
            k = rng.choice(items)
            a = rng.randint(0, max(0, len(k) - 13))
            t[5:5] = k[a : a + rng.choice((12, 13, 20, 40))]
        docs.append(", ".join(t).upper() if rng.random() < 0.3 else " ".join(t))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.id: r for r in decontaminate.contamination(spark.createDataFrame(rows(docs), DOCS), bench).collect()}
    for i, t in enumerate(docs):
        w, hit, found = _words(t), set(), set()
        for k, item in enumerate(items):
            own = _words(" ".join(item))
            n = min(len(own), 13)
            for a in range(len(own) - n + 1) if n else ():
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == own[a : a + n]:
                        hit |= set(range(s, s + n))
                        found.add(k)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r["items"]) == (len(w), len(hit), len(found), sorted(map(str, found))), t
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


ODD = ["", " ", "  a", "a  b     c", "x▁y", "日本語 テキスト", "😀 \x00 é\r\n", "<s> </s> [INST]", "a" * 3000, "ab" * 2000, "=" * 1500 + " " * 40, "haha" * 500]


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("the anio=-_ 1234\n") for _ in range(rng.randint(1, 60))) for _ in range(300)] + [None]
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    want = [(i, len((t or "").encode()), len(lib.encode(t or ""))) for i, t in enumerate(texts)]
    got = token_counts.token_counts(spark.createDataFrame(rows(texts), DOCS)).collect()
    assert sorted((r.id, r.n_bytes, r.n_tokens) for r in got) == want


def test_viterbi_finds_the_best_score_and_comes_back(spark):
    model = pieces.read_model()
    codec = sentencepiece_codec.Codec(model)
    score = dict(zip(model.pieces, model.scores.tolist(), strict=True))
    rng = random.Random(2)
    words = ["".join(rng.choice("theanioré ") for _ in range(rng.randint(1, 12))) for _ in range(200)]
    for word, ids in zip(words, sentencepiece_codec.Encoder(codec)(words), strict=True):
        text = "▁" + word.replace(" ", "▁")
        best = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            for s in range(max(0, e - codec.longest), e):
                p = text[s:e]
                c = score[p] if p in model.id_of else codec.unknown if e - s == 1 else None
                if c is not None:
                    best[e] = max(best[e], best[s] + c)
        assert sum(model.scores[i] for i in ids.tolist()) == pytest.approx(best[-1])
        assert codec.decode(ids) == word
    got = sentencepiece_codec.encode_column(spark.createDataFrame(rows([*ODD, None]), DOCS))
    assert got.where("not round_trip").count() == 0
    back = sentencepiece_codec.decode_column(got).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)


def test_pseudonyms(spark):
    values = [("4111111111111111", "card"), ("1.2.3.4", "ip"), ("123-45-6789", "ssn"), ("899-99-9999", "ssn"), ("001-01-0001", "ssn"), ("+1 (017) 555-7713", "phone"), ("2024-02-29", "date"), ("1900-01-01", "date"), ("2099-12-31", "date")]
    m = spark.createDataFrame(values, "m string, kind string")
    f = m.withColumn("p", pii.pseudonym(F.col("m"), F.col("kind"), "k"))
    f = f.withColumn("b", pii.pseudonym(F.col("p"), F.col("kind"), "k", True)).withColumn("again", pii.kind_of(F.col("p")))
    for r in f.collect():
        assert r.b == r.m and r.again == r.kind and len(r.p) == len(r.m) or r.kind == "ip", r
    text = "pay 4111111111111111 or 4111111111111112 by 2023-02-30 at 10.0.0.256, a.b@x.org."
    got = {r.id: r for r in pii.pseudonymise(spark.createDataFrame([(1, text), (2, "4111111111111111"), (3, None), (4, "")], "doc_id long, text string"), "k").collect()}
    assert got[2].text in got[1].text and "4111111111111112 by 2023-02-30 at 10.0.0.256" in got[1].text and "@x.org." in got[1].text
    assert got[3].text is None and got[4].text == "" and [x.kind for x in got[1].found] == ["card", "email"]


def test_held_elements_keep_the_rest_of_the_page():
    said = lambda page: [b.text for b in html_text.blocks(page)]
    for icon in ("<svg class='i'/>", '<svg viewBox="0 > 1" />', "<svg><title>x</title><style/><path/></svg>", "<svg><svg/><svg><text>y</text></svg><text>z</text></svg>", "<select><option>a</select>", "<SVG>x</SVG>", "<button title=\"a\"\">go</button>", "<title>t</title>", "<!-- <svg> -->"):
        assert said(f"<p>One{icon} two</p><p>Three</p><svg>q</svg>") == ["One two", "Three"], icon
    for tag in ("svg-icon", "button-row", "select-box", "title-bar", "iframe-x", "template-y"):
        assert said(f"<{tag}><p>One</p></{tag}><p>Two</p>") == ["One", "Two"], tag
    for tag in ("svg", "button", "select"):
        assert said(f"<{tag} class=a><p>One</p><p>Two</p>") == ["One", "Two"]
        assert said(f"<{tag}><p>One</p><{tag}>no</{tag}><p>Two</p>") == ["One", "Two"]
    assert said("<p>One</p><script>var a = '<svg>'</script><p>Two</p><svg><b>no</b></svg>") == ["One", "Two"]
    assert len(said("<p>x</p>" + "<button>" * 50_000 + "<p>y</p>")) == 2


def test_every_pattern_passes_the_first_look(spark):
    texts = ["8.8.8.8", "dns 1.1.1.1, ok", "8.8.8.8 since 2024", "a@-x.org", "v 1.2", None]
    got = [r.text for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("id").collect()]
    assert got[0] != "8.8.8.8" and got[2] == got[0] + " since 2024" and "1.1.1.1" not in got[1] and got[3] != texts[3] and got[4:] == texts[4:]


def test_spellings_are_found_and_linked(spark):
    groups = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111 1111 1111 1111 123", "3782 822463 10005", "3782-822463-10005", "378282246310005"]
    phones = ["+1 (555) 123-4567", "555-123-4567", "(555) 123-4567", "555.123.4567", "555 123 4567", "1-555-123-4567", "+15551234567", "+1 555 123 4567", "(555)123-4567"]
    abroad = ["+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+353 1 234 5678", "+7 495 123-45-67"]
    left = ["4111 1111 1111 1112", "4111 1111-1111 1111", "10 200 3000 40", "1,555 123 4567", "100 200 3000 4000", "+2024", "12345678", "555-123-45678"]
    alone = groups + phones + abroad
    mixed = ["+33 1 23 45 67 89 4111 1111 1111 1111", "+44 20 7946 0958 8.8.8.8", "+1 555 123 4567 123-45-6789", "+2024-02-29", "1234 5678 9012 2024-02-29", "1234 5678 9012 555-123-4567", "4111 1111 1111 1111 2024-02-29"]
    kinds = ["phone card", "phone ip", "phone ssn", "date", "date", "phone", "card date"]
    texts = alone + left + mixed
    got = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("id").collect()
    now = dict(zip(texts, got))
    digits = lambda t, n: re.sub("[^0-9]", "", now[t].text)[-n:]
    for t in alone:
        assert now[t].text != t and re.sub(r"\d", "0", now[t].text) == re.sub(r"\d", "0", t) and len(now[t].found) == 1, t
    assert len({digits(t, 16) for t in groups[:3]} | {re.sub(" ", "", now[groups[3]].text[:19])}) == 1 and now[groups[3]].text.endswith(" 123")
    assert len({digits(t, 15) for t in groups[4:]}) == 1 and len({digits(t, 10) for t in phones}) == 1 and len({digits(t, 12) for t in abroad[:3]}) == 1
    assert all(now[t].text.startswith(code) for t, code in zip(abroad, ("+44 ", "+44", "+44-", "+353 ", "+7 ")))
    assert [now[t].text for t in left] == left
    assert [" ".join(x.kind for x in now[t].found) for t in mixed] == kinds
    m = spark.createDataFrame([(t, "card" if t in groups else "phone") for t in alone], "m string, kind string")
    f = m.withColumn("p", pii.pseudonym(F.col("m"), F.col("kind"), "k")).withColumn("b", pii.pseudonym(F.col("p"), F.col("kind"), "k", True))
    for r in f.withColumn("again", pii.kind_of(F.col("p"))).collect():
        assert (r.b, r.again) == (r.m, r.kind), r


def test_dates_are_permuted(spark):
    d = spark.range(73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("m"))
    p = d.select(pii.pseudonym(F.col("m"), F.lit("date"), "k").alias("p"))
    assert p.distinct().count() == 73049 and p.where("p < '1900-01-01' or p > '2099-12-31'").count() == 0


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<<SYS>> \\ \\\\ <\\/s>", "", None, " a ", "\n", "<s> x </s>\n<s> y", "[INST[INST]]<<</SYS>>"]
    data = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", "system", "to\\ol<s>", None) for t in odd)]
    got = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(data + data[:1] + [(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")))
    r = got.where("conv_id = 1").withColumn("loss", chat_format.loss_text(F.col("segments"))).first()
    want = sorted(data + data[:1], key=lambda x: x[1])
    assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in want]
    assert r.loss == "".join(x[3] or "" for x in want if x[2] == "assistant")
    assert got.count() == 2


def test_chat_turn_order(spark):
    data = [(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (2, 0, "assistant", "a"), (2, 1, "assistant", "b")]
    got = chat_format.format_chats(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: r.n_violations for r in got.collect()} == {1: 0, 2: 2}


def test_html_on_made_up_pages(spark):
    field = html_text.Field().train()
    rng = random.Random(77)
    pages = [html_text.training_page(rng) for _ in range(200)]
    assert sum(field.extract(p) == "\n".join(m) for p, m in pages) >= 190
    got = html_text.extract_main_text(spark.createDataFrame([(1, "u", None, 1), (2, None, "", 1), (3, "u", "<p", 1), (4, "u", "<article><h1>A &amp;amp; b</h1><p>One\n two.<p>Three<script>x</script></article>", 1)], "page_id long, url string, html string, text int"))
    texts = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    assert texts[1] == texts[2] == ("", 0) and texts[4] == ("A &amp; b\nOne two.\nThree", 24)


def test_warc_round_trip(spark):
    data = [(1, "u", "a", 9), (1, "u", "a", 9), (2, None, "a", 9), (None, "x", None, 9), (3, "v\n", "", 9), (5, "z", "é", 9)]
    got = warc.round_trip(spark.createDataFrame(data, "page_id long, url string, html string, refers_to int")).collect()
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)
    d = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 1, d("a"), "response", None), (1, 1, d("a"), "revisit", 1), (2, 1, d("a"), "revisit", 1), (None, 0, d(""), "revisit", 3), (3, 0, d(""), "response", None), (5, 2, d("é"), "response", None)]
    assert found == sorted(want, key=repr)


def test_zip64_directory(tmp_path, monkeypatch):
    import zipfile

    from pyarrow import fs

    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    at = str(tmp_path / "p.wacz")
    one, two = warc.record(1, "u", b"x" * 50, "response", None), warc.record(2, "v", b"", "revisit", 1)
    with zipfile.ZipFile(at, "w") as z:
        z.writestr(warc.DATA, one + two)
        z.writestr(warc.INDEX, "".join(f'u 19700101000000 {{"offset": "{a}", "length": "{n}", "filename": "data.warc.gz"}}\n' for a, n in ((0, len(one)), (len(one), len(two)))))
    with fs.LocalFileSystem().open_input_file(at) as f:
        got = [warc.parse_record(r) for r in warc.Package(f).records()]
    assert got[0][1] == b"x" * 50 and got[1][0]["warc-refers-to"] == "<urn:page:1>"


def test_quality_learns_from_the_other_folds(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    good = [" ".join(word() for _ in range(60)) + "." for _ in range(300)]
    bad = [" ".join(word() + "!!" for _ in range(60)) for _ in range(300)]
    docs = rows(good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)] + [(1, None), (None, 1)], "doc_id long, quality int")
    got = {r.id: r for r in quality.quality_scores(spark.createDataFrame(docs, DOCS), labels).collect()}
    held = [r for i, r in got.items() if r.held_out and i < 600]
    assert len(got) == 602 and held and all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.predicted == int(r.id < 300) for r in held) >= 0.95 * len(held)


def test_isotonic():
    import numpy as np

    assert quality.isotonic(np.array([1.0, 0.0, 2.0]), np.array([1.0, 1.0, 1.0])).tolist() == [0.5, 0.5, 2.0]


def test_pipeline(spark):
    import corpus_pipeline
    from pyspark.sql import SparkSession  # noqa: F401

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = corpus_pipeline.run(spark, d)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert 0 < len(ids) < docs.count() and len(set(ids)) == len(ids)
    assert got.columns[: len(docs.columns)] == docs.columns and got.where("not round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns


def _brute_keep(docs, items, predicted):
    """Ids that the pipeline keeps, from (doc_id, text) rows, by plain loops."""
    docs = [(i, t) for i, t in docs if predicted[i]]
    groups = {}
    for i, t in docs:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i, t))
    docs = sorted((i, t) for own in groups.values() for _, i, t in [min(own, key=lambda x: x[:2])])
    own = [(i, sets(t, 5)) for i, t in docs]
    least = {}
    for i, x in own:
        least[i] = i
    for i, x in own:
        for j, y in own:
            if i < j and x and y and 10 * len(x & y) >= 8 * len(x | y):
                a, b = sorted((least[i], least[j]))
                least = {k: a if v == b else v for k, v in least.items()}
    docs = [(i, t) for i, t in docs if least[i] == i]
    windows = {}
    for item in items:
        w = _words(item)
        n = min(len(w), 13)
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, set()).add(tuple(w[a : a + n]))
    kept = []
    for i, t in docs:
        w, hit = _words(t), set()
        for n, those in windows.items():
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in those:
                    hit |= set(range(a, a + n))
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(i)
    return sorted(kept)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs, bench, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark", "labels"))
    predicted = {r.id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    want = _brute_keep([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()], predicted)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).select("doc_id").collect()) == want


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids and texts, empty texts, repeated rows, clashing columns and no rows at all: every stage runs and keeps the columns."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([*rows([None, "", "a b c d e f", "a b c d e f", "x" * 50000]), *rows(["a b c d e f"], 2), (None, None, None, None, None, None, None, None, None, None)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, d)
        assert got.columns[: len(odd.columns)] == odd.columns, name
        assert got.count() <= odd.count(), name
        assert stage(spark, odd.limit(0), d).count() == 0, name
    exact, near = (dict(corpus_pipeline.STAGES)[n](spark, odd, d) for n in ("exact dedup", "n-gram jaccard join"))
    assert exact.where("text = 'a b c d e f'").count() == 1
    assert {r.doc_id for r in near.where("text = 'a b c d e f'").collect()} == {2}
