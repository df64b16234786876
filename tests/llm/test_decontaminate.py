"""Contamination on every join path, passages that all items share, long texts, repeated rows and clashing names."""

import random

from tracelode.llm import decontaminate

from .test_ops import _words


def brute(docs, items):
    windows = {}
    for k, t in items:
        w = _words(t)
        n = min(len(w), 13)
        for a in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, {}).setdefault(tuple(w[a : a + n]), set()).add(k)
    out = []
    for i, t in docs:
        w, hit, found = _words(t), set(), set()
        for n, those in windows.items():
            for s in range(len(w) - n + 1):
                if own := those.get(tuple(w[s : s + n])):
                    hit |= set(range(s, s + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(str(k) for k in found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_every_join_path_gives_the_same(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(400)}"
    shared = " ".join(word() for _ in range(40))  # a passage that all items and a third of the documents have
    items = [(k, f"{word()} {shared} " + " ".join(word() for _ in range(rng.choice((0, 5, 20))))) for k in range(30)] + [(3, "v1 v2 v3"), (40, "v9"), (41, None), (42, "")]
    docs = [(k, " ".join(word() for _ in range(rng.randint(0, 80))) + (f" {shared}" if k % 3 == 0 else "")) for k in range(90)]
    docs += [docs[0], (None, docs[3][1]), (200, " ".join(word() for _ in range(60_000)) + " " + shared), (201, "v9 " * 30_000), (202, None)]
    d = spark.createDataFrame([(i, t, 1, "w", "h") for i, t in docs], "doc_id long, text string, n_words int, words string, h string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    want = brute(docs, items)

    def got():
        return sorted(((r.id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(d, b).collect()), key=repr)

    assert got() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ITEMS", 0)
    monkeypatch.setattr(decontaminate, "BIT_WORDS", 1)
    assert got() == want
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert got() == want
