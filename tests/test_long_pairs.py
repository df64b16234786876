"""Alignment against the whole table, and in seconds for long lists; first differences for any size of block."""

import random
import time

import pytest

from tracelode.operators import compare, skeleton


def table(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    pairs = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return pairs


def test_alignment_equals_the_whole_table():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert skeleton.alignment(a, b) == table(a, b)
    assert skeleton.alignment(list("abcd"), list("acd")) == [(0, 0), (2, 1), (3, 2)]
    assert skeleton.alignment(list("abcd"), list("xabyd")) == [(0, 1), (1, 2), (3, 4)]


def test_long_lists_take_seconds():
    rng = random.Random(6)
    a = [rng.randrange(300) for _ in range(10_000)]
    b = [x for x in a if rng.random() < 0.8] + [rng.randrange(300) for _ in range(2000)]
    began = time.perf_counter()
    pairs = skeleton.alignment(a, b)
    assert time.perf_counter() - began < 10
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) >= len(b) - 2000
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_first_difference_for_any_block(spark, block):
    rng = random.Random(block)
    recs = {k: [rng.choice("xy") if rng.random() < 0.1 else "x" for _ in range(rng.randint(1, 12))] for k in range(12)}
    recs[20], recs[21] = recs[0], list(recs[0])
    rows = spark.createDataFrame([(k, p, f) for k, own in recs.items() for p, f in enumerate(own)], "rec long, pos long, fp string")
    pairs = [(a, b) for a in recs for b in recs if a != b]
    want = {}
    for a, b in pairs:
        x, y = recs[a], recs[b]
        k = next((k for k in range(max(len(x), len(y))) if x[k : k + 1] != y[k : k + 1]), None)
        want[a, b] = (len(x), "identical") if k is None else (k, "left-only" if k >= len(y) else "right-only" if k >= len(x) else "content")
    got = compare.positional_diff(spark.createDataFrame(pairs, "l long, r long"), rows, rows, block)
    assert {(r.l, r.r): (r.common_prefix, r.reason) for r in got.collect()} == want
