"""Exact groups against plain grouping: long and odd texts, ties, repeated rows, clashing names, runs over range ends."""

import hashlib
import random
import re

import pytest

from tracelode.llm import exact_dedup


def plain(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for body, own in groups.items():
        own.sort()
        for x in own:
            i = rows[x[3]][0]
            out.append((i, rows[own[0][3]][0], len(own), x is own[0], hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_groups_equal_plain_grouping(spark, partitions):
    rng = random.Random(partitions)
    head = "h" * 70  # texts that differ only behind the splitters' bytes
    base = [None, "", " \t\x0b\x0c\r\n", "a b", "a\x00b", "é\xa0e", head + "1", head + "2", head + " 1", "x" * 300_000, "x" * 299_999 + " y", " ", "😀"]
    rows = [(rng.choice((None, rng.randint(0, 60))), rng.choice(base)) for _ in range(300)] + [(7, "same")] * 40 + [(i, " same") for i in range(40)]
    d = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, sha string, run int, body int, keep int")
    got = exact_dedup.exact_groups(d, partitions=partitions).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == plain(rows)


def test_dropping_keeps_columns_of_any_name(spark):
    rows = [(1, "a b", "p", 1), (2, "ab", "q", 2), (2, "ab", "q", 2), (3, None, "r", 3), (3, "c", "s", 4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, sha_of string, n_of int")
    got = exact_dedup.drop_exact_duplicates(d).collect()
    assert len(got) == 3 and set(map(tuple, got)) == {rows[0], rows[3], rows[4]}
