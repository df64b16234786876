"""Search over stored postings against search over texts, and what of the index it reads."""

import random

import pytest
from pyspark.sql import functions as F

from tracelode.operators import postings, search


@pytest.mark.parametrize("listed", [1000, 1])
def test_the_same_rows_as_over_texts(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(postings, "LISTED_TERMS", listed)
    rng = random.Random(4)
    words = ["deploy", "deployment", "redeploys", "to", "tokens", "token", "TokenList", "a", "xy", "docker", "é", "x1", "build2Go"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(90, None), (91, ""), (92, "deploy " * 500), (93, "docker"), (94, "docker")]
    d = spark.createDataFrame([(*r, 1, "z") for r in docs], "id long, t string, term int, tf string")
    postings.write_postings(d, "id", "t", str(tmp_path))
    for query in (["deploy"], ["token", "xy"], ["to"], ["docker", "docker"], ["none"], ["deploy", "none", "oy"], []):
        for limit in (None, 3):
            want = [] if not query else [tuple(r) for r in search.search(d, "id", "t", query, limit).collect()]
            got = [tuple(r) for r in postings.search_postings(spark, str(tmp_path), query, limit).collect()]
            assert got == want, (query, limit)


def test_an_empty_index_and_a_pushed_filter(spark, tmp_path):
    none = spark.createDataFrame([], "id long, t string")
    postings.write_postings(none, "id", "t", str(tmp_path / "none"))
    assert postings.search_postings(spark, str(tmp_path / "none"), ["deploy"]).count() == 0
    many = spark.range(4000).select(F.col("id"), F.concat(F.lit("w"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit(" common")).alias("t"))
    postings.write_postings(many, "id", "t", str(tmp_path / "many"))
    found = postings.search_postings(spark, str(tmp_path / "many"), ["w00017"])
    assert [r.doc for r in found.collect()] == [17]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "w00017" in plan.split("PushedFilters")[1]


def test_disk_of_writing_and_ids_of_several_texts(spark, tmp_path, monkeypatch):
    """Counts are put down once, compressed, and nothing uncompressed is cut; ids that several texts have, null ids and rare terms give the rows of a search over texts."""
    cuts = []
    monkeypatch.setattr(postings, "cut", lambda df: cuts.append(df.columns) or df.checkpoint())
    docs = [(k, f"w{k % 7} token tokenLists r{k}") for k in range(60)]
    postings.write_postings(spark.createDataFrame(docs, "id long, t string"), "id", "t", str(tmp_path / "one"))
    assert cuts == [] and not (tmp_path / "one" / "counts").exists()
    for frequent in (1 << 18, 8, 0):
        monkeypatch.setattr(search, "FREQUENT", frequent)
        d = spark.createDataFrame([*docs, (3, "deploy token"), (3, "token again"), (60, "a b"), (61, None)], "id long, t string")
        postings.write_postings(d, "id", "t", str(tmp_path / "some"))
        joined = d.groupBy("id").agg(F.concat_ws(" ", F.collect_list("t")).alias("t"))
        for query in (["token"], ["deploy", "r17"]):
            want = [tuple(r) for r in search.search(joined, "id", "t", query, None).collect()]
            assert [tuple(r) for r in postings.search_postings(spark, str(tmp_path / "some"), query, None).collect()] == want, (frequent, query)
    assert cuts and all(c == ["doc"] for c in cuts)
