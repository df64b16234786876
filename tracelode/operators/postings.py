"""A stored index of terms, and search that reads the postings of a query's terms only.

A posting is a term, a document and how often the term is in it. The vocabulary (terms: term, df, idf) tells which terms hold a term of the query and
what they weigh, and norms (doc, norm) has the length of each document's vector of weights, so a document's score follows from the postings of the
query's terms and a row of each table. Postings lie sorted by term and document, dealt by ranges of both, so a term that
is in very many documents lies in many files, and a filter on terms passes over files and row groups without them. Scores and ties are those
of search.search().

Writing puts counts down once, by document, as a compressed table that is removed in the end; frequencies, weights and postings are read from it.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .search import BONUS, UNKNOWN_IDF, term_counts, with_idf

#: Terms that a filter on postings lists; more are joined by a broadcast or, where the vocabulary is large, a shuffle.
LISTED_TERMS = 1000


def write_postings(docs: DataFrame, doc: str, text: str, at: str) -> None:
    """Write the index of docs to a folder: postings (term, doc, tf), terms (term, df, idf) and norms (doc, norm). What was there is replaced."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))

    def put(rows: DataFrame, part: str) -> DataFrame:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{at}/{part}")
        return spark.read.parquet(f"{at}/{part}")

    ids = texts.groupBy("doc").agg(F.count("*").alias("texts"))
    size = ids.agg(F.count("*").alias("documents"), F.max("texts").alias("most")).first()
    repeated = cut(ids.where("texts > 1").select("doc")) if (size.most or 0) > 1 else None
    counts = put(term_counts(texts, repeated, size.documents).sortWithinPartitions("doc", "term"), "counts")
    n = counts.select("doc").distinct().count()
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    idf = put(df.withColumn("idf", F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1).repartitionByRange("term").sortWithinPartitions("term"), "terms")
    weight = F.col("tf") * F.col("idf")
    norms = with_idf(counts, idf).groupBy("doc").agg(F.sqrt(F.sum(weight * weight)).alias("norm"))
    put(norms.sortWithinPartitions("doc"), "norms")
    put(counts.select("term", "doc", "tf").repartitionByRange("term", "doc").sortWithinPartitions("term", "doc"), "postings")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/counts")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def search_postings(spark: SparkSession, at: str, query: list[str], limit: int | None = 10) -> DataFrame:
    """doc, score, matched as search.search() gives them for the documents of an index."""
    if not query:
        return spark.createDataFrame([], f"doc {dict(spark.read.parquet(f'{at}/postings').dtypes)['doc']}, score double, matched long")
    vocabulary, postings, norms = (spark.read.parquet(f"{at}/{part}") for part in ("terms", "postings", "norms"))
    wanted = F.col("term").isin(*query)
    holds = [F.col("term").contains(term) for term in query if len(term) > 3]
    hit = vocabulary.where(functools.reduce(lambda a, b: a | b, holds, wanted)).select("term", "idf")
    listed = hit.select("term").limit(LISTED_TERMS + 1).collect()
    known = [r.idf for r in vocabulary.where(wanted).select("idf").collect()]  # at most the query's terms
    if len(listed) <= LISTED_TERMS:
        own = postings.where(F.col("term").isin(*(r.term for r in listed)) if listed else F.lit(False)).join(F.broadcast(hit), "term")
    else:
        own = postings.join(hit, "term")
    weight = F.col("tf") * F.col("idf")
    inside = [F.max(h.cast("int")) for h in holds] or [F.lit(0)]
    scored = own.groupBy("doc").agg(
        F.sum(F.when(wanted, weight * F.col("idf")).otherwise(0.0)).alias("dot"), F.count_if(wanted).cast("long").alias("matched"), functools.reduce(lambda a, b: a + b, inside).alias("inside")
    ).join(norms, "doc")
    q = math.sqrt(sum(x * x for x in known) + (len(query) - len(known)) * UNKNOWN_IDF**2)
    b = F.col("inside") * BONUS
    ranked = scored.select("doc", F.round(F.least(F.lit(1.0), F.col("dot") / (F.col("norm") * q) + b / (b + 1)), 4).alias("score"), "matched").orderBy(F.desc("score"), "doc")
    return ranked if limit is None else ranked.limit(limit)
