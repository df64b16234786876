"""Text retrieval by TF-IDF, under a token budget."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import camel_split, estimated_tokens, terms, words
from ..plans.lineage import cut
from ..plans.spread import before_in_order, dealt

#: Weight of a term that no document has.
UNKNOWN_IDF = 0.5
#: Bonus of a query term found inside a document's words.
BONUS = 0.3
#: Terms whose inverse frequencies are sent to every task, the most frequent ones; few rows have one of the others, and these are joined by a shuffle.
FREQUENT = 1 << 18
#: Documents whose texts a task splits and counts: between these two, and as many tasks as shuffles have where that is possible.
TASK_TEXTS = 512, 4096
#: What stands for a document in a list of its words; no word is like it.
_MARK = " "


def term_rows(texts: DataFrame, whole: str | None = None) -> DataFrame:
    """doc, term for each term of texts (doc, text), and the term whole once more for each text that has terms.

    Words become rows before they are filtered and lowered, as functions over lists of words are interpreted for each of them.
    """
    split = texts.select("doc", camel_split(F.col("text")).alias("text"))
    found = words(F.col("text"))
    if whole is not None:
        found = F.concat(found, F.array(F.when(F.col("text").rlike("[A-Za-z0-9]{2}"), _MARK)))
    # Outer, as else Spark filters by the size of what is exploded, and splits each text once more for it.
    rows = split.select("doc", F.explode_outer(found).alias("term"))
    if whole is None:
        return rows.where(F.length("term") > 1).select("doc", F.lower("term").alias("term"))
    marks = F.col("term") == _MARK
    return rows.where(marks | (F.length("term") > 1)).select("doc", F.when(marks, whole).otherwise(F.lower("term")).alias("term"))


def term_counts(texts: DataFrame, repeated: DataFrame | None, documents: int, whole: str | None = None) -> DataFrame:
    """doc, term, tf of texts (doc, text), of about so many documents. repeated: the ids (doc) that several texts have, null maybe one of them, if any.

    Texts are dealt by document, so that a document's terms are counted where they are split and only texts are shuffled. Texts of an
    id that has several, maybe very many, are dealt anyhow instead, and their counts are shuffled.
    """
    fewest, most = (math.ceil((documents + 1) / size) for size in reversed(TASK_TEXTS))
    tasks = max(min(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), most), fewest)
    counts = lambda own: term_rows(own, whole).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    if repeated is None:
        return counts(texts.repartition(tasks, "doc"))
    several = repeated.withColumnRenamed("doc", "several")
    is_one = F.col("doc").eqNullSafe(F.col("several"))
    return counts(texts.join(several, is_one, "left_anti").repartition(tasks, "doc")).unionByName(counts(dealt(texts.join(several, is_one, "left_semi"))))


def with_idf(rows: DataFrame, idf: DataFrame) -> DataFrame:
    """rows with the idf of their terms, from idf (term, df, idf), which has all of them. Rows of frequent terms, nearly all, stay where they are."""
    sizes = {r.bits: r.terms for r in idf.groupBy(F.length(F.bin("df")).alias("bits")).agg(F.count("*").alias("terms")).collect()}  # 63 rows at most
    least, listed = 64, 0
    for bits in sorted(sizes, reverse=True):
        if (listed := listed + sizes[bits]) > FREQUENT:
            break
        least = bits
    frequent = F.length(F.bin("df")) >= least
    known = F.broadcast(idf.where(frequent).select("term", "idf"))
    if listed <= FREQUENT:
        return rows.join(known, "term")
    rest = idf.where(~frequent).select("term", "idf")
    return rows.join(known, "term").unionByName(rows.join(known.select("term"), "term", "left_anti").join(rest, "term"))


def _document_frequency(docs: DataFrame, text: str) -> DataFrame:
    """term, df, idf. Each document sends a term once, and an empty one to be counted itself; partial counts shrink them before the shuffle.

    Texts are read once and dealt over tasks: the table, as large as the vocabulary, is cut.
    """
    own = dealt(docs.select(text)).select(F.array_distinct(terms(F.col(text))).alias("terms"))
    # Outer, as else Spark filters by the size of what is exploded, and splits each text once more for it.
    own = own.select(F.explode_outer(F.when(F.size("terms") > 0, F.concat("terms", F.array(F.lit(""))))).alias("term")).where("term is not null")
    df = cut(own.groupBy("term").agg(F.count("*").alias("df")))
    whole = df.where("term = ''").first()
    n = whole.df if whole else 0
    return df.where("term <> ''").withColumn("idf", F.log(F.lit(n + 1) / (F.col("df") + 1)) + 1)


def term_statistics(docs: DataFrame, text: str) -> DataFrame:
    """Per term: df and idf = ln((N + 1) / (df + 1)) + 1, N the documents that have a term."""
    return _document_frequency(docs, text).select("term", "df", F.round("idf", 6).alias("idf"))


def search(docs: DataFrame, doc: str, text: str, query: list[str], limit: int | None = 10) -> DataFrame:
    """Documents by cosine of TF-IDF with the query's terms, plus a bonus for terms found inside words; 4 places, ties by document.

    Each term of over three characters that a document has, be it inside a longer word, adds BONUS to
    b, and b / (1 + b) to the score, of at most 1. Only documents with a hit are split into weights.
    No limit: all of these.
    """
    idf = _document_frequency(docs, text).select("term", "idf")
    # A term that a document has, or that is inside its words, is in its text: only such texts are split.
    low = F.lower(F.col(text))
    has = [low.contains(term) for term in query] or [F.lit(False)]
    found = dealt(docs.where(functools.reduce(lambda a, b: a | b, has)).select(F.col(doc).alias("doc"), F.col(text).alias("text")))
    # What is inside a document's words is told after they are counted: a filter on the list of them would split each text once more for each term.
    tf = found.select("doc", F.explode_outer(terms(F.col("text"))).alias("term")).where("term is not null").groupBy("doc", "term").agg(F.count("*").alias("tf"))
    inside = [F.max(F.col("term").contains(term).cast("int")) for term in query if len(term) > 3] or [F.lit(0)]
    wanted = F.col("term").isin(*query)
    weight = F.col("tf") * F.col("idf")
    scored = tf.join(idf, "term").groupBy("doc").agg(
        F.sum(F.when(wanted, weight * F.col("idf")).otherwise(0.0)).alias("dot"), F.sqrt(F.sum(weight * weight)).alias("norm"), F.count_if(wanted).cast("long").alias("matched"),
        sum(inside[1:], inside[0]).alias("inside"),
    ).where("inside > 0 OR matched > 0")
    known = [r.idf for r in idf.where(wanted).collect()]  # at most the query's terms
    q = math.sqrt(sum(x * x for x in known) + (len(query) - len(known)) * UNKNOWN_IDF**2)
    b = F.col("inside") * BONUS
    score = F.round(F.least(F.lit(1.0), F.col("dot") / (F.col("norm") * q) + b / (b + 1)), 4)
    ranked = scored.select("doc", score.alias("score"), "matched").orderBy(F.desc("score"), "doc")
    return ranked if limit is None else ranked.limit(limit)


def within_budget(ranked: DataFrame, partition: str, order: list, text: str, budget: int) -> DataFrame:
    """Rows in order (which tells them apart) while their tokens stay within the budget; the first is always kept.

    Only tokens and order are sorted, by ranges, so a partition of any size is spread over tasks; a range
    that begins beyond the budget is left out as a whole. Texts are joined to what is kept.
    """
    keys = [partition, *order]
    d = ranked.select(*keys, estimated_tokens(F.col(text)).alias("tokens"))
    d = before_in_order(d, [partition], order, F.coalesce("tokens", F.lit(0)), "before", budget)
    d = d.withColumn("used", F.when(F.col("tokens").isNotNull() | (F.col("before") > 0), F.col("before") + F.coalesce("tokens", F.lit(0))))
    first = ranked.groupBy(partition).agg(F.min(F.struct(*order)).alias("first_place"))
    d = d.join(first, partition).where((F.col("used") <= budget) | (F.struct(*order) == F.col("first_place"))).drop("before", "first_place")
    return ranked.join(d, keys)
