"""An index of terms that follows its documents: an update writes a generation of what changed, and of stored terms reads those of changed documents.

A generation has the documents that came or changed (documents: doc, digest), their terms (by_doc: doc, term, tf), where a term is (by_term: term, doc), the
documents that went or changed (gone) and by how much terms became more or less frequent (frequencies). Rows of a generation are dead once a later
one says that their document is gone. Inverse frequencies and norms depend on every document, so none is stored: search computes them for the
documents that it finds, from sums of changes. The commit of a generation is written last; without it a generation isn't read, and is written
anew by the next update. compacted() folds generations into one, vacuum() removes those that it replaces. One writer at a time; two commits of a number raise.

Nulls: a null id is left out, a null text is empty. Repeated ids: their texts count as one document. Texts without terms are documents that no search
finds. Empty tables give an empty index. Other columns are not read.
"""

from __future__ import annotations

import functools
import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .search import BONUS, UNKNOWN_IDF, term_counts, with_idf

#: A term that each document with terms has once more, so that its frequency is their number; search never finds it.
ANY = ""
#: Documents or terms that a filter lists, so that files and row groups without them are passed over; more are joined.
LISTED = 1000
#: Documents or terms that are sent to every task, so that stored rows stay where they are; with more, rows are shuffled.
SENT = 1_000_000
_SORTED = {"documents": ["doc"], "by_term": ["term", "doc"], "by_doc": ["doc", "term"], "gone": ["doc"], "frequencies": ["term"]}


def _commits(spark: SparkSession, at: str) -> tuple[int, int, int]:
    """First generation that counts, last one, and number of documents with terms; -1 as the last where there is no index."""
    try:
        own = spark.read.parquet(f"{at}/commits").collect()  # a row for each update since the last vacuum()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return 0, -1, 0
        raise
    first = max((r.generation for r in own if r.base), default=0)
    return first, max(r.generation for r in own), sum(r.documents for r in own if r.generation >= first)


def _part(spark: SparkSession, at: str, part: str, span: tuple[int, int, int]) -> DataFrame:
    return spark.read.parquet(f"{at}/{part}").where(F.col("generation").between(span[0], span[1]))


def _keyed(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """rows joined with keys (all different, a row of few bytes each); rows aren't sorted for it, and are shuffled for many keys only."""
    sent = keys.limit(SENT + 1).count() <= SENT
    return rows.join(F.broadcast(keys) if sent else keys.hint("shuffle_hash"), key, how)


def _live(spark: SparkSession, at: str, part: str, span: tuple[int, int, int], which: Column | None = None) -> DataFrame:
    """Rows of a part, of those that a filter leaves, whose document has not gone since. None has gone since the last generation."""
    rows = _part(spark, at, part, span)
    rows = rows if which is None else rows.where(which)
    if span[0] == span[1]:
        return rows.drop("generation")
    gone = _part(spark, at, "gone", span).groupBy("doc").agg(F.max("generation").alias("__gone"))
    before = _keyed(rows.where(F.col("generation") < span[1]), gone, "doc", "left").where("__gone IS NULL OR generation >= __gone")
    return before.drop("__gone", "generation").unionByName(rows.where(F.col("generation") == span[1]).drop("generation"))


def _of(spark: SparkSession, at: str, part: str, span: tuple[int, int, int], keys: DataFrame, key: str) -> DataFrame:
    """Live rows of a part that have one of keys (all different)."""
    few = [r[0] for r in keys.select(key).limit(LISTED + 1).collect()]
    if len(few) <= LISTED:
        return _live(spark, at, part, span, F.col(key).isin(*few) if few else F.lit(False))
    return _keyed(_live(spark, at, part, span), keys.select(key), key, "left_semi")


def _put(rows: DataFrame, at: str, part: str, generation: int, spread: bool = True) -> DataFrame:
    """Write a part of a generation, sorted by its keys and, unless rows are dealt already, dealt by ranges of them. What was written is returned."""
    order, to = _SORTED[part], f"{at}/{part}/generation={generation}"
    rows = rows.repartitionByRange(*order) if spread else rows
    rows.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(to)
    return rows.sparkSession.read.parquet(to)


def _commit(spark: SparkSession, at: str, generation: int, documents: int, base: bool) -> None:
    commit = spark.createDataFrame([(documents, base)], "documents long, base boolean").coalesce(1)
    commit.write.mode("error").parquet(f"{at}/commits/generation={generation}")


def _digest(text: Column) -> Column:
    """Of an id's rows in any order: two sums of 64-bit hashes and the number of rows. It combines before a shuffle."""
    whole = lambda *seed: F.sum(F.xxhash64(text, *seed).cast("decimal(38,0)")).cast("string")
    return F.concat_ws("/", whole(), whole(F.lit("second")), F.count("*").cast("string"))


def delta(docs: DataFrame, doc: str, text: str, at: str) -> DataFrame:
    """doc, digest, known: documents that differ from those of an index. A null digest: it went; known: the index has it, in another form or to be removed."""
    spark, span = docs.sparkSession, _commits(docs.sparkSession, at)
    now = docs.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("doc")).agg(_digest(F.coalesce(F.col(text), F.lit(""))).alias("digest"))
    if span[1] < 0:
        return now.withColumn("known", F.lit(False))
    was = _live(spark, at, "documents", span).withColumnRenamed("digest", "was")
    both = now.join(was, "doc", "full_outer").where(~F.col("digest").eqNullSafe(F.col("was")))
    return both.select("doc", "digest", F.col("was").isNotNull().alias("known"))


def update(docs: DataFrame, doc: str, text: str, at: str) -> int:
    """Make the index in a folder (a new one where there is none) that of docs. Returns how many documents came, changed or went.

    All texts are hashed; only those that came or changed are split into terms, and nothing is written where none did.
    """
    spark = docs.sparkSession
    span = _commits(spark, at)
    changed = cut(delta(docs, doc, text, at))
    count = changed.count()
    if not count and span[1] >= 0:
        return 0
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL")
    here, left = changed.where("digest IS NOT NULL").select("doc", "digest"), changed.where("known").select("doc")
    several = changed.where("substring_index(digest, '/', -1) <> '1'").select("doc")  # the end of a digest is how many texts it is of
    own = term_counts(d if span[1] < 0 else _keyed(d, here.select("doc"), "doc", "left_semi"), None if several.isEmpty() else several, count, ANY)
    generation = span[1] + 1
    came = _put(own, at, "by_doc", generation, spread=False)
    change = came.select("term", F.lit(1).alias("one"))
    if span[1] >= 0:
        change = change.unionByName(_of(spark, at, "by_doc", span, left, "doc").select("term", F.lit(-1).alias("one")))
    change = _put(change.groupBy("term").agg(F.sum("one").alias("change")).where("change <> 0"), at, "frequencies", generation, spread=False)
    _put(came.where(F.col("term") != ANY).select("term", "doc"), at, "by_term", generation)
    _put(here, at, "documents", generation)
    _put(left, at, "gone", generation)
    more = change.where(F.col("term") == ANY).first()
    _commit(spark, at, generation, more.change if more else 0, span[1] < 0)
    return count


def compacted(spark: SparkSession, at: str) -> None:
    """Fold the generations of an index into one, from stored terms; no text is read."""
    span = _commits(spark, at)
    if span[0] == span[1] or span[1] < 0:
        return
    by_doc = _put(_live(spark, at, "by_doc", span).select("doc", "term", "tf"), at, "by_doc", span[1] + 1, spread=False)
    documents = _put(_live(spark, at, "documents", span), at, "documents", span[1] + 1)
    totals = _part(spark, at, "frequencies", span).groupBy("term").agg(F.sum("change").alias("change")).where("change > 0")
    _put(totals, at, "frequencies", span[1] + 1, spread=False)
    _put(by_doc.where(F.col("term") != ANY).select("term", "doc"), at, "by_term", span[1] + 1)
    _put(documents.select("doc").limit(0), at, "gone", span[1] + 1)
    _commit(spark, at, span[1] + 1, span[2], True)


def vacuum(spark: SparkSession, at: str) -> None:
    """Remove generations that a compaction replaced; frames that were read from them can't be computed any more."""
    first = _commits(spark, at)[0]
    old = [r.generation for r in spark.read.parquet(f"{at}/commits").where(F.col("generation") < first).collect()]
    for part in (*_SORTED, "commits"):
        for generation in old:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{part}/generation={generation}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def frequencies(spark: SparkSession, at: str) -> DataFrame:
    """term, df, idf: what search.term_statistics() gives for the documents of an index, unrounded."""
    span = _commits(spark, at)
    df = _part(spark, at, "frequencies", span).where(F.col("term") != ANY).groupBy("term").agg(F.sum("change").alias("df")).where("df > 0")
    return df.withColumn("idf", F.log(F.lit(span[2] + 1) / (F.col("df") + 1)) + 1)


def search_index(spark: SparkSession, at: str, query: list[str], limit: int | None = 10) -> DataFrame:
    """doc, score, matched as search.search() gives them for the documents of an index; of stored terms it reads those of documents that it finds."""
    span = _commits(spark, at)
    if not query:
        kind = dict(spark.read.parquet(f"{at}/documents").dtypes)["doc"]
        return spark.createDataFrame([], f"doc {kind}, score double, matched long")
    idf = frequencies(spark, at)
    wanted = F.col("term").isin(*query)
    holds = [F.col("term").contains(term) for term in query if len(term) > 3]
    hit = cut(idf.where(functools.reduce(lambda a, b: a | b, holds, wanted)))
    known = [r.idf for r in hit.where(wanted).select("idf").collect()]  # at most the query's terms
    found = cut(_of(spark, at, "by_term", span, hit, "term").select("doc").distinct())
    own = with_idf(_of(spark, at, "by_doc", span, found, "doc").where(F.col("term") != ANY), idf)
    weight = F.col("tf") * F.col("idf")
    inside = [F.max(h.cast("int")) for h in holds] or [F.lit(0)]
    scored = own.groupBy("doc").agg(
        F.sum(F.when(wanted, weight * F.col("idf")).otherwise(0.0)).alias("dot"),
        F.sqrt(F.sum(weight * weight)).alias("norm"),
        F.count_if(wanted).cast("long").alias("matched"),
        functools.reduce(lambda a, b: a + b, inside).alias("inside"),
    )
    q = math.sqrt(sum(x * x for x in known) + (len(query) - len(known)) * UNKNOWN_IDF**2)
    b = F.col("inside") * BONUS
    ranked = scored.select("doc", F.round(F.least(F.lit(1.0), F.col("dot") / (F.col("norm") * q) + b / (b + 1)), 4).alias("score"), "matched").orderBy(F.desc("score"), "doc")
    return ranked if limit is None else ranked.limit(limit)
