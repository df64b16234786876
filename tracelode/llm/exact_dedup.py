"""Exact duplicates by sorting contents.

Texts are normalised (white space deleted), dealt by sampled splitters over the composite
key (first 64 normalised bytes, SHA-256 of all of them, longer original first, id) and sorted
externally within each range by their whole normalised bytes, then longer original first and id.
Splitters stay small however long the texts are, and equal texts are neighbours: one pass compares
each text with the one before it in full. Because length and id belong to the key, a text that a
third of all rows share is split over as many ranges as any other third. A run that touches an end of
its range may go on in another one: of each range the texts of its first and its last run, two at
most, are compared in full with those of the other ranges; nothing else crosses ranges. The digest
only tells which texts can't be equal.

Defined results: null text is empty; all empty texts are one group. A null id sorts after
every other. Texts of any length are compared whole. Rows that repeat an id and a text are rows of
their group like any other: one row of a group is kept and no more. Of rows of equal length the least
id is kept. An empty table gives an empty result. Only the two named columns are read; others, whatever
their names, are ignored by exact_groups and passed on by drop_exact_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, cut, cut_table, fresh, quoted, small

_RUNS = "id long, n_chars long, range int, run int, keep long, size long, first boolean, edge boolean, sha string, body binary"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
_SCHEMA = pa.schema([(x.split()[0], _KINDS[x.split()[1]]) for x in _RUNS.split(", ")])
#: Rows of one result batch; and ends of ranges (about 60 bytes each) that are broadcast, more are joined by a shuffle.
_ROWS, BROADCAST_ROWS = 8192, 200_000


def normalised(text):
    """Without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, rows with their run's keeper and size out; edge: the run meets an end of the range, and its first row has the text."""
    part = TaskContext.get().partitionId()
    columns: list[list] = [[] for _ in _SCHEMA]
    ids: list = []
    lengths: list = []
    last: bytes | None = None
    sha, run = "", 0

    def close(edge: bool) -> None:
        nonlocal run
        n = len(ids)
        body = [last if edge else None] + [None] * (n - 1)
        for own, new in zip(columns, (ids, lengths, [part] * n, [run] * n, [ids[0]] * n, [n] * n, [True] + [False] * (n - 1), [edge] * n, [sha] * n, body), strict=True):
            own.extend(new)
        run += 1

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
        for own in columns:
            own.clear()
        return out

    for b in batches:
        for i, n, t, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
            # Texts of different digests differ; those of equal ones are compared whole.
            if last is None or digest != sha or t.as_py() != last:
                if last is not None:
                    close(run == 0)
                    if len(columns[0]) >= _ROWS:
                        yield taken()
                ids, lengths, last, sha = [], [], t.as_py(), digest
            ids.append(i)
            lengths.append(n)
    if last is not None:
        close(True)
    if columns[0]:
        yield taken()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, n_chars."""
    spark = docs.sparkSession
    arrow_limits(spark)
    text = F.col(quoted(text_col))
    d = docs.select(
        F.col(quoted(id_col)).cast("long").alias("id"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n"),
        F.encode(normalised(text), "UTF-8").alias("body"),
    )
    d = d.withColumn("sha", F.sha2("body", 256)).withColumn("head", F.substring("body", 1, 64))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.col("n").desc(), F.col("id").asc_nulls_last()]
    ranged = d.repartitionByRange(n, F.col("head").asc(), F.col("sha").asc(), *rest).sortWithinPartitions(F.col("body").asc(), *rest)
    runs, _ = cut_table(ranged.select("id", "n", "body", "sha").mapInArrow(_runs, _RUNS))
    # At most the first and the last run of each range can go on in another one: their texts meet in full.
    ends = runs.where("edge and first").select("range", "run", "sha", "body", "keep", "size", "n_chars")
    foremost = F.struct(-F.col("n_chars"), F.coalesce("keep", F.lit(2**63 - 1)), "range")
    groups = ends.groupBy("sha", "body").agg(F.min_by("keep", foremost).alias("all_keep"), F.min_by("range", foremost).alias("all_range"), F.sum("size").alias("all_size"))
    whole = cut(ends.join(groups, ["sha", "body"]).select("range", "run", "all_keep", "all_range", "all_size"))
    whole = F.broadcast(whole) if small(whole, BROADCAST_ROWS) else whole
    return (
        runs.drop("body").join(whole, ["range", "run"], "left")
        .select(
            "id",
            F.when(F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("keep")).alias("keep_id"),
            F.coalesce("all_size", "size").alias("group_size"),
            (F.col("first") & (F.col("all_range").isNull() | (F.col("all_range") == F.col("range")))).alias("kept"),
            F.col("sha").alias("text_sha256"),
            "n_chars",
        )
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts: all its columns, the row that exact_groups keeps.

    Of rows that repeat a kept row's id, text and length, one stays.
    """
    sha, n = fresh(docs, "sha_of"), fresh(docs, "n_of")
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col("id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), F.col("n_chars").alias("kept_n"))
    text = F.col(quoted(text_col))
    at = docs.withColumn(sha, F.sha2(F.encode(normalised(text), "UTF-8"), 256)).withColumn(n, F.length(F.coalesce(text, F.lit(""))).cast("long"))
    on = at[quoted(id_col)].eqNullSafe(kept["kept_id"]) & (at[sha] == kept["kept_sha"]) & (at[n] == kept["kept_n"])
    found = at.join(kept, on, "left_semi")
    return found.dropDuplicates([id_col, sha, n]).drop(sha, n)
