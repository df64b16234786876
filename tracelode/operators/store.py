"""An index of stored procedures: digests of what is there, term statistics and graph, kept beside them and rebuilt when stale."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .compare import digest_delta
from .graph import communities, page_rank, procedure_graph
from .procedures import documents, load
from .search import term_statistics

PARTS = ("digests", "terms", "nodes")


def digests(spark: SparkSession, folder: str, scopes: tuple[str, ...] = ("project", "global")) -> DataFrame:
    """key (scope and row's digest) and digest of each stored row, shadowed and broken ones too."""
    read = None
    for scope in scopes:
        own = F.substring(F.sha2("value", 256), 1, 16)
        d = spark.read.text(f"{folder}/{scope}").select(F.concat_ws("/", F.lit(scope), own).alias("key"), own.alias("digest"))
        read = d if read is None else read.unionByName(d)
    return read.distinct()


def count_stored(spark: SparkSession, folder: str, scopes: tuple[str, ...] = ("project", "global")) -> int:
    """Rows of all scopes, shadowed ones too."""
    return sum(spark.read.text(f"{folder}/{s}").count() for s in scopes)


def write_index(spark: SparkSession, folder: str, at: str, scopes: tuple[str, ...] = ("project", "global")) -> None:
    """Write the index of a store: digests, terms, and the graph's nodes with rank and community. What was there is replaced; the digests come last."""
    procs = load(spark, folder, scopes)[0]
    nodes, edges = procedure_graph(procs)
    ranked = nodes.join(page_rank(edges, nodes=nodes), "node", "left").join(communities(edges), "node", "left")
    ranked.write.mode("overwrite").parquet(f"{at}/nodes")
    term_statistics(documents(procs), "text").write.mode("overwrite").parquet(f"{at}/terms")
    digests(spark, folder, scopes).write.mode("overwrite").parquet(f"{at}/digests")


def read_index(spark: SparkSession, at: str) -> dict[str, DataFrame] | None:
    """The tables of an index; None where there is none, or only part of one."""
    try:
        return {p: spark.read.parquet(f"{at}/{p}") for p in PARTS}
    except AnalysisException:
        return None


def stale(spark: SparkSession, folder: str, at: str, scopes: tuple[str, ...] = ("project", "global")) -> bool:
    """Whether there is no index, or the store has other rows than it tells."""
    index = read_index(spark, at)
    return index is None or not digest_delta(index["digests"], digests(spark, folder, scopes), "key", "digest").isEmpty()


def refreshed(spark: SparkSession, folder: str, at: str, scopes: tuple[str, ...] = ("project", "global")) -> dict[str, DataFrame]:
    """The index, rebuilt first where it is stale."""
    if stale(spark, folder, at, scopes):
        write_index(spark, folder, at, scopes)
    return read_index(spark, at)


def named_communities(nodes: DataFrame) -> DataFrame:
    """community, procedures: labels of the procedures of each community of an index, sorted; those without one are left out."""
    own = nodes.where("kind = 'procedure' AND community IS NOT NULL").groupBy("community")
    return own.agg(F.array_sort(F.collect_list("label")).alias("procedures"))  # a community's procedures, not its runs
