"""Transition graphs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, python_path
from ..plans.spread import before_in_order, components, hot_keys, split_join
from .align import lcs_length


def transitions(steps: DataFrame, run: str, order: list[str], key: str) -> DataFrame:
    """Undirected weighted edges s, d, w between keys that follow each other; both directions are rows, a self-edge counts twice."""
    w = Window.partitionBy(run).orderBy(*order)
    e = steps.select(F.col(key).alias("s"), F.lead(key).over(w).alias("d")).where("d is not null").groupBy("s", "d").agg((F.count("*") * 0.5).alias("w"))
    return e.union(e.select(F.col("d").alias("s"), F.col("s").alias("d"), "w")).groupBy("s", "d").agg(F.sum("w").alias("w"))


def alike(sequences: DataFrame, least: float = 0.3) -> DataFrame:
    """a, b, share of sequences (name, keys) whose alignment is at least that share of the shorter one.

    A pair must have so many keys in common, so one of the shorter's rarest n - least * n + 1 keys is
    in the longer: only these meet. The n-th time that a key occurs is a key of its own.
    """
    s = sequences.where(F.size("keys") > 0).select("name", F.size("keys").alias("n"), F.posexplode("keys").alias("at", "key"))
    s = s.withColumn("nth", F.row_number().over(Window.partitionBy("name", "key").orderBy("at")))
    s = s.join(s.groupBy("key", "nth").agg(F.count("*").alias("df")), ["key", "nth"])
    rare = s.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("df", "key", "nth"))).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    x = rare.select("key", "nth", F.col("name").alias("x"), F.col("n").alias("nx"))
    y = s.select("key", "nth", F.col("name").alias("y"), F.col("n").alias("ny"))
    p = x.join(y, ["key", "nth"]).where((F.col("x") != F.col("y")) & (F.col("nx") <= F.col("ny"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    keys = sequences.select("name", "keys")
    python_path(sequences.sparkSession)
    p = p.join(keys.toDF("a", "ka"), "a").join(keys.toDF("b", "kb"), "b")
    return p.select("a", "b", (lcs_length(F.col("ka"), F.col("kb")) / F.least(F.size("ka"), F.size("kb"))).alias("share")).where(F.col("share") >= least)


def procedure_graph(procs: DataFrame, least: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of procedures (name, steps, parameters): procedures, steps and parameters as nodes.

    Weights: a procedure and its step 1 for each time, steps that follow each other 0.5, a procedure
    and its parameter 2, a parameter and the step of each member 1, procedures that align 4 * share.
    Edges are undirected: both directions are rows, and weights add up.
    """
    one = F.concat(F.lit("procedure:"), "name")
    at = procs.select(one.alias("p"), F.posexplode("steps").alias("at", "s")).select("p", "at", F.concat(F.lit("step:"), "s.key").alias("step"), F.col("s.verb").alias("verb"))
    q = procs.select(one.alias("p"), "name", F.explode("parameters").alias("q"))
    q = q.select("p", F.col("q.name").alias("label"), F.col("q.members").alias("members"), F.concat_ws("#", F.concat(F.lit("slot:"), "name"), F.get("q.members", F.lit(0))["step"].cast("string"), F.get("q.members", F.lit(0))["slot"]).alias("slot"))
    follows = at.select("step", F.lead("step").over(Window.partitionBy("p").orderBy("at")).alias("d")).where("step <> d")
    members = q.select("p", "slot", F.explode("members").alias("m")).join(at, ["p"]).where(F.col("at") == F.col("m.step"))
    near = alike(procs.select("name", F.transform("steps", lambda s: s["key"]).alias("keys")), least)
    pieces = [
        at.select(F.col("p").alias("s"), F.col("step").alias("d"), F.lit(1.0).alias("w")),
        follows.select(F.col("step").alias("s"), "d", F.lit(0.5).alias("w")),
        q.select(F.col("p").alias("s"), F.col("slot").alias("d"), F.lit(2.0).alias("w")),
        members.select(F.col("slot").alias("s"), F.col("step").alias("d"), F.lit(1.0).alias("w")),
        near.select(F.concat(F.lit("procedure:"), "a").alias("s"), F.concat(F.lit("procedure:"), "b").alias("d"), (F.col("share") * 4).alias("w")),
    ]
    edges = pieces[0]
    for piece in pieces[1:]:
        edges = edges.unionByName(piece)
    edges = edges.unionByName(edges.select(F.col("d").alias("s"), F.col("s").alias("d"), "w")).groupBy("s", "d").agg(F.sum("w").alias("w"))
    nodes = procs.select(one.alias("node"), F.lit("procedure").alias("kind"), F.col("name").alias("label"))
    nodes = nodes.unionByName(at.groupBy(F.col("step").alias("node")).agg(F.min("verb").alias("label")).withColumn("kind", F.lit("step")))
    return nodes.unionByName(q.select(F.col("slot").alias("node"), F.lit("slot").alias("kind"), "label").dropDuplicates(["node"])), edges


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("s").alias("node")).agg(F.sum("w").alias("degree"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Weighted modularity of a partition (node, community); one row."""
    p = partition.select(F.col("node").alias("s"), F.col("community").alias("cs"))
    e = edges.join(p, "s").join(p.select(F.col("s").alias("d"), F.col("cs").alias("cd")), "d")
    total = edges.agg(F.sum("w").alias("m2"))
    inside = e.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("own"), F.sum("w").alias("deg"))
    q = inside.join(F.broadcast(total)).agg(F.sum(F.col("own") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), F.lit(2.0))).alias("q"))
    return q.select(F.round("q", 6).alias("q"))


def page_rank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, epsilon: float = 1e-6, nodes: DataFrame | None = None) -> DataFrame:
    """node, score. Nodes (default: the ends of edges) without edges spread their mass over all.

    Stops when the scores change by less than n * epsilon in sum, or after the given rounds. The
    state of a round is a row for each node; it is cut, so the plan doesn't grow.
    """
    nodes = cut((edges.select(F.col("s").alias("node")) if nodes is None else nodes.select("node")).distinct())
    n = nodes.count()
    e = cut(edges.join(degrees(edges).withColumnRenamed("node", "s"), "s").where("degree > 0").select("s", "d", (F.col("w") / F.col("degree")).alias("share")))
    loose = nodes.join(e.select(F.col("s").alias("node")).distinct(), "node", "left_anti")
    r = nodes.withColumn("score", F.lit(1.0 / n if n else 0.0))
    for _ in range(rounds):
        spread = r.join(loose, "node", "left_semi").agg(F.sum("score")).first()[0] or 0.0
        got = r.withColumnRenamed("node", "s").join(e, "s").groupBy(F.col("d").alias("node")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = r.join(got, "node", "left").select("node", (F.lit((1 - alpha + alpha * spread) / max(n, 1)) + alpha * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("was"))
        new = cut(new)
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        r = new.drop("was")
        if change < n * epsilon:
            break
    return r


def communities(edges: DataFrame, passes: int = 40) -> DataFrame:
    """node, community by greedy single-level modularity.

    Nodes move one after the other, in order of their names, and only to communities of neighbours: so
    each connected component is by itself, given the weight of the whole graph, and is one task's work.
    Communities are numbered by their least nodes. Both directions of an edge are rows.
    """
    edges = cut(edges.select("s", "d", F.col("w").cast("double").alias("w")))
    python_path(edges.sparkSession)
    kind = dict(edges.dtypes)["s"]
    m2 = edges.agg(F.sum("w")).first()[0] or 0.0
    roots = components(edges, "s", "d").select(F.col("node").alias("s"), "root")
    hot = hot_keys(edges.groupBy("s").agg(F.count("*").alias("k")), ["s"], edges.count())
    apart = split_join(edges, roots, ["s"], hot, "left").withColumn("root", F.coalesce("root", "s"))

    def run(e: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for s, d, w in e[["s", "d", "w"]].itertuples(index=False):
            near.setdefault(s, {})[d] = near.setdefault(s, {}).get(d, 0.0) + float(w)
        ids = sorted(near)
        degree = {i: sum(near[i].values()) for i in ids}
        own = {i: k for k, i in enumerate(ids)}
        total = {k: degree[i] for i, k in own.items()}
        for _ in range(passes if m2 else 0):
            moved = False
            for i in ids:
                into: dict[int, float] = {}
                for j in sorted(near[i]):
                    into[own[j]] = into.get(own[j], 0.0) + near[i][j]
                gain = lambda c, i=i, into=into: into.get(c, 0.0) / m2 - total[c] * degree[i] * 2 / (m2 * m2)
                best, top = own[i], gain(own[i])
                for c in into:
                    if gain(c) > top:
                        best, top = c, gain(c)
                if best != own[i]:
                    total[own[i]] -= degree[i]
                    total[best] += degree[i]
                    own[i], moved = best, True
            if not moved:
                break
        least: dict[int, object] = {}
        return pd.DataFrame({"node": ids, "least": [least.setdefault(own[i], i) for i in ids]})

    found = cut(apart.groupBy("root").applyInPandas(run, f"node {kind}, least {kind}"))
    number = before_in_order(found.where("node = least").select("least", F.lit(0).alias("one")), ["one"], ["least"], F.lit(1), "community").select("least", "community")
    sizes = found.groupBy("least").agg(F.count("*").alias("k"))
    named = split_join(found, number, ["least"], hot_keys(sizes, ["least"], found.count()))
    return named.select("node", F.col("community").cast("long").alias("community"))
