"""Procedures: what the runs of one task share, with slots, parameters and optional steps; composing, cutting and storing them."""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.rules import conditions
from ..functions.templates import KINDS, SLOT, _named_content, filled, hint, slot_kind
from ..functions.text import ABSOLUTE
from ..plans.lineage import python_path
from .procedure import first_by_priority
from .skeleton import aligned_to_medoid

PROCEDURE = (
    "name string, status string, observations long, successes long, failures long, noise long, orthogonality double, "
    "steps array<struct<key: string, verb: string, kind: string, template: string, support: double>>, "
    "slots array<struct<name: string, step: long, kind: string, variance: double, fillers: array<struct<value: string, observed_in: long, sources: array<string>>>>>, "
    "parameters array<struct<name: string, kind: string, enumerated: boolean, members: array<struct<step: long, slot: string>>, "
    "variants: array<struct<label: string, observed_in: long, values: array<string>, sources: array<string>>>>>, "
    "optional array<struct<template: string, observed_in: long, of: long, before: long, conditions: array<struct<name: string, value: string>>>>, "
    "contracts array<struct<side: string, kind: string, target: string, note: string>>"
)
COLUMNS = "name status observations successes failures noise orthogonality steps slots parameters optional contracts".split()
LISTS = COLUMNS[7:]
#: Names that say nothing of what they stand for.
GENERIC = re.compile(r"arg\d?|path[23]?|file|target")


def _free_name(base: str, used: set[str]) -> str:
    name = next(n for n in [base, *[f"{base}{i}" for i in range(2, len(used) + 3)]] if n not in used)
    used.add(name)
    return name


def unify(runs: list[list[dict]]) -> None:
    """Words that differ between runs in commands of one verb and length become slots, in place.

    Only where key and template agree word for word, and not in compound commands; groups of one
    run say nothing.
    """
    groups: dict[tuple, list[tuple[int, dict]]] = defaultdict(list)
    for r, steps in enumerate(runs):
        for s in steps:
            words = s["key"].split(" ")
            if s["kind"] == "command" and len(words) == len(s["template"].split(" ")) and not re.search("&&|[|;]", s["key"]):
                groups[s["verb"], len(words)].append((r, s))
    for own in groups.values():
        if len({r for r, _ in own}) < 2:
            continue
        keys = [s["key"].removeprefix("bash::").split(" ") for _, s in own]
        texts = [s["template"].split(" ") for _, s in own]
        used = {n for _, s in own for n in s["values"]}
        for at in range(len(keys[0])):
            if len({k[at] for k in keys}) < 2 or any(k[at] != t[at] or "{{" in t[at] or "<*>" in t[at] for k, t in zip(keys, texts, strict=True)):
                continue
            before = keys[0][at - 1] if at else ""
            base = before.lstrip("-").replace("-", "_") if re.fullmatch(r"--?[A-Za-z][\w-]*", before) else _named_content(own[0][1]["verb"], keys[0], at)
            name = _free_name(base, used)
            for (_, s), k, t in zip(own, keys, texts, strict=True):
                s["values"][name], s["kinds"][name] = k[at], slot_kind(name, k[at])
                k[at], t[at] = "<*>", f"{{{{{name}}}}}"
        for (_, s), k, t in zip(own, keys, texts, strict=True):
            s["key"], s["template"] = "bash::" + " ".join(k), " ".join(t)


def _together(a: dict, b: dict) -> bool:
    """Whether two slots' values are in bijection over the runs that have both (two at least, of two values or more)."""
    pairs = {(a[r], b[r]) for r in a.keys() & b.keys()}
    return len(a.keys() & b.keys()) >= 2 and len(pairs) >= 2 and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)


def _parameters(matrix: dict[tuple[int, str], dict[int, str]], kinds: dict, ids: list[str]) -> list[dict]:
    group = {k: k for k in matrix}
    for a, b in combinations(matrix, 2):
        if group[a] != group[b] and _together(matrix[a], matrix[b]):
            gone = group[b]
            group = {k: group[a] if g == gone else g for k, g in group.items()}
    out, used = [], set()
    for root in dict.fromkeys(group.values()):
        members = sorted(k for k in matrix if group[k] == root)
        names = [slot for _, slot in members]
        name = _free_name(next((n for n in names if not GENERIC.fullmatch(n)), names[0]), used)
        seen: dict[tuple, list[str]] = {}
        for r, run in enumerate(ids):
            if all(r in matrix[m] for m in members):
                seen.setdefault(tuple(matrix[m][r] for m in members), []).append(run)
        if len(seen) < 2:
            continue
        variants = [{"label": v[0], "observed_in": len(s), "values": list(v), "sources": s} for v, s in sorted(seen.items(), key=lambda x: -len(x[1]))]
        kind = "choice" if len(members) > 1 else kinds[members[0]]
        out.append({"name": name, "kind": kind, "enumerated": len(members) > 1, "members": [{"step": i, "slot": n} for i, n in members], "variants": variants})
    return sorted(out, key=lambda p: -len(p["members"]))


def _optional(runs: list[list[dict]], m: int, aligned: list, place: dict[int, int], matrix: dict) -> list[dict]:
    """Steps outside the skeleton, with the slot values that tell the runs that have them from the others.

    What another run shares with the medoid is counted at the medoid only.
    """
    having: dict[str, list[int]] = {}
    first: dict[str, tuple[dict, int, int | None]] = {}
    for r, steps in enumerate(runs):
        matched = set(place) if r == m else {j for _, j in aligned[r]}
        after = sorted((j, place[i]) for i, j in aligned[r] if i in place)
        for j, s in enumerate(steps):
            if j in matched:
                continue
            if r not in having.setdefault(s["key"], []):
                having[s["key"]].append(r)
            first.setdefault(s["key"], (s, r, next((at for k, at in after if k > j), None)))
    names, out = {n for _, n in matrix}, []
    for key, own in having.items():
        s, r, before = first[key]
        template = filled(s["template"], {n: v for n, v in s["values"].items() if n not in names})
        told = {}
        for (_, name), values in matrix.items():
            inside, outside = {v for k, v in values.items() if k in own}, {v for k, v in values.items() if k not in own}
            if len(inside) == 1 and outside and not inside & outside:
                told[name] = next(iter(inside))
            elif values.get(r):
                template = re.sub(rf"(^|\s){re.escape(values[r])}(?=\s|$)", lambda m, n=name: f"{m[1]}{{{{{n}}}}}", template)
        out.append({"template": template, "observed_in": len(own), "of": len(runs), "before": before, "conditions": [{"name": n, "value": v} for n, v in told.items()]})
    return sorted(out, key=lambda o: -o["observed_in"])


def generalise(name: str, runs: list[tuple[str, str | None, list[dict]]], least: float = 0.6) -> dict:
    """The procedure of one task from its runs (id, outcome, steps). Failed runs are counted, and left out unless all failed.

    Steps: key, verb, kind, template, noise, values and kinds by slot name. A slot on whose value all
    agree becomes text, but for credentials, facts of the environment and absolute paths.
    """
    status = Counter(s for _, s, _ in runs)
    kept = [r for r in runs if r[1] != "failed"] or runs
    ids = [i for i, _, _ in kept]
    steps = [[{**s, "values": dict(s["values"]), "kinds": dict(s["kinds"])} for s in own if not s["noise"]] for _, _, own in kept]
    unify(steps)
    m, aligned = aligned_to_medoid([[s["key"] for s in own] for own in steps])
    at = [dict(pairs) for pairs in aligned]
    support = {i: sum(i in a for a in at) for i in range(len(steps[m]))}
    shared = [i for i, n in support.items() if n >= least * len(kept)]
    place = {i: k for k, i in enumerate(shared)}
    out, slots, matrix, kinds = [], [], {}, {}
    for k, i in enumerate(shared):
        step, seen = steps[m][i], defaultdict(dict)
        for r, a in enumerate(at):
            if i in a:
                for slot, value in steps[r][a[i]]["values"].items():
                    seen[slot][r] = value
        template = step["template"]
        for slot, values in seen.items():
            kind = step["kinds"].get(slot) or slot_kind(slot, next(iter(values.values())))
            some = Counter(values.values()).most_common()
            if len(some) == 1 and kind not in ("secret", "env") and not (kind == "path" and re.search(ABSOLUTE, some[0][0])):
                template = template.replace(f"{{{{{slot}}}}}", some[0][0])
                continue
            fillers = [{"value": v, "observed_in": n, "sources": [ids[r] for r in values if values[r] == v]} for v, n in some]
            slots.append({"name": slot, "step": k, "kind": kind, "variance": 1 - some[0][1] / len(kept), "fillers": fillers})
            matrix[k, slot], kinds[k, slot] = values, kind
        out.append({**{c: step[c] for c in ("key", "verb", "kind")}, "template": template, "support": support[i] / len(kept)})
    longest = max(map(len, steps))
    ends = {"success": status["success"] > 0, "failed": status["failed"] > 0}
    told = "failed" if status["failed"] == len(runs) else "success" if status["success"] == len(runs) else "mixed" if any(ends.values()) else "unknown"
    contracts = list(dict.fromkeys(c for s in out if s["kind"] == "command" for c in conditions(s["template"])))
    first = {c[:3]: c for c in reversed(contracts)}
    return {
        "name": name, "status": told, "observations": len(kept), "successes": status["success"], "failures": status["failed"],
        "noise": sum(s["noise"] for _, _, own in kept for s in own), "orthogonality": len(out) / longest if longest else 0.0,
        "steps": out, "slots": slots, "parameters": _parameters(matrix, kinds, ids), "optional": _optional(steps, m, aligned, place, matrix),
        "contracts": [dict(zip(("side", "kind", "target", "note"), c, strict=True)) for k, c in first.items()][::-1],
    }


def procedures(steps: DataFrame, least: float = 0.6) -> DataFrame:
    """One procedure for each family of steps: family, run, outcome, seq and the columns of templates.STEP.

    A family is the handful of recordings of one task, so it is one group; families are independent.
    """
    python_path(steps.sparkSession)

    def of(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        runs = []
        for run, own in rows.sort_values(["run", "seq"]).groupby("run", sort=True):
            made = [{"key": s.key, "verb": s.verb, "kind": s.kind, "template": s.template, "noise": bool(s.noise), "values": {x["name"]: x["value"] for x in s.slots}, "kinds": {x["name"]: x["kind"] for x in s.slots}} for s in own.itertuples()]
            runs.append((str(run), own.outcome.iloc[0], made))
        return pd.DataFrame([generalise(str(key[0]), runs, least)], columns=COLUMNS)

    d = steps.select("family", "run", "outcome", "seq", "key", "verb", "kind", "template", "noise", F.coalesce("slots", F.array()).alias("slots"))
    return d.where("family is not null").groupBy("family").applyInPandas(of, PROCEDURE)


def composed(procedure: dict, values: dict[str, str], quote: bool = False) -> list[str]:
    """The steps' texts with slots filled from values: a slot's own value, or its parameter's variant by label (exact, then any case).

    A free parameter takes any value; an enumerated one of unknown label is an error.
    """
    given: dict[tuple[int, str], str] = {}
    for p in procedure["parameters"]:
        if (want := values.get(p["name"])) is None:
            continue
        found = next((v for same in (str, str.lower) for v in p["variants"] if same(v["label"]) == same(want)), None)
        if found is not None:
            given |= {(m["step"], m["slot"]): x for m, x in zip(p["members"], found["values"], strict=True)}
        elif not p["enumerated"]:
            given[p["members"][0]["step"], p["members"][0]["slot"]] = want
        else:
            raise ValueError(f"{p['name']}: one of {', '.join(v['label'] for v in p['variants'])}")
    out = []
    for k, s in enumerate(procedure["steps"]):
        own = {n: values.get(n, given.get((k, n))) for n in SLOT.findall(s["template"])}
        out.append(filled(s["template"], {n: v for n, v in own.items() if v is not None}, quote))
    return out


def compose(procs: DataFrame, quote: bool = False) -> DataFrame:
    """name, step, text of procedures with a column ``assigned`` (map of names to values; null: none)."""
    python_path(procs.sparkSession)

    @F.pandas_udf(ArrayType(StringType()))
    def texts(own: pd.DataFrame, assigned: pd.Series) -> pd.Series:
        rows = own.to_dict("records")
        return pd.Series([composed(p, {} if a is None else dict(a), quote) for p, a in zip(rows, assigned, strict=True)])

    return procs.select("name", F.posexplode(texts(F.struct("steps", "parameters"), "assigned")).alias("step", "text"))


def gaps(procs: DataFrame, texts: DataFrame) -> DataFrame:
    """name, slot, kind, hint of the slots that compose() left open; of several kinds the gravest, choice for members of enumerated parameters."""
    left = texts.select("name", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(SLOT.pattern), F.lit(1)))).alias("slot")).distinct()
    own = procs.select("name", F.explode("slots").alias("s")).select("name", F.col("s.name").alias("slot"), F.col("s.kind").alias("kind"))
    p = procs.select("name", F.explode("parameters").alias("p")).select("name", F.col("p.name").alias("parameter"), F.col("p.enumerated").alias("many"), F.col("p.variants").alias("v"), F.explode("p.members").alias("m"))
    grouped = p.where("many").select("name", F.col("m.slot").alias("slot"), F.concat(F.lit("part of parameter "), "parameter", F.lit(": choose one of "), F.array_join(F.transform("v", lambda x: x["label"]), ", ")).alias("choose"))
    grouped = grouped.groupBy("name", "slot").agg(F.first("choose").alias("choose"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    known = own.unionByName(grouped.select("name", "slot", F.lit("choice").alias("kind"))).groupBy("name", "slot").agg(F.min_by("kind", rank).alias("kind"))
    d = left.join(known, ["name", "slot"], "left").join(grouped, ["name", "slot"], "left").withColumn("kind", F.coalesce("kind", F.lit("free")))
    return d.select("name", "slot", "kind", F.coalesce("choose", hint(F.col("kind"), F.col("slot"))).alias("hint"))


def bind(procs: DataFrame, environment: dict[str, str] | None = None, prefixes: tuple[str, ...] = ("",)) -> DataFrame:
    """procs with ``assigned`` completed from the environment: secrets and facts of the environment by their upper-case name.

    Names as common as NAME or the shell's own variables are never taken.
    """
    env = dict(os.environ if environment is None else environment)
    skip = {"PATH", "HOME", "USER", "SHELL", "PWD", "LANG", "TERM", "HOSTNAME", "NAME", "ARG", "FILE", "TARGET", "TYPE", "MODE", "VALUE", "ID"}
    texts = compose(procs)
    open_ = gaps(procs, texts).where(F.col("kind").isin("secret", "env"))
    known = {k: v for k, v in env.items() if v and k not in skip}
    table = procs.sparkSession.createDataFrame([(k, v) for k, v in known.items()], "variable string, value string")
    names = F.array(*[F.concat(F.lit(p), F.upper("slot")) for p in prefixes])
    found = open_.select("name", "slot", F.posexplode(names).alias("nth", "variable")).join(F.broadcast(table), "variable")  # as small as the environment
    one = found.groupBy("name", "slot").agg(F.min_by("value", "nth").alias("value"))
    extra = one.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("extra"))
    none = F.create_map().cast("map<string,string>")
    given = F.coalesce("assigned", none)
    fresh = F.map_filter(F.coalesce("extra", none), lambda k, _: ~F.map_contains_key(given, k))
    return procs.join(extra, "name", "left").withColumn("assigned", F.map_concat(given, fresh)).drop("extra")


def cut_segments(procs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Segments of procedures, as procedures with intent and dropped, by cuts: name, segment, intent, begin, end (steps from 0, both inside).

    Overlaps and ranges outside the steps raise. Parameters with members on both sides are named in
    ``dropped``. Slots and members count from the segment's first step.
    """
    w = Window.partitionBy("name").orderBy("begin", "end")
    fault = F.when((F.col("begin") < 0) | (F.col("end") < F.col("begin")) | (F.col("end") >= F.size("steps")), "no range of steps: ").when(F.lag("end").over(w) >= F.col("begin"), "overlapping: ")
    d = procs.join(cuts.select("name", "segment", "intent", "begin", "end"), "name").withColumn("fault", F.concat(fault, F.col("segment")))
    d = d.withColumn("begin", F.when(F.col("fault").isNotNull(), F.raise_error(F.col("fault")).cast("long")).otherwise(F.col("begin").cast("long")))
    inside = lambda m: m["step"].between(F.col("begin"), F.col("end"))
    moved = lambda s: s.withField("step", s["step"] - F.col("begin"))
    kept = F.filter("parameters", lambda p: F.forall(p["members"], inside))
    torn = F.filter("parameters", lambda p: F.exists(p["members"], inside) & ~F.forall(p["members"], inside))
    steps = F.slice("steps", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin") + 1).cast("int"))
    shape: dict[str, Column] = {
        "name": F.col("segment"),
        "observations": F.lit(1).cast("long"),
        "orthogonality": F.lit(0.0),
        "steps": steps,
        "slots": F.transform(F.filter("slots", inside), moved),
        "parameters": F.transform(kept, lambda p: p.withField("members", F.transform(p["members"], moved))),
        "optional": F.filter("optional", lambda o: F.lit(False)),
        "contracts": F.filter("contracts", lambda c: F.exists(steps, lambda s: s["template"].contains(c["note"]))),
    }
    return d.select(*[shape.get(c, F.col(c)).alias(c) for c in COLUMNS], F.coalesce("intent", F.lit("")).alias("intent"), F.transform(torn, lambda p: p["name"]).alias("dropped"))


def save(procs: DataFrame, folder: str, scope: str) -> None:
    """Procedures as JSON lines below folder/scope; what was there is replaced. Where they have saved_at (load(dated=True)) they keep it, others get the present time."""
    now = F.current_timestamp()
    saved = F.coalesce(F.col("saved_at"), now) if "saved_at" in procs.columns else now
    procs.select(*COLUMNS, saved.alias("saved_at")).write.mode("overwrite").json(f"{folder}/{scope}")


def load(spark: SparkSession, folder: str, scopes: tuple[str, ...] = ("project", "global"), dated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(procedures with scope, broken rows): of one name, that of the first scope; a row that isn't a procedure is kept apart.

    dated: with saved_at too; a row that doesn't tell when it was saved is as old as its file.
    """
    read = None
    for rank, scope in enumerate(scopes):
        d = spark.read.text(f"{folder}/{scope}").select(F.lit(scope).alias("scope"), F.lit(rank).alias("rank"), "value", F.from_json("value", PROCEDURE).alias("p"), F.coalesce(F.from_json("value", "saved_at timestamp")["saved_at"], F.col("_metadata.file_modification_time")).alias("saved_at"))
        read = d if read is None else read.unionByName(d)
    sound = F.col("p.name").isNotNull() & F.col("p.steps").isNotNull()
    kinds = {f.name: f.dataType for f in read.schema["p"].dataType.fields}
    backfilled = [(F.coalesce(f"p.{c}", F.array().cast(kinds[c])) if c in LISTS else F.col(f"p.{c}")).alias(c) for c in COLUMNS]
    good = first_by_priority(read.where(sound).select("scope", "rank", "saved_at", *backfilled), "name", "rank", "status").drop("rank", *([] if dated else ["saved_at"]))
    return good, read.where(~F.coalesce(sound, F.lit(False))).select("scope", "value")


def find(procs: DataFrame, wanted: list[str]) -> DataFrame:
    """wanted, name: for each name that is wanted the procedure of exactly this name, else the first by name that holds it in any case. Without one: no row."""
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(wanted)]).cast("array<string>")
    rank = F.when(F.col("name") == F.col("wanted"), 0).when(F.contains(F.lower("name"), F.lower("wanted")), 1)
    met = procs.select("name", F.explode(asked).alias("wanted")).withColumn("rank", rank).where("rank IS NOT NULL")
    return met.groupBy("wanted").agg(F.min(F.struct("rank", "name")).alias("best")).select("wanted", F.col("best.name").alias("name"))


def documents(procs: DataFrame) -> DataFrame:
    """name, text: what search() finds procedures by: names, steps, slots with their values, parameters with their variants, contracts."""
    parts = [
        F.array("name"),
        F.transform("steps", lambda s: s["template"]),
        F.flatten(F.transform("slots", lambda s: F.concat(F.array(s["name"]), F.transform(s["fillers"], lambda f: f["value"])))),
        F.flatten(F.transform("parameters", lambda p: F.concat(F.array(p["name"]), F.transform(p["variants"], lambda v: v["label"])))),
        F.transform("contracts", lambda c: c["target"]),
    ]
    return procs.select("name", F.array_join(F.flatten(F.array(*parts)), " ").alias("text"))
