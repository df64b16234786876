"""Command line: ``python -m tracelode.cli COMMAND ...``; results are printed as JSON lines."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import registry
from .functions import canonical, names, rules
from .operators import carry_out, compare, extract, freshness, link, lookup, plan, procedures, record, search, stats, store, trace
from .plans import lineage
from .sources import traces

#: Commands that print so many rows unless told otherwise, and how many more there are; the others print all.
LISTINGS, LISTED = ("sessions", "search"), 25


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelode", description=__doc__)
    p.add_argument("--limit", type=int, help=f"rows to print (sessions and search: {LISTED}, others: all)")
    c = p.add_subparsers(dest="command", required=True)
    for name, said in (("sessions", "list trace files, newest first"), ("show", "entries of the trace that REF resolves to"), ("entries", "entries of trace files")):
        own = c.add_parser(name, help=said)
        own.add_argument("pattern")
        if name == "show":
            own.add_argument("ref", nargs="?")
    c.add_parser("inspect", help="entries of recordings").add_argument("paths", nargs="+")
    c.add_parser("kinds", help="rows by type of trace files").add_argument("pattern")
    own = c.add_parser("search", help="rank the traces of a pattern by a query")
    own.add_argument("pattern")
    own.add_argument("terms", nargs="+")
    own = c.add_parser("find", help="rank stored procedures by a query, under a budget of tokens")
    own.add_argument("folder")
    own.add_argument("terms", nargs="+")
    own.add_argument("--budget", type=int, default=1200)
    own = c.add_parser("record", help="write recordings of traces below a folder")
    own.add_argument("pattern")
    own.add_argument("folder")
    own.add_argument("--profile", choices=record.PROFILES, default="normal")
    own.add_argument("--redact", action="store_true")
    own = c.add_parser("learn", help="the procedure that the traces of a pattern share")
    own.add_argument("pattern")
    own.add_argument("name")
    own.add_argument("--save", help="folder of procedures; written as scope 'global'")
    own = c.add_parser("compose", help="steps of a stored procedure, with NAME=VALUE filled in")
    own.add_argument("folder")
    own.add_argument("name")
    own.add_argument("values", nargs="*")
    own.add_argument("--quote", action="store_true", help="quote the values for a shell")
    c.add_parser("rules", help="packs of step rules")
    c.add_parser("verify", help="whether recordings replay themselves; exit 2 if one doesn't").add_argument("paths", nargs="+")
    own = c.add_parser("diff", help="where two recordings first differ")
    own.add_argument("left")
    own.add_argument("right")
    for name, said in (("library", "stored procedures"), ("procedure", "one stored procedure"), ("link", "what stored procedures require, and which of them provides it"), ("segment", "segments of a stored procedure, or what to cut it by"), ("run", "plan a run over stored procedures; carry it out with --yes"), ("check", "run the checks of stored procedures"), ("index", "state of the index of stored procedures")):
        own = c.add_parser(name, help=said)
        own.add_argument("folder")
        if name in ("procedure", "segment"):
            own.add_argument("name")
        if name in ("link", "run", "check"):
            own.add_argument("names", nargs="*" if name == "check" else "+")
        if name == "segment":
            own.add_argument("--cut", action="append", default=[], metavar="FROM-TO=NAME[:INTENT]")
            own.add_argument("--require-coverage", action="store_true", help="fail where a step is in no segment")
            own.add_argument("--save", help="folder of procedures; written as scope 'global'")
        if name == "run":
            own.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
            own.add_argument("--cwd", default=".")
            for flag in ("--yes", "--force", "--allow-dangerous", "--go-on", "--commands-only"):
                own.add_argument(flag, action="store_true")
        if name in ("run", "check"):
            own.add_argument("--timeout", type=float, default=120 if name == "run" else 20)
        if name == "check":
            own.add_argument("--dry-run", action="store_true", help="only list the checks")
            own.add_argument("--max-age-days", type=float, default=30, help="older procedures are trusted less")
        if name == "index":
            own.add_argument("at")
            own.add_argument("--write", action="store_true", help="rebuild it where it is stale")
    own = c.add_parser("query", help="run a registered query")
    own.add_argument("name", choices=sorted(registry.queries()))
    own.add_argument("sf_dir")
    return p


def _steps(spark: SparkSession, pattern: str, name: str) -> DataFrame:
    """Steps of all traces of a pattern as runs of one task; the outcome of each stays open."""
    e = traces.read_entries(spark, pattern)
    d = extract.call_steps(traces.calls_of(e), traces.results_of(e), ["trace"], ["line", "block"])
    seq = F.row_number().over(Window.partitionBy("trace").orderBy("line", "block", "part"))
    return d.withColumns({"family": F.lit(name), "run": F.col("trace"), "outcome": F.lit(None).cast("string"), "seq": seq})


def _messages(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Messages of recordings: rec, seq, role, text (all that counts of a message, in canonical form)."""
    e = traces.read_recordings(spark, paths).where("try_variant_get(entry, '$.type', 'string') = 'message'")
    said = canonical.comparable_text(F.to_json(F.try_variant_get("entry", "$.message", "variant")))
    return e.select(F.col("path").alias("rec"), "seq", F.try_variant_get("entry", "$.message.role", "string").alias("role"), said.alias("text"))


def _lines(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.split("\n")], "text string")


def _named(spark: SparkSession, folder: str, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """Stored procedures and their names, in the order in which they are wanted (by a part of their names, too); all of them where none is."""
    own = procedures.load(spark, folder, ("global",), dated=True)[0]
    if not wanted:
        return own, []
    found = {r.wanted: r.name for r in procedures.find(own, wanted).collect()}  # at most the names given
    if lost := [w for w in wanted if w not in found]:
        raise SystemExit(f"no procedure {', '.join(sorted(lost))}")
    real = list(dict.fromkeys(found[w] for w in wanted))
    return own.where(F.col("name").isin(real)), real


def _assigned(given: list[str]) -> dict[str, str]:
    if wrong := [g for g in given if "=" not in g]:
        raise SystemExit(f"NAME=VALUE is wanted, not {wrong[0]}")
    return dict(g.split("=", 1) for g in given)


def _segments(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    procs, (name,) = _named(spark, a.folder, [a.name])
    own = procs.first().asDict(recursive=True)
    if not a.cut:
        return _lines(spark, names.evidence_text(own))
    cuts = []
    for text in a.cut:
        place, _, rest = text.partition("=")
        segment, _, intent = rest.partition(":")
        cuts.append((name, segment or f"{name} {place}", intent, *names.parse_range(place)))
    covered = {k for *_, begin, end in cuts for k in range(begin, end + 1)}
    if a.require_coverage and (left := [k for k in range(len(own["steps"])) if k not in covered]):
        raise SystemExit("in no segment: " + ", ".join(names.describe_cut(k, k) for k in left))
    made = procedures.cut_segments(procs, spark.createDataFrame(cuts, "name string, segment string, intent string, begin int, end int"))
    if a.save:
        procedures.save(made, a.save, "global")
    return made


def _run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    here = [(str(p), p.is_dir()) for p in sorted(Path(a.cwd).resolve().rglob("*"))]
    present = spark.createDataFrame(here, "path string, is_dir boolean")
    port = plan.shell(a.timeout) if a.yes else carry_out.refuse
    p = plan.plan(*_named(spark, a.folder, a.names), present, str(Path(a.cwd).resolve()), _assigned(a.set), port, dict(os.environ), a.allow_dangerous)
    if not a.yes or (p.refusals and not a.force):
        return _lines(spark, plan.checks_text(p))
    done = plan.carry_out_plan(p, port, a.force, allow_dangerous=a.allow_dangerous, commands_only=a.commands_only, go_on=a.go_on)
    return spark.createDataFrame(done, "text string, status string, code int, output string")


def _check(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    procs, _ = _named(spark, a.folder, a.names)
    slots = F.transform(F.filter("slots", lambda s: s["step"] == F.col("nth")), lambda s: F.struct(s["name"], F.get(s["fillers"], F.lit(0))["value"].alias("value"), s["kind"]))
    steps = procs.select("name", "slots", F.posexplode("steps").alias("nth", "s")).select("name", "nth", F.col("s.verb").alias("verb"), slots.alias("slots"))
    asked = freshness.validators(steps, "name", ["nth"])
    if a.dry_run:
        return asked.orderBy("name", "nth")
    got = carry_out.run_validators(asked, "name", plan.shell(a.timeout))
    age = (F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("saved_at")) / 86400
    told = freshness.freshness(procs.select("name", age.alias("age_days")), got, "name", a.max_age_days)
    return _lines(spark, plan.freshness_text([tuple(r) for r in told.collect()]))


def _index(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    was = store.stale(spark, a.folder, a.at, ("global",))
    index = store.refreshed(spark, a.folder, a.at, ("global",)) if a.write else store.read_index(spark, a.at)
    counts = [("stale", int(was)), ("stored", store.count_stored(spark, a.folder, ("global",))), *((p, d.count()) for p, d in (index or {}).items())]
    return spark.createDataFrame(counts, "part string, n long")


def result(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What a command prints."""
    if a.command == "verify":
        hashed = trace.prefix_digests(_messages(spark, a.paths), ["rec"], "seq", "role", "text")
        return lookup.verified(hashed.where("role = 'assistant'").select("rec", "seq", F.col("prefix_digest").alias("hash"))).orderBy("rec")
    if a.command == "diff":
        left, right = (_messages(spark, [p]).select("rec", F.row_number().over(Window.partitionBy("rec").orderBy("seq")).alias("pos"), F.md5("text").alias("fp")) for p in (a.left, a.right))
        pair = left.select(F.col("rec").alias("l")).limit(1).crossJoin(right.select(F.col("rec").alias("r")).limit(1))  # one row
        return compare.positional_diff(pair, left, right).withColumn("common_prefix", F.col("common_prefix") - 1)
    if a.command == "library":
        good, broken = procedures.load(spark, a.folder, ("global",))
        if n := broken.count():
            print(f"{n} rows are no procedures", file=sys.stderr)
        return good.select("name", "scope", "status", "observations", F.size("steps").alias("steps"), F.transform("parameters", lambda p: p["name"]).alias("parameters")).orderBy("name")
    if a.command == "procedure":
        return _named(spark, a.folder, [a.name])[0]
    if a.command == "link":
        procs, real = _named(spark, a.folder, a.names)
        place = F.array_position(F.array(*[F.lit(n) for n in real]), F.col("name"))
        needs = procs.select("name", place.alias("place"), F.explode("contracts").alias("c")).select("name", "place", "c.side", "c.target")
        return link.link_requirements(needs, "target", ["place"], F.col("side") == "provides", F.col("side") == "requires", "name").orderBy("requirement", "target")
    if a.command in ("segment", "run", "check", "index"):
        return {"segment": _segments, "run": _run, "check": _check, "index": _index}[a.command](spark, a)
    if a.command == "sessions":
        return traces.list_traces(spark, a.pattern)
    if a.command == "show":
        found = traces.resolve_trace(traces.list_traces(spark, a.pattern), a.ref).first()
        if found is None:
            raise SystemExit("no such trace")
        return traces.read_entries(spark, found.path)
    if a.command == "entries":
        return traces.read_entries(spark, a.pattern)
    if a.command == "inspect":
        return traces.read_recordings(spark, a.paths)
    if a.command == "kinds":
        return stats.tool_weights(traces.read_entries(spark, a.pattern).selectExpr("type", "to_json(raw) AS body"), "type", "body")
    if a.command == "search":
        lines = traces.trace_lines(spark, a.pattern).groupBy("trace").agg({"value": "collect_list"}).toDF("trace", "lines")
        return search.search(lines.selectExpr("trace", "array_join(lines, ' ') AS body"), "trace", "body", [t.lower() for t in a.terms], None)
    if a.command == "find":
        procs = procedures.load(spark, a.folder, ("global",))[0]
        texts = procedures.documents(procs)
        ranked = search.search(texts, "name", "text", [t.lower() for t in a.terms], LISTED if a.limit is None else a.limit)
        said = ranked.join(texts, F.col("doc") == F.col("name")).select(F.lit(1).alias("query"), "name", "score", "matched", "text", (-F.col("score")).alias("rank"))
        return search.within_budget(said, "query", ["rank", "name"], "text", a.budget).orderBy("rank", "name").drop("query", "rank", "tokens", "used")
    if a.command == "record":
        paths = record.active_paths(traces.read_entries(spark, a.pattern))
        return record.read_packed(spark, record.write_recordings(record.record(paths, a.profile, a.redact), a.folder))
    if a.command == "learn":
        learnt = procedures.procedures(_steps(spark, a.pattern, a.name))
        if a.save:
            procedures.save(learnt, a.save, "global")
            learnt = procedures.load(spark, a.save, ("global",))[0]
        return learnt
    if a.command == "compose":
        given = _assigned(a.values)
        own, _ = _named(spark, a.folder, [a.name])
        return procedures.compose(own.withColumn("assigned", F.lit(None).cast("map<string,string>") if not given else F.create_map(*[F.lit(x) for kv in given.items() for x in kv])), a.quote).orderBy("step")
    if a.command == "rules":
        return spark.createDataFrame(list(rules.PACKS.items()), "pack string, description string")
    return registry.queries()[a.name](spark, a.sf_dir)


def main(argv: list[str] | None = None) -> None:
    a = _arguments().parse_args(argv)
    own = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    limit = LISTED if a.limit is None and a.command in LISTINGS else a.limit
    found, more = result(spark, a), 0
    if limit is not None and a.command not in LISTINGS:
        found = found.limit(limit)
    gaps = False
    for k, row in enumerate(found.toJSON().toLocalIterator()):
        gaps = gaps or (a.command == "verify" and '"ok":false' in row)
        if limit is None or k < limit:
            print(row)
        else:
            more += 1
    if more:
        print(f"... {more} more", file=sys.stderr)
    if own:
        lineage.clean(spark)
    if gaps:
        raise SystemExit(2)


if __name__ == "__main__":
    main()
