"""Planning a run over several procedures: binding, order, what is open, what is there, and the text of each step."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import danger
from .carry_out import Executor, carry_out, check_conditions, probe, refuse
from .procedures import bind, compose, gaps


@dataclass
class Plan:
    """Steps in order (name, step, kind, text, danger), open slots, unmet conditions, commands that are missing, and reasons to refuse."""

    steps: list[tuple]
    open: list[tuple]
    unmet: list[tuple]
    missing: list[str]
    refusals: list[str] = field(default_factory=list)


def plan(procs: DataFrame, order: list[str], present: DataFrame, folder: str, values: dict[str, str] | None = None, run: Executor = refuse, environment: dict[str, str] | None = None, allow_dangerous: bool = False) -> Plan:
    """A plan for the named procedures, one after the other, with values for all of them.

    procs: procedures; present: path, is_dir of what is there. A condition that an earlier step of the
    plan provides isn't asked for. Commands are probed through the port; with none they are unknown, not
    missing. A plan is for the few procedures that someone names, so it comes to the driver as a whole.
    """
    places = procs.sparkSession.createDataFrame([(n, k) for k, n in enumerate(order)], "name string, place int")
    own = procs.join(F.broadcast(places), "name")
    found = {r.name for r in own.select("name").distinct().collect()}
    given = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.create_map().cast("map<string,string>")
    bound = bind(own.withColumn("assigned", given), environment if environment is not None else {})
    texts = compose(bound, quote=True)
    kinds = bound.select("name", "place", F.posexplode("steps").alias("step", "s")).select("name", "place", "step", F.col("s.kind").alias("kind"))
    d = texts.join(kinds, ["name", "step"])
    steps = [tuple(r) for r in d.select("place", "name", "step", "kind", "text", danger(F.col("text")).alias("why")).orderBy("place", "step").drop("place").collect()]
    left = [tuple(r) for r in gaps(bound, texts).orderBy("name", "slot").collect()]
    needs = bound.select("place", F.explode("contracts").alias("c")).select("place", "c.*")
    asked = needs.where("side = 'requires'").groupBy("kind", "target").agg(F.min("place").alias("place"))
    made = needs.where("side = 'provides'").groupBy("target").agg(F.min("place").alias("made"))
    asked = asked.join(made, "target", "left").where("made IS NULL OR made >= place")
    checks = check_conditions(asked.where("kind <> 'command'"), present, folder).where("status = 'unmet'")
    unmet = [(r.kind, r.target, r.path) for r in checks.orderBy("kind", "target").collect()]
    commands = [r.target for r in asked.where("kind = 'command'").select("target").distinct().orderBy("target").collect()]
    try:
        missing = [c for c, state in probe(commands, run).items() if state == "missing"]
    except PermissionError:
        missing = []
    refusals = [f"no procedure {n}" for n in order if n not in found]
    refusals += [f"{n}: {s} is open" for n, s, _, _ in left] + [f"{k} {t} isn't there" for k, t, _ in unmet] + [f"{c} isn't installed" for c in missing]
    refusals += [] if allow_dangerous else [f"{n}, step {k + 1}: {why}" for n, k, _, _, why in steps if why]
    return Plan(steps, left, unmet, missing, refusals)


def carry_out_plan(p: Plan, run: Executor = refuse, force: bool = False, **how) -> list[tuple[str, str, int, str]]:
    """The steps of a plan through a port; a plan with reasons to refuse isn't begun unless forced."""
    if p.refusals and not force:
        raise ValueError("; ".join(p.refusals))
    return carry_out([(kind, text) for _, _, kind, text, _ in p.steps], run, **how)


def shell(timeout: float = 120) -> Executor:
    """A port that runs commands in a shell of this machine; nothing uses it unless it is handed in."""
    import subprocess

    from .carry_out import Result

    def run(command: str) -> Result:
        try:
            r = subprocess.run(["/bin/sh", "-c", command], capture_output=True, text=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired as e:
            raise TimeoutError(str(e)) from e
        return Result(r.returncode, r.stdout, r.stderr)

    return run


def checks_text(p: Plan) -> str:
    """What a plan found, line by line."""
    lines = [f"{len(p.steps)} steps, {'refused' if p.refusals else 'ready'}"]
    return "\n".join(lines + [f"  - {r}" for r in p.refusals] + [f"  {k + 1}. {text}" for k, (_, _, _, text, _) in enumerate(p.steps)])


def freshness_text(rows: list[tuple[str, str]]) -> str:
    """(name, status) of procedures, the ones to look at first."""
    rank = {"stale": 0, "unknown": 1, "unchecked": 2, "fresh": 3}
    return "\n".join(f"{status:<9}  {name}" for name, status in sorted(rows, key=lambda r: (rank.get(r[1], 4), r[0])))
