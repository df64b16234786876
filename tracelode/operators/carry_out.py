"""Carrying out procedures: probes, steps and checks through ports that the caller hands in; by default every port refuses."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import DANGEROUS, danger


@dataclass(frozen=True)
class Result:
    code: int
    stdout: str = ""
    stderr: str = ""


Executor = Callable[[str], Result]


def refuse(command: str) -> Result:
    raise PermissionError(f"no executor was given for: {command}")


def probe(commands: Iterable[str], run: Executor = refuse) -> dict[str, str]:
    """command -> available (exit 0 with a place), missing (exit 1) or unknown, each asked once."""
    out = {}
    for c in sorted(set(commands)):
        try:
            r = run(f"command -v '{c}'") if re.fullmatch(r"[\w.+-]+", c) else Result(2)
            out[c] = "available" if r.code == 0 and r.stdout.strip() else "missing" if r.code == 1 else "unknown"
        except (OSError, TimeoutError):
            out[c] = "unknown"
    return out


def carry_out(steps: Iterable[tuple[str, str]], run: Executor = refuse, allow_dangerous: bool = False, commands_only: bool = False, go_on: bool = False) -> list[tuple[str, str, int, str]]:
    """(text, status, code, output) of steps (kind, text), stopping at the first that isn't carried out.

    ok or failed for commands, refused for dangerous ones, agent for steps that no shell can run (with
    commands_only they are skipped and it goes on), skipped for what comes after the stop.
    """
    out, stopped = [], False
    for kind, text in steps:
        why = next((w for rule, w in DANGEROUS if re.search(rule.replace(r"\z", r"\Z"), text)), None)
        if stopped:
            out.append((text, "skipped", -1, ""))
        elif kind != "command":
            stopped = not commands_only
            out.append((text, "skipped" if commands_only else "agent", -1, ""))
        elif why and not allow_dangerous:
            stopped = True
            out.append((text, "refused", -1, why))
        else:
            try:
                r = run(text)
            except (OSError, TimeoutError) as e:
                r = Result(1, "", str(e))
            stopped = r.code != 0 and not go_on
            out.append((text, "failed" if r.code else "ok", r.code, (r.stdout + r.stderr).strip()))
    return out


def outcome_of_steps(steps: DataFrame, run: str, order: list[str], kind: Column, text: Column, code: Column, allow_dangerous: bool = False) -> DataFrame:
    """steps with the status that carry_out() gives, from exit codes known beforehand; runs are independent."""
    own = F.when(kind != "command", "agent").when(danger(text).isNotNull() & F.lit(not allow_dangerous), "refused").when(code == 0, "ok").otherwise("failed")
    before = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    stopped = F.coalesce(F.max((own != "ok").cast("int")).over(before), F.lit(0)) == 1
    return steps.withColumn("status", F.when(stopped, "skipped").otherwise(own))


def check_conditions(conditions: DataFrame, present: DataFrame, folder: str, home: str = "~") -> DataFrame:
    """kind, target, path, status of distinct conditions against what is present: path, is_dir.

    Files and folders are met or unmet; anything else, and targets with an open slot, are unverifiable.
    """
    c = conditions.select("kind", "target").distinct()
    within = F.regexp_replace("target", r"^(\./)+", "")
    path = F.when(F.col("target").startswith("/"), F.col("target")).when(F.col("target").startswith("~"), F.concat(F.lit(home), F.substring("target", 2, 1 << 30))).otherwise(F.concat(F.lit(posixpath.join(folder, "")), within))
    c = c.withColumn("path", F.when(F.col("kind").isin("file", "dir") & ~F.col("target").contains("{{"), path))
    d = c.join(present.select("path", "is_dir").distinct(), "path", "left")
    met = F.col("is_dir").isNotNull() & ((F.col("kind") == "file") | F.col("is_dir"))
    return d.select("kind", "target", "path", F.when(F.col("path").isNull(), "unverifiable").when(met, "met").otherwise("unmet").alias("status"))


def run_validators(validators: DataFrame, key: str, run: Executor = refuse, most: int = 10_000) -> DataFrame:
    """key, exit_code, stderr for freshness(): each distinct command is run once, through the port, on the driver.

    Only the distinct commands come to the driver, as that is where the port is; more than most of them
    raise, so that no run starts that can't end. What can't be run counts as not to be told.
    """
    commands = [r.command for r in validators.select("command").distinct().limit(most + 1).collect()]
    if len(commands) > most:
        raise ValueError(f"more than {most} commands to run: choose the procedures first")
    seen: list[tuple[str, int, str]] = []
    for c in sorted(commands, key=lambda x: x or ""):
        try:
            got = run(c)
            seen.append((c, got.code, got.stderr))
        except (OSError, TimeoutError) as e:
            seen.append((c, 127, str(e)))
    told = validators.sparkSession.createDataFrame(seen, "command string, exit_code int, stderr string")
    d = validators.select(key, "command").join(F.broadcast(told.withColumnRenamed("command", "told")), F.col("command").eqNullSafe(F.col("told")))
    return d.select(key, "exit_code", "stderr")
