"""Steps of a procedure from the calls of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.shell import _SCAN, shell_shape
from ..functions.templates import step_of
from ..plans.lineage import python_path


def sequence(command: str) -> list[str]:
    """A command cut at && and ; outside quotes; | and || stay joined."""
    parts = [""]
    for m in _SCAN.finditer(command):
        if m["op"] in ("&&", ";"):
            parts.append("")
        else:
            parts[-1] += m[0]
    return [p.strip() for p in parts if p.strip()]


def extract_steps(calls: DataFrame, results: DataFrame, rec: str = "rec", seq: str = "seq") -> DataFrame:
    """rec, seq, part, key, verb, noise, values: shapes of the shell commands whose calls didn't fail.

    calls: rec, seq, call_id, command; results: rec, call_id, is_error. A call without result counts
    as one that didn't fail.
    """
    python_path(calls.sparkSession)
    failed = results.where("is_error").select(rec, "call_id").distinct()
    cut = F.udf(lambda c: sequence(c or ""), ArrayType(StringType()), useArrow=True)
    d = calls.join(failed, [rec, "call_id"], "left_anti").select(rec, seq, F.posexplode(cut("command")).alias("part", "command"))
    return d.select(rec, seq, "part", "command", shell_shape("command").alias("shape")).select(rec, seq, "part", "command", "shape.*")


def call_steps(calls: DataFrame, results: DataFrame, rec: list[str], order: list[str], own_tools: str | None = None) -> DataFrame:
    """rec, order, part and the columns of templates.STEP for calls that didn't fail; a shell line gives a step for each command.

    calls: rec, order, call_id, tool, arguments (JSON text); results: rec, call_id, is_error. Tools
    whose name matches own_tools look the recording itself up and are left out.
    """
    python_path(calls.sparkSession)
    failed = results.where("is_error").select(*rec, "call_id").distinct()
    cut = F.udf(lambda c: sequence(c or ""), ArrayType(StringType()), useArrow=True)
    d = calls if own_tools is None else calls.where(~F.col("tool").rlike(own_tools))
    d = d.join(failed, [*rec, "call_id"], "left_anti")
    shell = (F.col("tool") == "bash") & F.get_json_object("arguments", "$.command").isNotNull()
    lines = F.transform(cut(F.get_json_object("arguments", "$.command")), lambda c: F.to_json(F.struct(c.alias("command"))))
    d = d.select(*rec, *order, "tool", F.posexplode(F.when(shell, lines).otherwise(F.array("arguments"))).alias("part", "arguments"))
    return d.select(*rec, *order, "part", step_of("tool", "arguments").alias("step")).select(*rec, *order, "part", "step.*")
