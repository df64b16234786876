"""Reading append-only JSON-line traces, and reading and writing recordings (gzip or plain JSON).

Known fields become columns; everything else stays in ``raw`` as VARIANT, so unknown fields and
entry types survive a round trip.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, python_path
from ..plans.spread import hot_keys, split_join
from .files import file_system

MAGIC_GZIP = b"\x1f\x8b"
VERSION = 1
#: Splits or files of which a table is broadcast (some 100 bytes each); beyond, it is joined by a shuffle.
MOST_FILES = 100_000


class TraceFormatError(ValueError):
    """A trace or recording that can't be read; says the line where there is one."""


def _got(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("raw", path, kind)


def trace_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """trace (file), line (from 1), value, raw. Files are split, so one of any size is read by many tasks.

    Lines are numbered without moving them: a split counts its lines, a table of a row for each split sums up those before it,
    and a line's place within its split is told by the order in which its task reads. The files are listed once, so
    both passes see the same splits.
    """
    return _numbered(spark, paths)[0].where(F.trim("value") != "").withColumn("raw", F.try_parse_json("value"))


def _numbered(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines (trace, line, value), and files (trace, lines, header: the line of the first session entry)."""
    d = spark.read.option("lineSep", "\n").text(paths)
    d = d.select(F.col("_metadata.file_path").alias("trace"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    kind = F.try_variant_get(F.try_parse_json("value"), "$.type", "string")
    splits = d.groupBy("trace", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.min(F.when(kind == "session", F.col("place"))).alias("header"))
    splits = cut(splits)
    before = Window.partitionBy("trace").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
    files = splits.groupBy("trace").agg(F.sum("n").alias("lines"), F.min(F.col("header") - F.col("first") + F.col("start")).alias("header"))
    keys = ["trace", "block"]
    lines = _beside(d, splits.select(*keys, "first", "start", "n"), keys, "n")
    return lines.select("trace", (F.col("place") - F.col("first") + F.col("start")).cast("int").alias("line"), "value"), files


def _beside(rows: DataFrame, few: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined with few (one row a key, and how many rows it has): broadcast where few are few enough, else by a join that splits hot keys."""
    if few.limit(MOST_FILES + 1).count() <= MOST_FILES:
        return rows.join(F.broadcast(few), keys)
    return split_join(rows, few, keys, hot_keys(few, keys, few.agg(F.sum(count)).first()[0], count))


def read_entries(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """Entries: trace, line, type, id, parent_id, ts, role, raw.

    The first line of type session is the header and isn't an entry. Missing type, parent and time
    become 'unknown', null and ''. A repeated id: the last row of it counts. Strictly read, bad JSON,
    a line that is no object, an entry without id and a file without header raise; else they are left out.
    """
    d, files = _numbered(spark, paths)
    d = d.where(F.trim("value") != "").withColumns({"raw": F.try_parse_json("value"), "is_object": _is_object()})
    return _entries(_beside(d, files, ["trace"], "lines"), strict)


def _is_object() -> Column:
    return F.substring(F.ltrim("value"), 1, 1) == "{"


def _entries(d: DataFrame, strict: bool) -> DataFrame:
    """Entries of lines (trace, line, raw, is_object, header: the line of the trace's header)."""
    d = d.withColumn("type", F.coalesce(_got("$.type"), F.lit("unknown"))).withColumn("id", _got("$.id"))
    d = d.where(F.col("header").isNull() | (F.col("line") != F.col("header")))
    fault = F.when(F.col("raw").isNull(), "invalid JSON").when(~F.col("is_object"), "not an object").when(F.col("id").isNull(), "entry without id").when(F.col("header").isNull(), "no session header")
    if strict:
        told = F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), fault)
        d = d.withColumn("id", F.when(fault.isNotNull(), F.raise_error(told)).otherwise(F.col("id")))
    else:
        d = d.where(fault.isNull())
    last = F.row_number().over(Window.partitionBy("trace", "id").orderBy(F.desc("line")))
    d = d.withColumn("nth", last).where("nth = 1")
    return d.select(
        "trace", "line", "type", "id", _got("$.parentId").alias("parent_id"), F.coalesce(_got("$.timestamp"), F.lit("")).alias("ts"), _got("$.message.role").alias("role"), "raw"
    )


def write_sessions(lines: DataFrame, at: str) -> None:
    """Write lines (rec, line, value) of many sessions, each beginning with its header, to a folder: whole sessions one after the other, a file for each task and not for each session."""
    lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rec").sortWithinPartitions("rec", "line").select("value").write.option("maxRecordsPerFile", 0).text(at)


def read_sessions(spark: SparkSession, paths: str | list[str], strict: bool = True) -> DataFrame:
    """Entries as read_entries() gives them, of files with many sessions: each session entry begins a trace of its own.

    A trace is named by its file, its header's id and line (file#id@line); lines are numbered from its header. Files are split: what a
    split begins within is told by the last header of the splits before it.
    """
    d = spark.read.option("lineSep", "\n").text(paths)
    d = d.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    d = d.withColumn("raw", F.try_parse_json("value"))
    head = lambda at: F.when(_got("$.type") == "session", F.struct(at.alias("at"), F.coalesce(_got("$.id"), F.lit("")).alias("session")))
    splits = cut(d.groupBy("file", "block").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.max(head(F.col("place"))).alias("last")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) + 1)
    last = F.when(F.col("last").isNotNull(), F.struct((F.col("last.at") - F.col("first") + F.col("start")).alias("at"), F.col("last.session").alias("session")))
    splits = splits.withColumn("last", last).withColumn("begun", F.last("last", ignorenulls=True).over(before))
    d = _beside(d, splits.select("file", "block", "first", "start", "begun", "n"), ["file", "block"], "n").withColumn("at", F.col("place") - F.col("first") + F.col("start"))
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    d = d.where(F.trim("value") != "").select("file", "block", "at", "raw", _is_object().alias("is_object"), "begun", head(F.col("at")).alias("own"))
    d = d.withColumn("head", F.coalesce(F.last("own", ignorenulls=True).over(within), "begun"))
    trace = F.concat("file", F.when(F.col("head").isNotNull(), F.concat(F.lit("#"), "head.session", F.lit("@"), F.col("head.at").cast("string"))).otherwise(""))
    line = F.when(F.col("head").isNotNull(), F.col("at") - F.col("head.at") + 1).otherwise(F.col("at")).cast("int")
    return _entries(d.select(trace.alias("trace"), line.alias("line"), "raw", "is_object", F.when(F.col("head").isNotNull(), F.lit(1)).alias("header")), strict)


def _peek(lines: Iterator[str]) -> tuple[str | None, str | None, str | None, str | None]:
    """id and cwd of the first header, the last name that the trace was given before a user spoke, and the first user's text, of a trace's lines."""
    head, name, said = None, None, None
    for line in lines:
        try:
            own = json.loads(line)
        except ValueError:
            continue
        if not isinstance(own, dict):
            continue
        message = own.get("message") if isinstance(own.get("message"), dict) else {}
        if head is None and own.get("type") == "session":
            head = own
        elif said is None and own.get("type") == "session_info" and isinstance(own.get("name"), str):
            name = own["name"]
        elif not said and message.get("role") == "user":
            content = message.get("content")
            parts = [b.get("text") for b in content if isinstance(b, dict)] if isinstance(content, list) else [content]
            said = " ".join(" ".join(p for p in parts if isinstance(p, str)).split())[:80]
        if head is not None and said:
            break
    text = lambda v: v if isinstance(v, str) else None
    return text((head or {}).get("id")), text((head or {}).get("cwd")), name, said


def _peeked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = []
        for path in b.column(0).to_pylist():
            system, at = file_system(path)
            with system.open_input_stream(at) as raw, io.TextIOWrapper(raw, "utf-8", "replace") as text:
                found.append(_peek(iter(text)))
        added = [pa.array(c, pa.string()) for c in zip(*found, strict=True)] or [pa.array([], pa.string())] * 4
        yield pa.RecordBatch.from_arrays([*b.columns, *added], ["path", "bytes", "modified", "id", "cwd", "name", "first_text"])


def list_traces(spark: SparkSession, pattern: str) -> DataFrame:
    """A row for each file, newest first: path, bytes, modified, id, cwd, name, first text of a user that has words (80 characters); broken files too.

    Files are opened by tasks and read line by line, no further than to the header and the first text of a user.
    """
    python_path(spark)
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    d = files.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)).mapInArrow(_peeked, "path string, bytes long, modified timestamp, id string, cwd string, name string, first_text string")
    return d.orderBy(F.desc("modified"), "path")


def resolve_trace(listed: DataFrame, ref: str | None = None) -> DataFrame:
    """The newest file, or the newest whose id begins with ref or whose path or name contains it."""
    d = listed if not ref else listed.where(F.col("id").startswith(ref) | F.col("path").contains(ref) | F.col("name").contains(ref))
    return d.orderBy(F.desc("modified"), "path").limit(1)


def unpack(payload: bytes) -> dict:
    """A recording from its bytes, gzip by its first two bytes or else plain JSON; checked."""
    try:
        body = json.loads(gzip.decompress(payload) if payload[:2] == MAGIC_GZIP else payload)
    except (OSError, EOFError, ValueError) as e:
        raise TraceFormatError(f"unreadable recording: {e}") from e
    if not isinstance(body, dict) or body.get("version") != VERSION:
        raise TraceFormatError("not a recording of version 1")
    if not all(isinstance(body.get(k), list) for k in ("entries", "dict")):
        raise TraceFormatError("entries and dict must be lists")
    return body


def expand(value, pool: list):
    """value with each pool reference {"$d": n} replaced; a number out of range is an error."""
    if isinstance(value, list):
        return [expand(v, pool) for v in value]
    if isinstance(value, dict):
        if set(value) == {"$d"} and isinstance(value["$d"], int):
            if not 0 <= value["$d"] < len(pool):
                raise TraceFormatError(f"no pooled string {value['$d']}")
            return pool[value["$d"]]
        return {k: expand(v, pool) for k, v in value.items()}
    return value


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            body = unpack(raw)
            head = json.dumps({k: v for k, v in body.items() if k not in ("entries", "dict")}, sort_keys=True)
            own = [json.dumps(expand(e, body["dict"]), sort_keys=True, ensure_ascii=False) for e in body["entries"]]
            n = max(len(own), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n), pa.array([head] * n), pa.array(list(range(n)) if own else [None], pa.int32()), pa.array(own or [None], pa.string())], ["path", "header", "seq", "entry"]
            )


def read_recordings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Entries of recordings, pool references expanded: path, header (VARIANT), seq, entry (VARIANT); one row with null entry for none."""
    python_path(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    d = files.mapInArrow(_unpacked, "path string, header string, seq int, entry string")
    return d.select("path", F.parse_json("header").alias("header"), "seq", F.parse_json("entry").alias("entry"))


def pack(header: dict, entries: list, least: int = 256) -> bytes:
    """A recording of version 1: strings of least characters or more are pooled in first-seen order; gzip."""
    pool: dict[str, int] = {}

    def pooled(v):
        if isinstance(v, str) and len(v) >= least:
            return {"$d": pool.setdefault(v, len(pool))}
        if isinstance(v, list):
            return [pooled(x) for x in v]
        return {k: pooled(x) for k, x in v.items()} if isinstance(v, dict) else v

    own = [pooled(e) for e in entries]
    return gzip.compress(json.dumps({**header, "version": VERSION, "dict": list(pool), "entries": own}, ensure_ascii=False).encode(), 9, mtime=0)


def _blocks() -> Column:
    """Content blocks of raw as an array of VARIANT: a list as it is, a text as one text block."""
    text = F.try_variant_get("raw", "$.message.content", "string")
    listed = F.try_variant_get("raw", "$.message.content", "array<variant>")
    one = F.array(F.to_variant_object(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    return F.when(listed.isNotNull(), listed).when(F.length(text) > 0, one)


def calls_of(entries: DataFrame) -> DataFrame:
    """Tool calls of assistants: trace, line, block, call_id, tool, arguments (JSON text)."""
    d = entries.where("role = 'assistant'").select("trace", "line", F.posexplode(_blocks()).alias("block", "b"))
    got = lambda k: F.try_variant_get("b", f"$.{k}", "string")
    d = d.where(got("type") == "toolCall")
    return d.select("trace", "line", "block", got("id").alias("call_id"), F.coalesce(got("name"), F.lit("")).alias("tool"), F.coalesce(F.to_json(F.try_variant_get("b", "$.arguments", "variant")), F.lit("{}")).alias("arguments"))


def results_of(entries: DataFrame) -> DataFrame:
    """Tool results: trace, line, call_id, tool, is_error, text (text blocks joined by a line feed)."""
    d = entries.where("role = 'toolResult'")
    texts = F.array_compact(F.transform(_blocks(), lambda b: F.try_variant_get(b, "$.text", "string")))
    return d.select(
        "trace", "line", _got("$.message.toolCallId").alias("call_id"), _got("$.message.toolName").alias("tool"),
        F.coalesce(_got("$.message.isError", "boolean"), F.lit(False)).alias("is_error"), F.coalesce(F.array_join(texts, "\n"), F.lit("")).alias("text"),
    )
