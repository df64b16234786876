"""A data source of recordings: spark.read.format("recordings") and df.write.format("recordings").

A row is an entry of a recording; header fields are columns, so that filters on them, and on the path, are pushed into the reader.
Those on the path leave files out before anything is read, those on header fields before a file's entries are made. Files are dealt
to tasks by size. Writing gives a file for each recording: use ``write_recordings``, which brings the rows of a
recording together, in order. A task writes beside the target, and the driver moves all files there when every task has succeeded;
if one fails, nothing is left. Where a store cannot move files, readers may see some of them before the last.

Defined results: a recording without entries is one row with null seq and entry. A file that can't be read raises with its path, or,
with option faults=true, is a row with its fault. An empty table writes no file. Rows without a path are refused.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ..plans.lineage import python_path
from .files import file_system
from .traces import TraceFormatError, expand, pack, unpack

SCHEMA = "path string, name string, profile string, lossy boolean, header string, seq int, entry string, fault string"
SUFFIX = ".rec"
#: Bytes of files that a task reads, about.
TASK_BYTES = 64 << 20
_HEADER = ("name", "profile", "lossy")
_TESTS = {
    EqualTo: lambda v, f: v is not None and v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v is not None and v in f.value,
    StringStartsWith: lambda v, f: v is not None and v.startswith(f.value),
    StringEndsWith: lambda v, f: v is not None and v.endswith(f.value),
    StringContains: lambda v, f: v is not None and f.value in v,
}


def _passes(filters: list[Filter], column: str, value) -> bool:
    return all(_TESTS[type(f)](value, f) for f in filters if f.attribute == (column,))


class Files(InputPartition):
    """Files that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (temporary place, final place) of each file."""

    moves: list[tuple[str, str]] = field(default_factory=list)


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.at, self.faults = options["path"], options.get("faults", "false").lower() == "true"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("path", *_HEADER) and not (self.faults and f.attribute[0] != "path"):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, at = file_system(self.at)
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
        # The path in a row is the option's own form, so that filters and listings agree.
        under = lambda p: self.at if p == at else self.at.rstrip("/") + p[len(at.rstrip("/")) :]
        files = sorted((under(f.path), f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and "/_" not in f.path[len(at) :])
        out: list[InputPartition] = []
        own, size = [], 0
        for path, n in files:
            if not _passes(self.pushed, "path", path):
                continue
            if own and size + n > self.task_bytes:
                out.append(Files(own))
                own, size = [], 0
            own.append(path)
            size += n
        return [*out, Files(own)] if own or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            system, at = file_system(path)
            try:
                with system.open_input_stream(at, compression=None) as f:
                    body = unpack(f.read())
                head = {k: v for k, v in body.items() if k not in ("entries", "dict")}
                values = {k: v if isinstance(v := head.get(k), bool if k == "lossy" else str) else None for k in _HEADER}
                if not all(_passes(self.pushed, k, v) for k, v in values.items()):
                    continue
                own = [json.dumps(expand(e, body["dict"]), sort_keys=True, ensure_ascii=False) for e in body["entries"]]
            except TraceFormatError as e:
                if not self.faults:
                    raise TraceFormatError(f"{path}: {e}") from e
                yield path, None, None, None, None, None, None, str(e)
                continue
            told = json.dumps(head, sort_keys=True, ensure_ascii=False)
            for seq, entry in enumerate(own) if own else [(None, None)]:
                yield path, values["name"], values["profile"], values["lossy"], told, seq, entry, None


class RecordingWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool) -> None:
        self.at, self.overwrite, self.columns = options["path"].rstrip("/"), overwrite, columns
        self.job = f"_writing-{uuid.uuid4().hex}"
        if missing := {"path", "seq", "entry"} - set(columns):
            raise ValueError(f"recordings need columns {', '.join(sorted(missing))}")

    def write(self, iterator: Iterator) -> Written:
        out = Written([])
        system, at = file_system(self.at)
        system.create_dir(f"{at}/{self.job}", recursive=True)
        get = {c: k for k, c in enumerate(self.columns)}
        for path, rows in itertools.groupby(iterator, key=lambda r: r[get["path"]]):
            if not path:
                raise ValueError("a recording needs a path")
            head, entries = {}, []
            for r in rows:
                if "header" in get and r[get["header"]]:
                    head = json.loads(r[get["header"]])
                head |= {c: r[get[c]] for c in _HEADER if c in get}
                if r[get["entry"]] is not None:
                    entries.append(json.loads(r[get["entry"]]))
            name = path.rpartition("/")[2].removesuffix(SUFFIX) + SUFFIX
            beside = f"{at}/{self.job}/{uuid.uuid4().hex}"
            with system.open_output_stream(beside, compression=None) as f:
                f.write(pack(head, entries))
            out.moves.append((beside, f"{at}/{name}"))
        return out

    def commit(self, messages: list) -> None:
        system, at = file_system(self.at)
        moves = [m for own in messages if own is not None for m in own.moves]
        if len({final for _, final in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("rows of one recording came from several tasks; use write_recordings")
        system.create_dir(at, recursive=True)
        if self.overwrite:
            keep = {final for _, final in moves}
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and f.path not in keep:
                    system.delete_file(f.path)
        for beside, final in moves:
            system.move(beside, final)
        self._clear(system, at)

    def abort(self, messages: list) -> None:
        system, at = file_system(self.at)
        self._clear(system, at)

    def _clear(self, system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(f"{at}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.job}")


class Recordings(DataSource):
    """Format "recordings"; option path: a folder or file, taskBytes: what a task reads, faults: rows for files that can't be read."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordingReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return RecordingWriter({k.lower(): v for k, v in self.options.items()}, schema.fieldNames(), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters."""
    python_path(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recordings)


def read_recordings_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("recordings").options(**options).load(path)


def write_recordings(entries: DataFrame, path: str, mode: str = "append") -> None:
    """A file for each recording of entries (path, seq, entry as JSON text; header as JSON text, name, profile, lossy if there): its rows in one task, in order, and no task holds more than one recording."""
    register(entries.sparkSession)
    kept = [c for c in ("path", "header", *_HEADER, "seq", "entry") if c in entries.columns]
    entries.select(*kept).repartition("path").sortWithinPartitions("path", "seq").write.format("recordings").mode(mode).save(path)


def headers(found: DataFrame) -> DataFrame:
    """A row for each recording of a table: path, header, entries."""
    return found.groupBy("path").agg(F.first("header").alias("header"), F.count("entry").alias("entries"))
