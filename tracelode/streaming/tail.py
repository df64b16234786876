"""Files that grow, as a stream: spark.readStream.format("growing_lines").

The source keeps a byte offset for each file of a folder. A batch takes what was appended to each since the last one, up to the last
line feed, so a line that is still being written waits; what a task reads is bounded, and long additions are cut at line
starts and dealt to several tasks. Offsets are in the query's checkpoint, so a restart goes on where it was, and a batch that is
repeated reads the same bytes. A file that is shorter than its offset was written anew and is read from its beginning; one that
is gone is forgotten. New files are found in every batch. Names that begin with a dot or underscore are left out.

Rows: path, at (the line's first byte), value. Lines of a file are in the order of ``at``, which never changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..plans.lineage import python_path
from ..sources.files import file_system

SCHEMA = "path string, at long, value string"
#: Bytes of an addition that one task reads.
TASK_BYTES = 64 << 20
_BLOCK = 1 << 16


class Range(InputPartition):
    """Lines of a file that begin in a range of bytes; the range's end is the batch's, too, where last is set."""

    def __init__(self, name: str, begin: int, end: int, first: int, last: int) -> None:
        self.name, self.begin, self.end, self.first, self.last = name, begin, end, first, last


class GrowingReader(DataSourceStreamReader):
    """Offsets are {file below the folder: byte}."""

    def __init__(self, options: dict) -> None:
        self.at, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _files(self) -> dict[str, int]:
        system, at = file_system(self.at)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return {}
        found = system.get_file_info(fs.FileSelector(at, recursive=True))
        names = {f.path[len(at) :].lstrip("/"): f.size for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)}
        return {n: size for n, size in names.items() if not any(p.startswith((".", "_")) for p in n.split("/"))}

    def latestOffset(self) -> dict:  # noqa: N802
        """For each file the end of its last whole line."""
        system, at = file_system(self.at)
        return {n: self._last_line_end(system, f"{at}/{n}", size) for n, size in sorted(self._files().items())}

    @staticmethod
    def _last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
        with system.open_input_file(path) as f:
            end = size
            while end > 0:
                begin = max(end - _BLOCK, 0)
                f.seek(begin)
                k = f.read(end - begin).rfind(b"\n")
                if k >= 0:
                    return begin + k + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for name, last in sorted(end.items()):
            first = start.get(name, 0)
            first = 0 if first > last else first  # written anew
            out += [Range(name, b, min(b + self.task_bytes, last), first, last) for b in range(first, last, self.task_bytes)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        p = partition
        system, at = file_system(self.at)
        with system.open_input_file(f"{at}/{p.name}") as f:
            place, rest = p.begin, b""
            if p.begin > p.first:  # a line that begins before the range belongs to the one before
                f.seek(p.begin - 1)
                place = p.begin - 1
                skipping = True
            else:
                f.seek(p.begin)
                skipping = False
            while place < p.end or rest:
                block = f.read(min(_BLOCK, p.last - place - len(rest))) if place + len(rest) < p.last else b""
                rest += block
                lines = rest.split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if place >= p.end:
                        return
                    if skipping:
                        skipping = False
                    else:
                        yield f"{self.at}/{p.name}", place, line.decode("utf-8", "replace")
                    place += len(line) + 1
                if not block:
                    return

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format "growing_lines"; option path: a folder, suffix: what names of files end in, taskBytes: what a task reads."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return GrowingReader({k.lower(): v for k, v in self.options.items()})


def stream_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """path, at, value of the lines of a folder's files, each once, as they are appended."""
    python_path(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**options).load(path)


def stream_entries(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Entries of growing traces: trace, at, type, id, parent_id, ts, role, raw, fault (null, or what is wrong with the line).

    As read_entries has them but for what needs a whole file: an entry stands for itself, so a session's header is a row of
    type session, and of rows that repeat an id the one of greatest ``at`` counts.
    """
    got = lambda p: F.try_variant_get("raw", p, "string")
    d = stream_lines(spark, path, **options).where(F.trim("value") != "").withColumn("raw", F.try_parse_json("value"))
    is_object = F.substring(F.ltrim("value"), 1, 1) == "{"
    fault = F.when(F.col("raw").isNull(), "invalid JSON").when(~is_object, "not an object").when(got("$.id").isNull(), "entry without id")
    return d.select(
        F.col("path").alias("trace"), "at", F.coalesce(got("$.type"), F.lit("unknown")).alias("type"), got("$.id").alias("id"), got("$.parentId").alias("parent_id"),
        F.coalesce(got("$.timestamp"), F.lit("")).alias("ts"), got("$.message.role").alias("role"), "raw", fault.alias("fault"),
    )
