"""WARC records in ZIP packages: a writer, and a reader that never extracts.

Each task writes packages with two stored members: ``archive/data.warc.gz`` (one gzip member a
record) and ``indexes/index.cdxj`` (key, time, and a JSON object with URL, digest, file, offset and
length of each record). The reader parses the end-of-central-directory record, its ZIP64 form where
there is one, and the central directory, finds the stored members behind their local headers, and reads
records by byte range, neighbouring ones in one request. It takes packages of other writers as well: any
number of stored ``archive/*.warc.gz`` or ``*.warc`` members, with CDX or CDXJ indexes (plain or gzip)
or without one (such a member is read from its start), HTTP or plain payloads, records of other kinds
skipped. Ranges are listed first and dealt over tasks, so that one large package is no single task.
Files are in the folder that the cluster shares; a task that runs again writes files of other names, and
only the names that its last run reported are read.

Of records with equal payloads of at least ``least`` bytes the one with the least page id is a
``response``, the others are ``revisit`` records without payload that refer to it. The reader computes
digest and length of each payload that is there; a revisit has those of the response with its digest.

Defined results: null html is an empty payload, null url an empty target. A null page id counts as
the greatest. Of rows that repeat an id and a payload one is the response (that of the least url), the
others revisit it. A payload of any length is one record, whole. An empty table gives an empty result.
Columns other than the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, cut, cut_table, hot_keys, shared_dir, small, split_join

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed at this size; ranges are joined up to this one, and an unindexed member is read in such pieces.
PACKAGE_BYTES, READ_BYTES = 256 << 20, 8 << 20
#: Revisits (about 60 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_LAST = 2**63 - 1
_RANGES = "path string, member string, begin long, lengths array<long>"
_READ = "page_id long, record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_to_id string, digest_ok boolean"
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
#: Records that are read; requests and remarks about the archive are not.
TYPES = ("response", "resource", "revisit")


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page, url: str, payload: bytes, kind: str, refers_to) -> bytes:
    """One WARC record, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 3, mtime=0)


def surt(url: str) -> str:
    """A URL as the key of an index: host names from the right, then path and query."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
    except ValueError:
        return re.sub(r"\s", "%20", url)
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return re.sub(r"\s", "%20", ",".join(reversed(host.split("."))) + ")" + rest.lower())


def _headers(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _dechunked(raw: bytes) -> bytes:
    out, at = [], 0
    while (end := raw.find(b"\r\n", at)) >= 0:
        n = int(raw[at:end].split(b";")[0] or b"0", 16)
        if not n:
            break
        out.append(raw[end + 2 : end + 2 + n])
        at = end + n + 4
    return b"".join(out)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record, a gzip member or plain."""
    whole = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = whole.partition(b"\r\n\r\n")
    first, headers = _headers(head)
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    block = rest[: int(headers["content-length"])]
    if not headers.get("content-type", "").startswith("application/http"):
        return headers, block
    http, _, payload = block.partition(b"\r\n\r\n")
    told = headers.get("warc-payload-digest", "")
    if _headers(http)[1].get("transfer-encoding", "").lower() == "chunked" and told and not _same_digest(told, payload):
        payload = _dechunked(payload)
    return headers, payload


def _same_digest(told: str, payload: bytes) -> bool | None:
    """Whether a digest header is that of the payload; None: no digest that is known here."""
    kind, _, value = told.partition(":")
    if kind.lower() not in ("sha1", "sha-1", "sha256", "sha-256", "md5"):
        return None
    own = hashlib.new(kind.lower().replace("-", ""), payload).digest()
    return value.upper().rstrip("=") in (base64.b32encode(own).decode().rstrip("="), own.hex().upper())


class Package:
    """Central directory of a ZIP file, and byte ranges of its stored members."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail_at = max(0, size - 22 - 65535)
        tail = file.read_at(size - tail_at, tail_at)
        at = tail.rfind(b"PK\x05\x06")
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        locator = tail[at - 20 : at]
        if locator[:4] == b"PK\x06\x07":  # ZIP64: the real numbers are elsewhere
            end = file.read_at(56, struct.unpack("<Q", locator[8:16])[0])
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack("<QQQ", end[32:56])
        self.members: dict[str, tuple[int, int]] = {}
        raw, p = file.read_at(length, start), 0
        for _ in range(count):
            if raw[p : p + 4] != b"PK\x01\x02":
                raise ValueError("bad central directory")
            method = struct.unpack("<H", raw[p + 10 : p + 12])[0]
            packed, full, n, m, k = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
            local = struct.unpack("<I", raw[p + 42 : p + 46])[0]
            name, extra = raw[p + 46 : p + 46 + n].decode(), raw[p + 46 + n : p + 46 + n + m]
            while len(extra) >= 4:  # ZIP64: 8-byte values for those fields that are all ones
                tag, own = struct.unpack("<HH", extra[:4])
                if tag == 1:
                    values = list(struct.unpack(f"<{own // 8}Q", extra[4 : 4 + own // 8 * 8]))
                    full = values.pop(0) if full == 0xFFFFFFFF else full
                    packed = values.pop(0) if packed == 0xFFFFFFFF else packed
                    local = values.pop(0) if local == 0xFFFFFFFF else local
                extra = extra[4 + own :]
            if method == 0:
                self.members[name] = (local, packed)
            p += 46 + n + m + k
        self._starts: dict[str, int] = {}

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        local, size = self.members[name]
        if name not in self._starts:
            head = self.file.read_at(30, local)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("bad local header")
            n, m = struct.unpack("<HH", head[26:30])
            self._starts[name] = local + 30 + n + m
        length = size - offset if length is None else length
        if offset < 0 or offset + length > size:
            raise ValueError("range beyond the member")
        return self.file.read_at(length, self._starts[name] + offset)

    def archives(self) -> list[str]:
        return [m for m in self.members if m.startswith("archive/") and m.endswith((".warc.gz", ".warc"))]

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """For each archive member that an index names: offset and length (-1: not told) of its records, in order."""
        files = {m.rpartition("/")[2]: m for m in self.archives()}
        found: dict[str, set[tuple[int, int]]] = {}
        for name in self.members:
            if not (name.startswith("indexes/") and re.search(r"\.cdxj?(\.gz)?$", name)):
                continue
            raw = self.read(name)
            lines = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8", "replace").splitlines()
            legend = "N b a m s k r M S V g".split()
            for line in lines:
                if line.lstrip().startswith("CDX ") and not found:
                    legend = line.split()[1:]
                elif "{" in line:
                    own = json.loads(line[line.index("{") :])
                    if own.get("filename") in files or len(files) == 1:
                        member = files.get(own.get("filename")) or next(iter(files.values()))
                        found.setdefault(member, set()).add((int(own["offset"]), int(own.get("length", -1))))
                elif len(line.split()) == len(legend):
                    own = dict(zip(legend, line.split(), strict=True))
                    if own.get("g") in files and own.get("V", "").isdigit():
                        found.setdefault(files[own["g"]], set()).add((int(own["V"]), int(own["S"]) if own.get("S", "").isdigit() else -1))
        return {m: sorted(x) for m, x in found.items()}

    def ranges(self) -> Iterator[tuple[str, int, list[int]]]:
        """(member, begin, lengths of neighbouring records); no lengths: the member is to be read from its start."""
        index = self.index()
        for member in self.archives():
            own = index.get(member)
            if not own:
                yield member, 0, []
                continue
            ends = [at for at, _ in own[1:]] + [self.members[member][1]]
            own = [(at, n if n >= 0 else end - at) for (at, n), end in zip(own, ends, strict=True)]
            begin, lengths = own[0][0], []
            for at, n in own:
                if lengths and (at != begin + sum(lengths) or sum(lengths) + n > READ_BYTES):
                    yield member, begin, lengths
                    begin, lengths = at, []
                lengths.append(n)
            yield member, begin, lengths

    def at(self, member: str, begin: int, lengths: list[int]) -> Iterator[bytes]:
        """The records of a range."""
        if not lengths:
            yield from self.scan(member)
            return
        raw, place = self.read(member, begin, sum(lengths)), 0
        for n in lengths:
            yield raw[place : place + n]
            place += n

    def scan(self, member: str) -> Iterator[bytes]:
        """Records of a member without an index, plain, read piece by piece."""
        size, at, left = self.members[member][1], 0, b""

        def piece() -> bytes:
            nonlocal at
            n = min(READ_BYTES, size - at)
            at += n
            return self.read(member, at - n, n)

        if member.endswith(".gz"):
            while left or at < size:
                unzip, own = zlib.decompressobj(31), []
                while not unzip.eof and (left or at < size):
                    own.append(unzip.decompress(left or piece()))
                    left = unzip.unused_data
                if own := b"".join(own):
                    yield own
            return
        while left or at < size:
            while (end := left.find(b"\r\n\r\n")) < 0 and at < size:
                left += piece()
            if end < 0:
                return
            n = end + 8 + int(_headers(left[:end])[1]["content-length"])
            while len(left) < n and at < size:
                left += piece()
            yield left[:n]
            left = left[n:]

    def records(self) -> Iterator[bytes]:
        for member, begin, lengths in self.ranges():
            yield from self.at(member, begin, lengths)


class _Writer:
    def __init__(self, folder: str):
        self.system, self.at = file_system(folder)
        self.folder, self.zip, self.done = folder, None, []

    def add(self, page, url: str, payload: bytes, kind: str, refers_to) -> None:
        if self.zip is None:
            self.name = f"{uuid.uuid4().hex}.wacz"
            self.stream = self.system.open_output_stream(f"{self.at}/{self.name}")
            self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
            self.data, self.size, self.index = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), 0, []
        raw = record(page, url, payload, kind, refers_to)
        self.data.write(raw)
        own = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": f"sha1:{digest(payload)}", "length": str(len(raw)), "offset": str(self.size), "filename": DATA.rpartition("/")[2]}
        self.index.append(f"{surt(url)} 19700101000000 {json.dumps(own)}\n")
        self.size += len(raw)
        if self.size >= PACKAGE_BYTES:
            self.close()

    def close(self) -> None:
        if self.zip is not None:
            self.data.close()
            self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.index)).encode("utf-8", "surrogatepass"))
            self.zip.close()
            self.stream.close()
            self.done.append((f"{self.folder}/{self.name}", len(self.index), self.size))
            self.zip = None


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                out.add(*row)
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done, strict=True)], ["path", "records", "bytes"])

    return run


def write_packages(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row; a row for each package: path, records, bytes."""
    spark = pages.sparkSession
    arrow_limits(spark, 512)
    own = pages.select(
        F.col(id_col).cast("long").alias("page"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("body")
    )
    file_system(folder)[0].create_dir(file_system(folder)[1], recursive=True)
    order = F.coalesce("page", F.lit(_LAST))
    keys = own.where(F.octet_length("body") >= least).select(order.alias("page"), F.sha1("body").alias("sha")).groupBy("sha", "page").agg(F.count("*").alias("copies"))
    keys = cut(keys)
    first = keys.groupBy("sha").agg(F.min("page").alias("first"), F.sum("copies").alias("k")).where("k > 1")
    first = cut(first)
    # A payload that a third of all rows have is dealt over tasks.
    hot = hot_keys(first, ["sha"], keys.count())
    again = cut(split_join(keys, first.drop("k"), ["sha"], hot, by=["page"]).select("sha", F.col("page").alias("own"), "first", "copies"))
    rows = own.withColumn("sha", F.sha1("body")).withColumn("own", order)
    if not again.where("copies > 1 and own = first").isEmpty():
        # Rows that repeat the response's id and payload: one of them, and the others counted out as revisits.
        rows = rows.dropDuplicates(["own", "sha", "url"]).join(rows.groupBy("own", "sha", "url").agg(F.count("*").alias("n")), ["own", "sha", "url"])
        by = rows.groupBy("own", "sha").agg(F.min("url").alias("least_url"))
        rows = rows.join(by, ["own", "sha"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
        rows = rows.withColumn("copy", F.when(F.col("url") == F.col("least_url"), F.col("copy")).otherwise(2))
    else:
        rows = rows.withColumn("copy", F.lit(1))
    again = F.broadcast(again.drop("copies")) if small(again, BROADCAST_ROWS) else again.drop("copies")
    rows = rows.join(again, ["sha", "own"], "left")
    revisit = F.col("first").isNotNull() & ((F.col("own") != F.col("first")) | (F.col("copy") > 1))
    rows = rows.select("page", "url", "body", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.nullif("first", F.lit(_LAST))).alias("refers"))
    return cut(rows.mapInArrow(_write(folder), "path string, records long, bytes long"))


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in _RANGES.split(", ")), strict=True)
    for b in batches:
        for path in b.column(0).to_pylist():
            system, at = file_system(path)
            with system.open_input_file(at) as f:
                rows = [(path, *x) for x in Package(f).ranges()]
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(zip(*rows[k : k + 4096], strict=True), kinds, strict=True)], list(names))


def _page(urn: str) -> int | None:
    """The page id of a record that the writer here named."""
    own = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(own) if urn.startswith("<urn:page:") and own else None


def _row(raw: bytes) -> tuple | None:
    h, payload = parse_record(raw)
    kind, refers, told = h.get("warc-type", ""), h.get("warc-refers-to", ""), h.get("warc-payload-digest", "")
    if kind not in TYPES:
        return None
    own = (_page(h.get("warc-record-id", "")), h.get("warc-record-id"), h.get("warc-target-uri", ""))
    if kind == "revisit":  # no payload; its digest is that of the record that it refers to
        return *own, None, told.partition(":")[2] or None, kind, _page(refers), refers or None, None
    return *own, len(payload), digest(payload), kind, None, None, _same_digest(told, payload) if told else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.split() for x in _READ.split(", ")), strict=True)
    path, file, package, rows = None, None, None, []

    def taken() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    try:
        for b in batches:
            for where, member, begin, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if where != path:
                    if file is not None:
                        file.close()
                    system, at = file_system(where)
                    path, file = where, system.open_input_file(at)
                    package = Package(file)
                for raw in package.at(member, begin, lengths):
                    if row := _row(raw):
                        rows.append(row)
                    if len(rows) >= 4096:
                        yield taken()
                        rows = []
        if rows:
            yield taken()
    finally:
        if file is not None:
            file.close()


def read_packages(packages: DataFrame) -> DataFrame:
    """The records of packages (column path): page_id, record_id, url, payload_bytes, payload_digest, record_type, refers_to, refers_to_id, digest_ok.

    digest_ok: whether the record's own digest is that of its payload (null: it has none, or no payload). page_id and
    refers_to are null for records of other writers. payload_bytes of a revisit is null where no response here has its digest.
    """
    spark = packages.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranges = packages.select("path").repartition(tasks).mapInArrow(_list, _RANGES)
    found, _ = cut_table(ranges.repartition(tasks).mapInArrow(_read, _READ))
    there = cut(found.where("record_type <> 'revisit'").groupBy("payload_digest").agg(F.min("payload_bytes").alias("bytes_there"), F.count("*").alias("k")))
    again = found.where("record_type = 'revisit'")
    hot = hot_keys(again.groupBy("payload_digest").agg(F.count("*").alias("k")), ["payload_digest"], again.count())
    again = split_join(again, there.drop("k"), ["payload_digest"], hot, "left", by=["record_id", "url"])
    again = again.withColumn("payload_bytes", F.col("bytes_there")).select(*found.columns)
    return found.where("record_type <> 'revisit'").unionByName(again)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write a record for each page into the shared folder and read the packages back.

    Raises if a payload isn't what its record says, or if a revisit refers to no response with its digest.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    found = read_packages(write_packages(pages, folder, least))
    responses = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "payload_digest").distinct()
    again = found.where("record_type = 'revisit'").groupBy("refers_to_id", "payload_digest").agg(F.count("*").alias("n"))
    lost = again.join(responses, ["refers_to_id", "payload_digest"], "left_anti")
    wrong = found.where("not digest_ok").select("record_id").unionByName(lost.select(F.col("refers_to_id").alias("record_id"))).limit(1).collect()
    if wrong:
        raise ValueError(f"the archives in {folder} don't hold what was written, see {wrong[0][0]}")
    return found
