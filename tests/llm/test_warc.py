"""Packages against plain grouping, packages of other layouts, hot payloads, damage."""

import base64
import gzip
import hashlib
import json
import random
import uuid
import zipfile

import pytest

from tracelode.llm import warc


def digest(t):
    return base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()


def plain(rows, least):
    groups = {}
    for k, (i, u, t) in enumerate(rows):
        groups.setdefault(t or "", []).append((i is None, i or 0, u or "", k))
    out = []
    for t, own in groups.items():
        own.sort()
        for x in own:
            i, first = rows[x[3]][0], rows[own[0][3]][0]
            response = x is own[0] or len(t.encode()) < least
            out.append((i, len(t.encode()), digest(t), "response" if response else "revisit", None if response else first))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 3])
def test_round_trip_equals_plain_grouping(spark, least):
    rng = random.Random(least)
    texts = [None, "", "a", "aé", "<p>\r\n\r\n</p>", "x" * 400_000, "long " * 60_000]
    rows = [(rng.choice((None, rng.randint(0, 200))), rng.choice((None, "http://a.b/c d?x", "é\n", "http://[bad")), rng.choice(texts)) for _ in range(150)]
    rows += [(1000 + k, "u", "hot") for k in range(400)]
    d = spark.createDataFrame([(*r, "q", 1) for r in rows], "page_id long, url string, html string, sha string, own int")
    got = warc.round_trip(d, least)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == plain(rows, least)


def _record(kind, url, block, http=True, **more):
    head = [f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Target-URI: {url}\r\nContent-Length: {len(block)}\r\n"]
    head += ["Content-Type: application/http; msgtype=response\r\n" if http else "Content-Type: text/plain\r\n", *(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())]
    return "".join(head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _foreign(folder):
    """Packages as other tools lay them out: several archives, one with a CDX index, one with a gzip CDXJ, two with none."""
    ok = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    records = [
        _record("warcinfo", "", b"software: other", http=False),
        _record("response", "http://a.org/", ok + b"one", WARC_Payload_Digest=f"sha1:{digest('one')}"),
        _record("request", "http://a.org/", b"GET / HTTP/1.1\r\n\r\n"),
        _record("revisit", "http://a.org/2", ok, WARC_Payload_Digest=f"sha1:{digest('one')}", WARC_Refers_To_Target_URI="http://a.org/"),
        _record("resource", "urn:x", b"plain", http=False),
        _record("response", "http://c.org/", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\ntwo\r\n0\r\n\r\n", WARC_Payload_Digest="sha1:" + hashlib.sha1(b"two").hexdigest()),
        _record("response", "http://d.org/", ok + b"bad", WARC_Payload_Digest=f"sha1:{digest('good')}"),
        _record("revisit", "http://e.org/", ok, WARC_Payload_Digest=f"sha1:{digest('elsewhere')}"),
    ]
    zipped = [gzip.compress(r) for r in records]
    at = [sum(map(len, zipped[:k])) for k in range(len(zipped))]
    kept = [k for k, r in enumerate(records) if b"warcinfo" not in r and b"request" not in r[:40]]
    cdx = " CDX N b a m s k r M S V g\n" + "".join(f"k{k} 2020 u text/html 200 D - - {len(zipped[k]) if k != 3 else '-'} {at[k]} one.warc.gz\n" for k in kept)
    cdxj = "".join(f"k{k} 2020 " + json.dumps({"url": "u", "filename": "two.warc.gz", "offset": at[k], "length": len(zipped[k])}) + "\n" for k in kept)
    with zipfile.ZipFile(folder / "a.wacz", "w") as z:
        z.writestr("datapackage.json", "{}")
        z.writestr("archive/one.warc.gz", b"".join(zipped))
        z.writestr("archive/two.warc.gz", b"".join(zipped))
        z.writestr("indexes/one.cdx", cdx)
        z.writestr("indexes/two.cdxj.gz", gzip.compress(cdxj.encode()))
        z.writestr("pages/pages.jsonl", "{}", zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(folder / "b.zip", "w") as z:
        z.comment = b"a comment behind the directory"
        z.writestr("archive/three.warc.gz", b"".join(zipped))
        z.writestr("archive/four.warc", b"".join(records))
    return [str(folder / "a.wacz"), str(folder / "b.zip")]


@pytest.mark.parametrize("piece", [50, 8 << 20])
def test_packages_of_other_layouts(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(warc, "READ_BYTES", piece)
    want = sorted(
        [
            ("http://a.org/", 3, digest("one"), "response", True),
            ("http://a.org/2", 3, digest("one"), "revisit", None),
            ("urn:x", 5, digest("plain"), "resource", None),
            ("http://c.org/", 3, digest("two"), "response", True),
            ("http://d.org/", 3, digest("bad"), "response", False),
            ("http://e.org/", None, digest("elsewhere"), "revisit", None),
        ]
        * 4,
        key=repr,
    )
    paths = _foreign(tmp_path)
    from pyarrow import fs

    direct = []
    for p in paths:
        with fs.LocalFileSystem().open_input_file(p) as f:
            direct += [x for x in map(warc._row, warc.Package(f).records()) if x]
    assert len(direct) == len(want)
    got = warc.read_packages(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert sorted(((r.url, r.payload_bytes, r.payload_digest, r.record_type, r.digest_ok) for r in got), key=repr) == want
    assert {r.page_id for r in got} == {None}


def test_what_is_no_package_is_told(tmp_path):
    from pyarrow import fs

    at = tmp_path / "x.wacz"
    at.write_bytes(b"PK" * 100)
    with fs.LocalFileSystem().open_input_file(str(at)) as f, pytest.raises(ValueError, match="central directory"):
        warc.Package(f)
