"""WARC archives: round trips, revisits, one stream in and members out, the index, other archives, broken ones, nulls and copies."""

import base64
import gzip
import hashlib
import json
import os
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from headerloom.llm import warc  # noqa: E402

SCHEMA = "page_id long, url string, html string, archive int, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in rows], SCHEMA).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def by_loop(rows, least=0):
    first = {}
    for i, _, html in rows:
        text = html or ""
        if len(text.encode()) >= least and (text not in first or (i is not None and (first[text] is None or i < first[text]))):
            first[text] = i
    out, used = [], set()
    for i, _, html in rows:
        text = html or ""
        size = len(text.encode())
        if size >= least and (i != first[text] or (text, i) in used):
            out.append((i, size, digest(text), "revisit", first[text]))
        else:
            used.add((text, i))
            out.append((i, size, digest(text), "response", None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/\r\nX-Injected: 1", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (7, "", None), (6, "u", ""), (None, "u", "<p>same</p>"),
    (None, "u", "alone\r\n\r\nWARC/1.1\r\nContent-Length: 9"), (11, "http://ü/", "é\0\U0001f600\r\n"), (12, "u", "x" * 3_000_000),
]


@pytest.mark.parametrize("least", [0, 12])
def test_equal_to_a_loop(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 2)
    monkeypatch.setattr(warc, "SPLIT", 300)
    got = warc.page_records(pages(spark, ROWS), least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == by_loop(ROWS, least)


def test_an_empty_table(spark):
    assert warc.page_records(pages(spark, [])).collect() == []


def test_files_are_one_stream_first_and_members_then(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4} " + "text " * 50) for i in range(20)]
    warc.page_records(pages(spark, rows).coalesce(1), folder=str(tmp_path)).count()
    plain = [f for f in os.listdir(tmp_path) if f.endswith(".warc.gz") and "members" not in f]
    parted = [f for f in os.listdir(tmp_path) if f.endswith(".members.warc.gz")]
    assert len(plain) == len(parted) == 1
    stream = zlib.decompressobj(warc.GZIP)
    stream.decompress((tmp_path / plain[0]).read_bytes())
    assert stream.eof and not stream.unused_data  # one member holds the file
    whole, index = (tmp_path / parted[0]).read_bytes(), [json.loads(x) for x in (tmp_path / parted[0].replace(".warc.gz", ".idx")).read_text().splitlines()]
    assert [x["type"] for x in index].count("response") == 4 and [x["type"] for x in index].count("revisit") == 16 and index[0]["type"] == "warcinfo"
    assert sum(x["length"] for x in index) == len(whole)
    for x in index:
        one = zlib.decompressobj(warc.GZIP)
        record = one.decompress(whole[x["offset"] : x["offset"] + x["length"]])
        assert one.eof and not one.unused_data and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert f"WARC-Record-ID: <{x['record_id']}>".encode() in record
    assert b"X-Injected" not in gzip.decompress(whole)


def test_payloads_are_read_back_whole(spark, tmp_path):
    records = warc.archived(pages(spark, ROWS), str(tmp_path))
    index = warc.normalised(records.select("archive").distinct(), str(tmp_path))
    found = warc.read(index.where("type = 'response'"), str(tmp_path), payload=True)
    got = sorted(((bytes(r.payload), r.target_uri) for r in found.collect()), key=repr)
    want = sorted((((h or "").encode(), None if u is None else re.sub(r"[\x00-\x20]+", " ", u).strip()) for _, u, h in ROWS), key=repr)
    assert got == want


@pytest.mark.parametrize("form", ["plain", "members", "one"])
def test_archives_of_others(spark, tmp_path, form):
    blocks = [b"hello", b"", b"a\r\n\r\nb" * 1000]
    records = [b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\nContent-Type: text/plain;\r\n folded\r\ncontent-length:  %d \r\n\r\n%s\r\n\r\n" % (i, len(b), b) for i, b in enumerate(blocks)]
    data = {"plain": b"".join(records), "members": b"".join(map(gzip.compress, records)), "one": gzip.compress(b"".join(records))}[form]
    (tmp_path / "other.warc.gz").write_bytes(data)
    index = warc.normalised(spark.createDataFrame([("other",)], "archive string"), str(tmp_path))
    found = warc.read(index, str(tmp_path), payload=True)
    assert sorted((r.record_id, r.type, r.payload_bytes, bytes(r.payload), r.payload_digest) for r in found.collect()) == [(f"urn:x:{i}", "resource", len(b), b, warc.payload_digest(b)) for i, b in enumerate(blocks)]


@pytest.mark.parametrize("data", [b"no warc at all", b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort", b"WARC/1.0\r\nContent-Le", gzip.compress(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")[:-9]])
def test_broken_archives_are_errors(data):
    with pytest.raises((ValueError, zlib.error)):
        list(warc.parsed(warc.inflated(iter([data]))))


def test_streams_in_pieces_of_any_size():
    records = [warc.response(b"urn:page:1::1", "u", bytes([i]) * n, "D") for i, n in enumerate((0, 1, 70_000))]
    data = gzip.compress(b"".join(records)) + b"\0" * 7
    for size in (1, 17, 4096):
        got = list(warc.parsed(warc.inflated(data[i : i + size] for i in range(0, len(data), size))))
        assert [head + b"\r\n\r\n" + block + b"\r\n\r\n" for head, block in got] == records
