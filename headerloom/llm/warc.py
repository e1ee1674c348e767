"""WARC archives: monolithic gzip files normalised to a member a record, with a sidecar index of offsets.

A crawl's tasks write their pages as they lie into archives that are one gzip stream each, as many crawlers do; such a
file can only be read from its beginning. The normaliser inflates each stream once, rewrites every record as a gzip
member of its own, and writes beside the file an index of the members' offsets. From then on any record is read by itself, and one
file by many tasks. Records whose payload was seen before become revisits in the same pass.

Files are written beside the tables of the job under names of their own, so an attempt that is lost leaves a file that no committed
table names. Pages go from table to archive to archive without a shuffle; only their digests are grouped.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.hotkeys import with_facts
from headerloom.llm.shared import shared_folder, written

#: Payload and records after which a task begins a new archive: one that is larger holds a single record.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 1 << 26, 10_000
#: Bytes read or inflated at once, and of members that a task reads back.
CHUNK, SPLIT = 1 << 20, 1 << 24
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the format.
GZIP = 31
PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAK = b"\r\n\r\n"


def opened(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith(("/", "file:")):
        return arrow_fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return arrow_fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: bytes, name: bytes, fields: list[tuple[bytes, bytes]], block: bytes, date: bytes = DATE.encode()) -> bytes:
    """The bytes of one record. White space of a field's value is a space: a field is one line."""
    lines = [(b"WARC-Type", kind), (b"WARC-Record-ID", b"<" + name + b">"), (b"WARC-Date", date), *fields, (b"Content-Length", b"%d" % len(block))]
    head = b"".join(k + b": " + re.sub(rb"[\x00-\x20\x7f]+", b" ", v) + b"\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head + b"\r\n" + block + _BREAK


def response(name: bytes, url: str | None, payload: bytes, digest: str, date: bytes = DATE.encode()) -> bytes:
    fields = [] if url is None else [(b"WARC-Target-URI", url.encode())]
    fields += [(b"WARC-Payload-Digest", b"sha1:" + digest.encode()), (b"Content-Type", b"application/http; msgtype=response")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + _BREAK
    return record(b"response", name, fields, http + payload, date)


def fields_of(head: bytes) -> dict[bytes, bytes]:
    """Lower-case name to value of the lines after the first."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in lines)}


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, or of a plain one, in pieces of bounded size."""
    chunks = iter(chunks)
    first = b""
    while len(first) < 2 and (chunk := next(chunks, None)) is not None:
        first += chunk
    if first[:2] != b"\x1f\x8b":
        yield first
        yield from chunks
        return
    stream = None
    for chunk in itertools.chain([first], chunks):
        while chunk:
            if stream is None:
                chunk = chunk.lstrip(b"\0")  # padding between members
                if not chunk:
                    break
                stream = zlib.decompressobj(GZIP)
            piece = stream.decompress(chunk, CHUNK)
            if piece:
                yield piece
            chunk = stream.unconsumed_tail
            if stream.eof:
                chunk, stream = stream.unused_data, None
    if stream is not None:
        piece = stream.flush()
        if piece:
            yield piece
        if not stream.eof:
            raise ValueError("the gzip stream ends early")


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record of a stream; holds one record and one piece. A stream that is no WARC, or ends within a record, is an error."""
    held, at, more = bytearray(), 0, True

    def upto(size: int) -> bool:
        nonlocal held, at, more
        while more and len(held) - at < size:
            piece = next(pieces, None)
            if piece is None:
                more = False
                break
            if at > CHUNK:
                del held[:at]
                at = 0
            held += piece
        return len(held) - at >= size

    while True:
        while upto(2) and held[at : at + 2] == b"\r\n":
            at += 2
        if not upto(1):
            return
        end, size = -1, 1024
        while end < 0:
            whole = upto(size)
            end = held.find(_BREAK, at)
            if end < 0 and not whole:
                raise ValueError("the archive ends within a header")
            size *= 2
        head = bytes(held[at:end])
        length = fields_of(head).get(b"content-length", b"")
        if not head.startswith(b"WARC/") or not length.isdigit():
            raise ValueError("this is no WARC record")
        size = end - at + len(_BREAK) + int(length)
        if not upto(size):
            raise ValueError("the archive ends within a record")
        yield head, bytes(held[at + size - int(length) : at + size])
        at += size


def _chunks(stream) -> Iterator[bytes]:
    while chunk := stream.read(CHUNK):
        yield chunk


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", level: int = 6, date: str = DATE) -> DataFrame:
    """archive, nth, page_id, size, digest, same: the records that the tasks write to monolithic gzip archives in ``folder``, a row each.

    ``same`` is a stronger digest of the payload, by which payloads are equal or not.
    """
    names = ["archive", "nth", "page_id", "size", "digest", "same"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        store, path = opened(folder)
        sink = None
        for batch in batches:
            rows = []
            for page, url, body in zip(*(batch.column(i) for i in range(3))):
                page, url, body = page.as_py(), url.as_py(), body.as_py() or b""
                if sink is None:
                    name, nth, size = uuid.uuid4().hex, 0, 0
                    sink, squeeze = store.open_output_stream(f"{path}/{name}.warc.gz", compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    info = record(b"warcinfo", f"urn:page-archive:{name}".encode(), [(b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n", date.encode())
                    sink.write(squeeze.compress(info))
                nth, size = nth + 1, size + len(body)
                digest = payload_digest(body)
                sink.write(squeeze.compress(response(f"urn:page:{'' if page is None else page}:{name}:{nth}".encode(), url, body, digest, date.encode())))
                rows.append((name, nth, page, len(body), digest, hashlib.sha256(body).digest()))
                if size >= ARCHIVE_BYTES or nth >= ARCHIVE_RECORDS:
                    sink.write(squeeze.flush())
                    sink.close()
                    sink = None
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)
        if sink is not None:
            sink.write(squeeze.flush())
            sink.close()

    opened(folder)[0].create_dir(opened(folder)[1], recursive=True)
    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("body"))
    return written(plain.mapInArrow(run, "archive string, nth int, page_id long, size long, digest string, same binary"))


def revisits(records: DataFrame, least: int = 0) -> DataFrame:
    """archive, nth, refers_to: the records whose payload, of ``least`` bytes or more, an earlier record has; refers_to is that record's name.

    Earlier is the record of the smallest page_id (null last), of repeated page_ids one of them.
    """
    place = F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "archive", "nth")
    some = records.where(F.col("size") >= least)
    facts = written(some.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("__n")).where("__n > 1"))
    both = with_facts(some, facts, "same", "__n", records.count())
    name = F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("first.page_id").cast("string"), F.lit("")), "first.archive", F.col("first.nth").cast("string"))
    return both.where("archive <> first.archive or nth <> first.nth").select("archive", "nth", name.alias("refers_to"))


def _revisit(head: bytes, block: bytes, refers_to: str) -> bytes:
    """A response's bytes as a revisit of another: the HTTP header stays, the payload goes."""
    given = fields_of(head)
    fields = [(name, given[name.lower()]) for name in (b"WARC-Target-URI", b"WARC-Payload-Digest", b"Content-Type") if name.lower() in given]
    fields += [(b"WARC-Refers-To", b"<" + refers_to.encode() + b">"), (b"WARC-Profile", PROFILE)]
    return record(b"revisit", given[b"warc-record-id"].strip(b"<>"), fields, block.partition(_BREAK)[0] + _BREAK, given.get(b"warc-date", DATE.encode()))


def normalised(archives: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """archive, nth, type, record_id, offset, length: an index row for each record of the archives, rewritten as a member of its own.

    archives: archive (name of ``folder``/name.warc.gz), and for what is to become a revisit ``seen``: a list of (nth, refers_to), or null.
    Records count from 0. The new archive is name-id.members.warc.gz with its index beside it, a JSON line a record in
    name-id.members.idx; id is an attempt's own. An archive is one task's work (its stream has no other beginning) in memory of one record.
    """
    names = ["archive", "nth", "type", "record_id", "offset", "length"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        store, path = opened(folder)
        for batch in batches:
            for r in range(batch.num_rows):
                name = batch.column("archive")[r].as_py()
                seen = {x["nth"]: x["refers_to"] for x in batch.column("seen")[r].as_py() or ()}
                new, at, rows = f"{name}-{uuid.uuid4().hex[:8]}.members", 0, []
                with store.open_input_stream(f"{path}/{name}.warc.gz", compression=None) as source, store.open_output_stream(f"{path}/{new}.warc.gz", compression=None) as sink:
                    for nth, (head, block) in enumerate(parsed(inflated(_chunks(source)))):
                        whole = _revisit(head, block, seen[nth]) if nth in seen else head + _BREAK + block + _BREAK
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, GZIP)
                        member = squeeze.compress(whole) + squeeze.flush()
                        sink.write(member)
                        given = fields_of(head)
                        kind = "revisit" if nth in seen else given.get(b"warc-type", b"").decode("utf-8", "replace")
                        rows.append((new, nth, kind, given.get(b"warc-record-id", b"").strip(b"<>").decode("utf-8", "replace"), at, len(member)))
                        at += len(member)
                with store.open_output_stream(f"{path}/{new}.idx", compression=None) as index:
                    for row in rows:
                        index.write(json.dumps(dict(zip(names, row))).encode() + b"\n")
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    if "seen" not in archives.columns:
        archives = archives.withColumn("seen", F.lit(None).cast("array<struct<nth: int, refers_to: string>>"))
    return written(archives.select("archive", "seen").mapInArrow(run, "archive string, nth int, type string, record_id string, offset long, length long"))


def read(index: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """record_id, type, target_uri, refers_to, payload_bytes, payload_digest (and payload): the records of the index, each read by its offset.

    Members are dealt to tasks by archive and offset, about SPLIT bytes each, whatever file they are in. A revisit gives the length and digest
    of the payload that it refers to, its own payload is null; a response whose payload has another digest than it says is an error.
    """
    names = ["record_id", "type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]

    def one(member: bytes):
        head, block = next(parsed(inflated(iter([member]))))
        given = fields_of(head)
        text = lambda k: given[k].decode("utf-8", "replace").strip("<>") if k in given else None
        body = block.partition(_BREAK)[2] if given.get(b"content-type", b"").startswith(b"application/http") else block
        said = (text(b"warc-payload-digest") or "").removeprefix("sha1:")
        if given[b"warc-type"] == b"revisit":
            size, digest, body = int(fields_of(block.partition(_BREAK)[0]).get(b"content-length", b"0")), said, None
        else:
            size, digest = len(body), payload_digest(body)
            if said and said != digest:
                raise ValueError(f"{text(b'warc-record-id')}: the payload's digest is {digest}, not {said}")
        return text(b"warc-record-id"), text(b"warc-type"), text(b"warc-target-uri"), text(b"warc-refers-to"), size, digest, body if payload else None

    def run(batches):
        store, path = opened(folder)
        name, source, held, begin = None, None, b"", 0
        for batch in batches:
            rows, size = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source, held, begin = archive, store.open_input_file(f"{path}/{archive}.warc.gz"), b"", 0
                if not begin <= offset <= offset + length <= begin + len(held):
                    source.seek(offset)
                    begin, held = offset, source.read(max(length, CHUNK))
                rows.append(one(held[offset - begin : offset - begin + length]))
                size += rows[-1][4] if payload else 0
                if size > 4 * CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        if source is not None:
            source.close()

    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.select("archive", "offset", "length").repartitionByRange(max(1, -(-total // SPLIT)), "archive", "offset").sortWithinPartitions("archive", "offset")
    out = dealt.mapInArrow(run, "record_id string, type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")
    return out if payload else out.drop("payload")


def page_of(name):
    """The page_id in a record's name."""
    return F.split_part(name, F.lit(":"), F.lit(3)).try_cast("long")


def page_records(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives that are written, normalised and read back.

    Of the pages of one payload, of ``least`` bytes or more, that of the smallest page_id is the response and the others
    revisit it; of rows that repeat that page_id one is the response; a null page_id comes last. A null payload is empty; a null url is no
    field of the record. Payloads of any length are whole in their record; other columns are ignored; an empty table gives an empty one.
    """
    folder = folder or f"{shared_folder(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    records = archived(pages, folder, id_col, url_col, payload_col)
    seen = revisits(records, least).groupBy("archive").agg(F.collect_list(F.struct("nth", "refers_to")).alias("seen"))
    archives = written(records.select("archive").distinct().join(seen, "archive", "left"))  # at most ARCHIVE_RECORDS a list
    index = normalised(archives.repartition(max(1, archives.count())), folder)
    found = read(index.where("type <> 'warcinfo'"), folder)
    return found.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), page_of("refers_to").alias("refers_to"))
