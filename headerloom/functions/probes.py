"""What files are, by their first bytes and names: signatures, archive families, repair packets, archive headers, probe output."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First bytes in hexadecimal (dots stand for any) and the kind that they mean, in the order they are tried; kinds by extension; media types.
MAGIC = [
    ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("52494646........57454250", "webp"), ("504152320050", "par2"), ("52434C4F4E45", "rclone"), ("377ABCAF271C", "7z"),
    ("52617221", "rar"), ("504B0304", "zip"), ("1A45DFA3", "matroska"), ("........66747970........", "mp4"), ("52494646........41564920", "avi"), ("664C6143", "flac"), ("494433", "mp3"), ("FF[EF].", "mp3"),
]
EXTENSIONS = {"nfo": "text", "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "webp": "webp", "mkv": "matroska", "mp4": "mp4", "m4v": "mp4", "flac": "flac", "mp3": "mp3"}
MEDIA_TYPES = {
    "rclone": "application/octet-stream", "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "par2": "application/x-par2", "7z": "application/x-7z-compressed", "rar": "application/vnd.rar",
    "zip": "application/zip", "text": "text/plain", "matroska": "video/x-matroska", "mp4": "video/mp4", "flac": "audio/flac", "mp3": "audio/mpeg",
}
_PLAIN = "rar|zip|7z|tar|tgz|tar\\.gz|tar\\.xz|txz|tar\\.zst|tzst"
PROBE = "format struct<duration: string, size: string>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int, tags: map<string, string>>>"


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(F.trim(F.coalesce(name, F.lit(""))), r"\.([^./\\]*)$", 1))


def signature(data: Column, name: Column) -> Column:
    """The kind of a file by its first bytes; printable text is ``text``; else by its extension; empty if nothing tells."""
    head = F.hex(F.substring(data, 1, 256))
    found = F.lit("")
    ext = extension(name)
    for one, kind in reversed(EXTENSIONS.items()):
        found = F.when(ext == one, kind).otherwise(found)
    found = F.when(head.rlike("^(09|0A|0D|[2-6].|7[0-9A-E])+$"), "text").otherwise(found)
    for pattern, kind in reversed(MAGIC):
        found = F.when(head.rlike(f"^{pattern}"), kind).otherwise(found)
    return F.coalesce(found, F.lit(""))


def media_type(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(""))


def is_archive(name: Column) -> Column:
    return F.lower(F.trim(name)).rlike(rf"\.({_PLAIN})$|\.(7z|zip)\.\d{{3}}$|\.r\d{{2,3}}$")


def is_representative(name: Column) -> Column:
    """Whether an archive file stands for its family: a first volume, or an archive of one file."""
    low = F.lower(F.trim(name))
    return F.when(low.rlike(r"\.(7z|zip)\.\d{3}$"), low.endswith(".001")).when(low.rlike(r"\.part0*1\.rar$"), True).when(low.rlike(r"\.part\d+\.rar$|\.r\d{2,3}$"), False).otherwise(low.rlike(rf"\.({_PLAIN})$"))


def family_key(name: Column) -> Column:
    """The name that all volumes of an archive share."""
    low = F.lower(F.trim(name))
    return F.when(low.rlike(r"\.(7z|zip)\.\d{3}$"), F.regexp_replace(low, r"\.\d{3}$", "")).otherwise(F.regexp_replace(low, r"(\.part\d+\.rar|\.r\d{2,3})$", ".rar"))


def password_hints(text: Column) -> Column:
    """The words that follow ``pass``, ``password`` or ``pw`` in a text, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?:pass(?:word)?|pw)[\s:_-]*([a-z0-9._-]{3,})"), 1))


def best_entry(entries: Column) -> Column:
    """Of an archive's entries the first video or sound that is no sample, else the first that is neither, else the first sample; null if there is none."""
    name = F.filter(F.transform(entries, lambda x: F.trim(x)), lambda x: x != "")
    media, sample = (lambda x: F.lower(x).rlike(r"\.(mkv|mp4|avi|ts|mp3|flac|m4a|wav|ogg|aac)$")), (lambda x: F.lower(x).contains("sample"))
    first = lambda test: F.get(F.filter(name, test), F.lit(0))
    return F.coalesce(first(lambda x: media(x) & ~sample(x)), first(lambda x: ~media(x) & ~sample(x)), first(sample))


def little_endian(data: Column, at: int, n: int) -> Column:
    """The n bytes at an offset as a whole number, least byte first."""
    hexa = F.hex(F.substring(data, at + 1, n))
    return F.conv(F.concat(*[F.substring(hexa, 2 * i + 1, 2) for i in reversed(range(n))]), 16, 10).cast("decimal(20,0)")


def seven_zip_header(data: Column) -> dict[str, Column]:
    """start, size and crc of the header at the end of a 7z archive, from its first 32 bytes; nulls if it is none or says nothing."""
    offset, size = little_endian(data, 12, 8), little_endian(data, 20, 8)
    sound = F.hex(F.substring(data, 1, 6)).eqNullSafe(F.lit("377ABCAF271C")) & (F.length(data) >= 32) & (size > 0) & (offset < 2**62) & (size < 2**62)
    return {"start": F.when(sound, offset + 32).cast("long"), "size": F.when(sound, size).cast("long"), "crc": F.when(sound, little_endian(data, 28, 4)).cast("long")}


def probe(text: Column) -> Column:
    """The JSON object in a probe's output, whatever stands before and after it; null if there is none."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), PROBE)


def repair_targets(files: DataFrame, id_col: str = "file_id", data_col: str = "data") -> DataFrame:
    """file_id, name, size of each file that the packets of a repair file describe, once each by name (case ignored).

    Packets start with a mark and their length; one whose length cannot be right ends the file. Names are valid UTF-8 of
    letters, digits, dots, dashes, underscores, slashes and spaces. Files are read one at a time.
    """

    def of(data: bytes):
        at, seen = 0, set()
        while (at := data.find(b"PAR2\0PKT", at)) >= 0 and at + 64 <= len(data):
            (size,) = struct.unpack_from("<Q", data, at + 8)
            if size < 64 or size > len(data) - at:
                return
            if data[at + 48 : at + 64] == b"PAR 2.0\0FileDesc" and size >= 120:
                (length,) = struct.unpack_from("<Q", data, at + 112)
                name = data[at + 120 : at + size].split(b"\0")[0].strip()
                try:
                    text = name.decode()
                except UnicodeDecodeError:
                    text = ""
                if 0 < length <= 1 << 50 and 0 < len(name) <= 512 and text and all(c.isalnum() or c in "/\\._- " for c in text) and text.lower() not in seen:
                    seen.add(text.lower())
                    yield text, length
            at += size

    def run(batches):
        for batch in batches:
            found = [(i, *x) for i, data in zip(batch.column(0).to_pylist(), batch.column(1)) if data.is_valid for x in of(data.as_py())]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["file_id", "name", "size"])

    return files.select(F.col(id_col).cast("long").alias("file_id"), F.col(data_col).cast("binary").alias("data")).mapInArrow(run, "file_id long, name string, size long")
