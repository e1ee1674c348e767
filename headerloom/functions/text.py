"""Column expressions for keys, names and counters of article subjects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value: Column) -> Column:
    """The value, worked out in a projection of its own: one with a higher-order function stays outside whole-stage code, whose single method soon is too long for the JVM to compile."""
    return bound(value, lambda x: x)


def normalize_key(value: Column) -> Column:
    """Lower case without what follows a yEnc mark; anything but letters and digits is one space."""
    text = F.regexp_replace(F.lower(value), r"\s+yenc.*$", "")
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "))


def search_title(value: Column) -> Column:
    """Lower case; dots, dashes, underscores and white space are one space."""
    return F.trim(F.regexp_replace(F.lower(value), r"[_.\-\s]+", " "))


def is_opaque(key: Column) -> Column:
    """A single token of twelve or more letters and digits that tells nothing."""
    return key.rlike("^[a-z0-9]{12,}$") & key.rlike("[0-9]")


def counters(subject: Column) -> dict[str, Column]:
    """File index and total from ``[i/n]``; part and total from the last ``(p/t)``; quoted file name. Parts default to 1 of 1."""

    def number(pattern: str, group: int, default: int) -> Column:
        found = F.regexp_extract(subject, pattern, group)
        return F.when(found == "", F.lit(default)).otherwise(found.cast("int"))

    files, part = r"\[(\d{1,9})/(\d{1,9})\]", r".*\((\d{1,9})/(\d{1,9})\)"
    return {
        "file_index": number(files, 1, 0),
        "file_total": number(files, 2, 0),
        "part_number": number(part, 1, 1),
        "part_total": number(part, 2, 1),
        "file_name": F.regexp_extract(subject, r'"([^"]+)"', 1),
        "is_yenc": F.lower(subject).contains("yenc"),
    }


def posting_window(posted_at: Column) -> Column:
    """``yyyymmdd-q``: the day and the quarter of it."""
    return F.concat(F.date_format(posted_at, "yyyyMMdd"), F.lit("-"), F.floor(F.hour(posted_at) / 6).cast("string"))


def composite_id(source: Column, guid: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("-"), guid), 256)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC sessions)."""
    return F.unix_micros(ts.cast("timestamp"))
