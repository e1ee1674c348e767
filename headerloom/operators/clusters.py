"""Release clustering: files of a family join the best cluster before them in posting order, auxiliary files after all others.

Which cluster a file joins depends on all files before it, so a family is one sequence. It is cut where no choice can cross: a
file never joins a cluster of another declared total, so a family whose files all declare one is a sequence for each total.
A sequence is read as a stream, sorted by the shuffle, and held as one summary a cluster: what the rule asks of a cluster
(dominant poster, first stem and title, taken indexes, sizes, times) is kept up to date as files join, never looked up in their rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, namedtuple
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.functions.matching import canonical_key
from headerloom.functions.text import search_title

# The least score that joins a cluster, and what near times weigh for files and for auxiliary files.
JOIN_AT = 0.55
HOURS = (2, 12, 24)
NEAR, NEAR_AUXILIARY = (0.16, 0.10, 0.05), (0.18, 0.10, 0.05)
SCHEMA = "known boolean, family_key long, binary_id long, cluster_id long, score double"
_HOUR = 3_600_000_000
_NEVER = -(1 << 61)
# How many clusters are looked at one by one, before arrays narrow them down, and how many texts' codes are kept.
FEW, KEPT = 128, 1024
#: Columns of files that may be missing, and what then stands for them.
DEFAULTS = {"first_article_number": 0, "file_name": "", "family_title": "", "is_auxiliary": False}


def sequences(files: DataFrame) -> DataFrame:
    """files with ``unit``: 0, or the declared total where every file of the family declares one."""
    open_ = files.where("coalesce(expected_files, 0) <= 0").select("family_key").distinct().withColumn("open", F.lit(True))
    return files.join(open_, "family_key", "left").withColumn("unit", F.when(F.col("open") | F.col("family_key").isNull(), 0).otherwise(F.col("expected_files"))).drop("open")


def _related(one: str, other: str) -> bool:
    return bool(one and other) and (one in other or other in one)


def _alike(one: str, other: str) -> bool:
    """0.6 of the shorter text's words are the other's."""
    x, y = one.split(), other.split()
    return bool(x and y) and (one == other or sum(w in y for w in x) / min(len(x), len(y)) >= 0.6)


class _Codes:
    """Numbers of texts, and for a text which numbers' texts it goes with; what was found for the last texts is kept."""

    def __init__(self, test):
        self.test, self.texts, self.code, self.known = test, [], {}, {}

    def __getitem__(self, text: str) -> int:
        if text not in self.code:
            self.code[text] = len(self.texts)
            self.texts.append(text)
        return self.code[text]

    def fits(self, text: str) -> bytearray:
        have = self.known.get(text)
        if have is None:
            if len(self.known) >= KEPT:
                self.known.clear()
            have = self.known[text] = bytearray()
        if len(have) < len(self.texts):
            have.extend([self.test(text, other) for other in self.texts[len(have) :]])
        return have


class Cluster:
    """What the rule asks of a cluster."""

    __slots__ = ("any_stem", "companion", "counts", "first", "high", "last", "lead_count", "low", "main_stem", "names", "other", "own_title", "place", "poster", "sizes", "stem", "times", "title", "total")

    def __init__(self, place: int, first: int):
        self.place, self.first, self.total, self.low, self.high, self.last = place, first, 0, 0, 0, _NEVER
        self.poster, self.lead_count, self.counts = 0, 0, {}
        self.times, self.sizes, self.names = [], [], set()
        self.other = self.companion = False
        self.main_stem = self.any_stem = self.own_title = ""  # first stem of a file that is no companion, first stem of any, first title
        self.stem = self.title = 0

    def size_fits(self, size: int) -> bool:
        sizes = self.sizes
        if size <= 0 or not sizes:
            return False
        at = bisect_left(sizes, size)
        return (at < len(sizes) and abs(sizes[at] - size) / max(sizes[at], size) <= 0.15) or (at > 0 and abs(sizes[at - 1] - size) / max(sizes[at - 1], size) <= 0.15)

    def complements(self, file) -> bool:
        if file.name_kind == "repair":
            return self.other
        if file.name_kind == "info":
            return any(_related(file.stem, other) for other in self.names)
        return self.companion

    def gap(self, posted: int) -> int:
        """Time to its nearest file, on both sides of ``posted``."""
        at, times = bisect_left(self.times, posted), self.times
        if at == len(times):
            return posted - self.last
        return min(times[at] - posted, posted - times[at - 1]) if at else times[at] - posted


class Sequence:
    """The clusters of one sequence of files."""

    ARRAYS = ("total", "low", "high", "poster", "stem", "title", "last")

    def __init__(self):
        self.clusters: list[Cluster] = []
        self.stems, self.titles = _Codes(_related), _Codes(_alike)
        self.taken: dict[int, set[int]] = defaultdict(set)
        self.posters = {"": 0}  # numbers of posters, by their names as given and in lower case
        self.arrays: dict[str, np.ndarray] = {}  # of more than FEW clusters

    def _poster(self, poster: str) -> int:
        code = self.posters.get(poster)
        if code is None:
            code = self.posters[poster] = self.posters.setdefault(poster.lower(), len(self.posters) + 1)
        return code

    def _likely(self, file, total: int, poster: int, stem: bytearray, title: bytearray, trust: float) -> list[Cluster]:
        """The clusters that may be the best of all, in their order, by bounds of their scores."""
        index, n = file.file_index, len(self.clusters)
        have = {name: column[:n] for name, column in self.arrays.items()}
        fits = (have["total"] == 0) | (have["total"] == total) if total else np.ones(n, bool)
        most = 0.16 * ((have["poster"] == poster) & (poster > 0))
        if file.is_auxiliary:
            most = most * (0.18 / 0.16) + 0.38 * np.frombuffer(stem, bool)[have["stem"]] + 0.10 + 0.10 + NEAR_AUXILIARY[0] * file.dated + trust
            slack = 0.10 + NEAR_AUXILIARY[0] * file.dated
        else:
            layout = np.maximum(have["total"], total) > 1
            if index > 0:
                taken = np.fromiter(self.taken.get(index, ()), np.int64)
                fits[taken[layout[taken]]] = False
                most = most + 0.12 * (layout & (have["low"] > 0) & (have["low"] - 1 <= index) & (index <= have["high"] + 1))
            if file.dated:
                gap = np.abs(have["last"] - file.posted)
                most = most + np.select([gap <= h * _HOUR for h in HOURS], NEAR, 0.0)
            most = most + 0.16 * np.frombuffer(stem, bool)[have["stem"]] + 0.08 * np.frombuffer(title, bool)[have["title"]] + 0.22 + 0.12 + trust
            slack = 0.12
        some = np.flatnonzero(fits)
        if len(some):
            some = some[most[some] >= max(JOIN_AT, most[some].max() - slack) - 1e-9]
        return [self.clusters[c] for c in some.tolist()]

    def best(self, file) -> tuple[float, Cluster | None]:
        """(score, cluster) of the best cluster that the file may join, the earliest of equal ones; (1, None) without one."""
        some = self.clusters
        if not some:
            return 1.0, None
        total, index, posted = max(file.expected_files, 0), file.file_index, file.posted
        poster, stem = self._poster(file.poster), self.stems.fits(file.stem)
        trust = min(max(file.confidence, 0.0), 1.0) * (0.06 if file.is_auxiliary else 0.10)
        title = stem if file.is_auxiliary else self.titles.fits(file.title)
        if len(some) > FEW:
            some = self._likely(file, total, poster, stem, title, trust)
        score, best = 0.0, None
        bar = JOIN_AT - 1e-9  # what can't reach it needs no closer look
        if file.is_auxiliary:
            rest = 0.10 + trust
            for c in some:  # sums are in the rule's order, so that equal evidence is equal
                if total and c.total and c.total != total:
                    continue
                x = 0.10
                if stem[c.stem]:
                    x += 0.38
                if poster and c.poster == poster:
                    x += 0.18
                if x + NEAR_AUXILIARY[0] + rest < bar:
                    continue
                if file.dated and c.times:
                    x += _weight(c.gap(posted), NEAR_AUXILIARY)
                if x + rest < bar:
                    continue
                if c.complements(file):
                    x += 0.10
                x = min(x + trust, 1.0)
                if x > score:
                    score, best, bar = x, c, max(bar, x - 1e-9)
        else:
            taken = self.taken.get(index, ()) if index > 0 else ()
            for c in some:
                if total and c.total and c.total != total:
                    continue
                inside = False
                if index > 0 and (total > 1 or c.total > 1):
                    if c.place in taken:
                        continue
                    inside = c.low > 0 and c.low - 1 <= index <= c.high + 1
                x = 0.22
                if poster and c.poster == poster:
                    x += 0.16
                if file.dated:
                    gap = abs(posted - c.last)
                    if gap <= HOURS[-1] * _HOUR:
                        x += _weight(gap, NEAR)
                if stem[c.stem]:
                    x += 0.16
                if title[c.title]:
                    x += 0.08
                if x + (0.24 if inside else 0.12) + trust < bar:
                    continue
                if c.complements(file):
                    x += 0.07
                if c.size_fits(file.size_bytes):
                    x += 0.05
                if inside:
                    x += 0.12
                x = min(x + trust, 1.0)
                if x > score:
                    score, best, bar = x, c, max(bar, x - 1e-9)
        return (score, best) if score >= JOIN_AT else (1.0, None)

    def add(self, file, c: Cluster | None) -> int:
        """Puts a file into cluster c, or a new one, and returns the cluster's first file."""
        if c is None:
            c = Cluster(len(self.clusters), file.binary_id)
            self.clusters.append(c)
        if file.expected_files > 0:
            c.total = file.expected_files
        index = file.file_index
        if index > 0:
            self.taken[index].add(c.place)
            c.low = min(c.low or index, index)
            c.high = max(c.high, index)
        if file.poster:
            count = c.counts[file.poster] = c.counts.get(file.poster, 0) + 1
            if count > c.lead_count:
                c.lead_count, c.poster = count, self._poster(file.poster)
        if file.dated:
            insort(c.times, file.posted)
            c.last = c.times[-1]
        if file.size_bytes > 0:
            insort(c.sizes, file.size_bytes)
        kind = file.name_kind
        c.other = c.other or kind != "repair"
        c.companion = c.companion or kind != ""
        c.names.add(file.stem)
        if not file.is_companion:
            c.main_stem = c.main_stem or file.stem
        c.any_stem = c.any_stem or file.stem
        c.own_title = c.own_title or file.own_title
        stem = c.main_stem or c.any_stem
        c.stem = self.stems[stem]
        c.title = self.titles[file.family_title or c.own_title or stem]
        if len(self.clusters) > FEW:
            self._note(c)
        return c.first

    def _note(self, changed: Cluster) -> None:
        """Keeps the arrays up to date."""
        n = len(self.clusters)
        if not self.arrays:
            self.arrays = {name: np.array([getattr(c, name) for c in self.clusters], np.int64) for name in self.ARRAYS}
        for name in self.ARRAYS:
            if n > len(self.arrays[name]):
                self.arrays[name] = np.append(self.arrays[name], np.zeros(n, np.int64))
            self.arrays[name][changed.place] = getattr(changed, name)


def _weight(gap: int, weights) -> float:
    return weights[0] if gap <= HOURS[0] * _HOUR else weights[1] if gap <= HOURS[1] * _HOUR else weights[2] if gap <= HOURS[2] * _HOUR else 0.0


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group, held = None, Sequence()
    for batch in batches:
        file = namedtuple("File", batch.schema.names)
        joined, scores = [], []
        for row in map(file._make, zip(*map(_values, batch.columns))):
            if group != (row.known, row.family_key, row.unit):
                group, held = (row.known, row.family_key, row.unit), Sequence()
            score, c = held.best(row)
            joined.append(held.add(row, c))
            scores.append(round(score, 4))
        given = [batch.column(name) for name in ("known", "family_key", "binary_id")]
        yield pa.RecordBatch.from_arrays([*given, pa.array(joined, pa.int64()), pa.array(scores, pa.float64())], names=["known", "family_key", "binary_id", "cluster_id", "score"])


def release_clusters(files: DataFrame) -> DataFrame:
    """family_key, binary_id, cluster_id (its first binary_id), score (1 of a first file) of every file.

    files: family_key, binary_id, posted_at, poster, stem, title, file_index, expected_files, size_bytes, confidence, and if there
    first_article_number, file_name, family_title (the family's own title), is_auxiliary. Files come by posting time (null
    is 1970), first article and id; auxiliary files come after all others. Blank texts and zeros stand for nulls; a null family is one family; of equal scores the older cluster wins.
    A file without a stem has its name's. Sums are compared as they come, without rounding. A sequence (see above) is one task's work, in memory of some numbers a file.
    """
    for name, value in DEFAULTS.items():
        if name not in files.columns:
            files = files.withColumn(name, F.lit(value))
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    name = F.lower(text("file_name"))
    kind = (
        F.when(name.rlike(r"\.par2$|\.vol"), "repair").when(name.endswith(".nfo"), "info")
        .when(name.rlike(r"\.(rar|zip|7z|(7z|zip)\.\d{3}|r\d{2,3})$"), "archive").otherwise("")
    )
    stem = search_title(F.when(text("stem") != "", text("stem")).otherwise(canonical_key(text("file_name"))))
    rows = sequences(files.withColumn("expected_files", whole("expected_files"))).select(
        F.col("family_key").isNotNull().alias("known"), whole("family_key").alias("family_key"), "unit", "binary_id",
        F.col("posted_at").isNotNull().alias("dated"), F.coalesce(F.unix_micros(F.col("posted_at").cast("timestamp")), F.lit(0)).alias("posted"), whole("first_article_number").alias("article"),
        F.coalesce("is_auxiliary", F.lit(False)).alias("is_auxiliary"), text("poster").alias("poster"), stem.alias("stem"), kind.alias("name_kind"),
        name.rlike(r"\.(par2|nzb|nfo|sfv|srr)$|\.vol").alias("is_companion"), search_title(text("title")).alias("own_title"), search_title(text("family_title")).alias("family_title"),
        whole("file_index").alias("file_index"), "expected_files", whole("size_bytes").alias("size_bytes"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"),
    )
    titled = F.when(F.col("own_title") != "", F.col("own_title")).when(F.col("family_title") != "", F.col("family_title")).otherwise(F.col("stem"))
    order = ("known", "family_key", "unit", "is_auxiliary", "posted", "article", "binary_id")
    found = rows.withColumn("title", titled).repartition("family_key", "unit").sortWithinPartitions(*order).mapInArrow(_assign, SCHEMA)
    return found.select(F.when(F.col("known"), F.col("family_key")).alias("family_key"), "binary_id", "cluster_id", "score")
