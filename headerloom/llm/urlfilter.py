"""URL filters by a sort-merge range join on reversed hosts.

A host is written with its labels reversed (``com/example/www/``), so a rule for a host and all its
subdomains is the interval of keys that start with the rule's key, and the intervals of rules are
nested or apart. Keys are cut into ranges at points taken from a bounded sample (the points only
balance the work); a rule goes to every range that its interval meets. Each range is sorted, and one
sweep over it keeps the stack of hosts whose intervals are open, each with its rules by path: a URL looks its path's
prefixes up, one for each length that the host's rules have, however many they are. URLs of one busy host are spread over
several ranges by a hash of their id.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.shared import sampled

#: Keys in the sample that places the cuts.
SAMPLE = 4096
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = "\U0010ffff"


def host_of(url):
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url):
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def host_key(host):
    """The labels of a host in reverse, each followed by a slash."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "/"), F.lit("/"))


class _Host:
    """The rules of one open host: key, host, verdict by path, and the lengths of these paths."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.verdicts, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        n, at = len(path), bisect_left(self.lengths, len(path))
        if at == len(self.lengths) or self.lengths[at] != n:
            insort(self.lengths, n)
        self.verdicts[path] = max(verdict, self.verdicts.get(path, verdict))

    def longest(self, path: str) -> str | None:
        """The longest of the paths that this one starts with."""
        for n in reversed(self.lengths[: bisect_left(self.lengths, len(path) + 1)]):
            if path[:n] in self.verdicts:
                return path[:n]
        return None


def _swept(parts):
    """Rows sorted by range, key and kind (rules first): each URL gets the longest rule that is open and fits its path."""
    stack: list[_Host] = []
    at = None
    for part in parts:
        rules, verdicts = [], []
        for zone, key, is_url, host, path, verdict in zip(part["zone"], part["key"], part["is_url"], part["host"], part["path"], part["verdict"]):
            if zone != at:
                at, stack = zone, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if not is_url:
                if not stack or stack[-1].key != key:
                    stack.append(_Host(key, host))
                stack[-1].add(path, verdict)
                rules.append(None)
                verdicts.append(None)
                continue
            best = (0, None, None)
            for one in stack:
                own = one.longest(path)
                if own is not None:
                    best = max(best, (len(one.host) + len(own), one.host + own, one.verdicts[own]), key=lambda x: (x[0], x[1] or ""))
            rules.append(best[1])
            verdicts.append(best[2])
        part = part.assign(rule=rules, verdict=verdicts)
        yield part.loc[part["is_url"], ["page_id", "host", "path", "rule", "verdict"]]


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", zones: int | None = None) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    rules: host, path, verdict, of any number. A rule fits its host and all subdomains if the URL's
    path starts with the rule's; the longest (host and path) wins, then the greater as text; of equal rules with
    several verdicts the greater verdict. Without a rule the rule is null and the verdict ``default``.
    Null URLs and those without ``://`` have an empty host and path, which no rule fits. Rows that
    repeat are judged each; an empty table gives an empty one; other columns are ignored.
    """
    zones = zones or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", F.when(F.col("host") == "", F.lit("")).otherwise(host_key(F.col("host"))))
    rows = rows.withColumn("spread", F.concat("key", F.lit("\u0000"), F.hex(F.xxhash64("page_id", "path"))))
    sample = sorted(r[0] for r in sampled(rows.select("spread"), "spread", SAMPLE).collect())
    cuts = sorted({sample[i * len(sample) // zones] for i in range(1, zones)}) if sample else []

    @F.pandas_udf("int")
    def zone_of(spread: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts, object), spread.to_numpy(object), "right").astype(np.int32) if cuts else np.zeros(len(spread), np.int32))

    urls = rows.select(zone_of("spread").alias("zone"), "key", F.lit(True).alias("is_url"), "page_id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    named = rules.select("host", "path", "verdict").where("host <> ''").withColumn("key", host_key(F.col("host")))
    reach = named.withColumn("zone", F.explode(F.sequence(zone_of("key"), zone_of(F.concat("key", F.lit(_LAST))))))
    kind = dict(urls.dtypes)["page_id"]
    reach = reach.select("zone", "key", F.lit(False).alias("is_url"), F.lit(None).cast(kind).alias("page_id"), "host", "path", "verdict")
    both = urls.unionByName(reach).repartition(zones, "zone").sortWithinPartitions("zone", "key", "is_url")
    out = both.mapInPandas(_swept, f"page_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
