"""Files that context split although their subjects hold complete counters: put together again, with everything that follows from it.

Fragments are grouped by the coordinates that their parts' subjects give. A group's target is the live file that has the group's canonical
key already, else the smallest fragment; earlier merges of incomplete targets join in. A file may be a fragment of several groups and a target of
others, so merges form chains: edges are pointed at the end of their chain by doubling, in as many rounds as the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.sources.folders import written

# What a merged file's identity says, and suffixes of auxiliary files.
KIND, REASON, SURE = "subject_multipart_obfuscated", "subject_multipart_regroup", 0.86
AUXILIARY = r"(\.par2|\.nfo|\.sfv|\.srr|\.srs|\.jpg|\.jpeg|\.png|\.gif|\.txt)$"
PLACE = ["group_id", "family_key", "file_name", "file_index", "file_total", "total_parts"]


def _plain(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def _first(*columns: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def fragments(files: DataFrame) -> DataFrame:
    """binary_id, group_id, family_key, name_key of the live, incomplete files of mere context whose name another such file of the family has.

    files: binary_id, group_id, binary_key, release_family_key, base_stem, source_key, file_name, family_kind, identity_reason,
    expected_files, total_parts, observed_parts, status.
    """
    some = files.where("family_kind = 'contextual_obfuscated' and identity_reason = 'contextual_fallback' and coalesce(status, 'active') <> 'superseded'")
    some = some.where("observed_parts < greatest(coalesce(total_parts, 0), 2) and trim(coalesce(file_name, '')) <> ''").withColumn("family_key", _first("release_family_key", "base_stem", "source_key")).where("trim(family_key) <> ''")
    some = some.select("binary_id", "group_id", "family_key", "file_name", F.lower(F.trim("file_name")).alias("name_key"))
    keys = ["group_id", "family_key", "name_key"]
    shared = some.groupBy(*keys, "file_name").count().where("count > 1").select(*keys).distinct()
    return some.join(shared, keys, "left_semi").drop("file_name")


def located_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    """The fragments' parts whose subjects name the file and count files and parts: PLACE, binary_id, part_number, segment_bytes.

    parts: part_id, binary_id, part_number, total_parts, segment_bytes, posted_at, file_name, subject_name, subject_index, subject_total, yenc_part, yenc_total.
    """
    rows = parts.select("binary_id", F.col("subject_name").alias("file_name"), F.col("subject_index").alias("file_index"), F.col("subject_total").alias("file_total"), F.col("yenc_total").alias("total_parts"), F.col("yenc_part").alias("part_number"), "segment_bytes")
    rows = rows.where("trim(file_name) <> '' and file_index > 0 and file_total > 0 and part_number > 0 and total_parts > 1")
    return rows.join(found, "binary_id").where(F.lower(F.trim("file_name")) == F.col("name_key")).drop("name_key")


def groups(located: DataFrame, files: DataFrame) -> DataFrame:
    """PLACE, stem, canonical_key, target, is_canonical of the places whose parts lie in two files or more and have two numbers or more."""
    bounds = [f(c).alias(f"{f.__name__}_{c}") for c in ("binary_id", "part_number") for f in (F.min, F.max)]
    found = located.groupBy(*PLACE).agg(*bounds).where("min_binary_id < max_binary_id and min_part_number < max_part_number")
    found = found.withColumns({"name": _plain(F.col("file_name")), "stem": _plain(F.regexp_replace(F.lower("file_name"), r"\.[^.]+$", ""))}).where("name <> '' and stem <> ''")
    found = found.withColumn("canonical_key", F.concat("stem", F.lit("::"), "name"))
    canonical = files.where("coalesce(status, 'active') <> 'superseded'").groupBy("group_id", F.col("binary_key").alias("canonical_key")).agg(F.min("binary_id").alias("canonical"))
    found = found.join(canonical, ["group_id", "canonical_key"], "left")
    return found.select(*PLACE, "stem", "canonical_key", F.coalesce("canonical", "min_binary_id").alias("target"), F.col("canonical").isNotNull().alias("is_canonical"))


def _better(one: str, other: str) -> Column:
    """Whether a file goes before another as a target: canonical ones first, then the smaller id."""
    rank = lambda side: F.struct(~F.col(f"{side}_canonical"), F.col(side))
    return rank(one) < rank(other)


def merges(located: DataFrame, found: DataFrame, earlier: DataFrame) -> DataFrame:
    """source, target: where each file that is merged away ends, one row a source.

    earlier: source, target of merges before. An edge points from the worse file to the better one (canonical targets first,
    then smaller ids), so edges make no circle; a file of several groups follows the best of its targets, and every chain ends in one file.
    """
    direct = located.join(found, PLACE).select(F.col("binary_id").alias("source"), "target").where("source <> target").unionByName(earlier.select("source", "target").where("source <> target")).distinct()
    canonical = found.where("is_canonical").select(F.col("target").alias("id")).distinct().withColumn("is_canonical", F.lit(True))
    for side in ("source", "target"):
        direct = direct.join(canonical.withColumnsRenamed({"id": side, "is_canonical": f"{side}_canonical"}), side, "left").withColumn(f"{side}_canonical", F.coalesce(f"{side}_canonical", F.lit(False)))
    turned = F.when(_better("source", "target"), F.struct(F.col("target").alias("source"), F.struct((~F.col("source_canonical")).alias("rank"), F.col("source").alias("id")).alias("to")))
    turned = F.coalesce(turned, F.struct(F.col("source"), F.struct((~F.col("target_canonical")).alias("rank"), F.col("target").alias("id")).alias("to")))
    edges = written(direct.select(turned.alias("e")).select("e.*").groupBy("source").agg(F.min("to").alias("to")).select("source", F.col("to.id").alias("target")))
    while True:
        onward = edges.select(F.col("source").alias("target"), F.col("target").alias("further"))
        jumped = written(edges.join(onward, "target", "left").select("source", F.coalesce("further", "target").alias("target"), F.col("further").isNotNull().alias("moved")))
        edges = jumped.select("source", "target")
        if jumped.where("moved").isEmpty():
            return edges


def _linked(files: DataFrame, parts: DataFrame, earlier: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The located parts, the groups, the earlier merges that take part again, and the edges."""
    located = written(located_parts(fragments(files), parts))
    chosen = written(groups(located, files))
    lasting = parts.groupBy(F.col("binary_id").alias("target")).agg(F.min("part_number").alias("a"), F.max("part_number").alias("b")).where("a < b").select("target")
    unsettled = files.where(F.col("identity_reason") != KIND).select(F.col("binary_id").alias("target"))
    again = earlier.join(lasting, "target", "left_semi").join(unsettled, "target", "left_semi")
    return located, chosen, again, merges(located, chosen, again)


def regrouped_edges(files: DataFrame, parts: DataFrame, earlier: DataFrame) -> DataFrame:
    """The ``edges`` of regrouped() alone; no part is moved for them."""
    return _linked(files, parts, earlier)[3]


def regrouped(files: DataFrame, parts: DataFrame, earlier: DataFrame) -> dict[str, DataFrame]:
    """What the merge leaves: ``edges`` (source, target), ``parts``, ``files``, ``dirty`` (group_id, family_key).

    files and parts as above, files also with match_confidence; earlier: source, target of merges before, whose targets take part again
    while they are not identified by their subject and hold two part numbers or more. parts: those of merged files under their target, of copies
    of a number the largest, then the smallest part_id; a moved part has its target's name and the greater total. files: sources are
    superseded, targets are active, identified by the subject, their parts and bytes counted anew, and their key is canonical; all others are as they were.
    A target of several groups takes the name of the one of most parts, then of the smallest name.
    """
    located, chosen, again, edges = _linked(files, parts, earlier)

    # What the groups and earlier merges say of each target, by the end of its chain.
    ends = edges.withColumnsRenamed({"source": "was", "target": "end"})
    size = located.groupBy(*PLACE).agg(F.count("*").alias("n"))
    said = chosen.join(size, PLACE).select("target", F.struct((-F.col("n")).alias("n"), "file_name", "family_key", "stem", "canonical_key", "file_index", "file_total", "total_parts").alias("says"))
    of = files.select(F.col("binary_id").alias("source"), F.col("file_name"), F.col("file_index"), F.col("expected_files"), F.col("total_parts"), _first("release_family_key", "base_stem", "source_key").alias("family_key"))
    old = again.join(of, "source").where("trim(coalesce(file_name, '')) <> ''").withColumn("stem", _plain(F.regexp_replace(F.lower("file_name"), r"\.[^.]+$", "")))
    one = F.lit(1)
    old = old.select("target", F.struct(F.lit(0).cast("long").alias("n"), "file_name", "family_key", "stem", F.concat("stem", F.lit("::"), _plain(F.col("file_name"))).alias("canonical_key"), F.greatest("file_index", one).alias("file_index"), F.greatest("expected_files", one).alias("file_total"), F.greatest("total_parts", one).alias("total_parts")).alias("says"))
    said = said.unionByName(old).join(ends, F.col("target") == F.col("was"), "left").withColumn("target", F.coalesce("end", "target"))
    said = written(said.groupBy("target").agg(F.min("says").alias("says"), F.max("says.total_parts").alias("most_parts"), F.max("says.file_total").alias("most_files")))

    moved = parts.join(ends, F.col("binary_id") == F.col("was"), "left").withColumn("target", F.coalesce("end", "binary_id")).drop("was")
    moved = moved.join(said.select("target", F.col("says.file_name").alias("new_name"), "most_parts"), "target", "left")
    away = F.col("end").isNotNull()
    moved = moved.select("part_id", F.col("target").alias("binary_id"), "part_number", F.when(away, F.greatest("total_parts", "most_parts")).otherwise(F.col("total_parts")).alias("total_parts"), "segment_bytes", "posted_at", F.when(away, F.col("new_name")).otherwise(F.col("file_name")).alias("file_name"), F.col("new_name").isNotNull().alias("merged"))
    moved = written(moved)
    rest = ["part_id", "total_parts", "segment_bytes", "posted_at", "file_name"]
    winners = moved.where("merged").groupBy("binary_id", "part_number").agg(F.min_by(F.struct(*rest), F.struct((-F.col("segment_bytes")).alias("a"), "part_id", "posted_at", "file_name", "total_parts")).alias("w")).select("binary_id", "part_number", "w.*")
    left = winners.unionByName(moved.where("not merged").select("binary_id", "part_number", *rest))

    stats = left.join(said.select(F.col("target").alias("binary_id")), "binary_id", "left_semi").groupBy("binary_id").agg(F.count("*").alias("seen"), F.sum("segment_bytes").alias("bytes"))
    rows = files.join(said.withColumnRenamed("target", "binary_id"), "binary_id", "left").join(stats, "binary_id", "left").join(edges.select(F.col("source").alias("binary_id"), F.col("target").alias("superseded_by")), "binary_id", "left")
    is_target, gone, says = F.col("says").isNotNull() & F.col("superseded_by").isNull(), F.col("superseded_by").isNotNull(), lambda c: F.col(f"says.{c}")
    new = {
        "binary_key": says("canonical_key"), "release_family_key": says("family_key"), "source_key": says("family_key"), "base_stem": says("stem"), "file_name": says("file_name"), "family_kind": F.lit(KIND), "identity_reason": F.lit(KIND),
        "file_index": F.greatest(says("file_index"), one), "expected_files": F.greatest("expected_files", "most_files"), "total_parts": F.greatest("total_parts", "most_parts"), "observed_parts": F.col("seen"), "match_confidence": F.greatest("match_confidence", F.lit(SURE)),
    }
    after = rows.select(*[F.when(is_target, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.when(gone, "superseded").when(is_target, "active").otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in files.columns], "superseded_by",
        F.when(is_target, F.lower(says("file_name")).rlike(AUXILIARY)).alias("is_auxiliary"), F.when(is_target, F.col("bytes")).alias("total_bytes"))
    dirty = said.join(files.select(F.col("binary_id").alias("target"), "group_id"), "target").select("group_id", F.col("says.family_key").alias("family_key")).where("trim(family_key) <> ''").distinct()
    return {"edges": edges, "parts": left, "files": after, "dirty": dirty}
