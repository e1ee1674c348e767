"""Selection and regrouping of files: header resolution, best file of a name, merges of fragments, recovered kinds, reform lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_headers(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per incoming (group_id, article_number): the stored header_id or null, and the payload that came last.

    existing: group_id, article_number, header_id; incoming: group_id, article_number, seq, payload.
    """
    keys = ["group_id", "article_number"]
    last = incoming.groupBy(*keys).agg(F.max_by("payload", "seq").alias("payload"), F.count("*").alias("copies"))
    stored = existing.groupBy(*keys).agg(F.min("header_id").alias("header_id"))
    return last.join(stored, keys, "left").withColumn("action", F.when(F.col("header_id").isNull(), "insert").otherwise("resolve"))


def best_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """The best file of each key: main before auxiliary, complete before not, then the smaller binary_id."""
    order = F.struct((~F.col("is_main")).alias("a"), (~F.col("is_complete")).alias("b"), F.col("binary_id").alias("c"))
    rest = [c for c in files.columns if c not in keys]
    return files.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("w")).select(*keys, "w.*")


def regroup_targets(parts: DataFrame) -> DataFrame:
    """group_key, target_binary_id of groups whose parts lie in two files or more and have two numbers or more.

    parts: group_key, binary_id, part_number. The smallest and the largest tell whether there are two, so a
    hot group needs no set of its values.
    """
    low_high = parts.where("group_key is not null").groupBy("group_key").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("binary_id", "part_number") for f in (F.min, F.max)])
    return low_high.where("min_binary_id < max_binary_id and min_part_number < max_part_number").select("group_key", F.col("min_binary_id").alias("target_binary_id"))


def regrouped_parts(parts: DataFrame) -> DataFrame:
    """Parts of the merged files: of copies of a number the largest stays, then the smaller article_id."""
    moved = parts.join(regroup_targets(parts), "group_key").groupBy("target_binary_id", "group_key", "part_number")
    order = F.struct(F.col("segment_bytes").alias("a"), (-F.col("article_id")).alias("b"), (-F.col("binary_id")).alias("c"))
    return moved.agg(F.max_by(F.struct("segment_bytes", "article_id", F.col("binary_id").alias("source_binary_id")), order).alias("w"), F.count("*").alias("copies")).select("target_binary_id", "group_key", "part_number", "w.*", "copies")


def superseded(parts: DataFrame) -> DataFrame:
    """binary_id, target_binary_id of each file that another of its group replaces."""
    return parts.join(regroup_targets(parts), "group_key").where("binary_id <> target_binary_id").select("binary_id", "target_binary_id").distinct()


def recovered_kinds(files: DataFrame) -> DataFrame:
    """Opaque and numeric files of families whose other files agree on one kind, with that kind."""
    weak = F.col("kind").isin("opaque_set", "numeric_obfuscated_set")
    clear = files.where(~weak).groupBy("family_key").agg(F.min("kind").alias("recovered_kind"), F.max("kind").alias("__last")).where("recovered_kind = __last").drop("__last")
    return files.where(weak).join(clear, "family_key").select("family_key", "binary_id", "kind", "recovered_kind")


def reform_candidates(files: DataFrame, releases: DataFrame) -> DataFrame:
    """Released families that now hold more payload files than their release, or whose release has fewer than expected."""
    payload = files.groupBy("family_key").agg(F.count_if("is_main").alias("payload_files"), F.coalesce(F.max("expected_files"), F.lit(0)).alias("expected"))
    more = (F.col("payload_files") > F.col("release_files")) | ((F.col("expected") > F.col("release_files")) & (F.col("payload_files") >= F.col("expected")))
    return releases.join(payload, "family_key").where(more).select("family_key", "release_files", "payload_files", F.col("expected").cast("long").alias("expected"))
