"""Queries on parts and files: deduplication, statistics, winners."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.operators import parts
from headerloom.sources.tables import table


def observation_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("binary_id"),
        F.col("l_linenumber").alias("part_number"),
        F.floor("l_extendedprice").cast("long").alias("segment_bytes"),
        F.col("l_partkey").alias("article_id"),
        F.col("l_shipdate").alias("posted_at"),
    )
    roots = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("binary_id"), F.col("o_orderdate").alias("root_posted_at"))
    return parts.observation_stats(lines, roots)


QUERIES = {"observation_stats": observation_stats}

ORACLE_SQL = {
    "observation_stats": """
        WITH ranked AS (
          SELECT l_orderkey AS binary_id, l_linenumber AS part_number, CAST(floor(l_extendedprice) AS BIGINT) AS segment_bytes,
                 l_shipdate AS posted_at,
                 row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                    ORDER BY floor(l_extendedprice) DESC, l_partkey ASC, l_shipdate ASC) AS rn
          FROM lineitem)
        SELECT o.o_orderkey AS binary_id, CAST(count(r.part_number) AS BIGINT) AS observed_parts,
               CAST(coalesce(sum(r.segment_bytes), 0) AS BIGINT) AS total_bytes,
               CAST(coalesce(max(r.part_number), 0) AS INTEGER) AS total_parts,
               coalesce(min(r.posted_at), min(o.o_orderdate)) AS posted_at,
               count(r.part_number) > 0 AND count(r.part_number) = coalesce(max(r.part_number), 0) AS is_complete
        FROM orders o LEFT JOIN ranked r ON r.binary_id = o.o_orderkey AND r.rn = 1
        GROUP BY o.o_orderkey""",
}
