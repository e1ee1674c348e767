"""The query of release clusters and its SQL: a recursion that puts one file of every family into its cluster at each step."""

from __future__ import annotations

from pyspark.sql import functions as F

from headerloom.operators import clusters
from headerloom.sources.tables import table


def release_clusters(spark, sf_dir):
    """Orders as files of ten customers' families, auxiliary ones among them, over months of hours."""
    key, family = F.col("o_orderkey"), F.floor(F.col("o_custkey") / 10)
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    stem = pick(F.col("o_custkey"), "some show", "show", "other", "x-y")
    hours = F.timestamp_add("HOUR", F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")), F.lit("2024-01-01").cast("timestamp"))
    rows = table(spark, sf_dir, "orders").select(
        family.alias("family_key"), key.alias("binary_id"), F.when(key % 23 != 0, hours).alias("posted_at"), (key % 5).alias("first_article_number"),
        F.when(key % 11 == 0, "").when(key % 11 == 1, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("poster"),
        F.when(F.col("o_custkey") % 4 == 2, "").otherwise(stem).alias("stem"), F.when(key % 3 == 0, "some.show pack").otherwise("").alias("title"),
        F.concat(stem, pick(key, ".rar", ".mkv", ".vol1+2.par2", ".nfo", ".sfv", "")).alias("file_name"), F.when(family % 3 == 0, "Some_Show").otherwise("").alias("family_title"),
        (key % 8).alias("file_index"), F.when(family % 2 == 0, pick(key, 3, 7)).otherwise(pick(F.col("o_custkey"), 0, 3, 7)).alias("expected_files"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"), ((key % 11) / 10.0).alias("confidence"), (key % 6).isin(2, 3, 4).alias("is_auxiliary"),
    )
    return clusters.release_clusters(rows)


def _points(condition: str, weight: str) -> str:
    return f"CASE WHEN {condition} THEN {weight}::DOUBLE ELSE 0::DOUBLE END"


def _near(first: str) -> str:
    gap = "list_min(list_transform(c.times, lambda t: abs(t - f.posted)))"
    return f"CASE WHEN f.posted IS NULL THEN 0::DOUBLE WHEN {gap} <= 2 THEN {first}::DOUBLE WHEN {gap} <= 12 THEN 0.10::DOUBLE WHEN {gap} <= 24 THEN 0.05::DOUBLE ELSE 0::DOUBLE END"


def _clusters_sql() -> str:
    stem = "CASE WHEN c.main_stem <> '' THEN c.main_stem ELSE c.any_stem END"
    title = f"CASE WHEN f.family_title <> '' THEN f.family_title WHEN c.title <> '' THEN c.title ELSE {stem} END"
    related = f"contains({stem}, f.stem) OR contains(f.stem, {stem})"
    poster = "c.lead <> '' AND lower(c.lead) = lower(f.poster)"
    layout = "f.file_index > 0 AND greatest(c.total, f.expected_files) > 1"
    alike = f"len(list_filter(string_split(f.full_title, ' '), lambda w: list_contains(string_split({title}, ' '), w))) / least(len(string_split(f.full_title, ' ')), len(string_split({title}, ' '))) >= 0.6"
    whole = "CASE f.kind WHEN 'repair' THEN c.other WHEN 'info' THEN list_bool_or(list_transform(c.stems, lambda s: contains(s, f.stem) OR contains(f.stem, s))) ELSE c.companion END"
    size = "len(list_filter(c.sizes, lambda s: abs(s - f.size_bytes) / greatest(s, f.size_bytes) <= 0.15)) > 0"
    inside = f"{layout} AND len(c.places) > 0 AND (f.file_index = list_min(c.places) - 1 OR f.file_index = list_max(c.places) + 1 OR (list_min(c.places) < f.file_index AND f.file_index < list_max(c.places)))"
    trust = "f.confidence"
    main = " + ".join(["0.22::DOUBLE", _points(poster, "0.16"), _near("0.16"), _points(related, "0.16"), _points(alike, "0.08"), _points(whole, "0.07"), _points(size, "0.05"), _points(inside, "0.12"), f"{trust} * 0.10::DOUBLE"])
    auxiliary = " + ".join(["0.10::DOUBLE", _points(related, "0.38"), _points(poster, "0.18"), _near("0.18"), _points(whole, "0.10"), f"{trust} * 0.06::DOUBLE"])
    count = "len(list_filter(c.posters, lambda p: p = f.poster)) + 1"
    leads = f"f.poster <> '' AND {count} > c.lead_count"
    return f"""
        WITH RECURSIVE given AS (
          SELECT o_custkey // 10 AS family_key, o_orderkey AS binary_id,
                 CASE WHEN o_orderkey % 23 <> 0 THEN date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) END AS posted, o_orderkey % 5 AS article,
                 CASE o_orderkey % 11 WHEN 0 THEN '' WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority END AS poster,
                 ['some show', 'show', 'other', 'x y'][o_custkey % 4 + 1] AS stem, CASE WHEN o_orderkey % 3 = 0 THEN 'some show pack' ELSE '' END AS title,
                 CASE WHEN o_custkey // 10 % 3 = 0 THEN 'some show' ELSE '' END AS family_title,
                 ['archive', '', 'repair', 'info', '', ''][o_orderkey % 6 + 1] AS kind, o_orderkey % 6 IN (2, 3, 4) AS companion, o_orderkey % 8 AS file_index,
                 CASE WHEN o_custkey // 10 % 2 = 0 THEN [3, 7][o_orderkey % 2 + 1] ELSE [0, 3, 7][o_custkey % 3 + 1] END AS expected_files,
                 CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, (o_orderkey % 11) / 10.0::DOUBLE AS confidence, o_orderkey % 6 IN (2, 3, 4) AS is_auxiliary
          FROM orders),
        files AS (
          SELECT *, CASE WHEN title <> '' THEN title WHEN family_title <> '' THEN family_title ELSE stem END AS full_title,
                 row_number() OVER (PARTITION BY family_key ORDER BY is_auxiliary, CASE WHEN posted IS NULL THEN -1 ELSE posted END, article, binary_id) AS n
          FROM given),
        run AS (
          SELECT DISTINCT family_key, 0::BIGINT AS n, 0::BIGINT AS binary_id, 0::BIGINT AS cluster_id, 0::DOUBLE AS score,
                 list_filter([{{'id': 0::BIGINT, 'total': 0, 'places': [0::BIGINT], 'sizes': [0::BIGINT], 'times': [0::BIGINT], 'posters': [''], 'lead': '', 'lead_count': 0::BIGINT, 'main_stem': '', 'any_stem': '', 'title': '',
                               'stems': [''], 'other': false, 'companion': false}}], lambda c: false) AS held
          FROM files
          UNION ALL
          SELECT family_key, n, binary_id, held[place].id, CASE WHEN is_new THEN 1::DOUBLE ELSE round(top, 4) END, held
          FROM (
            SELECT f.family_key, f.n, f.binary_id, f.place, f.is_new, f.top,
                   list_transform(CASE WHEN f.is_new THEN list_append(f.held, {{'id': f.binary_id, 'total': 0, 'places': []::BIGINT[], 'sizes': []::BIGINT[], 'times': []::BIGINT[], 'posters': []::VARCHAR[], 'lead': '', 'lead_count': 0::BIGINT,
                                  'main_stem': '', 'any_stem': '', 'title': '', 'stems': []::VARCHAR[], 'other': false, 'companion': false}}) ELSE f.held END,
                     lambda c, i: CASE WHEN i <> f.place THEN c ELSE {{
                       'id': c.id, 'total': greatest(c.total, f.expected_files), 'places': CASE WHEN f.file_index > 0 THEN list_append(c.places, f.file_index) ELSE c.places END,
                       'sizes': CASE WHEN f.size_bytes > 0 THEN list_append(c.sizes, f.size_bytes) ELSE c.sizes END, 'times': CASE WHEN f.posted IS NULL THEN c.times ELSE list_append(c.times, f.posted) END,
                       'posters': list_append(c.posters, f.poster), 'lead': CASE WHEN {leads} THEN f.poster ELSE c.lead END, 'lead_count': CASE WHEN {leads} THEN {count} ELSE c.lead_count END,
                       'main_stem': CASE WHEN c.main_stem = '' AND NOT f.companion THEN f.stem ELSE c.main_stem END, 'any_stem': CASE WHEN c.any_stem = '' THEN f.stem ELSE c.any_stem END,
                       'title': CASE WHEN c.title = '' THEN f.title ELSE c.title END, 'stems': list_append(c.stems, f.stem), 'other': c.other OR f.kind <> 'repair', 'companion': c.companion OR f.kind <> ''}} END) AS held
            FROM (
              SELECT *, top IS NULL OR top < 0.55::DOUBLE AS is_new, CASE WHEN top IS NULL OR top < 0.55::DOUBLE THEN len(held) + 1 ELSE list_position(scores, top) END AS place
              FROM (
                SELECT *, list_max(scores) AS top
                FROM (
                  SELECT f.*, r.held, list_transform(r.held, lambda c: CASE
                           WHEN f.expected_files > 0 AND c.total > 0 AND c.total <> f.expected_files THEN 0::DOUBLE
                           WHEN f.is_auxiliary THEN least(1::DOUBLE, {auxiliary})
                           WHEN {layout} AND list_contains(c.places, f.file_index) THEN 0::DOUBLE
                           ELSE least(1::DOUBLE, {main}) END) AS scores
                  FROM run r JOIN files f ON f.family_key = r.family_key AND f.n = r.n + 1))) f))
        SELECT family_key, binary_id, cluster_id, score FROM run WHERE n > 0"""


QUERIES = {"release_clusters": release_clusters}
ORACLE_SQL = {"release_clusters": _clusters_sql()}
