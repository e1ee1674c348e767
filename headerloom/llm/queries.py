"""The contract queries of this package, one for each operator, and the SQL of those that SQL can state."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from headerloom.llm import additive, bpe, crosstok, dartminhash, hyperlang, mix, partcodes, qda, spans, tagpaths, urlfilter, vafile, warc
from headerloom.llm.shared import crc32_mod
from headerloom.sources.tables import table

#: The rules of the URL contract: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_dart_minhash(spark, sf_dir):
    """The near-duplicate class of every document."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_source_mix(spark, sf_dir):
    """What a mix of 150 % of all words at weights 5, 2, 1 takes of every document."""
    return mix.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)


def op3_additive_ann(spark, sf_dir):
    """The 20 nearest found of every 20th vector by inner product."""
    return additive.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def op4_tag_paths(spark, sf_dir):
    """The main text of every page."""
    return tagpaths.extracted(table(spark, sf_dir, "pages"))


def op5_url_filter(spark, sf_dir):
    """Every page's URL judged by the rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judged(table(spark, sf_dir, "pages"), rules)


def op6_hyper_lang(spark, sf_dir):
    """The language of every document, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    learned = hyperlang.prototypes(docs.where(crc32_mod("doc_id", 3) != 1))
    return hyperlang.identified(docs, learned).select("doc_id", F.coalesce(crc32_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def quality_labels(spark, sf_dir):
    """doc_id and label of the rows that the quality classifier may learn from."""
    labels = table(spark, sf_dir, "labels")
    return labels.where(crc32_mod("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))


def op7_qda_quality(spark, sf_dir):
    """The quality of every document, learned from four fifths of the labels."""
    scored = qda.scored(table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir), threshold=0.3)
    return scored.select("doc_id", F.coalesce(crc32_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_byte_bpe(spark, sf_dir):
    """Digests of every document's token ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encoded(table(spark, sf_dir, "documents"), path), path)


def op9_va_topk(spark, sf_dir):
    """The 10 highest integer inner products of every 100th vector."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", k=10, scale=1024)


def op10_sentence_spans(spark, sf_dir):
    """Every document without the sentences that repeat an earlier span, and how many those were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.deduplicated(docs, words=spans.SHORT, count_col="removed_sentences")


def op11_part_codes(spark, sf_dir):
    """Every vector as four codes of codebooks of 256 entries that all rows train."""
    coded = partcodes.compressed(table(spark, sf_dir, "embeddings"), scale=1024, words=256, rounds=4)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_warc(spark, sf_dir):
    """What the records of all pages say, written to archives, normalised and read back."""
    return warc.page_records(table(spark, sf_dir, "pages"), least=0)


def op13_cross_tokens(spark, sf_dir):
    """How every document's tokens of two vocabularies align."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return crosstok.aligned_documents(table(spark, sf_dir, "documents"), *paths)


QUERIES = {f.__name__: f for f in (op1_dart_minhash, op2_source_mix, op3_additive_ann, op4_tag_paths, op5_url_filter, op6_hyper_lang, op7_qda_quality, op8_byte_bpe, op9_va_topk, op10_sentence_spans, op11_part_codes, op12_warc, op13_cross_tokens)}


def _part_codes_sql() -> str:
    """The four rounds, one after the other."""
    out = """
        WITH sound AS MATERIALIZED (
          SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
                 row_number() OVER () AS r
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
          SELECT r, vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM sound, range(4) t(p)),
        book0 AS MATERIALIZED (
          SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id, r) - 1 AS INTEGER) AS e, x
          FROM parts WHERE r IN (SELECT r FROM sound WHERE vec_id IS NOT NULL ORDER BY vec_id, r LIMIT 256)),"""
    step = """
        near{i} AS MATERIALIZED (
          SELECT r, p, min(d) AS d, arg_min(e, (d, e)) AS e
          FROM (SELECT s.r, s.p, b.e, CAST(list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
                FROM parts s JOIN book{i} b ON s.p = b.p) GROUP BY r, p),"""
    move = """
        mean{i} AS MATERIALIZED (
          SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY j) AS x
          FROM (SELECT n.p, n.e, j, sum(s.x[j]) AS total, count(*) AS n
                FROM near{i} n JOIN parts s ON s.r = n.r AND s.p = n.p, range(1, 17) t(j) GROUP BY n.p, n.e, j) GROUP BY p, e),
        book{j} AS MATERIALIZED (
          SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e),"""
    for i in range(4):
        out += step.format(i=i) + move.format(i=i, j=i + 1)
    return out + step.format(i=4) + """
        coded AS (
          SELECT s.vec_id, s.label, string_agg(printf('%02x', n.e), '' ORDER BY n.p) AS code, CAST(sum(n.d) AS BIGINT) AS error
          FROM sound s JOIN near4 n ON n.r = s.r GROUP BY s.r, s.vec_id, s.label),
        books AS (
          SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM book4)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
        FROM coded, books"""


ORACLE_SQL = {
    "op2_source_mix": r"""
        WITH sized AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                 md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS key
          FROM documents),
        totals AS (
          SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
        weighed AS (
          SELECT *, source_size * 2 AS cap,
                 [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
          FROM totals),
        filled AS (
          SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
                 coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
                 sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_left
          FROM weighed),
        judged AS (
          SELECT *, (total - cap_before::DOUBLE) * weight::DOUBLE / weight_left::DOUBLE >= cap AS capped FROM filled),
        goals AS (
          SELECT source, source_size,
                 CASE WHEN capped THEN cap::DOUBLE
                      ELSE (total - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0)::DOUBLE) * weight::DOUBLE
                           / (sum(CASE WHEN NOT capped THEN weight END) OVER ())::DOUBLE END AS target
          FROM judged),
        placed AS (
          SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
                 CAST(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - s.size AS before,
                 CAST(floor(g.target) AS BIGINT) AS budget
          FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, source, size, source_size, target,
               CAST(CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
                    + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS BIGINT) AS taken
        FROM placed""",
    "op5_url_filter": r"""
        WITH rules(rhost, rpath, verdict) AS (
          VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        parts AS (
          SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages),
        fit AS (
          SELECT p.page_id, r.rhost || r.rpath AS rule, r.verdict,
                 row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC) AS place
          FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fit f ON f.page_id = p.page_id AND f.place = 1""",
    "op9_va_topk": """
        WITH sound AS (
          SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
          FROM embeddings
          WHERE vec_id IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id,
                 CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
        ranked AS (
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
          FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op11_part_codes": _part_codes_sql(),
    "op12_warc": """
        WITH hashed AS (
          SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
        encoded AS (
          SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(hex, i // 4 * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
          FROM hashed),
        placed AS (
          SELECT *, row_number() OVER same AS place, first_value(page_id) OVER same AS first_id
          FROM encoded WINDOW same AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id ASC NULLS LAST))
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN place > 1 THEN first_id END AS refers_to
        FROM placed""",
}
