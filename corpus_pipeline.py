"""A training-data pipeline of the corpus operators: each stage's table is written and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm import bpe, dartminhash, mix, qda, spans
from headerloom.llm.queries import quality_labels
from headerloom.llm.shared import written


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier accepts."""
    return qda.kept(docs, quality_labels(spark, sf_dir), threshold=0.3)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least doc_id; documents without text stay."""
    return dartminhash.distinct_documents(docs)


def substring_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated spans of sentences; those that consist of such spans go."""
    removed = "removed_sentences"
    while removed in docs.columns:
        removed += "_"
    out = spans.deduplicated(docs, words=spans.SHORT, count_col=removed).where(f"{removed} = 0 or text <> ''")
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n_chars)
    return out.select(*docs.columns)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at the target weights, a document once for each epoch it is taken in."""
    return mix.mixed_documents(docs)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the bytes that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encoded(docs, path, keep=("lang", "source")), path, keep=("lang", "source", "ids"))


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", tokens),
]
#: The classifier, the signatures and the tokenizer cannot be stated in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
