"""The text pipeline over ``documents``: each stage reads what the one before kept and wrote.

A stage takes (spark, docs, sf_dir). All but the last return the columns of ``documents``; the last gives the encoded corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import decontaminate, language_id, near_dedup, pieces, secrets
from trialspark.session import scratch_path

MIN_LANGUAGE_SCORE = 0.5


def with_length(df: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars follows the text; columns as in ``docs``."""
    n = F.length("text").cast(docs.schema["n_chars"].dataType)
    return df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n)).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter and texts whose language stays unclear go."""
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.with_language(docs, model, lang="_lang", score="_score")
    return found.filter((F.col("_lang") != language_id.UNKNOWN) & (F.col("_score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each class stays; one without an id only if no other is in its class."""
    return near_dedup.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that cover a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: secrets are masked in the text; the documents stay."""
    return with_length(secrets.mask_secrets(docs), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding: pieces of each text, with the proof that they decode to it."""
    return pieces.encoded_digests(docs, with_pieces=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # a network, a forest and a Viterbi search are beyond SQL; tests/llm test the stages


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    folder = scratch_path(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
