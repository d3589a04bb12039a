"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, secrets, piece ids.

Each stage works on everything that its predecessor kept.  ``run`` writes every stage as Parquet below the shared
checkpoint folder and reads it again, so that a lost executor costs the stage that runs and nothing before it.

Defined results: a null, empty or blank text fails the quality rules and goes; a very long one is worked on whole; copies
and rows that repeat an id leave one row; an empty table gives no rows; other columns keep their values, whatever their
names, but for ``n_chars`` of a text that changed and the columns of the last stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common, decontaminate, near_dedup, quality_rules, secret_scan, sentence_pieces


def _aside(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns but id and text under names that no operator uses, so that theirs replace none."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"__column_{k}" for k, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps; null, empty and blank texts fail it."""
    held = _aside(docs)
    return quality_rules.apply_policy(quality_rules.ledger(held)).where("kept").select(*held.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity from 0.8.  Of rows that repeat an id, one stays."""
    held = _aside(docs)
    return near_dedup.keep_one(held, size=5, least=80).select(*held.columns).toDF(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item; null texts have none."""
    held = _aside(docs)
    return decontaminate.decontaminate(held, common.table(spark, sf_dir, "benchmark")).select(*held.columns).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; ``n_chars``, where there is one, follows where a text changed."""
    held = _aside(docs)
    done = secret_scan.redact(held.withColumn("__before", F.col("text")), secret_scan.train(secret_scan.sample(spark)))
    if "n_chars" in docs.columns:
        n = held.columns[docs.columns.index("n_chars")]
        done = done.withColumn(n, F.when(F.col("text").eqNullSafe(F.col("__before")), F.col(n)).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*held.columns).toDF(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids and whether these decode to the text; columns named like these are replaced."""
    return sentence_pieces.round_trip(docs).drop("decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_duplicates),
    ("decontaminate", benchmark_passages),
    ("secret_scan", secrets),
    ("sentence_pieces", pieces),
]

#: SQL cannot express the secret models and the pieces; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = common.table(spark, sf_dir, "documents")
    where = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
