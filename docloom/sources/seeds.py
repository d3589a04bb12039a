"""Seed files: CSV files with different headers, read with explicit schemas and united by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.domains import PRIORITY

# The header of each seed file.
HEADERS = {
    "sec_filings": "url,source_type,filing_type,fiscal_year,fiscal_quarter,priority,notes",
    "investor_relations": "url,source_type,content_type,priority,notes",
    "press_releases": "url,source_type,content_type,priority,notes",
    "blog": "url,source_type,content_type,category,priority,notes",
    "transcripts": "url,source_type,content_type,fiscal_year,fiscal_quarter,priority,notes",
    "media": "url,source_type,content_type,priority,notes",
}
COLUMNS = ("url", "source_type", "content_type", "category", "filing_type", "fiscal_year", "fiscal_quarter", "priority", "notes")


def unite(frames: list[DataFrame]) -> DataFrame:
    """Seed rows of all files: missing columns null, texts trimmed, empty ones null, the year an integer, a priority ordinal."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    have = [c for c in COLUMNS if c in every.columns]
    trimmed = every.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in have), *(F.lit(None).cast("string").alias(c) for c in COLUMNS if c not in have))
    ordinal = reduce(lambda w, p: w.when(F.col("priority") == p, PRIORITY[p]), PRIORITY, F.when(F.lit(False), 0))
    return trimmed.select(*COLUMNS).withColumns({"fiscal_year": F.col("fiscal_year").try_cast("int"), "priority_rank": ordinal})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All seed files of a folder, each read with the schema of its header."""
    frames = [spark.read.schema(", ".join(f"{c} string" for c in h.split(","))).csv(f"{folder.rstrip('/')}/{name}.csv", header=True) for name, h in HEADERS.items()]
    return unite(frames)


def crawl_queue(seeds: DataFrame, since: int | None = None, limit: int | None = None) -> DataFrame:
    """Seeds in the order of priority; with ``since``, those of earlier fiscal years are left out; then the first ``limit``."""
    if since is not None:
        seeds = seeds.where(F.col("fiscal_year").isNull() | (F.col("fiscal_year") >= since))
    seeds = seeds.orderBy("priority_rank", "url")
    return seeds if limit is None else seeds.limit(limit)
