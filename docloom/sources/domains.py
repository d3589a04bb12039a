"""The allowlist of domains as a small dimension, and lookups in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.base import col
from docloom.functions.urls import strip

SCHEMA = "domain string, source_type string, priority int, requests_per_second double, requires_special_handling boolean"
# Source types and the ordinals of priorities.
SOURCE_TYPES = ("sec_filing", "earnings_transcript", "press_release", "blog", "investor_relations", "news_media")
PRIORITY = {"high": 1, "medium": 2, "low": 3}
# The allowed domains, their source type, priority, requests per second and special handling.
DOMAINS = (
    ("sec.gov", "sec_filing", 1, 0.1, False),
    ("www.sec.gov", "sec_filing", 1, 0.1, False),
    ("investor.workday.com", "investor_relations", 1, 0.5, False),
    ("newsroom.workday.com", "press_release", 2, 0.5, False),
    ("blog.workday.com", "blog", 2, 0.5, False),
    ("www.workday.com", "investor_relations", 3, 0.5, False),
    ("seekingalpha.com", "earnings_transcript", 2, 0.2, True),
    ("www.fool.com", "earnings_transcript", 2, 0.2, False),
    ("www.reuters.com", "news_media", 3, 0.2, False),
    ("techcrunch.com", "news_media", 3, 0.2, False),
    ("www.businesswire.com", "press_release", 2, 0.3, False),
    ("www.prnewswire.com", "press_release", 2, 0.3, False),
)
# The domains that the written source policy lists.
POLICY = ("sec.gov", "www.sec.gov", "investor.workday.com", "newsroom.workday.com", "blog.workday.com", "seekingalpha.com", "fool.com", "reuters.com", "techcrunch.com", "venturebeat.com")
DEFAULT_RATE = 1.0


def dimension(spark: SparkSession) -> DataFrame:
    """One row for each allowed domain."""
    return spark.createDataFrame(list(DOMAINS), SCHEMA)


def key(domain: Column | str) -> Column:
    """The form in which domains are compared: lower case, no white space around."""
    return strip(F.lower(col(domain)))


def lookup(df: DataFrame, domain: str = "domain", default_rate: float = DEFAULT_RATE) -> DataFrame:
    """``df`` with source type, priority, request rate (or the default) and ``allowed``.

    The dimension has twelve fixed rows, so it is broadcast whatever the size of ``df``.
    """
    dim = dimension(df.sparkSession).withColumnRenamed("domain", "__key")
    found = df.join(F.broadcast(dim), key(domain) == F.col("__key"), "left")
    return found.withColumn("allowed", F.col("__key").isNotNull()).withColumn("requests_per_second", F.coalesce("requests_per_second", F.lit(default_rate))).drop("__key")


def by_source_type(spark: SparkSession, source_type: str) -> DataFrame:
    """Domains of a source type."""
    return dimension(spark).where(F.col("source_type") == source_type)


def by_priority(spark: SparkSession, priority: int) -> DataFrame:
    """Domains of a priority."""
    return dimension(spark).where(F.col("priority") == priority)


def all_domains(spark: SparkSession) -> DataFrame:
    """The allowed domains."""
    return dimension(spark).select("domain")
