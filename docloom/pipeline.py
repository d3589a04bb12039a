"""The engine's batch pipeline: ingest, build, transform, signals, train.  Each stage reads and writes Parquet tables."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.urls import extract_domain, url_hash
from docloom.operators import dedup, features, graph, signals
from docloom.sources import documents, domains, seeds
from docloom.sources.tables import table


def queue(spark: SparkSession, folder: str, since: int | None = None, limit: int | None = None) -> DataFrame:
    """The crawl queue of a folder of seed files."""
    return seeds.crawl_queue(seeds.read(spark, folder), since, limit)


def ingest(spark: SparkSession, source: str, out: str, wanted: DataFrame | None = None) -> DataFrame:
    """Pages as documents, one for each content, with the smallest URL hash as the representative; ``wanted`` (url) restricts them."""
    docs = documents.pages_as_documents(table(spark, source, "pages").select("url", "html"))
    if wanted is not None:
        docs = dedup.seen(docs, wanted.select(url_hash("url").alias("url_hash")), "url_hash")
    rated = domains.lookup(docs.withColumn("domain", extract_domain("url"))).drop("domain")
    return dedup.latest(rated.withColumn("__order", F.col("url_hash")), "content_hash", "__order").drop("__order")


def build(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Empty entity and edge tables are views of what the later stages write: here the entities of the lexicon."""
    rows = [(p, "Risk Topic", p) for p in (*T.RISK_AI, *T.RISK_TECH, *T.RISK_OTHER)] + [(p, "Technology Capability", p) for p in (*T.AI_EXPLICIT, *T.AI_IMPLICIT)]
    return spark.createDataFrame(rows, "entity_id string, entity_type string, alias string")


def transform(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Mention edges of all sentences with their evidence."""
    s = T.sentences(spark.read.parquet(f"{out}/ingest"), "content_hash")
    found = graph.mentions(s, spark.read.parquet(f"{out}/build"))
    return graph.edges(found, "MENTIONS", F.col("doc_id"), F.current_timestamp())


def quarterly(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Quarterly signals of dated documents."""
    o = table(spark, source, "orders").withColumn("at", F.col("o_orderdate").cast("date"))
    return signals.quarterly(o, "at", close=F.avg("o_totalprice"), intensity=signals.share(F.col("o_orderpriority") == "1-URGENT"))


def train(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Lagged features with labels and splits, ready for the model."""
    q = spark.read.parquet(f"{out}/signals")
    q = features.next_period_label(q, "quarter_start", "close")
    return features.lagged(q, "quarter_start", "intensity").withColumn("split", features.chronological_split(F.year("quarter_start")))


STAGES = {"ingest": ingest, "build": build, "transform": transform, "signals": quarterly, "train": train}


def run(spark: SparkSession, stage: str, source: str, out: str, **options) -> DataFrame:
    """One stage, written below ``out`` and read back."""
    STAGES[stage](spark, source, out, **options).write.mode("overwrite").parquet(f"{out}/{stage}")
    return spark.read.parquet(f"{out}/{stage}")


def main(argv: Sequence[str] | None = None) -> None:
    """The command line: stage or ``all``, source and output folders; seed files can restrict what is ingested."""
    parser = argparse.ArgumentParser(prog="docloom.pipeline")
    parser.add_argument("stage", choices=[*STAGES, "all"])
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--seeds", help="folder of seed files; only their URLs are ingested")
    parser.add_argument("--since", type=int, help="leave out seeds of earlier fiscal years")
    parser.add_argument("--limit", type=int, help="take so many seeds at most, in the order of their priority")
    args = parser.parse_args(argv)
    session = SparkSession.builder.appName("docloom").getOrCreate()
    for name in STAGES if args.stage == "all" else [args.stage]:
        options = {}
        if name == "ingest" and args.seeds:
            queue(session, args.seeds, args.since, args.limit).write.mode("overwrite").parquet(f"{args.out}/queue")
            options["wanted"] = session.read.parquet(f"{args.out}/queue")
        run(session, name, args.source, args.out, **options)


if __name__ == "__main__":
    main()
