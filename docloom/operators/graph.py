"""Knowledge graph: entity mentions with evidence, typed edges with provenance, co-mentions, first appearances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.base import let
from docloom.functions.text import padded

# Node and edge types.
NODE_TYPES = ("Company", "Document", "Product", "Technology Capability", "Event", "Risk Topic")
EDGE_TYPES = ("MENTIONS", "DISCLOSES", "ANNOUNCES", "ASSOCIATED_WITH")
EXTRACTOR_VERSION = "docloom-1"


#: Aliases that are looked for inside each row; a longer lexicon meets the words of the sentences in a join.
FEW_ALIASES = 200


def mentions(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sentences that hold an alias of an entity at word boundaries.

    ``lexicon`` has entity_id, entity_type and alias.  Up to ``FEW_ALIASES`` of them, which is checked, are matched in the
    row, and only hits are exploded: no shuffle.  Of a longer lexicon, word n-grams meet the aliases in an equi-join by
    sentence id; sentences are joined to the hits afterwards.
    """
    aliases = lexicon.select("entity_id", "entity_type", F.trim(padded("alias")).alias("gram")).where("gram <> ''").distinct()
    few = aliases.limit(FEW_ALIASES + 1).collect()
    if len(few) <= FEW_ALIASES:
        kind = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in aliases.schema) + ">"
        held = F.array(*(F.struct(*(F.lit(v) for v in r)).cast(kind) for r in few)).cast(f"array<{kind}>")
        hits = let(padded("sentence"), lambda t: F.filter(held, lambda a: F.contains(t, F.concat(F.lit(" "), a["gram"], F.lit(" ")))))
        return sentences.select("doc_id", "sentence_id", "sentence", F.explode(hits).alias("a")).select("doc_id", "sentence_id", "sentence", "a.*")
    sizes = [r[0] for r in aliases.select(F.size(F.split("gram", " "))).distinct().collect()]  # a few lengths of phrases
    grams = lambda n: lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
    tokens = F.split(F.trim(padded("sentence")), " ", -1)
    every = let(tokens, lambda t: F.array_distinct(F.concat(*(grams(n)(t) for n in sizes))))
    found = sentences.select("doc_id", "sentence_id", F.explode(every).alias("gram")).join(aliases, "gram")
    return found.join(sentences.select("doc_id", "sentence_id", "sentence").dropDuplicates(["doc_id", "sentence_id"]), ["doc_id", "sentence_id"])


def canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``entity``: the name that an alias map (alias, entity) gives a value, whatever its case and punctuation, else the value."""
    known = aliases.groupBy(F.trim(padded("alias")).alias("__form")).agg(F.min("entity").alias("__entity"))
    found = df.withColumn("__form", F.trim(padded(column))).join(known, "__form", "left")
    return found.withColumn("entity", F.coalesce("__entity", column)).drop("__form", "__entity")


def entity_counts(found: DataFrame, entity_type: str = "entity_type", entity: str = "entity_id") -> DataFrame:
    """Distinct entities of each type."""
    return found.groupBy(entity_type).agg(F.countDistinct(entity).alias("n_entities"))


def edges(found: DataFrame, edge_type: str, source_url: Column, extracted_at: Column, confidence: float = 1.0) -> DataFrame:
    """Document edges to entities with full provenance."""
    provenance = F.struct(
        F.col("doc_id").cast("string").alias("source_doc_id"), source_url.alias("source_url"), F.col("sentence_id"), F.col("sentence").alias("evidence_text"),
        F.lit(confidence).alias("confidence"), extracted_at.alias("extracted_at"), F.lit(EXTRACTOR_VERSION).alias("extractor_version"),
    )
    return found.select(
        F.col("doc_id").cast("string").alias("src_id"), F.lit("Document").alias("src_type"), F.lit(edge_type).alias("edge_type"),
        F.col("entity_id").cast("string").alias("dst_id"), F.col("entity_type").alias("dst_type"), provenance.alias("provenance"),
    )


def co_mentions(left: DataFrame, right: DataFrame, doc: str, a: str, b: str, least: int = 1) -> DataFrame:
    """Documents in which an ``a`` and a ``b`` occur together; distinct first, so repeats in a document cost nothing."""
    pairs = left.select(doc, a).distinct().join(right.select(doc, b).distinct(), doc)
    return pairs.groupBy(a, b).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= least)


def associated(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected edges, stored once with the smaller id first."""
    return pairs.select(F.least(a, b).alias("src_id"), F.greatest(a, b).alias("dst_id"), F.lit("ASSOCIATED_WITH").alias("edge_type")).distinct()


def first_mention(found: DataFrame, entity: str, doc: str, at: str) -> DataFrame:
    """Earliest date of each entity, with the smallest document of that date."""
    return found.groupBy(entity).agg(F.min(F.struct(F.col(at).alias("at"), F.col(doc).alias("doc"))).alias("f")).select(entity, F.col("f.at").alias("first_at"), F.col("f.doc").alias("first_doc"))
