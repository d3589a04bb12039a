"""First-seen flags, counts, membership and canonical mapping of URLs and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.urls import content_hash, normalize_url


def first_seen(df: DataFrame, url: str, content: str, seq: str) -> DataFrame:
    """``url_is_new`` and ``content_is_new`` in the order of ``seq``; a null content is always new and is not recorded.

    The first arrivals come from aggregations with map-side partial minima, which a key that a third of all rows share
    does not skew; a window over that key would put all of them into one task.
    """
    keyed = df.withColumns({"__u": normalize_url(url), "__c": content_hash(content)})
    urls = keyed.groupBy("__u").agg(F.min(seq).alias("__first_u"))
    contents = keyed.where(F.col("__c").isNotNull()).groupBy("__c").agg(F.min(seq).alias("__first_c"))
    found = keyed.join(urls, "__u", "left").join(contents, "__c", "left")
    return found.withColumns({
        "url_is_new": F.coalesce(F.col(seq) == F.col("__first_u"), F.lit(False)),
        "content_is_new": F.col("__c").isNull() | (F.col(seq) == F.col("__first_c")),
    }).drop("__u", "__c", "__first_u", "__first_c")


def counts(df: DataFrame, url: str, content: str) -> DataFrame:
    """Distinct canonical URLs and distinct contents."""
    return df.agg(F.countDistinct(normalize_url(url)).alias("url_count"), F.countDistinct(content_hash(content)).alias("content_count"))


def seen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is known."""
    return df.join(known.select(key).distinct(), key, "left_semi")


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def canonical_map(df: DataFrame, doc_id: str, content: str) -> DataFrame:
    """doc_id, content hash and the smallest id with that content."""
    hashed = df.select(F.col(doc_id).alias("doc_id"), content_hash(content).alias("content_hash"))
    return hashed.join(hashed.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_id")), "content_hash").select("doc_id", "content_hash", "canonical_id")


def drift(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Status of every key of two snapshots: added, removed, changed or same."""
    o, n = old.select(F.col(key), F.col(value).alias("__old")), new.select(F.col(key), F.col(value).alias("__new"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old") == F.col("__new"), "same").otherwise("changed")
    return o.join(n, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest ``order`` for each key; aggregated before the shuffle."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__row"))
    return best.select(key, "__row.*")


def arrival(df: DataFrame, key: str, order: str) -> DataFrame:
    """Arrival number of each row of a key, for keys of bounded size."""
    return df.withColumn("arrival", F.row_number().over(Window.partitionBy(key).orderBy(order)))
