"""Quality rules kept in a bitmask ledger (native: DataFrame expressions only).

Every rule is evaluated once for each document.  The ledger keeps the measurements and one long whose
bit *r* says that rule *r* failed.  A policy is a versioned mask over those bits: applying another policy
or asking what a single rule costs (an ablation) reads the ledger and never the texts again.

Defined results: a null or blank text has no words, measures zero everywhere and fails ``short``; repeated
rows are judged one by one; an empty table gives an empty ledger; columns of the input are kept, and one
that has the name of a ledger column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: Rule name -> failure condition over the measures.  The position is the bit; append only.
RULES: tuple[tuple[str, str], ...] = (
    ("short", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("upper_case", "100 * n_upper > 30 * word_chars"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["short"] | BITS["repeated_words"]
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "strict-1": sum(BITS.values()),
}
DEFAULT_POLICY = "strict-1"


def _repeated(windows: Column) -> Column:
    """Ascending start positions of the windows that occur twice or more."""

    def among(s: Column) -> Column:
        same = lambda k, j: F.get(s, k)["h"].eqNullSafe(F.get(s, j)["h"])
        found = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.sort_array(F.transform(found, lambda k: F.get(s, k)["i"]))

    return common.let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), among)


def _covered(starts: Column) -> Column:
    """Words covered by windows at these ascending positions."""

    def total(s: Column) -> Column:
        width = lambda k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - F.get(s, k), F.lit(WINDOW)))
        return F.when(F.size(s) > 0, F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), F.lit(0), lambda acc, k: acc + width(k))).otherwise(F.lit(0))

    return common.let(starts, total)


def _left(text: Column, keep: str) -> Column:
    """Characters of a class, counted by removing the runs of all others."""
    return F.length(F.regexp_replace(text, keep, "")).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures; windows are compared by 64-bit hashes within one text."""
    kept = [c for c in docs.columns if c not in MEASURES]
    t = F.col("__t")
    df = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    df = df.withColumns({"__w": common.words(t), "__l": F.filter(F.split(t, "\n", -1), lambda x: x.rlike(common.WORD))})
    df = df.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))

    def hashes(h: Column) -> Column:
        at = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))
        return F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), at)).otherwise(F.array().cast("array<bigint>"))

    df = df.withColumn("__v", common.let(F.col("__h"), hashes))
    twice = F.size(F.array_distinct("__v")) < F.size("__v")
    df = df.withColumn("__r", F.when(twice, _repeated(F.col("__v"))).otherwise(F.array().cast("array<int>")))
    return df.select(
        *kept,
        F.size("__w").cast("long").alias("n_words"),
        _left(t, common.SPACES).alias("word_chars"),
        _left(t, r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        common.barrier(_covered(F.col("__r")).cast("long")).alias("n_repeat_words"),
        F.size("__l").cast("long").alias("n_lines"),
        F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long").alias("n_upper"),
    )


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Measures and ``fail_bits``: every rule evaluated once."""
    bits = " + ".join(f"IF({condition}, {1 << i}L, 0L)" for i, (_, condition) in enumerate(RULES))
    return measure(docs.drop("fail_bits"), text).withColumn("fail_bits", common.barrier(F.expr(bits)))


def apply_policy(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """``kept`` under a versioned policy, from the ledger alone."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0)


def ablations(entries: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that only it rejects.

    One aggregation with map-side partial sums over single long values.
    """
    mask = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long"))
    names = [(name, bit) for name, bit in BITS.items() if bit & POLICIES[policy]]
    sums = entries.agg(
        F.count("*").alias("n_docs"),
        F.bit_or(mask).alias("seen_bits"),
        *(F.sum((mask.bitwiseAND(F.lit(bit).cast("long")) != 0).cast("long")).alias(f"f_{name}") for name, bit in names),
        *(F.sum((mask == bit).cast("long")).alias(f"o_{name}") for name, bit in names),
    )
    rows = F.array(*(F.struct(F.lit(name).alias("rule"), F.coalesce(f"f_{name}", F.lit(0)).alias("n_failed"), F.coalesce(f"o_{name}", F.lit(0)).alias("n_only")) for name, _ in names))
    return sums.select(F.lit(policy).alias("policy"), "n_docs", F.inline(rows))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the verdicts of the base and the default policy."""
    entries = apply_policy(ledger(common.table(spark, sf_dir, "documents").select("doc_id", "text")))
    base = F.col("fail_bits").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return entries.select("doc_id", *MEASURES[:5], base.alias("base_failed"), "kept", "fail_bits")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^ \t\n\x0B\f\r]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(i, i + 7)) AS p FROM rep) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS BIGINT) AS n_upper
      FROM w LEFT JOIN cov USING (r)),
f AS (SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
             + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words) THEN 16 ELSE 0 END
             + CASE WHEN 100 * n_upper > 30 * word_chars THEN 32 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM f
"""
