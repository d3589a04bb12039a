"""Validation against a gold set, sampling, calibration and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.base import let


def precision(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """True and false positives, positives missed, precision and coverage."""
    n = lambda c: F.sum(c.cast("bigint"))
    out = df.agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"), n(~predicted & actual).alias("fn"))
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return out.withColumns({"precision": part("tp", "fp"), "coverage": part("tp", "fn")})


def against_gold(predicted: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Precision and coverage of predicted keys against a gold set by the same keys; a key on one side only counts as an error."""
    both = predicted.select(*keys).distinct().withColumn("p", F.lit(True)).join(gold.select(*keys).distinct().withColumn("g", F.lit(True)), keys, "full")
    return precision(both, F.coalesce("p", F.lit(False)), F.coalesce("g", F.lit(False)))


def precision_report(df: DataFrame, category: str, predicted: Column, actual: Column, target: float = 0.8) -> DataFrame:
    """Lines of a Markdown report: true and false positives and precision of each category against the target."""
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    by = df.groupBy(category).agg(n(predicted & actual).alias("tp"), n(predicted & ~actual).alias("fp"))
    share = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    cells = [F.col(category).cast("string"), F.col("tp").cast("string"), F.col("fp").cast("string"), F.coalesce(F.format_number(share, 4), F.lit("-")), F.when(share >= target, "met").when(share.isNull(), "-").otherwise("below")]
    return by.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Rows for each pair of label and prediction."""
    return df.groupBy(actual, predicted).agg(F.count("*").alias("n"))


def calibration(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Mean correctness by tenth of confidence."""
    return df.groupBy(F.least(F.floor(F.col(confidence) * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def stratified(df: DataFrame, strata: list[str], key: str, k: int) -> DataFrame:
    """``k`` rows of each stratum in the order of a hash of the key: the same rows on every run.

    Spark keeps only the first ``k`` rows of a stratum in each task before the shuffle (a limit on a window's rank).
    """
    w = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def bucketed(key: Column, percent: int) -> Column:
    """Whether a key belongs to a fixed part of all keys, by the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % 100 < percent


def auc(df: DataFrame, score: str, label: str, bins: int = 200) -> DataFrame:
    """Area under the ROC curve by rank sums; ties count half.

    Scores are counted by value, then dealt to bins of about as many values each; bins are summed up in order, a row a bin, and
    ranked on their own, so no task sees all scores.
    """
    by = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("q"))
    edges = by.agg(F.percentile_approx(score, [k / bins for k in range(1, bins)])).first()[0] or []
    dealt = by.withColumn("__bin", F.size(F.filter(F.array(*map(F.lit, sorted(set(edges)))).cast("array<double>"), lambda e: e < F.col(score))))
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # over the bins, ``bins`` rows at most
    start = dealt.groupBy("__bin").agg(F.sum("q").alias("__q")).select("__bin", F.coalesce(F.sum("__q").over(before), F.lit(0)).alias("__below"))
    within = Window.partitionBy("__bin").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.withColumn("__within", F.coalesce(F.sum("q").over(within), F.lit(0))).join(start, "__bin")
    wins = ranked.withColumn("w", F.col("p") * (F.col("__below") + F.col("__within") + F.col("q") / 2))
    return wins.agg(F.try_divide(F.sum("w").cast("double"), (F.sum("p") * F.sum("q")).cast("double")).alias("auc"))


def classification(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Accuracy, balanced accuracy, precision, recall and the naive baselines: majority, chance, and always up."""
    n = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("double"))
    c = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    recall, special = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.try_divide(F.col("tn"), F.col("tn") + F.col("fp"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return c.select(
        F.try_divide(F.col("tp") + F.col("tn"), total).alias("accuracy"), ((recall + special) / 2).alias("balanced_accuracy"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), recall.alias("recall"),
        F.try_divide(F.greatest(F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")), total).alias("majority"), F.lit(0.5).alias("chance"), F.try_divide(F.col("tp") + F.col("fn"), total).alias("buy_and_hold"),
    )


def bootstrap(df: DataFrame, key: str, correct: str, rounds: int = 100) -> DataFrame:
    """95 % interval of the accuracy by a Poisson bootstrap: every row draws its weight in every round from a hash.

    Rows stay where they are; each task adds up ``rounds`` pairs of sums.
    """
    edges = F.array(*map(F.lit, (0.367879, 0.735759, 0.919699, 0.981012, 0.996340)))  # cumulative Poisson(1)
    u = lambda b: F.pmod(F.xxhash64(F.col(key), b), F.lit(1 << 20)) / float(1 << 20)
    weights = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda b: let(u(b), lambda x: F.size(F.filter(edges, lambda e: x >= e))))
    drawn = df.select(F.col(correct).cast("double").alias("c"), weights.alias("w"))
    means = drawn.agg(F.array(*(F.try_divide(F.sum(F.col("c") * F.col("w")[b]), F.sum(F.col("w")[b]).cast("double")) for b in range(rounds))).alias("ms")).select(F.explode("ms").alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
