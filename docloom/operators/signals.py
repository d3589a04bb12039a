"""Quarterly signals, coverage, gaps, shares and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.base import col

# Coverage targets of the corpus plan.
MIN_DOCS_PER_YEAR, MIN_AI_DOCS_PER_YEAR, AI_FROM_YEAR = 15, 30, 2020
# Least and most documents of each source type.
TYPE_TARGETS = {"sec_filing": (40, 50), "sec_8k": (50, 80), "earnings_transcript": (40, 50), "press_release": (80, 120), "blog": (50, 80), "news_media": (50, 100)}


def quarter(at: Column | str) -> Column:
    """First day of the quarter: sorts chronologically and is unambiguous."""
    return F.date_trunc("quarter", col(at).cast("timestamp")).cast("date")


def coverage(docs: DataFrame, at: str, by: str) -> DataFrame:
    """Documents by year and ``by``, with subtotals (null) of each and the total."""
    return docs.select(F.year(at).alias("year"), by).cube("year", by).agg(F.count("*").alias("n_docs"))


def against_target(counts: DataFrame, n: str, least: int) -> DataFrame:
    """Rows with how far they are below or above a target."""
    return counts.withColumns({"target": F.lit(least), "status": F.when(F.col(n) >= least, "met").otherwise("below"), "missing": F.greatest(F.lit(least) - F.col(n), F.lit(0))})


def against_ranges(counts: DataFrame, by: str, n: str, targets: dict[str, tuple[int, int]]) -> DataFrame:
    """Counts of each kind against its own least and most; kinds without rows count zero, kinds without a target have none."""
    goals = counts.sparkSession.createDataFrame([(k, *v) for k, v in targets.items()], f"{by} string, target_min int, target_max int")
    n_or_zero = F.coalesce(F.col(n), F.lit(0))
    status = F.when(F.col("target_min").isNull(), F.lit(None)).when(n_or_zero < F.col("target_min"), "below").when(n_or_zero > F.col("target_max"), "above").otherwise("met")
    return counts.join(goals, by, "full").select(by, n_or_zero.cast("bigint").alias(n), "target_min", "target_max", status.alias("status"))


def intensity(df: DataFrame, at: str, kind: str, weight: str) -> DataFrame:
    """Events of each month and kind, their summed weight and the mean weight."""
    by = df.groupBy(F.date_trunc("month", F.col(at).cast("timestamp")).cast("date").alias("month"), kind)
    return by.agg(F.count("*").alias("n_events"), F.sum(weight).alias("weight"), F.avg(weight).alias("intensity"))


def spine(df: DataFrame, at: str) -> DataFrame:
    """Every quarter from the first to the last one; its size depends on the calendar, not on the rows."""
    bounds = df.agg(F.min(quarter(at)).alias("lo"), F.max(quarter(at)).alias("hi"))
    return bounds.select(F.explode(F.expr("sequence(lo, hi, interval 3 months)")).alias("quarter_start"))


def missing_quarters(df: DataFrame, at: str) -> DataFrame:
    """Quarters between the first and the last that have no row."""
    return spine(df, at).join(df.select(quarter(at).alias("quarter_start")).distinct(), "quarter_start", "left_anti")


def quarterly(df: DataFrame, at: str, **measures: Column) -> DataFrame:
    """Measures of each quarter, available from the first day of the next one (``as_of_date``)."""
    out = df.groupBy(quarter(at).alias("quarter_start")).agg(F.count("*").alias("n_docs"), *(m.alias(k) for k, m in measures.items()))
    return out.withColumn("as_of_date", F.add_months("quarter_start", 3))


def share(flag: Column, of: Column | None = None) -> Column:
    """Part of the rows (of those with ``of``) that have a flag; null if there are none."""
    whole = F.count("*") if of is None else F.sum(of.cast("bigint"))
    part = flag if of is None else flag & of
    return F.try_divide(F.sum(part.cast("bigint")).cast("double"), whole.cast("double"))


def delta(df: DataFrame, value: str, order: str) -> DataFrame:
    """Change from the row before.  For series of one row a period, which are small whatever the corpus."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.orderBy(order)))


def variation(df: DataFrame, value: str) -> DataFrame:
    """Mean, sample deviation and coefficient of variation."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"))


def top_share(df: DataFrame, period: str, topic: str, k: int = 10) -> DataFrame:
    """The ``k`` topics with the most rows, their count and share of all rows by period."""
    top = df.groupBy(topic).agg(F.count("*").alias("total")).orderBy(F.desc("total"), topic).limit(k)
    counts = df.groupBy(period, topic).agg(F.count("*").alias("n"))
    whole = counts.withColumn("whole", F.sum("n").over(Window.partitionBy(period)))
    return whole.join(F.broadcast(top), topic).select(period, topic, "n", (F.col("n") / F.col("whole")).alias("share"))


def lead_lag(series: DataFrame, order: str, x: str, y: str, most: int = 4) -> DataFrame:
    """Correlation of x with y moved by -most..most periods, in one pass over the short series."""
    w = Window.orderBy(order)
    lags = range(-most, most + 1)
    moved = series.select(x, *(F.lag(y, -k).over(w).alias(f"y{i}") for i, k in enumerate(lags)))
    stats = moved.agg(*(F.corr(x, f"y{i}").alias(f"c{i}") for i in range(len(lags))))
    return stats.select(F.inline(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"c{i}").alias("corr")) for i, k in enumerate(lags)))))
