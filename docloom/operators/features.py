"""Time-safe features: lags on a dense spine, as-of joins, labels, splits and leakage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Last years of the training and validation periods.
TRAIN_END, VALIDATION_END = 2019, 2021
#: Spans of time that an as-of join without keys is dealt to.
BINS = 200


def lagged(series: DataFrame, order: str, value: str, lags: int = 4) -> DataFrame:
    """value_lag1..n, mean of the n rows before, and the changes lag1 - lag4 and lag1 - lag5.

    ``series`` has one row a quarter without gaps, so a window over all of it is small whatever the corpus.
    """
    w = Window.orderBy(order)
    x = F.col(value)
    cols = {f"{value}_lag{k}": F.lag(x, k).over(w) for k in range(1, lags + 1)}
    cols[f"{value}_mean"] = F.avg(x).over(w.rowsBetween(-lags, -1))
    cols[f"{value}_lag1_minus_lag4"] = F.lag(x, 1).over(w) - F.lag(x, 4).over(w)
    cols[f"{value}_lag1_minus_lag5"] = F.lag(x, 1).over(w) - F.lag(x, 5).over(w)
    return series.withColumns(cols)


def as_of(left: DataFrame, right: DataFrame, at: str, available: str, values: list[str], by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """``left`` with the latest ``right`` values available at ``at`` (before it, if ``strict``).

    Both sides are united and sorted once by key and time; the last values seen are carried forward.  No row meets
    another in a product, and keys are dealt over the cluster.  Without keys, spans of time with about as many rows each are:
    the last values of a span, a row a span, are carried to the next ones.  What is available at an unknown time never is.
    """
    by = by or []
    l_cols = left.columns
    side = F.lit(1 if not strict else 0)
    a = left.select(F.struct(*l_cols).alias("__l"), *[F.col(c).alias(f"__k_{c}") for c in by], F.col(at).alias("__t"), side.alias("__s"), F.lit(True).alias("__left"))
    b = right.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col(available).alias("__t"), (1 - side).alias("__s"), F.lit(False).alias("__left"), F.when(F.col(available).isNotNull(), F.struct(*values)).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    if not by:
        return _carried(both, l_cols, values)
    w = Window.partitionBy(*[f"__k_{c}" for c in by]).orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__left")
    return carried.select(*[F.col("__l")[c].alias(c) for c in l_cols], *[F.col(f"__v.{c}").alias(c) for c in values])


def _carried(both: DataFrame, l_cols: list[str], values: list[str]) -> DataFrame:
    """The as-of join of united sides without keys, dealt to spans of time."""
    edges = both.agg(F.percentile_approx("__t", [k / BINS for k in range(1, BINS)])).first()[0] or []
    later = [F.coalesce((F.col("__t") > F.lit(e)).cast("int"), F.lit(0)) for e in sorted(set(edges))]
    dealt = both.withColumn("__bin", reduce(lambda x, y: x + y, later, F.lit(0)))
    latest = F.max_by("__v", F.when(~F.col("__left"), F.struct("__t", "__s")))
    before = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    start = dealt.groupBy("__bin").agg(latest.alias("__last")).select(F.col("__bin").alias("__span"), F.last("__last", ignorenulls=True).over(before).alias("__before"))
    start = both.sparkSession.createDataFrame(start.collect(), start.schema)  # spans at most; the plan then reads both sides once
    within = Window.partitionBy("__bin").orderBy("__t", "__s").rowsBetween(Window.unboundedPreceding, 0)
    found = dealt.withColumn("__v", F.last("__v", ignorenulls=True).over(within)).where("__left").join(F.broadcast(start), F.col("__bin").eqNullSafe(F.col("__span")))
    known = F.when(F.col("__t").isNotNull(), F.coalesce("__v", "__before"))
    return found.withColumn("__v", known).select(*[F.col("__l")[c].alias(c) for c in l_cols], *[F.col(f"__v.{c}").alias(c) for c in values])


def next_period_label(series: DataFrame, order: str, close: str) -> DataFrame:
    """1 if the next close is higher, 0 if not, null for the last row; ``label_date`` is the next period."""
    w = Window.orderBy(order)
    nxt = F.lead(close).over(w)
    label = F.when(nxt > F.col(close), 1).when(nxt.isNotNull(), 0)
    return series.withColumns({"label": label, "label_date": F.lead(order).over(w)})


def chronological_split(year: Column) -> Column:
    """train, validation or test by year."""
    return F.when(year <= TRAIN_END, "train").when(year <= VALIDATION_END, "validation").otherwise("test")


def leakage(features: DataFrame, as_of_date: str, label_date: str) -> DataFrame:
    """Number of rows whose features are not strictly older than their label."""
    bad = F.col(as_of_date).isNull() | (F.col(as_of_date) >= F.col(label_date))
    return features.agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(bad, F.lit(False)).cast("bigint")).alias("violations"))


def split_overlap(df: DataFrame, split: str, at: str) -> DataFrame:
    """Whether the training period ends before the test period starts."""
    return df.agg(
        F.max(F.when(F.col(split) == "train", F.col(at))).alias("train_max"), F.min(F.when(F.col(split) == "test", F.col(at))).alias("test_min")
    ).withColumn("ok", F.col("train_max") < F.col("test_min"))


def allowed_only(features: DataFrame, as_of_date: str, quarter_start: str) -> DataFrame:
    """Drops features without a date and those not yet available at the quarter's start."""
    return features.where(F.col(as_of_date).isNotNull() & (F.col(as_of_date) <= F.col(quarter_start)))


def data_hash(df: DataFrame) -> DataFrame:
    """A hash of all rows that does not depend on their order; one long per task is shuffled."""
    return df.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("hash"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("checksum"))


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """0/1 columns for known values."""
    return reduce(lambda d, v: d.withColumn(f"{column}_{v}", (F.col(column) == v).cast("int")), values, df)


def expanding(series: DataFrame, order: str, value: str) -> DataFrame:
    """Mean and count of all earlier rows, the training window that grows with time; for series of one row a period."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return series.withColumns({f"{value}_so_far": F.avg(value).over(w), "n_so_far": F.count(value).over(w)})


def join_audit(joined: DataFrame, at: str, available: str, value: str) -> DataFrame:
    """One log row for each as-of join result: the time asked for, the time of what was found, its age and whether it leaks."""
    return joined.select(
        F.col(at).alias("asked_at"), F.col(available).alias("found_at"), F.datediff(at, available).alias("age_days"),
        F.col(value).isNotNull().alias("found"), F.coalesce(F.col(available) > F.col(at), F.lit(False)).alias("leaks"),
    )


def published_before(df: DataFrame, published: str, quarter_start: str) -> DataFrame:
    """How many documents were used in a quarter that ended before, or on the day, they were published, or whose date is unknown."""
    late = F.col(published).isNull() | (F.col(published) >= F.add_months(quarter_start, 3))
    return df.groupBy(quarter_start).agg(F.count("*").alias("n_rows"), F.sum(F.coalesce(late, F.lit(True)).cast("bigint")).alias("violations"))


def with_labels(features: DataFrame, labels: DataFrame, key: str = "quarter_id") -> DataFrame:
    """Features and labels of the same quarter; quarters with only one of them go, and a quarter that is labelled twice fails the job."""
    once = labels.groupBy(key).agg(*(F.first(c).alias(c) for c in labels.columns if c != key), F.count("*").alias("__n"))
    once = once.withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("labelled twice: "), F.col(key).cast("string")))).otherwise(F.col("__n")))
    return features.join(once.where("__n = 1").drop("__n"), key)


def z_score(df: DataFrame, value: str, train: Column) -> DataFrame:
    """``value_z``: the value less the training rows' mean, in their sample deviations."""
    known = df.where(train).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    return df.join(F.broadcast(known)).withColumn(f"{value}_z", F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")  # one row
