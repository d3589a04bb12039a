"""Structured Streaming twins: dedup, daily counts, rate-limit state and a cache with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators import crawl


def events(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as a stream; event times become timestamps, which watermarks need."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern, since a stream takes a single file only by one
    return reader.parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(stream: DataFrame, key: str) -> DataFrame:
    """The first row of every key; the state keeps all keys."""
    return stream.dropDuplicates([key])


def first_seen_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of every key while it is within the watermark's delay; bounded state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def daily(stream: DataFrame, key: str, at: str, delay: str = "1 day", cap: int = crawl.DAILY_CAP) -> DataFrame:
    """Requests by key and day, late rows within ``delay`` counted, and whether they exceed the cap."""
    counts = stream.withWatermark(at, delay).groupBy(key, F.window(at, "1 day")).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").cast("date").alias("day"), "n", (F.col("n") > cap).alias("over_cap"))


class RateState(StatefulProcessor):
    """Rate and error count of a domain; emits them after every batch of outcomes."""

    def __init__(self, start: float = crawl.DEFAULT_DELAY):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "rate double, errors int, requests long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        rate, errors, n = self.state.get() if self.state.exists() else (self.start, 0, 0)
        log = pd.concat(list(rows)).sort_values("event_id")
        for failed in log["failed"].tolist():
            n += 1
            if failed:
                errors += 1
                if errors >= crawl.ERRORS_BEFORE_SLOW_DOWN:
                    rate = max(crawl.MIN_RATE, rate * crawl.SLOW_DOWN)
            elif errors > 0:
                rate, errors = min(self.start, rate * crawl.SPEED_UP), errors - 1
        self.state.update((rate, errors, n))
        yield pd.DataFrame({"user_id": [key[0]], "requests": [n], "error_count": [errors], "current_rate": [rate]})

    def close(self) -> None:
        pass


class FreshValue(StatefulProcessor):
    """The last value of a key while it is fresh, by the time of the rows; a timer drops it once the watermark has passed its end."""

    def __init__(self, seconds: int = crawl.ROBOTS_TTL):
        self.micros = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("value", "body string, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values("at_us", kind="stable")
        body, until = self.state.get() if self.state.exists() else (None, None)
        bodies, hits = [], []
        for at, fetched in zip(log["at_us"].tolist(), log["body"].tolist()):
            hits.append(until is not None and at < until)
            if not hits[-1]:
                body, until = fetched, at + self.micros
            bodies.append(body)
        self.state.update((body, until))
        self.handle.registerTimer(until // 1000 + 1)
        yield pd.DataFrame({"host": key[0], "at_us": log["at_us"].to_numpy(), "body": bodies, "hit": hits})

    def handleExpiredTimer(self, key, timer_values, expired) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self.state.get()[1] // 1000 < expired.getExpiryTimeInMs():
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def cached(stream: DataFrame, seconds: int = crawl.ROBOTS_TTL, at: str | None = None, delay: str = "1 day") -> DataFrame:
    """(host, body) answered from a cache with a time to live; ``hit`` tells which answers were cached.

    ``at`` is the time of a request, by default that of its batch.  Event time and a watermark bound the state, and let a
    run over what is there come to its end.
    """
    timed = stream.withColumn("__at", F.col(at) if at else F.current_timestamp()).withColumn("at_us", F.unix_micros("__at")).withWatermark("__at", delay)
    return timed.groupBy("host").transformWithStateInPandas(FreshValue(seconds), "host string, at_us long, body string, hit boolean", "Append", "EventTime")


def rate_state(stream: DataFrame, start: float = crawl.DEFAULT_DELAY) -> DataFrame:
    """Adaptive rates as keyed state; needs the RocksDB state store."""
    return stream.groupBy("user_id").transformWithStateInPandas(RateState(start), "user_id long, requests long, error_count long, current_rate double", "Update", "None")


def run_to_table(stream: DataFrame, name: str, mode: str, checkpoint: str | None = None) -> DataFrame:
    """Process what is there, once, into an in-memory table: for result sets of bounded size, such as reports and tests."""
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, once; the whole result replaces a Parquet folder after each batch, without passing through the driver."""

    def write(result: DataFrame, batch: int) -> None:
        result.write.mode("overwrite").parquet(path)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, once, into a Parquet folder; exactly once across restarts with the same checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
