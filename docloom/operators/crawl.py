"""Crawl planning: robots verdicts, request schedules, adaptive rates, back-off, retries and caps, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from docloom.functions.base import col
from docloom.functions.urls import extract_domain

# Back-off and rate constants.
INITIAL_BACKOFF, MAX_BACKOFF, BACKOFF_MULTIPLIER, JITTER = 1.0, 60.0, 2.0, 0.1
MIN_RATE, SLOW_DOWN, SPEED_UP, ERRORS_BEFORE_SLOW_DOWN = 0.1, 0.5, 1.1, 3
DAILY_CAP, ROBOTS_TTL, DEFAULT_DELAY, MAX_RETRIES = 1000, 3600, 1.0, 3
#: Statuses that mean "no robots file"; ``compat`` denies them as the parser does when it never read a file.
MISSING = (404, 410)


def backoff(attempt: Column | str, initial: float = INITIAL_BACKOFF, maximum: float = MAX_BACKOFF, multiplier: float = BACKOFF_MULTIPLIER) -> Column:
    """Seconds to wait after an attempt, without jitter."""
    return F.least(F.lit(initial) * F.pow(F.lit(multiplier), col(attempt).cast("double")), F.lit(maximum))


def with_jitter(seconds: Column, seed: int = 42) -> Column:
    """Up to a tenth more or less; kept apart because it is random."""
    return seconds * (1 + (F.rand(seed) * 2 - 1) * JITTER)


def min_delay(rate: Column | str) -> Column:
    """Seconds between requests."""
    return F.lit(1.0) / col(rate)


def gaps(requests: DataFrame, domain: str, at: str, order: str) -> DataFrame:
    """Microseconds since the domain's previous request (``gap_us``); null for the first."""
    us = F.unix_micros(F.col(at).cast("timestamp"))
    return requests.withColumn("gap_us", us - F.lag(us).over(Window.partitionBy(domain).orderBy(at, order)))


def schedule(requests: DataFrame, domain: str, arrival: str, order: str, interval: float) -> DataFrame:
    """Start of each request at a constant interval: ``t_i = max(arrival_i, t_(i-1) + interval)``.

    The recurrence has the closed form ``i * interval + max over j <= i of (arrival_j - j * interval)``, a running
    maximum, so one sort by domain and time does it.  Whole microseconds keep it exact.
    """
    w = Window.partitionBy(domain).orderBy(arrival, order)
    step = int(interval * 1_000_000)
    i = F.row_number().over(w).cast("bigint")
    df = requests.withColumn("__i", i).withColumn("__a", F.unix_micros(F.col(arrival).cast("timestamp")))
    start = F.col("__i") * step + F.max(F.col("__a") - F.col("__i") * step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("start_us", start).withColumn("wait_us", F.col("start_us") - F.col("__a")).drop("__i", "__a")


def adaptive_rates(log: DataFrame, domain: str, order: str, failed: str, start: float = DEFAULT_DELAY) -> DataFrame:
    """Rate and error count of each domain after its whole log.

    Each outcome depends on the state before it, so sorted partitions are folded as a stream: a domain's log is read
    once, in batches, and only its state is held.  From the third counted error on the rate halves, down to a floor; a
    success takes one error back and raises the rate by a tenth, up to where it started, while errors are counted.
    """
    kind = log.schema[domain].dataType
    rows = log.select(F.col(domain), F.col(order).alias("__order"), F.col(failed).alias("__failed")).repartition(domain).sortWithinPartitions(domain, "__order")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for key, bad in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if now is None or now[0] != key:
                    now = [key, 0, 0, start]
                    done.append(now)
                now[1] += 1
                if bad:
                    now[2] += 1
                    if now[2] >= ERRORS_BEFORE_SLOW_DOWN:
                        now[3] = max(MIN_RATE, now[3] * SLOW_DOWN)
                elif now[2] > 0:
                    now[2], now[3] = now[2] - 1, min(start, now[3] * SPEED_UP)
            if len(done) > 1:
                yield made(done[:-1])
                done = done[-1:]
        if done:
            yield made(done)

    def made(states: list[list]) -> pa.RecordBatch:
        kinds = (to_arrow_type(kind), pa.int64(), pa.int32(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*states), kinds)], [domain, "requests", "error_count", "current_rate"])

    return rows.mapInArrow(fold, StructType([StructField(domain, kind), StructField("requests", LongType()), StructField("error_count", IntegerType()), StructField("current_rate", DoubleType())]))


def domain_stats(log: DataFrame, domain: str, failed: Column) -> DataFrame:
    """Requests and errors of each domain."""
    return log.groupBy(domain).agg(F.count("*").alias("request_count"), F.sum(failed.cast("bigint")).alias("error_count"))


def retry_outcomes(attempts: DataFrame, domain: str, order: str, failed: Column, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Runs of attempts: a task ends with its first success or after ``max_retries + 1`` failures.

    A run of failures starts behind a success; its length says how many tasks gave up within it and at which attempt the next
    success came.  Waiting time is the back-off before each retry.
    """
    w = Window.partitionBy(domain).orderBy(order)
    ok = (~failed).cast("bigint")
    df = attempts.withColumn("__run", F.sum(ok).over(w) - ok).withColumn("__k", F.row_number().over(Window.partitionBy(domain, "__run").orderBy(order)) - 1)
    size = max_retries + 1
    df = df.withColumns({"task": F.floor(F.col("__k") / size), "__at": F.col("__k") % size})
    out = df.groupBy(domain, F.col("__run").alias("run"), "task").agg(
        F.count("*").alias("attempts"), F.max(ok).alias("succeeded"),
        F.sum(F.when(F.col("__at") > 0, backoff(F.col("__at") - 1)).otherwise(F.lit(0.0))).alias("waited"),
    )
    return out.withColumn("success", F.col("succeeded") == 1).drop("succeeded")


def daily_cap(requests: DataFrame, domain: str, at: str, cap: int = DAILY_CAP) -> DataFrame:
    """Requests of a domain and day, and whether they exceed the cap."""
    return requests.groupBy(domain, F.to_date(at).alias("day")).agg(F.count("*").alias("n")).withColumn("over_cap", F.col("n") > cap)


def fresh(cache: DataFrame, fetched_at: str, now: Column, ttl: int = ROBOTS_TTL) -> DataFrame:
    """Cached rows that are younger than the time to live."""
    return cache.where(now - F.col(fetched_at) < ttl)


def cache_stats(cache: DataFrame, fetched_at: str, now: Column, ttl: int = ROBOTS_TTL) -> DataFrame:
    """Entries of a cache, and those that are still fresh."""
    is_fresh = now - F.col(fetched_at) < ttl
    return cache.agg(F.count("*").alias("cache_size"), F.coalesce(F.sum(is_fresh.cast("bigint")), F.lit(0).cast("bigint")).alias("n_fresh"))


def parse_robots(files: DataFrame, host: str = "host", body: str = "body", agent: str = "*") -> DataFrame:
    """host, pos, allow, prefix and delay of the rules that hold for an agent, in file order.

    A group names agents by a part of the product token before its slash, whatever the case; the group of ``*`` holds
    where no other does.  An empty Disallow allows everything; a delay counts if it is a whole number.
    """
    lines = files.select(F.col(host).alias("host"), F.posexplode(F.split(F.col(body), "\r\n|\r|\n", -1)).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select("host", "pos", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("k"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("v"), (line == "").alias("blank"))
    w = Window.partitionBy("host").orderBy("pos")
    agent_line = F.col("k") == "user-agent"
    opens = agent_line & ~F.coalesce(F.lag(agent_line).over(w), F.lit(False))
    lines = lines.withColumn("g", F.sum(opens.cast("int")).over(w))
    token = agent.split("/")[0].lower()
    mine = F.lit(token).contains(F.lower(F.col("v"))) & (F.col("v") != "*")
    groups = lines.where(agent_line).groupBy("host", "g").agg(F.max(mine).alias("mine"), F.max(F.col("v") == "*").alias("any"))
    chosen = groups.groupBy("host").agg(F.coalesce(F.min(F.when(F.col("mine"), F.col("g"))), F.min(F.when(F.col("any"), F.col("g")))).alias("g"))
    rules = lines.join(chosen, ["host", "g"]).where(F.col("k").isin("allow", "disallow", "crawl-delay"))
    return rules.select(
        "host", "pos", ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"), F.when(F.col("k") != "crawl-delay", F.col("v")).alias("prefix"),
        F.when((F.col("k") == "crawl-delay") & F.col("v").rlike("^[0-9]+$"), F.col("v").try_cast("double")).alias("delay"),
    )


def robots_verdicts(urls: DataFrame, rules: DataFrame, sites: DataFrame, url: str = "url", mode: str = "compat") -> DataFrame:
    """``urls`` with allowed, crawl_delay and reason.

    ``sites`` has host and status of the robots file.  The first rule whose prefix the URL's path has decides.  Rules
    are joined on the host, an equi-join with the prefix as its condition.  Without a file the verdict is no in
    ``compat`` mode and yes in ``intended`` mode.
    """
    path = F.regexp_extract(F.col(url), r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    keyed = urls.withColumns({"__host": extract_domain(url), "__path": F.when(path == "", F.lit("/")).otherwise(path), "__id": F.monotonically_increasing_id()})
    by_host = rules.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(F.col("prefix").isNotNull(), F.struct("pos", "allow", "prefix")))).alias("rules"), F.max("delay").alias("delay")
    )
    known = sites.join(by_host, "host", "left").withColumnRenamed("host", "__host")
    found = keyed.join(known, "__host", "left")
    first = F.get(F.filter("rules", lambda r: F.startswith(F.col("__path"), r["prefix"])), F.lit(0))["allow"]
    absent = F.col("status").isNull() | F.col("status").isin(*MISSING)
    allowed = F.when(absent, F.lit(mode == "intended")).when(F.col("status") != 200, F.lit(False)).otherwise(F.coalesce(first, F.lit(True)))
    return found.withColumns({
        "allowed": allowed,
        "crawl_delay": F.coalesce("delay", F.lit(DEFAULT_DELAY)),
        "reason": F.when(allowed, "Allowed by robots.txt").otherwise("Disallowed by robots.txt"),
    }).drop("__host", "__path", "__id", "status", "rules", "delay")


def plan(candidates: DataFrame, domains: DataFrame, rules: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """Verdict for every URL: robots, allowlist rate with default, and delay.  One shuffle by host replaces per-domain locks."""
    judged = robots_verdicts(candidates, rules, sites, url).withColumn("domain", extract_domain(url))
    rates = domains.select("domain", "requests_per_second")
    return judged.join(rates, "domain", "left").withColumn("rate", F.least(F.coalesce("requests_per_second", F.lit(1.0)), 1 / F.col("crawl_delay"))).drop("requests_per_second")
