"""Polite fetching as a Python data source: a request queue goes in, responses come out.

The planner has decided robots verdicts and rates before.  All requests of a domain form one input partition, so a
domain is never asked by two tasks at once; within it requests are spaced by the domain's rate and retried with back-off.
"""

from __future__ import annotations

import gzip
import json
import random
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Back-off in seconds.
INITIAL, MAXIMUM, MULTIPLIER, JITTER, RETRIES = 1.0, 60.0, 2.0, 0.1, 3
# Seconds to wait for a robots file.
ROBOTS_TIMEOUT = 10.0
# What a session and a request for a robots file accept.
ACCEPT_PAGES = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8"
ACCEPT_ROBOTS = "text/plain, text/html, */*"
SCHEMA = "url string, domain string, status int, mime string, body binary, attempts int, seconds double, error string"


@dataclass
class Outcome:
    """What a retried call came to."""

    success: bool
    result: Any
    error: Exception | None
    attempts: int
    seconds: float


def backoff(attempt: int, initial: float = INITIAL, maximum: float = MAXIMUM, multiplier: float = MULTIPLIER) -> float:
    """Seconds to wait after an attempt, with up to a tenth more or less."""
    return min(initial * multiplier**attempt, maximum) * (1 + random.uniform(-JITTER, JITTER))


def with_retry(call: Callable[[], Any], retries: int = RETRIES, errors: tuple[type[Exception], ...] = (Exception,), on_retry: Callable[[int, Exception], None] | None = None, wait: Callable[[float], None] = time.sleep) -> Outcome:
    """Call until it succeeds, at most ``retries`` times more; ``on_retry`` runs before each wait, not after the last failure."""
    began = time.monotonic()
    for attempt in range(retries + 1):
        try:
            return Outcome(True, call(), None, attempt + 1, time.monotonic() - began)
        except errors as e:
            if attempt == retries:
                return Outcome(False, None, e, attempt + 1, time.monotonic() - began)
            if on_retry is not None:
                on_retry(attempt, e)
            wait(backoff(attempt))
    raise AssertionError


def merged(*headers: dict[str, str]) -> dict[str, str]:
    """Headers of several origins in one; names count whatever their case, and the last one wins."""
    out: dict[str, tuple[str, str]] = {}
    for h in headers:
        out.update({name.lower(): (name, value) for name, value in h.items()})
    return dict(out.values())


def robots_headers(agent: str = "docloom/1.0", contact: str | None = None) -> dict[str, str]:
    """Headers of a request that says who asks; ``contact`` is a mail address."""
    return merged({"User-Agent": agent, "Accept": ACCEPT_ROBOTS}, {"From": contact} if contact else {})


def session_headers(agent: str = "docloom/1.0", contact: str | None = None) -> dict[str, str]:
    """Headers of a session that reads pages."""
    more = {"Accept": ACCEPT_PAGES, "Accept-Language": "en-US,en;q=0.5", "Accept-Encoding": "gzip, deflate", "Connection": "keep-alive"}
    return merged(robots_headers(agent, contact), more)


def filing_headers(agent: str, contact: str, host: str = "www.sec.gov") -> dict[str, str]:
    """Headers for the filing archive, which wants a contact in the agent."""
    return {"User-Agent": f"{agent} ({contact})", "Accept-Encoding": "gzip, deflate", "Host": host}


def _get(url: str, headers: dict[str, str], timeout: float = 30.0) -> tuple[int, str, bytes]:
    """Status, MIME type and decompressed body of a URL; redirects are followed."""
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
        body, kind = r.read(), (r.headers.get("Content-Encoding") or "").lower()
        body = gzip.decompress(body) if kind == "gzip" else zlib.decompress(body) if kind == "deflate" else body
        return r.status or 200, r.headers.get_content_type(), body


def responses(requests: Iterator[tuple[str, str, float]], headers: dict[str, str], retries: int) -> Iterator[tuple]:
    """Answers to (url, domain, requests a second), which come domain by domain: spaced by the rate and retried with back-off."""
    domain, last = None, 0.0
    for url, of, rate in requests:
        pause = last + 1 / rate - time.monotonic()
        if of == domain and pause > 0:
            time.sleep(pause)
        domain, last = of, time.monotonic()
        got = with_retry(lambda url=url: _get(url, headers), retries)
        status, mime, body = got.result if got.success else (getattr(got.error, "code", None), None, None)
        yield url, of, status, mime, body, got.attempts, got.seconds, None if got.success else str(got.error)


def session(planned: DataFrame, url: str = "url", headers: dict[str, str] | None = None, retries: int = RETRIES) -> DataFrame:
    """Responses for a crawl plan of any size (url, domain, rate, allowed): the throttled session.

    URLs that the plan does not allow are not asked for.  A domain's requests meet in one task, in the order of their
    URLs, so that no two tasks ask the same domain at once.
    """
    rows = planned.where("allowed").select(F.col(url).alias("url"), "domain", F.col("rate").cast("double").alias("rate")).repartition("domain").sortWithinPartitions("domain", "url")
    sent = headers or session_headers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for row in responses(wanted, sent, retries):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.float64(), pa.string()), strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def robots_files(hosts: DataFrame, host: str = "host", agent: str = "docloom/1.0", contact: str | None = None, scheme: str = "https", timeout: float = ROBOTS_TIMEOUT) -> DataFrame:
    """host, status, body and fetched_at of the robots file of every distinct host.

    Redirects are followed.  A file that is not there keeps its status; without an answer the status is null.  Both are
    input for ``crawl.parse_robots`` and ``crawl.robots_verdicts``, which turn them into verdicts.
    """
    sent = robots_headers(agent, contact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    status, _, raw = _get(f"{scheme}://{name}/robots.txt", sent, timeout)
                    body = raw.decode("utf-8", "replace") if status == 200 else ""
                except urllib.error.HTTPError as e:
                    status, body = e.code, ""
                except OSError:
                    status, body = None, ""
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([status], pa.int32()), pa.array([body]), pa.array([int(time.time())], pa.int64())], ["host", "status", "body", "fetched_at"])

    return hosts.select(F.col(host).alias("host")).where("host IS NOT NULL").distinct().mapInArrow(run, "host string, status int, body string, fetched_at bigint")


class Domain(InputPartition):
    """Requests of one domain."""

    def __init__(self, name: str, rate: float, urls: list[str]):
        self.name, self.rate, self.urls = name, rate, urls


class FetchReader(DataSourceReader):
    """Reads the queue in the option ``queue``: JSON, a list of [domain, rate, urls]."""

    def __init__(self, options: dict):
        self.queue = json.loads(options["queue"])
        self.agent = options.get("agent", "docloom/1.0")
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[Domain]:
        return [Domain(*entry) for entry in self.queue]

    def read(self, partition: Domain) -> Iterator[tuple]:
        yield from responses(((url, partition.name, partition.rate) for url in partition.urls), session_headers(self.agent), self.retries)


class FetchSource(DataSource):
    """The data source ``docloom_fetch``."""

    @classmethod
    def name(cls) -> str:
        return "docloom_fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FetchReader(self.options)


def fetch(spark: SparkSession, queue: list[tuple[str, float, list[str]]], agent: str = "docloom/1.0", retries: int = RETRIES) -> DataFrame:
    """Responses for a bounded queue of (domain, requests a second, URLs)."""
    spark.dataSource.register(FetchSource)
    return spark.read.format(FetchSource.name()).option("queue", json.dumps(queue)).option("agent", agent).option("retries", str(retries)).load()
