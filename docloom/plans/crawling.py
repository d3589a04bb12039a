"""Crawl-planning queries: the ``events`` table serves as a request log, users as domains, errors as failures."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.urls import extract_domain
from docloom.operators import crawl
from docloom.sources.tables import table

DAY = 86400


def _log(spark, d):
    return table(spark, d, "events").select("event_id", "ts", "user_id", (F.col("event_type") == "error").alias("failed"))


def request_gap(spark, d):
    """Time since the previous request of a domain."""
    return crawl.gaps(_log(spark, d), "user_id", "ts", "event_id").select("event_id", "gap_us")


def request_schedule(spark, d):
    """Start times at one request a day and domain, by the closed form."""
    s = crawl.schedule(_log(spark, d), "user_id", "ts", "event_id", DAY)
    return s.select("event_id", "start_us", "wait_us")


def domain_stats(spark, d):
    """Requests and errors by domain."""
    return crawl.domain_stats(_log(spark, d), "user_id", F.col("failed"))


def rate_adaptive(spark, d):
    """Rate and error count after the whole log."""
    r = crawl.adaptive_rates(_log(spark, d), "user_id", "event_id", "failed")
    return r.withColumn("current_rate", F.round("current_rate", 9)).withColumn("error_count", F.col("error_count").cast("bigint"))


def backoff_table(spark, d):
    """Back-off of the first eight attempts."""
    return spark.range(8).select(F.col("id").alias("attempt"), crawl.backoff("id").alias("seconds"))


def retry_outcome(spark, d):
    """Tasks of at most four attempts in the log of each domain."""
    out = crawl.retry_outcomes(_log(spark, d), "user_id", "event_id", F.col("failed"))
    return out.groupBy("attempts", "success").agg(F.count("*").alias("n_tasks"), F.sum("waited").alias("waited"))


def daily_cap(spark, d):
    """Requests of each domain and day against a cap of three."""
    return crawl.daily_cap(_log(spark, d), "user_id", "ts", 3)


def robots_fresh(spark, d):
    """Requests of the last hour before the log's end: the rows a cache would still hold."""
    log = _log(spark, d).select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("fetched_at"))
    end = log.agg(F.max("fetched_at").alias("now"))
    return crawl.fresh(log.join(F.broadcast(end)), "fetched_at", F.col("now")).select("event_id")


ROBOTS = "User-agent: *\nDisallow: /en/1\nAllow: /en/\nDisallow: /en/2\nCrawl-delay: 5\n\nUser-agent: docloom\nAllow: /de/1\nDisallow: /de/\nDisallow: /fr/2  # not yet\nCrawl-delay: 2\n"


def _sites(spark, d):
    """A robots file for each host; by the host's length some sites answer 404 or 500."""
    hosts = table(spark, d, "pages").select(extract_domain("url").alias("host")).distinct()
    status = F.when(F.length("host") % 5 == 0, 404).when(F.length("host") % 5 == 1, 500).otherwise(200)
    return hosts.select("host", status.alias("status"), F.when(status == 200, F.lit(ROBOTS)).otherwise(F.lit("")).alias("body"))


def robots_verdict(spark, d):
    """Verdict and delay of every page for the agent docloom/1.0."""
    sites = _sites(spark, d)
    rules = crawl.parse_robots(sites.where("status = 200"), agent="docloom/1.0")
    out = crawl.robots_verdicts(table(spark, d, "pages").select("page_id", "url"), rules, sites.select("host", "status"))
    return out.select("page_id", "allowed", "crawl_delay", "reason")


def crawl_plan(spark, d):
    """The plan of all pages: verdict, delay and rate; hosts with an even number of letters have a rate of their own."""
    sites = _sites(spark, d)
    rules = crawl.parse_robots(sites.where("status = 200"), agent="docloom/1.0")
    rates = sites.where(F.length("host") % 2 == 0).select(F.col("host").alias("domain"), F.lit(0.25).alias("requests_per_second"))
    out = crawl.plan(table(spark, d, "pages").select("page_id", "url"), rates, rules, sites.select("host", "status"))
    return out.select("page_id", "domain", "allowed", "crawl_delay", "rate")


def cache_size(spark, d):
    """Entries of the log as a cache, and those that are fresh at its end."""
    log = _log(spark, d).select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("fetched_at"))
    end = log.agg(F.max("fetched_at").alias("now"))
    return crawl.cache_stats(log.join(F.broadcast(end)), "fetched_at", F.col("now"), DAY)


def request_delays(spark, d):
    """Least seconds between the requests of each domain at its rate after the whole log."""
    rates = crawl.adaptive_rates(_log(spark, d), "user_id", "event_id", "failed")
    return rates.select("user_id", F.round(crawl.min_delay("current_rate"), 6).alias("seconds"))


QUERIES = {f.__name__: f for f in (crawl_plan, cache_size, request_delays, request_gap, request_schedule, domain_stats, rate_adaptive, backoff_table, retry_outcome, daily_cap, robots_fresh, robots_verdict)}

_RATES = """WITH RECURSIVE x AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        s(user_id, i, rate, errors) AS (SELECT user_id, 0, CAST(1 AS DOUBLE), 0 FROM (SELECT DISTINCT user_id FROM x) UNION ALL
          SELECT x.user_id, s.i + 1, CASE WHEN f THEN CASE WHEN errors + 1 >= 3 THEN greatest(0.1, rate * 0.5) ELSE rate END WHEN errors > 0 THEN least(1.0, rate * 1.1) ELSE rate END,
                 CASE WHEN f THEN errors + 1 ELSE greatest(errors - 1, 0) END FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1),
        last AS (SELECT * FROM s WHERE i = (SELECT max(i) FROM x WHERE x.user_id = s.user_id))"""
ORACLES = {
    "crawl_plan": """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
        v AS (SELECT page_id, host, CASE WHEN length(host) % 5 IN (0, 1) THEN false WHEN starts_with(path, '/de/1') THEN true WHEN starts_with(path, '/de/') THEN false WHEN starts_with(path, '/fr/2') THEN false ELSE true END AS allowed,
              CAST(CASE WHEN length(host) % 5 IN (0, 1) THEN 1.0 ELSE 2.0 END AS DOUBLE) AS crawl_delay FROM h)
        SELECT page_id, host AS domain, allowed, crawl_delay, least(CASE WHEN length(host) % 2 = 0 THEN CAST(0.25 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 1 / crawl_delay) AS rate FROM v""",
    "cache_size": f"SELECT count(*) AS cache_size, count(*) FILTER ((SELECT epoch_us(max(ts)) // 1000000 FROM events) - epoch_us(ts) // 1000000 < {DAY}) AS n_fresh FROM events",
    "request_delays": _RATES + " SELECT user_id, round(1 / rate, 6) AS seconds FROM last",
    "request_gap": "SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events",
    "request_schedule": f"""WITH x AS (SELECT event_id, user_id, ts, epoch_us(ts) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
        y AS (SELECT event_id, a, CAST(i * {DAY * 1000000} + max(a - i * {DAY * 1000000}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS start_us FROM x)
        SELECT event_id, start_us, start_us - a AS wait_us FROM y""",
    "domain_stats": "SELECT user_id, count(*) AS request_count, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS error_count FROM events GROUP BY user_id",
    "rate_adaptive": """WITH RECURSIVE x AS (SELECT user_id, event_type = 'error' AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        s(user_id, i, rate, errors) AS (SELECT user_id, 0, CAST(1 AS DOUBLE), 0 FROM (SELECT DISTINCT user_id FROM x) UNION ALL
          SELECT x.user_id, s.i + 1, CASE WHEN f THEN CASE WHEN errors + 1 >= 3 THEN greatest(0.1, rate * 0.5) ELSE rate END WHEN errors > 0 THEN least(1.0, rate * 1.1) ELSE rate END,
                 CASE WHEN f THEN errors + 1 ELSE greatest(errors - 1, 0) END FROM s JOIN x ON x.user_id = s.user_id AND x.i = s.i + 1)
        SELECT user_id, CAST(i AS BIGINT) AS requests, CAST(errors AS BIGINT) AS error_count, round(rate, 9) AS current_rate FROM s
        WHERE i = (SELECT max(i) FROM x WHERE x.user_id = s.user_id)""",
    "backoff_table": "SELECT i AS attempt, least(1.0 * pow(2.0, i), 60.0) AS seconds FROM range(8) AS t(i)",
    "retry_outcome": """WITH x AS (SELECT user_id, event_id, event_type <> 'error' AS ok FROM events),
        r AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) - CAST(ok AS INTEGER) AS run FROM x),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS k FROM r),
        t AS (SELECT user_id, run, k // 4 AS task, count(*) AS attempts, bool_or(ok) AS success, sum(CASE WHEN k % 4 > 0 THEN least(pow(2.0, k % 4 - 1), 60.0) ELSE 0.0 END) AS waited FROM k GROUP BY 1, 2, 3)
        SELECT attempts, success, count(*) AS n_tasks, sum(waited) AS waited FROM t GROUP BY 1, 2""",
    "daily_cap": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 3 AS over_cap FROM events GROUP BY 1, 2",
    "robots_fresh": "SELECT event_id FROM events WHERE (SELECT epoch_us(max(ts)) // 1000000 FROM events) - epoch_us(ts) // 1000000 < 3600",
    "robots_verdict": """WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
        v AS (SELECT page_id, CASE WHEN length(host) % 5 IN (0, 1) THEN false WHEN starts_with(path, '/de/1') THEN true WHEN starts_with(path, '/de/') THEN false WHEN starts_with(path, '/fr/2') THEN false ELSE true END AS allowed,
              CASE WHEN length(host) % 5 IN (0, 1) THEN 1.0 ELSE 2.0 END AS crawl_delay FROM h)
        SELECT page_id, allowed, CAST(crawl_delay AS DOUBLE) AS crawl_delay, CASE WHEN allowed THEN 'Allowed by robots.txt' ELSE 'Disallowed by robots.txt' END AS reason FROM v""",
}
