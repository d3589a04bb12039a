"""Streaming queries and the model, with batch SQL as their check where there is one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from docloom.operators import features, model, signals
from docloom.sources.tables import table
from docloom.streaming import jobs


def _folder(spark) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="docloom-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_dedup(spark, d):
    """First event of every user in the stream: which one depends on the order of files, so only the users are returned."""
    where = _folder(spark)
    return jobs.run_to_parquet(jobs.first_seen(jobs.events(spark, f"{d}/events.parquet"), "user_id").select("user_id"), f"{where}/out", f"{where}/checkpoint")


def stream_daily(spark, d):
    """Requests of each user and day, over a cap of three or not."""
    daily = jobs.daily(jobs.events(spark, f"{d}/events.parquet"), "user_id", "ts", cap=3)
    where = _folder(spark)
    return jobs.run_to_files(daily, f"{where}/out", f"{where}/checkpoint")


def stream_cache(spark, d):
    """Requests of each host, and how many a cache of one day answered; users stand in for hosts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where = _folder(spark)
    log = jobs.events(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").cast("string").alias("body"), "ts")
    done = jobs.run_to_parquet(jobs.cached(log, 86400, "ts", "60 days"), f"{where}/out", f"{where}/checkpoint")
    return done.groupBy("host").agg(F.count("*").alias("n_requests"), F.sum(F.col("hit").cast("bigint")).alias("n_hits"))


def model_lr(spark, d):
    """Coefficients of a logistic regression of the next quarter's label on lagged signals."""
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("date"))
    q = signals.quarterly(o, "at", close=F.avg("o_totalprice"), urgent=signals.share(F.col("o_orderpriority") == "1-URGENT"))
    q = features.next_period_label(q.select("quarter_start", "close", "urgent"), "quarter_start", "close")
    data = features.lagged(q, "quarter_start", "urgent", 2).withColumn("split", features.chronological_split(F.year("quarter_start") + 22))
    names = ["urgent_lag1", "urgent_lag2"]
    fitted, _ = model.logistic(data.where("label IS NOT NULL AND urgent_lag2 IS NOT NULL"), names)
    return spark.createDataFrame([(n, round(c, 6)) for n, c in model.coefficients(fitted, names)], "feature string, coefficient double")


QUERIES = {f.__name__: f for f in (stream_dedup, stream_daily, stream_cache, model_lr)}
ORACLES = {
    "stream_dedup": "SELECT DISTINCT user_id FROM events",
    "stream_cache": """WITH RECURSIVE f(user_id, fetched) AS (SELECT user_id, min(ts) FROM events GROUP BY 1
        UNION ALL SELECT f.user_id, min(e.ts) FROM f JOIN events e ON e.user_id = f.user_id AND e.ts >= f.fetched + INTERVAL 1 DAY GROUP BY f.user_id),
        n AS (SELECT user_id, count(*) AS n FROM f GROUP BY 1)
        SELECT CAST(user_id AS VARCHAR) AS host, count(*) AS n_requests, CAST(count(*) - any_value(n) AS BIGINT) AS n_hits FROM events JOIN n USING (user_id) GROUP BY user_id""",
    "stream_daily": "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) > 3 AS over_cap FROM events GROUP BY 1, 2",
}
