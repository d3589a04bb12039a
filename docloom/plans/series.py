"""Signal, feature and split queries.

``orders`` stands in for dated documents, ``lineitem`` for mentions, ``part`` for entities, ``customer`` segments for
source types, the mean order price of a quarter for its closing price.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import evaluate, features, graph, signals
from docloom.sources.tables import table


#: Least and most documents of a source type, for the segments that stand in.
RANGES = {"BUILDING": (0, 100), "MACHINERY": (1, 1_000_000_000), "AUTOMOBILE": (1_000_000_000, 2_000_000_000), "FURNITURE": (5, 1_000_000_000), "none": (40, 50)}


def _orders(spark, d):
    return table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("date"))


def _segments(spark, d):
    return _orders(spark, d).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def _mentions(spark, d):
    l = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return l.join(_orders(spark, d).select("o_orderkey", "at"), F.col("l_orderkey") == F.col("o_orderkey"))


def _quarters(spark, d):
    """Mean price, urgent share and documents of each quarter."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    return signals.quarterly(_orders(spark, d), "at", close=F.avg("o_totalprice"), urgent=signals.share(urgent))


def coverage_year_source(spark, d):
    """Documents by year and source type."""
    return _segments(spark, d).groupBy(F.year("at").alias("year"), F.col("c_mktsegment").alias("source_type")).agg(F.count("*").alias("n_docs"))


def coverage_cube(spark, d):
    """The same with all subtotals."""
    return signals.coverage(_segments(spark, d).withColumnRenamed("c_mktsegment", "source_type"), "at", "source_type")


def coverage_vs_target(spark, d):
    """Years against a target of 2000 documents."""
    by = _orders(spark, d).groupBy(F.year("at").alias("year")).agg(F.count("*").alias("n_docs"))
    return signals.against_target(by, "n_docs", 2000)


def entity_counts(spark, d):
    """Distinct entities of each type."""
    kinds = {"Product": "l_partkey", "Technology Capability": "l_suppkey", "Risk Topic": "l_returnflag"}
    found = F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(c).cast("string").alias("entity_id")) for k, c in kinds.items())))
    return graph.entity_counts(table(spark, d, "lineitem").select(found.alias("e")).select("e.*"))


def coverage_by_type(spark, d):
    """Documents of each source type against its own least and most; one type has no document, one no target."""
    by = _segments(spark, d).groupBy(F.col("c_mktsegment").alias("source_type")).agg(F.count("*").alias("n_docs"))
    return signals.against_ranges(by, "source_type", "n_docs", RANGES)


def ai_coverage(spark, d):
    """Years from 2020 on, moved by 22, and urgent orders as relevant documents against the target."""
    year = F.year("at") + 22
    by = _orders(spark, d).where((F.col("o_orderpriority") == "1-URGENT") & (year >= signals.AI_FROM_YEAR)).groupBy(year.alias("year")).agg(F.count("*").alias("n_docs"))
    return signals.against_target(by, "n_docs", signals.MIN_AI_DOCS_PER_YEAR)


def mentions_quarter(spark, d):
    """Mentions of every brand in each quarter, and its share of them."""
    m = _mentions(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    n = m.groupBy(signals.quarter("at").alias("quarter_start"), F.col("p_brand").alias("entity")).agg(F.count("*").alias("n_mentions"))
    whole = n.groupBy("quarter_start").agg(F.sum("n_mentions").alias("whole"))
    return n.join(whole, "quarter_start").select("quarter_start", "entity", "n_mentions", F.round(F.col("n_mentions") / F.col("whole"), 9).alias("share"))


def event_intensity(spark, d):
    """Events of each month and type, their weight and mean weight, in whole thousandths."""
    e = table(spark, d, "events").select("ts", "event_type", F.round(F.col("value") * 1000).cast("bigint").alias("weight"))
    return signals.intensity(e, "ts", "event_type", "weight").withColumn("intensity", F.round("intensity", 6))


def availability_check(spark, d):
    """Orders that were used in the quarter of a shipment, against the end of that quarter; every seventh date is put too late on purpose."""
    o = _orders(spark, d).select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.add_months("at", 12)).otherwise(F.col("at")).alias("published_at"))
    used = table(spark, d, "lineitem").select("l_orderkey", signals.quarter("l_shipdate").alias("quarter_start")).distinct()
    return features.published_before(used.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "published_at", "quarter_start")


def feature_label_join(spark, d):
    """Features of each quarter with its label; the last quarter has none and goes."""
    q = _quarters(spark, d).withColumn("quarter_id", F.concat(F.year("quarter_start"), F.lit("Q"), F.quarter("quarter_start")))
    labels = features.next_period_label(q.select("quarter_id", "quarter_start", "close"), "quarter_start", "close").where("label IS NOT NULL").select("quarter_id", "label")
    return features.with_labels(q.select("quarter_id", "n_docs"), labels)


def z_scores(spark, d):
    """Documents of each quarter in deviations from the training years."""
    q = _quarters(spark, d).select("quarter_start", "n_docs")
    return features.z_score(q, "n_docs", F.year("quarter_start") <= 1997).select("quarter_start", F.round("n_docs_z", 6).alias("n_docs_z"))


def quarter_gaps(spark, d):
    """Missing quarters, with those of even number taken out of odd years."""
    o = _orders(spark, d).where(~((F.year("at") % 2 == 1) & (F.quarter("at") % 2 == 0)))
    return signals.missing_quarters(o, "at")


def first_mention(spark, d):
    """First date and document of every entity."""
    return graph.first_mention(_mentions(spark, d), "l_partkey", "l_orderkey", "at")


def new_mentions_topk(spark, d):
    """The five quarters with the most entities that were new."""
    first = graph.first_mention(_mentions(spark, d), "l_partkey", "l_orderkey", "at")
    return first.groupBy(signals.quarter("first_at").alias("quarter_start")).agg(F.count("*").alias("n_new")).orderBy(F.desc("n_new"), "quarter_start").limit(5)


def term_year_pivot(spark, d):
    """Documents of each priority by year, as columns."""
    o = _orders(spark, d).select(F.col("o_orderpriority").alias("term"), F.year("at").alias("y"))
    years = sorted(r["y"] for r in o.select("y").where("y IS NOT NULL").distinct().collect())
    return o.groupBy("term").agg(*(F.count_if(F.col("y") == y).alias(f"y{y}") for y in years), F.min("y").alias("first_year"))


def comention(spark, d):
    """Pairs of part and supplier in the same order, counted by order."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("capability"))
    return graph.co_mentions(l.select("l_orderkey", "product"), l.select("l_orderkey", "capability"), "l_orderkey", "product", "capability")


def associations(spark, d):
    """Undirected edges between the same numbers."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("capability"))
    return graph.associated(l, "product", "capability")


def top_topics_share(spark, d):
    """Ten most frequent brands and their share by year."""
    m = _mentions(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    out = signals.top_share(m.select(F.year("at").alias("year"), F.col("p_brand").alias("topic")), "year", "topic")
    return out.withColumn("share", F.round("share", 9))


def quarter_signals(spark, d):
    """Signals of each quarter with the date from which they may be used."""
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))  # whole numbers add up alike in any order
    q = signals.quarterly(_orders(spark, d), "at", cents=cents, urgent=signals.share(F.col("o_orderpriority") == "1-URGENT"))
    return q.select("quarter_start", "n_docs", "cents", F.round("urgent", 9).alias("urgent"), "as_of_date")


def signal_variation(spark, d):
    """Mean, deviation and coefficient of variation of the quarterly price."""
    v = signals.variation(_quarters(spark, d), "close")
    return v.select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("cv", 9).alias("cv"))


def signal_delta(spark, d):
    """Change of the urgent share from the quarter before."""
    return signals.delta(_quarters(spark, d), "urgent", "quarter_start").select("quarter_start", F.round("delta", 9).alias("delta"))


def features_lagged(spark, d):
    """Lags, mean of the four quarters before and year-on-year changes of the number of documents."""
    out = features.lagged(_quarters(spark, d).select("quarter_start", "n_docs"), "quarter_start", "n_docs")
    return out.withColumn("n_docs_mean", F.round("n_docs_mean", 9))


def _keyed(spark, d):
    by = F.col("c_mktsegment").alias("segment")
    return _segments(spark, d).groupBy(by, signals.quarter("at").alias("quarter_start")).agg(F.count("*").alias("n")).withColumn("as_of_date", F.add_months("quarter_start", 3))


def asof_signals(spark, d):
    """For every order, the latest quarterly count of its segment that was available on its date."""
    left = _segments(spark, d).select("o_orderkey", F.col("c_mktsegment").alias("segment"), "at")
    out = features.as_of(left, _keyed(spark, d), "at", "as_of_date", ["quarter_start", "n"], ["segment"])
    return out.select("o_orderkey", "quarter_start", "n")


def asof_audit(spark, d):
    """Audit of the as-of join: results by whether something was found and whether it leaks."""
    left = _segments(spark, d).select("o_orderkey", F.col("c_mktsegment").alias("segment"), "at")
    out = features.as_of(left, _keyed(spark, d), "at", "as_of_date", ["as_of_date", "n"], ["segment"])
    log = features.join_audit(out, "at", "as_of_date", "n")
    return log.groupBy("found", "leaks").agg(F.count("*").alias("n_rows"), F.max("age_days").alias("max_age"))


def expanding_mean(spark, d):
    """Mean number of documents of all quarters before."""
    out = features.expanding(_quarters(spark, d).select("quarter_start", "n_docs"), "quarter_start", "n_docs")
    return out.select("quarter_start", F.round("n_docs_so_far", 6).alias("n_docs_so_far"), "n_so_far")


def year_range(spark, d):
    """Documents of the years 1996 to 1998."""
    from docloom.functions.text import in_years

    return _orders(spark, d).where(in_years("at", 1996, 1998)).select("o_orderkey")


def labels_next_quarter(spark, d):
    """Whether the next quarter's price is higher."""
    out = features.next_period_label(_quarters(spark, d).select("quarter_start", "close"), "quarter_start", "close")
    return out.select("quarter_start", "label", "label_date")


def leadlag_corr(spark, d):
    """Correlation of the urgent share with the price moved by up to four quarters."""
    return signals.lead_lag(_quarters(spark, d), "quarter_start", "urgent", "close").select("lag", F.round("corr", 6).alias("corr"))


def risk_event_corr(spark, d):
    """Correlation of the quarterly share of returns with the quarterly number of orders."""
    m = table(spark, d, "lineitem").select(signals.quarter("l_shipdate").alias("quarter_start"), (F.col("l_returnflag") == "R").alias("r"))
    risk = m.groupBy("quarter_start").agg(signals.share(F.col("r")).alias("risk"))
    joined = risk.join(_quarters(spark, d).select("quarter_start", "n_docs"), "quarter_start")
    return joined.agg(F.round(F.corr("risk", F.col("n_docs").cast("double")), 6).alias("corr"), F.count("*").alias("n_quarters"))


def chrono_split(spark, d):
    """Quarters of each split; years are moved by 22, so that all three periods occur."""
    q = _quarters(spark, d).select("quarter_start", features.chronological_split(F.year("quarter_start") + 22).alias("split"))
    return q.groupBy("split").agg(F.count("*").alias("n"), F.min("quarter_start").alias("first_quarter"), F.max("quarter_start").alias("last_quarter"))


def split_check(spark, d):
    """Whether training ends before testing starts."""
    q = _quarters(spark, d).select("quarter_start", features.chronological_split(F.year("quarter_start") + 22).alias("split"))
    return features.split_overlap(q, "split", "quarter_start")


def leakage_violations(spark, d):
    """Lagged features against their labels; every seventh feature date is put too late on purpose."""
    q = features.next_period_label(_quarters(spark, d).select("quarter_start", "close"), "quarter_start", "close")
    late = F.month("quarter_start") + F.year("quarter_start") * 12
    q = q.withColumn("feature_as_of", F.when(late % 7 == 0, F.add_months("quarter_start", 6)).otherwise(F.col("quarter_start")))
    return features.leakage(q, "feature_as_of", "label_date")


def features_allowed(spark, d):
    """Signals that may be used in the quarter after theirs, and those filed too late taken out."""
    q = _quarters(spark, d).select("quarter_start", "as_of_date")
    used = q.withColumn("use_at", F.add_months("quarter_start", F.when(F.month("quarter_start") == 1, 0).otherwise(3)))
    return features.allowed_only(used, "as_of_date", "use_at").select("quarter_start", "use_at")


def train_hash(spark, d):
    """Hash of the training rows, whatever their order."""
    return features.data_hash(_orders(spark, d).select("o_orderkey", "o_totalprice", "at"))


def split_confusion(spark, d):
    """Orders by status and urgency, as label and prediction."""
    return evaluate.confusion(_orders(spark, d).select(F.col("o_orderstatus").alias("label"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("pred")), "label", "pred")


QUERIES = {
    f.__name__: f
    for f in (
        coverage_year_source, coverage_cube, coverage_vs_target, entity_counts, quarter_gaps, first_mention, new_mentions_topk, term_year_pivot, comention, associations, top_topics_share,
        quarter_signals, signal_variation, signal_delta, features_lagged, asof_signals, asof_audit, expanding_mean, year_range, labels_next_quarter, leadlag_corr, risk_event_corr, chrono_split, split_check, leakage_violations,
        features_allowed, train_hash, split_confusion, coverage_by_type, ai_coverage, mentions_quarter, event_intensity, availability_check, feature_label_join, z_scores,
    )
}

_O = "o AS (SELECT *, CAST(o_orderdate AS DATE) AS odate, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start FROM orders)"
_S = f"{_O}, s AS (SELECT o.*, c_mktsegment AS source_type FROM o JOIN customer ON o_custkey = c_custkey)"
_M = f"{_O}, m AS (SELECT l_orderkey, l_partkey, l_suppkey, odate FROM lineitem JOIN o ON l_orderkey = o_orderkey)"
_Q = f"""{_O}, q AS (SELECT quarter_start, count(*) AS n_docs, avg(o_totalprice) AS close, count(*) FILTER (o_orderpriority = '1-URGENT') / count(*) AS urgent,
    CAST(quarter_start + INTERVAL 3 MONTH AS DATE) AS as_of_date FROM o GROUP BY quarter_start)"""
_SPLIT = "CASE WHEN year(quarter_start) + 22 <= 2019 THEN 'train' WHEN year(quarter_start) + 22 <= 2021 THEN 'validation' ELSE 'test' END"
ORACLES = {
    "coverage_year_source": f"WITH {_S} SELECT CAST(year(odate) AS INTEGER) AS year, source_type, count(*) AS n_docs FROM s GROUP BY 1, 2",
    "coverage_cube": f"WITH {_S} SELECT CAST(y AS INTEGER) AS year, source_type, count(*) AS n_docs FROM (SELECT year(odate) AS y, source_type FROM s) GROUP BY CUBE (y, source_type)",
    "coverage_vs_target": f"""WITH {_O}, y AS (SELECT CAST(year(odate) AS INTEGER) AS year, count(*) AS n_docs FROM o GROUP BY 1)
        SELECT year, n_docs, 2000 AS target, CASE WHEN n_docs >= 2000 THEN 'met' ELSE 'below' END AS status, greatest(2000 - n_docs, 0) AS missing FROM y""",
    "entity_counts": """SELECT 'Product' AS entity_type, count(DISTINCT l_partkey) AS n_entities FROM lineitem UNION ALL SELECT 'Technology Capability', count(DISTINCT l_suppkey) FROM lineitem
        UNION ALL SELECT 'Risk Topic', count(DISTINCT l_returnflag) FROM lineitem""",
    "coverage_by_type": f"WITH {_S}, t(source_type, target_min, target_max) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in RANGES.items()) + """),
        n AS (SELECT source_type, count(*) AS n FROM s GROUP BY 1) SELECT source_type, coalesce(n, 0) AS n_docs, target_min, target_max,
        CASE WHEN target_min IS NULL THEN NULL WHEN coalesce(n, 0) < target_min THEN 'below' WHEN coalesce(n, 0) > target_max THEN 'above' ELSE 'met' END AS status FROM n FULL JOIN t USING (source_type)""",
    "ai_coverage": f"""WITH {_O}, y AS (SELECT CAST(year(odate) + 22 AS INTEGER) AS year, count(*) AS n_docs FROM o WHERE o_orderpriority = '1-URGENT' AND year(odate) + 22 >= 2020 GROUP BY 1)
        SELECT year, n_docs, 30 AS target, CASE WHEN n_docs >= 30 THEN 'met' ELSE 'below' END AS status, greatest(30 - n_docs, 0) AS missing FROM y""",
    "mentions_quarter": f"""WITH {_M}, n AS (SELECT CAST(date_trunc('quarter', odate) AS DATE) AS quarter_start, p_brand AS entity, count(*) AS n_mentions FROM m JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
        SELECT quarter_start, entity, n_mentions, round(n_mentions / sum(n_mentions) OVER (PARTITION BY quarter_start), 9) AS share FROM n""",
    "event_intensity": """WITH x AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, event_type, CAST(round(value * 1000) AS BIGINT) AS w FROM events)
        SELECT month, event_type, count(*) AS n_events, CAST(sum(w) AS BIGINT) AS weight, round(avg(w), 6) AS intensity FROM x GROUP BY 1, 2""",
    "availability_check": f"""WITH {_O}, u AS (SELECT DISTINCT l_orderkey, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter_start FROM lineitem),
        j AS (SELECT u.quarter_start, CASE WHEN o_orderkey % 7 = 0 THEN CAST(odate + INTERVAL 12 MONTH AS DATE) ELSE odate END AS p FROM u JOIN o ON l_orderkey = o_orderkey)
        SELECT quarter_start, count(*) AS n_rows, count(*) FILTER (p >= quarter_start + INTERVAL 3 MONTH) AS violations FROM j GROUP BY 1""",
    "feature_label_join": f"""WITH {_Q}, l AS (SELECT *, lead(close) OVER (ORDER BY quarter_start) AS nxt FROM q)
        SELECT year(quarter_start) || 'Q' || quarter(quarter_start) AS quarter_id, n_docs, CASE WHEN nxt > close THEN 1 ELSE 0 END AS label FROM l WHERE nxt IS NOT NULL""",
    "z_scores": f"""WITH {_Q}, t AS (SELECT avg(n_docs) AS m, stddev_samp(n_docs) AS sd FROM q WHERE year(quarter_start) <= 1997) SELECT quarter_start, round((n_docs - m) / sd, 6) AS n_docs_z FROM q, t""",
    "quarter_gaps": f"""WITH {_O}, k AS (SELECT quarter_start FROM o WHERE NOT (year(odate) % 2 = 1 AND quarter(odate) % 2 = 0)),
        g AS (SELECT CAST(unnest(generate_series((SELECT min(quarter_start) FROM k), (SELECT max(quarter_start) FROM k), INTERVAL 3 MONTH)) AS DATE) AS quarter_start)
        SELECT quarter_start FROM g WHERE quarter_start NOT IN (SELECT quarter_start FROM k)""",
    "first_mention": f"WITH {_M}, f AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY odate, l_orderkey) AS i FROM m) SELECT l_partkey, odate AS first_at, l_orderkey AS first_doc FROM f WHERE i = 1",
    "new_mentions_topk": f"""WITH {_M}, f AS (SELECT l_partkey, min(odate) AS odate FROM m GROUP BY 1) SELECT CAST(date_trunc('quarter', odate) AS DATE) AS quarter_start, count(*) AS n_new FROM f GROUP BY 1
        ORDER BY n_new DESC, quarter_start LIMIT 5""",
    "term_year_pivot": f"WITH {_O} SELECT o_orderpriority AS term, " + ", ".join(f"count(*) FILTER (year(odate) = {y}) AS y{y}" for y in range(1995, 2002)) + ", CAST(min(year(odate)) AS INTEGER) AS first_year FROM o GROUP BY 1",
    "comention": """WITH a AS (SELECT DISTINCT l_orderkey, l_partkey AS product FROM lineitem), b AS (SELECT DISTINCT l_orderkey, l_suppkey AS capability FROM lineitem)
        SELECT product, capability, count(*) AS n_docs FROM a JOIN b USING (l_orderkey) GROUP BY 1, 2""",
    "associations": "SELECT DISTINCT least(l_partkey, l_suppkey) AS src_id, greatest(l_partkey, l_suppkey) AS dst_id, 'ASSOCIATED_WITH' AS edge_type FROM lineitem",
    "top_topics_share": f"""WITH {_M}, t AS (SELECT year(odate) AS year, p_brand AS topic FROM m JOIN part ON l_partkey = p_partkey),
        top AS (SELECT topic FROM t GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 10), c AS (SELECT year, topic, count(*) AS n FROM t GROUP BY 1, 2),
        w AS (SELECT *, sum(n) OVER (PARTITION BY year) AS whole FROM c) SELECT CAST(year AS INTEGER) AS year, topic, n, round(n / whole, 9) AS share FROM w WHERE topic IN (SELECT topic FROM top)""",
    "quarter_signals": f"""WITH {_O} SELECT quarter_start, count(*) AS n_docs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
        round(count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 9) AS urgent, CAST(quarter_start + INTERVAL 3 MONTH AS DATE) AS as_of_date FROM o GROUP BY quarter_start""",
    "signal_variation": f"WITH {_Q} SELECT round(avg(close), 4) AS mean, round(stddev_samp(close), 4) AS sd, round(stddev_samp(close) / avg(close), 9) AS cv FROM q",
    "signal_delta": f"WITH {_Q} SELECT quarter_start, round(urgent - lag(urgent) OVER (ORDER BY quarter_start), 9) AS delta FROM q",
    "features_lagged": f"""WITH {_Q} SELECT quarter_start, n_docs, {", ".join(f"lag(n_docs, {k}) OVER w AS n_docs_lag{k}" for k in range(1, 5))},
        round(avg(n_docs) OVER (ORDER BY quarter_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 9) AS n_docs_mean,
        lag(n_docs, 1) OVER w - lag(n_docs, 4) OVER w AS n_docs_lag1_minus_lag4, lag(n_docs, 1) OVER w - lag(n_docs, 5) OVER w AS n_docs_lag1_minus_lag5 FROM q WINDOW w AS (ORDER BY quarter_start)""",
    "asof_signals": f"""WITH {_S}, k AS (SELECT source_type, quarter_start, count(*) AS n, CAST(quarter_start + INTERVAL 3 MONTH AS DATE) AS as_of_date FROM s GROUP BY 1, 2)
        SELECT o_orderkey, k.quarter_start, n FROM s ASOF LEFT JOIN k ON s.source_type = k.source_type AND s.odate >= k.as_of_date""",
    "asof_audit": f"""WITH {_S}, k AS (SELECT source_type, count(*) AS n, CAST(quarter_start + INTERVAL 3 MONTH AS DATE) AS as_of_date FROM s GROUP BY source_type, quarter_start),
        j AS (SELECT odate, as_of_date, n FROM s ASOF LEFT JOIN k ON s.source_type = k.source_type AND s.odate >= k.as_of_date)
        SELECT n IS NOT NULL AS found, coalesce(as_of_date > odate, false) AS leaks, count(*) AS n_rows, CAST(max(odate - as_of_date) AS INTEGER) AS max_age FROM j GROUP BY 1, 2""",
    "expanding_mean": f"""WITH {_Q} SELECT quarter_start, round(avg(n_docs) OVER w, 6) AS n_docs_so_far, count(n_docs) OVER w AS n_so_far FROM q
        WINDOW w AS (ORDER BY quarter_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "year_range": "SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998",
    "labels_next_quarter": f"""WITH {_Q} SELECT quarter_start, CASE WHEN lead(close) OVER w > close THEN 1 WHEN lead(close) OVER w IS NOT NULL THEN 0 END AS label, lead(quarter_start) OVER w AS label_date
        FROM q WINDOW w AS (ORDER BY quarter_start)""",
    "leadlag_corr": f"WITH {_Q}, l AS (SELECT urgent, " + ", ".join(f"lag(close, {-k}) OVER w AS y{i}" if k <= 0 else f"lead(close, {k}) OVER w AS y{i}" for i, k in enumerate(range(-4, 5)))
    + " FROM q WINDOW w AS (ORDER BY quarter_start)) " + " UNION ALL ".join(f"SELECT {k} AS lag, round(corr(urgent, y{i}), 6) AS corr FROM l" for i, k in enumerate(range(-4, 5))),
    "risk_event_corr": f"""WITH {_Q}, r AS (SELECT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS quarter_start, count(*) FILTER (l_returnflag = 'R') / count(*) AS risk FROM lineitem GROUP BY 1)
        SELECT round(corr(risk, CAST(n_docs AS DOUBLE)), 6) AS corr, count(*) AS n_quarters FROM r JOIN q USING (quarter_start)""",
    "chrono_split": f"WITH {_Q} SELECT {_SPLIT} AS split, count(*) AS n, min(quarter_start) AS first_quarter, max(quarter_start) AS last_quarter FROM q GROUP BY 1",
    "split_check": f"""WITH {_Q}, x AS (SELECT quarter_start, {_SPLIT} AS split FROM q), y AS (SELECT max(quarter_start) FILTER (split = 'train') AS train_max, min(quarter_start) FILTER (split = 'test') AS test_min FROM x)
        SELECT train_max, test_min, train_max < test_min AS ok FROM y""",
    "leakage_violations": f"""WITH {_Q}, x AS (SELECT CASE WHEN (month(quarter_start) + year(quarter_start) * 12) % 7 = 0 THEN CAST(quarter_start + INTERVAL 6 MONTH AS DATE) ELSE quarter_start END AS f,
        lead(quarter_start) OVER (ORDER BY quarter_start) AS l FROM q) SELECT count(*) AS n_rows, count(*) FILTER (f IS NULL OR f >= l) AS violations FROM x""",
    "features_allowed": f"""WITH {_Q}, x AS (SELECT quarter_start, as_of_date, CASE WHEN month(quarter_start) = 1 THEN quarter_start ELSE CAST(quarter_start + INTERVAL 3 MONTH AS DATE) END AS use_at FROM q)
        SELECT quarter_start, use_at FROM x WHERE as_of_date <= use_at""",
    "split_confusion": "SELECT o_orderstatus AS label, CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS pred, count(*) AS n FROM orders GROUP BY 1, 2",
}
