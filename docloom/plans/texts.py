"""Text, graph and validation queries.

The prose of the test tables is invented, so these queries use a lexicon of words that occur there; the phrases of
``docloom.functions.text`` are the production default.  ``documents`` has no date: 2015-01-01 plus doc_id modulo 4000
days stands in, in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.urls import extract_domain
from docloom.operators import evaluate, graph, signals
from docloom.sources.tables import table

LEXICON = {"alpha": ("the", "der"), "beta": ("of the", "in the"), "gamma": ("de la", "und"), "delta": ("les",)}
_TYPES = {"alpha": "Product", "beta": "Technology Capability", "gamma": "Technology Capability", "delta": "Risk Topic"}
_LEX_SQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{e}', '{_TYPES[e]}', '{a}')" for e, al in LEXICON.items() for a in al) + ") AS t(entity_id, entity_type, alias))"
_PADDED = "' ' || trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')) || ' '"


def _docs(spark, d):
    return table(spark, d, "documents")


def _lexicon(spark):
    return spark.createDataFrame([(e, _TYPES[e], a) for e, al in LEXICON.items() for a in al], "entity_id string, entity_type string, alias string")


def sentences(spark, d):
    """Sentences of all documents with stable ids."""
    return T.sentences(_docs(spark, d)).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence_id", F.length("sentence").cast("bigint").alias("n_chars"))


def sentence_context(spark, d):
    """Each sentence with up to two sentences on both sides: their digest, characters and number."""
    from pyspark.sql import Window

    s = T.sentences(_docs(spark, d))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, 2)
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.sha2(F.array_join(F.collect_list("sentence").over(w), " "), 256).alias("context_sha256"), F.sum(F.length("sentence")).over(w).alias("context_chars"), F.count("*").over(w).alias("n_sentences"))


def lexicon_flags(spark, d):
    """Documents with each entity of the lexicon."""
    return _docs(spark, d).select("doc_id", T.flags("text", LEXICON).alias("f")).select("doc_id", *(F.coalesce(f"f.{e}", F.lit(False)).alias(e) for e in LEXICON))


def doc_flag_counts(spark, d):
    """Sentences, and those with an entity, by document."""
    n = _docs(spark, d).select("doc_id", T.sentence_counts("text", LEXICON).alias("n")).select("doc_id", "n.*").where("n_sentences > 0")
    return n.groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in ("n_sentences", *LEXICON)))


def section_flags(spark, d):
    """Sentences and flagged ones by the last heading, here the first word "the" or "der" of a sentence."""
    s = T.with_section(T.sentences(_docs(spark, d)), r"^\s*(the|der) ")
    s = s.withColumn("f", T.has_phrase("sentence", LEXICON["beta"]))
    return s.groupBy("section").agg(F.count("*").alias("n_sentences"), F.sum(F.col("f").cast("bigint")).alias("n_flagged"))


def false_positives(spark, d):
    """Reasons why sentences with an entity may be no evidence, with "les" in the place of a competitor."""
    s = T.sentences(_docs(spark, d)).where(T.has_phrase("sentence", LEXICON["alpha"]))
    return s.groupBy(T.false_positive_reason("sentence", LEXICON["delta"]).alias("reason")).agg(F.count("*").alias("n"))


def label_classes(spark, d):
    """Production labels of documents; the invented prose has few of these phrases."""
    x = _docs(spark, d).select(T.ai_label("text").alias("ai_label"), T.risk_label("text").alias("risk_label"), T.product_label("text", LEXICON["alpha"], LEXICON["beta"]).alias("product_label"))
    return x.groupBy("ai_label", "risk_label", "product_label").agg(F.count("*").alias("n"))


def evidence_span(spark, d):
    """Offsets and excerpt of the first "the " in every document."""
    e = _docs(spark, d).select("doc_id", T.evidence("text", "the ").alias("e"))
    return e.select("doc_id", F.col("e.start").cast("bigint").alias("start"), F.col("e.stop").cast("bigint").alias("stop"), F.col("e.excerpt").alias("excerpt"))


def html_text(spark, d):
    """Text of every page."""
    return table(spark, d, "pages").select("page_id", F.sha2(T.html_text("html"), 256).alias("text_hash"), F.length(T.html_text("html")).cast("bigint").alias("n_chars"))


def doc_classify(spark, d):
    """Type of every page by URL and title."""
    p = table(spark, d, "pages").select("page_id", T.document_type("url", F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("doc_type"))
    return p


def publish_dates(spark, d):
    """Best guess of a date from metadata, text or neither, with its confidence."""
    o = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("s"))
    k = F.col("o_orderkey") % 3
    x = o.select("o_orderkey", T.publish_date(F.when(k == 0, F.col("s")), F.when(k == 1, F.concat(F.lit("on "), F.col("s"), F.lit("."))).otherwise(F.lit("undated"))).alias("p"))
    return x.select("o_orderkey", "p.published_at", "p.published_conf")


def kg_edges(spark, d):
    """Mention edges of all sentences, counted by document and entity, with one evidence sentence each."""
    found = graph.mentions(T.sentences(_docs(spark, d)), _lexicon(spark))
    e = graph.edges(found, "MENTIONS", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.lit("2024-01-01").cast("timestamp"))
    return e.groupBy("src_id", "dst_id", "dst_type", "edge_type").agg(F.countDistinct("provenance.sentence_id").alias("n_sentences"), F.min("provenance.sentence_id").alias("evidence_id"))


def co_mention_entities(spark, d):
    """Documents that mention a product and a capability."""
    m = graph.mentions(T.sentences(_docs(spark, d)), _lexicon(spark))
    a = m.where("entity_type = 'Product'").select("doc_id", F.col("entity_id").alias("product"))
    b = m.where("entity_type = 'Technology Capability'").select("doc_id", F.col("entity_id").alias("capability"))
    return graph.co_mentions(a, b, "doc_id", "product", "capability")


def lang_intensity(spark, d):
    """Share of documents with a phrase, by language and by source."""
    x = _docs(spark, d).select("lang", "source", T.has_phrase("text", LEXICON["beta"]).alias("f"))
    return x.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.col("f").cast("double")), 9).alias("intensity"))


def _dated():
    """Stands in for the date of a document."""
    return F.date_add(F.lit("2015-01-01").cast("date"), (F.col("doc_id") % 4000).cast("int"))


def ai_intensity_quarter(spark, d):
    """Sentences of each quarter and the share of them with a phrase."""
    n = _docs(spark, d).select(signals.quarter(_dated()).alias("quarter_start"), T.sentence_counts("text", {"hits": LEXICON["beta"]}).alias("n")).select("quarter_start", "n.*")
    by = n.groupBy("quarter_start").agg(F.sum("n_sentences").alias("n_sentences"), F.sum("hits").alias("hits"))
    return by.withColumn("intensity", F.round(F.try_divide(F.col("hits").cast("double"), F.col("n_sentences").cast("double")), 9))


def entity_types(spark, d):
    """Distinct entities of each type that the documents mention."""
    return graph.entity_counts(graph.mentions(T.sentences(_docs(spark, d)), _lexicon(spark)))


def evidence_spans(spark, d):
    """Offsets and excerpts of every "the " in every document."""
    e = _docs(spark, d).select("doc_id", F.posexplode(T.evidence_all("text", "the ")).alias("k", "e"))
    return e.select("doc_id", F.col("k").cast("bigint").alias("k"), F.col("e.start").cast("bigint").alias("start"), F.col("e.stop").cast("bigint").alias("stop"), F.col("e.excerpt").alias("excerpt"))


def alias_canonical(spark, d):
    """Brands under the names of an alias map."""
    aliases = spark.createDataFrame([(" BRAND  11 ", "first"), ("brand#12", "second"), ("Brand-12", "second")], "alias string, entity string")
    return graph.canonical(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", aliases).select("p_partkey", "entity")


def corpus_criteria(spark, d):
    """The criteria that each document fails: sources stand in for authority, a phrase for relevance."""
    public, relevant = ~T.paywalled("text"), T.has_phrase("text", LEXICON["alpha"])
    dated = F.when(F.col("doc_id") % 13 != 0, _dated())
    reasons = T.quality_reasons(public, F.col("source").isin("src1", "src2", "src3", "src4", "src5"), "text", dated, relevant)
    return _docs(spark, d).select("doc_id", F.array_join(reasons, ",").alias("reasons"))


def gold_sentences(spark, d):
    """Sentences that one phrase list predicts against those that another one calls right, by document and sentence."""
    s = T.sentences(_docs(spark, d)).select("doc_id", "sentence_id", T.flags("sentence", {"p": LEXICON["alpha"], "g": LEXICON["beta"]}).alias("f"))
    m = evaluate.against_gold(s.where("f.p"), s.where("f.g"), ["doc_id", "sentence_id"])
    return m.withColumns({"precision": F.round("precision", 9), "coverage": F.round("coverage", 9)})


def precision_report(spark, d):
    """The lines of the precision report of the length rule by language."""
    g = _gold(spark, d).join(_docs(spark, d).select("doc_id", "lang"), "doc_id")
    return evaluate.precision_report(g, "lang", F.col("predicted"), F.col("quality") == 1)


def stratified_periods(spark, d):
    """Two documents of each source, period and length."""
    period = F.when(F.year(_dated()) <= 2017, "early").when(F.year(_dated()) <= 2020, "middle").otherwise("recent")
    length = F.when(F.length("text") < 500, "short").when(F.length("text") < 2000, "medium").otherwise("long")
    return evaluate.stratified(_docs(spark, d).select("doc_id", "source", period.alias("period"), length.alias("length")), ["source", "period", "length"], "doc_id", 2)


def media_share(spark, d):
    """Share of the mentions that come from media sources, here src1 to src4."""
    x = _docs(spark, d).select(T.has_phrase("text", LEXICON["alpha"]).alias("f"), F.col("source").isin("src1", "src2", "src3", "src4").alias("media"))
    n = lambda c: F.sum(c.cast("bigint"))
    return x.agg(n(F.col("f")).alias("n_all"), n(F.col("f") & F.col("media")).alias("n_media")).withColumn("media_share", F.round(F.try_divide(F.col("n_media").cast("double"), F.col("n_all").cast("double")), 9))


def quality_filters(spark, d):
    """Why a document fails the corpus criteria, if it does."""
    reason = F.when(F.length("text") < 200, "too_short").when(F.col("lang") != "en", "not_english").when(F.col("doc_id") % 13 == 0, "undated").otherwise("ok")
    return _docs(spark, d).select("doc_id", reason.alias("reason"))


def paywalls(spark, d):
    """Pages behind a paywall."""
    return table(spark, d, "pages").select("page_id", T.paywalled("html").alias("paywalled"), extract_domain("url").alias("domain"))


def _gold(spark, d):
    flags = _docs(spark, d).select("doc_id", (F.length("text") > 300).alias("predicted"), (F.length("text") / 4000.0).alias("conf"))
    return flags.join(table(spark, d, "labels"), "doc_id")


def gold_precision(spark, d):
    """Precision and coverage of a length rule against the quality labels."""
    p = evaluate.precision(_gold(spark, d), F.col("predicted"), F.col("quality") == 1)
    return p.withColumns({"precision": F.round("precision", 9), "coverage": F.round("coverage", 9)})


def confusion(spark, d):
    """Confusion matrix of the same rule."""
    return evaluate.confusion(_gold(spark, d).withColumn("predicted", F.col("predicted").cast("int")), "quality", "predicted")


def calibration(spark, d):
    """Share of label 1 by tenth of a score."""
    return evaluate.calibration(_gold(spark, d), "conf", "quality").withColumn("accuracy", F.round("accuracy", 9))


def stratified_sample(spark, d):
    """Three documents of each language and source."""
    return evaluate.stratified(_docs(spark, d).select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 3)


def audit_sample(spark, d):
    """A fixed tenth of all documents for double labelling."""
    return _docs(spark, d).where(evaluate.bucketed(F.col("doc_id"), 10)).select("doc_id")


def gold_union(spark, d):
    """Flagged sentences and a fixed twentieth of the others, without repeats."""
    s = T.sentences(_docs(spark, d))
    flagged = s.where(T.has_phrase("sentence", LEXICON["delta"])).select("sentence_id")
    return flagged.union(s.where(evaluate.bucketed(F.col("sentence_id"), 5)).select("sentence_id")).dropDuplicates(["sentence_id"])


def auc_ranksum(spark, d):
    """AUC of the score, by rank sums."""
    return evaluate.auc(_gold(spark, d), "conf", "quality").withColumn("auc", F.round("auc", 9))


def baselines(spark, d):
    """Metrics of the rule beside naive baselines."""
    m = evaluate.classification(_gold(spark, d).withColumn("predicted", F.col("predicted").cast("int")), "quality", "predicted")
    return m.select(*(F.round(c, 9).alias(c) for c in m.columns))


def bootstrap_accuracy(spark, d):
    """Bootstrap interval of the rule's accuracy."""
    return evaluate.bootstrap(_gold(spark, d).withColumn("ok", (F.col("predicted") == (F.col("quality") == 1)).cast("int")), "doc_id", "ok")


QUERIES = {
    f.__name__: f
    for f in (
        sentences, sentence_context, lexicon_flags, doc_flag_counts, section_flags, false_positives, label_classes, evidence_span, html_text, doc_classify, publish_dates, kg_edges, co_mention_entities, lang_intensity,
        media_share, quality_filters, paywalls, gold_precision, confusion, calibration, stratified_sample, audit_sample, gold_union, auc_ranksum, baselines, bootstrap_accuracy,
        ai_intensity_quarter, entity_types, evidence_spans, alias_canonical, corpus_criteria, gold_sentences, precision_report, stratified_periods,
    )
}


def _has(column, phrases):
    p = _PADDED.format(column)
    return "(" + " OR ".join(f"contains({p}, ' {x} ')" for x in phrases) + ")"


_SENT = """s AS (SELECT doc_id, i - 1 AS pos, ss[i] AS sentence, left(sha256(doc_id || '|' || (i - 1) || '|' || ss[i]), 16) AS sentence_id
    FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS ss FROM documents)))"""
_MENTION = f"{_SENT}, {_LEX_SQL}, m AS (SELECT s.doc_id, sentence_id, entity_id, entity_type FROM s JOIN lex ON contains({_PADDED.format('sentence')}, ' ' || alias || ' '))"
_GOLD = "g AS (SELECT d.doc_id, length(text) > 300 AS predicted, length(text) / 4000.0 AS conf, quality FROM documents d JOIN labels USING (doc_id))"
_HTML = "html"
for _p, _to in T.HTML_STEPS:
    _HTML = f"regexp_replace({_HTML}, '{_p}', '{_to}', 'g')"
_BUCKET = "CAST('0x' || left(md5(CAST({0} AS VARCHAR)), 8) AS BIGINT) % 100"
ORACLES = {
    "sentences": f"WITH {_SENT} SELECT doc_id, pos, sentence_id, length(sentence) AS n_chars FROM s",
    "sentence_context": f"""WITH {_SENT} SELECT doc_id, pos, sha256(string_agg(sentence, ' ') OVER w) AS context_sha256, CAST(sum(length(sentence)) OVER w AS BIGINT) AS context_chars, count(*) OVER w AS n_sentences FROM s
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "lexicon_flags": "SELECT doc_id, " + ", ".join(f"{_has('text', a)} AS {e}" for e, a in LEXICON.items()) + " FROM documents",
    "doc_flag_counts": f"WITH {_SENT} SELECT doc_id, count(*) AS n_sentences, " + ", ".join(f"count(*) FILTER ({_has('sentence', a)}) AS {e}" for e, a in LEXICON.items()) + " FROM s GROUP BY doc_id",
    "section_flags": f"""WITH {_SENT}, h AS (SELECT *, nullif(regexp_extract(lower(sentence), '^\\s*(the|der) ', 1), '') AS head FROM s),
        x AS (SELECT sentence, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM h)
        SELECT section, count(*) AS n_sentences, count(*) FILTER ({_has('sentence', LEXICON['beta'])}) AS n_flagged FROM x GROUP BY section""",
    "false_positives": f"""WITH {_SENT} SELECT CASE WHEN regexp_matches(lower(sentence), 'forward-looking statements|all rights reserved|safe harbor') THEN 'boilerplate'
        WHEN {_has('sentence', LEXICON['delta'])} THEN 'competitor' WHEN regexp_matches(lower(sentence), 'reduces? risk|mitigat|protects? against') THEN 'positive_framing'
        WHEN regexp_matches(lower(sentence), 'like a |as if |so to speak') THEN 'metaphor' ELSE 'none' END AS reason, count(*) AS n FROM s WHERE {_has('sentence', LEXICON['alpha'])} GROUP BY 1""",
    "label_classes": f"""SELECT CASE WHEN {_has('text', T.AI_EXPLICIT)} THEN 'AI_EXPLICIT' WHEN {_has('text', T.AI_IMPLICIT)} THEN 'AI_IMPLICIT' ELSE 'AI_NONE' END AS ai_label,
        CASE WHEN {_has('text', T.RISK_AI)} THEN 'RISK_AI' WHEN {_has('text', T.RISK_TECH)} THEN 'RISK_TECH' WHEN {_has('text', T.RISK_OTHER)} THEN 'RISK_OTHER' ELSE 'RISK_NONE' END AS risk_label,
        CASE WHEN {_has('text', LEXICON['alpha'])} AND {_has('text', LEXICON['beta'])} THEN 'BOTH' WHEN {_has('text', LEXICON['alpha'])} THEN 'PRODUCT' WHEN {_has('text', LEXICON['beta'])} THEN 'CAPABILITY' ELSE 'NONE' END AS product_label,
        count(*) AS n FROM documents GROUP BY 1, 2, 3""",
    "evidence_span": """WITH x AS (SELECT doc_id, text, instr(text, 'the ') AS i FROM documents) SELECT doc_id, i - 1 AS start, CASE WHEN i > 0 THEN i + 3 ELSE -1 END AS stop,
        CASE WHEN i > 0 THEN substr(text, greatest(i - 20, 1), i - greatest(i - 20, 1) + 24) ELSE '' END AS excerpt FROM x""",
    "html_text": f"WITH x AS (SELECT page_id, trim({_HTML}) AS t FROM pages) SELECT page_id, sha256(t) AS text_hash, length(t) AS n_chars FROM x",
    "doc_classify": """WITH x AS (SELECT page_id, lower(url) AS u, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS t FROM pages)
        SELECT page_id, CASE WHEN regexp_matches(u, '://([^/]*\\.)?sec\\.gov/') OR regexp_matches(t, '10-k|10-q|8-k') THEN 'sec_filing' WHEN contains(t, 'transcript') OR contains(t, 'earnings call') THEN 'earnings_transcript'
        WHEN contains(t, 'press release') OR contains(u, 'newsroom.') OR contains(u, 'wire.com') THEN 'press_release' WHEN regexp_matches(u, '://blog\\.') OR contains(u, '/blog') THEN 'blog'
        WHEN contains(u, '/news') OR contains(t, 'reports') THEN 'news_media' WHEN contains(u, '/event') OR contains(t, 'webcast') THEN 'event' ELSE 'unknown' END AS doc_type FROM x""",
    "publish_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS published_at, CASE o_orderkey % 3 WHEN 0 THEN CAST(0.9 AS DOUBLE) WHEN 1 THEN CAST(0.6 AS DOUBLE) END AS published_conf FROM orders",
    "kg_edges": f"""WITH {_MENTION} SELECT CAST(doc_id AS VARCHAR) AS src_id, entity_id AS dst_id, entity_type AS dst_type, 'MENTIONS' AS edge_type, count(DISTINCT sentence_id) AS n_sentences,
        min(sentence_id) AS evidence_id FROM m GROUP BY 1, 2, 3""",
    "co_mention_entities": f"""WITH {_MENTION} SELECT a.entity_id AS product, b.entity_id AS capability, count(DISTINCT a.doc_id) AS n_docs FROM m a JOIN m b USING (doc_id)
        WHERE a.entity_type = 'Product' AND b.entity_type = 'Technology Capability' GROUP BY 1, 2""",
    "lang_intensity": f"SELECT lang, source, count(*) AS n_docs, round(avg(CASE WHEN {_has('text', LEXICON['beta'])} THEN 1.0 ELSE 0.0 END), 9) AS intensity FROM documents GROUP BY 1, 2",
    "media_share": f"""WITH x AS (SELECT {_has('text', LEXICON['alpha'])} AS f, source IN ('src1', 'src2', 'src3', 'src4') AS media FROM documents)
        SELECT count(*) FILTER (f) AS n_all, count(*) FILTER (f AND media) AS n_media, round(count(*) FILTER (f AND media) / count(*) FILTER (f), 9) AS media_share FROM x""",
    "quality_filters": "SELECT doc_id, CASE WHEN length(text) < 200 THEN 'too_short' WHEN lang <> 'en' THEN 'not_english' WHEN doc_id % 13 = 0 THEN 'undated' ELSE 'ok' END AS reason FROM documents",
    "paywalls": "SELECT page_id, regexp_matches(lower(html), 'subscribe to (read|continue)|subscribers only|sign in to continue') AS paywalled, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS domain FROM pages",
    "gold_precision": f"""WITH {_GOLD}, c AS (SELECT count(*) FILTER (predicted AND quality = 1) AS tp, count(*) FILTER (predicted AND quality <> 1) AS fp, count(*) FILTER (NOT predicted AND quality = 1) AS fn FROM g)
        SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS coverage FROM c""",
    "confusion": f"WITH {_GOLD} SELECT quality, CAST(predicted AS INTEGER) AS predicted, count(*) AS n FROM g GROUP BY 1, 2",
    "calibration": f"WITH {_GOLD} SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bucket, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 9) AS accuracy FROM g GROUP BY 1",
    "stratified_sample": "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 3",
    "audit_sample": f"SELECT doc_id FROM documents WHERE {_BUCKET.format('doc_id')} < 10",
    "gold_union": f"WITH {_SENT} SELECT DISTINCT sentence_id FROM s WHERE {_has('sentence', LEXICON['delta'])} OR {_BUCKET.format('sentence_id')} < 5",
    "auc_ranksum": f"WITH {_GOLD} SELECT round(sum(CASE WHEN a.conf > b.conf THEN 1.0 WHEN a.conf = b.conf THEN 0.5 ELSE 0.0 END) / count(*), 9) AS auc FROM g a, g b WHERE a.quality = 1 AND b.quality = 0",
    "baselines": f"""WITH {_GOLD}, c AS (SELECT CAST(count(*) FILTER (predicted AND quality = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (predicted AND quality = 0) AS DOUBLE) AS fp,
        CAST(count(*) FILTER (NOT predicted AND quality = 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT predicted AND quality = 0) AS DOUBLE) AS tn FROM g)
        SELECT round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
        round(greatest(tp + fn, tn + fp) / (tp + fp + fn + tn), 9) AS majority, CAST(0.5 AS DOUBLE) AS chance, round((tp + fn) / (tp + fp + fn + tn), 9) AS buy_and_hold FROM c""",
    "ai_intensity_quarter": f"""WITH {_SENT}, x AS (SELECT CAST(date_trunc('quarter', DATE '2015-01-01' + CAST(doc_id % 4000 AS INTEGER)) AS DATE) AS quarter_start, {_has('sentence', LEXICON['beta'])} AS f FROM s)
        SELECT quarter_start, count(*) AS n_sentences, count(*) FILTER (f) AS hits, round(count(*) FILTER (f) / count(*), 9) AS intensity FROM x GROUP BY 1""",
    "entity_types": f"WITH {_MENTION} SELECT entity_type, count(DISTINCT entity_id) AS n_entities FROM m GROUP BY 1",
    "evidence_spans": """WITH x AS (SELECT doc_id, text, string_split(text, 'the ') AS p FROM documents), y AS (SELECT doc_id, text, p, unnest(generate_series(0, len(p) - 2)) AS k FROM x),
        z AS (SELECT doc_id, text, k, CAST(list_sum(list_transform(p[1:k + 1], lambda s: length(s))) AS BIGINT) + 4 * k AS start FROM y)
        SELECT doc_id, k, start, start + 4 AS stop, substr(text, greatest(start - 19, 1), start + 1 - greatest(start - 19, 1) + 24) AS excerpt FROM z""",
    "alias_canonical": "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'first' WHEN p_brand = 'Brand#12' THEN 'second' ELSE p_brand END AS entity FROM part",
    "corpus_criteria": f"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(lower(text), 'subscribe to (read|continue)|subscribers only|sign in to continue') THEN 'not_public' END,
        CASE WHEN source NOT IN ('src1', 'src2', 'src3', 'src4', 'src5') THEN 'not_authoritative' END, CASE WHEN length(trim(text)) < 200 THEN 'not_readable' END,
        CASE WHEN doc_id % 13 = 0 THEN 'undated' END, CASE WHEN NOT {_has('text', LEXICON['alpha'])} THEN 'not_relevant' END) AS reasons FROM documents""",
    "gold_sentences": f"""WITH {_SENT}, f AS (SELECT DISTINCT doc_id, sentence_id, {_has('sentence', LEXICON['alpha'])} AS p, {_has('sentence', LEXICON['beta'])} AS g FROM s),
        c AS (SELECT count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn FROM f)
        SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS coverage FROM c""",
    "precision_report": f"""WITH {_GOLD}, c AS (SELECT lang, count(*) FILTER (predicted AND quality = 1) AS tp, count(*) FILTER (predicted AND quality <> 1) AS fp FROM g JOIN documents USING (doc_id) GROUP BY 1)
        SELECT concat('| ', lang, ' | ', tp, ' | ', fp, ' | ', format('{{:.4f}}', tp / (tp + fp)), ' | ', CASE WHEN tp / (tp + fp) >= 0.8 THEN 'met' ELSE 'below' END, ' |') AS value FROM c""",
    "stratified_periods": """WITH x AS (SELECT doc_id, source, year(DATE '2015-01-01' + CAST(doc_id % 4000 AS INTEGER)) AS y, length(text) AS n FROM documents),
        k AS (SELECT doc_id, source, CASE WHEN y <= 2017 THEN 'early' WHEN y <= 2020 THEN 'middle' ELSE 'recent' END AS period, CASE WHEN n < 500 THEN 'short' WHEN n < 2000 THEN 'medium' ELSE 'long' END AS length FROM x)
        SELECT doc_id, source, period, length FROM (SELECT *, row_number() OVER (PARTITION BY source, period, length ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS i FROM k) WHERE i <= 2""",
}
