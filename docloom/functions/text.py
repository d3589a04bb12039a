"""Text functions: HTML to text, sentences with stable ids, lexicon flags, evidence spans, document types and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.base import col, let

# Phrases that the labelling scheme gives as examples of its classes.
AI_EXPLICIT = ("machine learning", "artificial intelligence", "deep learning", "generative ai")
AI_IMPLICIT = ("predictive analytics", "intelligent automation")
RISK_AI = ("algorithmic bias", "model accuracy", "bias", "data privacy", "model reliability")
RISK_TECH = ("cybersecurity", "data breach")
RISK_OTHER = ("market conditions", "competition")
SENTENCE = "[^.!?]+[.!?]*"
#: HTML to text: patterns and what replaces them, in order.
HTML_STEPS = (
    ("(?is)<(script|style|nav|head|footer)[^>]*>.*?</(script|style|nav|head|footer)>", " "),
    ("(?s)<!--.*?-->", " "),
    ("(?s)<[^>]*>", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("[ \\t\\r\\n]+", " "),
)


def html_text(html: Column | str) -> Column:
    """Text of a page without scripts, styles, navigation, comments and tags; white space collapsed."""
    out = col(html)
    for pattern, to in HTML_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def plain_tokens(text: Column | str) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "), " ", -1), lambda w: w != "")


def padded(text: Column | str) -> Column:
    """Lower-case text in which words stand between single blanks, for phrase search at word boundaries."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " ")), F.lit(" "))


def has_phrase(text: Column | str, phrases) -> Column:
    """Whether any phrase occurs at word boundaries."""
    return let(padded(text), lambda t: F.exists(F.array(*(F.lit(f" {p} ") for p in phrases)), lambda p: F.contains(t, p)))


def _holds(form: Column, phrases) -> Column:
    """Whether a text in the form of :func:`padded` has any phrase."""
    return reduce(lambda a, b: a | b, (F.contains(form, F.lit(f" {p} ")) for p in phrases), F.lit(False))


def flags(text: Column | str, lexicon: dict) -> Column:
    """A struct with a flag for each entry of a lexicon (name: phrases); the text is normalised once."""
    return let(padded(text), lambda t: F.struct(*(_holds(t, phrases).alias(name) for name, phrases in lexicon.items())))


def sentence_counts(text: Column | str, lexicon: dict) -> Column:
    """Number of a text's sentences, and of those with each entry of a lexicon, without exploding them."""
    forms = F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(SENTENCE), F.lit(0)), padded)
    count = lambda ss, phrases: F.size(F.filter(ss, lambda t: _holds(t, phrases))).cast("bigint")
    return let(forms, lambda ss: F.struct(F.size(ss).cast("bigint").alias("n_sentences"), *(count(ss, phrases).alias(name) for name, phrases in lexicon.items())))


def ai_label(text: Column | str) -> Column:
    """AI_EXPLICIT, AI_IMPLICIT or AI_NONE."""
    return F.when(has_phrase(text, AI_EXPLICIT), "AI_EXPLICIT").when(has_phrase(text, AI_IMPLICIT), "AI_IMPLICIT").otherwise("AI_NONE")


def risk_label(text: Column | str) -> Column:
    """RISK_AI, RISK_TECH, RISK_OTHER or RISK_NONE."""
    return F.when(has_phrase(text, RISK_AI), "RISK_AI").when(has_phrase(text, RISK_TECH), "RISK_TECH").when(has_phrase(text, RISK_OTHER), "RISK_OTHER").otherwise("RISK_NONE")


def product_label(text: Column | str, products, capabilities) -> Column:
    """PRODUCT, CAPABILITY, BOTH or NONE for the dictionaries given."""
    p, c = has_phrase(text, products), has_phrase(text, capabilities)
    return F.when(p & c, "BOTH").when(p, "PRODUCT").when(c, "CAPABILITY").otherwise("NONE")


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, sentence and a stable sentence_id made of document, position and wording."""
    found = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0))).alias("pos", "sentence"))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.col("sentence"))
    return found.withColumn("sentence_id", F.substring(F.sha2(key, 256), 1, 16))


def evidence(text: Column | str, phrase: str, around: int = 20) -> Column:
    """start (0-based, -1 if absent), stop and excerpt of the first occurrence of a phrase."""
    t = col(text)
    at = F.instr(t, phrase)
    low = F.greatest(at - around, F.lit(1))
    return F.struct(
        (at - 1).alias("start"),
        F.when(at > 0, at - 1 + len(phrase)).otherwise(F.lit(-1)).alias("stop"),
        F.when(at > 0, F.substr(t, low, at - low + len(phrase) + around)).otherwise(F.lit("")).alias("excerpt"),
    )


def evidence_all(text: Column | str, phrase: str, around: int = 20) -> Column:
    """start, stop and excerpt of every occurrence of a phrase, none of which overlap."""
    t = col(text)
    n = len(phrase)
    parts = F.slice(F.split(t, "\\Q" + phrase + "\\E", -1), 1, F.size(F.split(t, "\\Q" + phrase + "\\E", -1)) - 1)
    starts = F.aggregate(parts, F.array().cast("array<int>"), lambda at, p: F.concat(at, F.array(F.when(F.size(at) > 0, F.get(at, F.size(at) - 1) + n).otherwise(0) + F.length(p))))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + n).alias("stop"), F.substr(t, F.greatest(s + 1 - around, F.lit(1)), s + 1 - F.greatest(s + 1 - around, F.lit(1)) + n + around).alias("excerpt")))


def quality_reasons(public: Column, authoritative: Column, text: Column | str, published: Column, relevant: Column, least: int = 200) -> Column:
    """The criteria of the corpus that a document fails; none for one that may stay.  Unknown counts as failed."""
    tests = {"not_public": public, "not_authoritative": authoritative, "not_readable": F.length(F.trim(col(text))) >= least, "undated": published.isNotNull(), "not_relevant": relevant}
    return F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in tests.items())), lambda r: r.isNotNull())


def document_type(url: Column | str, title: Column | str) -> Column:
    """Rule-based type: filing, transcript, press release, blog, media, event, else unknown."""
    u, t = F.lower(col(url)), F.lower(col(title))
    return (
        F.when(u.rlike(r"://([^/]*\.)?sec\.gov/") | t.rlike("10-k|10-q|8-k"), "sec_filing")
        .when(t.contains("transcript") | t.contains("earnings call"), "earnings_transcript")
        .when(t.contains("press release") | u.contains("newsroom.") | u.contains("wire.com"), "press_release")
        .when(u.rlike("://blog\\.") | u.contains("/blog"), "blog")
        .when(u.contains("/news") | t.contains("reports"), "news_media")
        .when(u.contains("/event") | t.contains("webcast"), "event")
        .otherwise("unknown")
    )


def publish_date(meta: Column | str, body: Column | str) -> Column:
    """Best guess of the publication date with a confidence: metadata 0.9, an ISO date in the text 0.6, a US date 0.4."""
    iso = F.try_to_date(F.nullif(F.regexp_extract(col(body), r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), F.lit("")), "yyyy-MM-dd")
    us = F.try_to_date(F.nullif(F.regexp_extract(col(body), r"([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})", 1), F.lit("")), "M/d/yyyy")
    given = F.try_to_date(F.substring(col(meta), 1, 10), "yyyy-MM-dd")
    sure = F.when(given.isNotNull(), 0.9).when(iso.isNotNull(), 0.6).when(us.isNotNull(), 0.4)
    return F.struct(F.coalesce(given, iso, us).alias("published_at"), sure.alias("published_conf"))


def paywalled(body: Column | str) -> Column:
    """Whether a page asks for a subscription."""
    return F.lower(col(body)).rlike("subscribe to (read|continue)|subscribers only|sign in to continue")


def in_years(at: Column | str, first: int = 2015, last: int = 2025) -> Column:
    """Whether a date lies in the years of the corpus."""
    return F.year(col(at)).between(first, last)


def with_section(sentences: DataFrame, headings: str = r"^\s*(item [0-9]+[a-z]?|risk factors|management)", doc_id: str = "doc_id", pos: str = "pos") -> DataFrame:
    """``section``: the last heading at or before each sentence of a document, null before the first."""
    from pyspark.sql import Window

    heading = F.nullif(F.regexp_extract(F.lower("sentence"), headings, 1), F.lit(""))
    w = Window.partitionBy(doc_id).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("section", F.last(heading, ignorenulls=True).over(w))


def false_positive_reason(sentence: Column | str, competitors=()) -> Column:
    """Why a flagged sentence may be no evidence: boilerplate, competitor, positive framing, metaphor, else none."""
    s = F.lower(col(sentence))
    rival = has_phrase(sentence, competitors) if competitors else F.lit(False)
    return (
        F.when(s.rlike("forward-looking statements|all rights reserved|safe harbor"), "boilerplate")
        .when(rival, "competitor")
        .when(s.rlike("reduces? risk|mitigat|protects? against"), "positive_framing")
        .when(s.rlike("like a |as if |so to speak"), "metaphor")
        .otherwise("none")
    )
