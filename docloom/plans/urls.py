"""URL, allowlist, seed and dedup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import urls as U
from docloom.operators import dedup
from docloom.sources import domains, seeds
from docloom.sources.tables import table

#: Edge cases that the page table does not have.
EDGES = (
    "", " ", "HTTP://EXAMPLE.COM/Path", "http://example.com:80/path", "https://example.com:443/path", "https://x:80/p", "http://example.com/path/", "http://example.com/",
    "http://x?b=2&a=1&b=1", "http://x/?foo&bar=", "http://x/?t=DEF%2014A&s=a*b~c%2Fd", "http://x/?a=1;b=2", "http://x/?trkInfo=1&trk=2", "http://x/a;p=1?q=1",
    "http://x/a///", "http://x//", "not-a-url", "http://U:P@X.com:80/", "http://x/?utm%5Fsource=1&q=%zz", "ftp://example.com/a", "http://x/p#frag", " http://x/y ",
)

_TRACKING = ", ".join(f"'{p}'" for p in U.TRACKING_PARAMS)
#: The canonical form in DuckDB, for a column ``url`` of relation ``src``.
_NORMAL = f"""
s0 AS (SELECT *, trim(url) AS u FROM src),
s1 AS (SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme FROM s0),
s2 AS (SELECT *, CASE WHEN scheme <> '' THEN substr(u, length(scheme) + 2) ELSE u END AS rest FROM s1),
s3 AS (SELECT *, regexp_extract(rest, '^//([^/?#]*)', 1) AS net, regexp_replace(rest, '^//[^/?#]*', '') AS tail FROM s2),
s4 AS (SELECT *, lower(net) AS low, regexp_extract(tail, '^([^?#]*)', 1) AS raw_path, regexp_extract(tail, '^[^?#]*\\?([^#]*)', 1) AS q FROM s3),
s5 AS (SELECT *, CASE WHEN scheme = 'http' THEN regexp_replace(low, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(low, ':443$', '') ELSE low END AS netloc,
       regexp_replace(regexp_replace(raw_path, ';[^/]*$', ''), '/+$', '') AS trimmed,
       list_filter(list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x, i: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'i': i,
         'v': url_decode(replace(CASE WHEN instr(x, '=') > 0 THEN substr(x, instr(x, '=') + 1) ELSE '' END, '+', ' '))}}), lambda p: NOT list_contains([{_TRACKING}], lower(p.k))) AS ps FROM s4),
s6 AS (SELECT *, CASE WHEN trimmed = '' THEN '/' ELSE trimmed END AS path,
       array_to_string(list_transform(list_sort(ps), lambda p: replace(url_encode(p.k), '%20', '+') || '=' || replace(url_encode(p.v), '%20', '+')), '&') AS query FROM s5),
normal AS (SELECT *, CASE WHEN url IS NULL OR url = '' THEN '' ELSE CASE WHEN scheme <> '' THEN scheme || ':' ELSE '' END
           || CASE WHEN netloc <> '' THEN '//' || netloc || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END
                   WHEN scheme <> '' AND starts_with(path, '/') THEN '//' || path ELSE path END
           || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM s6)
"""
_EDGE_ROWS = ", ".join(f"({i}, '{u}')" for i, u in enumerate(EDGES))
_EDGE_SRC = f"WITH src AS (SELECT * FROM (VALUES {_EDGE_ROWS}) AS t(i, url)),"
_PAGE_SRC = "WITH src AS (SELECT page_id, url, html FROM pages),"


def _edges(spark):
    return spark.createDataFrame(list(enumerate(EDGES)), "i int, url string")


def _domains(spark):
    cases = (" WWW.SEC.GOV ", "sec.gov", "sec.gov:443", "fool.com", "investor.workday.com", "example.com", "techcrunch.com", "")
    return spark.createDataFrame([(i, d) for i, d in enumerate(cases)], "i int, domain string")


_DIM = ", ".join(f"('{d}', '{s}', {p}, CAST({r} AS DOUBLE), {str(h).lower()})" for d, s, p, r, h in domains.DOMAINS)
_DIM_SQL = f"dim AS (SELECT * FROM (VALUES {_DIM}) AS t(domain, source_type, priority, requests_per_second, requires_special_handling))"


def page_hosts(spark, d):
    """Pages and distinct canonical URLs by host."""
    p = table(spark, d, "pages").select(U.extract_domain("url").alias("host"), U.normalize_url("url").alias("u"))
    return p.groupBy("host").agg(F.count("*").alias("n_pages"), F.countDistinct("u").alias("n_urls"))


def url_normalize(spark, d):
    """Canonical form of every page's URL."""
    return table(spark, d, "pages").select("page_id", U.normalize_url("url").alias("canonical"))


def url_edges(spark, d):
    """Canonical form, validity, domain and https form of the edge cases."""
    return _edges(spark).select("i", U.normalize_url("url").alias("canonical"), U.is_valid_url("url").alias("valid"), U.extract_domain("url").alias("domain"))


def url_hash(spark, d):
    """Hash of the canonical URL."""
    return table(spark, d, "pages").select("page_id", U.url_hash("url").alias("url_hash"))


def url_domain(spark, d):
    """Network location, https form and validity of every URL."""
    return table(spark, d, "pages").select("page_id", U.extract_domain("url").alias("domain"), U.convert_to_https("url").alias("https"), U.is_valid_url("url").alias("valid"))


def accession_extract(spark, d):
    """Accession numbers in filing URLs made of order keys; every third URL has none."""
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("http://h/"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-24-000012"))).otherwise(F.lit("none")), F.lit("/a.htm")).alias("u"))
    return o.select("o_orderkey", U.accession_number("u").alias("accession"))


def content_hash(spark, d):
    """Hash of every text."""
    return table(spark, d, "documents").select("doc_id", U.content_hash("text").alias("content_hash"))


def same_document(spark, d):
    """Pages that share a canonical URL with others: counted by URL, not paired."""
    p = table(spark, d, "pages").select("page_id", U.normalize_url("url").alias("canonical"))
    return p.groupBy("canonical").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")).where("n > 1")


def domain_lookup(spark, d):
    """Allowlist lookup of spelled variants."""
    return domains.lookup(_domains(spark)).select("i", "domain", "source_type", "priority", "requests_per_second", "allowed")


def page_allowlist(spark, d):
    """Pages by whether their host is allowed, with the request rate or the default."""
    p = domains.lookup(table(spark, d, "pages").select("page_id", U.extract_domain("url").alias("domain")))
    return p.groupBy("allowed", "requests_per_second").agg(F.count("*").alias("n"))


def domain_by_type(spark, d):
    """Domains of press releases."""
    return domains.by_source_type(spark, "press_release").select("domain", "priority")


def domain_by_priority(spark, d):
    """Domains of the highest priority."""
    return domains.by_priority(spark, domains.PRIORITY["high"]).select("domain", "source_type")


def domain_list(spark, d):
    """All allowed domains."""
    return domains.all_domains(spark)


SEEDS = {
    "sec_filings": [("https://h/a?x=1", "sec_filing", "10-K", "", "", " high", "n1"), ("https://h/b", "sec_filing", "10-Q", "2020", "Q1", "medium", "n2")],
    "investor_relations": [("https://h/c", "investor_relations", "landing_page", "high", "n3")],
    "press_releases": [("https://h/d", "press_release", "listing", "low", "n4")],
    "blog": [("https://h/e", "blog", "category", "technology", "high", "n5"), ("https://h/f", "blog", "landing_page", "", "medium", "n6")],
    "transcripts": [("https://h/g", "earnings_transcript", "listing", "2014", "Q2", "high", "n7")],
    "media": [("https://h/h", "news_media", "search", "low", "n8")],
}


def _seeds(spark):
    return seeds.unite([spark.createDataFrame(rows, ", ".join(f"{c} string" for c in seeds.HEADERS[name].split(","))) for name, rows in SEEDS.items()])


def seed_union(spark, d):
    """Seed rows of six headers in one table."""
    return _seeds(spark)


def seed_queue(spark, d):
    """The first five seeds since 2015 by priority."""
    return seeds.crawl_queue(_seeds(spark), 2015, 5).select("url", "priority_rank")


def _seed_sql():
    parts = []
    for name, rows in SEEDS.items():
        cols = seeds.HEADERS[name].split(",")
        for r in rows:
            v = dict(zip(cols, r))
            cell = lambda c: f"nullif(trim('{v[c]}'), '')" if c in v else "NULL"  # noqa: E731, B023
            parts.append("SELECT " + ", ".join(f"CAST({cell(c)} AS {'INTEGER' if c == 'fiscal_year' else 'VARCHAR'}) AS {c}" for c in seeds.COLUMNS))
    return f"s AS ({' UNION ALL '.join(parts)}), r AS (SELECT *, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END AS priority_rank FROM s)"


def allowlist_diff(spark, d):
    """Domains that only the code or only the written policy allows."""
    code = domains.all_domains(spark)
    policy = spark.createDataFrame([(x,) for x in domains.POLICY], "domain string")
    return code.exceptAll(policy).withColumn("only_in", F.lit("code")).unionByName(policy.exceptAll(code).withColumn("only_in", F.lit("policy")))


def dedup_first_seen(spark, d):
    """First-seen flags of sources and texts in the order of doc_id."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("http://h/"), F.col("source"), F.lit("/"), F.col("lang")).alias("url"), "text")
    return dedup.first_seen(docs, "url", "text", "doc_id").select("doc_id", "url_is_new", "content_is_new")


def dedup_counts(spark, d):
    """Distinct URLs and contents of pages."""
    return dedup.counts(table(spark, d, "pages"), "url", "html")


def _halves(spark, d):
    docs = table(spark, d, "documents").select("doc_id", U.content_hash("text").alias("h"))
    return docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")


def seen_semi(spark, d):
    """Odd documents whose content an even one has."""
    old, new = _halves(spark, d)
    return dedup.seen(new, old, "h").select("doc_id")


def new_anti(spark, d):
    """Odd documents whose content no even one has."""
    old, new = _halves(spark, d)
    return dedup.unseen(new, old, "h").select("doc_id")


def canonical_map(spark, d):
    """Smallest id with the same content."""
    return dedup.canonical_map(table(spark, d, "documents"), "doc_id", "text")


def drift_compare(spark, d):
    """Two snapshots: without multiples of 7, against one without multiples of 11 in which multiples of 5 changed."""
    docs = table(spark, d, "documents").select("doc_id", U.content_hash("text").alias("h"))
    new = docs.where("doc_id % 11 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("h")))
    return dedup.drift(docs.where("doc_id % 7 <> 0"), new, "doc_id", "h")


def upsert_merge(spark, d):
    """Customers, those with a key divisible by 3 replaced by a later version, and one new one."""
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey % 3 = 0").withColumn("c_name", F.concat(F.lit("new "), F.col("c_name")))
    new = new.unionByName(spark.createDataFrame([(-1, "added")], "c_custkey long, c_name string"))
    return dedup.upsert(old, new, "c_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        page_hosts, url_normalize, url_edges, url_hash, url_domain, accession_extract, content_hash, same_document, domain_lookup, page_allowlist, domain_by_type, domain_by_priority,
        domain_list, seed_union, seed_queue, allowlist_diff, dedup_first_seen, dedup_counts, seen_semi, new_anti, canonical_map, drift_compare, upsert_merge,
    )
}

_HALVES = "WITH x AS (SELECT doc_id, sha256(text) AS h FROM documents), o AS (SELECT * FROM x WHERE doc_id % 2 = 0), n AS (SELECT * FROM x WHERE doc_id % 2 = 1)"
ORACLES = {
    "page_hosts": f"{_PAGE_SRC}{_NORMAL} SELECT low AS host, count(*) AS n_pages, count(DISTINCT canonical) AS n_urls FROM normal GROUP BY low",
    "url_normalize": f"{_PAGE_SRC}{_NORMAL} SELECT page_id, canonical FROM normal",
    "url_edges": f"{_EDGE_SRC}{_NORMAL} SELECT i, canonical, scheme IN ('http', 'https') AND net <> '' AS valid, low AS domain FROM normal",
    "url_hash": f"{_PAGE_SRC}{_NORMAL} SELECT page_id, left(sha256(canonical), 16) AS url_hash FROM normal",
    "url_domain": f"{_PAGE_SRC}{_NORMAL} SELECT page_id, low AS domain, regexp_replace(url, '^http://', 'https://') AS https, scheme IN ('http', 'https') AND net <> '' AS valid FROM normal",
    "accession_extract": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-24-000012' END AS accession FROM orders",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "same_document": f"{_PAGE_SRC}{_NORMAL} SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM normal GROUP BY canonical HAVING count(*) > 1",
    "domain_lookup": f"""WITH {_DIM_SQL}, c AS (SELECT * FROM (VALUES (0, ' WWW.SEC.GOV '), (1, 'sec.gov'), (2, 'sec.gov:443'), (3, 'fool.com'), (4, 'investor.workday.com'), (5, 'example.com'),
        (6, 'techcrunch.com'), (7, '')) AS t(i, domain)) SELECT i, c.domain, source_type, priority, coalesce(requests_per_second, 1.0) AS requests_per_second, dim.domain IS NOT NULL AS allowed
        FROM c LEFT JOIN dim ON dim.domain = lower(trim(c.domain))""",
    "page_allowlist": f"""{_PAGE_SRC}{_NORMAL}, {_DIM_SQL} SELECT dim.domain IS NOT NULL AS allowed, coalesce(requests_per_second, 1.0) AS requests_per_second, count(*) AS n
        FROM normal LEFT JOIN dim ON dim.domain = low GROUP BY 1, 2""",
    "domain_by_type": f"WITH {_DIM_SQL} SELECT domain, priority FROM dim WHERE source_type = 'press_release'",
    "domain_by_priority": f"WITH {_DIM_SQL} SELECT domain, source_type FROM dim WHERE priority = 1",
    "domain_list": f"WITH {_DIM_SQL} SELECT domain FROM dim",
    "seed_union": f"WITH {_seed_sql()} SELECT * FROM r",
    "seed_queue": f"WITH {_seed_sql()} SELECT url, priority_rank FROM r WHERE fiscal_year IS NULL OR fiscal_year >= 2015 ORDER BY priority_rank, url LIMIT 5",
    "allowlist_diff": f"""WITH {_DIM_SQL}, p AS (SELECT * FROM (VALUES {', '.join(f"('{x}')" for x in domains.POLICY)}) AS t(domain))
        SELECT domain, 'code' AS only_in FROM (SELECT domain FROM dim EXCEPT ALL SELECT domain FROM p) UNION ALL SELECT domain, 'policy' FROM (SELECT domain FROM p EXCEPT ALL SELECT domain FROM dim)""",
    "dedup_first_seen": """SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1 AS url_is_new,
        row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS content_is_new FROM documents""",
    "dedup_counts": f"{_PAGE_SRC}{_NORMAL} SELECT count(DISTINCT canonical) AS url_count, count(DISTINCT html) AS content_count FROM normal",
    "seen_semi": f"{_HALVES} SELECT doc_id FROM n WHERE EXISTS (SELECT 1 FROM o WHERE o.h = n.h)",
    "new_anti": f"{_HALVES} SELECT doc_id FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.h = n.h)",
    "canonical_map": "SELECT doc_id, sha256(text) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS canonical_id FROM documents",
    "drift_compare": """WITH x AS (SELECT doc_id, sha256(text) AS h FROM documents), o AS (SELECT * FROM x WHERE doc_id % 7 <> 0),
        n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE h END AS h FROM x WHERE doc_id % 11 <> 0)
        SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN n USING (doc_id)""",
    "upsert_merge": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'added'",
}
