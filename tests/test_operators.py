import datetime as dt
import functools
import gzip
import http.server
import json
import random
import threading
import time
import urllib.robotparser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom import config, pipeline
from docloom.operators import crawl, dedup, evaluate, features, graph, model, signals
from docloom.plans import catalog
from docloom.sources import documents, domains, fetch, seeds
from docloom.streaming import jobs


def test_domains(spark):
    df = spark.createDataFrame([(" WWW.SEC.GOV ",), ("sec.gov:443",), ("fool.com",), (None,)], "domain string")
    got = [(r.allowed, r.requests_per_second) for r in domains.lookup(df).collect()]
    assert sorted(got) == [(False, 1.0)] * 3 + [(True, 0.1)]
    assert domains.all_domains(spark).count() == 12


def test_first_seen_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "http://x", None), (2, "http://x/", "a"), (3, "http://y", "a"), (4, None, ""), (5, None, "")], "seq int, url string, content string")
    got = {r.seq: (r.url_is_new, r.content_is_new) for r in dedup.first_seen(df, "url", "content", "seq").collect()}
    assert got == {1: (True, True), 2: (False, True), 3: (True, False), 4: (True, True), 5: (False, False)}


def test_schedule_is_the_recurrence(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = [0, 1, 2, 30, 31, 100]
    df = spark.createDataFrame([(i, "d", t0 + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "i int, d string, ts timestamp")
    start, want = None, []
    for s in at:
        start = s if start is None else max(s, start + 10)
        want.append(start)
    base = int(t0.replace(tzinfo=dt.timezone.utc).timestamp())
    assert [r.start_us / 1e6 - base for r in crawl.schedule(df, "d", "ts", "i", 10).orderBy("i").collect()] == want


def test_adaptive_rates_and_their_stream(spark, tmp_path):
    outcomes = [True] * 5 + [False] * 7
    df = spark.createDataFrame([(i, 1, f) for i, f in enumerate(outcomes)] + [(i, 2, True) for i in range(20, 22)], "event_id long, user_id long, failed boolean")
    batch = {r.user_id: (r.requests, r.error_count, round(r.current_rate, 9)) for r in crawl.adaptive_rates(df, "user_id", "event_id", "failed").collect()}
    assert batch[1][1:] == (0, round(0.125 * 1.1**5, 9)) and batch[2] == (2, 2, 1.0)
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = jobs.run_to_table(jobs.rate_state(spark.readStream.schema(df.schema).parquet(path)), "rates", "update", str(tmp_path / "cp"))
    assert {r.user_id: (r.requests, r.error_count, round(r.current_rate, 9)) for r in out.collect()} == batch


def test_backoff(spark):
    assert [r[0] for r in spark.range(8).select(crawl.backoff("id")).collect()] == [1, 2, 4, 8, 16, 32, 60, 60]
    waits = []
    assert fetch.with_retry(lambda: 1 / 0, 2, wait=waits.append).attempts == 3 and len(waits) == 2
    assert fetch.with_retry(lambda: 5).result == 5
    assert 0.9 <= fetch.backoff(0) <= 1.1 and fetch.backoff(9) <= 66


def test_fetch_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>T</title>")
    queue = [("a", 100.0, [f"file://{tmp_path}/a.html", f"file://{tmp_path}/none.html"])]
    got = {r.url.rpartition("/")[2]: (r.attempts, r.error is None) for r in fetch.fetch(spark, queue, retries=0).collect()}
    assert got == {"a.html": (1, True), "none.html": (1, False)}


ROBOTS = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n",
    "User-agent: *\nAllow: /a/b\nDisallow: /a\nCrawl-delay: 3\n",
    "User-agent: docloom\nDisallow: /x\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: other\nUser-agent: DocLoom\nDisallow: /a # c\nCrawl-delay: 1.5\n",
    "User-agent: *\nDisallow:\n",
    "",
]


def test_robots_agree_with_the_parser(spark):
    files = spark.createDataFrame([(f"h{i}", b) for i, b in enumerate(ROBOTS)], "host string, body string")
    urls = [f"http://h{i}{p}" for i in range(len(ROBOTS)) for p in ("/a", "/a/b", "/x/y?z=1", "/", "")]
    rules = crawl.parse_robots(files, agent="docloom/1.0")
    sites = files.select("host", F.lit(200).alias("status"))
    got = {r.url: (r.allowed, r.crawl_delay) for r in crawl.robots_verdicts(spark.createDataFrame([(u,) for u in urls], "url string"), rules, sites).collect()}
    for i, body in enumerate(ROBOTS):
        p = urllib.robotparser.RobotFileParser()
        p.parse(body.splitlines())
        for u in urls:
            if u.startswith(f"http://h{i}"):
                assert got[u] == (p.can_fetch("docloom/1.0", u), float(p.crawl_delay("docloom/1.0") or 1.0)), (u, body)


@pytest.mark.parametrize("mode,allowed", [("compat", False), ("intended", True)])
def test_missing_robots(spark, mode, allowed):
    urls = spark.createDataFrame([("http://a/x",), ("http://b/x",), ("http://c/x",)], "url string")
    sites = spark.createDataFrame([("a", 404), ("b", 500)], "host string, status int")
    rules = crawl.parse_robots(spark.createDataFrame([], "host string, body string"))
    got = {r.url: r.allowed for r in crawl.robots_verdicts(urls, rules, sites, mode=mode).collect()}
    assert got == {"http://a/x": allowed, "http://b/x": False, "http://c/x": allowed}


def test_seeds(spark, tmp_path):
    for name, header in seeds.HEADERS.items():
        cols = header.split(",")
        (tmp_path / f"{name}.csv").write_text(header + "\n" + ",".join(" high" if c == "priority" else "2020" if c == "fiscal_year" else name for c in cols) + "\n")
    got = seeds.read(spark, str(tmp_path))
    assert got.count() == 6 and {r.priority_rank for r in got.collect()} == {1}
    assert seeds.crawl_queue(got, since=2021).count() == 4


def test_as_of_strict_and_ties(spark):
    left = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "id int, t int")
    right = spark.createDataFrame([(5, "a"), (6, "b")], "at int, v string")
    assert {r.id: r.v for r in features.as_of(left, right, "t", "at", ["v"]).collect()} == {1: "a", 2: "b", 3: None}
    assert {r.id: r.v for r in features.as_of(left, right, "t", "at", ["v"], strict=True).collect()} == {1: None, 2: "a", 3: None}


def test_as_of_without_keys(spark, monkeypatch):
    rng = random.Random(4)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(400))
    left = [(i, day()) for i in range(300)] + [(300, None)]
    right = [(d, i) for i, d in enumerate(sorted({day() for _ in range(120)}))]
    l = spark.createDataFrame(left, "i int, at date")
    r = spark.createDataFrame([*right, (None, 999)], "since date, n int")
    for bins in (1, 7, 200):
        monkeypatch.setattr(features, "BINS", bins)
        for strict in (False, True):
            got = {x.i: x.n for x in features.as_of(l, r, "at", "since", ["n"], strict=strict).collect()}
            ok = lambda since, at: since < at or (since == at and not strict)  # noqa: B023, E731
            assert got == {i: None if at is None else max((n for since, n in right if ok(since, at)), default=None) for i, at in left}
    assert features.as_of(l.limit(0), r, "at", "since", ["n"]).count() == 0
    assert features.as_of(l, r.limit(0), "at", "since", ["n"]).where("n IS NULL").count() == 301


def spark_hash(*values):
    """Spark's xxhash64 of values; nulls leave the hash as it is."""
    xxhash, h = pytest.importorskip("xxhash"), 42
    for v in values:
        if isinstance(v, dt.date):
            v = np.int32((v - dt.date(1970, 1, 1)).days)
        if v is not None:
            data = v.encode() if isinstance(v, str) else np.array(v).tobytes()
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) * (h >> 63)


def test_data_hash_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/orders.parquet").selectExpr("o_orderkey", "o_totalprice", "CAST(o_orderdate AS DATE) AS at").collect()
    key = np.int64 if spark.read.parquet(f"{small}/orders.parquet").schema["o_orderkey"].dataType.simpleString() == "bigint" else np.int32
    hashes = [spark_hash(r.at, key(r.o_orderkey), np.float64(r.o_totalprice)) for r in rows]
    got = catalog.QUERIES["train_hash"](spark, small).first()
    assert (got.n_rows, got.hash, int(got.checksum)) == (len(rows), functools.reduce(int.__xor__, hashes), sum(hashes))


def test_bootstrap_against_brute_force(spark):
    rows = [(i, int(i % 7 > 1)) for i in range(400)]
    got = evaluate.bootstrap(spark.createDataFrame(rows, "k long, ok int"), "k", "ok").first()
    edges, means = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340), []
    for b in range(100):
        w = [sum(spark_hash(np.int64(k), np.int32(b)) % (1 << 20) / (1 << 20) >= e for e in edges) for k, _ in rows]
        means.append(sum(x * ok for x, (_, ok) in zip(w, rows)) / sum(w))
    assert np.allclose((got.low, got.high), np.percentile(means, [2.5, 97.5]), atol=1e-12)
    assert got.low < sum(ok for _, ok in rows) / len(rows) < got.high


def test_logistic_against_newton(spark, small):
    """The query's coefficients against Newton's method on series that DuckDB makes."""
    q = duckdb.sql(f"""SELECT date_trunc('quarter', CAST(o_orderdate AS DATE)) AS q, avg(o_totalprice) AS close, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0 END) AS urgent
        FROM '{small}/orders.parquet' GROUP BY 1 ORDER BY 1""").fetchall()
    rows = [((q[i - 1][2], q[i - 2][2]), float(q[i + 1][1] > q[i][1]), q[i][0].year + 22) for i in range(2, len(q) - 1)]
    x, y, year = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    train, check = year <= 2019, (year > 2019) & (year <= 2021)
    x = (x - x[train].mean(0)) / x[train].std(0, ddof=1)
    x = np.column_stack([x, np.ones(len(x))])
    best = None
    for strength in (0.01, 0.1, 1.0):
        w, penalty = np.zeros(3), np.diag([strength, strength, 0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x[train] @ w))
            gradient = x[train].T @ (p - y[train]) / train.sum() + penalty @ w
            w -= np.linalg.solve((x[train].T * (p * (1 - p))) @ x[train] / train.sum() + penalty, gradient)
        hits = ((x[check] @ w > 0) == y[check]).mean()
        if best is None or hits > best[0]:
            best = hits, w
    got = {r.feature: r.coefficient for r in catalog.QUERIES["model_lr"](spark, small).collect()}
    assert np.allclose([got["urgent_lag1"], got["urgent_lag2"]], best[1][:2], atol=2e-4)


def test_permutation_importance(spark):
    rng = random.Random(2)
    rows = [(i, float(x), rng.random(), x, "train" if i < 200 else "validation") for i, x in enumerate(rng.randrange(2) for _ in range(300))]
    data = spark.createDataFrame(rows, "quarter_start int, x double, noise double, label int, split string")
    fitted, scaled = model.logistic(data, ["x", "noise"])
    (first, lost), (second, nothing) = model.permutation_importance(fitted, scaled, ["x", "noise"])
    assert (first, second) == ("x", "noise") and 0.35 < lost < 0.65 and abs(nothing) < 0.02
    numbers = [r["__i"] for r in model._numbered(scaled, "quarter_start", "own").orderBy("quarter_start").collect()]
    assert sorted(numbers) == list(range(1, 301)) and numbers != sorted(numbers)
    assert model.permutation_importance(fitted, scaled.limit(0), ["x", "noise"]) == []


def test_labels_and_splits(spark):
    s = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0)], "q int, close double")
    assert [r.label for r in features.next_period_label(s, "q", "close").orderBy("q").collect()] == [1, 0, None]
    years = spark.createDataFrame([(2019,), (2020,), (2022,)], "y int").select(features.chronological_split(F.col("y")).alias("s"))
    assert [r.s for r in years.collect()] == ["train", "validation", "test"]


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0)], "y int, p int")
    assert evaluate.precision(df, F.col("p") == 1, F.col("y") == 1).first().precision is None
    assert evaluate.classification(df, "y", "p").first().accuracy == 1.0


def test_graph_edges_have_provenance(spark):
    s = spark.createDataFrame([(1, "s1", "The data breach was found."), (1, "s2", "Nothing."), (2, "s3", "A databreach.")], "doc_id int, sentence_id string, sentence string")
    lex = spark.createDataFrame([("e", "Risk Topic", "Data Breach")], "entity_id string, entity_type string, alias string")
    got = graph.edges(graph.mentions(s, lex), "DISCLOSES", F.lit("u"), F.lit("2024-01-01").cast("timestamp")).collect()
    assert len(got) == 1 and got[0].provenance.sentence_id == "s1" and got[0].provenance.evidence_text.startswith("The")


def test_model(spark, tmp_path):
    rows = [(i, float(i % 2), i % 2, "train" if i < 40 else "validation" if i < 50 else "test") for i in range(60)]
    data = spark.createDataFrame(rows, "quarter_start int, x double, label int, split string")
    fitted, scaled = model.logistic(data, ["x"])
    assert model.coefficients(fitted, ["x"])[0][1] > 0
    assert "accuracy | 1.0" in model.report(model.predictions(fitted, scaled))
    assert model.permutation_importance(fitted, scaled, ["x"])[0][1] >= 0
    model.save(fitted, str(tmp_path / "m"), ["x"], 1)
    assert spark.read.text(str(tmp_path / "m/metadata")).count() == 1
    assert model.forest(data, ["x"])[0].getNumTrees == 20


def test_manifest_and_sentences(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<title>T</title><p>One. Two.</p>")
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF")
    raw = documents.raw_documents(documents.raw_files(spark, str(tmp_path / "in")))
    assert {(r.mime, r.title) for r in raw.collect()} == {("text/html", "T"), ("application/pdf", None)}
    documents.write_manifest(raw, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 2
    docs = spark.createDataFrame([(1, "One. Two!")], "doc_id int, text string")
    documents.write_sentences(docs, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    pdf = documents.pdf_text(documents.raw_files(spark, str(tmp_path / "in")).where("path LIKE '%pdf'"), lambda c: (c.decode(), 1, None))
    assert pdf.first().text == "%PDF"


def test_config(tmp_path):
    s = config.Settings.read(env={"DOCLOOM_START_YEAR": "2017"})
    assert s["ingestion.start_year"] == 2017 and s["modeling.random_seed"] == 42
    assert config.lookup({"a": {"b": None}}, "a.b", 1) == 1 and config.lookup({"a": 3}, "a.b", 2) == 2
    assert config.cast("Yes", bool) is True and config.load(tmp_path / "none") == {}
    with pytest.raises(ValueError):
        config.Settings.read(env={"DOCLOOM_MAX_RETRIES": ""})
    assert all(f.is_dir() for f in config.ensure_folders(tmp_path))


def test_pipeline(spark, tmp_path):
    out = str(tmp_path)
    counts = {name: pipeline.run(spark, name, "/root/testdata/sf0.001", out).count() for name in pipeline.STAGES}
    assert counts["ingest"] > 0 and counts["train"] == counts["signals"] > 0


def test_streams_within_watermark(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    got = jobs.run_to_parquet(jobs.first_seen_within(jobs.events(spark, path), "user_id", "ts", "1 hour").select("user_id"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert got.count() == spark.read.parquet(path).select("user_id").distinct().count()


def test_spine_and_variation(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 5),), (dt.date(2020, 12, 5),)], "d date")
    assert signals.missing_quarters(df, "d").count() == 2


def test_cache_with_time_to_live(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = str(tmp_path / "in")
    spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "host string, body string").coalesce(1).write.parquet(path)
    out = jobs.run_to_table(jobs.cached(spark.readStream.schema("host string, body string").parquet(path)), "cache", "append", str(tmp_path / "cp"))
    assert sorted((r.host, r.hit) for r in out.collect()) == [("a", False), ("a", True), ("b", False)]


def test_pivot_has_all_years_of_the_table(spark, small, tmp_path):
    from docloom.plans import series

    orders = spark.read.parquet(f"{small}/orders.parquet")
    orders.withColumn("o_orderdate", (F.col("o_orderdate") + F.expr("INTERVAL 5 YEARS")).cast(orders.schema["o_orderdate"].dataType)).write.parquet(f"{tmp_path}/orders.parquet")
    rows = series.term_year_pivot(spark, str(tmp_path)).collect()
    assert sum(v for r in rows for k, v in r.asDict().items() if k.startswith("y")) == orders.count()


class Site(http.server.BaseHTTPRequestHandler):
    """Pages with the headers that were sent, a robots file, and a redirect to it."""

    def do_GET(self):
        if self.path == "/gone/robots.txt":
            return self.send_error(404)
        if self.path == "/moved/robots.txt":
            self.send_response(302)
            self.send_header("Location", "/robots.txt")
            return self.end_headers()
        body = b"User-agent: *\nDisallow: /b\nCrawl-delay: 2\n" if self.path == "/robots.txt" else json.dumps(dict(self.headers)).encode()
        body = gzip.compress(body)
        self.send_response(200)
        self.send_header("Content-Type", "text/html")
        self.send_header("Content-Encoding", "gzip")
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def site():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"127.0.0.1:{server.server_port}"
    server.shutdown()


def test_robots_files_and_session(spark, site):
    hosts = spark.createDataFrame([(site,), (f"{site}/moved",), (f"{site}/gone",), ("127.0.0.1:9",), (None,), (site,)], "host string")
    files = fetch.robots_files(hosts, scheme="http").cache()
    got = {r.host: (r.status, r.body.startswith("User-agent")) for r in files.collect()}
    assert got == {site: (200, True), f"{site}/moved": (200, True), f"{site}/gone": (404, False), "127.0.0.1:9": (None, False)}
    urls = spark.createDataFrame([(f"http://{site}/{p}",) for p in "abc"], "url string")
    plan = crawl.plan(urls, spark.createDataFrame([(site, 4.0)], "domain string, requests_per_second double"), crawl.parse_robots(files), files.select("host", "status"))
    assert {r.url[-1]: (r.allowed, r.rate) for r in plan.collect()} == {"a": (True, 0.5), "b": (False, 0.5), "c": (True, 0.5)}
    began = time.time()
    done = {r.url[-1]: r for r in fetch.session(plan, headers=fetch.session_headers("loom/2", "me@example.org"), retries=0).collect()}
    assert set(done) == {"a", "c"} and all(r.status == 200 and r.mime == "text/html" for r in done.values())
    sent = json.loads(done["a"].body)
    assert sent["User-Agent"] == "loom/2" and sent["From"] == "me@example.org" and "gzip" in sent["Accept-Encoding"]
    assert time.time() - began >= 2  # two requests at one in two seconds


def test_headers():
    assert fetch.merged({"Accept": "a", "X": "1"}, {"accept": "b"}) == {"accept": "b", "X": "1"}
    assert "From" not in fetch.robots_headers() and fetch.filing_headers("a/1", "m@x")["User-Agent"] == "a/1 (m@x)"


def test_retry_calls_back():
    seen = []
    assert fetch.with_retry(lambda: 1 / 0, 2, on_retry=lambda k, e: seen.append((k, type(e))), wait=lambda s: None).attempts == 3
    assert seen == [(0, ZeroDivisionError), (1, ZeroDivisionError)]


def test_public_names():
    import docloom

    assert len(docloom.__all__) > 40 and all(callable(getattr(docloom, n)) or n.isupper() for n in docloom.__all__)
    with pytest.raises(AttributeError):
        docloom.nothing


def test_command_line(spark, tmp_path, small):
    page = spark.read.parquet(f"{small}/pages.parquet").orderBy("page_id").first().url
    for name, header in seeds.HEADERS.items():
        row = ",".join(page if c == "url" else "2020" if c == "fiscal_year" else "" for c in header.split(","))
        (tmp_path / f"{name}.csv").write_text(header + "\n" + row + "\n")
    pipeline.main(["ingest", small, str(tmp_path / "out"), "--seeds", str(tmp_path), "--since", "2019", "--limit", "3"])
    assert spark.read.parquet(str(tmp_path / "out/queue")).count() == 3
    assert [r.url for r in spark.read.parquet(str(tmp_path / "out/ingest")).collect()] == [page]


def test_long_and_short_lexicons_agree(spark, monkeypatch):
    s = spark.createDataFrame([(1, "a", "The DATA breach, the bias."), (1, "b", None), (2, "c", "biased data"), (2, "d", "")], "doc_id int, sentence_id string, sentence string")
    lex = spark.createDataFrame([("e", "T", "data breach"), ("f", "T", "bias"), ("g", "U", "Data  Breach!"), ("h", "U", " ")], "entity_id string, entity_type string, alias string")
    names = ["doc_id", "sentence_id", "sentence", "entity_id", "entity_type", "gram"]
    short = sorted(map(tuple, graph.mentions(s, lex).select(names).collect()))
    monkeypatch.setattr(graph, "FEW_ALIASES", 1)
    assert short == sorted(map(tuple, graph.mentions(s, lex).select(names).collect())) and len(short) == 3
    assert graph.mentions(s, lex.limit(0)).count() == 0


def test_cache_forgets(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("a", "x", 0), ("a", "y", 59), ("a", "z", 60), ("b", "u", 10), ("a", "w", 119)]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "host string, body string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("host string, body string, s int, ts timestamp").parquet(path)
    out = jobs.run_to_parquet(jobs.cached(stream, 60, "ts"), str(tmp_path / "o"), str(tmp_path / "c")).collect()
    assert sorted((r.host, r.at_us // 1_000_000 - 1_000_000, r.body, r.hit) for r in out) == [("a", 0, "x", False), ("a", 59, "x", True), ("a", 60, "z", False), ("a", 119, "z", True), ("b", 10, "u", False)]


def test_small_helpers(spark):
    one = spark.range(1)
    assert 0.9 <= one.select(crawl.with_jitter(F.lit(1.0))).first()[0] <= 1.1 and one.select(crawl.min_delay(F.lit(0.25))).first()[0] == 4.0
    assert features.one_hot(spark.createDataFrame([("x",), ("y",)], "k string"), "k", ["x"]).orderBy("k").select("k_x").collect()[0][0] == 1
    assert one.select(documents.storage_name(F.lit(b"a"), F.lit("application/pdf"))).first()[0].endswith(".pdf")
    assert dedup.arrival(spark.createDataFrame([("a", 2), ("a", 1)], "k string, t int"), "k", "t").count() > 0
    with pytest.raises(Exception, match="labelled twice"):
        features.with_labels(spark.createDataFrame([("q",)], "quarter_id string"), spark.createDataFrame([("q", 1), ("q", 0)], "quarter_id string, label int")).collect()


def test_auc_with_many_scores(spark):
    rows = [(i * 7919 % 1000 / 10, int(i * 31 % 97 > 40)) for i in range(3000)]
    want = sum((a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y) / (sum(x for _, x in rows) * sum(1 - x for _, x in rows))
    df = spark.createDataFrame(rows, "s double, y int")
    assert abs(evaluate.auc(df, "s", "y", 7).first()[0] - want) < 1e-12
    assert evaluate.auc(df.limit(0), "s", "y").first()[0] is None


def test_yaml_settings_and_logger(tmp_path, capsys):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("ingestion:\n  start_year: 2011\nlogging:\n  level: debug\n")
    s = config.Settings.read(tmp_path / "c.yaml", env={})
    assert s["ingestion.start_year"] == 2011
    log = config.logger("docloom.test", s)
    log.debug("hello")
    assert "| DEBUG    | docloom.test | hello" in capsys.readouterr().err and config.logger("docloom.test", s).handlers[1:] == []
