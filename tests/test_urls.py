import random
import string

from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.functions import sql
from docloom.functions import urls as U

CASES = {
    "HTTP://EXAMPLE.COM/Path": "http://example.com/Path",
    "http://example.com:80/path": "http://example.com/path",
    "https://example.com:443/path": "https://example.com/path",
    "http://example.com/path/": "http://example.com/path",
    "http://example.com/": "http://example.com/",
    "http://example.com/page?utm_source=google&utm_medium=cpc&id=123": "http://example.com/page?id=123",
    "": "",
    " ": "/",
    None: "",
    "http://x?b=2&a=1&b=1": "http://x/?a=1&b=2&b=1",
    "http://x/?foo&bar=": "http://x/?bar=&foo=",
    "http://x/?t=DEF%2014A&s=a*b~c%2Fd": "http://x/?s=a%2Ab~c%2Fd&t=DEF+14A",
    "http://x/?a=1;b=2": "http://x/?a=1%3Bb%3D2",
    "http://x/?trkInfo=1&trk=2": "http://x/?trkInfo=1",
    "http://x/a;p=1?q=1": "http://x/a?q=1",
    "http://x/a///": "http://x/a",
    "http://x//": "http://x/",
    "https://x:80/p": "https://x:80/p",
    "not-a-url": "not-a-url",
    "http://U:P@X.com:80/": "http://u:p@x.com/",
    "http://x/?utm%5Fsource=1&q=%zz": "http://x/?q=%25zz",
    "http://x/x;p/": "http://x/x;p",
    "http://x/a\tb\n": "http://x/ab",
    "http://[bad/p": None,
}


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, u string")
    return [r[1] for r in sorted(df.select("i", fn("u")).collect())]


def test_canonical_cases(spark):
    assert run(spark, U.normalize_url, CASES) == list(CASES.values())


def test_against_the_parser(spark):
    rng = random.Random(5)
    chars = "ab%2B+&=;/?#:@. é~*" + string.ascii_uppercase[:3]
    heads = ["http://", "https://", "HTTP://", "ftp://", "", "//", "mailto:", "http:", " http://"]
    values = [rng.choice(heads) + rng.choice(["h", "H.com:80", "h:443", ""]) + "".join(rng.choice(chars) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    assert run(spark, U.normalize_url, values) == [sql.canonical(v) for v in values]


@settings(max_examples=5, deadline=None, phases=[Phase.generate])  # no shrinking: each try is a Spark job
@given(st.lists(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.text("xyz+1", max_size=3)), unique_by=lambda p: p[0], max_size=5), min_size=1, max_size=5), st.randoms())
def test_order_of_distinct_parameters_does_not_matter(spark, lists, rng):
    one = ["http://h/p?" + "&".join(f"{k}={v}" for k, v in ps) for ps in lists]
    two = ["http://h/p?" + "&".join(f"{k}={v}" for k, v in rng.sample(ps, len(ps))) for ps in lists]
    first = run(spark, U.normalize_url, one)
    assert first == run(spark, U.normalize_url, two)
    assert first == run(spark, U.normalize_url, first)


def test_blanks_around_a_url_go_first(spark):
    """So a bare blank in the last parameter is lost, and one in another is kept."""
    assert run(spark, U.normalize_url, ["http://h/p?b=&a= ", "http://h/p?a= &b="]) == ["http://h/p?a=&b=", "http://h/p?a=+&b="]


def test_other_functions(spark):
    assert run(spark, U.url_hash, ["http://example.com/page"]) == ["b2b930c1becd9bf7"]
    assert run(spark, U.extract_domain, ["HTTP://U:P@X.com:80/", "x", None]) == ["u:p@x.com:80", "", ""]
    assert run(spark, U.is_valid_url, ["http://example.com", "https://example.com/path?query=1", "", "not-a-url", "ftp://example.com", None, " http://x", "http://[bad/p"]) == [True, True, False, False, False, False, True, False]
    assert run(spark, U.convert_to_https, ["http://x/p?q#f", "https://x/", "HTTP://x", "http://x/?"]) == ["https://x/p?q#f", "https://x/", "https://x", "https://x/"]
    assert run(spark, U.accession_number, ["http://h/0001327811-24-000012/a.htm", "http://h/"]) == ["0001327811-24-000012", None]
    df = spark.createDataFrame([("http://x/p?utm_source=x", "http://x/p?utm_medium=y"), ("http://x/p", "https://x/p"), ("http://x/1", "http://x/2")], "a string, b string")
    assert [r[0] for r in df.select(U.is_same_document("a", "b")).collect()] == [True, False, False]
    assert spark.range(1).select(U.normalize_url(F.lit("http://x/p#f"), True)).first()[0] == "http://x/p#f"
    assert run(spark, U.robots_url, ["https://h:8/p?q"]) == ["https://h:8/robots.txt"]


def test_no_python_in_the_plan(spark):
    plan = spark.range(1).select(U.normalize_url(F.col("id").cast("string")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "UDF" not in plan


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT url_domain('http://A.b/c'), accession_number('x0001327811-24-000012'), backoff_seconds(3), normalize_url('http://A/?b=1&a=2'), quarter_start(TIMESTAMP '2024-05-02 00:00:00')").first()
    assert list(row)[:4] == ["a.b", "0001327811-24-000012", 8.0, "http://a/?a=2&b=1"] and str(row[4]) == "2024-04-01"
    assert spark.sql("SELECT s.* FROM (SELECT 'A b. C!' AS t), LATERAL split_sentences(t) s").count() == 2
