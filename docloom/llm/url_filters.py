"""URL filters by a Bloom filter cascade (native: DataFrame expressions only).

A rule is a host and a path prefix, written as one key such as ``example.com/en/7``.  A URL's candidate keys are its
host and all parent domains, each joined to the prefixes of its path that have the length of some listed path.

The candidate keys of the whole corpus are the key universe.  Level 1 of the cascade is a Bloom filter of the listed
keys, level 2 one of the universe's keys that level 1 admits wrongly, level 3 one of the listed keys that level 2
admits, and so on until nothing is admitted wrongly.  The first level that rejects a key tells whether it is listed:
exact for every key of the universe, with no join when URLs are judged.  Level 1 is sized so that about as many
keys of the universe as there are listed ones pass, so the levels together need a few bits for each listed key and
each doubling of the universe.  The bits of a level stand in the plan once, as a constant of bytes.  A list whose first
level would need more than about ``MAX_BITS`` is dealt by the hash of its keys to parts with a cascade each; URLs are
judged part by part, each time only for their keys of that part, and the best rule so far is kept in the shared folder.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; the longest fitting
rule wins, of equally long ones that with the longer host, then the blocking one; repeated rows are judged one by
one; an empty table or list is fine; input columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of one level that may stand in a plan, 2.4 MB as bytes of seven bits.
MAX_BITS = 1 << 24
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUT = ("host", "path", "rule", "verdict")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if there are none."""
    at = F.locate("://", url) if isinstance(url, str) else F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """The keys under which a list could hold this URL."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(fits, lambda n: F.concat(h, F.substr(path, F.lit(1), n)))))
    return F.when((host != "") & F.lit(bool(lengths)), keys).otherwise(F.array().cast("array<string>"))


def _bits(n: int, rate: float) -> int:
    """Bits of a filter of ``n`` keys that admits a share ``rate`` of others: whole words of 56."""
    return -(-max(56, math.ceil(n * math.log2(1 / rate) * 1.4427)) // 56) * 56


class Bloom:
    """Bits of one level; ``data`` has seven in each byte, so that a byte is a character."""

    def __init__(self, keys: DataFrame, n: int, rate: float, level: int, bounded: bool = True):
        self.bits, self.hashes, self.level = _bits(n, rate), max(1, round(math.log2(1 / rate))), level
        if bounded and self.bits > MAX_BITS:
            raise OverflowError(f"the list needs {self.bits} bits, more than {MAX_BITS}")
        at = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at"))
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 56).cast("int"))
        words = at.groupBy(F.floor(F.col("at") / 56).cast("int").alias("word")).agg(F.bit_or(one).alias("bits"))
        self.data = bytearray(self.bits // 7)
        for word, bits in words.collect():  # at most bits / 56 rows
            self.data[8 * word : 8 * word + 8] = bytes(bits >> 7 * k & 127 for k in range(8))

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.level), F.lit(j)), F.lit(self.bits)) for j in range(self.hashes)]

    def admits(self, key: Column) -> Column:
        def tests(data: Column) -> Column:
            byte = lambda p: F.ascii(F.substr(data, F.floor(p / 7).cast("int") + 1, F.lit(1)).cast("string"))
            return reduce(lambda a, b: a & b, [F.getbit(byte(p), (p % 7).cast("int")) == 1 for p in self.places(key)])

        return common.let(F.lit(bytes(self.data)), tests)


def first_rate(n: int, n_universe: int) -> float:
    """Share of the universe that level 1 may admit wrongly, so that these keys are about as many as the listed ones."""
    return min(0.5, n * 0.7 / max(1, n_universe))


class Cascade:
    """Exact membership of the universe's keys in a list."""

    def __init__(self, listed: DataFrame, universe: DataFrame, n_universe: int):
        listed = common.checkpointed(listed.select("key").distinct())
        n = listed.count()
        self.levels: list[Bloom] = []
        if not n:
            return
        first = Bloom(listed, n, first_rate(n, n_universe), 1, bounded=False)
        # Wrongly admitted: seen in the universe, never in the list.  Few keys pass the filter, so little is shuffled.
        passed = universe.where(first.admits(F.col("key"))).select("key", F.lit(0).alias("on"))
        both = passed.unionByName(listed.select("key", F.lit(1).alias("on")))
        wrong = common.checkpointed(both.groupBy("key").agg(F.max("on").alias("on")).where("on = 0").select("key"))
        self.levels, here, there = [first], listed, wrong
        while n_wrong := there.count():
            level = Bloom(there, n_wrong, 0.5, len(self.levels) + 1, bounded=False)
            self.levels.append(level)
            here, there = there, common.checkpointed(here.where(level.admits(F.col("key"))))

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        found = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            found = F.when(~self.levels[i].admits(key), F.lit(i % 2 == 1)).otherwise(found)
        return found


def _prepared(pages: DataFrame, url: str) -> DataFrame:
    host, path = parts(F.col(url))
    return pages.drop(*(c for c in OUT if c != url)).withColumns({"__host": host, "__path": path})


def _keyed(df: DataFrame, lengths: list[int]) -> DataFrame:
    return df.withColumn("__keys", common.barrier(common.let(F.struct("__host", "__path"), lambda x: candidates(x["__host"], x["__path"], lengths))))


def _lengths(rules: DataFrame) -> list[int]:
    """Distinct lengths of the listed paths; a URL path has a few thousand characters at most."""
    path = F.regexp_extract("key", r"^[^/]*(.*)$", 1)
    return sorted(r[0] for r in rules.select(F.length(path)).distinct().collect())


def _part(key: Column, n_parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(n_parts))


def _ranked(key: Column, blocks: Column) -> Column:
    """A fitting key, in the order of precedence: the longest, then that with the longest host."""
    return F.struct(F.length(key).alias("n"), F.length(F.regexp_extract(key, "^[^/]*", 0)).alias("h"), key.alias("key"), blocks.alias("blocks"))


def _verdict(df: DataFrame, pages: DataFrame, blocked: Column, default: str) -> DataFrame:
    verdict = F.when(F.col("__rule").isNull(), F.lit(default)).when(blocked, F.lit("block")).otherwise(F.lit("allow"))
    keep = [c for c in pages.columns if c not in OUT]
    return df.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict``.  ``rules`` has ``key`` and ``action`` (block or allow).

    Three reads of the URL column: the size of the universe, its wrongly admitted keys, the verdicts.
    """
    lengths = _lengths(rules)
    df = _prepared(pages, url)
    n = _keyed(df, lengths).select(F.explode("__keys").alias("key")).agg(F.approx_count_distinct("key")).first()[0]
    listed = common.checkpointed(rules.where(F.col("action").isin("block", "allow")).select("key", "action").distinct())
    sizes = [r["count"] for r in listed.groupBy("action").count().collect()]  # two rows at most
    n_parts = max([1, *(math.ceil(_bits(m, first_rate(m, n)) / max(56, MAX_BITS)) for m in sizes)])
    best = None
    for k in range(n_parts):
        here = _keyed(df, lengths)
        if n_parts > 1:
            here = here.withColumn("__keys", common.barrier(F.filter("__keys", lambda key: _part(key, n_parts) == k)))
        universe = here.select(F.explode("__keys").alias("key"))
        block, allow = (Cascade(listed.where((F.col("action") == action) & (_part(F.col("key"), n_parts) == k)), universe, n // n_parts) for action in ("block", "allow"))
        tested = F.transform("__keys", lambda x: F.struct(x.alias("key"), block.holds(x).alias("blocks"), allow.holds(x).alias("allows")))
        fits = F.filter(tested, lambda x: x["blocks"] | x["allows"])
        top = F.array_max(F.transform(fits, lambda x: _ranked(x["key"], x["blocks"])))
        df = here.withColumn("__best", common.barrier(top if best is None else F.greatest("__best", top))).drop("__keys")
        best = "__best"
        if k < n_parts - 1:
            df = common.written(df)
    return _verdict(df.withColumn("__rule", F.col("__best.key")), pages, F.col("__best.blocks"), default)


def judge_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same verdicts by a shuffled join of the distinct pairs of host and path with the list.  :func:`judge` never uses it; it checks."""
    df = _keyed(_prepared(pages, url), _lengths(rules))
    listed = rules.groupBy("key").agg(F.max(F.col("action") == "block").alias("blocks"))
    fits = df.select("__host", "__path", F.explode("__keys").alias("key")).distinct().join(listed, "key")
    best = fits.groupBy("__host", "__path").agg(F.max(_ranked(F.col("key"), F.col("blocks"))).alias("__best"))
    df = df.join(best, ["__host", "__path"], "left").withColumn("__rule", F.col("__best.key"))
    return _verdict(df, pages, F.col("__best.blocks"), default)


#: The rules of the query, as (action, key).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against ``RULES``; a URL that fits no rule is in no list and so allowed."""
    rules = spark.createDataFrame([(key, action) for action, key in RULES], "key string, action string")
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP10_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(action, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'),
                                   ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(action, length(rhost || rpath)) AS action
         FROM h JOIN r ON starts_with(path, rpath) AND (host = rhost OR ends_with(host, '.' || rhost)) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM h LEFT JOIN best USING (page_id)
"""
