"""Secret scans (native: DataFrame expressions only).

Three fixed patterns give the base spans: assignments to a name like ``token``, access keys, long hex strings.  The
method adds spans: every other run of 20 or more key characters that holds a letter and a digit is scored by two
first-order Markov models over characters, one of random strings and one of ordinary identifiers.  Where the mean log-likelihood
ratio for each transition exceeds ``LEAST_RATIO``, the run looks random and becomes a ``markov`` span.

A slash may belong to a key in base 64 or separate the names of a path, so runs that hold slashes are also judged in whole.
Where the whole does not look random, a key may still follow a path.  Pieces are then taken from left to right: a stretch
begins with a piece of positive excess, the sum of what each transition has above ``STRETCH_RATIO``, and goes on as long as
the excess of the stretch stays positive.  Stretches of 20 or more characters that hold a letter and a digit become spans.

Both models are trained from labelled samples: strings with the label 1 (random) or 0 (ordinary).  The built-in sample
is made by rule, digests of counters in four alphabets against joined words and paths; a table of the user's may take its place.
Training counts transitions with one small aggregation, at most 64 x 64 x 2 rows, and the ratios go into the plan as one constant.

Offsets come from the pieces between the matches of a pattern, whose lengths add up.  Matches are leftmost and do not
overlap within a kind.  A method span is dropped where it touches a base span, a span with slashes where fewer than 20 of its
characters lie outside base spans.

Defined results: a null text is empty; repeated rows are scanned one by one; an empty table gives no rows; an empty
sample gives equal models and no method spans; input columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fixed patterns of the base kinds.  Runs are matched from their least length where that finds the same spans.
ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Runs that the method judges: those between slashes, and those with slashes.
RUN = r"[A-Za-z0-9+_=-]{20,}"
SLASHED = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_RUN = 20
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+_=-/"
SIZE = len(ALPHABET)
LEAST_RATIO = 0.25
#: More is asked of a part of a run, since the best of many parts is taken.
STRETCH_RATIO = 0.5
SPAN = "array<struct<start:int,kind:int,stop:int>>"

#: Words from which the built-in sample joins ordinary identifiers.
WORDS = (
    "user account name value index count total number string buffer length offset handler request response server client session cookie header "
    "content message event listener callback function method object class instance factory builder manager service provider controller model view "
    "template render update delete insert select create remove append filter reduce transform parse format encode decode convert validate check "
    "test example default config option setting parameter argument result error exception warning debug information level output input stream file path "
    "directory folder document page section chapter table column row field record database query index cache memory storage network socket address port "
    "thread process worker queue task job schedule timer date time year month day hour minute second version release build package module library"
).split()


def sample(spark: SparkSession, n: int = 3000) -> DataFrame:
    """``text`` and ``label``: ``n`` random strings in base 64 (both alphabets), hex and upper case, ``n`` joined identifiers and ``n`` paths."""
    words = F.array(*map(F.lit, WORDS))
    rows = spark.range(0, n, 1, 4)
    word = lambda k: F.get(words, F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))).cast("int"))
    tail = F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64("id", F.lit("n")), F.lit(10000)).cast("string")).otherwise(F.lit(""))
    parts = [word(k) for k in range(5)]
    style = F.col("id") % 4
    joined = F.when(style == 0, F.concat_ws("_", *parts)).when(style == 1, F.concat_ws("-", *parts)).when(style == 2, F.concat(parts[0], *(F.initcap(p) for p in parts[1:]))).otherwise(F.upper(F.concat_ws("_", *parts)))
    seed = F.col("id").cast("string")
    digest = F.sha2(F.concat(F.lit("key"), seed), 256)
    base64 = F.base64(F.unhex(digest))
    base64 = F.when(F.col("id") % 2 == 0, base64).otherwise(F.translate(base64, "+/", "-_"))
    upper = F.upper(F.regexp_replace(F.base64(F.unhex(digest)), "[^A-Za-z0-9]", ""))
    random = F.when(F.col("id") % 3 == 0, base64).when(F.col("id") % 3 == 1, digest).otherwise(upper)
    number = lambda k, least, many: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(many)) + least).cast("string")
    date = F.concat_ws("/", number("y", 1990, 40), F.lpad(number("m", 1, 12), 2, "0"), F.lpad(number("d", 1, 28), 2, "0"))
    name = F.concat_ws("-", *parts[2:4])
    path = F.when(style == 0, F.concat_ws("/", *parts)).when(style == 1, F.concat_ws("/", parts[0], date, name)).when(style == 2, F.concat_ws("/", F.lit("/"), parts[0], F.concat(F.lit("v"), number("v", 1, 9)), parts[1], number("i", 1, 100000), name))
    path = path.otherwise(F.concat_ws("/", F.initcap(parts[0]), parts[1], F.concat_ws("_", *parts[2:4]), F.concat(parts[4], F.initcap(parts[3]))))
    labelled = lambda text, label: rows.select(text.alias("text"), F.lit(label).alias("label"))
    return labelled(F.concat(joined, tail), 0).unionByName(labelled(path, 0)).unionByName(labelled(random, 1))


def _codes(text: Column) -> Column:
    """Positions 0.. of the characters in ``ALPHABET``; -1 for any other."""
    return F.transform(F.split(text, "", -1), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(samples: DataFrame, text: str = "text", label: str = "label") -> list[float]:
    """Log-likelihood ratio of random against ordinary for each pair of characters, with add-one smoothing."""
    codes = samples.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("int").alias("y"), _codes(F.col(text)).alias("c"))
    pairs = codes.select("y", F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.size("c")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    counts = pairs.where("p.a >= 0 AND p.b >= 0").groupBy("y", "p.a", "p.b").count()
    grid = samples.sparkSession.range(SIZE * SIZE).select((F.col("id") / SIZE).cast("int").alias("a"), (F.col("id") % SIZE).cast("int").alias("b"))
    known = counts.groupBy("a", "b").agg(*(F.sum(F.when(F.col("y") == y, F.col("count"))).alias(f"n{y}") for y in (0, 1)))
    total = counts.groupBy("a").agg(*(F.sum(F.when(F.col("y") == y, F.col("count"))).alias(f"t{y}") for y in (0, 1)))
    p = lambda y: (F.coalesce(F.col(f"n{y}"), F.lit(0)) + 1) / (F.coalesce(F.col(f"t{y}"), F.lit(0)) + SIZE)
    rows = grid.join(known, ["a", "b"], "left").join(total, "a", "left").select("a", "b", (F.log(p(1)) - F.log(p(0))).alias("r")).collect()
    ratios = [0.0] * (SIZE * SIZE)
    for r in rows:  # SIZE * SIZE of them
        ratios[r["a"] * SIZE + r["b"]] = round(r["r"], 6)
    return ratios


def _total(c: Column, ratios: list[float]) -> Column:
    """Summed log-likelihood ratio of the transitions between two or more codes."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to a constant
    step = lambda c, i: F.get(table, F.get(c, i) * SIZE + F.get(c, i + 1))
    return F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda acc, i: acc + F.coalesce(step(c, i), F.lit(0.0)))


def ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of the transitions of a run."""
    return common.let(_codes(text), lambda c: _total(c, ratios) / (F.size(c) - 1))


def _mixed(run: Column) -> Column:
    return run.rlike("[0-9]") & run.rlike("[A-Za-z]")


def _stretches(run: Column, ratios: list[float]) -> Column:
    """Offsets (start, stop) of what looks random in a run with slashes."""
    none = F.array().cast("array<struct<start:int,stop:int>>")
    excess = lambda t: common.let(_codes(t), lambda c: F.when(F.size(c) > 1, _total(c, ratios) - STRETCH_RATIO * (F.size(c) - 1)).otherwise(F.lit(0.0)))

    def find(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.when((i > 1) & (F.get(pieces, i - 1) == ""), F.lit("/")).otherwise(F.coalesce(F.right(F.get(pieces, i - 1), F.lit(1)), F.lit("")))
            seam = F.concat(before, F.when(i > 0, F.lit("/")).otherwise(F.lit("")), F.left(p, F.lit(1)))
            return F.struct(F.length(p).alias("n"), excess(p).alias("own"), excess(seam).alias("seam"))

        def add(acc: Column, p: Column) -> Column:
            longer = acc["sum"] + p["seam"] + p["own"]
            goes_on = (acc["sum"] > 0) & (longer > 0)
            ended = (acc["sum"] > 0) & ~goes_on & (acc["stop"] - acc["start"] >= LEAST_RUN)
            return F.struct(
                F.when(ended, F.array_append(acc["all"], F.struct(acc["start"].alias("start"), acc["stop"].alias("stop")))).otherwise(acc["all"]).alias("all"),
                F.when(goes_on, acc["start"]).otherwise(acc["at"]).alias("start"), (acc["at"] + p["n"]).alias("stop"), (acc["at"] + p["n"] + 1).alias("at"),
                F.when(goes_on, longer).otherwise(p["own"]).alias("sum"),
            )

        zero = F.lit(0)
        start = F.struct(none.alias("all"), zero.alias("start"), zero.alias("stop"), zero.alias("at"), F.lit(0.0).alias("sum"))
        end = F.struct(F.lit(0).alias("n"), F.lit(float("-inf")).alias("own"), F.lit(0.0).alias("seam"))  # ends the last stretch
        return F.aggregate(F.concat(F.transform(pieces, one), F.array(end)), start, add, lambda acc: acc["all"])

    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(run).alias("stop")))
    parts = F.filter(common.let(F.split(run, "/", -1), find), lambda s: _mixed(F.substr(run, s["start"] + 1, s["stop"] - s["start"])))
    return F.when(~_mixed(run), none).when(ratio(run, ratios) > LEAST_RATIO, whole).otherwise(parts)


def _spans(text: Column, pattern: str, kind: int, good=None, parts=None) -> Column:
    """Ascending spans of a pattern's matches for which ``good`` holds, or of ``parts`` of them."""

    def place(x: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["p"], i))
            stop = start + F.length(F.get(x["m"], i))
            return F.struct(F.array_append(acc["all"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"))).alias("all"), stop.alias("at"))

        empty = F.struct(F.array().cast(SPAN).alias("all"), F.lit(0).alias("at"))
        every = F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), empty, add, lambda acc: acc["all"])
        if good is None:
            return every
        marked = F.zip_with(every, x["m"], lambda s, m: F.struct(s.alias("s"), m.alias("m")))
        kept = F.filter(marked, lambda z: good(z["m"]))
        if parts is None:
            return F.transform(kept, lambda z: z["s"])
        moved = lambda z, p: F.struct((z["s"]["start"] + p["start"]).alias("start"), F.lit(kind).alias("kind"), (z["s"]["start"] + p["stop"]).alias("stop"))
        return F.flatten(F.transform(kept, lambda z: F.transform(parts(z["m"]), lambda p: moved(z, p))))

    matches = common.let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), place)
    return F.when(text.rlike(pattern), matches).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: start, kind (position in ``KINDS``) and exclusive stop in code points, ascending."""
    df = docs.drop("spans").withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    t = F.col("__t")
    long_enough = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8
    mixed = lambda m: _mixed(m) & (ratio(m, ratios) > LEAST_RATIO)
    slashed = F.when(t.contains("/"), _spans(t, SLASHED, 3, lambda m: m.contains("/"), lambda m: _stretches(m, ratios))).otherwise(F.array().cast(SPAN))
    base = F.concat(_spans(t, ASSIGN, 0, long_enough), _spans(t, ACCESS, 1), _spans(t, HEX, 2))
    df = df.withColumns({"__b": common.barrier(base), "__m": common.barrier(_spans(t, RUN, 3, mixed)), "__w": common.barrier(slashed)})

    def covered(m: Column, b: Column) -> Column:
        """Characters of a span that lie in base spans, which may overlap."""

        def add(acc: Column, s: Column) -> Column:
            fresh = F.least(s["stop"], m["stop"]) - F.greatest(s["start"], m["start"], acc["at"])
            return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), (acc["n"] + F.greatest(fresh, F.lit(0))).alias("n"))

        return F.aggregate(F.sort_array(b), F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), add, lambda acc: acc["n"])

    touches = lambda m, all_spans: F.exists(all_spans, lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"]))
    wide = F.filter("__w", lambda m: m["stop"] - m["start"] - covered(m, F.col("__b")) >= LEAST_RUN)
    both = F.struct(F.col("__b").alias("b"), F.col("__m").alias("m"), wide.alias("w"))
    free = lambda x: F.filter(x["m"], lambda m: ~touches(m, x["b"]) & ~touches(m, x["w"]))
    spans = common.let(both, lambda x: F.sort_array(F.concat(x["b"], x["w"], free(x))))
    some = (F.size("__b") > 0) | (F.size("__m") > 0) | (F.size("__w") > 0)
    return df.withColumn("spans", F.when(some, spans).otherwise(F.array().cast(SPAN))).drop("__t", "__b", "__m", "__w")


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, ratios: list[float], text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; spans that overlap become one mark.  Columns stay as they are."""
    df = scan(docs.withColumnRenamed("spans", "__spans"), ratios, text)

    def cut(x: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            between = F.when(s["start"] >= acc["at"], F.concat(F.substr(x["t"], acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.concat(acc["out"], between).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
        return F.aggregate(x["s"], start, add, lambda acc: F.concat(acc["out"], F.substr(x["t"], acc["at"] + 1)))

    cleaned = common.let(F.struct(F.col(text).alias("t"), F.col("spans").alias("s")), cut)
    df = df.withColumn(text, F.when(F.size("spans") > 0, cleaned).otherwise(F.col(text))).drop("spans")
    return df.withColumnRenamed("__spans", "spans").select(*docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of every document."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), train(sample(spark)))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
