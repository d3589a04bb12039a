"""Near-duplicate groups by a chosen-path set similarity join.

1. Every document becomes the set of its distinct word shingles, of which a digest and ``TOKENS`` minwise tokens are
   kept.  Documents with equal sets form a class, represented by its smallest id (counted with map-side partial sums, so
   thousands of copies meet as one row for each task).
2. Chosen path: in each of several independent trees a class branches from the root into ``BRANCH`` children, each
   named by its path and by the minwise token at a position that the path selects.  Nodes above ``SMALL`` classes branch
   again, single ones end.  A pair of similarity s shares BRANCH * s children on average: with 0.85 and two branches it
   survives a tree of any depth with a chance of 0.969, with 0.8 of 0.9375.  All trees read the same tokens, so a pair with
   few equal ones is in danger in each of them; as many trees are grown as bring the share of missed pairs, expected over
   the number of equal tokens, down to ``MISS``: six and nine.
3. Small nodes are compared exhaustively by their tokens, with a margin that loses a quarter of ``MISS`` at most, and linked
   to candidate clusters.  Nodes that stay large to the last level are made of documents that agree in that many tokens, and
   become part of a cluster as they are.  So do dense ones, large nodes of which one child would keep most classes.
4. Links are confirmed on full sets, ``100 * intersection >= least * union``, inside clusters: pairs that are already
   connected are skipped, and only spanning links are emitted.  A cluster above ``BLOCK`` shingles is dealt to blocks that
   also get its pivots; then what did not join the largest component is compared with all blocks.  No link between
   different texts is lost inside a cluster, and no task holds more than two blocks.
5. Components come from spanning links: one task contracts up to a million, more go through alternating large-star and
   small-star rounds.  Every step is written to the shared checkpoint folder.

Only documents in clusters have their full sets computed again; a Bloom filter of at most 2 MB keeps the other
texts out of the shuffle.

Defined results: null, empty and blank texts have empty sets and are linked with nothing; fewer words than a shingle make
one shingle; repeated rows belong to one class; rows of a null id have no component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .url_filters import Bloom

TOKENS, BRANCH, DEPTH, SMALL, PIVOTS = 64, 2, 12, 256, 16
#: Shingles of one block of a large cluster.
BLOCK = 2_000_000
#: A large node is dense if one child would keep this part of it: branching does not tell its classes apart.
DENSE = 0.6
#: Links that one task joins at once, 16 bytes each; more go through distributed rounds.
FEW_LINKS = 1_000_000
#: Share of linked pairs that the trees may miss.
MISS = 1e-6
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MULTIPLY = np.random.default_rng(9).integers(1, 2**63, TOKENS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = 3) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a text, ascending."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], np.uint64)
    joined = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, joined), np.uint64, len(words) - size + 1))


def minwise(items: np.ndarray) -> np.ndarray:
    """``TOKENS`` minwise tokens of a set."""
    out = np.full(TOKENS, 2**32 - 1, np.uint32)
    mixed = items ^ (items >> np.uint64(29))
    with np.errstate(over="ignore"):
        for k in range(0, len(mixed), 4096):
            part = (mixed[k : k + 4096, None] * _MULTIPLY) >> np.uint64(32)
            out = np.minimum(out, part.min(0).astype(np.uint32))
    return out


def sketch(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """Id, set size, 128-bit digest of the set and its minwise tokens, for each row."""

    def make(batch, texts):
        sets = [shingles(t, size) for t in texts]
        return [[len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [minwise(s).tobytes() for s in sets]]

    df = common.appended(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")), "text", "n bigint, digest binary, tokens binary", make)
    return df.drop("text")


def _mix(x: np.ndarray) -> np.ndarray:
    """A strong mix of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _children(nodes: np.ndarray, tokens: np.ndarray, many: int = BRANCH) -> np.ndarray:
    """For nodes (rows) and the tokens of the classes in them, the first ``many`` child nodes of each."""
    out = []
    for k in range(many):
        chosen = _mix(nodes ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1)))
        at = (chosen % np.uint64(TOKENS)).astype(np.int64)
        out.append(_mix(chosen ^ _mix(at.astype(np.uint64) << np.uint64(32) | tokens[np.arange(len(tokens)), at])))
    return np.stack(out, 1)


def trees(least: int) -> int:
    """Trees for which, if they were independent, a pair of similarity ``least`` percent is missed with a chance of about ``MISS``."""
    s, lost = least / 100, 0.0
    for _ in range(1000):  # chance that a tree of any depth loses a pair: the fixed point of a branching process
        lost = (1 - s + s * lost) ** BRANCH
    return max(1, round(np.log(MISS) / np.log(max(lost, 1e-9))))


def _equal_tokens(least: int) -> np.ndarray:
    """Chances that a pair of similarity ``least`` percent has 0, 1, ... ``TOKENS`` equal tokens."""
    s = least / 100
    return np.array([comb(TOKENS, k) * s**k * (1 - s) ** (TOKENS - k) for k in range(TOKENS + 1)])


def margin(least: int) -> int:
    """Equal tokens that a candidate must have: fewer occur with a chance of ``MISS / 4`` at most."""
    return int(np.searchsorted(np.cumsum(_equal_tokens(least)), MISS / 4, "right"))


def missed(least: int, n_trees: int) -> float:
    """Chance that a pair of similarity ``least`` percent is missed by the margin or by all trees, which share their tokens."""
    chance, low = _equal_tokens(least), margin(least)
    s, lost = np.arange(TOKENS + 1) / TOKENS, np.zeros(TOKENS + 1)
    for _ in range(DEPTH):
        lost = (1 - s + s * lost) ** BRANCH
    return float(chance[:low].sum() + (chance[low:] * lost[low:] ** n_trees).sum())


def grown(least: int) -> int:
    """Trees that are grown: :func:`trees`, and more until ``missed`` is ``MISS`` at most; 1,000 end the search."""
    n = trees(least)
    while n < 1000 and missed(least, n) > MISS:
        n += 1
    return n


def _grow(df: DataFrame, roots: int) -> DataFrame:
    """Rows (node, rep, probe) of the next level; ``df`` has rep, tokens and, unless it is the roots' many, node.

    ``probe`` is the first child that the class would have in that node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            reps = np.asarray(batch.column("rep"))
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
            if roots:
                grown = [_children(np.full(len(reps), t + 1, np.uint64), tokens) for t in range(roots)]
            else:
                grown = [_children(np.asarray(batch.column("node")).view(np.uint64), tokens)]
            nodes = np.concatenate(grown, 1)
            probes = _children(nodes.ravel(), np.repeat(tokens, nodes.shape[1], 0), 1)
            columns = [nodes.ravel().view(np.int64), np.repeat(reps, nodes.shape[1]), probes.ravel().view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "rep", "probe"])

    return df.mapInArrow(run, "node bigint, rep bigint, probe bigint")


def _leaves(classes: DataFrame, n_trees: int) -> DataFrame:
    """Rows (node, rep, m) of the nodes in which classes are to be compared; m is the node's size."""
    leaves, level = None, _grow(classes.select("rep", "tokens"), n_trees)
    for depth in range(1, DEPTH + 1):
        sizes = level.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        kept = common.checkpointed(level.join(sizes, "node"))
        small = kept.where(F.col("m") <= SMALL).select("node", "rep", "m")
        leaves = small if leaves is None else leaves.unionByName(small)
        large = kept.where(F.col("m") > SMALL)
        if large.isEmpty():
            break
        keeps = large.groupBy("node", "m", "probe").count().groupBy("node", "m").agg(F.max("count").alias("most"))
        ends = F.col("most") >= DENSE * F.col("m") if depth < DEPTH else F.lit(True)
        large = common.checkpointed(large.select("node", "rep", "m").join(keeps.select("node", ends.alias("ends")), "node"))
        leaves = leaves.unionByName(large.where("ends").drop("ends"))
        level = _grow(large.where("NOT ends").select("node", "rep").join(classes.select("rep", "tokens"), "rep"), 0)
    return leaves


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        up = self.up
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        edges = np.flatnonzero(change).tolist()
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for e in edges:
            held.append(batch.slice(start, e - start))
            yield pa.Table.from_batches(held)
            held, start = [], e
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _by_group(df: DataFrame, keys: list[str], compare: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """Links (u, v) that ``compare`` finds in each group; groups are bounded and stream through sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for group in _grouped(batches, keys):
            found += compare(group)
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])
                found = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "u bigint, v bigint")


def _candidates(least: int) -> Callable[[pa.Table], list[tuple[int, int]]]:
    low = margin(least)

    def compare(group: pa.Table) -> list[tuple[int, int]]:
        reps = group.column("rep").to_pylist()
        if len(reps) < 2:
            return []
        n = group.column("n").to_numpy()
        tokens = np.frombuffer(b"".join(group.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
        forest, out = Forest(len(reps)), []
        for i in range(len(reps) - 1):
            alike = (tokens[i + 1 :] == tokens[i]).sum(1) >= low
            near = np.flatnonzero(alike & (100 * np.minimum(n[i + 1 :], n[i]) >= least * np.maximum(n[i + 1 :], n[i])))
            out += [(reps[i], reps[j]) for j in (near + i + 1).tolist() if forest.join(i, j)]
        return out

    return compare


def _confirmed(least: int) -> Callable[[pa.Table], list[tuple[int, int]]]:
    """Spanning links by exact comparison of full sets.  ``comp`` holds what is connected already; with ``side`` 1 present, only pairs of a 1 and a 0 are compared."""

    def compare(group: pa.Table) -> list[tuple[int, int]]:
        reps, comp, side = (group.column(c).to_pylist() for c in ("rep", "comp", "side"))
        m = len(reps)
        if m < 2:
            return []
        sets = [np.frombuffer(x, np.uint64) for x in group.column("items").to_pylist()]
        n = np.array([len(s) for s in sets])
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), n)
        order = np.argsort(token, kind="stable")
        posts = owner[order]
        starts = np.searchsorted(token[order], np.arange(token.max() + 2))
        ends = np.cumsum(n)
        out, first = [], {}
        label = np.array([i if c is None else first.setdefault(c, i) for i, c in enumerate(comp)])  # component of each set
        some = [i for i in range(m) if side[i]] or range(m)
        sides = np.array(side)
        two = bool(sides.any())
        for i in some:
            others = label != label[i]
            if two:
                others &= sides == 0
            if not others.any():
                continue
            mine = token[ends[i] - n[i] : ends[i]]
            a, b = starts[mine], starts[mine + 1]
            size = b - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            both = np.bincount(posts[at], minlength=m)
            for j in np.flatnonzero(others & (100 * both >= least * (n + n[i] - both))).tolist():
                if label[i] != label[j]:
                    label[label == label[j]] = label[i]
                    out.append((reps[i], reps[j]))
        return out

    return compare


def _stars(links: DataFrame) -> DataFrame:
    """Links of each partition, contracted to one star for each of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([np.asarray(b.column("u")), np.asarray(b.column("v"))], 1) for b in batches if b.num_rows]
        if held:
            nodes, place = np.unique(np.concatenate(held), return_inverse=True)
            forest = Forest(len(nodes))
            for a, b in place.reshape(-1, 2).tolist():
                forest.join(a, b)
            roots = np.array([forest.root(i) for i in range(len(nodes))])
            far = np.flatnonzero(roots != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[roots[far]])], ["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def components(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(u, v): for each node of the links but the smallest of a component, that smallest one.

    Up to ``few`` links, some 16 MB, are contracted by one task.  More go through alternating large-star and small-star
    rounds: minima are aggregated before the shuffle, and the joins back are plain equi-joins whose large keys adaptive
    execution can split.
    """
    links = common.checkpointed(links.select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("bigint").alias("v")))
    if links.count() <= few:
        return common.checkpointed(_stars(links.coalesce(1)))
    state = None
    e = common.checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = common.checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == state:
            return e
        state = now


def _members(links: DataFrame) -> DataFrame:
    """(rep, cluster) of every node of the links."""
    stars = components(links)
    return common.checkpointed(stars.select(F.col("u").alias("rep"), F.col("v").alias("cluster")).unionByName(stars.select(F.col("v").alias("rep"), F.col("v").alias("cluster")).distinct()))


def _sets(docs: DataFrame, members: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """``members`` with their full sets; a Bloom filter keeps texts of other documents out of the shuffle."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("rep"), F.col(text).alias("text"))
    n = members.count()
    if n:
        try:
            rows = rows.where(Bloom(members.select(F.col("rep").alias("key")), n, 0.02, 0).admits(F.col("rep")))
        except OverflowError:
            pass  # too many for the filter: the join alone selects them
    sets = common.appended(rows, "text", "items binary, digest binary", lambda batch, texts: [*zip(*(((s := shingles(t, size)).tobytes(), xxhash.xxh3_128_digest(s.tobytes())) for t in texts))])
    return sets.drop("text").join(members, ["rep", "digest"]).dropDuplicates(["rep", "digest"])


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, least: int = 85) -> DataFrame:
    """For each row of ``docs``: id, n_shingles and component_id, the smallest id that links reach (least: percent)."""
    rows = common.checkpointed(sketch(docs, doc_id, text, size))
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens"))
    classes = common.checkpointed(classes)
    compared = _leaves(classes, grown(least))
    small = compared.where(F.col("m") <= SMALL).select("node", "rep").join(classes.select("rep", "n", "tokens"), "rep")
    stars = compared.where(F.col("m") > SMALL)
    stars = stars.join(stars.groupBy("node").agg(F.min("rep").alias("low")), "node").select(F.col("rep").alias("u"), F.col("low").alias("v"))
    clusters = _members(_by_group(small, ["node"], _candidates(least)).unionByName(stars))

    members = common.checkpointed(clusters.join(classes.select("rep", "digest", "n"), "rep"))
    sizes = members.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    members = common.checkpointed(members.select("rep", "digest", "n", "cluster", "blocks", "block"))
    held = common.checkpointed(_sets(docs, members, doc_id, text, size))

    plain = held.select("cluster", "block", "rep", "items", F.lit(None).cast("bigint").alias("comp"), F.lit(0).alias("side"))
    large = held.where("blocks > 1")
    # A cluster's pivots: a bounded number, chosen by hash in two steps, go to all of its blocks.
    best = large.groupBy("cluster").agg(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("rep", F.lit("pivot")), "blocks") == 0, F.col("rep")))).alias("some"))
    pivots = best.select("cluster", F.explode(F.slice("some", 1, PIVOTS)).alias("rep"))
    pivots = large.join(pivots, ["cluster", "rep"]).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("to <> block")
    pivots = pivots.select("cluster", F.col("to").alias("block"), "rep", "items", F.lit(None).cast("bigint").alias("comp"), F.lit(0).alias("side"))
    links = common.checkpointed(_by_group(plain.unionByName(pivots), ["cluster", "block"], _confirmed(least)))

    if not large.isEmpty():
        known = _members(links).select("rep", F.col("cluster").alias("comp"))
        state = large.join(known, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        largest = state.groupBy("cluster", "comp").count().groupBy("cluster").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
        state = common.checkpointed(state.join(largest, "cluster"))
        rest = state.where("comp <> main")
        if not rest.isEmpty():
            chunks = rest.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("chunks"))
            rest = rest.join(chunks, "cluster").withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit("rest")), "chunks").cast("int"))
            left = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            right = state.join(chunks, "cluster").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            cols = ["cluster", "block", "chunk", "rep", "items", "comp"]
            pairs = left.select(*cols, F.lit(1).alias("side")).unionByName(right.select(*cols, F.lit(0).alias("side")))
            links = common.checkpointed(links.unionByName(_by_group(pairs, ["cluster", "block", "chunk"], _confirmed(least))))

    joined = components(links).select(F.col("u").alias("rep"), F.col("v").alias("low"))
    linked = classes.join(joined, "rep", "left").where("copies > 1 OR low IS NOT NULL").select("digest", "n", F.coalesce("low", "rep").alias("low"))
    return rows.join(linked, ["digest", "n"], "left").select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id; of rows that repeat this id, one."""
    found = common.checkpointed(near_groups(docs, doc_id, **options).select("id", "component_id"))
    gone = found.where("id <> component_id").select(F.col("id").alias(doc_id)).distinct()
    kept = docs.join(gone, doc_id, "left_anti").select(*docs.columns)
    twice = common.checkpointed(found.where("id IS NOT NULL").groupBy(F.col("id").alias(doc_id)).count().where("count > 1").select(doc_id))
    if twice.isEmpty():
        return kept
    return kept.join(twice, doc_id, "left_anti").select(*docs.columns).unionByName(kept.join(twice, doc_id, "left_semi").dropDuplicates([doc_id]).select(*docs.columns))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at a similarity of 0.85 on shingles of three words."""
    found = near_groups(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(generate_series(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END)) AS sh FROM d),
c AS (SELECT min(doc_id) AS rep, sh, len(sh) AS n FROM s GROUP BY sh),
t AS (SELECT rep, n, unnest(sh) AS x FROM c WHERE n > 0),
p AS (SELECT a.rep AS u, b.rep AS v FROM t a JOIN t b ON a.x = b.x AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
      GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
"""
OP9_SQL = (
    OP9_SQL.replace("WITH d", "WITH RECURSIVE d", 1)
    + r"""e AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(node, low) AS (SELECT rep, rep FROM c WHERE n > 0 UNION SELECT e.v, r.low FROM r JOIN e ON e.u = r.node WHERE r.low < e.v),
m AS (SELECT node, min(low) AS low FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.low, s.doc_id) AS component_id, s.doc_id = coalesce(m.low, s.doc_id) AS kept
FROM s JOIN c ON c.sh = s.sh LEFT JOIN m ON m.node = c.rep
"""
)
