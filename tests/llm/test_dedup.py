import hashlib
import math
import random
from collections import Counter

import numpy as np

from docloom.llm import near_dedup as n, substring_dedup as s

WORDS = [f"w{i}" for i in range(400)]


def corpus():
    rng = random.Random(3)
    make = lambda k: [rng.choice(WORDS) for _ in range(k)]
    base, passage = make(120), make(60)
    texts = [None, "", " \n ", "one", "One", "two words", " ".join(base), " ".join(base), " ".join(base).upper()]
    texts += [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(0, 120, 3)]
    texts += [" ".join(make(50) + passage + make(20)) for _ in range(12)]
    texts += [" ".join(make(rng.randrange(1, 200))) for _ in range(40)]
    texts += [" ".join(make(4) * 30), "x" * 50_000, " ".join(["same"] * 300)]
    return texts


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "e", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words string, chunk int")


def removed(texts):
    words = [[w.decode() for w in (t or "").encode().split()] for t in texts]
    count = Counter(tuple(ws[i : i + s.WINDOW]) for ws in words for i in range(len(ws) - s.WINDOW + 1))
    out = []
    for ws in words:
        gone = {i + k for i in range(len(ws) - s.WINDOW + 1) if count[tuple(ws[i : i + s.WINDOW])] > 1 for k in range(s.WINDOW)}
        out.append((len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return out


def test_substrings_against_brute_force(spark):
    texts = corpus()
    got = {r.id: (r.n_words, r.n_removed, r.kept) for r in s.dedup(docs(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts)


def test_sketch_may_overflow(spark, monkeypatch):
    monkeypatch.setattr(s, "CELLS", 0)
    monkeypatch.setattr(s, "LEAST_BITS", 9)  # nearly every cell is hit: the second pass alone decides
    monkeypatch.setattr(s, "PER_BUCKET", 500)
    texts = corpus()
    got = {r.id: r.kept for r in s.dedup(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [x[2] for x in removed(texts)]


def test_sketch_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK", 1 << 9)
    monkeypatch.setattr(s, "CHUNK", 3000)
    texts = corpus()
    frame = docs(spark, texts).selectExpr("concat('d', doc_id) AS doc_id", "text")
    got = {r.id: r.kept for r in s.dedup(frame.repartition(3)).collect()}
    assert [got[f"d{i}"] for i in range(len(texts))] == [x[2] for x in removed(texts)]


def test_chunks_meet_in_groups(spark, monkeypatch):
    """Groups of two chunks, ranges of blocks and of buckets; then no range is smaller than a row."""
    monkeypatch.setattr(s, "CHUNK", 3000)
    monkeypatch.setattr(s, "GROUP", 2)
    monkeypatch.setattr(s, "PER_BUCKET", 500)
    texts = corpus()
    for block in (1 << 7, 1 << 24):
        monkeypatch.setattr(s, "BLOCK", block)
        got = {r.id: r.kept for r in s.dedup(docs(spark, texts).repartition(3)).collect()}
        assert [got[i] for i in range(len(texts))] == [x[2] for x in removed(texts)]


def test_wide_ranges_are_packed():
    cells = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 1000))
    assert (s._unpack(s._pack(cells, 40), 40) == cells).all()


def test_work_grows_with_the_input(monkeypatch):
    """What a chunk sends and a bucket holds at most stays the same from a certain size on, whatever the corpus; one window is in every chunk."""
    monkeypatch.setattr(s, "GROUP", 16)
    rng, sizes = np.random.default_rng(1), []
    for n_chunks in (64, 256):
        hashes = [np.concatenate(([np.uint64(12345) << np.uint64(40)], rng.integers(0, 2**63, 400, np.uint64) * np.uint64(2))) for _ in range(n_chunks)]
        bits, low, shift = int(s.CELLS * 400 * n_chunks).bit_length(), 12, (n_chunks // s.GROUP - 1).bit_length()
        high, held = low + shift, {}
        sent = [s._asked_cells(k, h, bits, high) for k, h in enumerate(hashes)]
        for k, rows in enumerate(sent):
            for r in rows:
                held.setdefault((r["block"], k >> 4), []).append((s._unpack(r["cells"], high), s._flags(r["twice"], len(s._unpack(r["cells"], high)))))
        blocks = {}
        for (span, g), parts in held.items():
            keys, twice, places = s._together(*map(list, zip(*parts)))
            assert all((keys[p] == k).all() for p, (k, _) in zip(places, parts))
            for b, x, y in s._runs(keys >> low):
                blocks.setdefault((span << shift) + b, []).append(y - x)
        sizes.append((max(map(len, sent)), max(len(p) for p in held.values()), max(map(sum, blocks.values())) / (1 << low)))
        assert max(map(len, blocks.values())) <= 1 << shift
    assert sizes[1][0] <= sizes[0][0] and sizes[1][1] <= sizes[0][1] == s.GROUP and sizes[1][2] < 1.3 * sizes[0][2]


def test_sketch_lets_few_single_windows_pass():
    """At its load, eight cells a window and row, about one of seventy windows that occur once passes, at any size."""
    rng = np.random.default_rng(1)
    for n in (50_000, 400_000):
        bits, low = int(s.CELLS * n).bit_length(), 15
        h = rng.integers(0, 2**63, n, np.uint64) * np.uint64(2)
        parts = np.array_split(h, 5)
        asked = {}
        for k, part in enumerate(parts):
            for r in s._asked_cells(k, part, bits, low):
                asked.setdefault(r["block"], []).append(r)
        said = {}
        for block, rows in asked.items():
            for r, x in zip(rows, s._answered_cells(rows, low)):
                said.setdefault(r["chunk"], []).append({"block": block, "bits": x})
        passed = 0
        for k, part in enumerate(parts):
            good = np.ones(len(part), bool)
            at = {a["block"]: np.unpackbits(np.frombuffer(a["bits"], np.uint8)) for a in said[k]}
            for row in range(s.ROWS):
                cells, place = np.unique(s._cells(part, row, bits), return_inverse=True)
                blocks = (cells.astype(np.int64) + (row << bits)) >> low
                good &= np.concatenate([at[b][: y - x] for b, x, y in s._runs(blocks)]).astype(bool)[place]
            passed += int(good.sum())
        assert passed / n < 0.02


def test_substring_edge_cases(spark):
    assert s.dedup(docs(spark, corpus()).limit(0)).count() == 0
    one = spark.createDataFrame([(None, "a " * 40), (5, None)], "doc_id long, text string")
    got = {r.id: (r.n_words, r.n_removed) for r in s.dedup(one).collect()}
    assert got == {None: (40, 40), 5: (0, 0)}
    row = s.op3_substring_dedup(spark, "/root/testdata/sf0.001").where("n_words = n_removed").first()
    assert row is None or row.kept_sha256 == hashlib.sha256(b"").hexdigest()


def groups(texts, size=3, least=85):
    sets = []
    for t in texts:
        w = [x for x in (t or "").encode().translate(n._LOWER).split()]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = list(range(len(texts)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b) and root(i) != root(j):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [(len(x), root(i)) for i, x in enumerate(sets)]


def test_near_groups_against_brute_force(spark):
    texts = corpus()
    got = {r.id: (r.n_shingles, r.component_id) for r in n.near_groups(docs(spark, texts).repartition(5)).collect()}
    assert [got[i] for i in range(len(texts))] == groups(texts)
    kept = n.keep_one(docs(spark, texts), size=5, least=80)
    assert kept.columns == ["doc_id", "text", "n_words", "chunk"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({g for _, g in groups(texts, 5, 80)})


def test_blocks_and_rounds(spark, monkeypatch):
    """Small limits: dense nodes, blocks with pivots, what is left beside the largest component, distributed rounds."""
    for name, value in (("SMALL", 4), ("BLOCK", 700), ("PIVOTS", 1), ("DENSE", 0.2)):
        monkeypatch.setattr(n, name, value)
    original = n.components
    monkeypatch.setattr(n, "components", lambda links: original(links, 0))
    texts = corpus()
    got = {r.id: r.component_id for r in n.near_groups(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == [g for _, g in groups(texts)]


def test_near_edge_cases(spark):
    assert n.near_groups(docs(spark, ["a"]).limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "A b c D")], "doc_id long, text string")
    got = sorted((str(r.id), r.component_id) for r in n.near_groups(twice).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("None", None)]
    assert sorted(str(r.doc_id) for r in n.keep_one(twice).collect()) == ["1", "None"]
    assert n.trees(85) == 4 and n.trees(80) == 5


def test_trees_that_share_tokens_miss_few_pairs():
    rng, pairs = np.random.default_rng(5), 2000
    for least in (85, 80):
        low, many = n.margin(least), n.grown(least)
        chance = [math.comb(64, k) * (least / 100) ** k * (1 - least / 100) ** (64 - k) for k in range(65)]
        total = sum(chance[:low])
        assert total <= n.MISS / 4
        for k in range(low, 56):  # pairs with k equal tokens, five levels
            a = rng.integers(0, 2**32, (pairs, 64), np.uint32)
            b = np.where(rng.random((pairs, 64)).argsort(1) < k, a, a ^ np.uint32(1))
            found = np.zeros(pairs, bool)
            for tree in range(many):
                at, nodes = np.arange(pairs), np.full(pairs, tree + 1, np.uint64)
                for _ in range(5):
                    x, y = n._children(nodes, a[at]), n._children(nodes, b[at])
                    at, nodes = np.repeat(at, n.BRANCH)[(x == y).ravel()], x[x == y]
                found[at] = True
            total += chance[k] * (~found).mean()
        assert total <= 1.2 * n.MISS, (least, total)
