import math
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import chat_format as ch, common, decontaminate as de, pitman_yor as py, url_filters as uf


def test_templates_are_black_boxes():
    turns = [("system", "s"), ("user", ch.HOSTILE), ("assistant", "one ### <"), ("assistant", ""), ("user", "u"), ("assistant", "\\# é")]
    text, spans, loss, rewrites = ch.render(turns)
    assert ch.read_back(text) == turns and rewrites == 0
    assert "".join(text[a:b] for a, b in spans) == text
    assert [ch.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]
    last_only = lambda ts: "".join(f"[{r}]{t}" if i == len(ts) - 1 else f"[{r}]" for i, (r, t) in enumerate(ts))
    assert ch.render(turns, last_only)[3] > 0
    framed = lambda ts: "<<" + "|".join(f"{r}>{t}" for r, t in ts) + "|"
    out, _, mask, again = ch.render([("user", "a"), ("assistant", "bb")], framed)
    assert [out[a:b] for a, b in mask] == ["bb"] and again == 1  # the mark that closed the empty conversation is gone


def test_spans_hold_after_a_rewrite():
    """Templates that drop earlier answers, number turns from the end, or close what was open: spans are those of the whole text."""
    turns = [("user", "u1"), ("assistant", "first"), ("user", "u2"), ("assistant", "second"), ("user", "u3")]

    def forgetful(ts):
        last = max((i for i, (r, _) in enumerate(ts) if r == "assistant"), default=-1)
        return "".join(f"<{r}>{t if r != 'assistant' or i == last else ''}</{r}>" for i, (r, t) in enumerate(ts))

    text, spans, loss, rewrites = ch.render(turns, forgetful)
    assert rewrites == 1 and [text[a:b] for a, b in spans] == ["u1", "", "u2", "second", "u3"] and [text[a:b] for a, b in loss] == ["", "second"]
    backwards = lambda ts: "".join(f"[{len(ts) - i}]{t}" for i, (_, t) in enumerate(ts))
    text, spans, loss, rewrites = ch.render(turns, backwards)
    assert rewrites == 4 and [text[a:b] for a, b in spans] == [t for _, t in turns] and [text[a:b] for a, b in loss] == ["first", "second"]


def test_long_conversations_are_rendered_in_time():
    import time

    turns = [("user" if k % 2 else "assistant", "word # < " * 120) for k in range(400)]
    began = time.process_time()
    text, _, loss, _ = ch.render(turns)
    assert [ch.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"] and time.process_time() - began < 120


def test_chat_frames(spark):
    rows = [(1, 1, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (None, 0, "a:b", "t", "x"), (2, None, "assistant", "l" * 100_000, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in ch.format_conversations(df).collect()}
    assert got[1].n_turns == 3 and got[1].formatted == "### user: a</turn>\n### user: b</turn>\n### user: </turn>\n"
    assert got[None].n_turns == 1 and got[2].loss_chars == 100_000
    assert ch.format_conversations(df.limit(0)).count() == 0


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short ITEM"), (3, None), (4, "... !!"), (2, "short item"), (5, "a b c d e f g h i j k l a b c d e f g h i j"), (None, "no id here at all")]


def windows():
    out = []
    for i, t in ITEMS:
        w = (t or "").encode().translate(de._NORMAL).split()
        k = min(10, len(w))
        out += [(str(i) if i is not None else None, tuple(w[j : j + k])) for j in range(len(w) - k + 1) if w]
    return out


def brute(text):
    w = (text or "").encode().translate(de._NORMAL).split()
    hit, items = set(), set()
    for name, x in windows():
        for j in range(len(w) - len(x) + 1):
            if tuple(w[j : j + len(x)]) == x:
                hit |= set(range(j, j + len(x)))
                items.add(name)
    return len(w), len(hit), sorted(items - {None})


DOCS = [None, "", "nothing", "one-two three FOUR five six seven eight nine ten", "x one two three four five six seven eight nine ten eleven y", "a short item, no id here at all", "short",
        "a b c d e f g h i j k l a b c d e f g h i j k", "item short item short item", "one two three four five six seven eight nine x", "z " * 30_000 + "short item"]


@pytest.mark.parametrize("most", [de.MAX_CHARS, 40])
def test_scan_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(de, "MAX_CHARS", most)  # 40: several automata, a pass each
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i % 9, t, "old") for i, t in enumerate(DOCS)], "doc_id long, text string, items string")
    got = [(r.n_words, r.n_hit, r["items"]) for r in de.scan(docs.coalesce(1), items).collect()]
    assert got == [brute(t) for t in DOCS]
    assert de.scan(docs.limit(0), items).count() == 0
    assert {r.n_hit for r in de.scan(docs, items.limit(0)).collect()} == {0}


def test_decontaminate_limits(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    clean = de.decontaminate(docs, items)
    assert clean.columns == ["doc_id", "text"] and {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(DOCS) if not brute(t)[1]}
    cut = {r.doc_id: r.text for r in de.decontaminate(docs, items, max_coverage=0.95, remove=True).collect()}
    assert cut[4] == "x \n y" and cut[2] == "nothing" and 3 not in cut
    assert all(brute(t)[1] == 0 for t in cut.values())


URLS = [None, "", "nope", "http://example.com/en/1", "https://a.example.com/en/77?x#y", "http://EXAMPLE.com/en/7", "http://x.net/de/", "http://example.net/de/85", "http://com/en/", "http://notexample.com/en/7",
        "ftp://u@b.org/es/x", "http://b.org", "http://b.org?/es/", "x://y.net/de/a://z.com/en/", "http://com./en/", "http://" + "a." * 200 + "com/en/" + "z" * 5000]


def verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for action, key in uf.RULES:
        h, _, p = key.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(key), key, action))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_against_brute_force(spark):
    rules = spark.createDataFrame([(k, a) for a, k in uf.RULES], "key string, action string")
    pages = spark.createDataFrame([(i, u, "keep") for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string")
    for judge in (uf.judge, uf.judge_by_join):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(pages, rules).collect()}
        assert [got[i] for i in range(len(URLS) * 2)] == [verdict(u) for u in URLS * 2]
        assert judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in uf.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    listed = spark.range(0, 4000, 7).selectExpr("concat('k', id) AS key")
    universe = spark.range(4000).selectExpr("concat('k', id) AS key")
    cascade = uf.Cascade(listed, universe, 4000)
    assert len(cascade.levels) > 1
    got = universe.where(cascade.holds(uf.F.col("key")))
    assert got.count() == listed.count() and got.join(listed, "key", "left_anti").count() == 0


def test_cascade_too_large(spark, monkeypatch):
    monkeypatch.setattr(uf, "MAX_BITS", 0)
    rules = spark.createDataFrame([(k, a) for a, k in uf.RULES], "key string, action string")
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    assert {r.page_id: r.verdict for r in uf.judge(pages, rules).collect()} == {i: verdict(u)[3] for i, u in enumerate(URLS)}


def test_long_list_in_parts(spark, monkeypatch):
    rules = spark.range(3000).selectExpr("concat('h', id % 700, '.com/p', id) AS key", "IF(id % 3 = 0, 'allow', 'block') AS action")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://www.h', id % 900, '.com/p', id, '/x') AS url", "id AS rule")
    want = {tuple(r) for r in uf.judge_by_join(pages, rules).collect()}
    cascades = []
    made = uf.Cascade
    monkeypatch.setattr(uf, "Cascade", lambda *a: cascades.append(made(*a)) or cascades[-1])
    for most in (1 << 24, 9000):
        monkeypatch.setattr(uf, "MAX_BITS", most)
        cascades.clear()
        got = uf.judge(pages, rules)
        assert {tuple(r) for r in got.collect()} == want and got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
        assert (len(cascades) == 2) == (most > 9000)
        assert most > 9000 or all(level.bits < 2 * most for c in cascades for level in c.levels)


def lm_docs():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{min(30, rng.geometric(0.15))}" for _ in range(rng.integers(0, 60))) for _ in range(60)]
    return [None, "", " \n", "NEW words Only", "w1 " * 5000, *texts, texts[5]]


def test_language_model(spark, monkeypatch):
    texts = lm_docs()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    want = {r.id: r for r in py.score(df).collect()}
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    c = Counter(w for ws, h in zip(tokens, held) for w in ws if not h)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(tokens):
        r = want[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert math.isfinite(r.score) and r.score < 0
    real = [i for i, h in enumerate(held) if not h and texts[i]]
    assert sum(want[i].score for i in real) > sum(want[i].base_score for i in real)
    # Chunks, buckets and partitions change nothing: seating is drawn from hashes.
    monkeypatch.setattr(py, "CHUNK", 500)
    again = {r.id: r.score for r in py.score(df.repartition(7)).collect()}
    assert all(math.isclose(again[i], want[i].score, rel_tol=1e-9) for i in again)
    assert py.score(df.limit(0)).count() == 0
    # Several buckets, hot restaurants in parts, ids of another type and a null one.
    monkeypatch.setattr(py, "WORDS_PER_BUCKET", 300)
    monkeypatch.setattr(py, "PAIRS_PER_BUCKET", 700)
    other = {r.id: r for r in py.score(df.selectExpr("nullif(concat('d', doc_id), 'd7') AS doc_id", "text"), held_out=lambda i: held[int(i[1:])] if i else False).collect()}
    for i, h in enumerate(held):
        r = other[None if i == 7 else f"d{i}"]
        assert r.n_tokens == want[i].n_tokens and (held[7] or math.isclose(r.base_score, want[i].base_score, rel_tol=1e-9) and math.isclose(r.score, want[i].score, rel_tol=0.2, abs_tol=1))


def test_language_model_in_groups(spark, monkeypatch):
    """Askers that meet in groups get the very numbers that they get alone."""
    for name, value in (("CHUNK", 500), ("WORDS_PER_BUCKET", 150), ("PAIRS_PER_BUCKET", 300)):
        monkeypatch.setattr(py, name, value)
    df = spark.createDataFrame(list(enumerate(lm_docs())), "doc_id long, text string").repartition(3)
    want = {r.id: r for r in py.score(df).collect()}
    for many in (2, 5):
        monkeypatch.setattr(py, "GROUP", many)
        got = {r.id: r for r in py.score(df).collect()}
        assert got.keys() == want.keys()
        for i, r in got.items():
            assert (r.n_tokens, r.n_known, r.train_tokens) == (want[i].n_tokens, want[i].n_known, want[i].train_tokens)
            assert math.isclose(r.base_score, want[i].base_score, rel_tol=1e-9) and math.isclose(r.score, want[i].score, rel_tol=1e-9)


def seated(texts, buckets=1):
    """Restaurants of texts that are all learned, in one or more buckets, and what the words' bucket answers."""
    n, hashes, place = py.tokenized(texts)
    chunk = py.Chunk([True] * len(texts), n, len(hashes), place)
    count = py._train_counts([True] * len(texts), n, len(hashes), place)
    (told,), (_, distinct, once, twice, _, low) = py._answer_words(0, [{"keys": py.pack(py._steps(hashes)), "count": py.pack(count)}])
    ids = np.cumsum(py.unpack(py._split(told)[0]), dtype=np.uint64)
    part = 20 if buckets > 1 else 1 << 40
    bucket, order = chunk.dealt(ids, count, buckets, part)
    rows = []
    for b, x, y in py._runs(bucket[order]):
        at = order[x:y]
        ask = {"chunk": 5, "u": py.pack(py._steps(ids[chunk.u[at]])), "w": py.pack(ids[chunk.w[at]]), "count": py.pack(chunk.pair_count[at]), "split": np.packbits(count[chunk.u[at]] >= part).tobytes()}
        rows.append(py._gathered(b, [ask])[0])
    parent = {"discount": 0.4, "uniform": 1 / (distinct + 1), "tables": distinct, "customers": 0}
    return chunk, order, rows, parent, low


def rounds(rows, parent, low, many, burn_in):
    state = [dict(r) for r in rows]
    held = [py.Restaurants(r, 0.6) for r in state]
    samples = 0
    for k in range(many):
        asks = [h.asks(low)[0] for h in held]
        answers, (customers, tables, *_) = py._answer_parent(parent, k, low)(0, asks)
        parent = parent | {"customers": customers, "tables": tables}
        for i, a in enumerate(answers):
            state[i]["tables"] = py.pack(held[i].tables)
            held[i] = py.Restaurants(state[i], 0.6)
            held[i].hear([{"payload": a}], parent)
            for _ in range(2):
                held[i].sweep(np.random.default_rng([k, i, samples]))
                if k >= burn_in:
                    state[i]["sum"] = state[i].get("sum", 0) + held[i].predictive()
        samples += 2 * (k >= burn_in)
    return held, parent, [r.get("sum", 0) / max(1, samples) for r in state]


@pytest.mark.parametrize("buckets", [1, 3])
def test_predictions_add_up_to_one(buckets):
    """The probabilities of all words and the unknown one after a context sum to one, also when its dishes are dealt to several buckets."""
    texts = [t.encode() for t in lm_docs()[5:]]
    _, _, rows, parent, low = seated(texts, buckets)
    held, parent, _ = rounds(rows, parent, low, 1, 9)
    new = (py.ROOT_STRENGTH + parent["discount"] * parent["tables"]) * parent["uniform"]
    words = {w: p for h in held for w, p in zip(h.dish_ids.tolist(), h.parent_p.tolist())}
    assert math.isclose(sum(words.values()) + new / (py.ROOT_STRENGTH + parent["customers"]), 1, rel_tol=1e-9)
    fresh = [py.Restaurants(r, 0.6) for r in rows]
    (a, *more), _ = py._answer_parent(parent, 9, low)(0, [h.asks(low)[0] for h in fresh])
    for h, x in zip(fresh, [a, *more]):
        h.hear([{"payload": x}], parent)
    words = {w: p for h in fresh for w, p in zip(h.dish_ids.tolist(), h.parent_p.tolist())}
    contexts = {}
    for h in fresh:
        for u, w, p in zip(h.ids[h.u].tolist(), h.dish_ids[h.w].tolist(), h.predictive().tolist()):
            contexts.setdefault(u, {})[w] = p
        assert (h.tables[h.count > 0] >= 1).all() and (h.tables <= h.count).all()
    assert any(len(h.split) for h in fresh) == (buckets > 1)
    for h in fresh:
        for u, i in zip(h.ids.tolist(), range(len(h.ids))):
            backing = (py.STRENGTH + 0.6 * h.held[i]) / (py.STRENGTH + h.customers[i])
            rest = 1 - sum(words[w] for w in contexts[u])
            assert math.isclose(sum(contexts[u].values()) + backing * rest, 1, rel_tol=1e-9)


def one_by_one(texts, uniform, sweeps, burn_in):
    """Mean predictive probability of each pair, from a sampler that moves one customer at a time and keeps every table."""
    rng = np.random.default_rng(11)
    sequences = [[py.START, *(w for w in t.split()), py.END] for t in texts]
    customers = [(a, b) for s in sequences for a, b in zip(s, s[1:])]
    seats: dict = {}
    root: dict = {}
    total = {"tables": Counter(), "customers": Counter(), "root": 0, "root_tables": 0}

    def root_p(w):
        m = root.get(w, [])
        return (sum(m) - 0.4 * len(m) + (py.ROOT_STRENGTH + 0.4 * total["root_tables"]) * uniform) / (py.ROOT_STRENGTH + total["root"])

    def enter(tables, old, new):
        weights = [x - old for x in tables] + [new]
        k = rng.choice(len(weights), p=np.array(weights) / sum(weights))
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return tables[k] == 1

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def seat(u, w):
        if enter(seats.setdefault((u, w), []), 0.6, (py.STRENGTH + 0.6 * total["tables"][u]) * root_p(w)):
            total["tables"][u] += 1
            total["root_tables"] += enter(root.setdefault(w, []), 0.4, (py.ROOT_STRENGTH + 0.4 * total["root_tables"]) * uniform)
            total["root"] += 1
        total["customers"][u] += 1

    def unseat(u, w):
        if leave(seats[u, w]):
            total["tables"][u] -= 1
            total["root_tables"] -= leave(root[w])
            total["root"] -= 1
        total["customers"][u] -= 1

    for u, w in customers:
        seat(u, w)
    mean: Counter = Counter()
    for k in range(sweeps):
        for u, w in customers:
            unseat(u, w)
            seat(u, w)
        if k >= burn_in:
            for (u, w), t in seats.items():
                mean[u, w] += (sum(t) - 0.6 * len(t) + (py.STRENGTH + 0.6 * total["tables"][u]) * root_p(w)) / (py.STRENGTH + total["customers"][u])
    return {k: v / (sweeps - burn_in) for k, v in mean.items()}, sequences


def test_sampler_agrees_with_one_customer_at_a_time():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(12, rng.geometric(0.3))}" for _ in range(rng.integers(3, 25))) for _ in range(16)]
    chunk, order, rows, parent, low = seated([t.encode() for t in texts])
    _, _, (p,) = rounds(rows, parent, low, 150, 50)
    places = np.cumsum(py.unpack(rows[0]["places"][0]["places"]), dtype=np.uint64).astype(np.int64)
    pair = np.empty(len(order))
    pair[order] = p[places]
    want, sequences = one_by_one(texts, parent["uniform"], 150, 50)
    got = np.bincount(chunk.doc, np.log10(pair)[chunk.pair])
    brute = np.array([sum(math.log10(want[x]) for x in zip(s, s[1:])) for s in sequences])
    assert np.abs(got / brute - 1).max() < 0.03 and abs(got.sum() / brute.sum() - 1) < 0.01


def test_tables_are_drawn_from_the_exact_conditional():
    """Three customers of a dish: one, two or three tables, with weights by hand."""
    d, p, s = 0.6, 0.2, 1.7
    w = np.array([s * p * (1 - d) * (2 - d), s * (s + d) * p**2 * 3 * (1 - d), s * (s + d) * (s + 2 * d) * p**3])
    drawn = py.seat(np.full(200_000, 3), np.full(200_000, s), np.full(200_000, p), d, np.random.default_rng(0))
    assert np.abs(np.bincount(drawn, minlength=4)[1:] / 200_000 - w / w.sum()).max() < 0.005
    many = py.seat(np.full(500, 5000), np.full(500, s), np.full(500, p), d, np.random.default_rng(0))
    assert many.min() >= 1 and 2 < many.mean() < 20


def test_tables_are_dropped(spark):
    common.clean(spark)
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    py.score(df).collect()
    left = list(common._TABLES)
    assert 0 < len(left) <= 6 and all(spark.catalog.tableExists(t) for t in left)
    assert common.clean(spark) == len(left) and not any(spark.catalog.tableExists(t) for t in left)


def test_packing():
    for x in ([], [0], [1, 2**40, 3], [255, 256]):
        assert py.unpack(py.pack(np.array(x, np.uint64))).tolist() == x
