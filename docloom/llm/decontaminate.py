"""Benchmark decontamination with a generalised suffix automaton.

The normalised test items are put into one generalised suffix automaton over words.  Training texts are streamed
through it, tracking the length of the longest suffix read so far that is a substring of some item.  Where that
length reaches the window, the window occurs; the state on its suffix path that stands for exactly the last ten
words names the items that hold them.  Items shorter than a window count as one window of their own length.

Only runs of known words as long as the shortest window are walked: a word that no item has resets the automaton,
so nothing else can match.  The automaton is broadcast.  Its size is checked first: items of more than ``MAX_CHARS``
characters are dealt to several automata by the hash of their id, and each gets a pass of its own over the texts.

Defined results: null and blank texts have no words; an item without words has no window; a null item id marks
words but is not reported; repeated items count once; repeated documents are judged one by one; columns of the
documents are kept, those named like an output are replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Characters of items in one automaton; it takes some 95 bytes a character, so 190 MB of a worker at most.
MAX_CHARS = 2_000_000
OUT = "n_words bigint, n_hit bigint, spans array<struct<start:int,stop:int>>, items array<string>"

#: Lower-cases A-Z and makes a blank of every ASCII character that is not a letter or digit.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


class Automaton:
    """Generalised suffix automaton of word sequences, with what ends in each state."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        names: list[set[str]] = [set()]
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        self.least = window
        texts = [(name, [self.ids.setdefault(w, len(self.ids)) for w in text.translate(_NORMAL).split()]) for name, text in items]
        for _, seq in texts:
            last = 0
            for c in seq:
                last = self._extend(last, c)
        names = [set() for _ in self.next]
        for name, seq in texts:
            if not seq:
                continue
            self.least = min(self.least, len(seq))
            v = 0
            for c in seq:  # walked again, so that every state knows the items that reach it
                v = self.next[v][c]
                names[v].add(name)
            if len(seq) < window:  # v holds all words of the item
                self.short.setdefault(v, []).append((len(seq), {name}))
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            names[self.link[v]] |= names[v]
        # For each state, the items with its last `window` words, and the short items on its suffix path.
        self.holds: list[frozenset[str]] = [frozenset()] * len(self.len)
        self.ends: list[tuple] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            p = self.link[v]
            self.ends[v] = (*self.ends[p], *self.short.get(v, ()))
            if self.len[v] >= window:
                self.holds[v] = self.holds[p] if self.len[p] >= window else frozenset(names[v])
        del self.short

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside windows, and the items of those windows."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(words) < self.least or not self.ids:
            return spans, found
        get = self.ids.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        runs = edges.reshape(-1, 2)
        nxt, link, length, window = self.next, self.link, self.len, self.window
        for a, b in runs[runs[:, 1] - runs[:, 0] >= self.least].tolist():
            v = n = 0
            for i, c in enumerate(ids[a:b].tolist(), a + 1):
                while v and c not in nxt[v]:
                    v = link[v]
                    n = length[v]
                if c in nxt[v]:
                    v = nxt[v][c]
                    n += 1
                back = 0
                if n >= window:
                    back = window
                    found |= self.holds[v]
                for size, names in self.ends[v]:
                    if size <= n:
                        back = max(back, size)
                        found |= names
                if back:
                    start = i - back
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i))
        return spans, found


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted([*a, *b]):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with words, words inside windows, their spans (positions of words) and the items, sorted as strings."""
    chosen = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    chars = chosen.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-chars // MAX_CHARS))
    df = docs.drop("n_words", "n_hit", "spans", "items")
    for part in range(parts):
        some = chosen.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part) if parts > 1 else chosen
        automaton = docs.sparkSession.sparkContext.broadcast(Automaton([(r["id"], r["text"].encode()) for r in some.collect()], window))

        def make(batch, texts, automaton=automaton, first=part == 0):
            a = automaton.value
            out = ([], [], [], [])
            before = [([], [])] * len(texts) if first else [([(s["start"], s["stop"]) for s in x], y) for x, y in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)]
            for t, (spans, names) in zip(texts, before, strict=True):
                words = t.translate(_NORMAL).split()
                now, found = a.scan(words)
                spans = _merged(spans, now) if spans else now
                out[0].append(len(words))
                out[1].append(sum(y - x for x, y in spans))
                out[2].append([{"start": x, "stop": y} for x, y in spans])
                out[3].append(sorted({*names, *(n for n in found if n is not None)}))
            return out

        df = common.appended(df, text, OUT, make)
    return df


def cut(texts: list[bytes], spans: list[list[dict]]) -> list[bytes]:
    """The texts without the words of the spans and what stands between them; a line break stays in their place."""
    out = []
    for t, cuts in zip(texts, spans, strict=True):
        if cuts:
            at = [m.span() for m in _WORD.finditer(t.translate(_NORMAL))]
            kept, last = [], 0
            for s in cuts:
                kept.append(t[last : at[s["start"]][0]])
                last = at[s["stop"] - 1][1]
            t = b"\n".join([*kept, t[last:]])
        out.append(t)
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", max_words: int = 0, max_coverage: float = 0.0, remove: bool = False, **names) -> DataFrame:
    """Documents within the limits, with the columns of ``docs``.

    A document goes if it has more than ``max_words`` words inside windows and they are more than ``max_coverage`` of
    its words.  With ``remove``, the spans of those that stay are cut out of their texts.
    """
    found = scan(docs, items, text, **names)
    found = found.where(~((F.col("n_hit") > max_words) & (F.col("n_hit") > max_coverage * F.col("n_words"))))
    if remove:
        found = common.appended(found.withColumnRenamed(text, "__text"), "__text", f"{text} string", lambda batch, texts: [[x.decode() for x in cut(texts, batch.column("spans").to_pylist())]])
    return found.select(*docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s
       FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
h AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, s)),
p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS pos FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
