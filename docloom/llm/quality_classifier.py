"""Quality classifier: histogram gradient-boosted trees over statistics of whole documents.

Statistics are computed where the texts lie.  Training uses a bounded sample of labelled rows (``MAX_SAMPLE``): their
statistics, a few hundred bytes a row, come to the driver, where features are cut into at most ``BINS`` quantile bins
and trees are grown level by level from gradient histograms.  Trees are complete binary trees in flat arrays, so that
scoring is ``DEPTH`` vectorised steps a tree over all rows of a slice.  The model, some 100 KB, goes along as a
broadcast; scoring is one pass over the texts without a shuffle.

Defined results: null and blank texts have zero statistics and are scored like any other; without labels of both kinds
the score is the smoothed share of label 1; a document with several labels is learned with each of them; repeated
documents are scored one by one; a null id is not held out and has no label; very long texts are read whole; an empty table
gives no rows; columns of the documents are kept, one named ``score`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most labelled rows to learn from; more are thinned by a hash of the document id.
MAX_SAMPLE = 20_000
BINS, DEPTH, TREES, RATE, L2, LEAST = 64, 4, 120, 0.1, 1.0, 4.0
#: Documents are called good from this score.
THRESHOLD = 0.7

FEATURES = (
    "log_words", "mean_word", "sd_word", "max_word", "upper", "digit", "full_stop", "comma", "bang", "bar", "symbol", "punct", "non_ascii", "line_rate",
    "dup_lines", "distinct", "top_word", "same_next", "distinct_pairs", "distinct_runs", "ends_stop", "ends_punct", "titled", "single", "entropy", "short_words",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!", b"|", b"#*$%&<>", b"'\"()-+/:;=?@[\\]^_`{}~", bytes(range(128, 256)), b"\n"), 1):
    _CLASS[list(_chars)] = _k


def statistics(text: bytes) -> list[float]:
    """One value for each of ``FEATURES``, all from the whole text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=11) / len(text)
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    first = np.fromiter((w[0] for w in words), np.uint8, n)
    p = counts[counts > 0] / len(text)
    return [
        np.log1p(n), sizes.mean(), sizes.std(), float(sizes.max()), *kinds[1:10], len(lines) / n,
        1 - len(set(lines)) / len(lines), len(seen) / n, max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1), len(set(zip(words, words[1:], words[2:], words[3:]))) / max(1, n - 3),
        float((last == 46).mean()), float(((last < 48) | (last > 57) & (last < 65)).mean()), float(((first > 64) & (first < 91)).mean()), float((sizes == 1).mean()),
        float(-(p * np.log2(p)).sum()), float((sizes <= 3).mean()),
    ]


@dataclass
class Trees:
    """``feature`` and ``cut``: a row per tree, inner nodes in heap order; ``value``: its leaves."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        rows, raw = np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += value[at - len(feature)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost logistic loss with trees of ``DEPTH`` levels over binned features."""
    inner = 2**DEPTH - 1
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    flat = binned + np.arange(m) * BINS
    raw, kept = np.full(n, model.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            first, many = 2**depth - 1, 2**depth
            at = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            hist = lambda w: np.bincount(at, np.repeat(w, m), many * m * BINS).reshape(many, m, BINS)  # noqa: E731, B023
            lg, lh = hist(g).cumsum(2), hist(h).cumsum(2)
            sg, sh = lg[:, :, -1:], lh[:, :, -1:]
            gain = lg**2 / (lh + L2) + (sg - lg) ** 2 / (sh - lh + L2) - sg**2 / (sh + L2)
            gain[(lh < LEAST / 4) | (sh - lh < LEAST / 4)] = -1
            best = gain.reshape(many, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, c = divmod(b, BINS)
                if gain[k, j, c] > 1e-9 and c < len(cuts[j]):
                    feature[first + k], cut[first + k] = j, cuts[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        raw += value[leaf]
        kept.append((feature, cut, value))
    model.feature, model.cut, model.value = (np.stack(a) for a in zip(*kept, strict=True))
    return model


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most: int = MAX_SAMPLE) -> Trees:
    """Fit on labelled documents; at most about ``most`` of them, chosen by a hash of their id."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("__id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(known), "__id")  # bounded by `most`
    measured = common.appended(chosen, "__text", "__x array<double>", lambda batch, texts: [[statistics(t) for t in texts]]).select("__id", "__y", "__x")
    rows = sorted(measured.collect())
    if not rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return fit(np.array([r["__x"] for r in rows]), np.array([r["__y"] for r in rows]))


def score(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch, texts):
        return [held.value.score(np.array([statistics(t) for t in texts], np.float64)).tolist()]

    return common.appended(docs, text, "score double", make)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32 leaves 2 modulo 4 are held out of training."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(~held_out)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
