"""LM scoring by a hierarchical Pitman-Yor model of words.

Every word that precedes others is a restaurant whose dishes are its successors.  All of them share one parent, the
restaurant of single words, whose own parent is uniform over the vocabulary and one unknown word.  A restaurant's customers
are the training occurrences; its tables are the customers that it sends to its parent.

Seating is sampled by Gibbs.  A step takes all customers of one dish out of a restaurant and draws the number of tables at
which they sit again from its exact conditional, given the restaurant's other tables and the parent: weights are rising
factorials of the strength, powers of the parent's probability and generalised Stirling numbers.  Above ``EXACT``
customers, the rest follow by the Chinese restaurant's rule in parties of a sixteenth of those seated, whose new tables
are drawn binomially.  The dishes of a restaurant are seated in ``COLOURS`` groups, one after the other, each seeing the
tables of the others.  A round makes some sweeps of all restaurants given the parent, then the parent is seated
anew.  The earlier rounds are the burn-in; each sweep of the last one gives predictive probabilities, which are averaged
for each pair; the score is the sum of their logarithms (sent with 17 binary places).

Counts and seatings are spread over the cluster.  Texts lie as token numbers in chunks of whole documents, in a table
bucketed by chunk, so that joining a chunk with its answers moves no text.  Chunks send their distinct words to buckets
of a hash range, which add up all chunks and answer with numbers; then their distinct pairs to buckets of restaurants,
where each pair lies once, with its count and its tables.  A hot word or pair is one entry a chunk, however often it occurs;
the dishes of a hot restaurant are dealt to several buckets.  Rounds work on those buckets alone, not on chunks: they
ask the word buckets for the parent's tables and keep the seating in a table between rounds.  At last they answer each
chunk with the logarithms of its pairs.  Neither what a chunk sends nor what a bucket holds grows with the corpus: askers
are dealt to groups of about ``GROUP``, and above one group each sends ranges of buckets, as many as a single group needs,
to its own group, which adds them up, asks the buckets of a range and passes the answers on.  The driver keeps totals only.  Random numbers come from the bucket and the round,
so a repeated task changes nothing.

Defined results: a null text is empty and has the end token alone; a null id is not held out; ids of any type are kept; very
long texts make chunks of their own; repeated rows are learned and scored one by one; other columns are dropped; an empty
table gives no rows; without training rows all words are unknown.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import common

START, END = 0, 1  # hashes of the context before a text and of the token after it
CHUNK = 4_000_000
SUMS = 6
WORDS_PER_BUCKET, PAIRS_PER_BUCKET = 2_000_000, 2_000_000
#: Askers whose words and pairs are added up before they meet those of others.
GROUP = 16_384
STRENGTH, ROOT_STRENGTH = 1.0, 10.0
#: Sweeps of each round, of which the last round's are averaged, and groups of dishes.
SWEEPS, COLOURS = (2, 2, 4), 3
#: Customers of a dish up to which the number of their tables is drawn from its exact conditional.
EXACT = 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers in byte planes; planes of zeros are left out."""
    x = np.ascontiguousarray(x, np.uint64)
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([planes]) + x.view(np.uint8).reshape(-1, 8)[:, :planes].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The inverse of :func:`pack`."""
    planes = data[0]
    part = np.frombuffer(data, np.uint8, offset=1).reshape(planes, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :planes] = part.T
    return out.view(np.uint64).ravel()


def _runs(groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, start, end) of each run of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))).tolist() if len(groups) else []
    return zip(groups[edges].tolist(), edges, [*edges[1:], len(groups)])


def tokenized(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, the distinct hashes (ascending) of a chunk, and the place of each token among them.

    A text is its start, its words and its end.
    """
    words = [t.translate(_LOWER).split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(n + 2)
    hashes = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint64)
    body = np.ones(len(hashes), bool)
    body[ends - 1] = body[ends - n - 2] = False
    hashes[body] = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, int(n.sum()))
    hashes[ends - 1] = END
    return n, *np.unique(hashes, return_inverse=True)


class Chunk:
    """Words and pairs of a chunk of documents."""

    def __init__(self, train: list[bool], n: np.ndarray, words: int, place: np.ndarray):
        ends = np.cumsum(n + 2)
        self.n_tokens = n + 1
        self.doc = np.repeat(np.arange(len(n)), n + 1)
        token = np.ones(len(place), bool)
        token[ends - n - 2] = False
        at = np.flatnonzero(token)
        self.word, before = place[at], place[at - 1]
        self.train = np.repeat(np.array(train, bool), n + 1)
        pairs, self.pair = np.unique(before * words + self.word, return_inverse=True)
        self.u, self.w = pairs // max(1, words), pairs % max(1, words)
        self.pair_count = np.bincount(self.pair[self.train], minlength=len(pairs))

    def dealt(self, ids: np.ndarray, total: np.ndarray, buckets: int, part: int, shift: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each pair, and the pairs by ranges of 2 ** shift buckets: whole restaurants, but hot ones in parts of about so many customers."""
        parts = 1 + total[self.u] // part
        with np.errstate(over="ignore"):
            dish = _mix(ids[self.w] + np.uint64(0x632BE59BD9B4E019)) % parts.astype(np.uint64)
            bucket = (_mix(_mix(ids[self.u]) ^ dish) % np.uint64(buckets)).astype(np.int64)
        return bucket, np.argsort((bucket >> shift).astype(np.uint16) if buckets >> shift < 1 << 16 else bucket >> shift, kind="stable")


def _train_counts(train: list[bool], n: np.ndarray, words: int, place: np.ndarray) -> np.ndarray:
    """Training occurrences of a chunk's words; a text's start is counted as a context, as often as texts end."""
    return np.bincount(place[np.repeat(np.array(train, bool), n + 2)], minlength=words)


def _chunks(docs: DataFrame, doc_id: str, text: str, held_out: Callable[[int], bool]) -> tuple[DataFrame, int, int]:
    """Table of chunks as token numbers, its number of buckets and the bytes of text."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    size = rows.select(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 2), F.lit(0))).first()[0]
    kind = rows.schema["id"].dataType
    fields = f"chunk bigint, ids array<{kind.simpleString()}>, train array<boolean>, n binary, words binary, count binary, tokens binary"
    schema = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(to_arrow_type(kind))), ("train", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("n", "words", "count", "tokens"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[tuple] = []
        total = k = 0

        def made() -> pa.RecordBatch:
            ids = [i for i, _ in held]
            train = [i is None or not held_out(i) for i in ids]
            n, words, place = tokenized([t for _, t in held])
            row = {"chunk": task << 32 | k, "ids": ids, "train": train, "n": pack(n), "words": words.tobytes(), "count": pack(_train_counts(train, n, len(words), place)), "tokens": pack(place)}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in common.slices(batches, "text", CHUNK):
            for row in zip(batch.column("id").to_pylist(), common.column_bytes(batch, "text"), strict=True):
                held.append(row)
                total += len(row[1])
                if total >= CHUNK:
                    yield made()
                    held.clear()
                    total, k = 0, k + 1
        if held:
            yield made()

    buckets = common.bucket_count(size)
    return common.bucketed(rows.mapInArrow(cut, fields), "chunk", buckets), buckets, size


def _answered(asked: DataFrame, answer: Callable[[int, list[dict]], tuple[list[bytes], list[int]]], asker: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """Ask the buckets; a table of the answers by ``asker`` in so many buckets, and the totals (the last one a maximum).

    ``answer`` gets what all ask of one bucket, a bounded range of keys, and returns a payload for each and up to ``SUMS`` numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in common.grouped(batches, ["bucket"]):
            held = list(rows)
            payloads, sums = answer(bucket, held)
            totals = [sums] + [[0] * SUMS] * (len(held) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([r[asker] for r in held], pa.int64()), pa.array([bucket] * len(held), pa.int64()), pa.array(payloads, pa.binary()), pa.array(totals, pa.list_(pa.int64()))], [asker, "from", "payload", "sums"])

    done = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, f"{asker} bigint, from bigint, payload binary, sums array<bigint>")
    how = [F.sum] * (SUMS - 1) + [F.max]
    total = [f(F.get("sums", F.lit(k))).alias(f"s{k}") for k, f in enumerate(how)]
    table = common.bucketed(done.groupBy(asker).agg(F.sort_array(F.collect_list(F.struct("from", "payload"))).alias("answers"), *total), asker, buckets)
    row = table.agg(*(F.coalesce(f(f"s{k}"), F.lit(0)) for k, f in enumerate(how))).first()
    return common.named_like(table.select(asker, "answers"), table), list(row)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield from batch.slice(k, 1).to_pylist()


def _shift(askers: int) -> int:
    """Two to its power is the number of groups of so many askers."""
    return max(0, -(-askers // GROUP) - 1).bit_length()


def _held(asked: DataFrame, asker: str, shift: int, buckets: int) -> DataFrame:
    """What the askers of a group sent to a range of buckets, a row each: ``at``, the range and the group in one number, and ``parts``."""
    at = F.shiftleft(F.col("bucket"), shift) + F.pmod(F.xxhash64(asker), F.lit(1 << shift))
    return common.bucketed(asked.groupBy(at.alias("at")).agg(F.collect_list(F.struct(*(c for c in asked.columns if c != "bucket"))).alias("parts")), "at", buckets)


def _answered_in_groups(asked: DataFrame, answer: Callable, asker: str, buckets: int, shift: int, add: Callable, split: Callable) -> tuple[DataFrame, list[int]]:
    """:func:`_answered`, by way of 2 ** shift groups of askers, whose buckets are ranges.

    ``add`` turns what a group's askers sent into rows for the buckets; ``split`` turns their answers into a payload for each asker.
    """
    if not shift:
        return _answered(asked, answer, asker, buckets)
    held = _held(asked, asker, shift, buckets)
    schema = pa.schema([(c, pa.int64() if c in ("bucket", asker) else pa.binary()) for c in asked.columns])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield pa.RecordBatch.from_pylist([r | {asker: row["at"]} for r in add(row["parts"])], schema)

    table, sums = _answered(held.mapInArrow(ask, asked.schema), answer, asker, buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            first, n = row["at"] >> shift << shift, len(row["parts"])
            yield pa.RecordBatch.from_arrays([pa.array([p[asker] for p in row["parts"]], pa.int64()), pa.array([first] * n, pa.int64()), pa.array(split(first, row["parts"], row["answers"], sums), pa.binary())], [asker, "from", "payload"])

    dealt = held.join(table.withColumnRenamed(asker, "at"), "at").mapInArrow(deal, f"{asker} bigint, from bigint, payload binary")
    out = common.bucketed(dealt.groupBy(asker).agg(F.sort_array(F.collect_list(F.struct("from", "payload"))).alias("answers")), asker, buckets)
    common.dropped(held)
    common.dropped(table)
    return out, sums


def _unique(keys: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the places of the given ones among them."""
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _ascending(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _word_rows(keys: np.ndarray, count: np.ndarray, buckets: int, shift: int = 0) -> list[dict]:
    """Words and their counts for buckets, or for ranges of 2 ** shift buckets."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) >> shift
    return [{"bucket": b, "keys": pack(_steps(keys[x:y])), "count": pack(count[x:y])} for b, x, y in _runs(bucket)]


def _added_words(buckets: int) -> Callable[[list[dict]], list[dict]]:
    def add(parts: list[dict]) -> list[dict]:
        keys, places = _unique([_ascending(p["keys"]) for p in parts])
        return _word_rows(keys, _sum(np.concatenate(places), np.concatenate([unpack(p["count"]) for p in parts]), len(keys)), buckets)

    return add


def _split_words(first: int, parts: list[dict], answers: list[dict], sums: list[int]) -> list[bytes]:
    """Numbers of words from that of the range's first bucket on, and counts."""
    low = sums[-1]
    told = [_split(a["payload"]) for a in answers]
    ids = np.concatenate([_ascending(t[0]) + np.uint64(a["from"] - first << low) for a, t in zip(answers, told, strict=True)])
    total = np.concatenate([unpack(t[1]) for t in told])
    return [_joined(_steps(ids[p]), total[p]) for p in _unique([_ascending(p["keys"]) for p in parts])[1]]


def _parent_rows(dishes: np.ndarray, dish_tables: np.ndarray, contexts: np.ndarray, customers: np.ndarray, tables: np.ndarray, low: int) -> list[dict]:
    """What the word buckets are told: tables by dish; customers and tables of split restaurants."""
    out: dict[int, dict] = {}
    empty = pack(np.zeros(0))
    for b, x, y in _runs((dishes >> np.uint64(low)).astype(np.int64)):
        out[b] = {"bucket": b, "dishes": pack(_steps(dishes[x:y])), "dish_tables": pack(dish_tables[x:y]), "contexts": empty, "context_customers": empty, "context_tables": empty}
    for b, x, y in _runs((contexts >> np.uint64(low)).astype(np.int64)):
        row = out.setdefault(b, {"bucket": b, "dishes": empty, "dish_tables": empty})
        row |= {"contexts": pack(_steps(contexts[x:y])), "context_customers": pack(customers[x:y]), "context_tables": pack(tables[x:y])}
    return [out[b] for b in sorted(out)]


def _added_parent(low: int) -> Callable[[list[dict]], list[dict]]:
    def add(parts: list[dict]) -> list[dict]:
        def added(name: str, *values: str) -> list[np.ndarray]:
            keys, places = _unique([_ascending(p[name]) for p in parts])
            return [keys, *(_sum(np.concatenate(places), np.concatenate([unpack(p[v]) for p in parts]), len(keys)) for v in values)]

        return _parent_rows(*added("dishes", "dish_tables"), *added("contexts", "context_customers", "context_tables"), low)

    return add


def _split_parent(first: int, parts: list[dict], answers: list[dict], sums: list[int]) -> list[bytes]:
    told = [np.concatenate([unpack(x) for x in part]) for part in zip(*(_split(a["payload"]) for a in answers), strict=True)]
    dishes, contexts = (_unique([_ascending(p[name]) for p in parts])[1] for name in ("dishes", "contexts"))
    return [_joined(told[0][d], told[1][d], told[2][c], told[3][c]) for d, c in zip(dishes, contexts, strict=True)]


def _added_pairs(parts: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Bucket within the range, context, dish, count and mark of each pair that a group's askers sent, in order, and the places of theirs."""
    some = [unpack(p["count"]) for p in parts]
    bucket, u, w = (np.concatenate([f(p[c]) for p in parts]) for c, f in (("sub", unpack), ("u", _ascending), ("w", unpack)))
    split = np.concatenate([np.unpackbits(np.frombuffer(p["split"], np.uint8))[: len(c)] for p, c in zip(parts, some, strict=True)])
    order = np.lexsort((w, u, bucket))
    new = np.ones(len(order), bool)
    new[1:] = False
    for x in (bucket, u, w):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    at = order[new]
    return [bucket[at], u[at], w[at], _sum(place, np.concatenate(some), len(at)), split[at]], np.split(place, np.cumsum([len(c) for c in some])[:-1])


def _chunk(row: dict, low: int) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """A chunk with the numbers of its words and their counts in all training texts."""
    parts = [_split(a["payload"]) for a in row["answers"]]
    ids = np.concatenate([np.cumsum(unpack(p[0]), dtype=np.uint64) + np.uint64(a["from"] << low) for a, p in zip(row["answers"], parts, strict=True)])
    place = unpack(row["tokens"]).astype(np.int64)
    return Chunk(row["train"], unpack(row["n"]).astype(np.int64), len(ids), place), ids, np.concatenate([unpack(p[1]) for p in parts]).astype(np.int64)


def _joined(*parts: np.ndarray) -> bytes:
    """Arrays of non-negative integers, one after the other."""
    return b"".join(len(x).to_bytes(4, "little") + x for x in map(pack, parts))


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _sum(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place, values.astype(np.float64), n).astype(np.int64)


def _answer_words(bucket: int, rows: list[dict]) -> tuple[list[bytes], list[int]]:
    """Places in the bucket and counts; sums: tokens, distinct words, words seen once and twice, and the bits of a place."""
    keys = [np.cumsum(unpack(r["keys"]), dtype=np.uint64) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = _sum(place, np.concatenate([unpack(r["count"]) for r in rows]), len(every))
    t = total[every != START]
    parts = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    return [_joined(_steps(p), total[p]) for p in parts], [int(t.sum()), int((t > 0).sum()), int((t == 1).sum()), int((t == 2).sum()), 0, len(every).bit_length()]


def _answer_parent(parent: dict, turn: int, low: int) -> Callable[[int, list[dict]], tuple[list[bytes], list[int]]]:
    """Customers and tables of dishes in the parent; customers and tables of split restaurants; sums: the parent's customers and tables."""

    def answer(bucket: int, rows: list[dict]) -> tuple[list[bytes], list[int]]:
        first = np.uint64(bucket << low)

        def added(name: str, *values: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
            keys = [(np.cumsum(unpack(r[name]), dtype=np.uint64) - first).astype(np.int64) if len(r[name]) > 1 else np.zeros(0, np.int64) for r in rows]
            every = np.concatenate(keys)
            n = int(every.max()) + 1 if len(every) else 0
            return keys, [_sum(every, np.concatenate([unpack(r[v]) for r in rows]), n) for v in values]

        dishes, (customers,) = added("dishes", "dish_tables")
        contexts, both = added("contexts", "context_customers", "context_tables")
        rng = np.random.default_rng([1, turn, bucket])
        tables = seat(customers, np.full(len(customers), ROOT_STRENGTH + parent["discount"] * max(0, parent["tables"] - 1)), np.full(len(customers), parent["uniform"]), parent["discount"], rng)
        return [_joined(customers[d], tables[d], *(x[c] for x in both)) for d, c in zip(dishes, contexts, strict=True)], [int(customers.sum()), int(tables.sum())] + [0] * (SUMS - 2)

    return answer


def _stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways for n customers to sit at t tables, weighed by the discount."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    for n in range(EXACT):
        with np.errstate(divide="ignore", invalid="ignore"):
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], np.where(t <= n, np.log(np.maximum(n - discount * t, 1e-300)) + out[n, 1:], -np.inf))
    return out


_TABLES: dict[float, np.ndarray] = {}


def seat(customers: np.ndarray, strength: np.ndarray, p: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes, given ``strength`` with the other tables' share and the parent's probabilities ``p``.

    Up to ``EXACT`` customers the draw is exact; further ones come in parties whose new tables are binomial.
    """
    tables = (customers > 0).astype(np.int64)
    if discount not in _TABLES:
        _TABLES[discount] = _stirling(discount)
    ways = _TABLES[discount]
    size = np.minimum(customers, EXACT)
    order = np.argsort(size, kind="stable")
    for n, x, y in _runs(size[order]):
        if n < 2:
            continue
        for k in range(x, y, max(1, 1_000_000 // n)):
            rows = order[k : min(y, k + max(1, 1_000_000 // n))]
            w = np.log(strength[rows, None] + discount * np.arange(n))
            np.cumsum(w, 1, out=w)
            w += np.log(p[rows])[:, None] * np.arange(1, n + 1) + ways[n, 1 : n + 1]
            w = np.exp(w - w.max(1, keepdims=True)).cumsum(1)
            tables[rows] = 1 + (w < (rng.random(len(rows)) * w[:, -1])[:, None]).sum(1)
    at = np.flatnonzero(customers > EXACT)
    i = EXACT
    while len(at):
        party, t = np.minimum(i // 16, customers[at] - i), tables[at]
        new = (strength[at] + discount * t) * p[at]
        tables[at] += rng.binomial(party, new / (new + i - discount * t))
        i += i // 16
        at = at[customers[at] > i]
    return tables


class Restaurants:
    """The pairs of a bucket, each once, and their seating."""

    def __init__(self, row: dict, discount: float):
        self.bucket, self.discount = row["bucket"], discount
        contexts, split, self.dish_ids, u, w, count = (unpack(x) for x in _split(row["pairs"]))
        self.ids, self.dish_ids = np.cumsum(contexts, dtype=np.uint64), np.cumsum(self.dish_ids, dtype=np.uint64)
        self.split = np.flatnonzero(split)
        self.u, self.w, self.count = np.cumsum(u, dtype=np.uint64).astype(np.int64), w.astype(np.int64), count.astype(np.int64)
        self.tables = unpack(row["tables"]).astype(np.int64) if row.get("tables") else (self.count > 0).astype(np.int64)
        self.customers = _sum(self.u, self.count, len(self.ids))
        self.held = _sum(self.u, self.tables, len(self.ids))

    def asks(self, low: int) -> list[dict]:
        """What word buckets of 2 ** low places are told."""
        customers, tables = _sum(self.u, self.count, len(self.ids)), _sum(self.u, self.tables, len(self.ids))
        return _parent_rows(self.dish_ids, _sum(self.w, self.tables, len(self.dish_ids)), self.ids[self.split], customers[self.split], tables[self.split], low)

    def hear(self, answers: list[dict], parent: dict) -> None:
        """Take the parent's probabilities and the totals of split restaurants."""
        customers, tables, context_customers, context_tables = (np.concatenate([unpack(x) for x in part]).astype(np.int64) for part in zip(*(_split(a["payload"]) for a in answers), strict=True))
        new = (ROOT_STRENGTH + parent["discount"] * parent["tables"]) * parent["uniform"]
        self.parent_p = (customers - parent["discount"] * tables + new) / (ROOT_STRENGTH + parent["customers"])
        self.customers[self.split], self.held[self.split] = context_customers, context_tables

    def sweep(self, rng: np.random.Generator) -> None:
        """Seat every dish again, in groups."""
        for colour in range(COLOURS):
            at = np.flatnonzero((self.count > 1) & (self.w % COLOURS == colour))
            others = self.held[self.u[at]] - self.tables[at]
            new = seat(self.count[at], STRENGTH + self.discount * others, self.parent_p[self.w[at]], self.discount, rng)
            self.held += _sum(self.u[at], new, len(self.ids)) - _sum(self.u[at], self.tables[at], len(self.ids))
            self.tables[at] = new

    def predictive(self) -> np.ndarray:
        """Probability of each pair's word after its context."""
        new = (STRENGTH + self.discount * self.held[self.u]) * self.parent_p[self.w]
        return (self.count - self.discount * self.tables + new) / (STRENGTH + self.customers[self.u])

    def turn(self, k: int) -> np.ndarray:
        """The sweeps of a round; the mean of their predictive probabilities in the last one."""
        rng = np.random.default_rng([2, k, self.bucket])
        p = np.zeros(len(self.count))
        for _ in range(SWEEPS[k]):
            self.sweep(rng)
            if k == len(SWEEPS) - 1:
                p += self.predictive()
        return p / SWEEPS[k]


def _gathered(bucket: int, rows: list[dict]) -> tuple[dict, list[int]]:
    """A bucket's pairs, each once, and the places of the askers' pairs among them; sums: pairs seen once and twice."""
    u = np.concatenate([np.cumsum(unpack(r["u"]), dtype=np.uint64) for r in rows])
    w = np.concatenate([unpack(r["w"]) for r in rows])
    counts = [unpack(r["count"]) for r in rows]
    ends = np.cumsum([len(c) for c in counts])
    width = int(w.max()).bit_length()
    if int(u.max()).bit_length() + width <= 64:
        numbers, u = None, u << np.uint64(width) | w
    else:  # numbers of so many words that two of them do not fit: those of this bucket do
        numbers, u = np.unique(u, return_inverse=True)
        u = u.astype(np.uint64) << np.uint64(width) | w
    order = np.argsort(u, kind="stable")  # a merge of ascending rows
    u = u[order]
    first = np.concatenate(([True], u[1:] != u[:-1]))
    place = np.empty(len(u), np.int64)
    place[order] = np.cumsum(first) - 1
    pairs = u[first]
    total = _sum(place, np.concatenate(counts), len(pairs))
    u, w = pairs >> np.uint64(width), pairs & np.uint64((1 << width) - 1)
    fresh = np.concatenate(([True], u[1:] != u[:-1]))
    contexts, u = u[fresh], np.cumsum(fresh) - 1
    if numbers is not None:
        contexts = numbers[contexts]
    dishes, w = np.unique(w, return_inverse=True)
    split = np.zeros(len(contexts), np.int64)
    split[u[place]] = np.concatenate([np.unpackbits(np.frombuffer(r["split"], np.uint8))[: len(c)] for r, c in zip(rows, counts, strict=True)])
    held = {"bucket": bucket, "pairs": _joined(_steps(contexts), split, _steps(dishes), _steps(u), w, total), "places": [{"chunk": r["chunk"], "places": pack(_steps(p))} for r, p in zip(rows, np.split(place, ends[:-1]), strict=True)]}
    return held, [int((total == 1).sum()), int((total == 2).sum())]


_ASKS = "array<struct<bucket:bigint,dishes:binary,dish_tables:binary,contexts:binary,context_customers:binary,context_tables:binary>>"
_ASK = pa.list_(pa.struct([("bucket", pa.int64()), *((c, pa.binary()) for c in ("dishes", "dish_tables", "contexts", "context_customers", "context_tables"))]))
_STATE = pa.schema([("bucket", pa.int64()), ("tables", pa.binary()), ("asks", _ASK)])
#: Logarithms are sent as multiples of its inverse.
_SCALE = 1 << 17


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Callable[[int], bool] = lambda i: zlib.crc32(str(i).encode()) % 5 == 1) -> DataFrame:
    """For every row: id, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    chunks, chunk_buckets, size = _chunks(docs, doc_id, text, held_out)
    kind: DataType = docs.schema[doc_id].dataType
    id_type = to_arrow_type(kind)
    tokens = max(1, size // 6)
    n_words, n_pairs = max(1, tokens // WORDS_PER_BUCKET), max(1, tokens // PAIRS_PER_BUCKET)
    part = PAIRS_PER_BUCKET // 2
    shift, parent_shift = _shift(chunks.count()), _shift(n_pairs)

    def ask_words(batches):
        for r in _rows(batches):
            out = [x | {"chunk": r["chunk"]} for x in _word_rows(np.frombuffer(r["words"], np.uint64), unpack(r["count"]), n_words, shift)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("count", pa.binary())]))

    asked = chunks.select("chunk", "words", "count").mapInArrow(ask_words, "bucket bigint, chunk bigint, keys binary, count binary")
    counts, (total, distinct, once, twice, _, low) = _answered_in_groups(asked, _answer_words, "chunk", chunk_buckets, shift, _added_words(n_words), _split_words)
    known = chunks.join(counts, "chunk")

    pair_schema = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), *((c, pa.binary()) for c in ("u", "w", "count", "split"))])
    pair_fields = "bucket bigint, chunk bigint, u binary, w binary, count binary, split binary"

    def ask_pairs(batches):
        for r in _rows(batches):
            c, ids, seen = _chunk(r, low)
            bucket, order = c.dealt(ids, seen, n_pairs, part, shift)
            bucket, u, w, n, split = bucket[order], ids[c.u[order]], ids[c.w[order]], c.pair_count[order], seen[c.u[order]] >= part
            out = [{"bucket": b, "chunk": r["chunk"], "u": pack(_steps(u[x:y])), "w": pack(w[x:y]), "count": pack(n[x:y]), "split": np.packbits(split[x:y]).tobytes(), **({"sub": pack(bucket[x:y] - (b << shift))} if shift else {})} for b, x, y in _runs(bucket >> shift)]
            yield pa.RecordBatch.from_pylist(out, pair_schema.append(pa.field("sub", pa.binary())) if shift else pair_schema)

    def ask_pairs_in_groups(batches):
        for r in _rows(batches):
            (bucket, u, w, n, split), _ = _added_pairs(r["parts"])
            first = r["at"] >> shift << shift
            yield pa.RecordBatch.from_pylist([{"bucket": first + b, "chunk": r["at"], "u": pack(_steps(u[x:y])), "w": pack(w[x:y]), "count": pack(n[x:y]), "split": np.packbits(split[x:y]).tobytes()} for b, x, y in _runs(bucket.astype(np.int64))], pair_schema)

    def gather(batches):
        for (bucket,), rows in common.grouped(batches, ["bucket"]):
            held, sums = _gathered(bucket, list(rows))
            held |= {"asks": Restaurants(held, 0.5).asks(low + parent_shift), "once": sums[0], "twice": sums[1]}
            yield pa.RecordBatch.from_pylist([held], pa.schema([("bucket", pa.int64()), ("pairs", pa.binary()), ("places", pa.list_(pa.struct([("chunk", pa.int64()), ("places", pa.binary())]))), ("asks", _ASK), ("once", pa.int64()), ("twice", pa.int64())]))

    asked = known.select("chunk", "train", "n", "tokens", "answers").mapInArrow(ask_pairs, pair_fields + (", sub binary" if shift else ""))
    if shift:
        held_pairs = _held(asked, "chunk", shift, chunk_buckets)
        asked = held_pairs.mapInArrow(ask_pairs_in_groups, pair_fields)
    gathered = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, f"bucket bigint, pairs binary, places array<struct<chunk:bigint,places:binary>>, asks {_ASKS}, once bigint, twice bigint")
    pair_buckets = min(n_pairs, common.bucket_count(size))
    pairs = common.bucketed(gathered, "bucket", pair_buckets)
    pairs_once, pairs_twice = pairs.agg(F.coalesce(F.sum("once"), F.lit(0)), F.coalesce(F.sum("twice"), F.lit(0))).first()
    clip = lambda a, b: min(0.95, max(0.1, a / max(1, a + 2 * b)))
    discount = clip(pairs_once, pairs_twice)
    parent = {"discount": clip(once, twice), "uniform": 1 / (distinct + 1), "tables": distinct, "customers": 0}
    state = pairs.select("bucket", "asks", F.lit(None).cast("binary").alias("tables"))

    def heard(answers: DataFrame, *more: str) -> DataFrame:
        return pairs.select("bucket", "pairs", *more).join(state.select("bucket", "tables"), "bucket").join(answers.withColumnRenamed("asker", "bucket"), "bucket")

    for k in range(len(SWEEPS)):
        asked = state.select(F.col("bucket").alias("asker"), F.explode("asks").alias("a")).select("asker", "a.*")
        answers, (customers, tables, *_) = _answered_in_groups(asked, _answer_parent(parent, k, low), "asker", pair_buckets, parent_shift, _added_parent(low), _split_parent)
        parent = parent | {"customers": customers, "tables": tables}
        if k == len(SWEEPS) - 1:
            break

        def turn(batches, parent=parent, k=k):
            for r in _rows(batches):
                held = Restaurants(r, discount)
                held.hear(r["answers"], parent)
                held.turn(k)
                yield pa.RecordBatch.from_pylist([{"bucket": r["bucket"], "tables": pack(held.tables), "asks": held.asks(low + parent_shift)}], _STATE)

        before, state = state, common.bucketed(heard(answers).mapInArrow(turn, f"bucket bigint, tables binary, asks {_ASKS}"), "bucket", pair_buckets)
        common.dropped(answers)
        if k:
            common.dropped(before)

    def finish(batches):
        for r in _rows(batches):
            held = Restaurants(r, discount)
            held.hear(r["answers"], parent)
            logs = np.rint(-np.log10(held.turn(len(SWEEPS) - 1)) * _SCALE).astype(np.uint64)
            for k in range(0, len(r["places"]), 64):
                some = r["places"][k : k + 64]
                yield pa.RecordBatch.from_pylist([{"chunk": x["chunk"], "from": r["bucket"], "payload": pack(logs[np.cumsum(unpack(x["places"]), dtype=np.uint64).astype(np.int64)])} for x in some], pa.schema([("chunk", pa.int64()), ("from", pa.int64()), ("payload", pa.binary())]))

    def finish_in_groups(batches):
        for r in _rows(batches):
            logs = np.concatenate([unpack(a["payload"]) for a in r["logs"]])
            chunk, places = [p["chunk"] for p in r["parts"]], _added_pairs(r["parts"])[1]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([r["at"] >> shift] * len(chunk), pa.int64()), pa.array([pack(logs[p]) for p in places], pa.binary())], ["chunk", "from", "payload"])

    def by_asker(logs: DataFrame, asker: str) -> DataFrame:
        return logs.groupBy(F.col("chunk").alias(asker)).agg(F.sort_array(F.collect_list(F.struct("from", "payload"))).alias("logs"))

    logs = heard(answers, "places").mapInArrow(finish, "chunk bigint, from bigint, payload binary")
    if shift:
        logs = held_pairs.join(by_asker(logs, "at"), "at").mapInArrow(finish_in_groups, "chunk bigint, from bigint, payload binary")
    logs = by_asker(logs, "chunk")

    def judge(batches):
        for r in _rows(batches):
            c, ids, seen = _chunk(r, low)
            _, order = c.dealt(ids, seen, n_pairs, part, shift)
            pair = np.empty(len(order))
            pair[order] = np.concatenate([unpack(a["payload"]) for a in r["logs"]]) / -_SCALE
            n, count = len(c.n_tokens), seen[c.word]
            logs = np.bincount(c.doc, pair[c.pair], n)
            base = np.bincount(c.doc, np.log10((count + 0.5) / (total + 0.5 * (distinct + 1))), n)
            yield pa.RecordBatch.from_arrays([
                pa.array(r["ids"], id_type), pa.array(c.n_tokens), pa.array(np.bincount(c.doc, count > 0, n).astype(np.int64)), pa.array(np.full(n, total, np.int64)),
                pa.array(base), pa.array(logs), pa.array(10 ** np.minimum(300.0, -logs / c.n_tokens)),
            ], ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    wanted = known.select("chunk", "ids", "train", "n", "tokens", "answers").join(logs, "chunk")
    return wanted.mapInArrow(judge, f"id {kind.simpleString()}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; rows whose crc32 leaves 1 modulo 5 are held out of training."""
    done = score(common.table(spark, sf_dir, "documents"))
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 1, F.lit(False))
    return done.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
