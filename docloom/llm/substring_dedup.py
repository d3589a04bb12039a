"""Substring dedup: words inside windows that occur elsewhere are removed, with a count-min prefilter.

1. Texts are cut into chunks of whole documents and written once, to a table in the shared folder that is bucketed by
   chunk: every later pass sees the same chunks, and joining them with their answers moves no text.
2. Sketch pass: every window of ``WINDOW`` words is hashed.  Each chunk sends the cells that its windows touch in ``ROWS``
   count-min rows, sorted and delta-coded (about a byte for each window and row), with a flag for "twice in this chunk".
   Rows have eight cells or more for each window of the corpus, however large it is; they are cut into blocks of ``BLOCK``
   cells, which are merged where they meet.  A merged block answers every chunk with one bit for each cell that it sent:
   "twice or more".  So the sketch is nowhere in one place, and its error does not grow with the corpus.
3. Second pass: only windows whose cells all say so can be repeated; the sketch overestimates, so none is lost.  Their
   128-bit fingerprints go to buckets, each chunk sending a fingerprint once with a flag for "twice in this chunk", so that
   a passage that a third of all documents share adds one row a chunk.  Buckets find the fingerprints that occur twice
   and answer with one bit for each.
4. Answers meet their chunks again and the covered words are removed.

Neither what a chunk sends nor what a block or bucket holds grows with the corpus.  Chunks are dealt to groups of about
``GROUP``; above one group, a chunk sends whole ranges of blocks, as many as a single group needs, to its own group, which
merges them, so that a window in every chunk is one entry a group, asks the blocks of a range and passes their bits on.

Windows that are equal by 128 bits count as equal.

Defined results: null and blank texts have no words; texts with fewer words than a window lose nothing; repeated rows are
copies of each other; ids of any type and null ones are kept; a very long text makes a chunk of its own; other columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common

WINDOW, ROWS = 35, 2
CHUNK = 3_000_000
#: Cells of a sketch row for each window at least, and cells that are merged together.
CELLS, BLOCK = 8, 1 << 24
LEAST_BITS = 16
PER_BUCKET = 1_000_000
#: Chunks whose cells and fingerprints are merged before they meet those of other chunks.
GROUP = 16_384
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> np.uint64(29))


def _windows(texts: list[bytes], size: int, both: bool) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray | None]:
    """Words of texts, positions of all windows in the joined words, and one or two 64-bit hashes of each window."""
    words = [t.split() for t in texts]
    n = np.fromiter(map(len, words), np.int64, len(words))
    total = int(n.sum())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in words for w in ws), np.uint64, total)
    m = max(0, total - size + 1)
    starts = np.cumsum(n) - n
    inside = np.zeros(m + 1, np.int64)
    some = n >= size
    np.add.at(inside, starts[some], 1)
    np.add.at(inside, starts[some] + n[some] - size + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:m]))

    def roll(x: np.ndarray, base: np.uint64) -> np.ndarray:
        out = np.zeros(m, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out *= base
                out += x[k : k + m]
        return _mix(out[at])

    return words, at, roll(h, _A), roll(_mix(h), _B) if both else None


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of windows in a row of the sketch with 2 ** bits cells."""
    return (h if not row else _mix(h + np.uint64(row))) >> np.uint64(64 - bits)


def _pack(sorted_cells: np.ndarray, low: int = 32) -> bytes:
    """Delta-coded integers of ``low`` bits in four byte planes, eight above 32 bits, of which the upper ones are mostly zero."""
    wide = np.uint64 if low > 32 else np.uint32
    return np.diff(sorted_cells, prepend=0).astype(wide).view(np.uint8).reshape(-1, wide().itemsize).T.tobytes()


def _unpack(data: bytes, low: int = 32) -> np.ndarray:
    wide = np.uint64 if low > 32 else np.uint32
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(wide().itemsize, -1).T).view(wide).ravel().cumsum(dtype=np.int64)


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n].astype(bool)


def _runs(groups: np.ndarray) -> list[tuple[int, int, int]]:
    """(group, start, end) of each run of equal values."""
    if not len(groups):
        return []
    edges = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))).tolist()
    return list(zip(groups[edges].tolist(), edges, [*edges[1:], len(groups)], strict=True))


def _asked_cells(chunk: int, h: np.ndarray, bits: int, low: int) -> list[dict]:
    """What a chunk with these window hashes sends to the sketch's blocks of 2 ** low cells, which are numbered through all rows."""
    out = []
    for row in range(ROWS):
        cells = np.sort(_cells(h, row, bits))
        new = np.concatenate((np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1]))
        at = np.flatnonzero(new)
        twice = np.diff(at, append=len(cells)) > 1
        cells = cells[at].astype(np.int64) + (row << bits)
        out += [{"block": b, "chunk": chunk, "cells": _pack(cells[x:y] - (b << low), low), "twice": np.packbits(twice[x:y]).tobytes()} for b, x, y in _runs(cells >> low)]
    return out


def _answered_cells(rows: list[dict], low: int) -> list[bytes]:
    """For each chunk's cells of a block, one bit: whether the merged cell was seen twice or more."""
    once, twice = np.zeros(1 << low, bool), np.zeros(1 << low, bool)
    cells = [_unpack(r["cells"]) for r in rows]
    for r, c in zip(rows, cells, strict=True):
        twice[c[once[c] | np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: len(c)].astype(bool)]] = True
        once[c] = True
    return [np.packbits(twice[c]).tobytes() for c in cells]


def _suspects(texts: list[bytes], size: int, bits: int, low: int, answers: list[dict]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words, positions of the windows that the sketch takes for repeated, and their fingerprints."""
    words, at, h, g = _windows(texts, size, True)
    good = np.ones(len(at), bool)
    said = {a["block"]: np.unpackbits(np.frombuffer(a["bits"], np.uint8)) for a in answers}
    for row in range(ROWS):
        cells, place = np.unique(_cells(h, row, bits), return_inverse=True)
        blocks = (cells.astype(np.int64) + (row << bits)) >> low
        if len(cells):
            good &= np.concatenate([said[b][: y - x] for b, x, y in _runs(blocks)]).astype(bool)[place]
    keys = np.empty(int(good.sum()), _KEY)
    keys["h"], keys["g"] = h[good], g[good]
    return words, at[good], keys


def _buckets(keys: np.ndarray, buckets: int, shift: int = 0) -> list[tuple[int, int, int]]:
    """(bucket, start, end) in ascending fingerprints: buckets are ranges of the first half; those of 2 ** shift buckets, if given."""
    return _runs(((keys["h"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) >> shift)


_KEY = [("h", np.uint64), ("g", np.uint64)]
_ASKED = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
_ASKED_DDL = "bucket bigint, chunk bigint, keys binary, twice binary"


def _together(keys: list[np.ndarray], flags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, whether each was seen twice, and where each of the given ones lies among them."""
    every = np.concatenate(keys)
    order = np.lexsort((every["g"], every["h"])) if every.dtype.names else np.argsort(every, kind="stable")
    s = every[order]
    place = np.empty(len(s), np.int64)
    new = np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1]))
    place[order] = np.cumsum(new) - 1
    twice = np.bincount(place, minlength=int(new.sum())) > 1
    twice[place[np.concatenate(flags)]] = True
    return s[new], twice, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def _relayed(asked: DataFrame, groups: int, tables: int, load: Callable, split: Callable, answered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers to ``asked``, whose buckets are ranges, by way of groups of chunks.

    A group holds what its chunks sent of a range, each key once, asks the range's buckets in its own name and deals their bits
    to its chunks.  ``load`` turns sent bytes into keys, ``split`` a range's keys into rows for its buckets.
    """
    at = F.col("bucket") * groups + F.pmod(F.xxhash64("chunk"), F.lit(groups))
    held = common.bucketed(asked.groupBy(at.alias("at")).agg(F.collect_list(F.struct("chunk", "keys", "twice")).alias("parts")), "at", tables)

    def merged(row: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        keys = [load(p["keys"]) for p in row["parts"]]
        return _together(keys, [_flags(p["twice"], len(k)) for p, k in zip(row["parts"], keys, strict=True)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from batch.slice(k, 1).to_pylist()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            keys, twice, _ = merged(row)
            out = [{"bucket": b, "chunk": row["at"], "keys": k, "twice": np.packbits(twice[x:y]).tobytes()} for b, x, y, k in split(row["at"] // groups, keys)]
            yield pa.RecordBatch.from_pylist(out, _ASKED)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(batches):
            keys, _, places = merged(row)
            runs = split(row["at"] // groups, keys)
            bits = np.concatenate([_flags(a["bits"], y - x) for a, (_, x, y, _) in zip(row["answers"], runs, strict=True)])
            chunk = [p["chunk"] for p in row["parts"]]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([row["at"] // groups] * len(chunk), pa.int64()), pa.array([np.packbits(bits[p]).tobytes() for p in places], pa.binary())], ["chunk", "bucket", "bits"])

    back = answered(held.mapInArrow(ask, _ASKED_DDL)).groupBy(F.col("chunk").alias("at")).agg(F.sort_array(F.collect_list(F.struct("bucket", "bits"))).alias("answers"))
    return held.join(back, "at").mapInArrow(deal, "chunk bigint, bucket bigint, bits binary")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Id, n_words, n_removed and the kept words, joined by one blank, of every row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(common.slices(batches, "text", CHUNK)):
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([batch.column("id").to_pylist()], pa.list_(to_arrow_type(kind))), pa.array([common.column_bytes(batch, "text")], pa.list_(pa.binary()))], ["chunk", "ids", "texts"])

    total = rows.select(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_tables = common.bucket_count(total)
    chunks = common.bucketed(rows.mapInArrow(cut, f"chunk bigint, ids array<{kind.simpleString()}>, texts array<binary>"), "chunk", n_tables)
    n = total // 6  # words have some six bytes with the blank behind them
    bits = max(LEAST_BITS, int(CELLS * n).bit_length())
    low = min(bits, BLOCK.bit_length() - 1)
    buckets = max(1, n // PER_BUCKET)
    shift = max(0, -(-chunks.count() // GROUP) - 1).bit_length()  # of the number of groups, a power of two
    high = min(bits, low + shift)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts"), strict=True):
                out = _asked_cells(chunk, _windows(texts.as_py(), size, False)[2], bits, high)
                if out:
                    yield pa.RecordBatch.from_pylist([{"bucket": r["block"], "chunk": chunk, "keys": r["cells"], "twice": r["twice"]} for r in out], _ASKED)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block,), held in common.grouped(batches, ["bucket"]):
            some = [r | {"cells": r["keys"]} for r in held]
            yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in some], pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array(_answered_cells(some, low), pa.binary())], ["chunk", "bucket", "bits"])

    def blocks(span: int, cells: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        first = span << high - low
        return [(first + b, x, y, _pack(cells[x:y] - (b << low))) for b, x, y in _runs(cells >> low)]

    def by_bucket(asked: DataFrame, answer: Callable) -> DataFrame:
        return asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "chunk bigint, bucket bigint, bits binary")

    def answers(asked: DataFrame, answer: Callable, load: Callable, split: Callable) -> DataFrame:
        if not shift:
            return by_bucket(asked, answer)
        return _relayed(asked, 1 << shift, n_tables, load, split, lambda rows: by_bucket(rows, answer))

    cells = chunks.select("chunk", "texts").mapInArrow(sketch, _ASKED_DDL)
    merged = answers(cells, merge, lambda data: _unpack(data, high), blocks)
    said = common.bucketed(merged.groupBy("chunk").agg(F.collect_list(F.struct(F.col("bucket").alias("block"), "bits")).alias("cells")), "chunk", n_tables)
    sketched = chunks.join(said, "chunk", "left")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts, said_cells in zip(batch.column("chunk").to_pylist(), batch.column("texts"), batch.column("cells"), strict=True):
                keys, counts = np.unique(_suspects(texts.as_py(), size, bits, high, said_cells.as_py() or [])[2], return_counts=True)
                out = [{"bucket": b, "chunk": chunk, "keys": keys[x:y].tobytes(), "twice": np.packbits(counts[x:y] > 1).tobytes()} for b, x, y in _buckets(keys, buckets, shift)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ASKED)

    def fingerprints(data: bytes) -> np.ndarray:
        return np.frombuffer(data, _KEY)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), rows in common.grouped(batches, ["bucket"]):
            chunk, keys, flags = [], [], []
            for r in rows:
                chunk.append(r["chunk"])
                keys.append(fingerprints(r["keys"]))
                flags.append(_flags(r["twice"], len(keys[-1])))
            _, twice, places = _together(keys, flags)
            masks = [np.packbits(twice[p]).tobytes() for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([bucket] * len(chunk), pa.int64()), pa.array(masks, pa.binary())], ["chunk", "bucket", "bits"])

    def ranges(span: int, keys: np.ndarray) -> list[tuple[int, int, int, bytes]]:
        return [(b, x, y, keys[x:y].tobytes()) for b, x, y in _buckets(keys, buckets)]

    asked = sketched.select("chunk", "texts", "cells").mapInArrow(ask, _ASKED_DDL)
    found = answers(asked, answer, fingerprints, ranges)
    by_chunk = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", F.col("bits").alias("mask")))).alias("masks"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, column, cells, masks in zip(batch.column("ids"), batch.column("texts"), batch.column("cells"), batch.column("masks"), strict=True):
                texts = column.as_py()
                words, at, found = _suspects(texts, size, bits, high, cells.as_py() or [])
                keys, inverse = np.unique(found, return_inverse=True)
                edges = {b: (x, y) for b, x, y in _buckets(keys, buckets, shift)}
                repeated = np.zeros(len(keys), bool)
                for m in masks.as_py() or ():
                    x, y = edges[m["bucket"]]
                    repeated[x:y] = np.unpackbits(np.frombuffer(m["mask"], np.uint8))[: y - x].astype(bool)
                total = sum(map(len, words))
                cover = np.zeros(total + 1, np.int64)
                hit = at[repeated[inverse]]
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + size, -1)
                gone = np.cumsum(cover[:total]) > 0
                removed, kept, start = [], [], 0
                for ws in words:
                    g = gone[start : start + len(ws)]
                    start += len(ws)
                    k = int(g.sum())
                    removed.append(k)
                    kept.append(b" ".join(ws if not k else [w for w, x in zip(ws, g.tolist(), strict=True) if not x]))
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), to_arrow_type(kind)), pa.array(list(map(len, words)), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])

    return sketched.join(by_chunk, "chunk", "left").select("ids", "texts", "cells", "masks").mapInArrow(remove, f"id {kind.simpleString()}, n_words bigint, n_removed bigint, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start anywhere else as well."""
    done = dedup(common.table(spark, sf_dir, "documents"))
    return done.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS ws FROM documents),
w AS (SELECT r, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS s FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 34)) AS i FROM d)),
x AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT r, pos FROM (SELECT r, unnest(generate_series(i, i + 34)) AS pos FROM x)),
g AS (SELECT r, list(pos) AS gone, count(*) AS n FROM c GROUP BY r),
k AS (SELECT d.r, string_agg(ws[p], ' ' ORDER BY p) AS kept FROM (SELECT r, ws, unnest(generate_series(1, len(ws))) AS p FROM d) AS d ANTI JOIN c ON c.r = d.r AND c.pos = d.p GROUP BY d.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r) LEFT JOIN k USING (r)
"""
