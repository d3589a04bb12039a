"""SentencePiece encoding and decoding by batched Viterbi over numpy arrays.

Texts fall into segments that no piece crosses: a piece has its word marks in front, so a segment starts at a run of
blanks or at a line break.  The distinct segments of a slice are encoded once.  Segments of equal length advance
together, one character a step.  At each position the hashes of the substrings that end there, one for each piece
length, probe the sorted hashes of all pieces; the best transition and its start are kept, and the path is read back.

* Unigram models: a transition adds the piece's score; the path with the largest sum wins.
* BPE models: a transition is allowed or not.  A piece may follow another if merging their joined characters would end in
  exactly these two, which is decided by undoing merges at the seam.  Just one path of allowed transitions exists, and it
  is what merging by rank gives.  Summing a BPE model's scores, which are merge ranks, would give other pieces than the
  model's own for a good part of all words.

A segment above ``LONGEST`` characters is a batch of its own: its substrings are probed all at once, then its positions
advance one by one, with the same transitions and backpointers; none is cut.

Characters without a piece become byte pieces, and so does a literal word mark (U+2581), which the library would turn
into a blank.  ``decode`` therefore gives back every text exactly.

Workers remember the pieces of the segments they met last, within ``MEMORY`` bytes.  ``round_trip`` encodes and decodes in
one worker.

Defined results: null and empty texts have no pieces and decode to an empty text; a very long text or word is encoded
whole; repeated rows are encoded one by one; columns are kept, those named like an output are replaced; an empty table
gives no rows; models with a character map are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
import sys
from collections.abc import Callable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK, LITERAL = "▁", "\ud800"  # a lone surrogate cannot occur in UTF-8 text
LONGEST = 48
#: Bytes of segments and their pieces that a worker remembers.
MEMORY = 160_000_000
#: Bits of a hash that a first look compares, and of the table of seams that were decided before.
SHORT, SEAMS = 20, 20
#: Bytes of text that are encoded together.
SLICE = 2_000_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NORMAL, _BYTE = 1, 6


def default_model() -> str:
    """The installed public model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field number and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Memory:
    """Segments met lately and their pieces, in two generations of about half of ``MEMORY`` bytes each."""

    def __init__(self) -> None:
        self.young, self.old, self.held = {}, {}, 0

    def pieces(self, found: set[str], make: Callable[[list[str]], list[bytes]]) -> dict[str, bytes]:
        """A dictionary that has the pieces of the segments; ``make`` is asked for those that are not remembered."""
        if self.held > MEMORY // 2:
            self.old, self.young, self.held = self.young, {}, 0
        missing = found - self.young.keys()
        again = missing & self.old.keys()
        new = list(missing - again)
        more = {s: self.old[s] for s in again}
        more.update(zip(new, make(new), strict=True))
        self.held += sum(map(sys.getsizeof, more)) + sum(map(sys.getsizeof, more.values())) + 100 * len(more)  # 100: its place in the dictionary
        self.young.update(more)
        return self.young


class Model:
    """Tables of a SentencePiece model; all of them are bounded by its vocabulary."""

    def __init__(self, data: bytes):
        pieces, spec, norm = [], {}, {}
        self.name = xxhash.xxh3_128_hexdigest(data)
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, _NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
            elif field == 3:
                norm = dict(_fields(value))
        if norm.get(2) or not norm.get(3, 1) or norm.get(4, 1):
            raise ValueError("only models that keep texts as they are, with a blank in front, are supported")
        self.bpe = spec.get(3, 1) == 2
        self.pieces = [p for p, _, _ in pieces]
        byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        if len(byte) != 256:
            raise ValueError("only models with byte fallback are supported")
        self.byte = [byte[b] for b in range(256)]
        self.score = np.array([s for _, s, _ in pieces], np.float32)
        self.unknown = float(self.score.min()) - 10 if not self.bpe else 0.0
        self.raw = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(MARK, " ").encode() if kind == _NORMAL else b"" for p, _, kind in pieces]
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses words")
        usable = self.ids
        if self.bpe:
            self._ranks()
            usable = {p: i for p, i in self.ids.items() if self.rank[i] >= 0 and not (len(p) > 1 and set(p) == {MARK})}
        self.longest = max(map(len, usable))
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.longest, _BASE))))
        hashes = np.array([self._hash(p) for p in usable], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.fromiter(usable.values(), np.int64, len(usable))[order]
        assert len(np.unique(self.keys)) == len(self.keys)
        # Most substrings are no pieces; this table of the hashes' upper bits tells so with one look.
        self.maybe = np.zeros(1 << SHORT, bool)
        self.maybe[self.keys >> np.uint64(64 - SHORT)] = True

    def _hash(self, piece: str) -> np.uint64:
        codes = np.array([ord(c) + 1 for c in piece], np.uint64)
        with np.errstate(over="ignore"):
            return (codes * self.power[: len(codes)][::-1]).sum(dtype=np.uint64)

    def _ranks(self) -> None:
        """Merge order of pieces, what each was merged from last, and which neighbours merge."""
        order = sorted(self.ids.values(), key=lambda i: (len(self.pieces[i]) > 1, -self.score[i], i))
        place = {i: k for k, i in enumerate(order)}
        self.rank = np.full(len(self.pieces), -1, np.int64)
        left, right = np.arange(len(order)), np.arange(len(order))
        for p, i in self.ids.items():
            parts = self.merge(p, last=True) if len(p) > 1 else [p]
            if len(p) == 1 or len(parts) == 2 and all(x in self.ids for x in parts):
                self.rank[i] = place[i]
                if len(p) > 1:
                    left[place[i]], right[place[i]] = place[self.ids[parts[0]]], place[self.ids[parts[1]]]
        self.left, self.right, self.n_ranks = left, right, len(order)
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p) if self.rank[i] >= 0 else 1):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None and self.rank[a] >= 0 and self.rank[b] >= 0:
                    pairs[place[a] * len(order) + place[b]] = place[i]
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def merge(self, text: str, last: bool = False) -> list[str]:
        """Pieces by merging the best-ranked neighbours, the leftmost first.  ``last``: the two parts before the final merge."""
        ids, score = self.ids, self.score
        part = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(-float(score[ids[a + b]]), i, a + b) for i, (a, b) in enumerate(zip(part, part[1:])) if a + b in ids]
        heapq.heapify(heap)
        n = len(part)
        two = part[:]
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if part[i] else n
            if not part[i] or j >= n or part[i] + part[j] != joined:
                continue
            two = [part[i], part[j]]
            part[i], part[j] = joined, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := joined + part[after[i]]) in ids:
                    heapq.heappush(heap, (-float(score[ids[x]]), i, x))
            if (h := before[i]) >= 0 and (x := part[h] + joined) in ids:
                heapq.heappush(heap, (-float(score[ids[x]]), h, x))
        out = [p for p in part if p]
        return (two if len(out) == 1 else out) if last else out

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps each pair of ranks apart.  Decided pairs are remembered in a direct-mapped table."""
        if not hasattr(self, "seams"):
            self.seams = np.full(1 << SEAMS, -1, np.int64)  # 2 * pair + verdict
        pair = a * self.n_ranks + b
        slot = ((pair.astype(np.uint64) * _BASE) >> np.uint64(64 - SEAMS)).astype(np.int64)
        known = self.seams[slot]
        good = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != pair)
        if len(new):
            verdict = self._keeps_apart(a[new], b[new])
            good[new] = verdict
            self.seams[slot[new]] = pair[new] * 2 + verdict
        return good

    def _keeps_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges at the seam, latest first, and look for an earlier one across it."""
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        at = np.arange(len(a))
        while len(at):
            key = a * self.n_ranks + b
            k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[k] == key) & (self.pair_ranks[k] < limit)
            good[at[crossed]] = False
            la, lb = self.right[a] != a, self.left[b] != b  # whether there is a merge to undo
            undo_a = la & ((a > b) | ~lb)
            undo_b = lb & ~undo_a
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_b, self.left[b], b)
            go = ~crossed & (undo_a | undo_b)
            at, a, b, limit = at[go], a[go], b[go], limit[go]
        return good

    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Pieces of words of one length, as bytes of 32-bit integers."""
        n, size = len(words), len(words[0])
        chars = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T).astype(np.uint64) + np.uint64(1)
        best = np.full((size + 1, n), -np.inf, np.float32)
        best[0] = 0
        start, piece = np.zeros((size + 1, n), np.int32), np.full((size + 1, n), -1, np.int64)
        with np.errstate(over="ignore"):
            for i in range(1, size + 1):
                rows = np.arange(n)
                h = np.zeros(n, np.uint64)
                for m in range(1, min(i, self.longest) + 1):
                    j = i - m
                    h = h + chars[j][rows] * self.power[m - 1]
                    at = np.flatnonzero(self.maybe[h >> np.uint64(64 - SHORT)])
                    k = np.searchsorted(self.keys, h[at])
                    k[k == len(self.keys)] = 0
                    found = self.keys[k] == h[at]
                    if m == 1:
                        ids = -chars[j].astype(np.int64)  # one was added to the code points
                        ids[at[found]] = self.key_ids[k[found]]
                        at = rows
                    else:
                        at, ids = at[found], self.key_ids[k[found]]
                    here = rows[at]
                    if self.bpe:
                        if j:
                            old = piece[j, here]
                            seam = np.flatnonzero((ids >= 0) & (old >= 0))
                            ok = np.ones(len(here), bool)
                            ok[seam] = self._follows(self.rank[old[seam]], self.rank[ids[seam]])
                            at, here, ids = at[ok], here[ok], ids[ok]
                        best[i, here], start[i, here], piece[i, here] = 0, j, ids
                        # Every prefix has one path, so these rows are through with this position.
                        left = np.ones(len(rows), bool)
                        left[at] = False
                        rows, h = rows[left], h[left]
                        if not len(rows):
                            break
                    else:
                        gain = best[j, here] + np.where(ids >= 0, self.score[ids], np.float32(self.unknown))
                        better = gain >= best[i, here]  # of equal paths, the one whose last piece starts first
                        here, ids, gain = here[better], ids[better], gain[better]
                        best[i, here], start[i, here], piece[i, here] = gain, j, ids
        steps, count = [], np.zeros(n, np.int64)
        at, rows = np.full(n, size), np.arange(n)
        while len(rows):
            steps.append((rows, piece[at[rows], rows]))
            count[rows] = len(steps)
            at[rows] = start[at[rows], rows]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(count)
        flat = np.empty(ends[-1], np.int32)
        for k, (rows, ids) in enumerate(steps):  # the last piece comes first
            flat[ends[rows] - 1 - k] = ids
        return self._bytes(flat, ends)

    def _bytes(self, flat: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Paths that follow each other, as bytes of 32-bit integers; characters without a piece become byte pieces."""
        low = np.flatnonzero(flat < 0)
        if len(low):
            spelled = [[self.byte[b] for b in (MARK if -1 - i == ord(LITERAL) else chr(-1 - i)).encode()] for i in flat[low].tolist()]
            more = np.array([len(x) - 1 for x in spelled])
            ends = ends + np.concatenate(([0], np.cumsum(more)))[np.searchsorted(low, ends)]
            size = np.ones(len(flat), np.int64)
            size[low] += more
            flat = np.repeat(flat, size)
            flat[flat < 0] = np.concatenate(spelled)
        data, at = flat.tobytes(), (4 * ends).tolist()
        return [data[x:y] for x, y in zip([0, *at], at)]

    def _viterbi_alone(self, word: str) -> bytes:
        """Pieces of one long word, like :meth:`_viterbi`: substrings are probed together, positions follow one by one."""
        size = len(word)
        chars = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = np.zeros(size + 1, np.uint64)  # of the substrings of m characters, by their end
        parts = []
        with np.errstate(over="ignore"):
            for m in range(1, min(size, self.longest) + 1):
                h = h[1:] + chars[: size - m + 1] * self.power[m - 1]
                at = np.flatnonzero(self.maybe[h >> np.uint64(64 - SHORT)])
                k = np.searchsorted(self.keys, h[at])
                k[k == len(self.keys)] = 0
                found = self.keys[k] == h[at]
                at, ids = at[found], self.key_ids[k[found]]
                if m == 1:
                    every = -chars.astype(np.int64)
                    every[at] = ids
                    at, ids = np.arange(size), every
                parts.append((at, at + m, ids))
        start, end, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(end, kind="stable")
        start, end, ids = start[order], end[order], ids[order]
        edge = np.searchsorted(end, np.arange(size + 2))
        good: set[int] = set()
        if self.bpe:
            for k in range(0, len(start), 100_000):  # seams of every piece with those that end where it starts
                lo, n = edge[start[k : k + 100_000]], np.diff(edge)[start[k : k + 100_000]]
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                a, b = ids[at], np.repeat(ids[k : k + 100_000], n)
                seam = np.unique((a * len(self.pieces) + b)[(a >= 0) & (b >= 0)])
                a, b = np.divmod(seam, len(self.pieces))
                good.update(seam[self._follows(self.rank[a], self.rank[b])].tolist())
        best, back, piece = [np.float32(0)] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        gain = np.where(ids >= 0, self.score[ids], np.float32(self.unknown)).tolist() if not self.bpe else None
        starts, options, edges, many = start.tolist(), ids.tolist(), edge.tolist(), len(self.pieces)
        for i in range(1, size + 1):
            top = -np.inf
            for k in range(edges[i], edges[i + 1]):
                j, p = starts[k], options[k]
                if self.bpe:
                    if not j or p < 0 or piece[j] < 0 or piece[j] * many + p in good:
                        back[i], piece[i] = j, p
                        break
                elif (value := best[j] + np.float32(gain[k])) >= top:
                    top = best[i] = value
                    back[i], piece[i] = j, p
        out, i = [], size
        while i:
            out.append(piece[i])
            i = back[i]
        return self._bytes(np.array(out[::-1], np.int32), np.array([len(out)]))[0]

    def segments(self, found: list[str]) -> list[bytes]:
        """Piece ids of distinct segments, as bytes of 32-bit integers."""
        cores = found.copy()
        runs = {}  # blanks in front of a core, or -1 for a line break; most segments have one mark and are cores
        for k, s in enumerate(found):
            if s[0] == MARK:
                if s[1:2] in ("", MARK):
                    rest = s.lstrip(MARK)
                    run = len(s) - len(rest)
                    if self.bpe:
                        rest, run = (MARK + rest, run - 1) if rest else ("", run)
                        cores[k], runs[k] = rest, run
            elif s[0] == "\n":
                cores[k], runs[k] = s[1:], -1
        by_size: dict[int, list[str]] = {}
        for c in dict.fromkeys(cores):
            by_size.setdefault(len(c), []).append(c)
        done = {"": b""}
        for size, words in by_size.items():
            if 0 < size <= LONGEST:
                most = max(1, 400_000 // size)
                for k in range(0, len(words), most):
                    some = words[k : k + most]
                    done.update(zip(some, self._viterbi(some), strict=True))
            elif size:
                done.update((w, self._viterbi_alone(w)) for w in words)
        out = [done[c] for c in cores]
        for k, run in runs.items():
            out[k] = self._joined(run, out[k])
        return out

    def _joined(self, run: int, core: bytes) -> bytes:
        """A core's pieces with the blanks or the line break in front."""
        if run < 0:
            return struct.pack("<i", self.byte[10]) + core
        if run:
            # Blanks merge last, from the left, into the longest pieces there are; a mark that no letter took is one of them.
            if core[:4] == struct.pack("<i", self.ids.get(MARK, -1)):
                run, core = run + 1, core[4:]
            blanks = []
            while run:
                size = next(k for k in range(run, 0, -1) if MARK * k in self.ids)
                blanks.append(self.ids[MARK * size])
                run -= size
            core = struct.pack(f"<{len(blanks)}i", *blanks) + core
        return core

    def encode(self, texts: list[str], memory: Memory | None = None) -> list[np.ndarray]:
        """Piece ids of texts."""
        split = []
        for t in texts:
            if MARK in t:
                t = t.replace(MARK, LITERAL)
            split.append(_SEGMENT.findall(MARK + t.replace(" ", MARK)) if t else [])
        here = (Memory() if memory is None else memory).pieces(set(itertools.chain.from_iterable(split)), self.segments)
        return [np.frombuffer(b"".join(map(here.__getitem__, seg)), np.int32) for seg in split]

    def decode(self, ids) -> str:
        """The text of piece ids."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


#: What a Python worker remembers from one task to the next, for the model it used last.
_REMEMBERED: dict[str, Memory] = {}


def remembered(model: Model) -> Memory:
    """This worker's memory for a model."""
    if model.name not in _REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[model.name] = Memory()
    return _REMEMBERED[model.name]


def _load(spark: SparkSession, path: str | None):
    with open(path or default_model(), "rb") as f:  # read on the driver; its tables are broadcast, a few MB for any vocabulary
        return spark.sparkContext.broadcast(Model(f.read()))


def encode(docs: DataFrame, text: str = "text", model: str | None = None, ids: str = "piece_ids") -> DataFrame:
    """``docs`` with the piece ids of its texts: one pass, no shuffle."""
    held = _load(docs.sparkSession, model)

    def make(batch, texts):
        return [held.value.encode([t.decode() for t in texts], remembered(held.value))]

    return common.appended(docs, text, f"{ids} array<int>", make, SLICE)


def decode(df: DataFrame, ids: str = "piece_ids", text: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` with the texts of its piece ids."""
    held = _load(df.sparkSession, model)

    @F.pandas_udf("string")
    def texts(column):
        return column.map(lambda x: "" if x is None else held.value.decode(x.tolist()))

    return df.withColumn(text, texts(F.col(ids)))


def round_trip(docs: DataFrame, text: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with ``piece_ids``, ``n_pieces``, the digest of the text they decode to and whether it is the one they came from.

    Encoding and decoding share a worker, so that only one of them holds the model and decoded texts stay there.
    """
    held = _load(docs.sparkSession, model)

    def make(batch, texts):
        ids = held.value.encode([t.decode() for t in texts], remembered(held.value))
        back = [held.value.decode(x.tolist()).encode() for x in ids]
        return [ids, [len(x) for x in ids], [hashlib.sha256(t).hexdigest() for t in back], [t == b for t, b in zip(texts, back, strict=True)]]

    return common.appended(docs, text, "piece_ids array<int>, n_pieces bigint, decoded_sha256 string, exact boolean", make, SLICE)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents, and whether they decode to the text they came from."""
    return round_trip(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
