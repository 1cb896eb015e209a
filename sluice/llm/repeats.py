"""Finding every repeated window of a corpus, of a fixed number of units (bytes or words), exactly.

The text moves little; batches of documents and buckets of keys exchange
messages instead:

1. Documents are packed into batches (written once, compressed). Documents
   whose whole content another one with a smaller id has are set aside: all
   their windows are repeats.
2. A window's key is the smallest hash of its k-grams, so equal windows have
   equal keys, and consecutive windows mostly share one: a batch sends its
   distinct keys, sorted and coded by their differences, to the keys' buckets.
   A bucket answers, one bit a key, which ones occur elsewhere too. Keys that
   don't, and the windows under them, are done.
3. For the others a batch sends the distinct stretches of text that share a
   key, each with its first place. The bucket finds the first place of every
   window in them (``resolve``, where the operators differ) and answers with
   it, window by window.
4. Each batch marks what its documents repeat.

A key under which very many stretches stand (a common line in ever different
company) is sent window by window, dealt by the hash of the window, so no
bucket grows with a single key; and a batch sends what it holds many times
once. Messages are rows (bucket or batch, bytes).

Rows without id come after all others: they may repeat others, but none
repeats them.
"""
from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import MAX_LONG, stage, text_buffers

BATCH = 2 << 20         # bytes of text in a batch (a longer document is a batch of its own)
PIECE = 256 << 10       # bytes whose hashes are held at once
KEY_BITS = 48           # of a window's key; equal keys of different windows only cost time
SALTS = 8               # keys that the documents of one content are dealt over
HOT = 4096              # stretches under one key that are sent window by window
PACKED = "batch long, docs long, size long, ids binary, nulls binary, lens binary, digests binary, blob binary"
MESSAGE = "bucket long, batch long, data binary"
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit name of pairs of 64-bit names."""
    h = a * _A
    h ^= ((b << np.uint64(31)) | (b >> np.uint64(33))) * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def names(x: np.ndarray, length: int, known: int = 1) -> np.ndarray:
    """Names of the strings of ``length`` units at each position by prefix doubling, from names of ``known`` units."""
    while known < length:
        step = min(known, length - known)
        if len(x) <= step:
            return x[:0]
        x = mix(x[:-step], x[step:])
        known += step
    return x


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, growing with the key: from its top 32 bits, so that the product stays within 64 for up to 2**32 buckets."""
    return (((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def byte_names(raw: np.ndarray, length: int) -> np.ndarray:
    x, known = raw.astype(np.uint64), 1
    while known < 8 and known * 2 <= length and len(x) > known:
        x = x[:-known] | (x[known:] << np.uint64(8 * known))    # up to 8 bytes are their own name
        known *= 2
    return names(x, length, known)


def sliding(x: np.ndarray, width: int, least: np.ufunc = np.minimum) -> np.ndarray:
    known = 1
    while known < width and len(x):
        step = min(known, width - known)
        x = least(x[:-step], x[step:]) if len(x) > step else x[:0]
        known += step
    return x


def pack(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
        z = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        out.append(struct.pack("<2sqq", a.dtype.str[1:].encode(), len(a), len(z)) + z)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        kind, n, z = struct.unpack_from("<2sqq", data, at)
        at += struct.calcsize("<2sqq")
        dtype = np.dtype("<" + kind.decode())
        raw = pa.decompress(data[at:at + z], n * dtype.itemsize, codec="zstd", asbytes=True) if z else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += z
    return out


class Piece:
    """Some documents of a batch: unit offsets, k-gram names, and the bytes of ranges of units."""

    def __init__(self, raw: bytes, lens: np.ndarray):
        self.raw, self.byte_off = raw, np.concatenate(([0], np.cumsum(lens)))
        self.hashes = np.zeros(0, np.uint64)


class Bytes(Piece):
    def __init__(self, raw: bytes, lens: np.ndarray):
        super().__init__(raw, lens)
        self.off = self.byte_off

    def grams(self, k: int) -> np.ndarray:
        return byte_names(np.frombuffer(self.raw, np.uint8), k)

    def byte_range(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lo, hi


class Words(Piece):
    """Documents as words, each followed by a blank."""

    def __init__(self, raw: bytes, lens: np.ndarray):
        super().__init__(raw, lens)
        x = np.frombuffer(raw, np.uint8)
        self.ends = np.flatnonzero(x == 32)
        self.starts = np.concatenate((np.zeros(min(1, len(self.ends)), np.int64), self.ends[:-1] + 1))
        self.off = np.searchsorted(self.ends, self.byte_off)

    def grams(self, k: int) -> np.ndarray:
        eight = byte_names(np.frombuffer(self.raw + b"\0" * 8, np.uint8), 8)
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64), np.zeros(len(size), np.uint64))
        todo, at = np.arange(len(size)), 0
        while len(todo):
            left = np.minimum(size[todo] - at, 8).astype(np.uint64)
            mask = np.where(left == 8, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(7)) * np.uint64(8)) - np.uint64(1))
            h[todo] = mix(h[todo], eight[self.starts[todo] + at] & mask)
            at += 8
            todo = todo[size[todo] > at]
        return names(h, k)

    def byte_range(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[lo], self.ends[hi - 1]


@dataclass(frozen=True)
class Task:
    """What is looked for: windows of ``span`` units, keyed by their k-grams.

    ``within``: a window may repeat one of the same document (an earlier start), else only one of a smaller id."""
    kind: type[Piece]
    span: int
    gram: int
    within: bool
    prepare: Callable[[bytes], bytes]
    bucket: int         # bytes of the corpus for each bucket

    @property
    def width(self) -> int:
        return self.span - self.gram + 1


class Runs:
    """The runs of consecutive windows with one key in a batch's documents (those not in ``skip``)."""

    def __init__(self, task: Task, ids: np.ndarray, lens: np.ndarray, blob: bytes, skip: np.ndarray):
        self.task, self.ids = task, ids
        off = np.concatenate(([0], np.cumsum(lens)))
        live = np.ones(len(ids), bool)
        live[skip] = False
        self.pieces, cols = [], []
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PIECE, side="right")) - 1)
            piece = task.kind(blob[off[lo]:off[hi]], lens[lo:hi])
            doc, *rest = self._of(piece, live[lo:hi])
            cols.append([np.full(len(doc), len(self.pieces), np.int64), doc + lo, *rest])
            self.pieces.append((lo, piece))
            lo = hi
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, bool)
        self.piece, self.doc, self.lo, self.n, self.key, self.again = (np.concatenate([c[i] for c in cols]) if cols else np.zeros(0, t) for i, t in enumerate(kinds))
        self.keys, self.back, self.count = np.unique(self.key, return_inverse=True, return_counts=True)

    def _of(self, piece: Piece, live: np.ndarray) -> list[np.ndarray]:
        """Of each run: document, first window, number of windows, key, whether one of its windows repeats another."""
        t, none = self.task, np.zeros(0, np.int64)
        end = np.where(live, np.maximum(piece.off[1:] - t.span + 1, piece.off[:-1]), piece.off[:-1])    # of each document's windows
        some = np.flatnonzero(end > piece.off[:-1])
        if not len(some):
            return [none, none, none, none.astype(np.uint64), none.astype(bool)]
        piece.hashes = piece.grams(t.gram)
        key = sliding(piece.hashes, t.width) >> np.uint64(64 - KEY_BITS)
        inside = np.zeros(len(key) + 1, np.int8)
        np.add.at(inside, piece.off[some], 1)
        np.add.at(inside, end[some], -1)
        new = np.cumsum(inside[:-1], dtype=np.int8) > 0
        new[1:] &= key[1:] != key[:-1]
        new[piece.off[some]] = True
        lo = np.flatnonzero(new)
        doc = np.searchsorted(piece.off, lo, side="right") - 1
        n = np.minimum(np.append(lo[1:], len(key)), end[doc]) - lo
        if (n > t.width).any():     # text that repeats itself: pieces of bounded length
            parts = -(-n // t.width)
            step = _steps(parts) * t.width
            lo, doc, n = np.repeat(lo, parts) + step, np.repeat(doc, parts), np.minimum(np.repeat(n, parts) - step, t.width)
        again = np.zeros(len(lo), bool)
        if t.within:    # a window that repeats one of its own run
            w = names(piece.hashes, t.span, t.gram)
            for s in range(1, t.width):
                same = np.flatnonzero(w[s:] == w[:-s])
                again[np.searchsorted(lo, same, side="right") - 1] = True
                again[np.searchsorted(lo, same + s, side="right") - 1] = True
        return [doc, lo, n, key[lo], again]

    def several(self) -> np.ndarray:
        """Whether each distinct key is a repeat within the batch."""
        if self.task.within:
            out = self.count > 1
            out[self.back[self.again]] = True
            return out
        low, high = np.full(len(self.keys), MAX_LONG), np.full(len(self.keys), -MAX_LONG)
        np.minimum.at(low, self.back, self.ids[self.doc])
        np.maximum.at(high, self.back, self.ids[self.doc])
        return low != high

    def position(self, r: np.ndarray) -> np.ndarray:
        """The place of runs in their documents."""
        out = self.lo[r].copy()
        for i, (base, piece) in enumerate(self.pieces):
            mine = self.piece[r] == i
            out[mine] -= piece.off[self.doc[r[mine]] - base]
        return out

    def window_names(self, r: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Names of single windows: of runs r, at units ``at`` of their pieces."""
        t, out = self.task, np.zeros(len(r), np.uint64)
        for i in np.unique(self.piece[r]):
            mine, g = self.piece[r] == i, self.pieces[i][1].hashes
            out[mine] = mix(g[at[mine]], g[at[mine] + t.span - t.gram]) if t.span <= 2 * t.gram else names(g, t.span, t.gram)[at[mine]]
        return out


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the counts, one after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Stretches:
    """The distinct stretches a batch asks about: text, first id and place, bucket; and for each window under a shared key its place in the answer."""

    def __init__(self, runs: Runs, shared: np.ndarray, hot: np.ndarray, buckets: int):
        self.runs, self.span = runs, runs.task.span
        pick = np.flatnonzero(shared[runs.back]) if len(runs.key) else np.zeros(0, np.int64)
        is_hot = hot[runs.back[pick]] if len(pick) else np.zeros(0, bool)
        cold, warm = pick[~is_hot], pick[is_hot]
        step = _steps(runs.n[cold])
        name = runs.window_names(np.repeat(cold, runs.n[cold]), np.repeat(runs.lo[cold], runs.n[cold]) + step)
        at = np.cumsum(runs.n[cold]) - runs.n[cold]
        head = name[at]                                     # a stretch is named by its first window and by all of them in order
        body = np.add.reduceat(mix(name, step.astype(np.uint64)), at) if len(at) else head
        step = _steps(runs.n[warm])
        warm = np.repeat(warm, runs.n[warm])
        name = runs.window_names(warm, runs.lo[warm] + step)
        run, begin = np.concatenate((cold, warm)), np.concatenate((np.zeros(len(cold), np.int64), step))
        n = np.concatenate((runs.n[cold], np.ones(len(warm), np.int64)))
        a = np.concatenate((head, name))
        b = np.concatenate((body, mix(name, np.zeros(len(name), np.uint64))))
        top = np.concatenate((runs.key[cold], name >> np.uint64(64 - KEY_BITS)))
        bucket = bucket_of(top, buckets)
        ids, place = runs.ids[runs.doc[run]], runs.position(run) + begin
        order = np.lexsort((place, ids, b, a, bucket))
        same = lambda x: x[order][1:] != x[order][:-1]
        new = np.concatenate((np.ones(min(1, len(order)), bool), same(bucket) | same(a) | same(b)))
        first = order[new]
        self.entry_run, self.entry_lo, self.size = run[first], runs.lo[run[first]] + begin[first], n[first]
        self.bucket, self.doc, self.pos = bucket[first], ids[first], place[first]
        entry = np.empty(len(order), np.int64)
        entry[order] = np.cumsum(new) - 1
        at = np.cumsum(self.size) - self.size
        self.answer = np.repeat(at[entry], n) + _steps(n)
        self.run, self.step = np.repeat(run, n), np.repeat(begin, n) + _steps(n)

    def messages(self) -> Iterator[tuple[int, bytes]]:
        lens, text = self._texts()
        ends = np.cumsum(lens)
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(lens)), bool), self.bucket[1:] != self.bucket[:-1])))
        for lo, hi in zip(cut, [*cut[1:], len(lens)], strict=True) if len(cut) else ():
            yield int(self.bucket[lo]), pack(lens[lo:hi].astype(np.int32), self.size[lo:hi].astype(np.int32), self.doc[lo:hi], self.pos[lo:hi],
                                             text[ends[lo] - lens[lo]:ends[hi - 1]])

    def _texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the stretches and their bytes, one after the other."""
        lo, hi, piece = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64), self.runs.piece[self.entry_run]
        for i in np.unique(piece):
            mine = piece == i
            lo[mine], hi[mine] = self.runs.pieces[i][1].byte_range(self.entry_lo[mine], self.entry_lo[mine] + self.size[mine] + self.span - 1)
        lens = hi - lo
        to, out = np.cumsum(lens) - lens, np.empty(lens.sum(), np.uint8)
        for i in np.unique(piece):
            mine = np.flatnonzero(piece == i)
            steps = _steps(lens[mine])
            out[np.repeat(to[mine], lens[mine]) + steps] = np.frombuffer(self.runs.pieces[i][1].raw, np.uint8)[np.repeat(lo[mine], lens[mine]) + steps]
        return lens, out


def pack_documents(docs: DataFrame, key: str, text: str, task: Task) -> DataFrame:
    """Write the documents as batches; a row holds many documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, nulls, parts, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            blob = b"".join(parts)
            lens = np.fromiter(map(len, parts), np.int64, len(parts))
            digests = b"".join(blake2b(p, digest_size=16).digest() for p in parts)
            z = pa.compress(blob, codec="zstd", asbytes=True) if blob else b""
            label = blake2b(digests + np.array(ids, np.int64).tobytes() + np.random.default_rng().bytes(16), digest_size=8).digest()
            row = [int.from_bytes(label, "big") >> 1, len(parts), len(blob), np.array(ids, np.int64).tobytes(), np.array(nulls, bool).tobytes(), lens.tobytes(), digests, z]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int64()] * 3 + [pa.binary()] * 5, strict=True)], names=["batch", "docs", "size", "ids", "nulls", "lens", "digests", "blob"])

        for b in batches:
            raw, off = text_buffers(b.column(1))
            for i, k in enumerate(b.column(0).to_pylist()):
                part = task.prepare(raw[off[i]:off[i + 1]].tobytes())
                if parts and size + len(part) > BATCH:
                    yield out()
                    ids, nulls, parts, size = [], [], [], 0
                ids.append(MAX_LONG if k is None else k)
                nulls.append(k is None)
                parts.append(part)
                size += len(part)
        if parts:
            yield out()

    return stage(docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, PACKED), "batches")


def copies(packed: DataFrame) -> DataFrame:
    """(batch, skip): the documents of a batch whose whole content another document with a smaller id has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, ids, digests in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(ids) // 8
                yield pa.RecordBatch.from_arrays([pa.array([digests[16 * i:16 * i + 16] for i in range(n)], pa.binary()), pa.array(np.frombuffer(ids, np.int64)), pa.array(np.full(n, batch)), pa.array(np.arange(n))],
                                                 names=["digest", "id", "batch", "at"])

    each = stage(packed.select("batch", "ids", "digests").mapInArrow(run, "digest binary, id long, batch long, at long"), "digests")
    first = each.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select(F.col("digest").alias("d"), "first")
    # One content may make up a third of all documents: its rows are dealt over SALTS keys.
    first = first.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    each = each.withColumn("salt", F.pmod(F.xxhash64("batch", "at"), F.lit(SALTS)).cast("int"))
    later = each.join(first, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")) & (F.col("id") > F.col("first")))
    return stage(later.groupBy("batch").agg(F.collect_list("at").alias("skip")), "copies")


def _runs(task: Task, row: dict) -> Runs:
    lens = np.frombuffer(row["lens"], np.int64)
    blob = pa.decompress(row["blob"], row["size"], codec="zstd", asbytes=True) if row["size"] else b""
    return Runs(task, np.frombuffer(row["ids"], np.int64), lens, blob, np.array(row["skip"] or [], np.int64))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _message(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "batch", "data"])


def _flags(row: dict, field: str = "flags") -> tuple[np.ndarray, np.ndarray]:
    """The answers about a batch's keys, in order: shared, hot."""
    parts = [unpack(m["data"]) for m in sorted(row[field] or [], key=lambda m: m["bucket"])]
    bits = lambda i: np.concatenate([np.unpackbits(p[i], count=int(p[2][0])) for p in parts]).astype(bool) if parts else np.zeros(0, bool)
    return bits(0), bits(1)


def _answer_keys(group: pd.DataFrame) -> pd.DataFrame:
    """Which keys of a bucket occur more than once, and which under more than HOT runs."""
    parts = [unpack(d) for d in group["data"]]
    keys = np.concatenate([np.cumsum(p[0]) for p in parts])
    several = np.concatenate([np.unpackbits(p[1], count=len(p[0])) for p in parts])
    n = np.concatenate([p[2] for p in parts]).astype(np.int64)
    _, back, seen = np.unique(keys, return_inverse=True, return_counts=True)
    shared = (seen > 1) | (np.bincount(back, several) > 0)
    hot = shared & (np.bincount(back, n) > HOT)
    out, at = [], 0
    for p in parts:
        mine = back[at:at + len(p[0])]
        out.append(pack(np.packbits(shared[mine]), np.packbits(hot[mine]), np.array([len(mine)], np.int64)))
        at += len(mine)
    return pd.DataFrame({"bucket": group["bucket"], "batch": group["batch"], "data": out})


def _by_batch(messages: DataFrame, name: str) -> DataFrame:
    return messages.groupBy(F.col("batch").alias("to")).agg(F.collect_list(F.struct("bucket", "data")).alias(name))


Resolver = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def find_repeats(docs: DataFrame, key: str, text: str, task: Task, resolve: Resolver, mark: Callable[..., pa.RecordBatch], result: str,
                 buckets: int | None = None) -> DataFrame:
    """Run the exchange. ``resolve``: of the stretches (bytes, lengths, window counts, first ids, first places) each window's first id and place.
    ``mark``: of a batch (piece, its first document, ids, nulls, removed-window mask per piece, copies) the result's rows.
    ``buckets``: of keys; default: one for every ``task.bucket`` bytes."""
    spark = docs.sparkSession
    packed = pack_documents(docs, key, text, task)
    if buckets is None:
        total = packed.agg(F.sum("size")).first()[0] or 0
        buckets = max(64, -(-total // task.bucket))
    if not 0 < buckets <= 1 << 32:
        raise ValueError(f"{buckets} buckets; at least 1 and at most 2**32 are possible")
    skip = copies(packed)
    whole = packed.drop("digests").join(skip.withColumnRenamed("batch", "b0"), F.col("batch") == F.col("b0"), "left").drop("b0")

    # A function for each row, so that what it holds is gone before the next.
    def keys_of(row: dict) -> pa.RecordBatch:
        runs = _runs(task, row)
        keys, several, n = runs.keys, runs.several(), np.minimum(runs.count, 255).astype(np.uint8)
        of = bucket_of(keys, buckets)
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else []
        return _message([(int(of[a]), row["batch"], pack(np.diff(keys[a:b], prepend=np.uint64(0)), np.packbits(several[a:b]), n[a:b])) for a, b in zip(cut, [*cut[1:], len(of)], strict=True)])

    def ask_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield keys_of(row)

    asked = whole.mapInArrow(ask_keys, MESSAGE)
    flags = stage(_by_batch(asked.groupBy("bucket").applyInPandas(_answer_keys, MESSAGE), "flags"), "flags")
    told = whole.join(flags, F.col("batch") == F.col("to"), "left").drop("to")

    def stretches_of(row: dict) -> pa.RecordBatch:
        return _message([(b, row["batch"], d) for b, d in Stretches(_runs(task, row), *_flags(row), buckets).messages()])

    def ask_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield stretches_of(row)

    def answer_stretches(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(d) for d in group["data"]]
        lens, sizes, doc, pos = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in range(4))
        ends, text = np.cumsum([p[1].astype(np.int64).sum() for p in parts]), np.concatenate([p[4] for p in parts])
        del parts
        first, place = resolve(text, lens, sizes, doc, pos)
        return pd.DataFrame({"bucket": group["bucket"], "batch": group["batch"], "data": [pack(first[a:b], place[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]})

    sent = told.mapInArrow(ask_stretches, MESSAGE)
    firsts = stage(_by_batch(sent.groupBy("bucket").applyInPandas(answer_stretches, MESSAGE), "firsts"), "firsts")
    final = told.join(firsts, F.col("batch") == F.col("to"), "left").drop("to")

    def marked(row: dict) -> Iterator[pa.RecordBatch]:
        runs = _runs(task, row)
        s = Stretches(runs, *_flags(row), buckets)
        got = [unpack(m["data"]) for m in sorted(row["firsts"] or [], key=lambda m: m["bucket"])]
        first, place = (np.concatenate([g[i] for g in got])[s.answer] if got else np.zeros(0, np.int64) for i in (0, 1))
        own, at = runs.ids[runs.doc[s.run]], runs.position(s.run) + s.step
        gone = (first < own) | (task.within & (first == own) & (place < at))
        nulls, copy = np.frombuffer(row["nulls"], bool), np.zeros(row["docs"], bool)
        copy[np.array(row["skip"] or [], np.int64)] = True
        for i, (base, piece) in enumerate(runs.pieces):
            here = gone & (runs.piece[s.run] == i)
            begin = runs.lo[s.run[here]] + s.step[here]
            n = len(piece.byte_off) - 1
            change = np.zeros(piece.off[-1] + 1, np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + task.span, -1)
            removed = np.cumsum(change[:-1]) > 0
            for d in np.flatnonzero(copy[base:base + n]):
                if piece.off[d + 1] - piece.off[d] >= task.span:
                    removed[piece.off[d]:piece.off[d + 1]] = True
            yield mark(piece, runs.ids[base:base + n], nulls[base:base + n], removed)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from marked(row)

    return final.mapInArrow(finish, result)
