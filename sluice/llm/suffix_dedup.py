"""Suffix-array dedup: bytes of substrings that an earlier document has too.

Positions are ranked by prefix doubling: the rank pair of a position and the
one an offset further ranks strings of twice the length, at offsets 1, 2, 4
and so on, until positions are unique or the threshold is passed. Ranks are
64-bit names of the strings, so they hold across the whole corpus without
renumbering. Only positions that can matter go on: of each window the
k-gram of smallest name (k: half the threshold) stands for it, k-grams that
occur once drop out (``repeats`` does this exchange), and for the windows that
remain the pairs (rank of the first half, rank of the second), which pass the
threshold, are sorted; equal pairs are equal strings, and the smallest id
among them is the first to have it.

Sorting takes place in the tasks to which Spark deals the ranks by key. To
shuffle a pair for every byte of the corpus would be some 16 times the text.

Edge cases: null and empty texts have no bytes; a text shorter than the
threshold loses none; documents with one id don't take bytes from each other;
rows without id may lose bytes to others but take none; only the named columns
are read; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.repeats import Bytes, Piece, Task, byte_names, find_repeats

RANKED = 256 << 10      # bytes of stretches ranked at once
RESULT = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string"


def spans_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _rank_pairs(span: int, gram: int):
    def resolve(text: np.ndarray, lens: np.ndarray, sizes: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every window the smallest id among equal ones."""
        stop = np.cumsum(lens)
        a, b, lo, done = np.empty(sizes.sum(), np.uint64), np.empty(sizes.sum(), np.uint64), 0, 0
        while lo < len(lens):       # ranks of some stretches at a time: they take many times the text's memory
            base = stop[lo] - lens[lo]
            hi = max(lo + 1, int(np.searchsorted(stop, base + RANKED, side="right")))
            rank, n = byte_names(text[base:stop[hi - 1]], gram), sizes[lo:hi]
            at = np.repeat(stop[lo:hi] - lens[lo:hi] - base - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a[done:done + len(at)], b[done:done + len(at)] = rank[at], rank[at + span - gram]
            lo, done = hi, done + len(at)
        who = np.repeat(doc, sizes)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = np.minimum.reduceat(who[order], np.flatnonzero(new))
        first = np.empty(len(a), np.int64)
        first[order] = least[np.cumsum(new) - 1]
        return first, np.zeros(len(a), np.int8)
    return resolve


def _mark(piece: Piece, ids: np.ndarray, nulls: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    raw = np.frombuffer(piece.raw, np.uint8)
    rows = []
    for i, (lo, hi) in enumerate(zip(piece.off[:-1], piece.off[1:], strict=True)):
        gone = removed[lo:hi]
        kept = raw[lo:hi][~gone].tobytes()
        start, end = spans_of(gone)
        rows.append((None if nulls[i] else int(ids[i]), int(hi - lo), int(gone.sum()), len(start), [{"start": int(a), "end": int(b)} for a, b in zip(start, end, strict=True)], kept, hashlib.sha256(kept).hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])


def remove_repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 50, buckets: int | None = None) -> DataFrame:
    """Per document: its length in bytes, the spans of bytes that a string of ``threshold`` bytes of a smaller id covers, and what is kept.

    Strings are judged on the input, not on what is left."""
    gram = -(-threshold // 2)
    task = Task(Bytes, threshold, gram, False, lambda t: t, 2 << 20)
    return find_repeats(docs, key, text, task, _rank_pairs(threshold, gram), _mark, RESULT, buckets).withColumnRenamed("id", key)
