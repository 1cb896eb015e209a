"""Substring dedup with suffix automata of reference shards.

The reference is the corpus before each place: a window of ``threshold`` words
goes if its words also start earlier (in a smaller id, or at an earlier place
of the same document). Only stretches whose windows can occur twice are kept
as reference (``repeats`` does this exchange); they are dealt into shards by
the key their windows share, so that every occurrence of a window meets in one
shard. A shard's automaton is built in the order of the stretches, each
stretch being streamed through it for matching statistics before it is added:
at each word the longest suffix that occurs before. Where that reaches the
threshold, the state of the window names its first place, and the documents'
maximal covered spans are removed.

Shards are sent to the tasks that stream against them, with the stretches
dealt to that shard. To broadcast every shard to all documents would take as
many passes over the corpus as there are shards, which grows with its square.

Edge cases: null and blank texts have no words; a text of fewer words than the
threshold loses none; rows that repeat an id don't take words from each other
at equal places; rows without id may lose words to others but take none from
them; only the named columns are read; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm.repeats import Piece, Task, Words, find_repeats
from sluice.llm.suffix_dedup import spans_of

RESULT = "id long, n_words long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept string, kept_sha256 string"


class SuffixAutomaton:
    """Of several strings of words; each state knows where it first ended."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0

    def start(self) -> None:
        """Begin another string."""
        self.last = 0

    def _split(self, p: int, q: int, word: bytes) -> int:
        """A copy of state q for its strings that end in p's strings and the word."""
        nxt, link, length = self.next, self.link, self.length
        clone = len(link)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        length.append(length[p] + 1)
        self.first.append(self.first[q])
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, word: bytes, end: int) -> None:
        """Extend the current string by a word that stands at ``end``."""
        nxt, link, length = self.next, self.link, self.length
        p = self.last
        q = nxt[p].get(word)
        if q is not None:
            self.last = q if length[q] == length[p] + 1 else self._split(p, q, word)
            return
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[p] + 1)
        self.first.append(end)
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[cur] = q if length[p] + 1 == length[q] else self._split(p, q, word)
        self.last = cur

    def add_and_match(self, words: list[bytes], begin: int, threshold: int) -> list[int]:
        """Add a string whose words stand at begin, begin + 1, ...; of each window of ``threshold`` words
        the place where its first occurrence ends (its own, if there is none before)."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        self.start()
        v, n, out = 0, 0, []
        for i, w in enumerate(words):
            while v and length[link[v]] >= n:      # the state may have been split
                v = link[v]
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            else:
                n = 0
            self.add(w, begin + i)
            if i + 1 >= threshold:
                if n >= threshold:
                    u = v
                    while length[link[u]] >= threshold:
                        u = link[u]
                    out.append(first[u])
                else:
                    out.append(begin + i)
        return out


def _automaton(threshold: int):
    def resolve(text: np.ndarray, lens: np.ndarray, sizes: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every window the id and place of its first occurrence."""
        raw, stop = text.tobytes(), np.cumsum(lens).tolist()
        texts = [raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)] if stop else []
        order = np.lexsort((pos, doc)).tolist()
        automaton, seen = SuffixAutomaton(), {}
        ids, places, ends, at = [], [], [0] * len(texts), 0
        for e in order:                 # equal stretches: the first one's answer
            if texts[e] in seen:
                continue
            seen[texts[e]] = e
            words = texts[e].split(b" ")
            ids.append(np.full(len(words), doc[e]))
            places.append(pos[e] + np.arange(len(words)))
            ends[e] = automaton.add_and_match(words, at, threshold)
            at += len(words)
        end = np.array([x for t in texts for x in ends[seen[t]]], np.int64)
        if not len(end):
            return end, end
        start = end - (threshold - 1)
        return np.concatenate(ids)[start], np.concatenate(places)[start]
    return resolve


def _mark(piece: Piece, ids: np.ndarray, nulls: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
    rows = []
    for i, (lo, hi) in enumerate(zip(piece.byte_off[:-1], piece.byte_off[1:], strict=True)):
        a, b = piece.off[i], piece.off[i + 1]
        gone = removed[a:b]
        kept = piece.raw[lo:hi - 1] if hi > lo else b""
        start, end = spans_of(gone)
        if len(start):
            kept = b" ".join(w for w, g in zip(kept.split(b" "), gone.tolist(), strict=True) if not g)
        rows.append((None if nulls[i] else int(ids[i]), int(b - a), int(gone.sum()), len(start), [{"start": int(x), "end": int(y)} for x, y in zip(start, end, strict=True)], kept.decode(), hashlib.sha256(kept).hexdigest()))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string())
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "n_words", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])


def _as_words(text: bytes) -> bytes:
    words = text.split()
    return b" ".join(words) + b" " if words else b""


def remove_repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 20, buckets: int | None = None) -> DataFrame:
    """Per document: its number of words, the spans of words that windows of ``threshold`` words which also start earlier cover, and the words kept.

    Windows are judged on the input, not on what is left."""
    gram = max(1, threshold * 2 // 5)
    task = Task(Words, threshold, gram, True, _as_words, 1 << 20)
    return find_repeats(docs, key, text, task, _automaton(threshold), _mark, RESULT, buckets).withColumnRenamed("id", key)
