"""Ranked lexical search by presence-mask grouping.

Documents are cut into segments. A segment keeps, for every query term, the
documents that hold it as a bitmap, and their term frequencies. For an item
the bitmaps of its terms, side by side, give each document a mask of the terms
it holds; documents with one mask are one group, whose score can't exceed the
sum of its terms' highest contributions in the segment. Groups are scored
exactly by descending bound until the next bound is below the score of the
item's ``top``-th document, so a segment's list is exact; the lists meet in
two rounds of a bounded window.

Scores are integers. A term's weight is floor(1000 ln((2N+2)/(2 df+1))); a
document's contribution of a term is weight * (10^9 tf div (1000 tf + 8 m)),
with m = 25 + 75 n N div L, once for each time the item has the term. N, L and
df count all documents; they are sums over the segments, which are written
once with the frequencies of the query terms alone and read twice.

The query set is cut into blocks of at most ``block_terms`` terms with
repeats, so what goes to the tasks is bounded whatever the number of items (an
item of more terms is a block of its own). Each block takes one pass over the
documents.

Edge cases: a null or empty text has no terms, counts nowhere and is never
found; items without terms, and items none of whose terms any document holds,
have no rows; equal scores go by ascending doc_id, null ids last; rows with
one id or one text are documents of their own; item rows with one id are
ranked each by itself; an empty table gives no rows; only the named columns
are read, so other columns may have any names.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import slices_by_bytes, stage

_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
PIECE = 1 << 20             # bytes of a text whose words are in memory at once
SEGMENT_BYTES = 1 << 21     # text behind one segment (one document at least)
CHUNK = 256                 # documents scored at once
SALT = 32                   # first round of the merge: parts of an item's lists
SEGMENT = "docs long, words long, ids binary, known binary, lengths binary, terms array<int>, dfs array<long>, places binary, counts binary"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    folded, lo = text.translate(_WORD), 0
    while lo < len(folded):
        hi = len(folded) if len(folded) - lo <= PIECE else folded.find(b" ", lo + PIECE)
        hi = len(folded) if hi < 0 else hi
        yield folded[lo:hi].split()
        lo = hi


def term_counts(text: str | None) -> Counter:
    found: Counter = Counter()
    for words in words_of((text or "").encode()):
        found.update(words)
    return found


@dataclass(frozen=True)
class Block:
    """Some of the items: (id, terms, times) each, terms numbered by the block's vocabulary."""
    items: list[tuple[int | None, np.ndarray, np.ndarray]]
    vocabulary: dict[bytes, int]


def item_blocks(items: DataFrame, item_id: str, text: str, block_terms: int) -> Iterator[Block]:
    """The items in blocks: they are read one by one, as term counts, and no more than a block is held."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = sorted(term_counts(t.as_py()).items())
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([[w for w, _ in c]], pa.list_(pa.binary())), pa.array([[n for _, n in c]], pa.list_(pa.int64()))], names=["id", "terms", "times"])

    held, vocabulary, size = [], {}, 0
    rows = items.select(F.col(item_id).cast("long"), F.col(text)).mapInArrow(counts, "id long, terms array<binary>, times array<long>")
    for r in stage(rows, "search-items").orderBy("id").toLocalIterator():
        if held and size + len(r["terms"]) > block_terms:
            yield Block(held, vocabulary)
            held, vocabulary, size = [], {}, 0
        size += len(r["terms"])
        held.append((r["id"], np.array([vocabulary.setdefault(bytes(w), len(vocabulary)) for w in r["terms"]], np.int64), np.array(r["times"], np.int64)))
    if held:
        yield Block(held, vocabulary)


def segment_row(ids: pa.Array, texts: pa.Array, vocabulary: dict[bytes, int]) -> dict:
    """One segment: per document its id and length, per query term its documents and frequencies there."""
    lengths, places, terms, counts = [], [], [], []
    for place, t in enumerate(texts):
        found = term_counts(t.as_py())
        lengths.append(found.total())
        mine = [(vocabulary[w], n) for w, n in found.items() if w in vocabulary]
        places += [place] * len(mine)
        terms += [t for t, _ in mine]
        counts += [n for _, n in mine]
    terms, places, counts, lengths = (np.array(x, np.int64) for x in (terms, places, counts, lengths))
    order = np.lexsort((places, terms))
    held, first, dfs = np.unique(terms[order], return_index=True, return_counts=True)
    return {"docs": int((lengths > 0).sum()), "words": int(lengths.sum()), "ids": ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(),
            "known": np.asarray(ids.is_valid()).astype(np.uint8).tobytes(), "lengths": lengths.tobytes(), "terms": held.tolist(), "dfs": dfs.tolist(),
            "places": places[order].astype(np.int32).tobytes(), "counts": counts[order].tobytes()}


def segments(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """The documents as written segments over the query terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices_by_bytes(batch, 1, SEGMENT_BYTES):
                row = segment_row(b.column(0), b.column(1), shared.value)
                if row["docs"]:
                    yield pa.RecordBatch.from_pylist([row], schema=_SEGMENT_ARROW)

    return stage(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, SEGMENT), "search-segments")


_SEGMENT_ARROW = pa.schema([("docs", pa.int64()), ("words", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("lengths", pa.binary()),
                            ("terms", pa.list_(pa.int32())), ("dfs", pa.list_(pa.int64())), ("places", pa.binary()), ("counts", pa.binary())])


class Segment:
    """A segment's bitmaps and contributions (10^9 tf div (1000 tf + 8 m)), by term."""

    def __init__(self, row: dict, total_docs: int, total_words: int):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8) > 0
        n = np.frombuffer(row["lengths"], np.int64)
        if len(n) and 75 * int(n.max()) * total_docs >= 1 << 63:
            m = np.array([25 + 75 * int(x) * total_docs // total_words for x in n], np.int64)
        else:
            m = 25 + 75 * n * total_docs // total_words
        places, tf = np.frombuffer(row["places"], np.int32), np.frombuffer(row["counts"], np.int64)
        gain = 10**9 * tf // (1000 * tf + 8 * m[places])
        cut = np.concatenate([[0], np.cumsum(row["dfs"])]).astype(np.int64)
        most = np.maximum.reduceat(gain, cut[:-1]) if len(gain) else gain
        self.size = len(n)
        self.rows = {t: i for i, t in enumerate(row["terms"])}
        self.places = [places[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.gains = [gain[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        self.most = most
        self.bitmaps = np.zeros((len(self.places), (self.size + 7) // 8), np.uint8)
        for i, p in enumerate(self.places):
            bits = np.zeros(self.size, np.uint8)
            bits[p] = 1
            self.bitmaps[i] = np.packbits(bits)

    def best(self, terms: np.ndarray, weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``top`` documents with a score above 0, best first. ``weights``: weight x times of each term."""
        here = [(self.rows[t], w) for t, w in zip(terms.tolist(), weights.tolist(), strict=True) if w and t in self.rows]
        if not here:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, w = np.array([r for r, _ in here]), np.array([x for _, x in here], np.int64)
        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(self.bitmaps[at], axis=0))[:self.size])
        bits = np.unpackbits(self.bitmaps[at], axis=1)[:, some]
        masks = np.ascontiguousarray(np.packbits(bits, axis=0).T)              # a row of bytes for each document
        _, one, group = np.unique(masks.view(f"V{masks.shape[1]}").ravel(), return_index=True, return_inverse=True)
        bound = bits[:, one].T.astype(np.int64) @ (w * self.most[at])           # of each distinct mask
        by_bound = np.argsort(-bound, kind="stable")
        size = np.bincount(group, minlength=len(one))
        rank = np.empty(len(one), np.int64)
        rank[by_bound] = np.arange(len(one))
        docs = some[np.argsort(rank[group], kind="stable")]                     # groups one after another, by descending bound
        through = np.cumsum(size[by_bound])
        bound = bound[by_bound]
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = lo = 0
        while g < len(bound):
            if bound[g] <= 0 or len(scores) >= top and bound[g] < scores[-1]:
                break
            g = min(max(int(np.searchsorted(through, lo + CHUNK, side="right")), g + 1), len(bound))     # whole groups
            mine = docs[lo:int(through[g - 1])]
            lo = int(through[g - 1])
            places, scores = self.first(np.concatenate([places, mine]), np.concatenate([scores, self.score(mine, at, w)]), top)
        return places, scores

    def score(self, docs: np.ndarray, at: np.ndarray, w: np.ndarray) -> np.ndarray:
        total = np.zeros(len(docs), np.int64)
        for r, x in zip(at.tolist(), w.tolist(), strict=True):
            p = self.places[r]
            i = np.minimum(np.searchsorted(p, docs), len(p) - 1)
            total += x * np.where(p[i] == docs, self.gains[r][i], 0)
        return total

    def first(self, places: np.ndarray, scores: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[places], ~self.known[places], -scores))[:top]
        order = order[scores[order] > 0]
        return places[order], scores[order]


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 10, doc_id: str = "doc_id", item_id: str = "item_id",
                   text: str = "text", block_terms: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` highest-scoring documents of every item."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(items, item_id, text, block_terms):
        found = _rank_block(segments(docs, block.vocabulary, doc_id, text), block, top)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _rank_block(written: DataFrame, block: Block, top: int) -> DataFrame:
    spark = written.sparkSession
    n = written.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    total_docs, total_words = n["docs"] or 0, n["words"] or 0
    held = written.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect()   # one number a query term
    weight = np.zeros(len(block.vocabulary), np.int64)
    for r in held:
        weight[r["terms"]] = math.floor(1000 * math.log((2 * total_docs + 2) / (2 * r["df"] + 1)))
    shared = spark.sparkContext.broadcast([(i, key, terms, times * weight[terms]) for i, (key, terms, times) in enumerate(block.items)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                seg = Segment(batch.slice(j, 1).to_pylist()[0], total_docs, total_words)
                no, keys, ids, scores = [], [], [], []
                for i, key, terms, weights in shared.value:
                    places, best = seg.best(terms, weights, top)
                    no += [i] * len(best)
                    keys += [key] * len(best)
                    ids += [int(x) if k else None for x, k in zip(seg.ids[places], seg.known[places], strict=True)]
                    scores += best.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], names=["no", "item_id", "doc_id", "score"])

    lists = written.mapInArrow(run, "no int, item_id long, doc_id long, score long")
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALT))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["no", "part"], ["no"]):                     # an item's lists grow with the segments: parts first, their best after
        near = lists.withColumn("part", part) if "part" in keys else lists
        lists = near.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top).drop("part", *(["rank"] if "part" in keys else []))
    return lists.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
