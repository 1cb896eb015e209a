"""SimHash near-dedup by anchor-point covering.

Two 64-bit fingerprints within ``distance`` bits have a half (32 bits) within
``distance // 2`` bits. In each half the anchors are the words of a covering
code: the perfect binary Golay code (23 bits, 4096 words, covering radius 3)
beside 9 uncoded bits, 2**21 anchors. Every fingerprint has one home, the
anchor nearest to its half. It is replicated to each anchor that is the home
of some word within the half's threshold of it, which are exactly the anchors
within covering radius plus threshold that can matter. So two fingerprints
that are close in a half meet at the home of the one, and are compared there
over all 64 bits.

Fingerprints are made distinct first; texts that share one are a class. An
anchor reports for each fingerprint at most the links of a spanning forest of
what it has found close, so a large group of near copies gives rows in
proportion to its size and no connection is lost. Components come from
repeated hooking to the smallest neighbour and pointer jumping over written
tables; nothing is collected.

Edge cases: a null or empty text has no words and fingerprint zero, linked as
any other; fewer words than a shingle give the whole sequence as the one
shingle; repeated rows share class and component; a null id takes part in its
class, but the component's name is the smallest id that is not null (null if
there is none); only the named columns are read; an empty table gives none.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, stage

GOLAY = 0xAE3       # generator polynomial of the binary Golay code: x^11+x^9+x^7+x^6+x^5+x+1
SEED = 42
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WS = re.compile(rb"[\x20\x09-\x0D]+")
SMALL = 64          # posts of an anchor that is compared by a join
SALTS = 8           # keys that the rows of one class are dealt over
PIECE = 4096        # fingerprints of one anchor compared with as many others in a task


@lru_cache(maxsize=1)
def golay_decoder() -> np.ndarray:
    """For each of the 2**23 words the index of its nearest code word (they are at most 3 bits off; there is one)."""
    if bin(GOLAY).count("1") != 7:
        raise ValueError("not the Golay polynomial")
    code = np.zeros(1 << 12, np.uint32)
    for i in range(12):
        code[1 << i: 2 << i] = code[: 1 << i] ^ np.uint32(GOLAY << i)
    out = np.zeros(1 << 23, np.uint16)
    index = np.arange(1 << 12, dtype=np.uint16)
    for weight in range(4):
        for flips in combinations(range(23), weight):
            out[code ^ np.uint32(sum(1 << f for f in flips))] = index
    return out


def anchor(half: np.ndarray) -> np.ndarray:
    """The anchor nearest to each 32-bit word: 12 bits name the code word, 9 are as they are."""
    half = half.astype(np.uint32)
    return (golay_decoder()[half & np.uint32((1 << 23) - 1)].astype(np.int32) << 9) | (half >> np.uint32(23)).astype(np.int32)


def anchors_within(half: np.ndarray, threshold: int) -> np.ndarray:
    """A row for each word: the homes of all words within ``threshold`` bits of it (repeats included)."""
    flips = [sum(1 << i for i in c) for w in range(threshold + 1) for c in combinations(range(32), w)]
    return np.stack([anchor(half.astype(np.uint32) ^ np.uint32(f)) for f in flips], axis=1)


def fingerprint(text: bytes, shingle: int) -> int:
    """The fingerprint of one text: bit b is set if it is in over half of the shingles' hashes."""
    words = [w for w in _WS.split(text.translate(_FOLD)) if w]
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[k - 1:].tolist(), strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 15):
        total += np.unpackbits(h[lo:lo + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, out: str, text: str = "text", shingle: int = 3) -> DataFrame:
    """All columns and the fingerprint as a (signed) long."""
    (copy,) = fresh(docs, "text")
    n_cols = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint((t or "").encode(), shingle) for t in b.column(n_cols).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], pa.array(np.array(fp, np.uint64).view(np.int64))], names=[*b.schema.names[:n_cols], out])

    schema = docs.select("*", F.lit(0).cast("long").alias(out)).schema
    return docs.withColumn(copy, F.col(text)).mapInArrow(run, schema)


def _post(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """A fingerprint -> its posts: (half and anchor, fingerprint, at home?)."""
    for b in batches:
        fp = b.column(0).to_numpy().view(np.uint64)
        keys, who, home = [], [], []
        for part in range(2):
            half = (fp >> np.uint64(32 * part)).astype(np.uint32)
            own = anchor(half)
            near = np.sort(anchors_within(half, threshold), axis=1)
            first = np.concatenate((np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
            row, col = np.nonzero(first)
            keys.append(near[row, col].astype(np.int64) * 2 + part)
            who.append(fp[row].view(np.int64))
            home.append(near[row, col] == own[row])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(who)), pa.array(np.concatenate(home))], names=["anchor", "fp", "home"])


def forest(pairs: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest index that the pairs connect it to."""
    root = np.arange(n)
    a, b = pairs
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _compare(distance: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Link what is close to a fingerprint at home; return for each linked one the smallest it is connected to here."""
        fps, at = np.unique(group["fp"].to_numpy(), return_inverse=True)
        u = fps.view(np.uint64)
        home = np.zeros(len(fps), bool)
        home[at[group["home"].to_numpy()]] = True
        h = np.flatnonzero(home)
        a, b = [], []
        for lo in range(0, len(h), 256):
            near = np.bitwise_count(u[h[lo:lo + 256], None] ^ u[None, :]) <= distance
            x, y = np.nonzero(near)
            a.append(h[lo:lo + 256][x])
            b.append(y)
        if not a:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        root = forest((np.concatenate(a), np.concatenate(b)), len(fps))
        linked = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[root[linked]], "b": fps[linked]})
    return run


def near_links(prints: DataFrame, distance: int = 3, fp: str = "fp") -> DataFrame:
    """Links (a, b) among distinct fingerprints that connect just those within ``distance`` bits of each other, chained.

    Anchors with at most ``SMALL`` posts are compared by an equi-join on the
    anchor, home against posts. A larger one is cut into pieces by hash, and
    each pair of pieces is compared in a group of its own, so no group holds
    more than about 2 x PIECE rows and none reports more links than rows."""
    threshold = distance // 2
    if not 0 <= distance <= 5:
        raise ValueError("distance must lie between 0 and 5")
    posts = stage(prints.select(F.col(fp).alias("fp")).distinct().mapInArrow(lambda b: _post(b, threshold), "anchor long, fp long, home boolean"), "posts")
    size = posts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("home").cast("int")).alias("homes"))
    large = stage(size.filter(f"n > {SMALL} and homes = 1").select(F.col("anchor").alias("key"), F.ceil(F.col("n") / PIECE).cast("int").alias("pieces")), "anchors")
    few = posts.join(large, F.col("anchor") == F.col("key"), "left_anti")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    mine, theirs = few.filter("home").select("anchor", F.col("fp").alias("a")), few.select(F.col("anchor").alias("at"), F.col("fp").alias("b"))
    links = mine.join(theirs, (F.col("anchor") == F.col("at")) & (F.col("a") != F.col("b")) & close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    many = posts.join(large, F.col("anchor") == F.col("key")).drop("key")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    first = many.filter("home").select("anchor", "fp", "home", piece.alias("i"), across.alias("j"))
    second = many.filter("not home or pieces > 1").select("anchor", "fp", F.lit(False).alias("home"), across.alias("i"), piece.alias("j"))
    star = first.unionByName(second).groupBy("anchor", "i", "j").applyInPandas(_compare(distance), "a long, b long")
    return links.union(star).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Each round hooks every node's root to the smallest root beside it, then
    follows pointers; both halve the depth, so rounds grow with the logarithm of
    the longest chain. Each round's tables are written."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stage(edges, "edges")
    label = stage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("root", "beside")
        hook = stage(both.groupBy("root").agg(F.min("beside").alias("to")).select("root", F.least("root", "to").alias("to")), "hooks")
        while True:
            next_ = hook.alias("x").join(hook.select(F.col("root").alias("r2"), F.col("to").alias("t2")), F.col("to") == F.col("r2"))
            next_ = stage(next_.select("root", F.col("t2").alias("to"), (F.col("to") != F.col("t2")).alias("moved")), "jumps")
            hook, moved = next_.select("root", "to"), not next_.filter("moved").isEmpty()
            if not moved:
                break
        h = hook.select(F.col("root").alias("r"), "to")
        label = stage(label.join(h, label["root"] == h["r"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ha, hb = hook.toDF("a", "ta"), hook.toDF("b", "tb")
        edges = stage(edges.join(ha, "a").join(hb, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    return label


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row per document: key, fp (long), component_id."""
    prints = stage(with_fingerprint(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "fp", "text", shingle).select("id", "fp"), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(near_links(classes, distance))
    least = classes.join(roots, classes["fp"] == roots["node"]).groupBy("root").agg(F.min("least").alias("component"))
    joined = roots.join(least, "root").select("node", "component")
    named = classes.join(joined, classes["fp"] == joined["node"], "left").filter("n > 1 or node is not null")
    named = named.select(F.col("fp").alias("_fp"), F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"))
    # A class may hold a third of all rows: its rows are dealt over SALTS keys.
    salt = F.pmod(F.xxhash64("id", F.lit("salt")), F.lit(SALTS)).cast("int")
    named = named.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    out = prints.withColumn("salt", salt).join(named, (F.col("fp") == F.col("_fp")) & (F.col("salt") == F.col("_salt")), "left")
    return out.select(F.col("id").alias(key), "fp", F.when(F.col("_fp").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component.

    It is the row with the smallest key, of those with that key the one with
    the smallest fingerprint, of those one of the texts with the smallest hash.
    So rows that share a key, or have none, are judged by their own texts: a
    null key comes after all others, and stays only where no row of its
    component has one. The rows are written once with their fingerprints."""
    fp, least, alike = fresh(docs, "fp", "least", "alike")
    rows = stage(with_fingerprint(docs, fp, text, shingle), "printed")
    prints = rows.select(F.col(key).alias("id"), F.col(fp).alias("fp"))
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    roots = components(near_links(classes, distance))
    named = classes.join(roots, classes["fp"] == roots["node"])
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "fp")).alias("first"))
    # Fingerprints all of whose rows go: linked ones that don't hold their component's row.
    gone = named.join(first, "root").filter(F.col("first.fp") != F.col("fp")).select(F.col("fp").alias("gone"))
    kept = rows.join(gone, F.col(fp) == F.col("gone"), "left_anti")
    # Of the other fingerprints that stand more than once, the rows of the smallest key.
    several = classes.filter("n > 1").select(F.col("fp").alias(alike), F.col("least").alias(least))
    kept = kept.join(several, F.col(fp) == F.col(alike), "left").filter(F.col(alike).isNull() | F.col(key).eqNullSafe(F.col(least)))
    again = prints.join(several, (F.col("fp") == F.col(alike)) & F.col("id").eqNullSafe(F.col(least))).groupBy("fp").count().filter("count > 1").select(F.col("fp").alias("again"))
    if not again.isEmpty():
        again = stage(again, "again")
        single = kept.join(again, F.col(fp) == F.col("again"), "left_anti").select(*docs.columns)
        one = kept.join(again, F.col(fp) == F.col("again"), "left_semi").groupBy(fp).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("row"))
        return single.unionByName(one.select("row.*"))
    return kept.select(*docs.columns)
