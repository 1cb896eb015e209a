"""Benchmark decontamination: size-partitioned MinHash containment search, native.

Items are partitioned by size (distinct 5-word shingles) into classes
(U / 4, U], U a power of four. For a class every document is cut into blocks
of U shingles, so a long document never drowns a short item. Items and blocks
get one-permutation MinHash sketches: shingle hashes fall into 256 bins, the
smallest of each bin is kept. An item and a block that agree in a bin make the
document a candidate for the item, and it is enough that one of the document's
blocks does. ``miss_probability`` bounds the chance that none does: where one
block holds the passage, under 1e-6 for the least favourable size at a
containment of 0.8; where a block border cuts it at the worst place, 1.4e-6 for
five shingles (two and two shared), under 1e-7 for all other sizes; under 1e-12
from 17 shingles on either way. Every candidate is verified by exact containment of the shingles themselves.

Words are maximal runs of letters and digits of the lower-cased text; fewer
than five make one shingle. The whole path is DataFrame functions.

Edge cases: a null or empty text, or one without words, has no shingle and is
never matched, nor is an item of that kind; a document without id can't be
reported, and rows that repeat an id are reported as one document, but
``remove_contaminated`` judges each row by its own text; repeated items are reported under each id; only the
named columns are read; empty tables give an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, stage

SHINGLE = 5
BIN_BITS = 8                    # 256 bins
ALL_KEPT = 4                    # blocks of so few shingles are kept whole
BROADCAST_ROWS = 2_000_000      # sketch or shingle rows of items that are broadcast; more are joined by shuffle


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _starts(words: Column, k: int) -> Column:
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, hashes): the hashes of a text's shingles in order."""
    w = df.select(F.col(key).alias("id"), words_of(F.col(text)).alias("words"))
    return w.select("id", F.transform(_starts(F.col("words"), k), lambda i: F.xxhash64(*[F.get(F.col("words"), i + j) for j in range(k)])).alias("hashes"))


def _sketch(df: DataFrame, array: str, u: int) -> DataFrame:
    """Replace an array of hashes by the smallest hash of each bin, a row each."""
    rest = [c for c in df.columns if c != array]
    if u <= ALL_KEPT:
        return df.select(*rest, F.explode(array).alias("h"))
    df = df.select(*rest, F.sort_array(array).alias("ordered"))
    bin_of = lambda x: F.shiftright(x, 64 - BIN_BITS)
    kept = F.filter("ordered", lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col("ordered"), i - 1))))
    return df.select(*rest, F.explode(kept).alias("h"))


def _shingles(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Distinct (id, shingle) with the shingles as text."""
    w = df.select(F.col(key).alias("id"), words_of(F.col(text)).alias("words"))
    each = F.transform(_starts(F.col("words"), k), lambda i: F.concat_ws(" ", F.slice(F.col("words"), i + 1, k)))
    return w.select("id", F.explode(F.array_distinct(each)).alias("shingle"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", containment: float = 0.8, shingle: int = SHINGLE) -> DataFrame:
    """One row per document and item it holds: key, item, n_shingles, n_shared, containment."""
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("body")).filter("doc is not null")
    items = items.select(F.col(item).alias("item"), F.col(item_text).alias("body")).filter("item is not null")
    wanted = stage(_shingles(items, "item", "body", shingle).distinct().toDF("item", "shingle"), "item-shingles")
    sizes = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("n_shingles"))
    n_rows = wanted.count()
    small = (lambda d: F.broadcast(d)) if n_rows <= BROADCAST_ROWS else (lambda d: d)
    # few whatever the benchmark's size: the logarithm of the largest item
    levels = [r[0] for r in sizes.select(F.ceil(F.log(4.0, F.col("n_shingles")) - 1e-9).cast("int").alias("c")).distinct().orderBy("c").collect()]
    hashed, found = _hashed(docs, "doc", "body", shingle), None
    probe = _hashed(items, "item", "body", shingle).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("hashes"))).alias("hashes"))
    probe = probe.withColumn("c", F.ceil(F.log(4.0, F.size("hashes")) - 1e-9).cast("int"))
    for c in levels:
        u = 4 ** c
        sketch = _sketch(probe.filter(F.col("c") == c).select(F.col("id").alias("item"), "hashes"), "hashes", u).select("item", F.col("h").alias("k"))
        cut = F.when(F.size("hashes") > 0, F.transform(F.sequence(F.lit(1), F.size("hashes"), F.lit(u)), lambda s: F.slice("hashes", s, u))).otherwise(F.array().cast("array<array<bigint>>"))
        blocks = hashed.select("id", F.explode(cut).alias("block"))
        hits = _sketch(blocks, "block", u).join(small(sketch), F.col("h") == F.col("k")).select(F.col("id").alias("doc"), "item").distinct()
        found = hits if found is None else found.union(hits)
    if found is None:
        found = docs.select("doc").join(sizes.select("item"), F.lit(False))
    found = stage(found.distinct(), "candidates")
    ids = found.select(F.col("doc").alias("c_doc")).distinct()
    texts = docs.join(ids, F.col("doc") == F.col("c_doc"), "left_semi")
    mine = _shingles(texts, "doc", "body", shingle)
    shared = mine.join(small(wanted.withColumnRenamed("shingle", "s")), F.col("shingle") == F.col("s")).select(F.col("id").alias("doc"), "item", "shingle").distinct()
    shared = shared.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("n_shared"))
    out = shared.join(found, ["doc", "item"], "left_semi").join(small(sizes), "item")
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).filter(F.col("containment") >= containment)
    return out.select(F.col("doc").alias(key), F.col("item").alias(item), "n_shingles", "n_shared", "containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no item.

    What a document holds follows from its text, so texts are judged, named by
    128 bits of hashes: rows that share an id, or have none, go or stay by
    their own texts."""
    (name,) = fresh(docs, "name")
    named = docs.withColumn(name, F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("b"), text).alias("b")))
    gone = contaminated(named, items, name, text, **options).select(F.col(name).alias("gone")).distinct()
    return named.join(gone, F.col(name) == F.col("gone"), "left_anti").drop(name)


def miss_probability(size: int, containment: float = 0.8, before: int = 0) -> float:
    """The chance that an item of ``size`` shingles is no candidate of a document that holds the share ``containment`` of it,
    ``before`` of the shared shingles in one block and the rest in the next (0: all in one)."""
    u = 4 ** math.ceil(math.log(max(size, 1), 4) - 1e-9)
    both, missed = math.ceil(containment * size), 1.0
    for shared in (before, both - before):
        union = u + size - shared
        kept = (1 << BIN_BITS) * (1 - (1 - 2.0 ** -BIN_BITS) ** union) / union if u > ALL_KEPT else 1.0
        missed *= (1 - min(kept, 1.0)) ** shared
    return missed
