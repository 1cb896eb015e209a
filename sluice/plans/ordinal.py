"""Skew-safe per-group ordinals and prefix sums.

``row_number() over (partition by g order by k)`` sorts a whole group in one
task; when one group holds a third of the rows that task is the job. Here the
ordering key is cut into ranges at its quantiles (closer at both ends, so that
an outlier has a range of few rows), and each range into blocks of equal width,
so that a block holds about ``block`` rows also where the keys are dense in one
place and rare in another. Evenly spread keys have one range.
Per-(group, block) counts are pre-aggregated (map-side combine) and
prefix-summed level by level: blocks within blocks of ``FAN`` blocks, and so
on, until a level has one block a group, so no window on the way sees more
than ``FAN`` rows of the level below it, however large the group. The final
numbering runs per (group, block).

Null groups are a group like any other. Rows without a key come after all
others of their group, ordered by a hash of the row (and the tiebreak), in
blocks of their own.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 13   # rows per ordinal block: parallelism for hot groups, small block table
FAN = 1024                # blocks under one block of the next level


def _key_num(c: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("bigint")


# Places of the range borders, as shares of the rows, and the accuracy their quantiles need.
TAIL = (0.0002, 0.001, 0.005)
SHARES = (*TAIL, *[i / 64 for i in range(1, 64)], *[1 - t for t in reversed(TAIL)])
ACCURACY = 10000


def _bounds(df: DataFrame, key: Column, group: Sequence[str] = (), shares: bool | None = None) -> tuple:
    """Smallest and largest key, rows, rows without a key, whether a group is
    null, and with ``shares`` (the default where no group is given) the keys at
    ``SHARES``, in one aggregate."""
    shares = not group if shares is None else shares
    null = F.lit(False)
    for g in group:
        null = null | F.col(g).isNull()
    at = [F.percentile_approx(key, list(SHARES), ACCURACY).alias("at")] if shares else []
    r = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"), F.count_if(key.isNull()).alias("none"), F.max(null).alias("null"), *at).first()
    found = r["lo"] or 0, r["hi"] or 0, r["n"], r["none"], bool(r["null"])
    return (*found, list(r["at"] or [])) if shares else found


def _ranges(lo: int, hi: int, keyed: int, at: Sequence[int], block: int) -> list[tuple[int, int, int]]:
    """Ranges of keys as (first key, width of a block, number of its first block).

    The rows of a range follow from the shares of its borders. A share whose key
    is the one before it adds no border: equal keys stand in one block. Ranges of
    less than half a block join the next, but for those at the ends. Keys spread so
    evenly that no block of one width would hold over twice its share have one range."""
    width = max(1, (hi - lo + 1) * block // max(keyed, 1))
    points, held = [(lo, 0.0), *zip(at, SHARES), (hi + 1, 1.0)], defaultdict(float)
    for (start, share), (end, above) in zip(points, points[1:]):
        held[(start - lo) // width] += (above - share) * keyed / max(1.0, (end - start) / width)
    if max(held.values()) <= 2 * block:
        return [(lo, width, 0)]
    cuts, last = [(lo, 0.0)], lo
    for key, share in zip(at, SHARES):
        small = (share - cuts[-1][1]) * keyed < block / 2
        if key <= last or key > hi or (small and TAIL[-1] < share < 1 - TAIL[-1]):
            continue
        cuts.append((key, share))
        last = key
    out, first = [], 0
    for (start, share), (end, above) in zip(cuts, [*cuts[1:], (hi + 1, 1.0)]):
        n = max(1, min(end - start, -(-int((above - share) * keyed) // block)))
        out.append((start, -(-(end - start) // n), first))
        first += n
    return out


def _block_of(key: Column, ranges: Sequence[tuple[int, int, int]]) -> Column:
    """The block of a key: its range by halving, then equal widths."""
    if len(ranges) == 1:
        start, width, first = ranges[0]
        return F.floor((key - F.lit(start)) / F.lit(width)) + F.lit(first)
    mid = len(ranges) // 2
    return F.when(key < F.lit(ranges[mid][0]), _block_of(key, ranges[:mid])).when(key.isNotNull(), _block_of(key, ranges[mid:]))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet; the keys stand once."""
    names = {k: f"__r{i}_{k}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(names)
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return left.join(r, on, how).drop(*names.values())


def block_offsets(counts: DataFrame, group: Sequence[str], blk: str, n: str, out: str, levels: int) -> DataFrame:
    """Exclusive prefix sums of ``n`` over the blocks of each group:
    (group, blk, out). ``levels`` levels of blocks stand above ``blk``."""
    group = list(group)
    if levels == 0:
        w = Window.partitionBy(*group).orderBy(blk)
        return counts.select(*group, blk, (F.sum(n).over(w) - F.col(n)).alias(out))
    up = f"{blk}_u"
    c = counts.withColumn(up, F.floor(F.col(blk) / FAN))
    sums = c.groupBy(*group, up).agg(F.sum(n).alias(n))
    above = block_offsets(sums, group, up, n, f"{out}_u", levels - 1)
    w = Window.partitionBy(*group, up).orderBy(blk)
    inner = c.select(*group, blk, up, (F.sum(n).over(w) - F.col(n)).alias(out))
    return null_safe_join(inner, above, [*group, up]).select(*group, blk, (F.col(out) + F.col(f"{out}_u")).alias(out))


def _levels(blocks: int) -> int:
    """Levels needed above ``blocks`` blocks so that the top has at most FAN."""
    n = 0
    while blocks > FAN:
        blocks = -(-blocks // FAN)
        n += 1
    return n


def with_ordinal(df: DataFrame, group: Sequence[str], order: str, out: str = "rn",
                 tiebreak: Sequence[str] = (), block: int = DEFAULT_BLOCK,
                 key_kind: str = "number", total: str | None = None) -> DataFrame:
    """Add a 0-based ordinal of each row within ``group`` ordered by
    (``order``, *``tiebreak``). ``order`` must be numeric or a timestamp
    (``key_kind='timestamp'``). ``total`` names an optional column with the
    group's row count, taken from the same block table (no extra join)."""
    group = list(group)
    blk = "__blk"
    key = _key_num(F.col(order), key_kind)
    lo, hi, rows, none, null_group, at = _bounds(df, key, group, shares=True)
    ranges = _ranges(lo, hi, rows - none, at, block)
    last = ranges[-1][2] + (hi - ranges[-1][0]) // ranges[-1][1]
    # Rows without a key: blocks by a hash, after the last block of keys.
    by_hash = F.xxhash64(*(tiebreak or [c for c, t in df.dtypes if not t.startswith(("map", "variant"))]))
    spread = -(-none // block)
    b = df.withColumn(blk, _block_of(key, ranges))
    if none:
        b = b.withColumn(blk, F.coalesce(blk, F.lit(last + 1) + F.pmod(by_hash, F.lit(spread))))
    counts = b.groupBy(*group, blk).agg(F.count(F.lit(1)).alias("__n"))
    offs = block_offsets(counts, group, blk, "__n", "__off", _levels(last + 1 + spread))
    if total:
        offs = null_safe_join(offs, counts.groupBy(*group).agg(F.sum("__n").alias(total)), group)
    # A plain join deals the rows as the window needs them; a null-safe one costs another exchange.
    j = null_safe_join(b, offs, [*group, blk]) if null_group else b.join(offs, on=[*group, blk], how="inner")
    w = Window.partitionBy(*group, blk).orderBy(F.col(order), *[F.col(c) for c in tiebreak], *([by_hash] if none else []))
    return (j.withColumn(out, F.row_number().over(w) - 1 + F.col("__off"))
             .drop(blk, "__off"))


def with_prefix_offset(df: DataFrame, group: Sequence[str], order: str, n: str,
                       out: str = "offset", block: int = FAN) -> DataFrame:
    """Add ``out`` = sum of ``n`` over earlier rows of the group (exclusive
    prefix sum) ordered by the dense integer ``order`` (e.g. page_idx).

    The rows of a block are gathered into one row (``block`` of them at most),
    so the input is read once; the blocks are prefix-summed, and unfolded."""
    group = list(group)
    blk = "__pblk"
    item = F.struct(F.col(order).alias("o"), F.col(n).alias("n"))
    gathered = df.groupBy(*group, F.floor(F.col(order) / F.lit(block)).alias(blk)).agg(
        F.array_sort(F.collect_list(item)).alias("__items"), F.sum(n).alias("__bs"))
    up = "__pup"
    g = gathered.withColumn(up, F.floor(F.col(blk) / FAN))
    w = Window.partitionBy(*group, up).orderBy(blk)
    top = Window.partitionBy(*group).orderBy(up)
    g = g.withColumn("__in", F.sum("__bs").over(w))
    # Running sum within a block of blocks; the sum of the earlier ones follows
    # from the last row of each, one per FAN blocks.
    tops = g.groupBy(*group, up).agg(F.max("__in").alias("__t"))
    tops = tops.select(*group, up, (F.sum("__t").over(top) - F.col("__t")).alias("__before"))
    g = null_safe_join(g, tops, [*group, up])
    start = F.col("__in") - F.col("__bs") + F.col("__before")
    zero = F.struct(F.lit(0).cast("bigint").alias("s"), F.array().cast("array<struct<o:bigint,n:bigint,off:bigint>>").alias("a"))
    unfold = F.aggregate("__items", zero, lambda acc, x: F.struct(
        (acc["s"] + x["n"]).cast("bigint").alias("s"),
        F.concat(acc["a"], F.array(F.struct(x["o"].cast("bigint").alias("o"), x["n"].cast("bigint").alias("n"), acc["s"].alias("off")))).alias("a")), lambda acc: acc["a"])
    e = g.select(*group, start.alias("__start"), F.explode(unfold).alias("__e"))
    return e.select(*group, F.col("__e.o").cast(df.schema[order].dataType).alias(order), F.col("__e.n").cast(df.schema[n].dataType).alias(n),
                    (F.col("__start") + F.col("__e.off")).alias(out))
