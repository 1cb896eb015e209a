"""Mixing sources to target weights by Pfair scheduling.

Every source's documents form blocks; a slot of the mix takes one block. With
weight w, the j-th block (from 0) of a source is released at slot floor(j / w)
and due by slot ceil((j + 1) / w). Of the released blocks the one with the
earliest deadline takes the next slot. With weights that sum to one every
deadline is met, so at each slot every source has got less than one block more
or less than its weight asks for.

Weights are whole parts of a period (largest remainders), so the schedule
repeats every period, and one period, a list of bounded length, describes it.
When a source has no block left the weights of the others are scaled up and a
new phase begins; there are at most two phases a source. The phases are
computed from the sources' block counts (one number a source); the slot of
every document then follows by arithmetic in a projection, without a shuffle
beyond the numbering of documents within their source.

Edge cases: a null source is a source of its own; a source without a target
weight, or with weight zero, comes after all weighted ones, by equal weights
(nothing is dropped); null or empty texts count as documents; rows that repeat
an id are documents of their own; the last block of a source may be short; an
empty table gives an empty mix.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, number_rows, without

PERIOD = 1000         # slots after which the weights are met exactly
MAX_SOURCES = 1000    # more are an error: the schedule is a driver-side table of sources x period at most


def quantise(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole parts of the period in proportion to the weights, at least one each, by largest remainder."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {k: w / total * period for k, w in weights.items()}
    parts = {k: max(1, math.floor(x)) for k, x in exact.items()}
    spare = period - sum(parts.values())
    while spare > 0:
        for k in sorted(parts, key=lambda k: (parts[k] - exact[k], repr(k)))[:spare]:
            parts[k] += 1
            spare -= 1
    while spare < 0:
        parts[max((k for k in parts if parts[k] > 1), key=lambda k: (parts[k] - exact[k], repr(k)))] -= 1
        spare += 1
    return parts


def one_period(parts: Mapping[str, int]) -> list[str]:
    """Earliest deadline first over one period: the source of each slot."""
    period = sum(parts.values())
    waiting = [(0, k, 0) for k in range(len(parts))]      # release, source, block
    names, n = list(parts), list(parts.values())
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []                # deadline, source, block
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // n[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append(names[s])
        if j + 1 < n[s]:
            heapq.heappush(waiting, ((j + 1) * period // n[s], s, j + 1))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], period: int = PERIOD) -> list[dict]:
    """The schedule: for each phase its first slot, the period's parts and slots, and each source's first and end block."""
    left, at, out = {k: b for k, b in blocks.items() if b > 0}, 0, []
    done = dict.fromkeys(left, 0)
    while left:
        active = {k: weights.get(k, 0.0) for k in sorted(left, key=lambda k: (k is None, k)) if weights.get(k, 0.0) > 0}
        parts = quantise(active or dict.fromkeys(sorted(left, key=lambda k: (k is None, k)), 1.0), period)
        order = one_period(parts)
        cycles = min(left[k] // n for k, n in parts.items())
        if cycles:
            length, used = cycles * len(order), {k: cycles * n for k, n in parts.items()}
        else:   # the part of a period before a source runs out
            used, length = dict.fromkeys(parts, 0), 0
            for k in order:
                if used[k] == left[k]:
                    break
                used[k] += 1
                length += 1
        offsets = {k: [i for i, x in enumerate(order) if x == k] for k in parts}
        out.append({"slot": at, "period": len(order), "sources": {k: {"first": done[k], "end": done[k] + used[k], "parts": parts[k], "offsets": offsets[k]} for k in parts if used[k]}})
        at += length
        for k, u in used.items():
            done[k] += u
            left[k] -= u
            if not left[k]:
                del left[k]
    return out


def tempered_weights(counts: Mapping[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights that flatten the sources' sizes: size ** power, normalised."""
    raw = {k: n ** power for k, n in counts.items() if n}
    total = sum(raw.values())
    return {k: w / total for k, w in raw.items()}


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id",
        block_rows: int = 8, period: int = PERIOD, block: str = "block", release: str = "release", deadline: str = "deadline",
        slot: str = "slot", place: str = "place") -> DataFrame:
    """All columns, and of each document its source's block, the block's release, deadline and slot, and its place in the block.

    The order of the mix is (slot, place). ``weights``: by source; default:
    the square roots of the sources' row counts. Documents of a source are
    taken in the order of a hash of their id. A column named like an added one is replaced."""
    spark = docs.sparkSession
    docs = without(docs, [block, release, deadline, slot, place], keep=[source, key])
    counts = {r[0]: r[1] for r in docs.groupBy(source).agg(F.count(F.lit(1))).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix groups of sources, or raise MAX_SOURCES")
    weights = tempered_weights(counts) if weights is None else weights
    plan = phases({k: -(-n // block_rows) for k, n in counts.items()}, weights, period)
    rows: dict = {}
    for p in plan:
        for k, s in p["sources"].items():
            rows.setdefault(None if k is None else str(k), []).append((s["first"], s["end"], s["parts"], p["slot"], p["period"], s["offsets"]))
    src, plan_col, ph, idx, cyc, num = fresh(docs, "src", "plan", "phase", "idx", "cycle", "num")
    schema = f"{src} string, {plan_col} array<struct<first: bigint, end: bigint, parts: bigint, slot: bigint, period: bigint, offsets: array<bigint>>>"
    lookup = F.broadcast(spark.createDataFrame(list(rows.items()), schema))    # sources x period numbers at most, both bounded above
    d = number_rows(docs, [source], F.xxhash64(F.lit("mix"), F.col(key)), num, sum(counts.values()), [key])
    d = d.withColumn(block, F.floor(F.col(num) / block_rows).cast("long")).withColumn(place, (F.col(num) % block_rows).cast("int"))
    d = d.join(lookup, F.col(source).cast("string").eqNullSafe(F.col(src)))
    d = d.withColumn(ph, F.get(F.filter(plan_col, lambda x: (x["first"] <= F.col(block)) & (F.col(block) < x["end"])), F.lit(0)))
    d = d.withColumn(idx, (F.col(block) - F.col(f"{ph}.first")) % F.col(f"{ph}.parts"))
    d = d.withColumn(cyc, F.col(f"{ph}.slot") + F.floor((F.col(block) - F.col(f"{ph}.first")) / F.col(f"{ph}.parts")) * F.col(f"{ph}.period"))
    d = d.withColumn(release, (F.col(cyc) + F.floor(F.col(idx) * F.col(f"{ph}.period") / F.col(f"{ph}.parts"))).cast("long"))
    d = d.withColumn(deadline, (F.col(cyc) + F.ceil((F.col(idx) + 1) * F.col(f"{ph}.period") / F.col(f"{ph}.parts"))).cast("long"))
    d = d.withColumn(slot, (F.col(cyc) + F.get(F.col(f"{ph}.offsets"), F.col(idx).cast("int"))).cast("long"))
    return d.select(*docs.columns, block, release, deadline, slot, place)


def in_mix_order(docs: DataFrame, weights: Mapping[str, float] | None = None, **options) -> DataFrame:
    """The documents laid out in the order of the mix: partitions are consecutive ranges of it, rows sorted within."""
    names = dict(zip(("block", "release", "deadline", "slot", "place"), fresh(docs, "block", "release", "deadline", "slot", "place"), strict=True))
    mixed = mix(docs, weights, **names, **options)
    return mixed.repartitionByRange(names["slot"], names["place"]).sortWithinPartitions(names["slot"], names["place"]).select(*docs.columns)
