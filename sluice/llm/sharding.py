"""Sharding by a hierarchical weighted hash tree.

A key descends from the root through regions and racks to a shard. At each
node every child draws log(u) / weight, u in (0, 1) being a hash of the key
and the child's name, and the largest draw wins. So a child is chosen in
proportion to its weight, and a change of a child's weight moves keys only to
or from that child: movement is confined to the subtrees whose weights change.
The weight of a region or rack is the sum of its shards' weights.

``topology`` builds the standard tree of n shards: the first eight stand in
two regions of two racks of two; each further one stands in a region and rack
of its own, so that it takes keys only into itself and no key moves between
the others. The law is ``key``: the id and the number of shards decide.

All is DataFrame functions over id, text length and checksum; the text itself
is not shuffled. Slots number the rows of a shard from 0 without gaps, in the
order of a hash of the id, or of a position that is given (as of a mix).

Edge cases: a null text has size 1 and the checksum of the empty text; null
ids all draw alike, as one key; rows that repeat an id go to one shard, each
with a slot of its own; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, number_rows, unit_hash


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def topology(n: int) -> list[Shard]:
    """The standard tree: shards 0-7 in 2 regions x 2 racks x 2, every further shard in a region of its own."""
    return [Shard(f"r{i // 4}", f"k{i // 2}", i) if i < 8 else Shard(f"r{i}", f"k{i}", i) for i in range(n)]


def draw(key: Column, names: Sequence[str], weights: Sequence[float]) -> Column:
    """The index of the child with the largest weighted draw."""
    scores = [F.log(unit_hash(F.xxhash64(key, F.lit(name)))) / F.lit(float(w)) for name, w in zip(names, weights, strict=True)]
    if len(scores) == 1:
        return F.lit(0)
    best = F.greatest(*scores)
    out = F.lit(len(scores) - 1)
    for i in range(len(scores) - 2, -1, -1):
        out = F.when(scores[i] == best, F.lit(i)).otherwise(out)
    return out


def place(key: Column, tree: Sequence[Shard]) -> Column:
    """The shard of a key: region, then rack within it, then shard within that."""
    def descend(members: Sequence[Shard], level: int, path: str) -> Column:
        if level == 3:
            return F.lit(members[0].shard)
        groups: dict[str, list[Shard]] = {}
        for m in members:
            groups.setdefault((m.region, m.rack, str(m.shard))[level], []).append(m)
        names = [f"{path}/{g}" for g in groups]
        subs = [descend(g, level + 1, p) for g, p in zip(groups.values(), names, strict=True)]
        chosen = draw(key, names, [sum(m.weight for m in g) for g in groups.values()])
        out = subs[-1]
        for i in range(len(subs) - 2, -1, -1):
            out = F.when(chosen == i, subs[i]).otherwise(out)
        return out

    live = [m for m in tree if m.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    return descend(live, 0, "").cast("int")


def shard(docs: DataFrame, tree: Sequence[Shard], rows: int | None = None, grown: Sequence[Shard] | None = None, key: str = "doc_id",
          text: str = "text", names: Sequence[str] = ("size", "text_crc32", "law", "shard", "slot", "grown_shard"), carry: Sequence[str] | None = None,
          position: Column | None = None, positions: int | None = None) -> DataFrame:
    """The columns ``carry`` (default: all; those named like an added one are replaced), and of every row: size, checksum, law, shard, slot, and its shard in the tree ``grown``.

    ``rows``: the table's row count, if known; else it is counted. ``position``: a number from 0 to below ``positions``,
    spread evenly, in whose order the slots of a shard follow; default: a hash of the id."""
    if (position is None) != (positions is None):
        raise ValueError("position and positions go together")
    size, crc, law, out, slot, more = names
    taken = {n.lower() for n in names}
    if taken & {key.lower(), text.lower()}:
        raise ValueError("an input column has the name of a column that is added; give other names")
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in taken]
    body = F.coalesce(F.col(text), F.lit(""))
    tie, order = fresh(docs, "key", "order")
    rows = docs.count() if rows is None else rows
    if position is None:
        by, spread = F.xxhash64(F.lit("slot"), F.col(key)), rows
    else:   # over the lower half of the range of hashes: longs stay in order, and twice the buckets hold as many rows
        by, spread = position.cast("long") * F.lit(((1 << 63) - 1) // max(positions, 1)), 2 * rows
    d = docs.select(*carry, F.col(key).alias(tie), by.alias(order), (F.octet_length(body) + 1).cast("long").alias(size), F.crc32(body).cast("long").alias(crc), F.lit("key").alias(law),
                    place(F.col(key), tree).alias(out), (place(F.col(key), grown) if grown else F.lit(None).cast("int")).alias(more))
    d = number_rows(d, [out], F.col(order), slot, spread, [tie, crc, size], null_groups=position is None)
    return d.select(*carry, *names)
