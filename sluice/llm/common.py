"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.session import scratch_path

ASCII_WS = "[\\x20\\x09-\\x0D]+"
MAX_LONG = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder under the shared checkpoint folder and read it
    back: cuts lineage, and makes rows and generated ids durable."""
    spark = session_of(df)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame does not have yet (any letter case)."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        c = f"__{n}"
        while c.lower() in have:
            c = "_" + c
        have.add(c.lower())
        out.append(c)
    return out


def without(df: DataFrame, added: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The frame without the columns an operator is about to add (any letter case), so that no name stands twice.

    The operator's own inputs (``keep``) must not be among them."""
    names, inputs = {a.lower() for a in added}, {k.lower() for k in keep}
    if names & inputs:
        raise ValueError(f"the input column {sorted(names & inputs)[0]!r} has the name of a column that is added; rename it")
    return df.drop(*[c for c in df.columns if c.lower() in names])


def text_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and n + 1 offsets into it. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices_by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_buffers(batch.column(column))
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def unit_hash(h: Column) -> Column:
    """A 64-bit hash as a double in (0, 1): 52 of its bits and a half."""
    return (F.shiftrightunsigned(h, 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def number_rows(df: DataFrame, group: Sequence[str], order: Column, out: str, rows: int,
                ties: Sequence[str] = (), null_groups: bool = True) -> DataFrame:
    """Number the rows of every group from 0, without gaps, in the order of a 64-bit hash.

    The hash range is cut into buckets of about 512 rows of the whole table
    (``rows`` is its count, or an estimate), counted per (group, bucket) with
    map-side combine; two-level prefix sums of those counts give each bucket
    its first number, and only the rows of one bucket are sorted together. A
    group with a third of all rows is so spread over a third of the buckets'
    tasks. A plain join deals the rows as the window needs them, so they are
    shuffled once; with ``null_groups`` its key is a struct of the group, which
    is never null and equal where all its fields are equal or null."""
    h, b, sup, n, off, soff, whole = fresh(df, "h", "bucket", "super", "n", "off", "soff", "group")
    buckets = min(max(rows // 512, 64), 1 << 20)
    d = df.withColumn(h, order)
    if null_groups and group:
        d, group = d.withColumn(whole, F.struct(*group)), [whole]
    d = d.withColumn(b, F.floor(unit_hash(F.col(h)) * buckets).cast("long"))
    counts = d.groupBy(*group, b).agg(F.count(F.lit(1)).alias(n)).withColumn(sup, F.floor(F.col(b) / 1024))
    sums = counts.groupBy(*group, sup).agg(F.sum(n).alias(soff))
    before = Window.partitionBy(*group).orderBy(sup).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*group, sup, F.coalesce(F.sum(soff).over(before), F.lit(0)).alias(soff))
    inner = Window.partitionBy(*group, sup).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, b, sup, F.coalesce(F.sum(n).over(inner), F.lit(0)).alias(off)).join(sums, [*group, sup])
    first = counts.select(*group, b, (F.col(off) + F.col(soff)).alias(off))
    j = d.join(first, [*group, b])
    w = Window.partitionBy(*group, b).orderBy(h, *ties)
    return j.withColumn(out, (F.row_number().over(w) - 1 + F.col(off)).cast("long")).drop(h, b, off, whole)


def group_count(total: int, per_group: int, least: int = 1) -> int:
    return max(least, math.ceil(total / per_group))
