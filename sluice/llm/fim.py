"""Fill-in-middle transformation over a Roaring-style set of cut offsets.

The places where a text may be cut are its start and the end of each of its
lines, as code-point offsets. They are held the way Roaring bitmaps hold
integers: one container for each 65536 consecutive offsets, which is a sorted
array, a bitmap or a list of runs, whichever is smallest, with the cumulative
cardinality beside it. The offset of the k-th cut is a binary search for the
container and a select inside it; a document's two cuts are two such selects.

A document keeps its text (``plain``) or becomes ``psm`` (prefix, suffix,
middle) or ``spm`` (suffix, prefix, middle), each part behind its marker.
Draws are the four leading 32-bit words of sha256 of ``seed:key``, so a row's
cuts and form depend on its key and text alone.

Edge cases: a null text is empty; an empty text, or one that holds a marker,
stays plain; a null key draws from ``seed:``; repeated rows get equal results;
a text of one long line has two cuts, its start and its end; an empty table
gives no rows. Columns the frame has already under a name that is added are
replaced by the added one.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, without

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
WIDTH = 16                       # low bits inside a container
ARRAY_MOST = 4096                # an array of more 16-bit numbers takes more bytes than a bitmap
BITMAP_BYTES = (1 << WIDTH) // 8
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_POP = _BIT.sum(axis=1).astype(np.int64)
ADDED = ("n_units", "form", "prefix_chars", "middle_chars", "output")


class Container:
    """At most 65536 numbers below 65536: ``kind`` says how they are held."""

    def __init__(self, low: np.ndarray):
        """``low``: ascending, distinct."""
        starts = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        array_bytes = 2 * len(low) if len(low) <= ARRAY_MOST else BITMAP_BYTES + 1
        if 4 * len(starts) < min(array_bytes, BITMAP_BYTES):
            self.kind = "run"
            self.first = low[starts].astype(np.uint16)
            self.before = starts.astype(np.int32)            # numbers in the runs before
        elif array_bytes <= BITMAP_BYTES:
            self.kind = "array"
            self.values = low.astype(np.uint16)
        else:
            self.kind = "bitmap"
            bits = np.zeros(1 << WIDTH, np.uint8)
            bits[low] = 1
            self.bits = np.packbits(bits, bitorder="little")
            self.before = np.concatenate([[0], np.cumsum(_POP[self.bits])])   # numbers in the bytes before

    def select(self, k: int) -> int:
        """The k-th smallest number, from 0."""
        if self.kind == "array":
            return int(self.values[k])
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        if self.kind == "run":
            return int(self.first[at]) + k - int(self.before[at])
        return 8 * at + int(np.flatnonzero(_BIT[self.bits[at]])[k - int(self.before[at])])


class BoundarySet:
    """An ascending set of offsets, in containers by their high bits."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> WIDTH
        cut = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[cut]
        ends = np.append(cut[1:], len(offsets))
        self.containers = [Container(offsets[a:b] & ((1 << WIDTH) - 1)) for a, b in zip(cut, ends, strict=True)]
        self.through = ends                                   # cumulative cardinalities

    def __len__(self) -> int:
        return int(self.through[-1]) if len(self.through) else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        c = int(np.searchsorted(self.through, k, side="right"))
        return (int(self.keys[c]) << WIDTH) + self.containers[c].select(k - (int(self.through[c - 1]) if c else 0))


def line_boundaries(text: bytes) -> np.ndarray:
    """0 and the end of every line (``[^\\n]*\\n`` or the rest), in code points of the UTF-8 text."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(raw == 10) + 1
    if len(raw) and (not len(ends) or ends[-1] != len(raw)):
        ends = np.append(ends, len(raw))
    if not len(ends):
        return np.zeros(1, np.int64)
    starts = ((raw & 0xC0) != 0x80).view(np.uint8)            # 1 at the first byte of a code point
    chars = np.add.reduceat(starts, np.concatenate([[0], ends[:-1]]), dtype=np.int64)
    return np.concatenate([[0], np.cumsum(chars)])


def split(text: str, draws: tuple[int, int, int, int], plain_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    bounds = BoundarySet(line_boundaries(text.encode()))
    n = len(bounds) - 1
    if not text or any(m in text for m in MARKERS) or draws[2] % 100 < plain_percent:
        return n, "plain", None, None, text
    first, second = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = bounds.select(first), bounds.select(second)
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def draws_of(key: Column, seed: int) -> list[Column]:
    """The first four 32-bit words of sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 7,
                   plain_percent: int = 0, spm_percent: int = 50) -> DataFrame:
    """All columns, and n_units, form, prefix_chars, middle_chars, output.

    Rows are transformed where they are: one pass, no shuffle."""
    docs_in = without(docs, ADDED, keep=(text, key))
    copy, *drawn = fresh(docs_in, "text", "d1", "d2", "d3", "d4")
    n_cols = len(docs_in.columns)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):            # a few texts at a time: the output is as large as the input
                b = batch.slice(i, 64)
                draws = [c.to_pylist() for c in b.columns[n_cols + 1:]]
                rows = [split(t.as_py() or "", d, plain_percent, spm_percent) for t, *d in zip(b.column(n_cols), *draws, strict=True)]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                                 names=[*b.schema.names[:n_cols], *ADDED])

    null = F.lit(None)
    schema = docs_in.select("*", *[null.cast("string" if n in ("form", "output") else "long").alias(n) for n in ADDED]).schema
    wide = docs_in.withColumn(copy, F.col(text)).withColumns(dict(zip(drawn, draws_of(F.col(key), seed), strict=True)))
    return wide.mapInArrow(run, schema)


def restore(form: Column, output: Column) -> Column:
    """The text again. The parts hold no marker, and none can arise where a
    part meets a marker, since each begins with its only ``<``."""
    part = F.split(output, "|".join(MARKERS), -1)
    return (F.when(form == "psm", F.concat(part[1], part[3], part[2]))
             .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output))
