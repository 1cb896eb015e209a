"""Keyed tables under a commit log.

A store is a folder with a log and the tables the log names. Version N is one
small JSON file ``_log/N``: for every table its bucket directory (which file
folder holds a bucket, and its rows), and for every writer the last batch it
committed. A version is put there only if nobody has put it there before, so
of two writers that started from the same version one wins; the other starts
again from the winner's version with its rows as it staged them. Everything a
version changes (rows, watermarks, run rows) becomes visible with that one
file; a writer that breaks off before leaves the store as it was.

Writers are named: a batch is skipped if the log says that this writer has
committed it, whatever other writers or earlier checkpoints did.

Tables grow by linear hashing. The directory holds ``first * 2^level + split``
buckets: a key's bucket is its hash modulo ``first * 2^level``, or modulo twice
that where the result is below ``split``. When a table outgrows its buckets
the next ones in turn are split in two, so the files of all others stay as
they are, and no batch reads or writes more than the buckets it has keys of
and those it splits. Key columns and their types are part of the table.

The log needs a file system whose rename fails if the target exists (HDFS and
the like, as stream checkpoints do); on local disks a hard link serves.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.session import scratch_path

BUCKETS = 16               # of a new table, unless its first batch asks for more
TARGET_ROWS = 1_000_000    # a bucket; those not yet split in a round hold up to twice as many
FILL = 0.75                # of the target: mean rows a bucket at which splitting begins
BUCKET = "__bucket"


# A later run's record replaces an earlier run's, whatever its page.
DEFAULT_ORDER = ("run_started_at", "run_id", "page_idx", "pos")


class SinkError(ValueError):
    pass


def order_columns(batch: DataFrame, order: Sequence[str]) -> list[str]:
    """The columns of ``order`` that the batch has."""
    found = [c for c in order if c in batch.columns]
    if not found:
        raise SinkError("upsert needs one of the order columns " + ", ".join(order))
    return found


def dedupe_last(batch: DataFrame, keys: Sequence[str], order: Sequence[str] = DEFAULT_ORDER,
                quarantine: bool = False) -> DataFrame:
    """K2 (in-batch): one row per key, the last by ``order`` wins.

    ``max_by(struct(row), struct(order))`` is an ordinary aggregate, so it
    combines map-side: a key holding a third of the batch is reduced in every
    task before the shuffle instead of being sorted in one task."""
    keys = list(keys)
    if not keys:
        raise SinkError("upsert needs at least one key column")
    cols = [c for c in batch.columns if c not in keys]
    if not quarantine:
        any_null = F.greatest(*[F.col(k).isNull() for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull()
        # The check sits in a filter so the optimizer cannot prune it.
        batch = batch.filter(F.coalesce(
            F.when(any_null, F.raise_error(F.lit("null value in upsert key " + ",".join(keys)))).cast("boolean"),
            F.lit(True)))
    else:
        batch = batch.dropna(subset=keys)
    if not cols:
        return batch.select(*keys).distinct()
    by = F.struct(*order_columns(batch, order))
    agg = batch.groupBy(*keys).agg(F.max_by(F.struct(*cols), by).alias("__last"))
    return agg.select(*keys, *[F.col("__last")[c].alias(c) for c in cols])


@dataclass(frozen=True)
class Directory:
    """One table as the log has it. ``files``: bucket -> (folder, rows); a bucket without rows has none."""
    keys: tuple[tuple[str, str], ...]
    schema: str
    first: int
    target: int
    level: int = 0
    split: int = 0
    files: Mapping[int, tuple[str, int]] = field(default_factory=dict)

    @property
    def buckets(self) -> int:
        return (self.first << self.level) + self.split

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.files.values())

    def address(self, h: Column) -> Column:
        low, high = F.pmod(h, F.lit(self.first << self.level)), F.pmod(h, F.lit(self.first << (self.level + 1)))
        return F.when(low < self.split, high).otherwise(low).cast("int")

    def grown(self, rows: int) -> Directory:
        """The directory with as many buckets as ``rows`` need; files as they were."""
        level, split = self.level, self.split
        while ((self.first << level) + split) * self.target * FILL < rows:
            split += 1
            if split == self.first << level:
                level, split = level + 1, 0
        return replace(self, level=level, split=split)

    def parent(self, bucket: int) -> int:
        """The bucket of this directory out of which a later one's ``bucket`` was split."""
        while bucket >= self.buckets:
            bucket -= self.first << ((bucket // self.first).bit_length() - 1)
        return bucket


@dataclass(frozen=True)
class Version:
    number: int
    tables: Mapping[str, Directory]
    writers: Mapping[str, int]
    note: str = ""

    def to_json(self) -> str:
        return json.dumps({"number": self.number, "writers": dict(self.writers), "note": self.note, "tables": {n: asdict(d) for n, d in self.tables.items()}})

    @staticmethod
    def from_json(text: str) -> Version:
        v = json.loads(text)
        tables = {n: Directory(**{**d, "keys": tuple(tuple(k) for k in d["keys"]), "files": {int(b): (f, r) for b, (f, r) in d["files"].items()}}) for n, d in v["tables"].items()}
        return Version(v["number"], tables, v["writers"], v["note"])


# ---- the log -------------------------------------------------------------------

def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under this name unless there is one; of two writers one gets True."""
    jvm = spark._jvm
    fs, target = _path(spark, path)
    if fs.exists(target):
        return False
    fs.mkdirs(target.getParent())
    written = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(written, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if target.toUri().getScheme() == "file":
            nio = jvm.java.nio.file
            nio.Files.createLink(nio.Path.of(target.toUri()), nio.Path.of(written.toUri()))
        else:
            rename = jvm.org.apache.hadoop.fs.Options.Rename
            how = spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(written, target, how)
        return True
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(written, False)


def _log_file(base: str, number: int) -> str:
    return f"{base}/_log/{number:020d}.json"


def versions(spark: SparkSession, base: str) -> list[int]:
    """The committed versions that are still kept, oldest first."""
    fs, folder = _path(spark, f"{base}/_log")
    if not fs.exists(folder):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """The latest version, or the latest up to ``number``."""
    done = [v for v in versions(spark, base) if number is None or v <= number]
    if not done:
        return None
    fs, p = _path(spark, _log_file(base, done[-1]))
    stream = fs.open(p)
    try:
        return Version.from_json(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, base: str, change: Callable[[Version], Version | None], writer: str = "", batch: int | None = None,
           before_commit: Callable[[], None] | None = None) -> int:
    """Apply ``change`` to the latest version and commit the result; again from the winner's if another writer was faster.

    Nothing happens if the log says that ``writer`` has committed ``batch``, or if ``change`` returns None. Returns the version that holds the change."""
    while True:
        now = read_version(spark, base) or Version(0, {}, {})
        if batch is not None and now.writers.get(writer, -1) >= batch:
            return now.number
        new = change(now)
        if new is None:
            return now.number
        writers = {**now.writers, writer: batch} if batch is not None else now.writers
        new = replace(new, number=now.number + 1, writers=writers)
        if before_commit is not None:
            before_commit()
        if put_if_absent(spark, _log_file(base, new.number), new.to_json()):
            return new.number


# ---- tables ----------------------------------------------------------------------

def read_table(spark: SparkSession, base: str, name: str = "rows", version: int | None = None) -> DataFrame | None:
    """A table of the store at its latest (or the given) version; None if that has no such table."""
    v = read_version(spark, base, version)
    return None if v is None or name not in v.tables else _read(spark, base, v.tables[name])


def _read(spark: SparkSession, base: str, table: Directory, buckets: Sequence[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(table.schema))
    held = sorted(table.files if buckets is None else set(buckets) & set(table.files))
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/{table.files[b][0]}/{BUCKET}={b}" for b in held])


def _merged_schema(old: T.StructType, new: T.StructType) -> T.StructType:
    """Old columns, then new ones; a column can't change its type."""
    known = {f.name: f.dataType for f in old.fields}
    for f in new.fields:
        if f.name in known and known[f.name] != f.dataType:
            raise SinkError(f"column {f.name!r} is {known[f.name].simpleString()} in the table and {f.dataType.simpleString()} in the batch")
    fields = [*old.fields, *[f for f in new.fields if f.name not in known]]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def _dealt(spark: SparkSession, base: str, rows: DataFrame, folder: str) -> dict[int, tuple[str, int]]:
    """Write rows that carry their bucket, a bucket in one task; returns bucket -> (folder, rows)."""
    rows.write.partitionBy(BUCKET).parquet(f"{base}/{folder}")
    counts = spark.read.parquet(f"{base}/{folder}").groupBy(BUCKET).count().collect()      # a row a bucket; the files' footers alone
    return {r[BUCKET]: (folder, r["count"]) for r in counts}


@dataclass(frozen=True)
class Staged:
    """A batch with one row per key, written once, whatever number of attempts its commit takes."""
    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]


def stage_batch(batch: DataFrame, keys: Sequence[str], order: Sequence[str], observed: Observation | None = None) -> Staged:
    last = dedupe_last(batch, keys, order)
    if observed is not None:
        last = last.observe(observed, F.count(F.lit(1)).alias("n"))
    path = scratch_path(batch.sparkSession, "table-batch")
    last.write.parquet(path)
    return Staged(batch.sparkSession.read.schema(last.schema).parquet(path), tuple(keys), tuple(order))


def merge(spark: SparkSession, base: str, name: str, old: Directory | None, staged: Staged, buckets: int = BUCKETS, target: int = TARGET_ROWS) -> Directory:
    """The table with the batch merged in: last row by the order wins, be it in the table or in the batch.

    Buckets without keys of the batch are not read. Then buckets are split as the table has grown."""
    rows = staged.rows
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if old is None:
        arriving = rows.count()
        old = Directory(tuple((k, kinds[k]) for k in staged.keys), T.StructType([]).json(), max(buckets, 1), target)
        old = replace(old, first=max(old.first, -(-arriving // int(target * FILL))))
    if [k for k, _ in old.keys] != list(staged.keys):
        raise SinkError(f"the table's key is {', '.join(k for k, _ in old.keys)}; the batch has {', '.join(staged.keys)}")
    for k, kind in old.keys:
        if kinds[k] != kind:
            rows = rows.withColumn(k, F.col(k).cast(kind))
    known = T.StructType.fromJson(json.loads(old.schema))
    schema = _merged_schema(known, rows.schema)
    key_hash = F.xxhash64(*staged.keys)
    new = rows.withColumn(BUCKET, old.address(key_hash))
    touched = [0] if old.buckets == 1 else [r[0] for r in new.select(BUCKET).distinct().collect()]            # numbers of buckets
    if not touched or old.buckets == 1 and not old.files and new.isEmpty():
        return replace(old, schema=schema.json())
    held = _read(spark, base, replace(old, schema=schema.json()), touched)
    both = held.withColumn(BUCKET, old.address(key_hash)).unionByName(new, allowMissingColumns=True) if set(touched) & set(old.files) else new
    merged = dedupe_last(both.repartition(BUCKET), [*staged.keys, BUCKET], staged.order)
    folder = f"{name}/{uuid.uuid4().hex}"
    files = {**old.files, **_dealt(spark, base, merged.select(*schema.names, BUCKET), folder)}
    now = replace(old, schema=schema.json(), files=files)
    grown = now.grown(now.rows)
    if grown.buckets == now.buckets:
        return now
    parents = {now.parent(b) for b in range(now.buckets, grown.buckets)}
    moved = _read(spark, base, now, sorted(parents)).withColumn(BUCKET, grown.address(key_hash))
    again = _dealt(spark, base, moved.repartition(BUCKET), f"{name}/{uuid.uuid4().hex}") if parents & set(files) else {}
    return replace(grown, files={**{b: f for b, f in files.items() if b not in parents}, **again})


def upsert_table(batch: DataFrame, base: str, keys: Sequence[str], order: Sequence[str] = DEFAULT_ORDER, name: str = "rows", buckets: int = BUCKETS,
                 target: int = TARGET_ROWS, writer: str = "", batch_id: int | None = None, observed: Observation | None = None) -> int:
    """K2 persisted: merge a batch into a table of the store and commit it; returns the version. ``observed`` gets the batch's rows, one per key."""
    spark = batch.sparkSession
    if batch_id is not None and committed(spark, base, writer, batch_id):
        return read_version(spark, base).number
    staged = stage_batch(batch, keys, order, observed)
    return commit(spark, base, lambda v: replace(v, tables={**v.tables, name: merge(spark, base, name, v.tables.get(name), staged, buckets, target)}), writer, batch_id)


def committed(spark: SparkSession, base: str, writer: str, batch_id: int) -> bool:
    """Whether the log has this batch of this writer."""
    v = read_version(spark, base)
    return v is not None and v.writers.get(writer, -1) >= batch_id


def drop_old_versions(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Remove log files beyond the last ``keep`` versions, and the bucket folders that only those had. Returns the versions removed.

    Folders that no version names are left: a writer may be about to commit them."""
    done = versions(spark, base)
    old, kept = done[:-keep], done[-keep:]
    folders = lambda number: {f"{f}/{BUCKET}={b}" for d in read_version(spark, base, number).tables.values() for b, (f, _) in d.files.items()}
    used = set().union(*[folders(v) for v in kept])
    gone = set().union(*[folders(v) for v in old]) - used
    for folder in gone:
        fs, p = _path(spark, f"{base}/{folder}")
        fs.delete(p, True)
    for v in old:
        fs, p = _path(spark, _log_file(base, v))
        fs.delete(p, False)
    return old
