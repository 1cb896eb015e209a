"""Sinks (K1-K10): keyed upsert, append, column union, JSON columns,
database upsert statements, key/value message projection, written counts.

``upsert`` is a pure DataFrame function (target, batch) -> new table; the
``write_*`` helpers persist it as a new snapshot under a table folder, never
overwriting the snapshot being read.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sluice.operators.tables import DEFAULT_ORDER, SinkError, dedupe_last, order_columns, upsert_table  # noqa: F401
from sluice.session import scratch_path

def upsert(target: DataFrame | None, batch: DataFrame, keys: Sequence[str],
           order: Sequence[str] = DEFAULT_ORDER, drop_order: bool = True) -> DataFrame:
    """K2: replace all non-key columns of matching keys (NULLs included),
    insert new keys; in-batch duplicates: the last by ``order`` wins.

    new table = (target LEFT ANTI batch keys) UNION batch. Both sides are
    unique per key after the dedupe, so the anti join has no hot keys."""
    last = dedupe_last(batch, keys, order)
    if drop_order:
        last = last.drop(*[c for c in order if c not in keys and c in last.columns])
    if target is None:
        return last
    kept = target.join(last.select(*keys), on=list(keys), how="left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """K4: union by name; columns missing from a frame are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def record_columns(records: DataFrame, rec_col: str = "rec") -> DataFrame:
    """K4 for dynamic (unmapped) records: the union of top-level keys, with
    the number of records carrying each."""
    return (records.select(F.explode(F.map_keys(F.try_variant_get(rec_col, "$", "map<string,variant>")))
                           .alias("column"))
                   .groupBy("column").agg(F.count(F.lit(1)).alias("n_records")))


def default_keys(columns: Sequence[str], keys: Sequence[str] | None) -> list[str]:
    """K5: configured keys, else the first mapped column."""
    if keys:
        return list(keys)
    if not columns:
        raise SinkError("no columns to key on")
    return [columns[0]]


_JSON_COL = re.compile(r"(^raw_json$|_json$)")


def json_columns(df: DataFrame) -> DataFrame:
    """K6: ``raw_json`` / ``*_json`` text columns become VARIANT; blank -> NULL.
    Invalid JSON is reported in ``__json_error`` (the column name)."""
    types = dict(df.dtypes)
    js = [c for c in df.columns if _JSON_COL.search(c) and types[c] == "string"]
    if not js:
        return df
    errs, cols = [], []
    for c in df.columns:
        if c in js:
            txt = F.when(F.trim(F.col(c)) != "", F.col(c))
            errs.append(F.when(txt.isNotNull() & F.try_parse_json(txt).isNull(), F.lit(c)))
            cols.append(F.try_parse_json(txt).alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols, F.coalesce(*errs).alias("__json_error"))


def check_target(name: str | None, what: str = "table") -> str:
    """K7: a blank table/topic name is an error."""
    if name is None or not str(name).strip():
        raise SinkError(f"sink {what} is required")
    return str(name).strip()


def quote_ident(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def upsert_statement(table: str, columns: Sequence[str], keys: Sequence[str]) -> str:
    """K8: ``INSERT .. ON CONFLICT (keys) DO UPDATE SET c = EXCLUDED.c``
    (``DO NOTHING`` when there are no non-key columns to update; a plain
    insert without keys)."""
    check_target(table)
    cols = ", ".join(quote_ident(c) for c in columns)
    params = ", ".join("?" for _ in columns)
    tbl = ".".join(quote_ident(p) for p in table.split("."))
    sql = f"INSERT INTO {tbl} ({cols}) VALUES ({params})"
    upd = [c for c in columns if c not in keys]
    if keys:
        sql += f" ON CONFLICT ({', '.join(quote_ident(k) for k in keys)}) "
        sql += ("DO UPDATE SET " + ", ".join(f"{quote_ident(c)} = EXCLUDED.{quote_ident(c)}" for c in upd)
                if upd else "DO NOTHING")
    return sql


def message_projection(df: DataFrame, keys: Sequence[str] | None) -> DataFrame:
    """K9: key = text of the first key field (or NULL), value = JSON of the
    whole record with nulls kept -- the shape the Kafka writer takes."""
    key = F.col(keys[0]).cast("string") if keys else F.lit(None).cast("string")
    return df.select(key.alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns]),
                               {"ignoreNullFields": "false"}).alias("value"))


def write_kafka(df: DataFrame, topic: str, keys: Sequence[str] | None, fmt: str = "kafka", **options) -> int:
    """K9 write (needs the Kafka connector jar; acks=all as the reference);
    returns the messages written, observed on the write itself (K10)."""
    check_target(topic, "topic")
    obs = Observation(f"kafka_{uuid.uuid4().hex[:8]}")
    (message_projection(df, keys).observe(obs, F.count(F.lit(1)).alias("n")).write.format(fmt)
     .option("topic", topic).option("kafka.acks", "all").options(**options).mode("append").save())
    return int(obs.get["n"])


def write_jdbc_upsert(df: DataFrame, url: str, table: str, keys: Sequence[str],
                      batch_size: int = 1000, max_connections: int = 5,
                      connect: Callable | None = None, loads_table: str | None = None) -> int:
    """K8 write: per-partition batched statements, one transaction a partition
    (a DB-API ``connect(url)`` factory must be supplied; no driver ships here).
    The rows are staged in the shared folder first, so only the writing, not
    the stages before it, runs in ``max_connections`` tasks; K10 counts them there.

    A task that fails rolls back and closes. Retried or run twice, a keyed
    upsert leaves the same rows; plain inserts do if ``loads_table`` names a
    table ``(load_id text, part int)``: each part leaves its mark there in the
    transaction of its rows, and a part that has its mark is done."""
    if connect is None:
        raise SinkError("write_jdbc_upsert needs a connect(url) factory")
    spark = df.sparkSession
    staged = scratch_path(spark, "jdbc")
    obs = Observation(f"jdbc_{uuid.uuid4().hex[:8]}")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.parquet(staged)
    rows = spark.read.schema(df.schema).parquet(staged)
    cols, load = df.columns, staged.rsplit("/", 1)[-1]
    sql = upsert_statement(table, cols, keys)
    # A row's part follows from the row alone, so a retried task has the same rows.
    part = F.pmod(F.xxhash64(*(keys or cols)), F.lit(max_connections)).cast("int")

    def write(found):
        conn, marked = connect(url), set()
        try:
            cur, batch = conn.cursor(), []
            for r in found:
                p = r["__part"]
                if loads_table and p not in marked:
                    cur.execute(f"SELECT 1 FROM {loads_table} WHERE load_id = ? AND part = ?", (load, p))
                    if cur.fetchone():
                        return
                    cur.execute(f"INSERT INTO {loads_table} (load_id, part) VALUES (?, ?)", (load, p))
                    marked.add(p)
                batch.append(tuple(r[c] for c in cols))
                if len(batch) >= batch_size:
                    cur.executemany(sql, batch)
                    batch = []
            if batch:
                cur.executemany(sql, batch)
            conn.commit()
        except BaseException:
            conn.rollback()
            raise
        finally:
            conn.close()
    # Partition ids as keys: each part in a task of its own.
    rows.withColumn("__part", part).repartitionByRange(max_connections, "__part").foreachPartition(write)
    return int(obs.get["n"])


# ---- snapshot tables (K2/K3 persistence) ----------------------------------

def _fs(spark, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def snapshot_versions(spark, base: str) -> list[int]:
    """Committed snapshot numbers (folders ``v=N`` holding ``_SUCCESS``)."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name[2:]))
    return sorted(out)


def read_snapshot(spark, base: str) -> DataFrame | None:
    vs = snapshot_versions(spark, base)
    return spark.read.parquet(f"{base}/v={vs[-1]}") if vs else None


def write_snapshot(df: DataFrame, base: str, partition_by: Sequence[str] = ()) -> tuple[int, int]:
    """Write ``df`` as the next snapshot; returns (version, rows written).
    The row count is observed on the write action itself (K10)."""
    spark = df.sparkSession
    vs = snapshot_versions(spark, base)
    v = (vs[-1] + 1) if vs else 1
    obs = Observation(f"rows_v{v}")
    w = df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{base}/v={v}")
    return v, int(obs.get["n"])


def write_upsert(batch: DataFrame, base: str, keys: Sequence[str],
                 order: Sequence[str] = DEFAULT_ORDER) -> tuple[int, int]:
    """K2 persisted: merge ``batch`` into the latest snapshot, write the next."""
    spark = batch.sparkSession
    new = upsert(read_snapshot(spark, base), batch, keys, order)
    return write_snapshot(new, base)


def write_append(batch: DataFrame, base: str) -> int:
    """K3: plain insert (append) into the table folder; returns rows written."""
    obs = Observation("append_rows")
    batch.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(base)
    return int(obs.get["n"])


# ---- K1 routing -------------------------------------------------------------

SINKS: dict[str, Callable] = {}


def register_sink(name: str):
    def deco(fn):
        SINKS[name] = fn
        return fn
    return deco


def route(sink_type: str | None) -> Callable:
    """K1: blank type = postgresql; an unknown or unregistered type is an error."""
    t = (sink_type or "").strip().lower() or "postgresql"
    if t not in SINKS:
        raise SinkError(f"no sink registered for type {t!r}")
    return SINKS[t]


def is_upsert(write_mode: str | None) -> bool:
    """K3: blank means upsert; ``insert`` (or ``append``) keeps every row."""
    mode = (write_mode or "").strip().lower() or "upsert"
    if mode not in ("upsert", "insert", "append"):
        raise SinkError(f"unknown write mode {write_mode!r}")
    return mode == "upsert"


def without_order(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in DEFAULT_ORDER if c in df.columns])


@register_sink("parquet")
def _parquet_sink(df: DataFrame, table: str, keys: Sequence[str] = (), write_mode: str | None = "upsert", **opts):
    check_target(table)
    data = without_order(df)
    if not is_upsert(write_mode):
        return write_append(data, table)
    ks = default_keys(data.columns, keys)
    obs = Observation(f"upsert_{uuid.uuid4().hex[:8]}")
    upsert_table(df, table, ks, observed=obs, **{k: opts[k] for k in ("buckets", "target") if k in opts})
    return int(obs.get["n"])


@register_sink("kafka")
def _kafka_sink(df: DataFrame, topic: str, keys: Sequence[str] = (), write_mode: str | None = None, **opts):
    return write_kafka(without_order(df), topic, keys, **opts)


@register_sink("postgresql")
def _pg_sink(df: DataFrame, table: str, keys: Sequence[str] = (), url: str | None = None,
             connect: Callable | None = None, batch_size: int = 1000, write_mode: str | None = "upsert", loads_table: str | None = None, **_):
    check_target(table)
    data, how = without_order(df), {"batch_size": batch_size, "connect": connect, "loads_table": loads_table}
    if not is_upsert(write_mode):
        return write_jdbc_upsert(data, url or "", table, [], **how)
    ks = default_keys(data.columns, keys)
    return write_jdbc_upsert(without_order(dedupe_last(df, ks)), url or "", table, ks, **how)
