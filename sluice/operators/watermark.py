"""Extraction watermarks and incremental runs.

A watermark is per connector: ``(ts TIMESTAMP, last_id STRING)``, stored in
a ``connector_state`` table. Advancing is a grouped aggregate (partial
aggregation, no hot-key sort); bump/rolling rules are expressions over the
aggregate joined with the previous state (one row per connector).
``as_of`` is always an argument -- never ``now()`` -- so runs repeat.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.jsonpath import read_instant, read_monotonic_id
from sluice.functions.timefmt import overlap_seconds
from sluice.operators.extract import page_records_array
from sluice.sources.landed import PAGES_SCHEMA

STATE_COLUMNS = ("connector_id", "ts", "last_id")
ROLLING_END_OFFSET_S = 60      # fixed value: rolling window end = as_of + 1 minute


def _lit_ts(as_of) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def record_times(records: DataFrame, path: str, keys: Sequence[str] = ("connector_id",)) -> DataFrame:
    return records.select(*keys, read_instant("rec", path).alias("t"))


def advance_timestamp(records: DataFrame, path: str, prev: DataFrame | None = None,
                      keys: Sequence[str] = ("connector_id",)) -> DataFrame:
    """``greatest(prev.ts, max(instant at path))`` per connector.
    Unparseable/missing times are ignored; connectors without records keep
    their previous value (they are not in the output)."""
    keys = list(keys)
    agg = record_times(records, path, keys).groupBy(*keys).agg(F.max("t").alias("new_ts"))
    if prev is None:
        return agg.select(*keys, F.col("new_ts").alias("ts"))
    j = agg.join(prev.select(*keys, F.col("ts").alias("prev_ts")), keys, "left")
    return j.select(*keys, F.greatest("prev_ts", "new_ts").alias("ts"))


def advance_monotonic(records: DataFrame, path: str, prev: DataFrame | None = None,
                      keys: Sequence[str] = ("connector_id",)) -> DataFrame:
    """Largest id per connector, previous ``last_id`` included. Numeric
    comparison when any id is an integer, else text comparison (documented
    choice for mixed sets, whose order-dependent reference result is not
    reproducible)."""
    keys = list(keys)
    ids = records.select(*keys, read_monotonic_id("rec", path).alias("id"))
    if prev is not None:
        ids = ids.unionByName(prev.select(*keys, F.col("last_id").alias("id")))
    ids = ids.filter(F.col("id").isNotNull() & (F.trim("id") != ""))
    num = F.when(F.col("id").rlike(r"^[+-]?[0-9]+$"), F.col("id").try_cast("bigint"))
    agg = ids.groupBy(*keys).agg(F.max(num).alias("nmax"), F.max("id").alias("tmax"))
    return agg.select(*keys, F.coalesce(F.col("nmax").cast("string"), F.col("tmax")).alias("last_id"))


def rolling_window(prev: DataFrame, overlap: Column | str, as_of,
                   keys: Sequence[str] = ("connector_id",)) -> DataFrame:
    """``end = as_of + 1 minute``, ``start = coalesce(prev.ts, end) - overlap``."""
    end = _lit_ts(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ROLLING_END_OFFSET_S))
    ov = overlap_seconds(F.col(overlap) if isinstance(overlap, str) and overlap in prev.columns
                         else F.lit(overlap) if isinstance(overlap, str) else overlap)
    start = F.coalesce(F.col("ts"), end) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ov)
    return prev.select(*keys, start.alias("start"), end.alias("end"))


def rolling_advance(new_ts: DataFrame, incremental: Column, as_of,
                    keys: Sequence[str] = ("connector_id",)) -> DataFrame:
    """Full sync -> max timestamp seen; incremental -> the window end."""
    end = _lit_ts(as_of) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ROLLING_END_OFFSET_S))
    return new_ts.select(*keys, F.when(incremental, end).otherwise(F.col("ts")).alias("ts"))


def bump_if_unchanged(advanced: DataFrame, prev: DataFrame | None, as_of,
                      keys: Sequence[str] = ("connector_id",)) -> DataFrame:
    """W4 (incremental timestamp runs): a watermark that did not move past the
    previous one -- or that has no previous one -- becomes ``as_of``."""
    keys = list(keys)
    a = advanced
    if prev is None:
        return a.select(*keys, F.when(F.col("ts").isNotNull(), _lit_ts(as_of)).alias("ts"))
    j = a.join(prev.select(*keys, F.col("ts").alias("prev_ts")), keys, "left")
    ts = F.when(F.col("ts").isNotNull() & (F.col("prev_ts").isNull() | (F.col("ts") <= F.col("prev_ts"))),
                _lit_ts(as_of)).otherwise(F.col("ts"))
    return j.select(*keys, ts.alias("ts"))


def choose_mode(connectors: DataFrame, state: DataFrame, requested: str = "sync_type") -> DataFrame:
    """full/sample requests -> full; incremental disabled -> full; no
    stored watermark -> incremental only when ``on_first_run`` is not
    ``full``; else incremental. ``connectors`` needs connector_id,
    ``sync_type``, ``inc_enabled``, ``inc_mode`` and ``on_first_run``."""
    st = state.select("connector_id", F.col("ts").alias("__ts"), F.col("last_id").alias("__id"))
    j = connectors.join(st, "connector_id", "left")
    has_wm = F.when(F.col("inc_mode") == "monotonic_id", F.col("__id").isNotNull()) \
              .otherwise(F.col("__ts").isNotNull())
    req = F.lower(F.coalesce(F.col(requested), F.lit("incremental")))
    mode = (F.when(req.isin("full", "sample"), F.lit("full"))
             .when(~F.coalesce(F.col("inc_enabled"), F.lit(False)), F.lit("full"))
             .when(~has_wm, F.when(F.lower(F.coalesce("on_first_run", F.lit(""))) == "full", F.lit("full"))
                   .otherwise(F.lit("incremental")))
             .otherwise(F.lit("incremental")))
    return j.select("connector_id", mode.alias("mode"))


def persistable(runs: DataFrame) -> DataFrame:
    """State rows to persist: not sample runs, incremental enabled, the
    mode's field set, and the sink succeeded (status ``success``)."""
    field = F.when(F.col("inc_mode") == "monotonic_id", F.col("last_id").isNotNull()) \
             .otherwise(F.col("ts").isNotNull())
    ok = ((F.lower("run_type") != "sample") & F.coalesce(F.col("inc_enabled"), F.lit(False))
          & field & (F.col("status") == "success"))
    return runs.filter(ok).select(*STATE_COLUMNS)


def state_upsert(state: DataFrame, new: DataFrame, as_of) -> DataFrame:
    """replace/insert state rows by connector (K2 on connector_state)."""
    upd = new.select(*STATE_COLUMNS, _lit_ts(as_of).alias("updated_at"))
    kept = state.join(upd.select("connector_id"), "connector_id", "left_anti")
    return kept.unionByName(upd, allowMissingColumns=True)


def state_reset(state: DataFrame, reset: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """Delete state of the given connectors; returns (new state, audit rows)."""
    kept = state.join(reset.select("connector_id"), "connector_id", "left_anti")
    audit = (state.join(reset.select("connector_id"), "connector_id", "left_semi")
             .select("connector_id", F.lit("reset_state").alias("action"),
                     F.to_json(F.struct("ts", "last_id")).alias("detail"),
                     _lit_ts(as_of).alias("at")))
    return kept, audit


def watermark_lag(state: DataFrame, as_of) -> DataFrame:
    """``max(0, as_of - ts)`` in seconds; 0 when there is no watermark."""
    lag = F.coalesce(F.greatest(F.lit(0).cast("bigint"),
                                F.unix_seconds(_lit_ts(as_of)) - F.unix_seconds(F.col("ts"))),
                     F.lit(0).cast("bigint"))
    return state.select("connector_id", lag.alias("lag_seconds"))


def slice_since_id(src: DataFrame, id_col: str, since: Column | None) -> DataFrame:
    """Rows with ``id > since_id`` (all rows without a since id, also row by row)."""
    return src if since is None else src.filter(since.isNull() | (F.col(id_col) > since))


def slice_window(src: DataFrame, t_col: str, start, end, closed: bool = False) -> DataFrame:
    """Half-open ``start <= t < end`` (rolling) or closed ``[start, end]``
    where rows without a time are kept. Literal bounds push down to Parquet."""
    t = F.col(t_col)
    s, e = _lit_ts(start), _lit_ts(end)
    if closed:
        return src.filter(t.isNull() | ((t >= s) & (t <= e)))
    return src.filter((t >= s) & (t < e))


ZONE_SCHEMA = "file string, lo timestamp, hi timestamp, n bigint, open bigint"


def add_zones(spark, landed: str, zones: str, input_root: str, field: str, fmt: str = "parquet") -> int:
    """W9 over landed pages: notes the smallest and largest ``field`` (an instant
    inside the JSON body, which Parquet statistics cannot reach) of each page
    file, its records, and those without the field, in the table at ``zones``.
    Only files that it does not list yet are read. Returns the files added.

    Page files are never changed once landed, and their paths hold no character
    that a URI escapes. Files that hold no page have no zone: they are always read."""
    pages = spark.read.schema(PAGES_SCHEMA).format(fmt).load(landed)
    files = spark.createDataFrame([(f,) for f in pages.inputFiles()], "path string").withColumn("file", _file_name(F.col("path")))
    known = _zones(spark, zones)
    if known is not None:
        files = files.join(known.select("file"), "file", "left_anti")
    new = [r["path"] for r in files.select("path").collect()]
    if not new:
        return 0
    found = spark.read.schema(PAGES_SCHEMA).format(fmt).load(new).select(_file_name(F.col("_metadata.file_path")).alias("file"), page_records_array(F.col("body"), input_root).alias("recs"))
    records = found.select("file", F.explode_outer("recs").alias("rec"))
    t = read_instant(F.col("rec"), field)
    made = records.groupBy("file").agg(F.min(t).alias("lo"), F.max(t).alias("hi"), F.count("rec").alias("n"), F.count_if(F.col("rec").isNotNull() & t.isNull()).alias("open"))
    made.select("file", "lo", "hi", "n", "open").coalesce(8).write.mode("append").parquet(zones)
    return len(new)


def _file_name(path: Column) -> Column:
    """A path with one slash after its scheme: listings and rows write local ones differently."""
    return F.regexp_replace(path, r"^([A-Za-z0-9]+):/+", "$1:/")


def _zones(spark, zones: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(zones)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(ZONE_SCHEMA).parquet(zones).dropDuplicates(["file"])


def pages_within(spark, landed: str, zones: str, start, end, closed: bool = False, fmt: str = "parquet") -> DataFrame:
    """The pages of the files whose zone meets the slice (as in ``slice_window``;
    ``closed`` keeps records without a time, so their files too), and of files
    that have no zone yet. Their records are still to be sliced. The names of
    the files go through the driver, as those of any scan do."""
    names = spark.read.schema(PAGES_SCHEMA).format(fmt).load(landed).inputFiles()
    listed = spark.createDataFrame([(f,) for f in names], "path string").withColumn("file", _file_name(F.col("path")))
    known = _zones(spark, zones)
    if known is not None:
        s, e = _lit_ts(start), _lit_ts(end)
        meets = (F.col("hi") >= s) & ((F.col("lo") <= e) if closed else (F.col("lo") < e))
        keep = F.coalesce(meets, F.lit(False)) | ((F.col("open") > 0) if closed else F.lit(False))
        listed = listed.join(known.select("file", keep.alias("keep")), "file", "left").filter(F.coalesce("keep", F.lit(True)))
    chosen = [r["path"] for r in listed.select("path").collect()]
    if not chosen:
        return spark.createDataFrame([], PAGES_SCHEMA)
    return spark.read.schema(PAGES_SCHEMA).format(fmt).load(chosen)
