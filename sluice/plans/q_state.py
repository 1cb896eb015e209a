"""Registered queries for watermarks (W), request planning (P) and page
selection / stop rules (G)."""
from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from sluice.functions.jsonpath import read_instant
from sluice.functions.timefmt import iso_instant_text, overlap_seconds
from sluice.operators import extract as X
from sluice.operators import paging as G
from sluice.operators import requests as P
from sluice.operators import sync as Y
from sluice.operators import tables as B
from sluice.operators import watermark as W
from sluice.plans.registered import iso_ts, register
from sluice.session import scratch_path
from sluice.sources.landed import (
    customer_connectors, dealt, event_pages, land_pages, order_pages, prior_state, read_table,
    rich_event_pages, user_connectors,
)

AS_OF = "2024-02-01 00:00:00"

# ---- DuckDB fragments --------------------------------------------------------
PREV = """(SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, user_id,
  CASE WHEN user_id % 7 = 0 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE max(ts) END AS ts,
  CASE WHEN user_id % 10 = 0 THEN 'evt-' || CAST(user_id AS VARCHAR)
       WHEN user_id % 3 = 0 THEN CAST(user_id * 50 AS VARCHAR) END AS last_id
  FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)"""
NEWTS = """(SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, user_id, max(ts) AS ts
  FROM events GROUP BY user_id)"""
ADV = f"""(SELECT n.connector_id, n.user_id,
  CASE WHEN p.ts IS NULL OR n.ts > p.ts THEN n.ts ELSE p.ts END AS ts, p.ts AS prev_ts
  FROM {NEWTS} n LEFT JOIN {PREV} p USING (connector_id))"""
UCONN = """(SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, user_id,
  CASE user_id % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' WHEN 2 THEN 'sample' END AS sync_type,
  user_id % 5 <> 0 AS inc_enabled,
  CASE WHEN user_id % 3 = 0 THEN 'monotonic_id' ELSE 'timestamp' END AS inc_mode,
  CASE WHEN user_id % 2 = 0 THEN 'full' ELSE 'incremental' END AS on_first_run,
  CASE user_id % 6 WHEN 0 THEN user_id % 60 WHEN 1 THEN (user_id % 60) * 60 WHEN 2 THEN (user_id % 24) * 3600
    WHEN 3 THEN 0 WHEN 4 THEN 300 ELSE 0 END AS overlap_s,
  CASE user_id % 4 WHEN 0 THEN 'iso_instant' WHEN 1 THEN 'epoch_ms' WHEN 2 THEN 'dahua_utc'
    ELSE 'meiya_datetime' END AS time_format
  FROM events GROUP BY user_id)"""
MONO = f"""(SELECT c AS connector_id, coalesce(CAST(max(CASE WHEN regexp_full_match(id, '[+-]?[0-9]+')
    THEN TRY_CAST(id AS BIGINT) END) AS VARCHAR), max(id)) AS last_id FROM (
  SELECT 'user-' || CAST(user_id AS VARCHAR) AS c, CASE WHEN user_id % 10 = 0 THEN 'evt-' || lpad(CAST(event_id AS VARCHAR), 6, '0')
    ELSE CAST(event_id AS VARCHAR) END AS id FROM events
  UNION ALL SELECT connector_id, last_id FROM {PREV} WHERE last_id IS NOT NULL) GROUP BY c)"""


def fmt_sql(ts: str, fmt_col: str) -> str:
    return (f"CASE {fmt_col} WHEN 'epoch_ms' THEN CAST(epoch_us({ts}) // 1000 AS VARCHAR) "
            f"WHEN 'dahua_utc' THEN strftime({ts}, '%Y%m%dT%H%M%SZ') "
            f"WHEN 'meiya_datetime' THEN strftime({ts}, '%Y-%m-%d %H:%M:%S') ELSE {iso_ts(ts)} END")


def _urecs(spark, sf):
    return X.extract_records(rich_event_pages(spark, sf, page_size=10, per_user=True), "$.data")


def _fmt_by(ts, fmt_col):
    from sluice.functions.timefmt import format_instant
    return (F.when(F.col(fmt_col) == "epoch_ms", format_instant(ts, "epoch_ms"))
             .when(F.col(fmt_col) == "dahua_utc", format_instant(ts, "dahua_utc"))
             .when(F.col(fmt_col) == "meiya_datetime", format_instant(ts, "meiya_datetime"))
             .otherwise(format_instant(ts, "iso_instant")))


# ---- W -----------------------------------------------------------------------

@register("w1_advance_timestamp", f"SELECT connector_id, {iso_ts('ts')} AS watermark FROM {ADV}")
def w1_advance_timestamp(spark, sf):
    a = W.advance_timestamp(_urecs(spark, sf), "$.ts", prior_state(spark, sf))
    return a.select("connector_id", iso_instant_text("ts").alias("watermark"))


@register("w2_advance_monotonic_id", f"SELECT connector_id, last_id FROM {MONO}")
def w2_advance_monotonic_id(spark, sf):
    return W.advance_monotonic(_urecs(spark, sf), "$.rid", prior_state(spark, sf))


@register("w3_rolling_advance", f"""
SELECT connector_id, {iso_ts("CASE WHEN user_id % 2 = 1 THEN TIMESTAMP '2024-02-01 00:01:00' ELSE ts END")} AS watermark
FROM {NEWTS}""")
def w3_rolling_advance(spark, sf):
    a = W.advance_timestamp(_urecs(spark, sf), "$.ts")
    a = a.withColumn("__inc", F.regexp_extract("connector_id", r"(\d+)$", 1).cast("int") % 2 == 1)
    r = W.rolling_advance(a.select("connector_id", "ts", "__inc"), F.col("__inc"), AS_OF)
    return r.select("connector_id", iso_instant_text("ts").alias("watermark"))


@register("w4_bump_if_unchanged", f"""
SELECT connector_id, {iso_ts("CASE WHEN prev_ts IS NULL OR ts <= prev_ts THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END")} AS watermark
FROM {ADV}""")
def w4_bump_if_unchanged(spark, sf):
    prev = prior_state(spark, sf)
    a = W.advance_timestamp(_urecs(spark, sf), "$.ts", prev)
    b = W.bump_if_unchanged(a, prev, AS_OF)
    return b.select("connector_id", iso_instant_text("ts").alias("watermark"))


@register("w5_choose_mode", f"""
SELECT c.connector_id, CASE WHEN lower(coalesce(sync_type, 'incremental')) IN ('full', 'sample') THEN 'full'
  WHEN NOT inc_enabled THEN 'full'
  WHEN (CASE WHEN inc_mode = 'monotonic_id' THEN p.last_id IS NULL ELSE p.ts IS NULL END)
    THEN CASE WHEN on_first_run = 'full' THEN 'full' ELSE 'incremental' END
  ELSE 'incremental' END AS mode
FROM {UCONN} c LEFT JOIN {PREV} p USING (connector_id)""")
def w5_choose_mode(spark, sf):
    return W.choose_mode(user_connectors(spark, sf), prior_state(spark, sf))


@register("w6_persist_rule", f"""
SELECT a.connector_id, {iso_ts('a.ts')} AS ts, m.last_id
FROM {ADV} a JOIN {MONO} m USING (connector_id) JOIN {UCONN} c USING (connector_id)
WHERE coalesce(c.sync_type, 'incremental') <> 'sample' AND c.inc_enabled AND c.user_id % 6 <> 5
  AND (CASE WHEN c.inc_mode = 'monotonic_id' THEN m.last_id IS NOT NULL ELSE a.ts IS NOT NULL END)""")
def w6_persist_rule(spark, sf):
    prev = prior_state(spark, sf)
    recs = _urecs(spark, sf)
    ts = W.advance_timestamp(recs, "$.ts", prev)
    ids = W.advance_monotonic(recs, "$.rid", prev)
    c = user_connectors(spark, sf)
    runs = (ts.join(ids, "connector_id").join(c, "connector_id")
            .select("connector_id", "ts", "last_id", "inc_enabled", "inc_mode",
                    F.coalesce("sync_type", F.lit("incremental")).alias("run_type"),
                    F.when(F.col("user_id") % 6 == 5, "failed").otherwise("success").alias("status")))
    return W.persistable(runs).select("connector_id", iso_instant_text("ts").alias("ts"), "last_id")


@register("w7_state_upsert_reset", f"""
SELECT connector_id, {iso_ts('ts')} AS ts, last_id FROM (
  SELECT a.connector_id, a.ts, NULL AS last_id, a.user_id FROM {ADV} a WHERE a.user_id % 2 = 0
  UNION ALL SELECT p.connector_id, p.ts, p.last_id, p.user_id FROM {PREV} p WHERE p.user_id % 2 = 1)
WHERE user_id % 5 <> 0""")
def w7_state_upsert_reset(spark, sf):
    prev = prior_state(spark, sf)
    adv = W.advance_timestamp(_urecs(spark, sf), "$.ts", prev)
    uid = F.regexp_extract("connector_id", r"(\d+)$", 1).cast("int")
    new = adv.filter(uid % 2 == 0).select("connector_id", "ts", F.lit(None).cast("string").alias("last_id"))
    st = W.state_upsert(prev.drop("user_id"), new, AS_OF)
    reset = st.filter(uid % 5 == 0).select("connector_id")
    kept, _audit = W.state_reset(st, reset, AS_OF)
    return kept.select("connector_id", iso_instant_text("ts").alias("ts"), "last_id")


@register("w7_reset_audit", f"""
SELECT connector_id, 'reset_state' AS action FROM (
  SELECT a.connector_id, a.user_id FROM {ADV} a WHERE a.user_id % 2 = 0
  UNION ALL SELECT p.connector_id, p.user_id FROM {PREV} p WHERE p.user_id % 2 = 1) WHERE user_id % 5 = 0""")
def w7_reset_audit(spark, sf):
    prev = prior_state(spark, sf)
    adv = W.advance_timestamp(_urecs(spark, sf), "$.ts", prev)
    uid = F.regexp_extract("connector_id", r"(\d+)$", 1).cast("int")
    new = adv.filter(uid % 2 == 0).select("connector_id", "ts", F.lit(None).cast("string").alias("last_id"))
    st = W.state_upsert(prev.drop("user_id"), new, AS_OF)
    _, audit = W.state_reset(st, st.filter(uid % 5 == 0).select("connector_id"), AS_OF)
    return audit.select("connector_id", "action")


@register("w8_watermark_lag", f"""
SELECT connector_id, greatest(0, CAST(floor(epoch(TIMESTAMP '2024-02-01 00:00:00')) AS BIGINT)
  - CAST(floor(epoch(ts)) AS BIGINT)) AS lag_seconds FROM {ADV}""")
def w8_watermark_lag(spark, sf):
    adv = W.advance_timestamp(_urecs(spark, sf), "$.ts", prior_state(spark, sf))
    return W.watermark_lag(adv, AS_OF)


@register("w9_since_id_slice", f"""
SELECT e.event_id FROM events e LEFT JOIN {PREV} p ON p.user_id = e.user_id
WHERE p.last_id IS NULL OR NOT regexp_full_match(p.last_id, '[0-9]+') OR e.event_id > CAST(p.last_id AS BIGINT)""")
def w9_since_id_slice(spark, sf):
    ev = read_table(spark, sf, "events")
    prev = prior_state(spark, sf).select("user_id", "last_id")
    since = F.when(F.col("last_id").rlike(r"^[0-9]+$"), F.col("last_id").cast("bigint"))
    j = ev.join(prev, "user_id", "left")
    return W.slice_since_id(j, "event_id", since).select("event_id")


@register("w9_rolling_slice", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def w9_rolling_slice(spark, sf):
    ev = read_table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return W.slice_window(ev, "t", "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("event_id")


@register("w9_closed_slice", """
SELECT event_id FROM events WHERE event_type = 'error'
  OR (ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00')""")
def w9_closed_slice(spark, sf):
    ev = read_table(spark, sf, "events").withColumn(
        "t", F.when(F.col("event_type") != "error", F.col("ts").cast("timestamp")))
    return W.slice_window(ev, "t", "2024-01-10 00:00:00", "2024-01-20 00:00:00", closed=True).select("event_id")


@register("w9_zone_map_slice", """
SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-10 08:00:00'""")
def w9_zone_map_slice(spark, sf):
    """A slice by a time inside the page bodies: only the page files whose zone
    meets it are read; half of the zones are added by a second call."""
    land, zones = scratch_path(spark, "zone-pages"), scratch_path(spark, "zones")
    pages = event_pages(spark, sf, page_size=100)
    middle = pages.agg((F.max("page_idx") / 2).cast("int")).first()[0] or 0
    for part in (F.col("page_idx") <= middle, F.col("page_idx") > middle):
        pages.filter(part).repartitionByRange(20, "page_idx").write.mode("append").parquet(land)
        W.add_zones(spark, land, zones, "$.data", "$.ts")
    bounds = ("2024-01-10 00:00:00", "2024-01-10 08:00:00")
    recs = X.extract_records(W.pages_within(spark, land, zones, *bounds), "$.data")
    timed = recs.select(F.try_variant_get("rec", "$.event_id", "bigint").alias("event_id"), read_instant("rec", "$.ts").alias("t"))
    return W.slice_window(timed, "t", *bounds).select("event_id")


@register("w10_incremental_merge_run", """
SELECT user_id, count(*) AS n_rows, max(event_id) AS max_event_id, round(sum(value), 2) AS total_value
FROM events GROUP BY user_id""")
def w10_incremental_merge_run(spark, sf):
    """A full run over the events before the cutoff, then an incremental run
    of what the stored watermark less the overlap asks for: the keyed upsert
    makes the overlap harmless, and the table equals one full run's."""
    base, config = _sync_setup(spark)
    ev = _timed_events(spark, sf)
    Y.run_sync(_sync_pages(ev.filter(F.col("t") < "2024-01-15 00:00:00"), 1), config, base, 1, AS_OF, "full")
    Y.run_sync(_sync_pages(Y.requested_since(ev, "t", Y.read_state(spark, base), F.lit("sync"), config.overlap), 2), config, base, 2, AS_OF)
    table = B.read_table(spark, base)
    return table.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("event_id").alias("max_event_id"),
                                        F.round(F.sum("value"), 2).alias("total_value"))


def _timed_events(spark, sf):
    return read_table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))


def _sync_setup(spark):
    base = scratch_path(spark, "sync")
    steps = ({"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"}, {"source": "$.user_id", "target": "user_id", "type": "long"},
        {"source": "$.value", "target": "value", "type": "double"}]},)
    return base, Y.SyncConfig("$.data", steps, "parquet", "rows", ("event_id",), "upsert", True, "timestamp", "$.t", "5m")


def _sync_pages(rows, run_id):
    record = F.to_json(F.struct("event_id", "user_id", "value", iso_instant_text("t").alias("t")))
    return _landed(land_pages(rows, F.lit("sync"), "event_id", record, page_size=200, run_id=run_id))


def _landed(pages):
    """Pages as files, as a fetcher leaves them."""
    path = scratch_path(pages.sparkSession, "landed")
    pages.write.parquet(path)
    return pages.sparkSession.read.schema(pages.schema).parquet(path)


@register("w10_state_and_runs", """
SELECT 'sync' AS connector_id, n.run_id, n.status, n.records_ok, strftime(m, '%Y-%m-%d %H:%M:%S') AS watermark FROM
  (SELECT 1 AS run_id, 'success' AS status, count(*) AS records_ok FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
   UNION ALL SELECT 2, 'success', count(*) FROM events WHERE ts >= (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00') - INTERVAL 5 MINUTE) n,
  (SELECT max(ts) AS m FROM events) WHERE n.records_ok > 0""")
def w10_state_and_runs(spark, sf):
    """What two runs leave: their run rows, and the last watermark."""
    base, config = _sync_setup(spark)
    ev = _timed_events(spark, sf)
    Y.run_sync(_sync_pages(ev.filter(F.col("t") < "2024-01-15 00:00:00"), 1), config, base, 1, AS_OF, "full")
    Y.run_sync(_sync_pages(Y.requested_since(ev, "t", Y.read_state(spark, base), F.lit("sync"), config.overlap), 2), config, base, 2, AS_OF)
    state = Y.read_state(spark, base).select(F.col("connector_id").alias("c"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("watermark"))
    runs = Y.read_runs(spark, base)
    return runs.join(state, runs["connector_id"] == state["c"]).select("connector_id", "run_id", "status", "records_ok", "watermark")


CUT = "TIMESTAMP '2024-01-15 00:00:00'"


def _by_connector(config, **changes):
    """Several connectors in one run: the connector is part of the key."""
    return replace(config, connector_column="connector_id", **changes)


def _connector_pages(rows, run_id, page_size=50):
    record = F.to_json(F.struct("event_id", "user_id", "value", iso_instant_text("t").alias("t")))
    return _landed(land_pages(rows, F.concat(F.lit("sync-"), (F.col("user_id") % 5).cast("string")), "event_id", record, page_size=page_size, run_id=run_id))


@register("w10_rolling_window", f"""
SELECT 'sync-' || CAST(user_id % 5 AS VARCHAR) AS connector_id, strftime(max(ts) FILTER (ts < {CUT}), '%Y-%m-%d %H:%M:%S') AS after_full,
  strftime(TIMESTAMP '{AS_OF}' + INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS after_incremental, count(*) AS n_rows
FROM events GROUP BY 1 HAVING count(*) FILTER (ts < {CUT}) > 0 AND count(*) FILTER (ts >= {CUT}) > 0""")
def w10_rolling_window(spark, sf):
    """A full run stores the latest record time, an incremental one the end of its window."""
    base, config = _sync_setup(spark)
    config, ev = _by_connector(config, inc_mode="rolling_window"), _timed_events(spark, sf)
    early = F.col("t") < "2024-01-15 00:00:00"
    one = Y.run_sync(_connector_pages(ev.filter(early), 1), config, base, 1, AS_OF, "full")["version"]
    two = Y.run_sync(_connector_pages(ev.filter(~early), 2), config, base, 2, AS_OF)["version"]
    at = lambda v, name: Y.read_state(spark, base, v).select("connector_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias(name))
    return at(one, "after_full").join(at(two, "after_incremental"), "connector_id").join(
        B.read_table(spark, base).groupBy("connector_id").agg(F.count(F.lit(1)).alias("n_rows")), "connector_id")


@register("w10_monotonic_id", f"""
SELECT 'sync-' || CAST(user_id % 5 AS VARCHAR) AS connector_id, CAST(max(event_id) FILTER (ts < {CUT}) AS VARCHAR) AS after_full, CAST(max(event_id) AS VARCHAR) AS after_incremental,
  count(*) FILTER (ts < {CUT} OR event_id > m) AS n_rows
FROM events JOIN (SELECT user_id % 5 AS c, max(event_id) FILTER (ts < {CUT}) AS m FROM events GROUP BY 1) ON c = user_id % 5 GROUP BY user_id % 5 HAVING max(m) IS NOT NULL AND max(event_id) > max(m)""")
def w10_monotonic_id(spark, sf):
    """The incremental run asks for ids above the stored one; the largest id is stored."""
    base, config = _sync_setup(spark)
    config, ev = _by_connector(config, inc_mode="monotonic_id", response_path="$.event_id"), _timed_events(spark, sf)
    one = Y.run_sync(_connector_pages(ev.filter(F.col("t") < "2024-01-15 00:00:00"), 1), config, base, 1, AS_OF, "full")["version"]
    since = Y.read_state(spark, base).select(F.col("connector_id").alias("c"), F.col("last_id").cast("bigint").alias("since"))
    asked = ev.join(since, F.concat(F.lit("sync-"), (F.col("user_id") % 5).cast("string")) == F.col("c"), "left").filter(F.col("since").isNull() | (F.col("event_id") > F.col("since")))
    two = Y.run_sync(_connector_pages(asked.drop("c", "since"), 2), config, base, 2, AS_OF)["version"]
    at = lambda v, name: Y.read_state(spark, base, v).select("connector_id", F.col("last_id").alias(name))
    return at(one, "after_full").join(at(two, "after_incremental"), "connector_id").join(
        B.read_table(spark, base).groupBy("connector_id").agg(F.count(F.lit(1)).alias("n_rows")), "connector_id")


@register("w10_sample_run", """
WITH e AS (SELECT 'sync-' || CAST(user_id % 5 AS VARCHAR) AS connector_id, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS r FROM events)
SELECT connector_id, 'full' AS mode, count(*) FILTER (event_id % 4 <> 0) AS records_ok, count(*) FILTER (event_id % 4 = 0) AS records_failed,
  CAST(ceil(count(*) / 10) AS BIGINT) AS n_pages, least(20, count(*) FILTER (event_id % 4 = 0)) AS n_errors, 0 AS n_rows, 0 AS n_state
FROM e WHERE r <= 34 GROUP BY connector_id""")
def w10_sample_run(spark, sf):
    """The first 34 records of each connector: counts and details, no sink, no watermark."""
    base, config = _sync_setup(spark)
    steps = ({"type": "map_fields", "mappings": [{"source": "$.event_id", "target": "event_id", "type": "long"}, {"source": "$.n", "target": "n", "type": "long"}]},)
    ev = _timed_events(spark, sf)
    record = F.to_json(F.struct("event_id", iso_instant_text("t").alias("t"), F.when(F.col("event_id") % 4 == 0, F.lit("no number")).otherwise(F.lit("7")).alias("n")))
    pages = land_pages(ev, F.concat(F.lit("sync-"), (F.col("user_id") % 5).cast("string")), "event_id", record, page_size=10, run_id=1)
    Y.run_sync(pages, _by_connector(config, steps=steps), base, 1, AS_OF, "sample", record_limit=34, write_sink=False)
    rows, state = B.read_table(spark, base), Y.read_state(spark, base).count()
    d = Y.read_details(spark, base).groupBy("connector_id").agg(F.count_if(F.col("stage") == "http").alias("n_pages"), F.count_if(F.col("stage") == "transform").alias("n_errors"))
    return Y.read_runs(spark, base).join(d, "connector_id").select("connector_id", "mode", "records_ok", "records_failed", "n_pages", "n_errors",
                                                                   F.lit(0 if rows is None else 1).alias("n_rows"), F.lit(state).cast("int").alias("n_state"))


@register("w10_racing_runs", """
SELECT user_id, count(*) AS n_rows, sum(event_id) AS ids, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events) AS watermark, 2 AS n_runs FROM events GROUP BY user_id""")
def w10_racing_runs(spark, sf):
    """Two runs start from one version and overlap; the one that commits later starts again from the other's: rows, watermark and run rows are those of one run after the other."""
    base, config = _sync_setup(spark)
    ev, raced = _timed_events(spark, sf), []

    def other():
        if not raced:
            raced.append(True)
            Y.run_sync(_sync_pages(ev.filter(F.col("event_id") % 3 != 0), 2), config, base, 2, AS_OF, "full")
    Y.run_sync(_sync_pages(ev.filter(F.col("event_id") % 3 != 1), 1), config, base, 1, AS_OF, "full", before_commit=other)
    (state,) = Y.read_state(spark, base).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("watermark")).collect()      # of the one connector
    n_runs = Y.read_runs(spark, base).count()
    rows = B.read_table(spark, base).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("event_id").alias("ids"))
    return rows.select("*", F.lit(state["watermark"]).alias("watermark"), F.lit(n_runs).cast("int").alias("n_runs"))


@register("k2_bucket_growth", """
SELECT event_id % 997 AS key_bucket, count(*) AS n, sum(event_id) AS ids, round(sum(CASE WHEN event_id % 2 = 0 THEN value + 1 ELSE value END), 2) AS total, true AS within_target, true AS grown
FROM events GROUP BY 1""")
def k2_bucket_growth(spark, sf):
    """A keyed table fed in batches, the even keys twice: it splits buckets as it grows, none above twice the target."""
    base = scratch_path(spark, "growth")
    ev = read_table(spark, sf, "events").select("event_id", F.col("value"), F.lit(0).alias("run_id"))
    target = max(ev.count() // 10, 1)
    for n in range(4):
        B.upsert_table(ev.filter(F.col("event_id") % 4 == n), base, ["event_id"], buckets=2 + n, target=target)
    B.upsert_table(ev.filter("event_id % 2 = 0").withColumn("value", F.col("value") + 1).withColumn("run_id", F.lit(1)), base, ["event_id"], buckets=64, target=target)
    table = B.read_version(spark, base).tables["rows"]
    return B.read_table(spark, base).groupBy((F.col("event_id") % 997).alias("key_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 2).alias("total")).select(
        "*", F.lit(max(r for _, r in table.files.values()) <= 2 * target).alias("within_target"), F.lit(table.buckets > table.first).alias("grown"))


@register("w2_wide_ids", """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id,
  CAST(greatest(max(999999999999999900 + event_id), 999999999999999999) AS VARCHAR) AS last_id FROM events GROUP BY user_id""")
def w2_wide_ids(spark, sf):
    """Ids of 18 and 19 digits; the stored one has 18 nines."""
    ev = read_table(spark, sf, "events")
    conn = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    rid = (F.lit(999999999999999900) + F.col("event_id")).cast("string")
    recs = ev.select(conn.alias("connector_id"), F.parse_json(F.to_json(F.struct(rid.alias("rid")))).alias("rec"))
    prev = ev.select(conn.alias("connector_id"), F.lit("9" * 18).alias("last_id")).distinct()
    return W.advance_monotonic(recs, "$.rid", prev)


# ---- P -----------------------------------------------------------------------

CCONN = """(SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS connector_id, o_custkey AS custkey,
  CASE WHEN o_custkey % 4 = 0 THEN 'offset_limit' ELSE 'page_page_size' END AS strategy,
  CASE WHEN o_custkey % 4 = 1 THEN 'skip_limit' END AS page_value_type,
  CAST(o_custkey % 2 AS INTEGER) AS page_start, CAST(5 + (o_custkey % 3) * 5 AS INTEGER) AS page_size,
  CASE WHEN o_custkey % 7 = 0 THEN 2 ELSE 1000 END AS max_pages,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(count(*) AS INTEGER) END AS total, count(*) AS n_orders
  FROM orders GROUP BY o_custkey)"""
PLAN = f"""(SELECT *, page - page_start AS page_idx,
  CASE WHEN strategy = 'offset_limit' OR page_value_type = 'skip_limit' THEN (page - page_start) * page_size ELSE page END AS ppv
  FROM (SELECT c.*, unnest(range(page_start, CASE WHEN total IS NULL THEN page_start + max_pages - 1
    ELSE least(greatest(page_start, CAST(ceil(total / page_size) AS INTEGER)), page_start + max_pages - 1) END + 1)) AS page
  FROM {CCONN} c))"""


@register("p1_page_plan", f"SELECT connector_id, page, CAST(page_idx AS INTEGER) AS page_idx FROM {PLAN}")
def p1_page_plan(spark, sf):
    return P.plan_pages(customer_connectors(spark, sf)).select("connector_id", "page", F.col("page_idx").cast("int"))


@register("p2_offset_plan", f"""
SELECT connector_id, page, CAST(ppv AS INTEGER) AS page_param_value, page_size AS "limit" FROM {PLAN}""")
def p2_offset_plan(spark, sf):
    return P.plan_pages(customer_connectors(spark, sf)).select(
        "connector_id", "page", F.col("page_param_value").cast("int"), "limit")


@register("p3_total_pages", f"""
SELECT connector_id, CAST(ceil(total / page_size) AS INTEGER) AS total_pages, count(*) AS n_pages, max(page) AS last_page
FROM {PLAN} GROUP BY connector_id, total, page_size""")
def p3_total_pages(spark, sf):
    c = customer_connectors(spark, sf)
    plan = P.plan_pages(c)
    return plan.groupBy("connector_id", "total", "page_size").agg(
        F.count(F.lit(1)).alias("n_pages"), F.max("page").alias("last_page")) \
        .select("connector_id", P.total_pages(F.col("total"), F.col("page_size")).alias("total_pages"),
                "n_pages", "last_page")


@register("p4_separate_total", f"""
SELECT connector_id, count(*) AS n_pages FROM (
  SELECT c.connector_id, unnest(range(0, least(greatest(page_start, CAST(ceil(n_orders / page_size) AS INTEGER)),
    page_start + max_pages - 1) - page_start + 1)) AS i FROM {CCONN} c) GROUP BY connector_id""")
def p4_separate_total(spark, sf):
    c = customer_connectors(spark, sf).drop("total")
    o = read_table(spark, sf, "orders")
    counts = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("connector_id"),
        F.lit(1).cast("bigint").alias("run_id"), F.lit(-1).alias("page_idx"), F.lit("count").alias("kind"),
        F.concat(F.lit('{"total":'), F.col("n").cast("string"), F.lit("}")).alias("body"))
    totals = P.separate_totals(counts, "$.total")
    plan = P.plan_pages(c.join(totals.drop("run_id"), "connector_id", "left"))
    return plan.groupBy("connector_id").agg(F.count(F.lit(1)).alias("n_pages"))


OPAGES = """(SELECT 'cust-' || CAST(o_custkey AS VARCHAR) AS connector_id,
  CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 5 AS INTEGER) AS page_idx,
  count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""
OPAGE_IDX = f"(SELECT DISTINCT connector_id, page_idx, CAST((n - 1) // 5 AS INTEGER) AS last FROM {OPAGES})"


@register("p5_cursor_requests", f"""
SELECT connector_id, page_idx, CASE WHEN page_idx = 0 THEN NULL ELSE 'c' || CAST(page_idx AS VARCHAR) END AS cursor
FROM {OPAGE_IDX}""")
def p5_cursor_requests(spark, sf):
    pages = order_pages(spark, sf, cursor=True)
    return P.next_requests_cursor(pages, "$.meta.next").select("connector_id", "page_idx", "cursor")


@register("p6_link_requests", f"""
SELECT connector_id, page_idx, CASE WHEN page_idx = 0 THEN NULL
  ELSE 'http://api.local/' || connector_id || '?page=' || CAST(page_idx + 1 AS VARCHAR) END AS url
FROM {OPAGE_IDX}""")
def p6_link_requests(spark, sf):
    pages = order_pages(spark, sf, link=True)
    return P.next_requests_link(pages).select("connector_id", "page_idx", "url")


@register("p7_query_assembly", f"""
SELECT connector_id, page, 'http://api.local/' || connector_id || '?cust=' || CAST(custkey AS VARCHAR)
  || CASE WHEN strategy = 'offset_limit' THEN '&offset=' || CAST(ppv AS VARCHAR) || '&page=0'
     ELSE '&page=' || CAST(ppv AS VARCHAR) END
  || '&size=' || CAST(page_size AS VARCHAR) || '&status=open' AS url
FROM {PLAN}""")
def p7_query_assembly(spark, sf):
    plan = P.plan_pages(customer_connectors(spark, sf))
    pname = F.when(F.col("strategy") == "offset_limit", F.lit("offset")).otherwise(F.lit("page"))
    conf = F.create_map(F.lit("status"), F.lit("open"), F.lit("page"), F.lit("0"),
                        F.lit("cust"), F.col("custkey").cast("string"))
    paging = F.create_map(pname, F.col("page_param_value").cast("string"),
                          F.lit("size"), F.col("limit").cast("string"))
    url = P.assemble_url(F.concat(F.lit("http://api.local/"), F.col("connector_id")), conf, paging)
    return plan.select("connector_id", "page", url.alias("url"))


@register("p8_body_compose", f"""
SELECT connector_id, page, CAST(ppv AS BIGINT) AS b_page, CAST(page_size AS BIGINT) AS b_size,
  CAST(custkey AS BIGINT) AS b_cust, 'x' AS b_keep FROM {PLAN}""")
def p8_body_compose(spark, sf):
    plan = P.plan_pages(customer_connectors(spark, sf))
    tmpl = F.concat(F.lit('{"filter":{"cust":'), F.col("custkey").cast("string"),
                    F.lit('},"paging":{"size":0,"keep":"x"}}'))
    body = P.compose_body(tmpl, {"paging.page": F.col("page_param_value"), "paging.size": F.col("limit")})
    b = plan.select("connector_id", "page", F.parse_json(body).alias("b"))
    return b.select("connector_id", "page",
                    F.try_variant_get("b", "$.paging.page", "bigint").alias("b_page"),
                    F.try_variant_get("b", "$.paging.size", "bigint").alias("b_size"),
                    F.try_variant_get("b", "$.filter.cust", "bigint").alias("b_cust"),
                    F.try_variant_get("b", "$.paging.keep", "string").alias("b_keep"))


@register("p9_body_type", f"""
SELECT connector_id, CASE WHEN custkey % 3 IN (0, 2) THEN 'none' WHEN custkey % 5 = 0 THEN 'form'
  WHEN custkey % 2 = 0 THEN 'json' WHEN custkey % 7 = 0 THEN 'form-urlencoded' ELSE 'none' END AS body_type FROM {CCONN}""")
def p9_body_type(spark, sf):
    c = customer_connectors(spark, sf)
    ck = F.col("custkey")
    method = F.when(ck % 3 == 0, "GET").when(ck % 3 == 1, "POST").otherwise("HEAD")
    explicit = F.when(ck % 5 == 0, F.lit("form"))
    return c.select("connector_id", P.body_type(explicit, method, ck % 2 == 0, ck % 7 == 0).alias("body_type"))


@register("p10_timestamp_params", f"""
SELECT connector_id, {fmt_sql("(p.ts - to_seconds(c.overlap_s))", "c.time_format")} AS param
FROM {UCONN} c JOIN {PREV} p USING (connector_id)""")
def p10_timestamp_params(spark, sf):
    c = user_connectors(spark, sf)
    j = c.join(prior_state(spark, sf).select("connector_id", "ts"), "connector_id")
    of = lambda name: P.timestamp_param(F.col("ts"), F.col("overlap"), name)
    param = of("iso_instant")
    for name in ("epoch_ms", "dahua_utc", "meiya_datetime"):
        param = F.when(F.col("time_format") == name, of(name)).otherwise(param)
    return j.select("connector_id", param.alias("param"))


@register("p11_since_id_params", f"""
SELECT connector_id, CASE WHEN regexp_full_match(last_id, '[+-]?[0-9]+') AND TRY_CAST(last_id AS BIGINT) IS NOT NULL THEN last_id
  ELSE '"' || last_id || '"' END AS since_id_json FROM {PREV} WHERE last_id IS NOT NULL""")
def p11_since_id_params(spark, sf):
    p = prior_state(spark, sf).filter(F.col("last_id").isNotNull())
    return p.select("connector_id", P.since_id_value(F.col("last_id")).alias("since_id_json"))


@register("p12_rolling_window_params", f"""
SELECT c.connector_id,
  {iso_ts("coalesce(p.ts, TIMESTAMP '2024-02-01 00:01:00') - to_seconds(c.overlap_s)")} AS window_start,
  {iso_ts("TIMESTAMP '2024-02-01 00:01:00'")} AS window_end
FROM {UCONN} c LEFT JOIN {PREV} p USING (connector_id)""")
def p12_rolling_window_params(spark, sf):
    c = user_connectors(spark, sf)
    j = c.join(prior_state(spark, sf).select("connector_id", "ts"), "connector_id", "left")
    w = W.rolling_window(j, "overlap", AS_OF)
    return w.select("connector_id", iso_instant_text("start").alias("window_start"),
                    iso_instant_text("end").alias("window_end"))


@register("p13_overlap_seconds", f"SELECT connector_id, CAST(overlap_s AS BIGINT) AS overlap_seconds FROM {UCONN}")
def p13_overlap_seconds(spark, sf):
    return user_connectors(spark, sf).select("connector_id", overlap_seconds(F.col("overlap")).alias("overlap_seconds"))


# ---- G -----------------------------------------------------------------------

TAILED = f"""(SELECT connector_id, page_idx, last FROM {OPAGE_IDX}
  UNION ALL SELECT DISTINCT connector_id, last + 1, last FROM {OPAGE_IDX})"""


@register("g1_cursor_stop_rules", f"SELECT connector_id, page_idx, page_idx >= last AS stop FROM {TAILED}")
def g1_cursor_stop_rules(spark, sf):
    pages = order_pages(spark, sf, cursor=True, empty_tail=True)
    f = G.cursor_stop(pages, "$.data", "$.meta.next", "$.meta.hasMore")
    return f.select("connector_id", "page_idx", "stop")


@register("g1_has_more_only", f"SELECT connector_id, page_idx, page_idx >= last AS stop FROM {TAILED}")
def g1_has_more_only(spark, sf):
    pages = order_pages(spark, sf, cursor=True, empty_tail=True)
    f = G.cursor_stop(pages, "$.data", "$.meta.next", "$.meta.hasMore", ["HAS_MORE_FALSE"])
    return f.select("connector_id", "page_idx", "stop")


@register("g2_link_stop_rules", f"SELECT connector_id, page_idx, page_idx >= last AS stop FROM {TAILED}")
def g2_link_stop_rules(spark, sf):
    pages = order_pages(spark, sf, link=True, empty_tail=True)
    return G.link_stop(pages, "$.data").select("connector_id", "page_idx", "stop")


ONE_RULE = """(SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS connector_id, CAST(p AS INTEGER) AS page_idx, c_custkey % 3 AS kind
  FROM customer, (SELECT unnest(range(0, 4)) AS p))"""


def _one_rule_pages(spark, sf):
    """Four pages a customer; on page 2 just one stop rule fires: an empty
    page (kind 0), a blank cursor or missing link (1), has-more false (2)."""
    c = dealt(read_table(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("page_idx"))
    kind, here = F.col("c_custkey") % 3, F.col("page_idx") == 2
    data = F.when((kind == 0) & here, F.lit("[]")).otherwise(F.lit('[{"k":1}]'))
    nxt = F.when((kind == 1) & here, F.lit("  ")).otherwise(F.concat(F.lit("c"), F.col("page_idx").cast("string")))
    more = F.when((kind == 2) & here, F.lit("false")).otherwise(F.lit("true"))
    body = F.concat(F.lit('{"data":'), data, F.lit(',"meta":{"next":"'), nxt, F.lit('","hasMore":'), more, F.lit("}}"))
    link = F.when((kind == 1) & here, F.lit('<http://h/?p=1>; rel="next-archive"')).otherwise(F.lit('<http://h/?p=9>; rel="last", <http://h/?p=2>; rel="next"'))
    return c.select(F.concat(F.lit("cust-"), F.col("c_custkey").cast("string")).alias("connector_id"), F.lit(1).cast("bigint").alias("run_id"),
                    "page_idx", F.lit("page").alias("kind"), body.alias("body"), F.create_map(F.lit("Link"), link).alias("headers"))


def _stops(pages, by):
    """Each rule's stops beside the pages. The pages are made from a few bytes a customer, so their size is not known: no side is broadcast."""
    out = pages.select("connector_id", "page_idx")
    for name, f in by.items():
        out = out.join(f(pages).select("connector_id", "page_idx", F.col("stop").alias(name)).hint("merge"), ["connector_id", "page_idx"])
    return out


@register("g1_one_rule_each", f"""
SELECT connector_id, page_idx, page_idx = 2 AS all_rules, page_idx = 2 AND kind = 0 AS empty_page,
  page_idx = 2 AND kind = 1 AS empty_cursor, page_idx = 2 AND kind = 2 AS has_more FROM {ONE_RULE}""")
def g1_one_rule_each(spark, sf):
    rule = lambda r: lambda p: G.cursor_stop(p, "$.data", "$.meta.next", "$.meta.hasMore", r)
    return _stops(_one_rule_pages(spark, sf), {"all_rules": rule(None), "empty_page": rule(["empty_page"]), "empty_cursor": rule(["empty_cursor"]), "has_more": rule(["has_more_false"])})


@register("g2_one_rule_each", f"""
SELECT connector_id, page_idx, page_idx = 2 AND kind IN (0, 1) AS all_rules, page_idx = 2 AND kind = 0 AS empty_page,
  page_idx = 2 AND kind = 1 AS no_next_link FROM {ONE_RULE}""")
def g2_one_rule_each(spark, sf):
    rule = lambda r: lambda p: G.link_stop(p, "$.data", r)
    return _stops(_one_rule_pages(spark, sf), {"all_rules": rule(None), "empty_page": rule(["empty_page"]), "no_next_link": rule(["no_next_link"])})


@register("g3_long_chain", """
SELECT count(*) AS pages, count(*) FILTER (WHERE event_id IS NOT NULL) AS kept, (SELECT count(*) FROM events) > 1200 AS cut,
  least(1200, (SELECT count(*) FROM events)) AS kept_of_1200 FROM events""")
def g3_long_chain(spark, sf):
    """A chain as long as the events, one page each: kept whole without a
    limit of the connector's own; with one of 1200 it is cut and says so."""
    ev = read_table(spark, sf, "events")
    record = F.to_json(F.struct("event_id"))
    pages = land_pages(ev, F.lit("chain"), "event_id", record, page_size=1)
    f = G.cursor_stop(pages, "$.data", None, None, ["empty_page"])
    whole = G.truncate_chain(f).agg(F.count(F.lit(1)).alias("kept"))
    limited = G.truncate_chain(f, 1200).agg(F.count(F.lit(1)).alias("kept_of_1200"), F.coalesce(F.max("run_truncated"), F.lit(False)).alias("cut"))
    one = lambda d: d.withColumn("__one", F.lit(1))
    n = pages.agg(F.count(F.lit(1)).alias("pages"))
    return one(n).join(one(whole), "__one").join(one(limited), "__one").drop("__one")


@register("g3_truncate_chain", f"""
SELECT connector_id, page_idx, CAST(CASE WHEN page_idx < last THEN 5 ELSE n - last * 5 END AS INTEGER) AS n_records
FROM (SELECT DISTINCT connector_id, page_idx, CAST((n - 1) // 5 AS INTEGER) AS last, n FROM {OPAGES})
WHERE page_idx <= least(last, 3)""")
def g3_truncate_chain(spark, sf):
    pages = order_pages(spark, sf, cursor=True, empty_tail=True)
    f = G.cursor_stop(pages, "$.data", "$.meta.next", "$.meta.hasMore")
    t = G.truncate_chain(f, max_pages=4)
    return t.select("connector_id", "page_idx", F.col("n_records").cast("int"))


@register("g3_truncate_by_total", f"""
SELECT t.connector_id, t.page_idx FROM {TAILED} t JOIN {CCONN} c USING (connector_id)
WHERE t.page_idx <= CASE WHEN c.page_start = 1 THEN t.last ELSE t.last + 1 END""")
def g3_truncate_by_total(spark, sf):
    pages = order_pages(spark, sf, empty_tail=True)
    c = customer_connectors(spark, sf).select("connector_id", "page_start")
    j = pages.join(c, "connector_id")
    f = G.page_stop(j, "$.data", "$.meta.total", F.lit(5), F.col("page_start"))
    return G.truncate_pages_by_total(f).select("connector_id", "page_idx")


def _faulty_pages(spark, sf):
    pages = rich_event_pages(spark, sf, page_size=10, per_user=True)
    uid = F.regexp_extract("connector_id", r"(\d+)$", 1).cast("int")
    return pages.select(
        "connector_id", "run_id", "page_idx", "kind",
        F.when((uid % 13 == 0) & (F.col("page_idx") == 1), 500).otherwise(F.col("status")).alias("status"),
        "duration_ms",
        F.when((uid % 17 == 0) & (F.col("page_idx") == 2), F.substring("body", 1, 20)).otherwise(F.col("body")).alias("body"),
        ((uid % 19 == 0) & (F.col("page_idx") == 0)).alias("truncated"), "body_length",
        F.when((uid % 23 == 0) & (F.col("page_idx") == 3), F.lit("connection reset")).alias("error"),
        "headers")


G4_FAIL = """(SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, CAST(fp AS INTEGER) AS failed_page, reason FROM (
  SELECT user_id, CASE WHEN user_id % 19 = 0 THEN 0 WHEN user_id % 13 = 0 AND n > 10 THEN 1
    WHEN user_id % 17 = 0 AND n > 20 THEN 2 WHEN user_id % 23 = 0 AND n > 30 THEN 3 END AS fp,
    CASE WHEN user_id % 19 = 0 THEN 'response body truncated' WHEN user_id % 13 = 0 AND n > 10 THEN 'HTTP status 500'
    WHEN user_id % 17 = 0 AND n > 20 THEN 'response body is not JSON'
    WHEN user_id % 23 = 0 AND n > 30 THEN 'HTTP request failed: connection reset' END AS reason
  FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)) WHERE fp IS NOT NULL)"""


@register("g4_page_failures", f"SELECT connector_id, failed_page, reason FROM {G4_FAIL}")
def g4_page_failures(spark, sf):
    return G.page_failures(_faulty_pages(spark, sf)).select("connector_id", "failed_page", "reason")


@register("g4_no_partial_output", f"""
SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, count(*) AS n_records FROM events
WHERE 'user-' || CAST(user_id AS VARCHAR) NOT IN (SELECT connector_id FROM {G4_FAIL}) GROUP BY user_id""")
def g4_no_partial_output(spark, sf):
    pages = _faulty_pages(spark, sf)
    good = G.drop_failed_runs(pages, G.page_failures(pages))
    recs = X.extract_records(good, "$.data")
    return recs.groupBy("connector_id").agg(F.count(F.lit(1)).alias("n_records"))


@register("g6_page_log", """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, CAST(rn // 10 AS INTEGER) AS page_idx,
  count(*) AS n_records, count(*) + 5 AS duration_ms
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)
GROUP BY user_id, rn // 10""")
def g6_page_log(spark, sf):
    pages = rich_event_pages(spark, sf, page_size=10, per_user=True)
    return G.page_log(pages, "$.data").select("connector_id", "page_idx", F.col("n_records").cast("bigint"),
                                              "duration_ms")
