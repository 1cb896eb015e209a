"""Registered queries for streams: push events (S4, U1-U8) and landed
pages (S3). Each runs a Structured Streaming query to completion
(``availableNow``) into folders under ``spark.checkpoint.dir`` and returns
the resulting table."""
from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import runs as J
from sluice.operators import tables as B
from sluice.plans.registered import FLAGSHIP_STEPS, ORACLE, register
from sluice.session import scratch_path
from sluice.sources.landed import dealt, event_pages, land_pages, push_connectors, push_requests, read_table, run_log, shuffle_partitions
from sluice.streaming import runs as R
from sluice.streaming.pages import run_pages_stream
from sluice.streaming.push import run_deduped_stream, run_push_stream

PUSH_MAPPINGS = [
    {"source": "$.EventID", "target": "event_id", "type": "string"},
    {"source": "$.EventType", "target": "event_type", "type": "long"},
    {"source": "$.EventName", "target": "event_name", "type": "string"},
    {"source": "$.CameraID", "target": "camera_id", "type": "string"},
    {"source": "$.ImgUrl", "target": "img_url", "type": "string"},
    {"source": "$.Confidence", "target": "confidence", "type": "double"},
    {"source": "$.EventTime", "target": "event_time", "type": "string"},
]

PUSH_SQL = """(SELECT event_id AS eid, user_id % 4 AS k, event_type,
  CASE WHEN event_id % 50 = 0 THEN '' WHEN event_id % 10 = 1 THEN 'EVT-' || CAST(event_id - 1 AS VARCHAR)
    ELSE 'EVT-' || CAST(event_id AS VARCHAR) END AS EventID,
  user_id, value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events)"""
ACCEPTED = f"""(SELECT * FROM {PUSH_SQL} WHERE k IN (0, 1) AND EventID <> '' AND eid % 37 <> 0
  AND NOT (k = 0 AND eid % 13 = 0))"""


def _files_a_batch(landed, batches: int) -> int:
    """Files of one micro-batch, if a file a partition has landed and ``batches`` of them are to take all: their number does not grow with the partitions."""
    return -(-shuffle_partitions(landed) // batches)


def _run_push(spark, sf, batches: int = 4):
    land = scratch_path(spark, "push-landed")
    sent = push_requests(spark, sf)
    sent.sortWithinPartitions("seq").write.json(land)
    out = scratch_path(spark, "push-out")
    return run_push_stream(spark, land, push_connectors(spark, sf), PUSH_MAPPINGS, out,
                           scratch_path(spark, "push-ckpt"), max_files_per_trigger=_files_a_batch(sent, batches))


@register("u6_push_stream_table", f"""
SELECT connector_id, event_id, event_type, event_name, camera_id, img_url, confidence, event_time FROM (
  SELECT 'push-' || CAST(k AS VARCHAR) AS connector_id, EventID AS event_id, user_id % 5 AS event_type, event_type AS event_name,
    'cam-' || CAST(user_id AS VARCHAR) AS camera_id, 'http://img.local/' || CAST(eid AS VARCHAR) || '.jpg' AS img_url,
    round(value / 500, 4) AS confidence, t AS event_time,
    row_number() OVER (PARTITION BY k, EventID ORDER BY eid DESC) AS r FROM {ACCEPTED}) WHERE r = 1""")
def u6_push_stream_table(spark, sf):
    """U1-U6 end to end: the keyed table after all pushes (last push per
    connector and EventID wins; rejected pushes write nothing)."""
    table, _, _ = _run_push(spark, sf)
    return B.read_table(spark, table).select(
        "connector_id", "event_id", "event_type", "event_name", "camera_id", "img_url", "confidence", "event_time")


@register("u7_push_results", f"""
SELECT 'push-' || CAST(k AS VARCHAR) AS connector_id, op_code, op_desc, count(*) AS n FROM (
  SELECT k, CASE WHEN k = 3 THEN 1 WHEN k = 2 THEN 1 WHEN EventID = '' THEN 1
    WHEN k = 0 AND eid % 13 = 0 THEN 1 WHEN eid % 37 = 0 THEN 1 ELSE 0 END AS op_code,
  CASE WHEN k = 3 THEN 'connector mode does not accept push' WHEN k = 2 THEN 'webhook not enabled'
    WHEN EventID = '' THEN 'EventID is required' WHEN k = 0 AND eid % 13 = 0 THEN 'sign verification failed'
    WHEN eid % 37 = 0 THEN 'transform failed for push event' ELSE 'ok' END AS op_desc FROM {PUSH_SQL})
GROUP BY 1, 2, 3""")
def u7_push_results(spark, sf):
    _, results, _ = _run_push(spark, sf)
    r = spark.read.parquet(results)
    return r.groupBy("connector_id", "op_code", "op_desc").agg(F.count(F.lit(1)).alias("n"))


@register("u8_push_run_log", f"""
SELECT 'push-' || CAST(k AS VARCHAR) AS connector_id, status, count(*) AS n FROM (
  SELECT k, CASE WHEN EventID = '' OR (k = 0 AND eid % 13 = 0) OR eid % 37 = 0 THEN 'failed' ELSE 'success' END AS status
  FROM {PUSH_SQL} WHERE k IN (0, 1)) GROUP BY 1, 2""")
def u8_push_run_log(spark, sf):
    _, _, runs = _run_push(spark, sf)
    return spark.read.parquet(runs).groupBy("connector_id", "status").agg(F.count(F.lit(1)).alias("n"))


@register("s3_page_stream_flagship", """
SELECT event_id, user_id, value, k, ts FROM (
  SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events WHERE event_type <> 'error') WHERE rn = 1""")
def s3_page_stream_flagship(spark, sf):
    """The flagship as a stream of landed page files (several micro-batches):
    the final table equals the batch result."""
    land = scratch_path(spark, "pages-landed")
    pages = event_pages(spark, sf, page_size=100)
    pages.write.parquet(land)
    table = scratch_path(spark, "pages-table")
    run_pages_stream(spark, land, "$.data", FLAGSHIP_STEPS, ["user_id"], table,
                     scratch_path(spark, "pages-ckpt"), max_files_per_trigger=_files_a_batch(pages, 4))
    return B.read_table(spark, table).select("event_id", "user_id", "value", "k", "ts")


@register("s3_second_run_wins", """
SELECT event_id, user_id, round(CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END, 4) AS value FROM events""")
def s3_second_run_wins(spark, sf):
    """A second run re-sends a third of the records with new values, on earlier
    pages than the first run had them: the later run's values stay."""
    ev = read_table(spark, sf, "events")
    record = lambda v: F.to_json(F.struct("event_id", "user_id", F.round(v, 4).alias("value")))
    first = land_pages(ev, F.lit("runs"), "event_id", record(F.col("value")), page_size=50, run_id=1)
    again = ev.filter(F.col("event_id") % 3 == 0)
    second = land_pages(again, F.lit("runs"), "event_id", record(F.col("value") + 1), page_size=50, run_id=2)
    land = scratch_path(spark, "runs-landed")
    second.write.parquet(f"{land}/a")
    first.write.parquet(f"{land}/b")
    table = scratch_path(spark, "runs-table")
    steps = [{"type": "map_fields", "mappings": [{"source": "$.event_id", "target": "event_id", "type": "long"},
                                                 {"source": "$.user_id", "target": "user_id", "type": "long"},
                                                 {"source": "$.value", "target": "value", "type": "double"}]}]
    run_pages_stream(spark, f"{land}/*", "$.data", steps, ["event_id"], table, scratch_path(spark, "runs-ckpt"), max_files_per_trigger=2 * _files_a_batch(first, 4))
    return B.read_table(spark, table).select("event_id", "user_id", "value")


@register("u6_two_connectors", """
SELECT connector_id, event_id, event_name FROM (SELECT 'push-0' AS connector_id UNION ALL SELECT 'push-1') c,
  (SELECT 'EVT-' || CAST(event_id AS VARCHAR) AS event_id, event_type AS event_name FROM events)""")
def u6_two_connectors(spark, sf):
    """Two connectors push the same event ids: each keeps its own rows."""
    ev = dealt(read_table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    eid = F.concat(F.lit("EVT-"), F.col("event_id").cast("string"))
    body = F.to_json(F.struct(eid.alias("EventID"), F.col("event_type").alias("EventName")))
    sign = F.lower(F.md5(F.concat(F.lit("ivsp_"), eid)))
    sent = [ev.select(F.lit(c).alias("connector_id"), F.concat(F.lit(f"{c}-"), F.col("event_id").cast("string")).alias("request_id"),
                      sign.alias("sign"), F.col("event_id").alias("seq"), body.alias("body")) for c in ("push-0", "push-1")]
    land = scratch_path(spark, "two-landed")
    for d in sent:
        d.write.mode("append").json(land)
    conns = spark.createDataFrame([("push-0", "push", True, True, True, "ivsp"), ("push-1", "both", True, True, False, "ivsp")],
                                  "connector_id string, mode string, published boolean, webhook_enabled boolean, verify_sign boolean, plat_flag string")
    out = scratch_path(spark, "two-out")
    table, _, _ = run_push_stream(spark, land, conns, [m for m in PUSH_MAPPINGS if m["target"] in ("event_id", "event_name")], out,
                                  scratch_path(spark, "two-ckpt"), max_files_per_trigger=2 * _files_a_batch(ev, 3))
    return B.read_table(spark, table).select("connector_id", "event_id", "event_name")


@register("u5_raw_json", f"""
SELECT connector_id, event_id, json_extract_string(raw, '$.ImgUrl') AS img, json_extract_string(raw, '$.TaskID') AS task FROM (
  SELECT 'push-' || CAST(k AS VARCHAR) AS connector_id, EventID AS event_id,
    json_object('ImgUrl', 'http://img.local/' || CAST(eid AS VARCHAR) || '.jpg', 'TaskID', 'task-' || CAST(eid % 7 AS VARCHAR)) AS raw,
    row_number() OVER (PARTITION BY k, EventID ORDER BY eid DESC) AS r FROM {ACCEPTED}) WHERE r = 1""")
def u5_raw_json(spark, sf):
    """The stored event text: normalised (ImgUrl filled in), all fields kept."""
    table, _, _ = _run_push(spark, sf)
    raw = F.parse_json("raw_json")
    return B.read_table(spark, table).select("connector_id", "event_id", F.try_variant_get(raw, "$.ImgUrl", "string").alias("img"),
                                                    F.try_variant_get(raw, "$.TaskID", "string").alias("task"))


@register("s3_two_checkpoints", """
SELECT event_id, user_id, round(value, 4) AS value FROM events""")
def s3_two_checkpoints(spark, sf):
    """Two page streams, each with a checkpoint of its own, fill one table; one is then started again, and again with a new checkpoint."""
    ev = read_table(spark, sf, "events")
    record = F.to_json(F.struct("event_id", "user_id", F.round("value", 4).alias("value")))
    table, steps = scratch_path(spark, "two-table"), [{"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"}, {"source": "$.user_id", "target": "user_id", "type": "long"}, {"source": "$.value", "target": "value", "type": "double"}]}]
    land = [scratch_path(spark, "two-landed") for _ in range(2)]
    ckpt = [scratch_path(spark, "two-ckpt") for _ in range(3)]
    for n, part in enumerate(land):
        land_pages(ev.filter(F.col("event_id") % 2 == n), F.lit(f"c{n}"), "event_id", record, page_size=100, run_id=1).write.parquet(part)
    for n, c in ((0, 0), (1, 1), (0, 0), (1, 2)):
        run_pages_stream(spark, land[n], "$.data", steps, ["event_id"], table, ckpt[c])
    return B.read_table(spark, table).select("event_id", "user_id", "value")


@register("u6_restarted_stream", f"""
SELECT connector_id, event_id, event_name FROM (
  SELECT 'push-' || CAST(k AS VARCHAR) AS connector_id, EventID AS event_id, event_type AS event_name,
    row_number() OVER (PARTITION BY k, EventID ORDER BY eid DESC) AS r FROM {ACCEPTED}) WHERE r = 1""")
def u6_restarted_stream(spark, sf):
    """Pushes that land after the stream has lost its checkpoint: none is lost, none is written twice."""
    land, out = scratch_path(spark, "push-landed"), scratch_path(spark, "push-out")
    sent, conns = push_requests(spark, sf), push_connectors(spark, sf)
    for n in range(2):
        sent.filter(F.col("seq") % 2 == n).write.mode("append").json(land)
        run_push_stream(spark, land, conns, PUSH_MAPPINGS, out, scratch_path(spark, "push-ckpt"))
    return B.read_table(spark, f"{out}/table").select("connector_id", "event_id", "event_name")


PARTS = 5


def _landed_in_parts(rows, at, land: str, swap_s: int, write) -> None:
    """Land the rows in files that follow each other in time, but for a third
    of them, which lands up to ``swap_s`` seconds' worth of rows later."""
    staged = scratch_path(rows.sparkSession, "parts")      # the rows are made once, by all tasks
    rows.withColumn("__t", at).write.parquet(staged)
    rows, ids = rows.sparkSession.read.parquet(staged), [c for c in ("id", "request_id") if c in rows.columns]
    lo, hi = rows.agg(F.min("__t"), F.max("__t")).first()
    span = ((hi or 0) - (lo or 0)) // PARTS + 1
    late = F.when(F.xxhash64(*ids) % 3 == 0, swap_s).otherwise(0)
    part = F.least(F.floor((F.col("__t") + late - F.lit(lo or 0)) / F.lit(span)), F.lit(PARTS - 1))
    for n in range(PARTS):
        write(rows.filter(part == n).drop("__t").repartition(2, *ids), land)


def _landed_runs(spark, sf) -> str:
    """The run log in files out of order by up to an hour, then a heartbeat that lets the last runs fall due."""
    land = scratch_path(spark, "runs-landed")
    runs = run_log(spark, sf).select(*R.RUN_SCHEMA.names)
    _landed_in_parts(runs, F.unix_seconds("started_at"), land, 3600, lambda d, to: d.write.mode("append").parquet(to))
    beat = runs.agg((F.max("started_at") + F.expr("interval 1 day")).alias("started_at"))
    beat.select(*[F.col(f.name) if f.name == "started_at" else F.lit(None).cast(f.dataType).alias(f.name) for f in R.RUN_SCHEMA]).write.mode("append").parquet(land)
    return land


def _alerts(spark, sf):
    return R.run_alerts(spark, _landed_runs(spark, sf), scratch_path(spark, "alerts"), scratch_path(spark, "alerts-ckpt"), "2 hours", max_files_per_trigger=2)


@register("j16_streamed_streaks", ORACLE["j16_consecutive_failures"])
def j16_streamed_streaks(spark, sf):
    """Failure streaks of a run log that lands out of order in several micro-batches: those of the batch operator."""
    return _alerts(spark, sf).filter(F.col("alert") == R.STREAK).select("connector_id", "id")


@register("j17_streamed_failures", ORACLE["j17_failures_within_window"])
def j17_streamed_failures(spark, sf):
    """Failures within 30 minutes on the same stream."""
    return _alerts(spark, sf).filter(F.col("alert") == R.WINDOW).select("connector_id", "id", F.col("failures").alias("failures_in_window"))


@register("j1_running_stats", ORACLE["j1_stats_by_connector"])
def j1_running_stats(spark, sf):
    """Statistics by connector, kept up to date by a streaming aggregate."""
    return R.run_statistics(spark, _landed_runs(spark, sf), scratch_path(spark, "stats"), scratch_path(spark, "stats-ckpt"), max_files_per_trigger=2)


@register("j2_running_total", ORACLE["j2_global_stats"])
def j2_running_total(spark, sf):
    return R.total_of(j1_running_stats(spark, sf))


@register("j19_running_report", ORACLE["j19_daily_report"])
def j19_running_report(spark, sf):
    """The daily report, kept up to date by a streaming aggregate."""
    return R.run_statistics(spark, _landed_runs(spark, sf), scratch_path(spark, "report"), scratch_path(spark, "report-ckpt"), J.daily_report,
                            ("day", "connector_id"), max_files_per_trigger=2)


@register("u6_deduped_within_delay", f"""
SELECT 'push-' || CAST(k AS VARCHAR) AS connector_id, nullif(EventID, '') AS event_id, CASE WHEN EventID = '' THEN count(*) ELSE 1 END AS n
FROM {PUSH_SQL} GROUP BY k, EventID""")
def u6_deduped_within_delay(spark, sf):
    """Pushes that land out of order in several micro-batches: a repeated event
    passes once, also if it comes in a later batch; pushes without id all pass."""
    land = scratch_path(spark, "push-landed")
    sent = push_requests(spark, sf).withColumn("__at", F.unix_seconds(F.to_timestamp(F.get_json_object("body", "$.EventTime"))))
    _landed_in_parts(sent, F.col("__at"), land, 3600, lambda d, to: d.drop("__at").write.mode("append").json(to))
    got = run_deduped_stream(spark, land, scratch_path(spark, "deduped"), scratch_path(spark, "deduped-ckpt"), "2 hours", max_files_per_trigger=2)
    return got.groupBy("connector_id", "event_id").agg(F.count(F.lit(1)).alias("n"))
