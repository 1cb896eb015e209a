"""Registered queries for run accounting (J) and sinks (K)."""
from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.timefmt import iso_instant_text
from sluice.operators import extract as X
from sluice.operators import runs as J
from sluice.operators import sinks as K
from sluice.operators import tables as B
from sluice.operators import transform as T
from sluice.operators import watermark as W
from sluice.session import scratch_path
from sluice.plans.registered import iso_ts, register
from sluice.sources.landed import (
    connector_versions, event_pages, order_connectors, prior_state, read_table,
    rich_event_pages, run_log,
)

RUNS = """(SELECT event_id AS id, 'user-' || CAST(user_id AS VARCHAR) AS connector_id,
  CASE CAST(json_extract(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'incremental' ELSE 'sample' END AS run_type,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' AND event_id % 7 = 0 THEN 'running'
    WHEN event_type = 'signup' AND event_id % 11 = 0 THEN 'pending' ELSE 'success' END AS status,
  ts AS started_at, ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS fin,
  CAST(json_extract(props, '$.k') AS BIGINT) AS records_ok,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS records_failed FROM events)"""
RUNS_F = f"(SELECT *, CASE WHEN status IN ('running', 'pending') THEN NULL ELSE fin END AS finished_at FROM {RUNS})"
VERS = """(SELECT l_orderkey * 10 + l_linenumber AS id, 'ord-' || CAST(l_orderkey AS VARCHAR) AS connector_id,
  CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS version_number,
  CASE WHEN l_linestatus = 'F' THEN 'published' ELSE 'draft' END AS status, l_partkey FROM lineitem)"""
AS_OF = "2024-01-31 00:00:00"


@register("j1_stats_by_connector", f"""
SELECT connector_id, count(*) AS total_runs, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS success_runs,
  sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed_runs, coalesce(sum(records_ok), 0) AS records_ok,
  coalesce(sum(records_failed), 0) AS records_failed FROM {RUNS} GROUP BY connector_id""")
def j1_stats_by_connector(spark, sf):
    return J.stats_by_connector(run_log(spark, sf))


@register("j2_global_stats", f"""
SELECT count(*) AS total_runs, coalesce(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END), 0) AS success_runs,
  coalesce(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END), 0) AS failed_runs,
  coalesce(sum(records_ok), 0) AS records_ok, coalesce(sum(records_failed), 0) AS records_failed FROM {RUNS}""")
def j2_global_stats(spark, sf):
    return J.stats_global(run_log(spark, sf))


@register("j3_recent_runs", f"""
SELECT id, connector_id, status FROM {RUNS} ORDER BY started_at DESC, id DESC LIMIT 50""")
def j3_recent_runs(spark, sf):
    return J.recent_runs(run_log(spark, sf)).select("id", "connector_id", "status")


@register("j4_runs_per_connector", f"""
SELECT connector_id, id, rank FROM (SELECT connector_id, id,
  row_number() OVER (PARTITION BY connector_id ORDER BY started_at DESC, id DESC) AS rank FROM {RUNS}) WHERE rank <= 5""")
def j4_runs_per_connector(spark, sf):
    return J.runs_per_connector(run_log(spark, sf), 5).select("connector_id", "id", "rank")


@register("j5_run_details", """
SELECT job_run_id, id FROM (SELECT l_orderkey AS job_run_id, l_orderkey * 10 + l_linenumber AS id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem) WHERE r <= 3""")
def j5_run_details(spark, sf):
    li = read_table(spark, sf, "lineitem")
    details = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
                        F.col("l_orderkey").alias("job_run_id"), F.lit("http").alias("stage"),
                        F.col("l_linenumber").alias("page_number"), F.col("l_returnflag").alias("message"))
    return J.run_details(details, limit=3).select("job_run_id", "id")


@register("j6_run_duration", f"""
SELECT id, (epoch_us(finished_at) // 1000) - (epoch_us(started_at) // 1000) AS duration_ms FROM {RUNS_F}""")
def j6_run_duration(spark, sf):
    return J.with_duration(run_log(spark, sf)).select("id", "duration_ms")


@register("j7_overview_recent", f"""
SELECT id, connector_id FROM {RUNS} ORDER BY started_at DESC, id DESC LIMIT 10""")
def j7_overview_recent(spark, sf):
    return J.overview(run_log(spark, sf), 10)["recent"].select("id", "connector_id")


OVERVIEW_COLUMNS = ["frame", "connector_id", "id", "total_runs", "success_runs", "failed_runs", "records_ok", "records_failed"]


@register("j7_overview", f"""
WITH s AS (SELECT connector_id, count(*) AS total_runs, sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS success_runs,
  sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) AS failed_runs, coalesce(sum(records_ok), 0) AS records_ok,
  coalesce(sum(records_failed), 0) AS records_failed FROM {RUNS} GROUP BY connector_id)
SELECT 'by_connector' AS frame, connector_id, CAST(NULL AS BIGINT) AS id, total_runs, success_runs, failed_runs, records_ok, records_failed FROM s
UNION ALL SELECT 'global', NULL, NULL, coalesce(sum(total_runs), 0), coalesce(sum(success_runs), 0), coalesce(sum(failed_runs), 0),
  coalesce(sum(records_ok), 0), coalesce(sum(records_failed), 0) FROM s
UNION ALL SELECT 'recent', connector_id, id, NULL, NULL, NULL, records_ok, records_failed FROM
  (SELECT * FROM {RUNS} ORDER BY started_at DESC, id DESC LIMIT 10)""")
def j7_overview(spark, sf):
    """All three frames of the overview."""
    frames = J.overview(run_log(spark, sf), 10)
    out = None
    for name, frame in frames.items():
        part = frame.select(*[F.lit(name).alias(c) if c == "frame" else F.col(c) if c in frame.columns else F.lit(None).cast("string" if c == "connector_id" else "bigint").alias(c)
                              for c in OVERVIEW_COLUMNS])
        out = part if out is None else out.unionByName(part)
    return out


@register("j8_active_connectors", f"""
SELECT DISTINCT connector_id FROM {RUNS} WHERE status IN ('pending', 'running')""")
def j8_active_connectors(spark, sf):
    return J.active_connectors(run_log(spark, sf))


@register("j9_fail_stale_runs", f"""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'pending'
  THEN 'failed' ELSE status END AS status
  FROM {RUNS}) GROUP BY status""")
def j9_fail_stale_runs(spark, sf):
    r = J.fail_stale(run_log(spark, sf), AS_OF)
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register("j10_latest_status", f"""
SELECT id AS run_id, status FROM {RUNS}""")
def j10_latest_status(spark, sf):
    r = run_log(spark, sf)
    one = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    ev = (r.select(F.col("id").alias("run_id"), F.lit("pending").alias("status"), F.col("started_at").alias("event_ts"))
          .unionByName(r.filter(F.col("status") != "pending").select(
              F.col("id").alias("run_id"), F.lit("running").alias("status"), (F.col("started_at") + one).alias("event_ts")))
          .unionByName(r.filter(~F.col("status").isin("pending", "running")).select(
              F.col("id").alias("run_id"), "status",
              F.greatest(F.col("finished_at"), F.col("started_at") + one).alias("event_ts"))))
    return J.latest_status(ev).select("run_id", "status")


@register("j11_connector_summary", f"""
SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) AS connector_id, v.published_version, coalesce(v.has_draft, false) AS has_draft
FROM orders LEFT JOIN (SELECT connector_id, max(CASE WHEN status = 'published' THEN version_number END) AS published_version,
  sum(CASE WHEN status = 'draft' THEN 1 ELSE 0 END) > 0 AS has_draft FROM {VERS} GROUP BY connector_id) v
ON v.connector_id = 'ord-' || CAST(o_orderkey AS VARCHAR)""")
def j11_connector_summary(spark, sf):
    s = J.connector_summary(order_connectors(spark, sf), connector_versions(spark, sf))
    return s.select("connector_id", "published_version", "has_draft")


@register("j12_latest_published", f"""
SELECT connector_id, version_number, id FROM (SELECT *, row_number() OVER (PARTITION BY connector_id
  ORDER BY version_number DESC) AS r FROM {VERS} WHERE status = 'published') WHERE r = 1""")
def j12_latest_published(spark, sf):
    return J.latest_published(connector_versions(spark, sf)).select("connector_id", "version_number", "id")


@register("j13_publish_drafts", f"""
WITH sel AS (SELECT connector_id, coalesce(max(CASE WHEN status = 'published' THEN version_number END), 0) + 1 AS nxt
  FROM {VERS} WHERE CAST(substr(connector_id, 5) AS BIGINT) % 3 = 0 GROUP BY connector_id)
SELECT v.connector_id, CASE WHEN v.status = 'draft' AND s.nxt IS NOT NULL THEN s.nxt ELSE v.version_number END AS version_number,
  CASE WHEN v.status = 'draft' AND s.nxt IS NOT NULL THEN 'published' ELSE v.status END AS status
FROM {VERS} v LEFT JOIN sel s USING (connector_id)
UNION ALL SELECT v.connector_id, NULL, 'draft' FROM {VERS} v JOIN sel s USING (connector_id) WHERE v.status = 'draft'""")
def j13_publish_drafts(spark, sf):
    v = connector_versions(spark, sf)
    sel = v.select("connector_id").filter(F.substring("connector_id", 5, 20).cast("bigint") % 3 == 0)
    return J.publish_drafts(v, sel).select("connector_id", "version_number", "status")


@register("j14_import_connectors", """
SELECT connector_id, name FROM (
  SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) AS connector_id, o_orderpriority AS name FROM orders
  WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0
  UNION ALL SELECT 'ord-' || CAST(o_orderkey AS VARCHAR), 'imported-' || o_orderstatus FROM orders WHERE o_orderkey % 3 = 0)""")
def j14_import_connectors(spark, sf):
    c = order_connectors(spark, sf).select("connector_id", "name", "o_orderkey")
    existing = c.filter(F.col("o_orderkey") % 2 == 0).drop("o_orderkey")
    o = read_table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 == 0)
    incoming = o.select(F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("connector_id"),
                        F.concat(F.lit("imported-"), F.col("o_orderstatus")).alias("name"))
    table, _conflicts = J.import_connectors(existing, incoming, overwrite=True)
    return table.select("connector_id", "name")


@register("j14_import_conflicts", """
SELECT 'ord-' || CAST(o_orderkey AS VARCHAR) AS connector_id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0""")
def j14_import_conflicts(spark, sf):
    c = order_connectors(spark, sf)
    existing = c.filter(F.col("o_orderkey") % 2 == 0).select("connector_id", "name")
    incoming = c.filter(F.col("o_orderkey") % 3 == 0).select("connector_id", "name")
    _table, conflicts = J.import_connectors(existing, incoming, overwrite=False)
    return conflicts


@register("j15_audit_rows", """
SELECT o_orderkey AS id, least(2000, length(repeat(o_orderpriority, 200))) AS detail_len FROM orders""")
def j15_audit_rows(spark, sf):
    o = read_table(spark, sf, "orders")
    a = J.audit_rows(o.select(F.col("o_orderkey").alias("id"), F.repeat("o_orderpriority", 200).alias("detail")))
    return a.select("id", F.length("detail").alias("detail_len"))


@register("j16_consecutive_failures", f"""
SELECT connector_id, id FROM (SELECT connector_id, id, status,
  lag(status, 1) OVER w AS s1, lag(status, 2) OVER w AS s2 FROM {RUNS}
  WINDOW w AS (PARTITION BY connector_id ORDER BY started_at, id))
WHERE status = 'failed' AND s1 = 'failed' AND s2 = 'failed'""")
def j16_consecutive_failures(spark, sf):
    return J.consecutive_failures(run_log(spark, sf)).select("connector_id", "id")


@register("j16_runs_without_start", f"""
WITH r AS (SELECT connector_id, id, status, CASE WHEN id <> max(id) OVER (PARTITION BY connector_id) THEN started_at END AS started_at FROM {RUNS})
SELECT connector_id, id, started_at IS NULL AS not_started FROM (SELECT *, lag(status, 1) OVER w AS s1, lag(status, 2) OVER w AS s2 FROM r
  WINDOW w AS (PARTITION BY connector_id ORDER BY started_at NULLS LAST, id)) WHERE status = 'failed' AND s1 = 'failed' AND s2 = 'failed'""")
def j16_runs_without_start(spark, sf):
    """The last run of each connector has no start time: it counts after all others."""
    runs = run_log(spark, sf)
    last = runs.groupBy("connector_id").agg(F.max("id").alias("last"))
    runs = runs.join(last, "connector_id").withColumn("started_at", F.when(F.col("id") != F.col("last"), F.col("started_at"))).drop("last")
    return J.consecutive_failures(runs).select("connector_id", "id", F.col("started_at").isNull().alias("not_started"))


@register("j17_failures_within_window", f"""
SELECT a.connector_id, a.id, count(*) AS failures_in_window FROM
  (SELECT connector_id, id, CAST(floor(epoch(started_at)) AS BIGINT) AS t FROM {RUNS} WHERE status = 'failed') a
  JOIN (SELECT connector_id, CAST(floor(epoch(started_at)) AS BIGINT) AS t FROM {RUNS} WHERE status = 'failed') b
  ON a.connector_id = b.connector_id AND b.t BETWEEN a.t - 1800 AND a.t
GROUP BY a.connector_id, a.id HAVING count(*) >= 3""")
def j17_failures_within_window(spark, sf):
    return J.failures_within(run_log(spark, sf)).select("connector_id", "id", "failures_in_window")


@register("j18_lag_alerts", """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS connector_id, greatest(0, CAST(floor(epoch(TIMESTAMP '2024-01-20 00:00:00')) AS BIGINT)
  - CAST(floor(epoch(max(ts))) AS BIGINT)) AS lag_seconds FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00'
GROUP BY user_id HAVING user_id % 2 = 0 AND lag_seconds > 21600""")
def j18_lag_alerts(spark, sf):
    st = prior_state(spark, sf)
    uid = F.col("user_id")
    st = st.withColumn("ts", F.when(uid % 7 == 0, F.lit(None)).otherwise(F.col("ts")))
    ev = read_table(spark, sf, "events").filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    real = ev.groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("mts"))
    st = st.join(real, "user_id").select("connector_id", F.coalesce("ts", "mts").alias("ts"), "user_id")
    lags = W.watermark_lag(st, "2024-01-20 00:00:00")
    sched = st.select("connector_id", (F.col("user_id") % 2 == 0).alias("enabled"))
    return J.lag_alerts(lags, sched)


@register("j19_daily_report", f"""
SELECT CAST(started_at AS DATE) AS day, connector_id, count(*) AS runs, coalesce(sum(records_ok), 0) AS records_ok,
  coalesce(sum(records_failed), 0) AS records_failed,
  round(100.0 * sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) / count(*), 1) AS success_pct
FROM {RUNS} GROUP BY 1, 2""")
def j19_daily_report(spark, sf):
    return J.daily_report(run_log(spark, sf))


@register("j20_job_counters", f"SELECT connector_id, status, count(*) AS jobs FROM {RUNS} GROUP BY 1, 2")
def j20_job_counters(spark, sf):
    return J.metric_counters(run_log(spark, sf))["jobs"]


@register("j20_records_by_stage", f"""
SELECT 'transform' AS stage, coalesce(sum(records_ok), 0) AS records FROM {RUNS}
UNION ALL SELECT 'failed', coalesce(sum(records_failed), 0) FROM {RUNS}""")
def j20_records_by_stage(spark, sf):
    return J.metric_counters(run_log(spark, sf))["records"]


@register("j20_duration_by_type", f"""
SELECT run_type, count(finished_at) AS n, sum((epoch_us(finished_at) // 1000) - (epoch_us(started_at) // 1000)) AS sum_ms,
  max((epoch_us(finished_at) // 1000) - (epoch_us(started_at) // 1000)) AS max_ms FROM {RUNS_F} GROUP BY run_type""")
def j20_duration_by_type(spark, sf):
    return J.metric_counters(run_log(spark, sf))["duration"].drop("p50_ms")


DURATIONS = f"(SELECT run_type, (epoch_us(finished_at) // 1000) - (epoch_us(started_at) // 1000) AS ms FROM {RUNS_F} WHERE finished_at IS NOT NULL)"


@register("j20_duration_quantiles", f"""
SELECT run_type, count(*) AS n, q, TRUE AS within_bound FROM {DURATIONS}, (SELECT unnest([50, 95]) AS q) GROUP BY run_type, q""")
def j20_duration_quantiles(spark, sf):
    """p50 and p95 from sketches per day and run type, rolled up without the
    runs; each is held against its true rank among the runs (error under 2 %)."""
    runs = run_log(spark, sf)
    found = J.duration_quantiles(J.duration_sketches(runs))
    d = J.with_duration(runs).filter(F.col("duration_ms").isNotNull()).select("run_type", "duration_ms")
    ranks = d.join(found, "run_type").groupBy("run_type").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("n"), *[
        f(c).alias(f"{name}{q}") for q in (50, 95) for name, f, c in
        (("below", F.count_if, F.col("duration_ms") < F.col(f"p{q}_ms")), ("upto", F.count_if, F.col("duration_ms") <= F.col(f"p{q}_ms")))])
    e = ranks.select("run_type", "n", "runs", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"below{q}").alias("below"), F.col(f"upto{q}").alias("upto")) for q in (50, 95)])).alias("x"))
    share = F.col("x.q") / 100
    near = (F.col("x.below") <= (share + 0.02) * F.col("runs")) & (F.col("x.upto") >= (share - 0.02) * F.col("runs"))
    return e.select("run_type", "n", F.col("x.q").alias("q"), (near & (F.col("n") == F.col("runs"))).alias("within_bound"))


@register("j20_duration_p50", f"""
SELECT run_type, count(*) AS n, TRUE AS p50_is_median FROM {DURATIONS} GROUP BY run_type""")
def j20_duration_p50(spark, sf):
    """The p50 of the duration summary, held against the runs: no more than a hundredth of them off the middle."""
    runs = run_log(spark, sf)
    d = J.with_duration(runs).filter(F.col("duration_ms").isNotNull()).select("run_type", "duration_ms")
    g = d.join(J.metric_counters(runs)["duration"].select("run_type", "n", "p50_ms"), "run_type").groupBy("run_type").agg(
        F.max("n").alias("n"), F.count_if(F.col("duration_ms") < F.col("p50_ms")).alias("below"), F.count_if(F.col("duration_ms") <= F.col("p50_ms")).alias("upto"))
    return g.select("run_type", "n", ((F.col("below") <= F.col("n") * 0.51) & (F.col("upto") >= F.col("n") * 0.49)).alias("p50_is_median"))


# ---- K -----------------------------------------------------------------------

@register("k2_upsert_into_target", """
SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def k2_upsert_into_target(spark, sf):
    """Target = last early event per user; batch = pages of later events."""
    ev = read_table(spark, sf, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    early = ev.filter(F.col("ts") < cut).select("user_id", "event_id", "event_type",
                                                F.lit(0).alias("page_idx"), F.col("event_id").alias("pos"))
    target = K.upsert(None, early, ["user_id"])
    late = ev.filter(F.col("ts") >= cut)
    from sluice.sources.landed import event_record, land_pages
    pages = land_pages(late, F.lit("late"), "event_id", event_record())
    recs = X.extract_records(pages, "$.data")
    batch = recs.select(F.try_variant_get("rec", "$.user_id", "bigint").alias("user_id"),
                        F.try_variant_get("rec", "$.event_id", "bigint").alias("event_id"),
                        F.try_variant_get("rec", "$.event_type", "string").alias("event_type"), "page_idx", "pos")
    return K.upsert(target, batch, ["user_id"])


@register("k3_append", """
SELECT user_id, count(*) AS n FROM events GROUP BY user_id""")
def k3_append(spark, sf):
    ev = read_table(spark, sf, "events")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    table = scratch_path(spark, "k3-table")
    sink = K.route("parquet")
    for part in (ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)):
        sink(part.select("event_id", "user_id", F.lit(0).alias("page_idx"), F.col("event_id").alias("pos")), table=table, keys=["user_id"], write_mode="insert")
    return spark.read.parquet(table).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@register("k10_written_counts", """
SELECT write_mode, CASE write_mode WHEN 'insert' THEN count(*) ELSE count(DISTINCT user_id) END AS written
FROM events, (SELECT unnest(['insert', 'upsert', NULL]) AS write_mode) GROUP BY write_mode""")
def k10_written_counts(spark, sf):
    """The parquet sink by write mode: insert writes every row, upsert (also
    the default) one per key; the counts are what the sink reports."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", F.lit(0).alias("page_idx"), F.col("event_id").alias("pos"))
    rows = [(m, K.route("parquet")(ev, table=scratch_path(spark, "k10"), keys=["user_id"], write_mode=m)) for m in ("insert", "upsert", None)]
    return spark.createDataFrame(rows, "write_mode string, written bigint")


@register("k5_first_column_key", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def k5_first_column_key(spark, sf):
    """A sink without configured keys: the first mapped column is the key."""
    ev = read_table(spark, sf, "events").select("user_id", "event_id", F.lit(0).alias("page_idx"), F.col("event_id").alias("pos"))
    return K.upsert(None, ev, K.default_keys(ev.columns, None)).select("user_id", "event_id")


@register("k7_empty_batches", """
SELECT user_id, event_id, 0 AS written_by_empty FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""")
def k7_empty_batches(spark, sf):
    """A batch without rows after a full one writes nothing and loses nothing."""
    ev = read_table(spark, sf, "events").select("user_id", "event_id", F.lit(0).alias("page_idx"), F.col("event_id").alias("pos"))
    table, sink = scratch_path(spark, "k7"), K.route("parquet")
    sink(ev, table=table, keys=["user_id"])
    none = sink(ev.filter(F.lit(False)), table=table, keys=["user_id"])
    return B.read_table(spark, table).select("user_id", "event_id", F.lit(none).cast("int").alias("written_by_empty"))


@register("k4_record_columns", """
SELECT c AS "column", count(*) AS n_records FROM (SELECT unnest(['event_id', 'ts', 'ts_ms', 'ts_dahua', 'ts_meiya',
  'ts_mixed', 'user_id', 'event_type', 'value', 'amount_text', 'qty', 'flag', 'rid', 'tags', 'props']) AS c FROM events)
GROUP BY c""")
def k4_record_columns(spark, sf):
    return K.record_columns(X.extract_records(rich_event_pages(spark, sf), "$.data"))


@register("k4_union_missing_columns", """
SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS value,
  CASE WHEN event_type <> 'click' THEN event_type END AS event_type FROM events""")
def k4_union_missing_columns(spark, sf):
    ev = read_table(spark, sf, "events")
    a = ev.filter(F.col("event_type") == "click").select("event_id", "value")
    b = ev.filter(F.col("event_type") != "click").select("event_id", "event_type")
    return K.union_columns([a, b])


@register("k6_json_columns", """
SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_id % 9 = 0 THEN 'raw_json' END AS json_error FROM events""")
def k6_json_columns(spark, sf):
    ev = read_table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 9 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    j = K.json_columns(ev.select("event_id", raw.alias("raw_json")))
    return j.select("event_id", F.try_variant_get("raw_json", "$.k", "bigint").alias("k"),
                    F.col("__json_error").alias("json_error"))


@register("k9_message_projection", """
SELECT CAST(event_id AS VARCHAR) AS key, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"user_id":'
  || CAST(user_id AS VARCHAR) || ',"event_type":"' || event_type || '","value":' || CAST(value AS VARCHAR)
  || ',"note":' || CASE WHEN event_type = 'error' THEN '"check"' ELSE 'null' END || '}' AS value FROM events""")
def k9_message_projection(spark, sf):
    ev = read_table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.when(F.col("event_type") == "error", F.lit("check")).alias("note"))
    return K.message_projection(ev, ["event_id"])
