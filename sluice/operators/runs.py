"""Run accounting, connector versions and alerts.

Run logs are append-only tables: ``job_run(id, connector_id, run_type,
status, started_at, finished_at, records_ok, records_failed)`` and
``job_run_detail(id, job_run_id, stage, page_number, record_index, message,
sample_json)``. Per-connector top-k and "previous runs" use bounded windows
or equi-joins on a per-connector ordinal, so one busy connector never lands
in a single task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.plans.ordinal import with_ordinal

# Run statuses and the clamps of the listing endpoints.
PENDING, RUNNING, SUCCESS, FAILED = "pending", "running", "success", "failed"
RECENT_DEFAULT, RECENT_MAX = 50, 200
DETAIL_MAX = 100
MESSAGE_LIMIT = 2000
LAG_ALERT_SECONDS = 21600
FAILURE_WINDOW_SECONDS = 1800


def clamp(n: int | None, default: int, hi: int) -> int:
    """Listing limits: default when missing, clamped to 1..hi."""
    return max(1, min(hi, default if n is None else int(n)))


def stats_by_connector(runs: DataFrame) -> DataFrame:
    """Runs, successes, failures, records ok/failed per connector."""
    return (runs.groupBy("connector_id").agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.sum(F.when(F.col("status") == SUCCESS, 1).otherwise(0)).alias("success_runs"),
        F.sum(F.when(F.col("status") == FAILED, 1).otherwise(0)).alias("failed_runs"),
        F.coalesce(F.sum("records_ok"), F.lit(0)).alias("records_ok"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("records_failed")))


def stats_global(runs: DataFrame) -> DataFrame:
    """The same over all runs; one row even for an empty log."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum(F.when(F.col("status") == SUCCESS, 1).otherwise(0)), F.lit(0)).alias("success_runs"),
        F.coalesce(F.sum(F.when(F.col("status") == FAILED, 1).otherwise(0)), F.lit(0)).alias("failed_runs"),
        F.coalesce(F.sum("records_ok"), F.lit(0)).alias("records_ok"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("records_failed"))


def with_duration(runs: DataFrame) -> DataFrame:
    """Duration in ms, NULL while a run has not finished."""
    return runs.withColumn("duration_ms", F.unix_millis("finished_at") - F.unix_millis("started_at"))


def recent_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first (started_at, then id), clamped limit -> a
    TakeOrderedAndProject, no global sort."""
    k = clamp(limit, RECENT_DEFAULT, RECENT_MAX)
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(k)


def runs_per_connector(runs: DataFrame, limit: int | None = None) -> DataFrame:
    """J4 for all connectors at once: the newest ``k`` runs of each (any k:
    only the single listing clamps it). Top-k first within (connector, day),
    then (connector, month), then per connector, so no window sees more than
    k rows of each part below it."""
    k = RECENT_DEFAULT if limit is None else max(1, int(limit))
    pre = runs
    for part in (F.to_date("started_at"), F.date_trunc("month", F.col("started_at")), F.date_trunc("year", F.col("started_at"))):
        w1 = Window.partitionBy("connector_id", part).orderBy(F.col("started_at").desc(), F.col("id").desc())
        pre = pre.withColumn("__r", F.row_number().over(w1)).filter(F.col("__r") <= k).drop("__r")
    w2 = Window.partitionBy("connector_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    return pre.withColumn("rank", F.row_number().over(w2)).filter(F.col("rank") <= k)


def run_details(details: DataFrame, job_run_id=None, limit: int | None = None) -> DataFrame:
    """Details of one run in id order, at most 1..100; without a run
    the details of all runs, cut only if ``limit`` says so."""
    if job_run_id is None and limit is None:
        return details
    k = clamp(limit, DETAIL_MAX, DETAIL_MAX) if job_run_id is not None else max(1, int(limit))
    d = details if job_run_id is None else details.filter(F.col("job_run_id") == F.lit(job_run_id))
    w = Window.partitionBy("job_run_id").orderBy("id")
    return d.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def overview(runs: DataFrame, limit: int | None = None) -> dict[str, DataFrame]:
    """Per-connector stats, global stats and recent runs."""
    return {"by_connector": stats_by_connector(runs), "global": stats_global(runs),
            "recent": recent_runs(runs, limit)}


def active_connectors(runs: DataFrame) -> DataFrame:
    """Connectors with a pending or running run."""
    return runs.filter(F.col("status").isin(PENDING, RUNNING)).select("connector_id").distinct()


def fail_stale(runs: DataFrame, as_of, pending_age_s: int | None = None,
               running_age_s: int | None = None) -> DataFrame:
    """Every pending run becomes failed (with ``pending_age_s``: those
    older than that; with ``running_age_s``, running ones too -- quirk 14)."""
    t = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    age = F.unix_seconds(t) - F.unix_seconds(F.col("started_at"))
    stale = F.col("status") == PENDING
    if pending_age_s is not None:
        stale = stale & (age > pending_age_s)
    if running_age_s is not None:
        stale = stale | ((F.col("status") == RUNNING) & (age > running_age_s))
    return runs.withColumn("error_message", F.when(stale, F.lit("stale run failed")).otherwise(F.col("error_message"))) \
               .withColumn("finished_at", F.when(stale, t).otherwise(F.col("finished_at"))) \
               .withColumn("status", F.when(stale, F.lit(FAILED)).otherwise(F.col("status")))


def latest_status(run_events: DataFrame) -> DataFrame:
    """Status machine over append-only events ``(run_id, status,
    event_ts)``: the latest event wins (``max_by``, partial aggregation)."""
    rank = (F.when(F.col("status") == PENDING, 0).when(F.col("status") == RUNNING, 1).otherwise(2))
    return run_events.groupBy("run_id").agg(
        F.max_by("status", F.struct("event_ts", rank)).alias("status"),
        F.max("event_ts").alias("updated_at"))


def connector_summary(connectors: DataFrame, versions: DataFrame) -> DataFrame:
    """Connectors LEFT JOIN versions: latest published version number
    and whether a draft exists."""
    v = versions.groupBy("connector_id").agg(
        F.max(F.when(F.col("status") == "published", F.col("version_number"))).alias("published_version"),
        (F.sum(F.when(F.col("status") == "draft", 1).otherwise(0)) > 0).alias("has_draft"))
    return connectors.join(v, "connector_id", "left").select(
        connectors["*"], "published_version", F.coalesce("has_draft", F.lit(False)).alias("has_draft"))


def latest_published(versions: DataFrame) -> DataFrame:
    """The latest published version per connector (``max_by``)."""
    p = versions.filter(F.col("status") == "published")
    cols = [c for c in p.columns if c != "connector_id"]
    g = p.groupBy("connector_id").agg(F.max_by(F.struct(*cols), "version_number").alias("__v"))
    return g.select("connector_id", *[F.col("__v")[c].alias(c) for c in cols])


def publish_drafts(versions: DataFrame, connectors_to_publish: DataFrame) -> DataFrame:
    """Each selected connector's draft becomes version max+1 (first = 1)
    and a new draft is opened; all connectors in one batch."""
    sel = connectors_to_publish.select("connector_id").distinct()
    nxt = (versions.join(sel, "connector_id", "left_semi").groupBy("connector_id")
           .agg((F.coalesce(F.max(F.when(F.col("status") == "published", F.col("version_number"))), F.lit(0)) + 1)
                .alias("__next")))
    v = versions.join(nxt, "connector_id", "left")
    is_draft = (F.col("status") == "draft") & F.col("__next").isNotNull()
    published = v.select(*[F.when(is_draft, F.col("__next")).otherwise(F.col("version_number")).alias(c)
                           if c == "version_number" else
                           F.when(is_draft, F.lit("published")).otherwise(F.col("status")).alias(c)
                           if c == "status" else F.col(c) for c in versions.columns])
    drafts = v.filter(is_draft).select(*[F.lit(None).cast(versions.schema[c].dataType).alias(c)
                                         if c == "version_number" else
                                         F.lit("draft").alias(c) if c == "status" else F.col(c)
                                         for c in versions.columns])
    return published.unionByName(drafts)


def import_connectors(existing: DataFrame, incoming: DataFrame, overwrite: bool) -> tuple[DataFrame, DataFrame]:
    """Import configs. ``overwrite``: replace matching ids (upsert);
    else insert only new ids and report the conflicts. Returns (table, conflicts)."""
    conflicts = incoming.join(existing.select("connector_id"), "connector_id", "left_semi") \
                        .select("connector_id")
    if overwrite:
        kept = existing.join(incoming.select("connector_id"), "connector_id", "left_anti")
        return kept.unionByName(incoming, allowMissingColumns=True), conflicts.limit(0)
    new = incoming.join(existing.select("connector_id"), "connector_id", "left_anti")
    return existing.unionByName(new, allowMissingColumns=True), conflicts


def audit_rows(actions: DataFrame) -> DataFrame:
    """Audit entries with details cut at 2000 characters."""
    return actions.withColumn("detail", F.left(F.col("detail"), F.lit(MESSAGE_LIMIT)))


def consecutive_failures(runs: DataFrame, n: int = 3) -> DataFrame:
    """Runs that end a streak of ``n`` failures in a row per connector.
    A per-connector ordinal (skew-safe) and equi-joins on (connector,
    ordinal - i) replace ``lag`` over a whole connector. Runs without a start
    time, as those that were never begun, count after all others, by their id's
    hash; runs without a connector are a chain of their own."""
    r = with_ordinal(runs.select("connector_id", "id", "started_at", "status"),
                     ["connector_id"], "started_at", out="__o", tiebreak=["id"], key_kind="timestamp")
    cur = r.filter(F.col("status") == FAILED).select("connector_id", "id", "started_at", "__o")
    fails = r.filter(F.col("status") == FAILED).select("connector_id", "__o")
    for i in range(1, n):
        prev = fails.select("connector_id", (F.col("__o") + i).alias("__o"))
        cur = cur.join(prev.toDF("__c", "__p"), F.col("connector_id").eqNullSafe(F.col("__c")) & (F.col("__o") == F.col("__p")), "left_semi")
    return cur.select("connector_id", "id", "started_at")


def failures_within(runs: DataFrame, window_s: int = FAILURE_WINDOW_SECONDS, n: int = 3) -> DataFrame:
    """Failed runs at which a connector has had >= ``n`` failures in
    the trailing ``window_s`` seconds (inclusive). Each failure is copied
    into its own time bucket and the next one (the halo), so the range
    window runs per (connector, bucket): bounded by the bucket's runs."""
    f = runs.filter(F.col("status") == FAILED).select(
        "connector_id", "id", F.unix_seconds("started_at").alias("__t"))
    b = F.floor(F.col("__t") / window_s)
    halo = f.select("*", F.explode(F.array(
        F.struct(b.alias("b"), F.lit(True).alias("own")),
        F.struct((b + 1).alias("b"), F.lit(False).alias("own")))).alias("__z"))
    halo = halo.select("connector_id", "id", "__t", F.col("__z.b").alias("__b"), F.col("__z.own").alias("__own"))
    w = Window.partitionBy("connector_id", "__b").orderBy("__t").rangeBetween(-window_s, 0)
    c = halo.withColumn("__n", F.count(F.lit(1)).over(w))
    return c.filter(F.col("__own") & (F.col("__n") >= n)).select(
        "connector_id", "id", F.timestamp_seconds("__t").alias("started_at"), F.col("__n").alias("failures_in_window"))


def lag_alerts(lags: DataFrame, schedules: DataFrame, threshold_s: int = LAG_ALERT_SECONDS) -> DataFrame:
    """Connectors whose watermark lag exceeds the threshold and whose
    schedule is enabled."""
    en = schedules.filter(F.col("enabled")).select("connector_id")
    return lags.filter(F.col("lag_seconds") > threshold_s).join(en, "connector_id", "left_semi")


def daily_report(runs: DataFrame, lags: DataFrame | None = None) -> DataFrame:
    """Per day and connector: runs, success % (1 decimal, 0 without
    runs), records ok/failed, and the max lag when given."""
    g = runs.groupBy(F.to_date("started_at").alias("day"), "connector_id").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.when(F.col("status") == SUCCESS, 1).otherwise(0)).alias("__ok"),
        F.coalesce(F.sum("records_ok"), F.lit(0)).alias("records_ok"),
        F.coalesce(F.sum("records_failed"), F.lit(0)).alias("records_failed"))
    g = g.withColumn("success_pct", F.when(F.col("runs") > 0, F.round(100.0 * F.col("__ok") / F.col("runs"), 1))
                     .otherwise(F.lit(0.0))).drop("__ok")
    if lags is not None:
        g = g.join(lags.groupBy("connector_id").agg(F.max("lag_seconds").alias("max_lag_seconds")),
                   "connector_id", "left")
    return g


def metric_counters(runs: DataFrame) -> dict[str, DataFrame]:
    """Job counters by connector/status, duration summary by run type,
    records by stage (``transform`` ok, ``failed``)."""
    d = with_duration(runs)
    return {
        "jobs": runs.groupBy("connector_id", "status").agg(F.count(F.lit(1)).alias("jobs")),
        "duration": d.groupBy("run_type").agg(
            F.count("duration_ms").alias("n"), F.sum("duration_ms").alias("sum_ms"),
            F.max("duration_ms").alias("max_ms"),
            F.percentile_approx("duration_ms", 0.5).alias("p50_ms")),
        "records": runs.select(F.explode(F.array(
            F.struct(F.lit("transform").alias("stage"), F.col("records_ok").alias("n")),
            F.struct(F.lit("failed").alias("stage"), F.col("records_failed").alias("n")))).alias("s"))
            .groupBy(F.col("s.stage").alias("stage")).agg(F.coalesce(F.sum("s.n"), F.lit(0)).alias("records")),
    }


# Items kept a level of a sketch; the rank error that goes with it (one-sided, 99 %) is below 1 %.
SKETCH_K = 400


def duration_sketches(runs: DataFrame, by: tuple = ("day", "run_type"), k: int = SKETCH_K) -> DataFrame:
    """J20 durations as mergeable state: one quantile sketch (KLL) of
    ``duration_ms`` per day and run type, of a few KB whatever the number of
    runs. Append the sketches of each new day; no quantile reads a run again.
    Unfinished runs have no duration; a group of only such runs has no sketch."""
    d = with_duration(runs).withColumn("day", F.to_date("started_at")).filter(F.col("duration_ms").isNotNull())
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint("duration_ms", k).alias("sketch"))


def duration_quantiles(sketches: DataFrame, by: tuple = ("run_type",), quantiles: tuple = (0.5, 0.95), k: int = SKETCH_K) -> DataFrame:
    """Sketches rolled up to ``by``: runs and one ``p<percent>_ms`` a quantile."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("__s"))
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_bigint("__s", F.lit(q)).alias(f"p{round(q * 100)}_ms") for q in quantiles])
