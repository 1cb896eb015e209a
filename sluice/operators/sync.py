"""One run of connectors over their landed pages.

A run reads its pages twice: once for the page log, a small table with a row a
page (failure, records, stop rules, the page's highest watermark values), and
once for the records of the pages that the log lets pass, which are
transformed and staged. All that follows works on those two.

Rows, watermarks and run rows become visible together: they are tables of one
store, and one put-if-absent of its next version commits the run (see
``tables``). A run that breaks off before leaves nothing; a run that finds
another one's version in its place starts again from that with its rows as it
staged them; a run that is in the log already is not done again. External sinks
(database, messages) are written before the commit: an upsert repeated after a
break-off is harmless, messages are sent at least once.

Failed pages fail the connector's run: a failed run row with the reason is all
it leaves. Sample runs take the first records of a run and move no watermark.
"""
from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sluice.functions.jsonpath import is_json_null, parse_body, read_instant, read_monotonic_id, root_path, vget, vkind
from sluice.functions.timefmt import overlap_seconds
from sluice.operators import extract as X
from sluice.operators import paging as G
from sluice.operators import sinks as K
from sluice.operators import tables as B
from sluice.operators import transform as T
from sluice.operators import watermark as W
from sluice.plans.ordinal import with_prefix_offset
from sluice.session import scratch_path

STATE_SCHEMA = "connector_id string, ts timestamp, last_id string, updated_at timestamp"
RUNS_SCHEMA = "connector_id string, run_id bigint, run_type string, mode string, status string, records_ok bigint, records_failed bigint, error_message string, details string"
DETAILS_SCHEMA = "connector_id string, run_id bigint, stage string, page_idx int, record_index bigint, message string, sample_json string"
RUN = ["connector_id", "run_id"]


@dataclass(frozen=True)
class SyncConfig:
    """The settings of a parsed config (S1) that a run needs.

    ``table``: of the parquet sink, the name of a table in the run's store; of
    a database, the table. ``connector_column``: with it several connectors
    share a table, each with keys of its own."""
    input_root: str = "$.data"
    steps: tuple = ()
    sink: str = "parquet"
    table: str = "rows"
    keys: tuple[str, ...] = ()
    write_mode: str = "upsert"
    inc_enabled: bool = False
    inc_mode: str = "timestamp"
    response_path: str = "$.updated_at"
    overlap: str = "5m"
    on_first_run: str = "full"
    bump: bool = True
    schema: str = "public"
    topic: str = ""
    batch_size: int = 500
    sink_options: Mapping = field(default_factory=dict)
    connector_column: str = ""
    strategy: str = ""
    stop_when: tuple[str, ...] = ()
    cursor_path: str = ""
    has_more_path: str = ""
    total_path: str = ""
    page_size: int = 100
    page_start: int = 1
    max_pages: int | None = None

    @staticmethod
    def from_row(row, table: str | None = None, **sink_options) -> SyncConfig:
        """From a row of ``parse_configs``. ``table`` in place of the configured one; ``sink_options``: url, connect, broker settings."""
        from sluice.operators.config import transform_steps
        s, i, t, p = row["sink"], row["incremental"], row["transform"], row["pagination"]
        c = SyncConfig(t["input_root"], tuple(transform_steps(t["steps"])), "", table or "rows", inc_enabled=i["enabled"], inc_mode=i["mode"],
                       response_path=i["response_path"] or "$.updated_at", overlap=i["overlap"] or "5m", on_first_run=row["sync"]["on_first_run"],
                       strategy=p["strategy"], stop_when=tuple(p["stop_when"]), cursor_path=p["cursor_response_path"] or "", has_more_path=p["has_more_path"] or "",
                       total_path=p["total_path"] or "", page_size=p["page_size"], page_start=p["page_start"], max_pages=p["max_pages"])
        if s is None:
            return c
        return replace(c, sink=s["type"], table=table or s["table"] or "", keys=tuple(s["keys"]), write_mode=s["write_mode"], schema=s["schema"],
                       topic=s["topic"] or "", batch_size=s["batch_size"], sink_options=sink_options)


def _stored(spark, base: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    got = B.read_table(spark, base, name, version)
    return spark.createDataFrame([], schema) if got is None else got.select(*[c.split()[0] for c in schema.split(", ")])


def read_state(spark, base: str, version: int | None = None) -> DataFrame:
    """The stored watermarks; none yet: an empty table."""
    return _stored(spark, base, "state", STATE_SCHEMA, version)


def read_runs(spark, base: str) -> DataFrame:
    """The run rows, one per connector and run."""
    return _stored(spark, base, "runs", RUNS_SCHEMA)


def read_details(spark, base: str) -> DataFrame:
    """The page and transform rows of the runs in the log."""
    folders = [r[0] for r in read_runs(spark, base).select("details").filter("details is not null").distinct().collect()]     # one a run
    return spark.read.schema(DETAILS_SCHEMA).parquet(*[f"{base}/{f}" for f in folders]) if folders else spark.createDataFrame([], DETAILS_SCHEMA)


def requested_since(source: DataFrame, time_col: str, state: DataFrame, connector: Column, overlap: str) -> DataFrame:
    """The rows an incremental request returns: those at or after each
    connector's watermark less the overlap; all rows of a connector without
    one. An equi-join with the state, one row per connector."""
    start = state.select(F.col("connector_id").alias("__c"), (F.col("ts") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), overlap_seconds(F.lit(overlap)))).alias("__start"))
    j = source.withColumn("__conn", connector).join(start, F.col("__conn") == F.col("__c"), "left")
    return j.filter(F.col("__start").isNull() | (F.col(time_col) >= F.col("__start"))).drop("__conn", "__c", "__start")


def _staged(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def page_log(pages: DataFrame, config: SyncConfig) -> DataFrame:
    """A row a page, from one parse of its body: ``reason`` it failed for,
    ``n_records``, ``stop`` (the strategy's rules, G1/G2), ``total``, and the
    highest watermark values of its records."""
    path, _ = root_path(config.input_root)
    d = pages.filter(F.col("kind").isin("page", "count")).withColumn("__v", parse_body(F.col("body")))
    root = F.try_variant_get("__v", path, "variant")
    d = d.withColumn("__r", root).withColumn("__k", vkind(F.col("__r")))
    d = d.withColumn("__a", F.when(F.col("__k") == "array", F.try_variant_get("__r", "$", "array<variant>")).when(~is_json_null(F.col("__r")), F.array("__r")))
    broken = F.col("body").isNotNull() & (F.trim("body") != "") & F.col("__v").isNull()
    d = d.withColumn("n_records", F.coalesce(F.size("__a"), F.lit(0)))
    stop = {"link_header": G.link_stop_rule, "cursor": G.cursor_stop_rule}.get(config.strategy.lower())
    stop = F.lit(False) if stop is None else stop(F.col("__v"), F.col("n_records"), F.col("headers"), config.cursor_path, config.has_more_path, config.stop_when)
    total = F.try_variant_get(vget(F.col("__v"), config.total_path), "$", "int") if config.total_path else F.lit(None).cast("int")
    null = F.lit(None)
    times, ids = null.cast("timestamp"), null.cast("array<string>")
    if config.inc_enabled and config.inc_mode == "monotonic_id":
        ids = F.filter(F.transform("__a", lambda r: read_monotonic_id(r, config.response_path)), lambda x: x.isNotNull() & (F.trim(x) != ""))
    elif config.inc_enabled:
        times = F.array_max(F.transform("__a", lambda r: read_instant(r, config.response_path)))
    d = d.select(*RUN, "page_idx", "kind", "duration_ms", "n_records", G.failure_reason(broken).alias("reason"), stop.alias("stop"), total.alias("total"), times.alias("wm_ts"), ids.alias("__ids"))
    number = lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("bigint"))
    return d.withColumn("wm_num", F.array_max(F.transform("__ids", number))).withColumn("wm_text", F.array_max("__ids")).drop("__ids")


def kept_pages(log: DataFrame, config: SyncConfig) -> DataFrame:
    """The data pages of runs without a failed page, up to the strategy's stop."""
    failed = log.filter(F.col("reason").isNotNull()).select(*RUN).distinct()
    good = log.join(failed, RUN, "left_anti").filter(F.col("kind") == "page")
    strategy = config.strategy.lower()
    if not strategy:
        return good.withColumn("run_truncated", F.lit(False))
    if strategy in ("cursor", "link_header"):
        return G.truncate_chain(good, config.max_pages)
    flagged = good.withColumn("__total", F.col("total")).withColumn("__ps", F.lit(config.page_size)).withColumn("__pstart", F.lit(config.page_start))
    return G.truncate_pages_by_total(flagged, config.max_pages)


def _check(config: SyncConfig, run_type: str, record_limit: int | None, write_sink: bool) -> None:
    if run_type == "sample" and (record_limit is None or record_limit <= 0):
        raise ValueError("a sample run requires a positive record limit")
    if write_sink and config.sink:
        K.route(config.sink)
        kind = config.sink.strip().lower()
        K.check_target(config.topic if kind == "kafka" else config.table, "topic" if kind == "kafka" else "table")
        K.is_upsert(config.write_mode)
        if kind == "parquet" and ("/" in config.table or config.table in ("state", "runs", "details") or config.table.startswith("_")):
            raise K.SinkError(f"{config.table!r} can't be the name of a run's table")


def watermarks(log: DataFrame, prev: DataFrame, config: SyncConfig, modes: DataFrame, as_of: str) -> DataFrame:
    """(connector_id, ts, last_id) after the run, of every connector in ``log`` (W1-W4); the field the mode doesn't move stays."""
    seen = log.groupBy("connector_id").agg(F.max("wm_ts").alias("ts"), F.max("wm_num").alias("num"), F.max("wm_text").alias("text"))
    old = prev.select("connector_id", F.col("ts").alias("prev_ts"), F.col("last_id").alias("prev_id"))
    if config.inc_mode == "monotonic_id":
        prev_num = F.when(F.col("prev_id").rlike(r"^[+-]?[0-9]+$"), F.col("prev_id").try_cast("bigint"))
        last = F.coalesce(F.greatest("num", prev_num).cast("string"), F.greatest("text", "prev_id"))
        return seen.join(old, "connector_id", "left").select("connector_id", F.col("prev_ts").alias("ts"), last.alias("last_id"))
    advanced = seen.join(old, "connector_id", "left").select("connector_id", F.greatest("prev_ts", "ts").alias("ts"))
    incremental = F.col("mode") == "incremental"
    if config.inc_mode == "rolling_window":
        new = W.rolling_advance(advanced.join(modes, "connector_id"), incremental, as_of)
    elif config.bump:
        some = modes.filter(incremental).select("connector_id")
        new = W.bump_if_unchanged(advanced.join(some, "connector_id", "left_semi"), prev, as_of).unionByName(advanced.join(some, "connector_id", "left_anti"))
    else:
        new = advanced
    return new.join(old.drop("prev_ts"), "connector_id", "left").select("connector_id", "ts", F.col("prev_id").alias("last_id"))


def run_sync(pages: DataFrame, config: SyncConfig, base: str, run_id: int, as_of: str, run_type: str = "incremental",
             connectors: Sequence[str] | None = None, record_limit: int | None = None, write_sink: bool = True,
             before_commit: Callable[[], None] | None = None) -> dict:
    """Run the connectors whose pages these are; returns the rows written and the store's version.

    ``base``: folder of the store. ``run_type``: full, incremental or sample
    (which needs ``record_limit``). ``before_commit`` is called when all but
    the commit is done (for tests of broken-off and racing runs)."""
    spark = pages.sparkSession
    _check(config, run_type, record_limit, write_sink)
    if connectors is not None:
        pages = pages.filter(F.col("connector_id").isin(list(connectors)))
    log = _staged(page_log(pages, config), "sync-pages")
    present = log.select("connector_id").distinct()
    if write_sink and config.sink and not config.connector_column and present.limit(2).count() > 1:
        raise K.SinkError("several connectors in one run need a connector_column in their sink")
    if _in_log(spark, base, present, run_id):
        return {"written": 0, "version": B.read_version(spark, base).number}
    settings = present.select("connector_id", F.lit(run_type).alias("sync_type"), F.lit(config.inc_enabled).alias("inc_enabled"),
                              F.lit(config.inc_mode).alias("inc_mode"), F.lit(config.on_first_run).alias("on_first_run"))
    modes = _staged(W.choose_mode(settings, read_state(spark, base)), "sync-modes")      # as the run was requested; W5

    kept = kept_pages(log, config)
    offsets = with_prefix_offset(kept.select(*RUN, "page_idx", "n_records"), RUN, "page_idx", "n_records", out="__poff")
    if record_limit is not None:
        kept = offsets.withColumnRenamed("__poff", "__off").filter(F.col("__off") < record_limit)
    data = pages.filter(F.col("kind") == "page")
    if config.strategy or record_limit is not None:
        data = data.join(kept.select(*RUN, "page_idx", *(["__off"] if record_limit is not None else [])), [*RUN, "page_idx"])
    elif not (failed := log.filter(F.col("reason").isNotNull()).select(*RUN).distinct()).isEmpty():
        data = G.drop_failed_runs(data, failed)
    records = X.extract_records(data, config.input_root, keep=[*RUN, "page_idx", *(["__off"] if record_limit is not None else [])])
    if record_limit is not None:
        records = records.filter(F.col("__off") + F.col("pos") < record_limit).drop("__off")
    result = T.transform(records, list(config.steps), max_errors=T.PULL_MAX_ERRORS, stage=lambda d: _staged(d, "sync-rows"), offsets=offsets.drop("n_records"))
    rows = result.rows.drop(*[c for c in ("rec", "record_index") if c in result.rows.columns])

    data_columns = [c for c in rows.columns if c not in ("connector_id", *K.DEFAULT_ORDER)]
    sunk = rows.withColumn(config.connector_column, F.col("connector_id")) if config.connector_column else rows
    sunk = sunk.drop("connector_id") if config.connector_column != "connector_id" else sunk
    keys = [*([config.connector_column] if config.connector_column else []), *K.default_keys(data_columns, config.keys)]
    staged, written = None, None
    if write_sink and config.sink and config.sink.strip().lower() == "parquet":
        obs = Observation(f"sync_{run_id}")
        insert = not K.is_upsert(config.write_mode)          # an inserted record is a row of its own: the run, page and place are its key
        staged = B.stage_batch(sunk, [*([config.connector_column] if config.connector_column else []), "run_id", "page_idx", "pos"] if insert else keys, K.DEFAULT_ORDER, obs)
        written = int(obs.get["n"])
    elif write_sink and config.sink:
        written = K.route(config.sink)(sunk, keys=keys, write_mode=config.write_mode, **_target(config))
    counts = rows.groupBy("connector_id").agg(F.count(F.lit(1)).alias("records_ok"))
    bad = result.errors_count.withColumnRenamed("n", "records_failed")
    folder = f"details/{run_id}-{scratch_path(spark, 'x').rsplit('-', 1)[-1]}"
    run_rows = _staged(_run_rows(log, modes, counts, bad, run_id, run_type, folder), "sync-runs")
    if written is None:
        written = int(run_rows.agg(F.sum("records_ok")).first()[0] or 0)
    some_bad = not run_rows.filter("records_failed > 0").isEmpty()
    details(log, kept, result.errors if some_bad else None, run_id).write.parquet(f"{base}/{folder}")
    run_batch = B.Staged(run_rows, tuple(RUN), ("run_id",))           # one row a connector already

    def change(v: B.Version) -> B.Version | None:
        if _in_log(spark, base, present, run_id, v.number):
            return None
        tables = dict(v.tables)
        if staged is not None:
            tables[config.table] = B.merge(spark, base, config.table, tables.get(config.table), staged)
        if config.inc_enabled and run_type != "sample":
            prev = read_state(spark, base, v.number)
            ended = run_rows.filter("status = 'success'").select("connector_id")
            moved = watermarks(log.join(ended, "connector_id", "left_semi").join(kept.select(*RUN, "page_idx"), [*RUN, "page_idx"], "left_semi")
                               .unionByName(log.join(ended, "connector_id", "left_semi").filter("kind = 'count'")), prev, config, modes, as_of)
            settled = moved.select("*", F.lit(run_type).alias("run_type"), F.lit(True).alias("inc_enabled"), F.lit(config.inc_mode).alias("inc_mode"), F.lit("success").alias("status"))
            new = W.persistable(settled).withColumn("updated_at", F.lit(as_of).cast("timestamp")).withColumn("seq", F.lit(v.number).cast("bigint"))
            tables["state"] = B.merge(spark, base, "state", tables.get("state"), B.Staged(_staged(new, "sync-state"), ("connector_id",), ("seq",)), buckets=1)
        tables["runs"] = B.merge(spark, base, "runs", tables.get("runs"), run_batch, buckets=1)
        return replace(v, tables=tables, note=f"run {run_id}")

    version = B.commit(spark, base, change, before_commit=before_commit)
    return {"written": written, "version": version}


def _in_log(spark, base: str, connectors: DataFrame, run_id: int, version: int | None = None) -> bool:
    """Whether the run is done: its connectors have run rows."""
    if version == 0:
        return False
    done = _stored(spark, base, "runs", RUNS_SCHEMA, version).filter(F.col("run_id") == run_id)
    return not done.isEmpty() and connectors.join(done, "connector_id", "left_anti").isEmpty()


def _target(config: SyncConfig) -> dict:
    """What a sink is called with besides rows, keys and mode."""
    if config.sink.strip().lower() == "kafka":
        return {"topic": config.topic, **config.sink_options}
    table = f"{config.schema}.{config.table}" if config.schema and "." not in config.table else config.table
    return {"table": table, "batch_size": config.batch_size, **config.sink_options}


def _run_rows(log: DataFrame, modes: DataFrame, ok: DataFrame, failed: DataFrame, run_id: int, run_type: str, folder: str) -> DataFrame:
    reason = F.min(F.struct("page_idx", "reason"))
    why = log.filter(F.col("reason").isNotNull()).groupBy("connector_id").agg(reason["reason"].alias("error_message"))
    j = modes.join(ok, "connector_id", "left").join(failed, "connector_id", "left").join(why, "connector_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return j.select("connector_id", F.lit(run_id).cast("bigint").alias("run_id"), F.lit(run_type).alias("run_type"), "mode",
                    F.when(F.col("error_message").isNull(), "success").otherwise("failed").alias("status"),
                    count("records_ok"), count("records_failed"), "error_message", F.lit(folder).alias("details"))


def details(log: DataFrame, kept: DataFrame, errors: DataFrame | None, run_id: int) -> DataFrame:
    """Per-run details: a row a fetched page, a failed page, and a sampled bad record."""
    null, run = F.lit(None), F.lit(run_id).cast("bigint").alias("run_id")
    fetched = log.join(kept.select(*RUN, "page_idx"), [*RUN, "page_idx"], "left_semi").filter("kind = 'page'")
    message = F.concat(F.lit("page fetched records="), F.col("n_records").cast("string"), F.lit(" durationMs="), F.coalesce(F.col("duration_ms").cast("string"), F.lit("")))
    http = lambda d, m: d.select("connector_id", run, F.lit("http").alias("stage"), F.col("page_idx").cast("int").alias("page_idx"), null.cast("bigint").alias("record_index"),
                                 m.alias("message"), null.cast("string").alias("sample_json"))
    failed = log.filter(F.col("reason").isNotNull())
    pages = http(fetched, message).unionByName(http(failed, F.col("reason")))
    if errors is None:
        return pages
    bad = errors.select("connector_id", run, F.lit("transform").alias("stage"), null.cast("int").alias("page_idx"), "record_index", "message", "sample_json")
    return pages.unionByName(bad)
