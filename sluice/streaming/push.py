"""Push events as a stream.

Each pushed request lands as one JSON line ``{connector_id, request_id,
sign, seq, body}`` (``body`` = the event object text). The stream is read
with ``readStream.json`` and processed per micro-batch with ``foreachBatch``:

* U1 gate: stream-static join to the latest published push connectors
  (``connector_id, mode, published, webhook_enabled, verify_sign,
  plat_flag``; one row per connector). The join is left to the planner,
  which broadcasts the table only where its measured size allows it.
* U2 normalise, U3 id check, U4 signature, U5 typed transform (T17 rules;
  a failing field fails the event), ``raw_json`` = the normalised event.
* U7 result rows (``op_code`` 0/1 + reason), U8 run-log rows
  (``run_type=push``): a folder per stream and batch, written over on a replay.
* U6 idempotent write: keyed upsert per (connector, event id), last ``seq``
  wins, into a table whose log names the stream and its batch. It is committed
  after results and run log: a batch the log has is complete, any other is
  done again as a whole. A stream with another checkpoint is another writer.
* U6 in state: ``dedupe_pushes`` drops repeats of (connector, event id) that
  come within a delay in event time, before anything is written.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators import tables as B
from sluice.operators import transform as TR
from sluice.session import scratch_path
from sluice.streaming.pages import stream_id

PUSH_SCHEMA = T.StructType([
    T.StructField("connector_id", T.StringType()),
    T.StructField("request_id", T.StringType()),
    T.StructField("sign", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("body", T.StringType()),
])

# Reply reasons.
R_NO_CONNECTOR = "connector not found"
R_NOT_PUSH = "connector mode does not accept push"
R_NOT_PUBLISHED = "connector not published"
R_WEBHOOK_OFF = "webhook not enabled"
R_NOT_OBJECT = "body must be a JSON object"
R_NO_ID = "EventID is required"
R_BAD_SIGN = "sign verification failed"
R_TRANSFORM = "transform failed for push event"


def sign_of(plat_flag: Column, event_id: Column) -> Column:
    """U4: upper-case MD5 hex of ``platFlag_EventID``."""
    return F.upper(F.md5(F.concat_ws("_", plat_flag, event_id)))


def sign_ok(plat_flag: Column, event_id: Column, sign: Column) -> Column:
    return F.coalesce(F.upper(F.trim(sign)) == sign_of(plat_flag, event_id), F.lit(False))


def normalise(body: Column) -> Column:
    """The event as VARIANT with ``ImgUrl`` := ``ImageUrl`` when missing."""
    v = F.try_parse_json(body)
    img = F.try_variant_get(v, "$.ImgUrl", "variant")
    alt = F.try_variant_get(v, "$.ImageUrl", "variant")
    missing = img.isNull() | F.is_variant_null(img)
    fixed = F.when(missing & alt.isNotNull() & ~F.is_variant_null(alt), F.parse_json(
        F.concat(F.regexp_replace(F.to_json(v), r"}\s*$", ""),
                 F.when(F.to_json(v) == "{}", F.lit("")).otherwise(F.lit(",")),
                 F.lit('"ImgUrl":'), F.to_json(alt), F.lit("}"))))
    return F.coalesce(fixed, v)


def evaluate(events: DataFrame, connectors: DataFrame, mappings: Sequence[dict],
             id_field: str = "EventID") -> DataFrame:
    """U1-U5 over a (micro-)batch: one row per request with ``op_code``,
    ``op_desc``, ``gated`` (True when the gate rejected it: no run row) and
    the mapped columns for accepted events."""
    c = connectors.select("connector_id", "mode", "published", "webhook_enabled", "verify_sign", "plat_flag",
                          F.lit(True).alias("__known"))
    j = events.join(c, "connector_id", "left")
    v = normalise(F.col("body"))
    j = j.withColumn("rec", v)
    is_obj = F.substring(F.schema_of_variant("rec"), 1, 6) == "OBJECT"
    eid = F.try_variant_get("rec", f"$.{id_field}", "string")
    gate = (F.when(F.col("__known").isNull(), F.lit(R_NO_CONNECTOR))
             .when(~F.lower(F.coalesce("mode", F.lit(""))).isin("push", "both"), F.lit(R_NOT_PUSH))
             .when(~F.coalesce(F.col("published"), F.lit(False)), F.lit(R_NOT_PUBLISHED))
             .when(~F.coalesce(F.col("webhook_enabled"), F.lit(False)), F.lit(R_WEBHOOK_OFF)))
    check = (F.when(F.col("rec").isNull() | ~is_obj, F.lit(R_NOT_OBJECT))
              .when(eid.isNull() | (F.trim(eid) == ""), F.lit(R_NO_ID))
              .when(F.coalesce(F.col("verify_sign"), F.lit(False)) & ~sign_ok(F.col("plat_flag"), eid, F.col("sign")),
                    F.lit(R_BAD_SIGN)))
    j = j.withColumn("__gate", gate).withColumn("__check", check) \
         .withColumn("raw_json", F.to_json("rec")).withColumn("page_idx", F.lit(0)) \
         .withColumn("pos", F.col("seq"))
    m = TR.map_fields_step(j.select("connector_id", "request_id", "seq", "page_idx", "pos", "rec",
                                    "__gate", "__check", "raw_json"), mappings,
                           carry=("request_id", "seq", "__gate", "__check", "raw_json")).drop("__sample")
    reason = F.coalesce("__gate", "__check", F.when(F.col(TR.ERR).isNotNull(), F.lit(R_TRANSFORM)))
    return m.withColumn("op_code", F.when(reason.isNull(), 0).otherwise(1)) \
            .withColumn("op_desc", F.coalesce(reason, F.lit("ok"))) \
            .withColumn("gated", F.col("__gate").isNotNull()) \
            .drop("__gate", "__check", TR.ERR)


def process_batch(batch: DataFrame, batch_id: int, connectors: DataFrame, mappings: Sequence[dict], table: str, results: str, runlog: str,
                  key: str | Sequence[str] = ("connector_id", "event_id"), writer: str = "push") -> None:
    """U6-U8 for one micro-batch, once per (writer, batch id)."""
    spark = batch.sparkSession
    if B.committed(spark, table, writer, batch_id):
        return                                  # replayed batch: the table is committed last, so all is there
    staged = scratch_path(spark, "push-batch")  # three writes from one evaluation, also if an executor is lost between them
    evaluated = evaluate(batch, connectors, mappings)
    evaluated.write.parquet(staged)
    ev = spark.read.schema(evaluated.schema).parquet(staged)
    part = f"writer={writer}/batch_id={batch_id}"
    targets = [m["target"] for m in mappings]
    ok = ev.filter(F.col("op_code") == 0).select(*dict.fromkeys(["connector_id", *targets]), "raw_json", "page_idx", "pos")
    ev.select("connector_id", "request_id", "seq", "op_code", "op_desc").write.mode("overwrite").parquet(f"{results}/{part}")
    ev.filter(~F.col("gated")).select(
        "connector_id", F.lit("push").alias("run_type"),
        F.when(F.col("op_code") == 0, "success").otherwise("failed").alias("status"),
        F.when(F.col("op_code") == 0, 1).otherwise(0).alias("records_ok"),
        F.lit(0).alias("records_failed"), "request_id").write.mode("overwrite").parquet(f"{runlog}/{part}")
    # The table keeps each row's push sequence (pos): the last push per
    # key wins whatever order the micro-batches arrive in.
    B.upsert_table(ok, table, [key] if isinstance(key, str) else list(key), writer=writer, batch_id=batch_id)


def run_push_stream(spark, landed_dir: str, connectors: DataFrame, mappings: Sequence[dict],
                    out_dir: str, checkpoint: str, max_files_per_trigger: int | None = None):
    """Read landed push requests as a stream and process them to
    completion (``availableNow``). Returns the table folder."""
    reader = spark.readStream.schema(PUSH_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(landed_dir)
    table, results, runlog = f"{out_dir}/table", f"{out_dir}/results", f"{out_dir}/runs"
    q = (stream.writeStream
         .foreachBatch(lambda df, bid: process_batch(df, bid, connectors, mappings, table, results, runlog, writer=stream_id(spark, checkpoint)))
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return table, results, runlog


def dedupe_pushes(events: DataFrame, within: str, id_field: str = "EventID", time_fields: Sequence[str] = ("EventTime", "SendTime")) -> DataFrame:
    """U6 over a stream: the first of the pushes of one connector and event id
    whose event times lie within ``within``; adds ``event_id``, ``event_time``.

    The state holds a key until the watermark has passed its time by the delay,
    whatever the length of the stream; until the
    batch after that, any push of that key is a repeat. A push later than the delay is dropped
    (and counted in the query's progress): where late pushes must land, the
    keyed table (``process_batch``) is the way. Pushes without an id are never
    repeats of each other: they pass, one by request, for U3 to reject. One
    without a time passes as well; its repeats do so unless they share its
    micro-batch."""
    v = F.try_parse_json("body")
    eid = F.nullif(F.trim(F.try_variant_get(v, f"$.{id_field}", "string")), F.lit(""))
    at = F.coalesce(*[F.try_to_timestamp(F.try_variant_get(v, f"$.{f}", "string")) for f in time_fields])
    key = F.coalesce(F.concat(F.lit("id:"), eid), F.concat(F.lit("request:"), F.col("request_id")))
    timed = events.withColumn("event_id", eid).withColumn("event_time", at).withColumn("__key", key)
    return timed.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["connector_id", "__key"]).drop("__key")


def run_deduped_stream(spark, landed_dir: str, out: str, checkpoint: str, within: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Land the pushes without repeats: files written once; returns all of them so far."""
    reader = spark.readStream.schema(PUSH_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    found = dedupe_pushes(reader.json(landed_dir), within)
    q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)
