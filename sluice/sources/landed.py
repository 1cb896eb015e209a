"""Landed response pages derived from tables (S2 input builder).

A paged JSON API returns its rows ``page_size`` at a time inside an envelope.
``land_pages`` produces exactly what such an API would have returned for a
table: one row per (connector, page) in the PAGES schema. Page contents are
bounded by ``page_size`` so the per-page ``collect_list`` never grows with
the data; numbering within a connector uses the skew-safe ordinal.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.ordinal import with_ordinal

PAGES_SCHEMA = T.StructType([
    T.StructField("connector_id", T.StringType()),
    T.StructField("run_id", T.LongType()),
    T.StructField("page_idx", T.IntegerType()),
    T.StructField("kind", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("body", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("body_length", T.LongType()),
    T.StructField("error", T.StringType()),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
])

PAGE_COLUMNS = [f.name for f in PAGES_SCHEMA.fields]


def record_json(cols: dict[str, Column]) -> Column:
    """JSON object text of named columns, nulls kept."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in cols.items()]),
                     {"ignoreNullFields": "false"})


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows of few bytes and much work each, dealt over the session's partitions: a scan makes its tasks by bytes."""
    return rows.repartition(shuffle_partitions(rows), key)


def land_pages(df: DataFrame, connector: Column, order: str, record: Column,
               page_size: int = 100, root: str = "data", total: bool = True,
               run_id: int = 1, tiebreak: Sequence[str] = (),
               cursor: bool = False, link: bool = False,
               empty_tail: bool = False, key_kind: str = "number") -> DataFrame:
    """Group rows of ``df`` into API pages.

    ``record`` is the JSON text of one row. The body is
    ``{"<root>":[...], "meta":{"total":N, "next":..., "hasMore":...}}``; with
    ``root='$'`` the body is the bare array. ``cursor`` adds next-cursor and
    has-more fields, ``link`` a ``Link`` header pointing at the next page.
    ``empty_tail`` appends the empty page an API returns after the last one.
    """
    names = [f"__tb{i}" for i in range(len(tiebreak))]
    rows = df.select("*", connector.alias("__conn"), F.col(order).alias("__ord"), *[F.col(c).alias(n) for c, n in zip(tiebreak, names)])
    rows = with_ordinal(rows, ["__conn"], "__ord", out="__rn", tiebreak=names, key_kind=key_kind, total="__total")
    # The columns a record needs travel to its page, and its text is made there: building and parsing JSON costs far
    # more than its bytes show, so the number of partitions is the session's and not one chosen by bytes.
    rows = rows.withColumns({"__page": (F.col("__rn") / page_size).cast("int"), "__pos": (F.col("__rn") % page_size).cast("int")})
    # Dealt by a hash column: a constant connector is folded out of the grouping, and by the keys themselves it would be shuffled again.
    rows = rows.withColumn("__deal", F.xxhash64("__conn", "__page")).repartition(shuffle_partitions(df), "__deal").withColumn("__rec", record)
    # Group totals ride along from the ordinal's block table, so no join
    # (which a constant connector id would turn into a cartesian product).
    pages = rows.groupBy("__deal", "__conn", "__page").agg(
        F.array_sort(F.collect_list(F.struct("__pos", "__rec"))).alias("__items"),
        F.first("__total").alias("__total")).drop("__deal").withColumnsRenamed({"__conn": "connector_id", "__page": "page_idx"})
    pages = pages.withColumn("__last", ((F.col("__total") - 1) / page_size).cast("int"))
    if empty_tail:
        tail = pages.filter(F.col("page_idx") == F.col("__last")).select(
            "connector_id", (F.col("__last") + 1).alias("page_idx"),
            F.expr("array()").cast(pages.schema["__items"].dataType).alias("__items"),
            "__total", "__last")
        pages = pages.unionByName(tail)
    items = F.array_join(F.transform("__items", lambda x: x["__rec"]), ",")
    arr = F.concat(F.lit("["), items, F.lit("]"))
    is_last = F.col("page_idx") >= F.col("__last")
    meta_parts = []
    if total:
        meta_parts.append(F.concat(F.lit('"total":'), F.col("__total").cast("string")))
    if cursor:
        nxt = F.when(is_last, F.lit("")).otherwise(
            F.concat(F.lit("c"), (F.col("page_idx") + 1).cast("string")))
        meta_parts.append(F.concat(F.lit('"next":"'), nxt, F.lit('"')))
        meta_parts.append(F.concat(F.lit('"hasMore":'), F.when(is_last, F.lit("false")).otherwise(F.lit("true"))))
    if root == "$":
        body = arr
    else:
        meta = F.concat(F.lit(',"meta":{'), F.concat_ws(",", *meta_parts), F.lit("}")) if meta_parts else F.lit("")
        body = F.concat(F.lit('{"' + root + '":'), arr, meta, F.lit("}"))
    if link:
        headers = F.when(~is_last, F.create_map(
            F.lit("Link"),
            F.concat(F.lit("<http://api.local/"), F.col("connector_id"), F.lit("?page="),
                     (F.col("page_idx") + 2).cast("string"), F.lit('>; rel="next"'))))
    else:
        headers = F.lit(None)
    headers = F.coalesce(headers, F.create_map().cast("map<string,string>"))
    return pages.select(
        F.col("connector_id"), F.lit(run_id).cast("bigint").alias("run_id"),
        F.col("page_idx").cast("int"), F.lit("page").alias("kind"),
        F.lit(200).alias("status"),
        (F.size("__items").cast("bigint") + 5).alias("duration_ms"),
        body.alias("body"), F.lit(False).alias("truncated"),
        F.length(body).cast("bigint").alias("body_length"),
        F.lit(None).cast("string").alias("error"), headers.alias("headers"),
    )


def event_record() -> Column:
    """Record JSON of an ``events`` row: ISO ``ts`` text, nested ``props``."""
    from sluice.functions.timefmt import iso_instant_text
    return F.to_json(F.struct(
        F.col("event_id"), iso_instant_text(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id"), F.col("event_type"), F.col("value"),
        F.parse_json("props").alias("props")), {"ignoreNullFields": "false"})


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_pages(spark, sf_dir: str, page_size: int = 100, per_user: bool = False,
                **kw) -> DataFrame:
    """Pages of the ``events`` table: one connector (``events``) or one per
    user (``user-<id>``), ordered by ``event_id``."""
    ev = read_table(spark, sf_dir, "events")
    conn = (F.concat(F.lit("user-"), F.col("user_id").cast("string")) if per_user
            else F.lit("events"))
    return land_pages(ev, conn, "event_id", event_record(), page_size=page_size, **kw)


def _pj(text: Column) -> Column:
    return F.parse_json(text)


def _q(text: Column) -> Column:
    return F.concat(F.lit('"'), text, F.lit('"'))


def event_record_rich() -> Column:
    """Record JSON of an ``events`` row with the value shapes real APIs send:
    the same instant in four formats and mixed, integers as text (padded,
    unparseable, null), booleans as text, ids numeric or text, an array."""
    from sluice.functions.timefmt import iso_instant_text
    ts = F.col("ts").cast("timestamp")
    eid, uid = F.col("event_id"), F.col("user_id")
    iso = iso_instant_text(ts)
    ms = F.unix_millis(ts).cast("string")
    dahua = F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")
    meiya = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    m5, m6, m4 = eid % 5, eid % 6, eid % 4
    ts_mixed = (F.when(m5 == 0, ms).when(m5 == 1, _q(iso)).when(m5 == 2, _q(dahua))
                 .when(m5 == 3, _q(meiya)).otherwise(_q(F.concat(F.lit("bad-"), eid.cast("string")))))
    qty = (F.when(m6 == 0, _q(uid.cast("string")))
            .when(m6 == 1, _q(F.concat(F.lit(" "), uid.cast("string"), F.lit(" "))))
            .when(m6 == 2, F.col("value").cast("string"))
            .when(m6 == 3, F.lit('"n/a"'))
            .when(m6 == 4, F.lit("null"))
            .otherwise(uid.cast("string")))
    flag = (F.when(m4 == 0, F.lit("true")).when(m4 == 1, F.lit('"TRUE"'))
             .when(m4 == 2, F.lit('"yes"')).otherwise(F.lit("false")))
    rid = F.when(uid % 10 == 0, _q(F.concat(F.lit("evt-"), F.lpad(eid.cast("string"), 6, "0")))) \
           .otherwise(eid.cast("string"))
    base = F.to_json(F.struct(
        eid.alias("event_id"), iso.alias("ts"), F.unix_millis(ts).alias("ts_ms"),
        dahua.alias("ts_dahua"), meiya.alias("ts_meiya"),
        uid.alias("user_id"), F.col("event_type"), F.col("value"),
        F.col("value").cast("string").alias("amount_text"),
        F.array(F.col("event_type")).alias("tags"),
        F.parse_json("props").alias("props")), {"ignoreNullFields": "false"})
    # Mixed-type fields are spliced in as raw JSON text so numbers keep the
    # exact notation (a VARIANT round trip would print 28.0 as 28).
    raw = F.concat(F.lit(',"ts_mixed":'), ts_mixed, F.lit(',"qty":'), qty,
                   F.lit(',"flag":'), flag, F.lit(',"rid":'), rid, F.lit("}"))
    return F.concat(F.regexp_replace(base, "}$", ""), raw)


def rich_event_pages(spark, sf_dir: str, page_size: int = 100, per_user: bool = False,
                     **kw) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    conn = (F.concat(F.lit("user-"), F.col("user_id").cast("string")) if per_user
            else F.lit("events"))
    return land_pages(ev, conn, "event_id", event_record_rich(), page_size=page_size, **kw)


# ---- derived connector / state tables ----------------------------------------

STATE_CUTOFF = "2024-01-15 00:00:00"


def prior_state(spark, sf_dir: str) -> DataFrame:
    """A previous run's connector_state per user connector: the last event
    time before the cutoff (a far-future value for every 7th user) and a
    last id (numeric for every 3rd user, text for every 10th)."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("ts") < F.lit(STATE_CUTOFF).cast("timestamp_ntz"))
    g = ev.groupBy("user_id").agg(F.max("ts").alias("mts"))
    uid = F.col("user_id")
    return g.select(
        F.concat(F.lit("user-"), uid.cast("string")).alias("connector_id"),
        F.when(uid % 7 == 0, F.lit("2024-03-01 00:00:00").cast("timestamp"))
         .otherwise(F.col("mts").cast("timestamp")).alias("ts"),
        F.when(uid % 10 == 0, F.concat(F.lit("evt-"), uid.cast("string")))
         .when(uid % 3 == 0, (uid * 50).cast("string")).alias("last_id"),
        "user_id")


def user_connectors(spark, sf_dir: str) -> DataFrame:
    """One connector per user with sync/incremental settings derived from the id."""
    uid = F.col("user_id")
    u = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return u.select(
        F.concat(F.lit("user-"), uid.cast("string")).alias("connector_id"), "user_id",
        F.when(uid % 4 == 0, "full").when(uid % 4 == 1, "incremental").when(uid % 4 == 2, "sample")
         .alias("sync_type"),
        (uid % 5 != 0).alias("inc_enabled"),
        F.when(uid % 3 == 0, "monotonic_id").otherwise("timestamp").alias("inc_mode"),
        F.when(uid % 2 == 0, "full").otherwise("incremental").alias("on_first_run"),
        F.when(uid % 6 == 0, F.concat((uid % 60).cast("string"), F.lit("s")))
         .when(uid % 6 == 1, F.concat(F.lit(" "), (uid % 60).cast("string"), F.lit("M ")))
         .when(uid % 6 == 2, F.concat((uid % 24).cast("string"), F.lit("h")))
         .when(uid % 6 == 3, F.lit(""))
         .when(uid % 6 == 4, F.concat((uid % 60).cast("string"), F.lit("d"))).alias("overlap"),
        F.when(uid % 4 == 0, "iso_instant").when(uid % 4 == 1, "epoch_ms")
         .when(uid % 4 == 2, "dahua_utc").otherwise("meiya_datetime").alias("time_format"),
        "n_events")


def customer_connectors(spark, sf_dir: str) -> DataFrame:
    """One paged connector per customer over its orders."""
    ck = F.col("o_custkey")
    o = read_table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return o.select(
        F.concat(F.lit("cust-"), ck.cast("string")).alias("connector_id"), ck.alias("custkey"),
        F.when(ck % 4 == 0, "offset_limit").otherwise("page_page_size").alias("strategy"),
        F.when(ck % 4 == 1, "skip_limit").alias("page_value_type"),
        (ck % 2).cast("int").alias("page_start"),
        (F.lit(5) + (ck % 3) * 5).cast("int").alias("page_size"),
        F.when(ck % 7 == 0, 2).otherwise(1000).alias("max_pages"),
        F.when(ck % 11 == 0, F.lit(None)).otherwise(F.col("n_orders")).cast("int").alias("total"),
        "n_orders")


def order_record() -> Column:
    return F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))


def order_pages(spark, sf_dir: str, page_size: int = 5, **kw) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    conn = F.concat(F.lit("cust-"), F.col("o_custkey").cast("string"))
    return land_pages(o, conn, "o_orderkey", order_record(), page_size=page_size, **kw)


def run_log(spark, sf_dir: str) -> DataFrame:
    """A ``job_run`` table derived from events: one run per event, the user
    as connector; errors failed, some signups still running/pending; the
    run lasts ``value`` seconds; records_ok = props.k."""
    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    status = (F.when(F.col("event_type") == "error", "failed")
               .when((F.col("event_type") == "signup") & (F.col("event_id") % 7 == 0), "running")
               .when((F.col("event_type") == "signup") & (F.col("event_id") % 11 == 0), "pending")
               .otherwise("success"))
    start = F.col("ts").cast("timestamp")
    fin = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("value").cast("decimal(18,6)"))
    return ev.select(
        F.col("event_id").alias("id"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("connector_id"),
        F.when(k % 3 == 0, "full").when(k % 3 == 1, "incremental").otherwise("sample").alias("run_type"),
        status.alias("status"), start.alias("started_at"),
        F.when(~status.isin("running", "pending"), fin).alias("finished_at"),
        k.alias("records_ok"), F.when(status == "failed", 1).otherwise(0).cast("bigint").alias("records_failed"),
        F.lit(None).cast("string").alias("error_message"))


def connector_versions(spark, sf_dir: str) -> DataFrame:
    """``connector_version`` rows from lineitem: one connector per order,
    line numbers as versions; finished lines are published, others drafts."""
    li = read_table(spark, sf_dir, "lineitem")
    pub = F.col("l_linestatus") == "F"
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("ord-"), F.col("l_orderkey").cast("string")).alias("connector_id"),
        F.when(pub, F.col("l_linenumber")).alias("version_number"),
        F.when(pub, "published").otherwise("draft").alias("status"),
        F.to_json(F.struct("l_partkey", "l_quantity")).alias("config_json"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"))


def order_connectors(spark, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("ord-"), F.col("o_orderkey").cast("string")).alias("connector_id"),
                    F.col("o_orderpriority").alias("name"), F.lit("pull").alias("mode"),
                    F.col("o_orderdate").cast("timestamp").alias("updated_at"), "o_orderkey")


# ---- push requests -------------------------------------------------------------

def push_requests(spark, sf_dir: str) -> DataFrame:
    """One pushed request per event (PUSH_SCHEMA rows): connector
    ``push-<user mod 4>``; EventID blank for every 50th event, repeated
    (the previous event's id) for every 10th+1; a wrong sign for every 13th;
    ``ImageUrl`` instead of ``ImgUrl`` for every 4th; a non-numeric
    EventType for every 37th."""
    ev = dealt(read_table(spark, sf_dir, "events"), "event_id")
    eid, uid = F.col("event_id"), F.col("user_id")
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    event_id = (F.when(eid % 50 == 0, F.lit(""))
                 .when(eid % 10 == 1, F.concat(F.lit("EVT-"), (eid - 1).cast("string")))
                 .otherwise(F.concat(F.lit("EVT-"), eid.cast("string"))))
    img = F.concat(F.lit("http://img.local/"), eid.cast("string"), F.lit(".jpg"))
    etype = F.when(eid % 37 == 0, F.lit('"x"')).otherwise((uid % 5).cast("string"))
    body = F.concat(
        F.lit('{"EventID":'), F.to_json(F.array(event_id)).substr(F.lit(2), F.length(F.to_json(F.array(event_id))) - 2),
        F.lit(',"EventType":'), etype,
        F.lit(',"EventName":"'), F.col("event_type"), F.lit('"'),
        F.lit(',"SendTime":"'), ts, F.lit('","CameraID":"cam-'), uid.cast("string"), F.lit('"'),
        F.when(eid % 4 == 0, F.concat(F.lit(',"ImageUrl":"'), img, F.lit('"')))
         .otherwise(F.concat(F.lit(',"ImgUrl":"'), img, F.lit('"'))),
        F.lit(',"EventTime":"'), ts, F.lit('","Confidence":'), F.round(F.col("value") / 500, 4).cast("string"),
        F.lit(',"TaskID":"task-'), (eid % 7).cast("string"), F.lit('"}'))
    sign = F.when(eid % 13 == 0, F.lit("BAD")).otherwise(
        F.lower(F.md5(F.concat(F.lit("ivsp_"), event_id))))
    return ev.select(F.concat(F.lit("push-"), (uid % 4).cast("string")).alias("connector_id"),
                     F.concat(F.lit("req-"), eid.cast("string")).alias("request_id"),
                     sign.alias("sign"), eid.alias("seq"), body.alias("body"))


def push_connectors(spark, sf_dir: str) -> DataFrame:
    """The push connectors referenced by ``push_requests`` (latest published
    versions), one row each."""
    ev = read_table(spark, sf_dir, "events")
    k = (F.col("user_id") % 4).cast("int")
    g = ev.select(k.alias("k")).distinct()
    return g.select(F.concat(F.lit("push-"), F.col("k").cast("string")).alias("connector_id"),
                    F.when(F.col("k") == 1, "both").when(F.col("k") == 3, "pull").otherwise("push").alias("mode"),
                    F.lit(True).alias("published"), (F.col("k") != 2).alias("webhook_enabled"),
                    (F.col("k") == 0).alias("verify_sign"), F.lit("ivsp").alias("plat_flag"))


def jstr(c: Column) -> Column:
    """JSON string literal text of a column (quoted and escaped)."""
    a = F.to_json(F.array(c))
    return a.substr(F.lit(2), F.length(a) - 2)


def part_specs(spec_rows: DataFrame) -> DataFrame:
    """One API description document per ``part`` row (OpenAPI 3 for even
    keys, Swagger 2 for odd ones): ``GET /parts/<key>`` with pagination
    parameters chosen by size, plus ``POST`` for large parts."""
    k = F.col("p_partkey").cast("string")
    size = F.col("p_size")
    slug = F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    server = F.when(F.col("p_partkey") % 2 == 0, F.concat(
        F.lit('"openapi":"3.0.1","servers":[{"url":"http://api.local/'), slug, F.lit('/"}]'))).otherwise(F.concat(
        F.lit('"swagger":"2.0","host":"api.local","basePath":"/'), slug, F.lit('","schemes":["https"]')))
    opid = F.when(size % 3 == 0, F.concat(F.lit('"operationId":"getPart'), k, F.lit('",'))).otherwise(F.lit(""))
    summ = F.when(size % 2 == 0, F.concat(F.lit('"summary":'), jstr(F.col("p_name")), F.lit(","))).otherwise(F.lit(""))
    params = (F.when(size % 4 == 0, F.lit('{"name":"offset","in":"query","schema":{"type":"integer","format":"int32"}},'
                                          '{"name":"Limit","in":"query","schema":{"type":"integer"}}'))
               .when(size % 4 == 1, F.lit('{"name":"Page-Token","in":"query","schema":{"type":"string"}},'
                                          '{"name":"page_size","in":"query","type":"integer"}'))
               .when(size % 4 == 2, F.lit('{"name":"page","in":"query","schema":{"type":"integer"}},'
                                          '{"name":"per-page","in":"query","schema":{"type":"number","format":"float"}}'))
               .otherwise(F.lit("")))
    post = F.when(size > 25, F.concat(F.lit(',"post":{"description":'),
                                      jstr(F.concat(F.lit("create "), F.col("p_name"))), F.lit("}"))).otherwise(F.lit(""))
    doc = F.concat(F.lit("{"), server, F.lit(',"paths":{"/parts/'), k,
                   F.lit('":{"parameters":[{"name":"X-Tenant","in":"header"}],"get":{'), opid, summ,
                   F.lit('"description":'), jstr(F.col("p_type")), F.lit(',"parameters":['), params, F.lit("]}"),
                   post, F.lit("}}}"))
    return dealt(spec_rows, "p_partkey").select(F.col("p_partkey").alias("spec_id"), doc.alias("doc"))


def read_pages(spark, path: str, fmt: str = "parquet", connectors: Sequence[str] | None = None,
               kind: str | None = None) -> DataFrame:
    """Landed page folders as a batch table. The schema is given, so no
    file is read to infer it; connector and kind filters reach the scan."""
    pages = spark.read.schema(PAGES_SCHEMA).format(fmt).load(path)
    if connectors is not None:
        pages = pages.filter(F.col("connector_id").isin(list(connectors)))
    return pages if kind is None else pages.filter(F.col("kind") == kind)


def read_versions(spark, path: str) -> DataFrame:
    """Connector versions (connector_id, version_number, status, config)."""
    return spark.read.schema("connector_id string, version_number int, status string, config string").parquet(path)
