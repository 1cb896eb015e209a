"""Registered queries for record extraction (X) and transforms (T)."""
from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions import jsonpath as J
from sluice.functions.timefmt import iso_instant_text
from sluice.operators import extract as X
from sluice.operators import transform as T
from sluice.plans.registered import iso_ts, register
from sluice.sources.landed import land_pages, read_table, rich_event_pages

# DuckDB: events with the landing order of `rich_event_pages` (one connector,
# 100 per page) or per user (`user-<id>`, 10 per page).
RICH = ("(SELECT e.*, row_number() OVER (ORDER BY event_id) - 1 AS rn, "
        "event_id % 6 AS m6, event_id % 5 AS m5, event_id % 4 AS m4 FROM events e)")
RICH_U = ("(SELECT e.*, 'user-' || CAST(user_id AS VARCHAR) AS connector_id, "
          "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn, "
          "event_id % 6 AS m6 FROM events e)")


def _recs(spark, sf, per_user=False, page_size=None):
    ps = page_size or (10 if per_user else 100)
    return X.extract_records(rich_event_pages(spark, sf, page_size=ps, per_user=per_user), "$.data")


def _get(path, typ="bigint"):
    return F.try_variant_get(F.col("rec"), path, typ)


@register("x1_extract_records", f"""
SELECT connector_id, CAST(rn // 10 AS INTEGER) AS page_idx, CAST(rn % 10 AS INTEGER) AS pos, event_id
FROM {RICH_U}""")
def x1_extract_records(spark, sf):
    r = _recs(spark, sf, per_user=True)
    return r.select("connector_id", "page_idx", "pos", _get("$.event_id").alias("event_id"))


@register("x2_read_value", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events""")
def x2_read_value(spark, sf):
    r = _recs(spark, sf)
    return r.select(_get("$.event_id").alias("event_id"), J.vget("rec", "props.k", "bigint").alias("k"),
                    J.vget("rec", "event_type", "string").alias("event_type"))


@register("x3_read_integer", f"""
SELECT event_id, CASE m6 WHEN 0 THEN CAST(user_id AS INTEGER) WHEN 2 THEN CAST(trunc(value) AS INTEGER)
  WHEN 5 THEN CAST(user_id AS INTEGER) END AS qty_int FROM {RICH}""")
def x3_read_integer(spark, sf):
    r = _recs(spark, sf)
    return r.select(_get("$.event_id").alias("event_id"), J.read_integer("rec", "$.qty").alias("qty_int"))


@register("x4_read_string", f"""
SELECT event_id,
  CASE m6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN ' ' || CAST(user_id AS VARCHAR) || ' '
    WHEN 2 THEN CAST(value AS VARCHAR) WHEN 3 THEN 'n/a' WHEN 4 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS qty_text,
  replace(props, ' ', '') AS props_text
FROM {RICH}""")
def x4_read_string(spark, sf):
    r = _recs(spark, sf)
    return r.select(_get("$.event_id").alias("event_id"), J.read_string("rec", "$.qty").alias("qty_text"),
                    J.read_string("rec", "props").alias("props_text"))


@register("x5_read_boolean", f"""
SELECT event_id, m4 IN (0, 1) AS flag, CAST(NULL AS BOOLEAN) AS missing FROM {RICH}""")
def x5_read_boolean(spark, sf):
    r = _recs(spark, sf)
    return r.select(_get("$.event_id").alias("event_id"), J.read_boolean("rec", "$.flag").alias("flag"),
                    J.read_boolean("rec", "$.no_such_field").alias("missing"))


@register("x6_read_instant", f"""
SELECT event_id, {iso_ts("CASE m5 WHEN 0 THEN make_timestamp((epoch_us(ts) // 1000) * 1000) WHEN 1 THEN ts WHEN 2 THEN date_trunc('second', ts) WHEN 3 THEN date_trunc('second', ts) END")} AS instant
FROM {RICH}""")
def x6_read_instant(spark, sf):
    r = _recs(spark, sf)
    return r.select(_get("$.event_id").alias("event_id"),
                    iso_instant_text(J.read_instant("rec", "$.ts_mixed")).alias("instant"))


@register("x7_read_monotonic_id", """
SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'evt-' || lpad(CAST(event_id AS VARCHAR), 6, '0')
  ELSE CAST(event_id AS VARCHAR) END AS mono_id FROM events""")
def x7_read_monotonic_id(spark, sf):
    r = _recs(spark, sf)
    return r.select(_get("$.event_id").alias("event_id"), J.read_monotonic_id("rec", "$.rid").alias("mono_id"))


_X8_SAMPLES = f"""
SELECT '$.event_id' AS path, CAST(event_id AS VARCHAR) AS s FROM {RICH}
UNION ALL SELECT '$.ts', {iso_ts('ts')} FROM {RICH}
UNION ALL SELECT '$.ts_ms', CAST((epoch_us(ts) // 1000) AS VARCHAR) FROM {RICH}
UNION ALL SELECT '$.ts_dahua', strftime(ts, '%Y%m%dT%H%M%SZ') FROM {RICH}
UNION ALL SELECT '$.ts_meiya', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM {RICH}
UNION ALL SELECT '$.ts_mixed', CASE m5 WHEN 0 THEN CAST((epoch_us(ts) // 1000) AS VARCHAR) WHEN 1 THEN {iso_ts('ts')}
  WHEN 2 THEN strftime(ts, '%Y%m%dT%H%M%SZ') WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  ELSE 'bad-' || CAST(event_id AS VARCHAR) END FROM {RICH}
UNION ALL SELECT '$.user_id', CAST(user_id AS VARCHAR) FROM {RICH}
UNION ALL SELECT '$.event_type', event_type FROM {RICH}
UNION ALL SELECT '$.value', CAST(value AS VARCHAR) FROM {RICH}
UNION ALL SELECT '$.amount_text', CAST(value AS VARCHAR) FROM {RICH}
UNION ALL SELECT '$.qty', CASE m6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN ' ' || CAST(user_id AS VARCHAR) || ' '
  WHEN 2 THEN CAST(value AS VARCHAR) WHEN 3 THEN 'n/a' WHEN 4 THEN 'null' ELSE CAST(user_id AS VARCHAR) END FROM {RICH}
UNION ALL SELECT '$.flag', CASE m4 WHEN 0 THEN 'true' WHEN 1 THEN 'TRUE' WHEN 2 THEN 'yes' ELSE 'false' END FROM {RICH}
UNION ALL SELECT '$.rid', CASE WHEN user_id % 10 = 0 THEN 'evt-' || lpad(CAST(event_id AS VARCHAR), 6, '0')
  ELSE CAST(event_id AS VARCHAR) END FROM {RICH}
UNION ALL SELECT '$.tags', NULL FROM {RICH}
UNION ALL SELECT '$.tags[*]', event_type FROM {RICH}
UNION ALL SELECT '$.props', NULL FROM {RICH}
UNION ALL SELECT '$.props.k', CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) FROM {RICH}
"""


@register("x8_path_catalogue", f"""
SELECT path, count(*) AS n_records, min(s) AS sample FROM ({_X8_SAMPLES}) GROUP BY path""")
def x8_path_catalogue(spark, sf):
    return X.path_catalogue(_recs(spark, sf))


@register("x9_non_object_records", """
SELECT CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 AS INTEGER) AS page_idx,
       CAST((row_number() OVER (ORDER BY event_id) - 1) % 100 AS INTEGER) AS pos, event_id AS value
FROM events""")
def x9_non_object_records(spark, sf):
    ev = read_table(spark, sf, "events")
    pages = land_pages(ev, F.lit("ids"), "event_id", F.col("event_id").cast("string"), root="$")
    r = X.extract_records(pages, "$")
    return r.select("page_idx", "pos",
                    F.try_variant_get(X.as_object("rec"), "$.value", "bigint").alias("value"))


@register("x10_record_index", f"""
SELECT connector_id, event_id, rn AS record_index FROM {RICH_U}""")
def x10_record_index(spark, sf):
    r = X.with_record_index(_recs(spark, sf, per_user=True))
    return r.select("connector_id", _get("$.event_id").alias("event_id"), "record_index")


def _rows(spark, sf, steps, per_user=False):
    res = T.transform(_recs(spark, sf, per_user), steps)
    return res


@register("t1_filter", """
SELECT event_id FROM events WHERE value > 250 AND event_type IN ('click', 'view')""")
def t1_filter(spark, sf):
    steps = [{"type": "filter",
              "condition": "${record.value:double} > 250 AND ${record.event_type} IN ('click', 'view')"}]
    rows = _rows(spark, sf, steps).rows
    return rows.select(_get("$.event_id").alias("event_id"))


T2_MAPPINGS = [
    {"source": "$.event_id", "target": "event_id", "type": "long"},
    {"source": "user_id", "target": "user_id", "type": "long"},
    {"source": "$.value", "target": "value", "type": "double"},
    {"source": "$.amount_text", "target": "amount", "type": "decimal", "scale": 2},
    {"source": "$.flag", "target": "flag", "type": "boolean"},
    {"source": "$.ts", "target": "ts", "type": "datetime", "target_format": "dahua_utc"},
    {"source": "$.event_type", "target": "etype", "type": "string"},
]


@register("t2_map_fields", f"""
SELECT event_id, user_id, value, CAST(value AS DECIMAL(38,2)) AS amount, m4 IN (0, 1) AS flag,
  strftime(ts, '%Y%m%dT%H%M%SZ') AS ts, event_type AS etype FROM {RICH}""")
def t2_map_fields(spark, sf):
    rows = _rows(spark, sf, [{"type": "map_fields", "mappings": T2_MAPPINGS}]).rows
    return rows.drop("connector_id", "run_id", "page_idx", "pos")


@register("t3_identity_map", """
SELECT event_id, 15 AS n_fields FROM events""")
def t3_identity_map(spark, sf):
    rows = _rows(spark, sf, [{"type": "map_fields", "mappings": []}]).rows
    return rows.select(_get("$.event_id").alias("event_id"),
                       F.size(F.map_keys(F.try_variant_get("rec", "$", "map<string,variant>"))).alias("n_fields"))


@register("t4_expression", """
SELECT event_id, round(value * 2, 2) AS amount, upper(event_type) AS kind, value * 2 > 500 AS big FROM events""")
def t4_expression(spark, sf):
    steps = [
        {"type": "map_fields", "mappings": [
            {"source": "event_id", "target": "event_id", "type": "long"},
            {"source": "value", "target": "value", "type": "double"},
            {"source": "event_type", "target": "event_type", "type": "string"}]},
        {"type": "expression", "expressions": [
            ("amount", "round(${record.value} * 2, 2)"),
            ("kind", "upper(event_type)"),
            ("big", "amount > 500")]},
    ]
    return _rows(spark, sf, steps).rows.select("event_id", "amount", "kind", "big")


@register("t5_expression_operators", """
SELECT event_id, CASE WHEN value > 300 AND event_type <> 'error' THEN upper(event_type) || '-' || CAST(user_id AS VARCHAR) ELSE 'none' END AS label,
  user_id % 7 IN (1, 2) AS picked, CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 50 AS mid FROM events""")
def t5_expression_operators(spark, sf):
    """Allowed operators and functions over record placeholders, nested ones too."""
    steps = [{"type": "expression", "expressions": [
        ("label", "case when ${record.value:double} > 300 and ${record.event_type} <> 'error' then upper(${record.event_type}) || '-' || ${record.user_id} else 'none' end"),
        ("picked", "${record.user_id:bigint} % 7 in (1, 2)"), ("mid", "${record.props.k:bigint} between 10 and 50")]}]
    return _rows(spark, sf, steps).rows.select(_get("$.event_id").alias("event_id"), "label", "picked", "mid")


@register("t16_strict_run", """
SELECT event_id, user_id, value FROM events WHERE event_type <> 'error'""")
def t16_strict_run(spark, sf):
    """A strict run in which every record converts gives all rows (a bad one raises: see the unit tests)."""
    steps = [{"type": "filter", "condition": "${record.event_type} <> 'error'"}, {"type": "map_fields", "mappings": T2_MAPPINGS[:3]}]
    recs = X.extract_records(rich_event_pages(spark, sf), "$.data")
    return T.transform_strict(recs, steps).select("event_id", "user_id", "value")


@register("t18_cut_samples", """
SELECT user_id, least(2000, length('{"name":"","user_id":' || CAST(user_id AS VARCHAR) || '}') + 5 * sum(length(event_type))) AS n_chars
FROM events GROUP BY user_id""")
def t18_cut_samples(spark, sf):
    """Error samples of records of very different length: cut at 2000 characters."""
    ev = read_table(spark, sf, "events")
    long = ev.groupBy("user_id").agg(F.sum(5 * F.length("event_type")).cast("int").alias("n"))
    rec = F.concat(F.lit('{"name":"'), F.repeat(F.lit("x"), F.col("n")), F.lit('","user_id":'), F.col("user_id").cast("string"), F.lit("}"))
    recs = X.extract_records(land_pages(long, F.concat(F.lit("u"), F.col("user_id").cast("string")), "user_id", rec), "$.data")
    bad = T.transform(recs, [{"type": "map_fields", "mappings": [{"source": "$.name", "target": "name", "type": "long"}]}], max_errors=None).errors
    return bad.select(F.substring("connector_id", 2, 20).cast("bigint").alias("user_id"), F.length("sample_json").alias("n_chars"))


T7_STEPS = [
    {"type": "filter", "condition": "${record.event_type} <> 'error'"},
    {"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"},
        {"source": "$.user_id", "target": "user_id", "type": "long"},
        {"source": "$.value", "target": "value", "type": "double"},
        {"source": "$.props.k", "target": "k", "type": "long"}]},
    {"type": "expression", "expressions": {"score": "round(value * k, 2)"}},
    {"type": "no_such_step"},
    {"type": "filter", "condition": "score > 1000"},
]


@register("t7_step_chain", """
SELECT event_id, user_id, round(value * CAST(json_extract(props, '$.k') AS BIGINT), 2) AS score FROM events
WHERE event_type <> 'error' AND round(value * CAST(json_extract(props, '$.k') AS BIGINT), 2) > 1000""")
def t7_step_chain(spark, sf):
    return _rows(spark, sf, T7_STEPS).rows.select("event_id", "user_id", "score")


def _one_mapping(spark, sf, m, per_user=False):
    steps = [{"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"}, m]}]
    return _rows(spark, sf, steps, per_user)


@register("t8_cast_long", f"""
SELECT event_id, CASE m6 WHEN 0 THEN user_id WHEN 2 THEN CAST(trunc(value) AS BIGINT) WHEN 5 THEN user_id END AS qty
FROM {RICH} WHERE m6 NOT IN (1, 3)""")
def t8_cast_long(spark, sf):
    return _one_mapping(spark, sf, {"source": "$.qty", "target": "qty", "type": "long"}).rows \
        .select("event_id", "qty")


@register("t9_cast_double", f"""
SELECT event_id, CASE m6 WHEN 0 THEN CAST(user_id AS DOUBLE) WHEN 1 THEN CAST(user_id AS DOUBLE)
  WHEN 2 THEN value WHEN 5 THEN CAST(user_id AS DOUBLE) END AS qty
FROM {RICH} WHERE m6 <> 3""")
def t9_cast_double(spark, sf):
    return _one_mapping(spark, sf, {"source": "$.qty", "target": "qty", "type": "double"}).rows \
        .select("event_id", "qty")


@register("t10_cast_boolean", f"""
SELECT event_id, m4 IN (0, 1) AS flag, CASE WHEN m6 = 4 THEN NULL ELSE false END AS qty_flag FROM {RICH}""")
def t10_cast_boolean(spark, sf):
    steps = [{"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"},
        {"source": "$.flag", "target": "flag", "type": "boolean"},
        {"source": "$.qty", "target": "qty_flag", "type": "boolean"}]}]
    return _rows(spark, sf, steps).rows.select("event_id", "flag", "qty_flag")


@register("t11_cast_decimal", f"""
SELECT event_id, CASE m6 WHEN 0 THEN CAST(user_id AS DECIMAL(38,2)) WHEN 2 THEN CAST(value AS DECIMAL(38,2))
  WHEN 5 THEN CAST(user_id AS DECIMAL(38,2)) END AS qty
FROM {RICH} WHERE m6 NOT IN (1, 3)""")
def t11_cast_decimal(spark, sf):
    return _one_mapping(spark, sf, {"source": "$.qty", "target": "qty", "type": "decimal", "scale": 2}).rows \
        .select("event_id", "qty")


@register("t12_cast_string", f"""
SELECT event_id,
  CASE m6 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN ' ' || CAST(user_id AS VARCHAR) || ' '
    WHEN 2 THEN CAST(value AS VARCHAR) WHEN 3 THEN 'n/a' WHEN 4 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS qty,
  replace(props, ' ', '') AS props, CAST(user_id AS VARCHAR) AS uid
FROM {RICH}""")
def t12_cast_string(spark, sf):
    steps = [{"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"},
        {"source": "$.qty", "target": "qty", "type": "string"},
        {"source": "$.props", "target": "props"},
        {"source": "$.user_id", "target": "uid", "type": "no_such_type"}]}]
    return _rows(spark, sf, steps).rows.select("event_id", "qty", "props", "uid")


@register("t13_datetime_parse", """
SELECT event_id, CAST((epoch_us(date_trunc('second', ts)) // 1000) AS VARCHAR) AS ts_ms,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_ms FROM events""")
def t13_datetime_parse(spark, sf):
    steps = [{"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"},
        {"source": "$.ts_meiya", "target": "ts_ms", "type": "datetime",
         "source_format": "meiya_datetime", "target_format": "epoch_ms"},
        {"source": "$.ts_ms", "target": "from_ms", "type": "datetime",
         "source_format": "dahua_utc", "target_format": "meiya_datetime"}]}]
    return _rows(spark, sf, steps).rows.select("event_id", "ts_ms", "from_ms")


@register("t14_datetime_format", f"""
SELECT event_id, {iso_ts('ts')} AS iso, strftime(ts, '%Y%m%dT%H%M%SZ') AS dahua,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS meiya, CAST((epoch_us(ts) // 1000) AS VARCHAR) AS ms FROM events""")
def t14_datetime_format(spark, sf):
    maps = [{"source": "$.event_id", "target": "event_id", "type": "long"}]
    for tgt, fmt in (("iso", None), ("dahua", "dahua_utc"), ("meiya", "meiya_datetime"), ("ms", "epoch_ms")):
        maps.append({"source": "$.ts", "target": tgt, "type": "datetime", "target_format": fmt})
    return _rows(spark, sf, [{"type": "map_fields", "mappings": maps}]).rows \
        .select("event_id", "iso", "dahua", "meiya", "ms")


@register("t15_datetime_passthrough", f"""
SELECT event_id, CASE m5 WHEN 0 THEN strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN {iso_ts('ts')} WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
  WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'bad-' || CAST(event_id AS VARCHAR) END AS t
FROM {RICH}""")
def t15_datetime_passthrough(spark, sf):
    m = {"source": "$.ts_mixed", "target": "t", "type": "datetime",
         "source_format": "dahua_utc", "target_format": "meiya_datetime"}
    return _one_mapping(spark, sf, m).rows.select("event_id", "t")


@register("t17_tolerant_errors", f"""
SELECT connector_id, record_index, message FROM (
  SELECT connector_id, rn AS record_index,
    'cannot convert field ''qty'' to long: ' || CASE m6 WHEN 1 THEN ' ' || CAST(user_id AS VARCHAR) || ' ' ELSE 'n/a' END AS message,
    row_number() OVER (PARTITION BY connector_id ORDER BY rn) AS k
  FROM {RICH_U} WHERE m6 IN (1, 3)) WHERE k <= 20""")
def t17_tolerant_errors(spark, sf):
    res = _one_mapping(spark, sf, {"source": "$.qty", "target": "qty", "type": "long"}, per_user=True)
    return res.errors.select("connector_id", "record_index", "message")


@register("t17_tolerant_error_counts", f"""
SELECT connector_id, count(*) AS records_failed FROM {RICH_U} WHERE m6 IN (1, 3) GROUP BY connector_id""")
def t17_tolerant_error_counts(spark, sf):
    """Quirk 2: the true failed count per run (samples stay capped)."""
    recs = _recs(spark, sf, per_user=True)
    steps = [{"type": "map_fields", "mappings": [{"source": "$.qty", "target": "qty", "type": "long"}]}]
    res = T.transform(recs, steps, max_errors=None)
    return res.errors.groupBy("connector_id").agg(F.count(F.lit(1)).alias("records_failed"))


@register("t19_preview", f"""
SELECT connector_id, event_id, event_type FROM {RICH_U} WHERE rn < 10""")
def t19_preview(spark, sf):
    steps = [{"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"},
        {"source": "$.event_type", "target": "event_type", "type": "string"}]}]
    return T.preview(_recs(spark, sf, per_user=True), steps, limit=10) \
        .select("connector_id", "event_id", "event_type")


@register("g5_record_limit", f"""
SELECT connector_id, event_id FROM {RICH_U} WHERE rn < 25""")
def g5_record_limit(spark, sf):
    r = T.limit_records(_recs(spark, sf, per_user=True), 25)
    return r.select("connector_id", _get("$.event_id").alias("event_id"))
