"""Golden values that pin single rules (overlap, formats, signature, windows; FIXTURES.md §6)."""
from pyspark.sql import functions as F

from tests.conftest import one_body_records


def test_overlap_param_formats(spark):
    from sluice.operators.requests import timestamp_param
    df = spark.sql("select timestamp'2025-06-01 08:30:00' ts, '5m' ov")
    got = df.select(timestamp_param(F.col("ts"), F.col("ov"), None).alias("a"),
                    timestamp_param(F.col("ts"), F.col("ov"), "dahua_utc").alias("b"),
                    timestamp_param(F.col("ts"), F.col("ov"), "meiya_datetime").alias("c")).first()
    assert tuple(got) == ("2025-06-01T08:25:00Z", "20250601T082500Z", "2025-06-01 08:25:00")


def test_rolling_window_start(spark):
    from sluice.operators.watermark import rolling_window
    prev = spark.sql("select 'c' connector_id, timestamp'2025-06-01 10:00:00' ts")
    r = rolling_window(prev, "5m", "2025-06-01 12:00:00").first()
    assert str(r["start"]) == "2025-06-01 09:55:00"
    assert str(r["end"]) == "2025-06-01 12:01:00"


def test_skip_limit_in_body(spark):
    from sluice.operators.requests import plan_pages
    c = spark.createDataFrame([("c", "page_page_size", "skip_limit", 1, 50, 1000, 500)],
                              "connector_id string, strategy string, page_value_type string, page_start int, "
                              "page_size int, max_pages int, total int")
    row = plan_pages(c).filter("page = 2").first()
    assert (row["page_param_value"], row["limit"]) == (50, 50)


def test_monotonic_max(spark):
    from sluice.operators.watermark import advance_monotonic
    recs = one_body_records(spark, '{"data":[{"id":1},{"id":5},{"id":3}]}')
    assert advance_monotonic(recs, "$.id").first()["last_id"] == "5"


def test_tolerant_skip_with_index(spark):
    from sluice.operators.transform import transform
    recs = one_body_records(spark, '{"data":[{"id":1},{"id":"bad"}]}')
    res = transform(recs, [{"type": "map_fields", "mappings": [{"source": "$.id", "target": "id", "type": "long"}]}])
    assert [r["id"] for r in res.rows.collect()] == [1]
    errs = res.errors.collect()
    assert len(errs) == 1 and errs[0]["record_index"] == 1
    assert errs[0]["sample_json"] == '{"id":"bad"}'


def test_datetime_dahua_to_iso(spark):
    from sluice.operators.transform import transform
    recs = one_body_records(spark, '{"data":[{"t":"20250601T080000Z"}]}')
    m = [{"source": "t", "target": "t", "type": "datetime", "source_format": "dahua_utc"}]
    assert transform(recs, [{"type": "map_fields", "mappings": m}]).rows.first()["t"] == "2025-06-01T08:00:00Z"


def test_cursor_stop_rules(spark):
    from sluice.operators.paging import cursor_stop
    bodies = ['{"data":[{"id":1}],"meta":{"next":"","hasMore":true}}',
              '{"data":[{"id":1}],"meta":{"next":"c2","hasMore":false}}',
              '{"data":[],"meta":{"next":"c2","hasMore":true}}',
              '{"data":[{"id":1}],"meta":{"next":"c2","hasMore":true}}',
              '{"data":[{"id":1}],"meta":{"next":"c2"}}']
    pages = spark.createDataFrame([("c", 1, i, "page", b, {}) for i, b in enumerate(bodies)],
                                  "connector_id string, run_id bigint, page_idx int, kind string, body string, "
                                  "headers map<string,string>")
    got = [r["stop"] for r in cursor_stop(pages, "$.data", "$.meta.next", "$.meta.hasMore")
           .orderBy("page_idx").collect()]
    assert got == [True, True, True, False, False]


def test_detect_record_array(spark):
    from sluice.operators.infer import detect_record_array
    body = '{"version":"2.0","code":1,"data":[{"a":1}],"states":{"total":1,"rows":[{"x":1}]},"msg":"ok"}'
    df = spark.createDataFrame([(body,)], "body string")
    assert detect_record_array(df).first()["record_path"] == "$.data"
    body2 = '{"meta":{"items":[{"a":1}]},"rows":[{"b":2}]}'
    df2 = spark.createDataFrame([(body2,)], "body string")
    assert detect_record_array(df2).first()["record_path"] == "$.meta.items"


def test_sign_golden(spark):
    from sluice.streaming.push import sign_of, sign_ok
    r = spark.sql("select 'ivsp' p, 'UUID00001' e").select(
        sign_of(F.col("p"), F.col("e")).alias("s"),
        sign_ok(F.col("p"), F.col("e"), F.lit(" cb0498dc24b6898ee2248257ecd4a01c ")).alias("ok")).first()
    assert r["s"] == "CB0498DC24B6898EE2248257ECD4A01C" and r["ok"]
