"""Semantic cases per operator family, values asserted."""
import pytest
from pyspark.sql import functions as F

from tests.conftest import one_body_records


def test_extract_shapes(spark):
    from sluice.operators.extract import as_object
    assert one_body_records(spark, '[{"a":1},{"a":2}]', "$").count() == 2
    assert one_body_records(spark, '{"data":{"a":1}}').count() == 1        # object -> one record
    assert one_body_records(spark, '{"data":null}').count() == 0
    assert one_body_records(spark, "   ").count() == 0
    assert one_body_records(spark, "<html>").count() == 0
    r = one_body_records(spark, "[7]", "$[*]").select(
        F.try_variant_get(as_object("rec"), "$.value", "int").alias("v")).first()
    assert r["v"] == 7


def test_casts_follow_java_rules(spark):
    from sluice.operators.transform import transform
    recs = one_body_records(spark, '{"data":[{"v":" 12 "},{"v":"2.7"},{"v":2.7},{"v":"yes"},{"v":"TRUE"},'
                                   '{"v":"1e5"},{"v":null}]}')
    def conv(t, **kw):
        m = [{"source": "v", "target": "x", "type": t, **kw}]
        res = transform(recs, [{"type": "map_fields", "mappings": m}], max_errors=None)
        return ([r["x"] for r in res.rows.orderBy("pos").collect()],
                sorted(r["record_index"] for r in res.errors.collect()))
    vals, errs = conv("long")
    assert vals == [2, None] and errs == [0, 1, 3, 4, 5]
    vals, errs = conv("boolean")
    assert vals == [False, False, False, False, True, False, None] and errs == []
    vals, errs = conv("double")
    assert vals == [12.0, 2.7, 2.7, 100000.0, None] and errs == [3, 4]
    vals, errs = conv("string")
    assert vals == [" 12 ", "2.7", "2.7", "yes", "TRUE", "1e5", None]


def test_strict_mode_raises_first_index(spark):
    """Building the plan runs nothing; reading it fails with the first bad record, even when all are bad."""
    from sluice.operators.transform import transform_strict
    steps = [{"type": "map_fields", "mappings": [{"source": "id", "target": "id", "type": "long"}]}]
    plan = transform_strict(one_body_records(spark, '{"data":[{"id":1},{"id":"x"},{"id":"y"}]}'), steps)
    with pytest.raises(Exception, match="strict transform failed: record 1: "):
        plan.collect()
    with pytest.raises(Exception, match="record 0: "):
        transform_strict(one_body_records(spark, '{"data":[{"id":"x"}]}'), steps).count()
    fine = transform_strict(one_body_records(spark, '{"data":[{"id":1},{"id":2}]}'), steps)
    assert sorted(r["id"] for r in fine.collect()) == [1, 2]


def test_strict_rows_of_one_connector_are_not_joined(spark):
    """With constant run keys a full join of the rows is a nested loop, for which the driver broadcasts them all."""
    from sluice.operators.extract import extract_records
    from sluice.operators.transform import transform_strict
    from sluice.sources.landed import land_pages
    steps = [{"type": "map_fields", "mappings": [{"source": "id", "target": "id", "type": "long"}]}]

    def run(record):
        return transform_strict(extract_records(land_pages(spark.range(250), F.lit("one"), "id", record), "$.data"), steps)
    fine = run(F.to_json(F.struct("id")))
    assert "FullOuter" not in fine._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["id"] for r in fine.collect()) == list(range(250))
    bad = run(F.to_json(F.struct(F.when(F.col("id") >= 207, F.lit("x")).otherwise(F.col("id").cast("string")).alias("id"))))
    for read in (bad.limit(1), bad.filter("id = 3"), bad.select(F.lit(1))):
        with pytest.raises(Exception, match="strict transform failed: record 207: "):
            read.collect()


@pytest.mark.parametrize("text", [
    "reflect('java.lang.System', 'exit', 0)", "(select 1)", "`reflect`('java.lang.Math','abs',-3)", "reflect/**/('java.lang.Math','abs',-3)",
    "current_timestamp", "unix_timestamp()", "JAVA_METHOD('java.lang.Math','abs',-3)", "a in (select 1)", "exists(select 1)", "uuid()", "rand() > 0.5",
    "row_number() over (order by a)", "*", "explode(array(1))", "current_user", "system.builtin.reflect('a','b')", "transform(array(1), x -> rand())", "version()", "a b c"])
def test_forbidden_expression(spark, text):
    from sluice.operators.expressions import check_expression
    with pytest.raises(ValueError):
        check_expression(text)


@pytest.mark.parametrize("text", [
    "a > 1 and b between 1 and 2", "case when a is null then 'x' else upper(b) end", "a || '-' || cast(b as string)", "if(a in (1, 2), a * 2, -a)", "a like 'x%' or not a rlike '^y'",
    "trim(both 'x' from a)", "transform(a, x -> x + 1)[0]", "date_format(to_timestamp(a), 'yyyy')", "coalesce(a.b, 0) % 2 = 1", "unix_timestamp(a)"])
def test_allowed_expression(spark, text):
    from sluice.operators.expressions import check_expression
    assert check_expression(text) == text
    assert check_expression("current_timestamp + 1", ["current_timestamp"])


def test_expression_with_quotes_in_a_name(spark):
    from sluice.operators.transform import compile_expression
    with pytest.raises(ValueError):
        compile_expression("${record.x') or reflect('a','b'}", [], True)


def test_upsert_last_wins_and_null_keys(spark):
    from sluice.operators.sinks import upsert
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "x", 0, 0), (2, "y", 0, 1), (3, None, 1, 0)],
                              "k int, v string, page_idx int, pos int")
    got = sorted(tuple(r) for r in upsert(t, b, ["k"]).collect())
    assert got == [(1, "a"), (2, "y"), (3, None)]
    bad = spark.createDataFrame([(None, "z", 0, 0)], "k int, v string, page_idx int, pos int")
    with pytest.raises(Exception):
        upsert(t, bad, ["k"]).collect()


def test_push_repeats_upsert(spark):
    """15 pushes with 2 repeated ids -> 13 rows."""
    from sluice.operators.sinks import dedupe_last
    rows = [(f"E{i if i < 13 else i - 13}", i, 0, i) for i in range(15)]
    df = spark.createDataFrame(rows, "event_id string, v int, page_idx int, pos int")
    assert dedupe_last(df, ["event_id"]).count() == 13


def test_upsert_statement_and_routing():
    from sluice.operators.sinks import SinkError, check_target, route, upsert_statement
    sql = upsert_statement("public.t", ["id", "name"], ["id"])
    assert sql == ('INSERT INTO "public"."t" ("id", "name") VALUES (?, ?) ON CONFLICT ("id") '
                   'DO UPDATE SET "name" = EXCLUDED."name"')
    with pytest.raises(SinkError):
        route("mongo")
    with pytest.raises(SinkError):
        check_target("  ")
    assert route(None) is route("postgresql")


def test_query_assembly_overwrites(spark):
    from sluice.operators.requests import assemble_url
    r = spark.sql("select 'http://h/x' u, map('page','0','q','a b') c, map('page','3','size','10') p").select(
        assemble_url(F.col("u"), F.col("c"), F.col("p")).alias("url")).first()
    assert r["url"] == "http://h/x?page=3&q=a b&size=10"


def test_link_header_next(spark):
    from sluice.operators.requests import link_next
    def of(text):
        return spark.createDataFrame([({"LINK": text},)], "h map<string,string>").select(link_next(F.col("h")).alias("n")).first()["n"]
    assert of('<http://h/i?page=1>; rel="prev", <http://h/i?page=3>; REL="next"') == "http://h/i?page=3"
    assert of('<http://h/a>; rel="next-archive", <http://h/b>; title="x"; rel=next') == "http://h/b"
    assert of('<http://h/a>; rel="next-archive"') is None and of('<http://h/a>; rel="prev next"') is None


def test_overlap_rules(spark):
    from sluice.functions.timefmt import overlap_seconds
    df = spark.createDataFrame([("5m",), ("2H",), (" 30s ",), ("",), (None,), ("3d",)], "o string")
    assert [r[0] for r in df.select(overlap_seconds(F.col("o"))).collect()] == [300, 7200, 30, 0, 0, 300]


def test_bad_overlap_is_reported(spark):
    from sluice.operators.config import parse_configs
    text = '{"incremental":{"enabled":true,"timestamp":{"overlap":"%s"}}}'
    df = spark.createDataFrame([(text % o,) for o in ("5m", "500ms", "3d", " 1H ")], "config string")
    assert [r["config_error"] for r in parse_configs(df).collect()] == [None, "overlap must be a whole number with s, m or h: 500ms", None, None]


def test_bump_rules(spark):
    from sluice.operators.watermark import bump_if_unchanged
    adv = spark.sql("select * from values ('a', timestamp'2025-06-01 09:00:00'), ('b', timestamp'2025-06-01 08:00:00'),"
                    " ('c', timestamp'2025-06-01 07:00:00') as t(connector_id, ts)")
    prev = spark.sql("select * from values ('a', timestamp'2025-06-01 08:00:00'), ('b', timestamp'2025-06-01 08:00:00')"
                     " as t(connector_id, ts)")
    got = {r["connector_id"]: str(r["ts"]) for r in bump_if_unchanged(adv, prev, "2025-06-02 00:00:00").collect()}
    assert got == {"a": "2025-06-01 09:00:00", "b": "2025-06-02 00:00:00", "c": "2025-06-02 00:00:00"}


def test_openapi_swagger2(spark):
    from sluice.operators.catalog import infer_pagination, operations
    doc = ('{"swagger":"2.0","host":"h.io","basePath":"/v1/","paths":{"/items":{"get":{"parameters":'
           '[{"name":"Offset","in":"query","type":"integer"},{"name":"limit","in":"query","type":"integer"}]},'
           '"post":{"description":"add"}}}}')
    ops = operations(spark.createDataFrame([(1, doc)], "spec_id int, doc string"))
    got = sorted((r["method"], r["operation_id"], r["summary"], r["url"]) for r in ops.collect())
    assert got == [("GET", "GET /items", "GET /items", "http://h.io/v1/items"),
                   ("POST", "POST /items", "add", "http://h.io/v1/items")]
    p = infer_pagination(ops).first()
    assert (p["strategy"], p["page_param"], p["size_param"], p["page_start"]) == ("offset_limit", "Offset", "limit", 0)


def test_reference_cycles_and_bad_documents(spark):
    from sluice.operators.catalog import operations, parameters
    doc = ('{"paths":{"/a":{"get":{"parameters":[{"$ref":"#/components/parameters/p~1q"},{"$ref":"http://elsewhere"},{"$ref":"#/none"}],'
           '"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Loop"}}}}}}},"components":{"parameters":'
           '{"p/q":{"name":"p","in":"query","schema":{"type":"float"}}},"schemas":{"Loop":{"allOf":[{"$ref":"#/components/schemas/Loop"},{"properties":{"n":{"type":"int32"}}}]}}}}')
    specs = spark.createDataFrame([(1, doc), (2, "{broken"), (3, None), (4, "[]"), (5, "{}")], "spec_id int, doc string")
    got = [(r["spec_id"], r["name"], r["place"], r["type"]) for r in parameters(operations(specs)).orderBy("i").collect()]
    assert got == [(1, "p", "query", "number"), (1, "n", "body", "integer")]


def test_mappings_from_declared_schema(spark):
    from sluice.operators.infer import mappings_from_schema
    s = '{"properties":{"id":{"type":"integer"},"amt":{"type":"number"},"ok":{"type":"boolean"},"n":{}}}'
    df = spark.createDataFrame([("c", s)], "connector_id string, record_schema string")
    got = {r["target"]: r["type"] for r in mappings_from_schema(df).collect()}
    assert got == {"id": "long", "amt": "double", "ok": "boolean", "n": "string"}


def test_types_ignore_nulls(spark):
    from sluice.operators.infer import infer_mappings
    recs = one_body_records(spark, '{"data":[{"a":1,"b":null,"c":true},{"a":null,"b":null,"c":2},{"a":2.5,"c":null}]}')
    assert {r["target"]: r["type"] for r in infer_mappings(recs, "all").collect()} == {"a": "double", "b": "string", "c": "string"}
    only = one_body_records(spark, '{"data":[{"a":1},{"a":null},{"a":2}]}')
    assert {r["target"]: r["type"] for r in infer_mappings(only, "all").collect()} == {"a": "long"}


def test_since_id_and_monotonic_beyond_18_digits(spark):
    from sluice.operators.requests import since_id_value
    df = spark.createDataFrame([("1000000000000000001",), ("99999999999999999999",), ("x1",), (None,)], "i string")
    assert [r[0] for r in df.select(since_id_value(F.col("i"))).collect()] == ["1000000000000000001", '"99999999999999999999"', '"x1"', None]


def test_sample_texts_are_cut_and_whole_errors_kept(spark):
    from sluice.operators.transform import transform
    long = "x" * 3000
    recs = one_body_records(spark, '{"data":[' + ",".join(['{"id":"%s"}' % long] * 30) + "]}")
    res = transform(recs, [{"type": "map_fields", "mappings": [{"source": "id", "target": "id", "type": "long"}]}])
    got = res.errors.collect()
    assert sorted(r["record_index"] for r in got) == list(range(20)) and {len(r["sample_json"]) for r in got} == {2000}
    whole = res.all_errors.collect()
    assert len(whole) == 30 and {len(r["sample_json"]) for r in whole} == {len('{"id":""}') + 3000} and all(len(r["message"]) > 3000 for r in whole)


def test_write_modes_and_blank_targets(spark, tmp_path):
    from sluice.operators import sinks as K
    rows = spark.createDataFrame([(1, "a", 0, 0), (1, "b", 0, 1), (2, "c", 0, 2)], "k int, v string, page_idx int, pos int")
    sent = []

    class Cursor:
        def executemany(self, sql, batch):
            (tmp_path / f"{abs(hash((sql, tuple(batch))))}").write_text(sql + "|" + str(len(batch)))

    class Connection:
        cursor = lambda self: Cursor()
        commit = close = rollback = lambda self: None
    for mode, n in (("insert", 3), ("upsert", 2), (None, 2)):
        assert K.route("postgresql")(rows, table="t", keys=["k"], write_mode=mode, connect=lambda url: Connection()) == n
    sent = [p.read_text() for p in tmp_path.iterdir()]
    assert any("ON CONFLICT" not in s for s in sent) and any("ON CONFLICT" in s for s in sent)
    for sink, target in (("postgresql", "table"), ("kafka", "topic"), ("parquet", "table")):
        with pytest.raises(K.SinkError):
            K.route(sink)(rows, **{target: "  "}, keys=["k"])
    with pytest.raises(K.SinkError):
        K.route("parquet")(rows, table=str(tmp_path / "x"), keys=["k"], write_mode="replace")
    assert K.default_keys(["a", "b"], None) == ["a"] and K.default_keys(["a", "b"], ["b"]) == ["b"]


def test_no_window_grows_with_a_group(spark):
    """Levels of blocks: each part of a prefix sum over one group has at most FAN rows."""
    from sluice.plans import ordinal
    assert [ordinal._levels(n) for n in (1, 1024, 1025, 1 << 20, (1 << 20) + 1, 1 << 30)] == [0, 0, 1, 1, 2, 2]
    df = spark.range(0, 3000).select(F.lit("g").alias("g"), (F.col("id") * 1000).alias("k"))
    lo, hi, n, none, null_group = ordinal._bounds(df, F.col("k"), ["g"])
    assert none == 0 and not null_group
    width = max(1, (hi - lo + 1) * 64 // n)
    per_block = df.groupBy(F.floor(F.col("k") / width)).count().agg(F.max("count")).first()[0]
    assert per_block <= 2 * 64
    old = ordinal.FAN
    try:
        ordinal.FAN = 4
        got = ordinal.with_ordinal(df, ["g"], "k", block=16, total="n").orderBy("k").collect()
        assert [r["rn"] for r in got] == list(range(3000)) and {r["n"] for r in got} == {3000}
        pages = spark.range(0, 100).select(F.lit("g").alias("g"), F.col("id").cast("int").alias("page_idx"), (F.col("id") % 3).cast("int").alias("n"))
        offs = [r["offset"] for r in ordinal.with_prefix_offset(pages, ["g"], "page_idx", "n", block=3).orderBy("page_idx").collect()]
        assert offs == [sum(i % 3 for i in range(p)) for p in range(100)]
    finally:
        ordinal.FAN = old


def test_ordinal_matches_row_number(spark):
    from sluice.plans.ordinal import with_ordinal
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 5000).alias("k"))
    got = with_ordinal(df, ["g"], "k", block=64).select("g", "k", "rn")
    from pyspark.sql import Window
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1)
    assert got.exceptAll(exp).count() == 0 and got.count() == 5000


def test_ordinals_keep_rows_with_null_keys(spark):
    from sluice.plans import ordinal
    rows = [("a", 3, 1), ("a", None, 2), (None, 5, 3), (None, 1, 4), ("a", 1, 5), (None, None, 6), ("a", None, 7)] + [("n", None, 100 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k int, id int")
    for block in (4, 8192):
        got = ordinal.with_ordinal(df, ["g"], "k", tiebreak=["id"], block=block, total="n").collect()
        assert len(got) == len(rows)
        for g, n in (("a", 4), (None, 3), ("n", 50)):
            mine = sorted((r["rn"], r["k"]) for r in got if r["g"] == g)
            assert [i for i, _ in mine] == list(range(n)) and all(r["n"] == n for r in got if r["g"] == g)
            keys = [k for _, k in mine]
            assert keys == sorted((k for k in keys if k is not None)) + [None] * keys.count(None)


def test_record_index_of_runs_with_null_keys(spark):
    from sluice.operators.extract import with_record_index
    rows = [(c, r, p, i) for c, r in (("x", 1), (None, 1), ("x", None)) for p in range(3) for i in range(2)]
    recs = spark.createDataFrame(rows, "connector_id string, run_id bigint, page_idx int, pos int")
    got = {(r["connector_id"], r["run_id"], r["page_idx"], r["pos"]): r["record_index"] for r in with_record_index(recs).collect()}
    assert got == {(c, r, p, i): 2 * p + i for c, r, p, i in rows}


def test_failure_streaks_of_runs_without_a_start(spark):
    from sluice.operators.runs import consecutive_failures
    rows = [("c", i, f"2024-01-0{i}", "failed") for i in (1, 2)] + [("c", 9, None, "failed"), (None, 11, "2024-01-01", "failed"), (None, 12, "2024-01-02", "failed"), (None, 13, "2024-01-03", "failed"), ("d", 20, None, "failed")]
    runs = spark.createDataFrame(rows, "connector_id string, id bigint, s string, status string").withColumn("started_at", F.col("s").cast("timestamp"))
    assert {(r["connector_id"], r["id"]) for r in consecutive_failures(runs).collect()} == {("c", 9), (None, 13)}


def test_python_batches_are_bounded_in_bytes(spark):
    sizes = lambda batches: ((b.select([0]).slice(0, 1).set_column(0, "n", __import__("pyarrow").array([b.num_rows], "int64"))) for b in batches)
    df = spark.range(0, 3000, 1, 1).select(F.expr("repeat('x', 20000)").alias("t"))
    assert 0 < max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) <= 250
