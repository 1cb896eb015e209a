"""Registered queries for configs (S1), page scans (S2), wildcard and deep
paths (X2, X8, I4, I5), references and responses of API documents (O3-O8)."""
from __future__ import annotations

from pyspark.sql import functions as F

from sluice.functions.jsonpath import parse_body, vget
from sluice.operators import catalog as O
from sluice.operators import config as C
from sluice.operators import extract as X
from sluice.operators import infer as I
from sluice.plans.registered import register
from sluice.session import scratch_path
from sluice.sources.landed import dealt, event_pages, read_pages, read_table

CONFIGS = """(SELECT 'cust-' || CAST(c_custkey AS VARCHAR) AS connector_id, c_custkey AS k FROM customer)"""


@register("s1_config_defaults", f"""
SELECT connector_id, CASE WHEN k % 9 = 8 THEN NULL WHEN k % 2 = 0 THEN 'push' ELSE 'pull' END AS config_mode,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 3 = 0 THEN 'json' WHEN k % 3 = 1 THEN 'form-urlencoded' ELSE 'none' END AS body_type,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 5 = 0 THEN 500 WHEN k % 5 = 1 THEN 700 ELSE 30000 END AS timeout_ms,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 4 = 0 THEN 'link_header' ELSE 'page_page_size' END AS strategy,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 4 = 0 THEN 'no_next_link,empty_page' WHEN k % 4 = 1 THEN 'has_more_false' ELSE 'empty_cursor,empty_page' END AS stop_when,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 4 = 1 THEN 'json_path' ELSE 'none' END AS total_source,
  CASE WHEN k % 9 = 8 THEN NULL ELSE 1000 END AS max_pages,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 6 = 0 THEN 'monotonic_id' WHEN k % 6 = 1 THEN 'rolling_window' ELSE 'timestamp' END AS inc_mode,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 6 = 0 THEN '$.id' WHEN k % 6 IN (1, 2) THEN '$.updated_at' END AS response_path,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 6 = 0 THEN 'since_id' WHEN k % 6 = 1 THEN 'startTime' WHEN k % 6 = 2 THEN 'after' END AS request_param,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 6 = 0 THEN NULL ELSE '5m' END AS overlap,
  CASE WHEN k % 9 = 8 OR k % 7 = 0 THEN NULL ELSE 'postgresql' END AS sink, CASE WHEN k % 9 = 8 OR k % 7 = 0 THEN NULL ELSE 'upsert' END AS write_mode,
  CASE WHEN k % 9 = 8 OR k % 7 = 0 THEN NULL ELSE 500 END AS batch_size,
  CASE WHEN k % 9 = 8 THEN NULL WHEN k % 7 = 1 THEN '$' ELSE '$.data' END AS input_root,
  CASE WHEN k % 9 = 8 THEN NULL ELSE k % 2 = 0 END AS scheduled,
  CASE WHEN k % 9 = 8 THEN 'Connector config must be a JSON object' END AS config_error FROM {CONFIGS}""")
def s1_config_defaults(spark, sf):
    """One config text per customer, most settings missing or blank in turn."""
    k = F.col("c_custkey")
    pick = lambda *cases: F.concat(*[F.when(c, F.lit(t)).otherwise(F.lit("")) for c, t in cases])
    http = F.concat(F.lit('"http":{"url":"http://h"'), pick((k % 3 == 0, ',"body":{"a":1}'), (k % 3 == 1, ',"form":{"x":"y"},"body_type":" "'),
                                                           (k % 5 == 0, ',"timeout_ms":500'), (k % 5 == 1, ',"timeoutMs":700')), F.lit("}"))
    paging = pick((k % 4 == 0, ',"pagination":{"strategy":"link_header"}'),
                  (k % 4 == 1, ',"pagination":{"strategy":"","total_count":{"json_path":"$.meta.total"},"stop_when":[" has_more_false ",""]}'))
    inc = pick((k % 6 == 0, ',"incremental":{"enabled":true,"mode":"MONOTONIC_ID"}'), (k % 6 == 1, ',"incremental":{"enabled":true,"mode":"rolling_window"}'),
               (k % 6 == 2, ',"incremental":{"enabled":true,"timestamp":{"request_param":"after"}}'), (k % 6 == 3, ',"incremental":{"enabled":false,"mode":"monotonic_id"}'))
    rest = pick((k % 7 == 1, ',"transform":{"input_root":"$"}'), (k % 7 != 0, ',"sink":{"type":"","target":{"table":"t"},"keys":["id"]}'),
                (k % 2 == 0, ',"mode":"push","schedule":{"type":"interval"}'))
    text = F.when(k % 18 == 8, F.lit("[1]")).when(k % 9 == 8, F.lit("{broken")).otherwise(F.concat(F.lit("{"), http, paging, inc, rest, F.lit("}")))
    c = dealt(read_table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.concat(F.lit("cust-"), k.cast("string")).alias("connector_id"), text.alias("config"))
    return C.parse_configs(c).select(
        "connector_id", "config_mode", "http.body_type", "http.timeout_ms", "pagination.strategy", F.array_join("pagination.stop_when", ",").alias("stop_when"),
        "pagination.total_source", "pagination.max_pages", F.col("incremental.mode").alias("inc_mode"), "incremental.response_path", "incremental.request_param",
        "incremental.overlap", F.col("sink.type").alias("sink"), "sink.write_mode", "sink.batch_size", "transform.input_root", F.col("schedule.enabled").alias("scheduled"), "config_error")


@register("s2_page_scan", """
SELECT CAST(ceil(count(*) / 100) AS BIGINT) AS pages, count(*) AS records, max(event_id) AS last FROM events""")
def s2_page_scan(spark, sf):
    """Landed page folders, written as JSON lines and read back as a batch."""
    land = scratch_path(spark, "pages-json")
    event_pages(spark, sf, page_size=100).write.json(land)
    pages = read_pages(spark, land, "json", kind="page")
    recs = X.extract_records(pages, "$.data")
    n = pages.agg(F.count(F.lit(1)).alias("pages")).withColumn("j", F.lit(1))
    r = recs.agg(F.count(F.lit(1)).alias("records"), F.max(vget("rec", "$.event_id", "bigint")).alias("last")).withColumn("j", F.lit(1))
    return n.join(r, "j").drop("j")


@register("x2_wildcard_path", """
SELECT o_custkey AS k, count(*) AS n, min(o_orderkey) AS first, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tags
FROM orders GROUP BY o_custkey""")
def x2_wildcard_path(spark, sf):
    """All ids under ``$.items[*].id``, and under two wildcards."""
    o = read_table(spark, sf, "orders")
    item = F.struct(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.struct(F.lit("t").alias("tag")))).alias("tags"))
    doc = o.groupBy(F.col("o_custkey").alias("k")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("d"))
    v = doc.select("k", parse_body("d").alias("v"))
    ids, tags = F.try_variant_get(vget("v", "$.items[*].id"), "$", "array<bigint>"), F.try_variant_get(vget("v", "$.items[*].tags[*].tag"), "$", "array<string>")
    return v.select("k", F.size(ids).cast("bigint").alias("n"), F.get(ids, 0).alias("first"), F.size(tags).cast("bigint").alias("tags"))


DEPTH = 12


@register("x8_deep_paths", """
SELECT '$' || (SELECT string_agg('.l' || CAST(i AS VARCHAR), '' ORDER BY i) FROM range(1, d + 1) t(i)) || CASE WHEN d = 12 THEN '.leaf' ELSE '' END AS path,
  (SELECT count(*) FROM customer) AS n_records, CASE WHEN d = 12 THEN (SELECT CAST(min(CAST(c_custkey AS VARCHAR)) AS VARCHAR) FROM customer) END AS sample
FROM range(1, 13) r(d) UNION ALL
SELECT '$' || (SELECT string_agg('.l' || CAST(i AS VARCHAR), '' ORDER BY i) FROM range(1, 13) t(i)), (SELECT count(*) FROM customer), NULL""")
def x8_deep_paths(spark, sf):
    """Records twelve objects deep: no path is lost."""
    rec = F.struct(F.col("c_custkey").alias("leaf"))
    for i in range(DEPTH, 0, -1):
        rec = F.struct(rec.alias(f"l{i}"))
    c = dealt(read_table(spark, sf, "customer").select("c_custkey"), "c_custkey").select(F.parse_json(F.to_json(rec)).alias("rec"))
    return X.path_catalogue(c)


DEEP = """(SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN '$.a.b.c.d.items' ELSE '$.result.records' END AS path,
  CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE 'code,total' END AS envelope FROM customer)"""


@register("i4_deep_arrays", f"SELECT k, path AS record_path, envelope FROM {DEEP}")
def i4_deep_arrays(spark, sf):
    """Record arrays five keys deep, and one that a preferred key hides; the
    envelope is what stands beside the array."""
    k = F.col("c_custkey")
    deep = F.concat(F.lit('{"x":[1,2],"a":{"b":{"c":{"d":{"n":1,"items":[{"k":'), k.cast("string"), F.lit("}]}}}}}"))
    near = F.concat(F.lit('{"other":{"rows":[{"z":"[{\\""}]},"result":{"code":0,"records":[{"k":'), k.cast("string"), F.lit('}],"total":1}}'))
    pages = read_table(spark, sf, "customer").select(k.alias("k"), F.when(k % 2 == 0, deep).otherwise(F.replace(near, F.lit('"other":{"rows":[{"z":"[{\\""}]},'), F.lit('"other":{"rows":["[{"]},'))).alias("body"))
    d = I.envelope_fields(I.detect_record_array(pages), F.col("record_path"))
    return d.select("k", "record_path", F.array_join("envelope", ",").alias("envelope"))


def _ref_specs(spark, sf):
    """API documents with shared parameters, references, ``allOf`` and a
    reference to itself."""
    k = F.col("p_partkey")
    kind = k % 3
    schemas = F.lit('"schemas":{"Base":{"type":"object","properties":{"id":{"type":"int64"},"parent":{"$ref":"#/components/schemas/Base"}}},'
                    '"Part":{"allOf":[{"$ref":"#/components/schemas/Base"},{"type":"object","properties":{"name":{"type":"string"},"price":{"type":"double"}}}]},'
                    '"List":{"type":"object","properties":{"Has-More":{"type":"boolean"},"meta":{"type":"object","properties":{"nextCursor":{"type":"string"},"totalCount":{"type":"integer"}}},'
                    '"rows":{"type":"array","items":{"$ref":"#/components/schemas/Part"}}}}}')
    params = (F.when(kind == 0, F.lit('{"$ref":"#/components/parameters/Skip"},{"name":"Limit","in":"query","schema":{"type":"int32"}}'))
               .when(kind == 1, F.lit('{"name":"Page-Token","in":"query","schema":{"type":"string","example":"abc"}}'))
               .otherwise(F.lit('{"name":"PageNum","in":"query","type":"integer"},{"name":"x","in":"cookie"}')))
    ok = F.when(k % 2 == 0, F.lit('"200":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/List"}}}}')) \
          .otherwise(F.lit('"404":{},"201":{"content":{"text/json":{"schema":{"type":"array","items":{"$ref":"#/components/schemas/Part"}}}}}'))
    doc = F.concat(F.lit('{"servers":[{"url":" "},{"url":"http://h/api/"}],"paths":{"parts":{"get":{"operationId":"'), F.when(k % 5 == 0, F.lit("***")).otherwise(F.concat(F.lit("List Parts "), k.cast("string"))),
                   F.lit('","parameters":['), params, F.lit('],"responses":{'), ok, F.lit('}},"put":{"requestBody":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Part"}}}}}}},'
                         '"components":{"parameters":{"Skip":{"name":"Skip","in":"query","schema":{"type":"integer"}}},'), schemas, F.lit("}}"))
    return O.operations(dealt(read_table(spark, sf, "part").select("p_partkey"), "p_partkey").select(k.alias("spec_id"), doc.alias("doc")))


@register("o3_references", """
SELECT p_partkey AS spec_id, method, name, place, type, example FROM part, (VALUES
  (0, 'GET', 'Skip', 'query', 'integer', '1'), (0, 'GET', 'Limit', 'query', 'integer', '1'), (1, 'GET', 'Page-Token', 'query', 'string', 'abc'),
  (2, 'GET', 'PageNum', 'query', 'integer', '1')) v(kind, method, name, place, type, example) WHERE p_partkey % 3 = kind
UNION ALL SELECT p_partkey, 'PUT', name, 'body', type, example FROM part, (VALUES ('id', 'integer', '1'), ('parent', 'string', 'example'),
  ('name', 'string', 'example'), ('price', 'number', '1.0')) v(name, type, example)""")
def o3_references(spark, sf):
    return O.parameters(_ref_specs(spark, sf)).select("spec_id", "method", "name", "place", "type", "example")


@register("o4_response_schema", """
SELECT p_partkey AS spec_id, CASE WHEN p_partkey % 2 = 0 THEN '$.rows' ELSE '$' END AS input_root,
  'id:integer,parent:string,name:string,price:number' AS fields, CASE WHEN p_partkey % 2 = 0 THEN 'Has-More,meta' ELSE '' END AS envelope FROM part""")
def o4_response_schema(spark, sf):
    """Record fields, input root and envelope behind references."""
    d = O.with_response(_ref_specs(spark, sf).filter(F.col("method") == "GET"))
    fields = F.array_join(F.transform(F.map_entries("record_fields"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return d.select("spec_id", "input_root", fields.alias("fields"), F.array_join(F.map_keys("envelope"), ",").alias("envelope"))


@register("o8_paging_paths", """
SELECT p_partkey AS spec_id, CASE p_partkey % 3 WHEN 0 THEN 'offset_limit' WHEN 1 THEN 'cursor' ELSE 'page_page_size' END AS strategy,
  CASE p_partkey % 3 WHEN 0 THEN 'Skip' WHEN 1 THEN 'page' ELSE 'PageNum' END AS page_param,
  CASE p_partkey % 3 WHEN 0 THEN 'Limit' ELSE 'page_size' END AS size_param,
  CASE WHEN p_partkey % 3 = 1 THEN 'Page-Token' ELSE 'cursor' END AS cursor_param,
  '$.meta.nextCursor' AS cursor_response_path,
  CASE WHEN p_partkey % 6 = 4 THEN '$.Has-More' ELSE '$.meta.hasMore' END AS has_more_path,
  CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 <> 1 THEN '$.meta.totalCount' END AS total_path FROM part""")
def o8_paging_paths(spark, sf):
    p = O.infer_pagination(_ref_specs(spark, sf))
    return p.select("spec_id", "strategy", "page_param", "size_param", "cursor_param", "cursor_response_path", "has_more_path", "total_path")


@register("o2_o10_names", """
SELECT p_partkey AS spec_id, method, 'http://h/api/parts' AS url, 'openapi-' || CASE WHEN method = 'PUT' THEN 'put-parts'
  WHEN p_partkey % 5 = 0 THEN 'operation' ELSE 'list-parts-' || CAST(p_partkey AS VARCHAR) END AS slug
FROM part, (VALUES ('GET'), ('PUT')) v(method)""")
def o2_o10_names(spark, sf):
    ops = O.filter_operations(_ref_specs(spark, sf), None, "t parts")
    return ops.select("spec_id", "method", "url", O.connector_slug(F.col("operation_id"), F.col("method"), F.col("path")).alias("slug"))
