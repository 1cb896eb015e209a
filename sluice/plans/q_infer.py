"""Registered queries for schema inference (I) and the API catalogue (O)."""
from __future__ import annotations

from pyspark.sql import functions as F

from sluice.operators import catalog as O
from sluice.operators import extract as X
from sluice.operators import infer as I
from sluice.plans.registered import register
from sluice.sources.landed import land_pages, part_specs, read_table


def _customer_records(spark, sf):
    c = read_table(spark, sf, "customer")
    ck = F.col("c_custkey")
    base = F.to_json(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                              (F.col("c_acctbal") > 5000).alias("vip")))
    mixed = (F.when(ck % 3 == 0, (ck * 10).cast("string"))
              .when(ck % 3 == 1, F.concat((ck * 10).cast("string"), F.lit(".5")))
              .otherwise(F.concat(F.lit('"c'), ck.cast("string"), F.lit('"'))))
    rec = F.concat(F.regexp_replace(base, "}$", ""), F.lit(',"mixed":'), mixed, F.lit("}"))
    pages = land_pages(c, F.lit("customers"), "c_custkey", rec, page_size=100, root="payload")
    return X.extract_records(pages, "$.payload")


CUST_TYPES = """(VALUES ('c_custkey', 'long'), ('c_name', 'string'), ('c_nationkey', 'long'), ('c_acctbal', 'double'),
  ('c_mktsegment', 'string'), ('vip', 'boolean'), ('mixed', '{mixed}')) AS t(target, type)"""


@register("i1_infer_mappings_all", f"""
SELECT 'customers' AS connector_id, target, '$.' || target AS source, type
FROM {CUST_TYPES.format(mixed='string')}, (SELECT count(*) AS n FROM customer) WHERE n > 0""")
def i1_infer_mappings_all(spark, sf):
    return I.infer_mappings(_customer_records(spark, sf), mode="all")


@register("i1_infer_mappings_first", f"""
SELECT 'customers' AS connector_id, target, '$.' || target AS source,
  CASE WHEN target = 'mixed' THEN CASE k % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'double' ELSE 'string' END ELSE type END AS type
FROM {CUST_TYPES.format(mixed='')}, (SELECT min(c_custkey) AS k FROM customer)""")
def i1_infer_mappings_first(spark, sf):
    return I.infer_mappings(_customer_records(spark, sf), mode="first")


@register("i3_infer_schema", """
SELECT path, any_value(t) AS type, count(*) AS n_records, min(s) AS sample FROM (
  SELECT '$.p_partkey' AS path, CAST(p_partkey AS VARCHAR) AS s, 'long' AS t FROM part
  UNION ALL SELECT '$.p_name', p_name, 'string' FROM part
  UNION ALL SELECT '$.brand', NULL, 'object' FROM part
  UNION ALL SELECT '$.brand.name', p_brand, 'string' FROM part
  UNION ALL SELECT '$.brand.size', CAST(p_size AS VARCHAR), 'long' FROM part) GROUP BY path""")
def i3_infer_schema(spark, sf):
    p = read_table(spark, sf, "part")
    rec = F.to_json(F.struct("p_partkey", "p_name", F.struct(F.col("p_brand").alias("name"),
                                                             F.col("p_size").alias("size")).alias("brand")))
    recs = X.extract_records(land_pages(p, F.lit("parts"), "p_partkey", rec, page_size=100), "$.data")
    return I.infer_schema(recs)


@register("i3_nested_schema", """
SELECT json_extract_string(s, '$.properties.c_custkey.type') AS key_type, CAST(min(c_custkey) AS VARCHAR) AS key_example, 'object' AS place_type, 'string' AS nation_type,
  'object' AS mixed_type, min(CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment END) AS segment_example, 'boolean' AS vip_type, 'string' AS tags_type, 6 AS n_fields
FROM customer, (SELECT '{"properties":{"c_custkey":{"type":"long"}}}' AS s) GROUP BY s""")
def i3_nested_schema(spark, sf):
    """One schema from records that disagree: nations are numbers or texts, and
    ``mixed`` is an object in every second record only."""
    c = read_table(spark, sf, "customer")
    ck = F.col("c_custkey")
    nation = F.when(ck % 3 == 0, F.concat(F.lit('"n'), F.col("c_nationkey").cast("string"), F.lit('"'))).otherwise(F.col("c_nationkey").cast("string"))
    mixed = F.when(ck % 2 == 1, F.concat(F.lit('{"segment":'), F.to_json(F.struct("c_mktsegment")).substr(F.lit(17), F.length(F.to_json(F.struct("c_mktsegment"))) - 17), F.lit("}"))).otherwise(F.lit("7"))
    rec = F.concat(F.lit('{"c_custkey":'), ck.cast("string"), F.lit(',"place":{"nation":'), nation, F.lit(',"segment":"x"},"mixed":'), mixed,
                   F.lit(',"vip":'), (F.col("c_acctbal") > 5000).cast("string"), F.lit(',"note":null,"tags":["a",1]}'))
    schema = I.nested_schema(X.extract_records(land_pages(c, F.lit("customers"), "c_custkey", rec, page_size=100), "$.data"))
    s = F.parse_json("record_schema")
    at = lambda path: F.try_variant_get(s, "$.properties." + path, "string")
    return schema.select(at("c_custkey.type").alias("key_type"), at("c_custkey.example").alias("key_example"), at("place.type").alias("place_type"),
                         at("place.properties.nation.type").alias("nation_type"), at("mixed.type").alias("mixed_type"),
                         at("mixed.properties.segment.example").alias("segment_example"), at("vip.type").alias("vip_type"), at("tags.type").alias("tags_type"),
                         F.size(F.map_keys(F.try_variant_get(s, "$.properties", "map<string,variant>"))).alias("n_fields"))


@register("i2_schema_mappings", """
SELECT p_partkey, target, '$.' || target AS source, type FROM (
  SELECT p_partkey, 'id' AS target, CASE WHEN p_size % 2 = 0 THEN 'long' ELSE 'string' END AS type FROM part
  UNION ALL SELECT p_partkey, 'price', CASE p_size % 3 WHEN 0 THEN 'double' WHEN 1 THEN 'decimal' ELSE 'double' END FROM part
  UNION ALL SELECT p_partkey, 'live', 'boolean' FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, 'when', 'string' FROM part)""")
def i2_schema_mappings(spark, sf):
    """Mappings of one declared schema per part."""
    size = F.col("p_size")
    fields = F.concat_ws(",", F.concat(F.lit('"id":{"type":"'), F.when(size % 2 == 0, "INTEGER").otherwise("string"), F.lit('"}')),
                         F.concat(F.lit('"price":{"type":"'), F.when(size % 3 == 0, "number").when(size % 3 == 1, "decimal").otherwise("double"), F.lit('"}')),
                         F.when(size > 25, F.lit('"live":{"type":"boolean","example":true}')), F.lit('"when":{"format":"date"}'))
    parts = read_table(spark, sf, "part").select("p_partkey", F.concat(F.lit('{"type":"object","properties":{'), fields, F.lit("}}")).alias("record_schema"))
    return I.mappings_from_schema(parts)


def _mixed_pages(spark, sf):
    ev = read_table(spark, sf, "events")
    o = read_table(spark, sf, "orders")
    c = read_table(spark, sf, "customer")
    a = land_pages(ev, F.lit("ev"), "event_id", F.to_json(F.struct("event_id", "event_type")), root="data")
    b = land_pages(o, F.lit("ord"), "o_orderkey", F.to_json(F.struct("o_orderkey")), root="records")
    d = land_pages(c, F.lit("cust"), "c_custkey", F.to_json(F.struct("c_custkey")), root="payload")
    return a.unionByName(b).unionByName(d)


PAGES_OF = """(SELECT 'ev' AS connector_id, unnest(range(0, CAST(ceil((SELECT count(*) FROM events) / 100) AS INTEGER))) AS page_idx, '$.data' AS record_path
  UNION ALL SELECT 'ord', unnest(range(0, CAST(ceil((SELECT count(*) FROM orders) / 100) AS INTEGER))), '$.records'
  UNION ALL SELECT 'cust', unnest(range(0, CAST(ceil((SELECT count(*) FROM customer) / 100) AS INTEGER))), '$.payload')"""


@register("i4_detect_record_array", f"SELECT connector_id, CAST(page_idx AS INTEGER) AS page_idx, record_path FROM {PAGES_OF}")
def i4_detect_record_array(spark, sf):
    return I.detect_record_array(_mixed_pages(spark, sf)).select("connector_id", "page_idx", "record_path")


@register("i5_envelope_fields", f"""
SELECT connector_id, CAST(page_idx AS INTEGER) AS page_idx, 'meta' AS envelope FROM {PAGES_OF}""")
def i5_envelope_fields(spark, sf):
    d = I.detect_record_array(_mixed_pages(spark, sf))
    e = I.envelope_fields(d, F.col("record_path"))
    return e.select("connector_id", "page_idx", F.array_join("envelope", ",").alias("envelope"))


SPEC_OPS = """(SELECT p_partkey AS spec_id, 'GET' AS method, '/parts/' || CAST(p_partkey AS VARCHAR) AS path,
    CASE WHEN p_size % 3 = 0 THEN 'getPart' || CAST(p_partkey AS VARCHAR) ELSE 'GET /parts/' || CAST(p_partkey AS VARCHAR) END AS operation_id,
    CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_type END AS summary, p_partkey, p_brand, p_size FROM part
  UNION ALL SELECT p_partkey, 'POST', '/parts/' || CAST(p_partkey AS VARCHAR), 'POST /parts/' || CAST(p_partkey AS VARCHAR),
    'create ' || p_name, p_partkey, p_brand, p_size FROM part WHERE p_size > 25)"""


def _ops(spark, sf):
    return O.operations(part_specs(read_table(spark, sf, "part")))


@register("o1_operations", f"SELECT spec_id, method, path, operation_id, summary FROM {SPEC_OPS}")
def o1_operations(spark, sf):
    return _ops(spark, sf).select("spec_id", "method", "path", "operation_id", "summary")


@register("o2_server_urls", f"""
SELECT spec_id, method, CASE WHEN p_partkey % 2 = 0 THEN 'http' ELSE 'https' END || '://api.local/'
  || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || path AS url FROM {SPEC_OPS}""")
def o2_server_urls(spark, sf):
    return _ops(spark, sf).select("spec_id", "method", "url")


@register("o3_parameters", f"""
SELECT spec_id, method, place, count(*) AS n FROM (
  SELECT spec_id, method, 'header' AS place FROM {SPEC_OPS}
  UNION ALL SELECT spec_id, method, 'query' FROM {SPEC_OPS}, (VALUES (1), (2)) v(x) WHERE method = 'GET' AND p_size % 4 <> 3)
GROUP BY 1, 2, 3""")
def o3_parameters(spark, sf):
    return O.parameters(_ops(spark, sf)).groupBy("spec_id", "method", "place").agg(F.count(F.lit(1)).alias("n"))


@register("o7_pagination", f"""
SELECT spec_id, method, path,
  CASE p_size % 4 WHEN 0 THEN 'offset_limit' WHEN 1 THEN 'cursor' WHEN 2 THEN 'page_page_size' END AS strategy,
  CASE p_size % 4 WHEN 0 THEN 'offset' WHEN 1 THEN 'page' WHEN 2 THEN 'page' END AS page_param,
  CASE p_size % 4 WHEN 0 THEN 'Limit' WHEN 1 THEN 'page_size' WHEN 2 THEN 'per-page' END AS size_param,
  CASE WHEN p_size % 4 = 3 THEN NULL ELSE 'query' END AS location,
  CASE p_size % 4 WHEN 0 THEN 'offset' WHEN 2 THEN 'page_number' END AS page_value_type,
  CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 END AS page_start,
  CASE p_size % 4 WHEN 1 THEN 'Page-Token' WHEN 3 THEN NULL ELSE 'cursor' END AS cursor_param,
  CASE WHEN p_size % 4 = 3 THEN NULL ELSE '$.meta.nextCursor' END AS cursor_response_path,
  CASE WHEN p_size % 4 = 3 THEN NULL ELSE '$.meta.hasMore' END AS has_more_path, CAST(NULL AS VARCHAR) AS total_path
FROM {SPEC_OPS} WHERE method = 'GET'""")
def o7_pagination(spark, sf):
    return O.infer_pagination(_ops(spark, sf))


@register("o9_parameter_types", """
SELECT spec_id, method, name, type, CASE type WHEN 'integer' THEN '1' WHEN 'number' THEN '1.0' ELSE 'example' END AS example FROM (
  SELECT p_partkey AS spec_id, 'GET' AS method, 'X-Tenant' AS name, 'string' AS type FROM part
  UNION ALL SELECT p_partkey, 'POST', 'X-Tenant', 'string' FROM part WHERE p_size > 25
  UNION ALL SELECT p_partkey, 'GET', 'offset', 'integer' FROM part WHERE p_size % 4 = 0
  UNION ALL SELECT p_partkey, 'GET', 'Limit', 'integer' FROM part WHERE p_size % 4 = 0
  UNION ALL SELECT p_partkey, 'GET', 'Page-Token', 'string' FROM part WHERE p_size % 4 = 1
  UNION ALL SELECT p_partkey, 'GET', 'page_size', 'integer' FROM part WHERE p_size % 4 = 1
  UNION ALL SELECT p_partkey, 'GET', 'page', 'integer' FROM part WHERE p_size % 4 = 2
  UNION ALL SELECT p_partkey, 'GET', 'per-page', 'number' FROM part WHERE p_size % 4 = 2)""")
def o9_parameter_types(spark, sf):
    return O.parameters(_ops(spark, sf)).select("spec_id", "method", "name", "type", "example")


@register("o10_connector_slugs", f"""
SELECT spec_id, method, 'openapi-' || CASE WHEN starts_with(operation_id, 'getPart') THEN lower(operation_id)
  ELSE lower(method) || '-parts-' || CAST(p_partkey AS VARCHAR) END AS connector_id FROM {SPEC_OPS}""")
def o10_connector_slugs(spark, sf):
    return _ops(spark, sf).select("spec_id", "method", O.connector_slug(F.col("operation_id"), F.col("method"), F.col("path")).alias("connector_id"))


@register("o10_filter_operations", f"""
SELECT spec_id, operation_id FROM {SPEC_OPS} WHERE method = 'GET' AND (lower(path) LIKE '%1%'
  OR lower(summary) LIKE '%1%' OR lower(operation_id) LIKE '%1%')""")
def o10_filter_operations(spark, sf):
    return O.filter_operations(_ops(spark, sf), "get", "1").select("spec_id", "operation_id")
