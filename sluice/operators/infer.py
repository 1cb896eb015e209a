"""Schema inference from records and responses."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.jsonpath import vkind
from sluice.functions.jsonpath import jtext
from sluice.operators.extract import max_depth_of, walk_paths
from sluice.plans.ordinal import null_safe_join
from sluice.session import scratch_path

# Record-array keys tried first at each level, in this order.
PREFERRED_ARRAY_KEYS = ("results", "data", "items", "records", "list")
# Mapping type of a JSON value kind; widening order for the all-records mode.
TYPE_OF_KIND = {"boolean": "boolean", "integer": "long", "float": "double"}
WIDEN_RANK = {"long": 1, "double": 2, "boolean": 3, "string": 4}


def _type_col(kind: Column) -> Column:
    lut = F.create_map(*[F.lit(x) for kv in TYPE_OF_KIND.items() for x in kv])
    return F.coalesce(F.element_at(lut, kind), F.lit("string"))


def field_types(records: DataFrame, group: Sequence[str] = ("connector_id",)) -> DataFrame:
    """Top-level fields of object records with their mapping type."""
    group = list(group)
    e = records.select(*group, "page_idx", "pos",
                       F.explode(F.try_variant_get("rec", "$", "map<string,variant>")).alias("field", "v"))
    k = vkind(F.col("v"))
    return e.select(*group, "page_idx", "pos", "field", _type_col(k).alias("type"), (k == "null").alias("is_null"))


def infer_mappings(records: DataFrame, mode: str = "first",
                   group: Sequence[str] = ("connector_id",)) -> DataFrame:
    """``(target, source '$.field', type)`` per field. ``first``: the
    first record's fields (as the reference); ``all``: every record, types
    widened long < double < string (boolean with anything else -> string);
    JSON nulls don't count, a field that has no other value is a string."""
    group = list(group)
    ft = field_types(records, group)
    if mode == "first":
        first = (ft.select(*group, F.struct("page_idx", "pos").alias("o"))
                 .groupBy(*group).agg(F.min("o").alias("o")))
        ft = ft.join(first, group).filter(F.struct("page_idx", "pos") == F.col("o")).drop("o")
        out = ft.select(*group, "field", "type")
    else:
        rank = F.create_map(*[F.lit(x) for kv in WIDEN_RANK.items() for x in kv])
        typ = F.when(~F.col("is_null"), F.col("type"))
        g = ft.withColumn("type", typ).groupBy(*group, "field").agg(
            F.max(F.element_at(rank, F.col("type"))).alias("r"),
            F.count_distinct("type").alias("nt"),
            F.max((F.col("type") == "boolean").cast("int")).alias("hasb"))
        t = (F.when((F.col("hasb") == 1) & (F.col("nt") > 1), F.lit("string"))
              .when(F.col("r") == 1, "long").when(F.col("r") == 2, "double")
              .when(F.col("r") == 3, "boolean").otherwise("string"))
        out = g.select(*group, "field", t.alias("type"))
    return out.select(*group, F.col("field").alias("target"),
                      F.concat(F.lit("$."), F.col("field")).alias("source"), "type")


def mappings_from_schema(schemas: DataFrame, schema_col: str = "record_schema") -> DataFrame:
    """Mappings from a declared record schema ``{"properties": {name:
    {"type": ...}}}``: integer/long -> long, number/double -> double,
    boolean, decimal, else string."""
    props = F.from_json(F.get_json_object(F.col(schema_col), "$.properties"), "map<string,string>")
    e = schemas.select("*", F.explode(props).alias("field", "p"))
    t = F.lower(F.coalesce(F.get_json_object("p", "$.type"), F.lit("string")))
    typ = (F.when(t.isin("integer", "long"), "long").when(t.isin("number", "double"), "double")
            .when(t == "boolean", "boolean").when(t == "decimal", "decimal").otherwise("string"))
    return e.select(*[c for c in schemas.columns if c != schema_col], F.col("field").alias("target"),
                    F.concat(F.lit("$."), "field").alias("source"), typ.alias("type"))


def infer_schema(records: DataFrame, group: Sequence[str] = (), max_depth: int | None = None) -> DataFrame:
    """Record schema, one row per path (nested objects recursed): type
    (``object`` and ``array`` for containers, scalars widened as in I1),
    the number of records that have it, and an example value (the smallest)."""
    group = list(group)
    walked = walk_paths(records, max_depth=max_depth, group=group)
    k = vkind(F.col("v"))
    rank = F.create_map(*[F.lit(x) for kv in {**WIDEN_RANK, "object": 5, "array": 6}.items() for x in kv])
    typ = F.when(k.isin("object", "array"), k).when(k != "null", _type_col(k))
    scalar = F.when(k == "null", F.lit("null")).when(~k.isin("object", "array"), jtext(F.col("v"), k))
    g = walked.select(*group, "path", typ.alias("t"), scalar.alias("s")).groupBy(*group, "path").agg(
        F.count(F.lit(1)).alias("n_records"), F.min("s").alias("sample"), F.max(F.element_at(rank, F.col("t"))).alias("r"),
        F.count_distinct("t").alias("nt"), F.max((F.col("t") == "boolean").cast("int")).alias("hasb"))
    widened = (F.when((F.col("hasb") == 1) & (F.col("nt") > 1) & (F.col("r") < 5), "string").when(F.col("r") == 1, "long").when(F.col("r") == 2, "double")
                .when(F.col("r") == 3, "boolean").when(F.col("r") == 5, "object").when(F.col("r") == 6, "array").otherwise("string"))
    return g.select(*group, "path", widened.alias("type"), "n_records", "sample")


def nested_schema(records: DataFrame, group: Sequence[str] = ("connector_id",), max_depth: int | None = None) -> DataFrame:
    """I3 in its nested shape: per group one JSON text ``{"type": "object",
    "properties": {name: {"type", "example"} | {"type": "object", "properties"}}}``.

    All records are merged: types widen as in I1, a field that is an object in
    any record is an object with the properties of all of them, an array is a
    string; the example is the smallest text (of an array its JSON, of JSON null
    ``null``). Records that are no objects have no properties; a group of only
    such records has an empty object. A name that holds a dot can't be told from
    two names in a path: such fields are left out.

    Fields are first merged by path (partial aggregation over all records);
    what is folded, level by level from the deepest, is one row a path."""
    keys, group = list(group), list(group)
    if not group:
        records, group = records.withColumn("__all", F.lit(1)), ["__all"]
    walked = walk_paths(records, max_depth=max_depth, group=group).filter(~F.col("path").contains("[*]"))
    k = vkind(F.col("v"))
    typ = F.when(k == "object", "object").when(k == "array", "string").when(k != "null", _type_col(k))
    text = F.when(k == "null", F.lit("null")).when(k == "array", F.to_json("v")).when(k != "object", jtext(F.col("v"), k))
    rank = F.create_map(*[F.lit(x) for kv in {**WIDEN_RANK, "object": 5}.items() for x in kv])
    g = walked.select(*group, "path", typ.alias("t"), text.alias("s")).groupBy(*group, "path").agg(
        F.max(F.element_at(rank, F.col("t"))).alias("r"), F.count_distinct("t").alias("nt"), F.max((F.col("t") == "boolean").cast("int")).alias("hasb"),
        F.min(F.when(F.col("s") != "null", F.col("s"))).alias("s"))
    kind = (F.when(F.col("r") == 5, "object").when((F.col("hasb") == 1) & (F.col("nt") > 1), "string").when(F.col("r") == 1, "long")
             .when(F.col("r") == 2, "double").when(F.col("r") == 3, "boolean").otherwise("string"))
    steps = F.split("path", r"\.")
    depth = F.size(steps) - 1
    staged = scratch_path(records.sparkSession, "schema-paths")
    g.select(*group, "path", depth.alias("depth"), F.element_at(steps, -1).alias("name"), F.regexp_replace("path", r"\.[^.]*$", "").alias("parent"),
             kind.alias("type"), F.coalesce("s", F.lit("null")).alias("s")).write.parquet(staged)
    paths = records.sparkSession.read.parquet(staged)
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    plain = F.col("type").isin("long", "double", "boolean")
    scalar = F.concat(F.lit('{"type":"'), F.col("type"), F.lit('","example":'), F.when(plain, F.col("s")).otherwise(quoted(F.col("s"))), F.lit("}"))
    below = None
    for level in range(paths.agg(F.max("depth")).first()[0] or 0, 0, -1):
        here = paths.filter(F.col("depth") == level)
        here = here.withColumn("__props", F.lit(None).cast("string")) if below is None else null_safe_join(here, below.withColumnRenamed("parent", "path"), [*group, "path"], "left")
        node = F.when(F.col("type") == "object", F.concat(F.lit('{"type":"object","properties":'), F.coalesce("__props", F.lit("{}")), F.lit("}"))).otherwise(scalar)
        entry = F.concat(quoted(F.col("name")), F.lit(":"), node)
        below = here.groupBy(*group, "parent").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("__props"))
    groups = records.select(*group).distinct()
    groups = groups.withColumn("__props", F.lit(None).cast("string")) if below is None else null_safe_join(groups, below.drop("parent"), group, "left")
    return groups.select(*keys, F.concat(F.lit('{"type":"object","properties":'), F.coalesce("__props", F.lit("{}")), F.lit("}")).alias("record_schema"))


def detect_record_array(pages: DataFrame, body_col: str = "body", max_depth: int | None = None) -> DataFrame:
    """I4: path of the record array of each body: the first array of objects
    in a depth-first walk that tries ``results, data, items, records, list``
    first at each level, then the other keys in document order.

    Candidates are kept as an array in the row, each with its rank vector
    (the place of every step among its siblings), so nothing is joined or
    shuffled; the smallest vector is the first in the walk. The walk goes as
    deep as the deepest body (one aggregate finds that), or to ``max_depth``.
    Keys keep document order through ``from_json(.., map<string,string>)``."""
    pref = F.array(*[F.lit(k) for k in PREFERRED_ARRAY_KEYS])
    big = len(PREFERRED_ARRAY_KEYS)
    depth = max_depth_of(pages, F.col(body_col)) if max_depth is None else max_depth
    keys = pages.columns
    none = F.array().cast("array<struct<rank:array<int>,path:string>>")

    def is_obj_array(txt: Column) -> Column:
        return F.ltrim(txt).startswith("[") & (vkind(F.try_variant_get(F.try_parse_json(txt), "$[0]", "variant")) == "object")

    def hits(nodes: Column) -> Column:
        return F.transform(F.filter(nodes, lambda n: F.coalesce(is_obj_array(n["txt"]), F.lit(False))), lambda n: F.struct(n["rank"].alias("rank"), n["path"].alias("path")))

    def children(n: Column) -> Column:
        def child(e: Column, i: Column) -> Column:
            at = F.array_position(pref, e["key"]).cast("int")
            return F.struct(F.concat(n["rank"], F.array(F.when(at > 0, at - 1).otherwise(i + big))).alias("rank"),
                            F.concat(n["path"], F.lit("."), e["key"]).alias("path"), e["value"].alias("txt"))
        entries = F.map_entries(F.from_json(n["txt"], "map<string,string>"))
        return F.when(F.ltrim(n["txt"]).startswith("{"), F.coalesce(F.transform(entries, child), F.array().cast(NODES))).otherwise(F.array().cast(NODES))

    root = F.array(F.struct(F.array().cast("array<int>").alias("rank"), F.lit("$").alias("path"), F.col(body_col).alias("txt")))
    cur = pages.select(*keys, root.cast(NODES).alias("__nodes"), none.alias("__found"))
    for level in range(depth + 1):
        found = cur.select(*keys, "__nodes", F.concat("__found", hits(F.col("__nodes"))).alias("__found"))
        cur = found if level == depth else found.select(*keys, F.flatten(F.transform("__nodes", children)).alias("__nodes"), "__found")
    return cur.select(*keys, F.array_min("__found")["path"].alias("record_path"))


NODES = "array<struct<rank:array<int>,path:string,txt:string>>"


def envelope_fields(pages: DataFrame, record_path: str | Column, body_col: str = "body") -> DataFrame:
    """The envelope = the keys beside the record array, in the object
    that holds it (document order), as an array; none for a root array."""
    rp = F.regexp_replace(F.lit(record_path) if isinstance(record_path, str) else record_path, r"\[.*$", "")
    leaf = F.element_at(F.split(rp, r"\."), -1)
    parent = F.regexp_replace(rp, r"\.[^.]+$", "")
    holder = F.when(parent == "$", F.col(body_col)).otherwise(F.call_function("get_json_object", F.col(body_col), parent))
    keys = F.map_keys(F.from_json(holder, "map<string,string>"))
    return pages.select("*", F.when(rp != "$", F.filter(keys, lambda k: k != leaf)).otherwise(F.array().cast("array<string>")).alias("envelope"))
