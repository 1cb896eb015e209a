"""API catalogue: operations of many OpenAPI / Swagger documents.

``specs(spec_id, doc)`` holds one JSON document per row. References and
``allOf`` are resolved once per document by a small Arrow-batched helper
(O6); operations are then exploded with ``from_json(.., map<string,string>)``
(document order kept) and every later step is a column expression on the row
of its operation: no join, no grouping.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.pyhelpers import resolve_paths

# Method order, success codes, and pagination parameter names
# (lower-cased, '-' read as '_'), each list in priority order.
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
SUCCESS_CODES = ("200", "201", "202", "204", "default")
PAGE_NAMES = ("page", "page_number", "pagenumber", "page_no", "pagenum")
PAGE_SIZE_NAMES = ("page_size", "pagesize", "per_page", "perpage", "size", "limit")
OFFSET_NAMES = ("offset", "skip")
LIMIT_NAMES = ("limit",)
CURSOR_NAMES = ("cursor", "page_token", "pagetoken", "next_token", "nexttoken", "after")
HAS_MORE_NAMES = ("hasmore", "has_more")
NEXT_CURSOR_NAMES = ("nextcursor", "next_cursor", "nextpagetoken", "next_page_token", "nexttoken", "next_token", "next")
TOTAL_NAMES = ("total", "totalcount", "total_count", "count")
SLUG_PREFIX, SLUG_MAX = "openapi-", 48


# Objects beside the fields of an envelope that may hold paging fields, in order.
CONTAINERS = ("meta", "pagination", "page")
MAP = "map<string,string>"


def _j(col: Column, path: str) -> Column:
    return F.get_json_object(col, path)


def _object(text: Column) -> Column:
    """The fields of a JSON object in document order; no object: none."""
    return F.coalesce(F.when(F.ltrim(text).startswith("{"), F.from_json(text, MAP)), F.create_map().cast(MAP))


def _plain(text: Column) -> Column:
    """A field's text; JSON null and blank are missing."""
    return F.when(~text.rlike("^ *$|^null$"), text)


def server_url(doc: Column) -> Column:
    """O2: the first server with a URL, else ``scheme://host + basePath``
    (Swagger 2, first scheme, default http); one trailing slash removed."""
    listed = F.transform(F.from_json(_j(doc, "$.servers"), "array<struct<url:string>>"), lambda s: s["url"])
    oas3 = F.get(F.filter(listed, lambda u: F.coalesce(F.trim(u) != "", F.lit(False))), 0)
    host = _plain(_j(doc, "$.host"))
    sw = F.concat(F.coalesce(_j(doc, "$.schemes[0]"), F.lit("http")), F.lit("://"), host, F.coalesce(_j(doc, "$.basePath"), F.lit("")))
    return F.regexp_replace(F.coalesce(oas3, sw, F.lit("")), "/$", "")


def join_url(server: Column, path: Column) -> Column:
    """O2: server and path; an absolute path stays, a bare one gets a slash."""
    return (F.when((F.trim(server) == "") | path.rlike("^https?://"), path)
             .when(path.startswith("/"), F.concat(F.regexp_replace(server, "/$", ""), path))
             .otherwise(F.concat(F.regexp_replace(server, "/$", ""), F.lit("/"), path)))


def operations(specs: DataFrame) -> DataFrame:
    """One row per (path, method) in method order: operation_id
    (default ``METHOD path``), summary (-> description -> id), server and full
    URL, the path-level and operation-level parameters and the operation, with
    references resolved (JSON text)."""
    p = specs.select("spec_id", server_url(F.col("doc")).alias("server"), resolve_paths(F.col("doc")).alias("paths"))
    p = p.select("spec_id", "server", F.posexplode(F.map_entries(_object(F.col("paths")))).alias("path_pos", "pe"))
    p = p.select("spec_id", "server", "path_pos", F.col("pe.key").alias("path"), _object(F.col("pe.value")).alias("item"))
    m = p.select("*", F.posexplode(F.array(*[F.lit(x) for x in HTTP_METHODS])).alias("method_pos", "m"))
    m = m.withColumn("op", F.element_at("item", F.col("m"))).filter(F.col("op").isNotNull() & (F.col("op") != "null"))
    oid = F.coalesce(_j(F.col("op"), "$.operationId"), F.concat(F.upper("m"), F.lit(" "), F.col("path")))
    return m.select(
        "spec_id", "path_pos", "method_pos", F.upper("m").alias("method"), "path", oid.alias("operation_id"),
        F.coalesce(_j(F.col("op"), "$.summary"), _j(F.col("op"), "$.description"), oid).alias("summary"),
        "server", join_url(F.col("server"), F.col("path")).alias("url"),
        F.coalesce(F.element_at("item", F.lit("parameters")), F.lit("[]")).alias("path_params"),
        F.coalesce(_j(F.col("op"), "$.parameters"), F.lit("[]")).alias("op_params"), "op")


PARAM = "array<struct<name:string,in:string,required:boolean,schema:string,type:string,example:string>>"
FIELD = "struct<name:string,place:string,type:string,example:string>"


def json_content(content: Column) -> Column:
    """The schema in the fields of a ``content``: of application/json, else of the first kind."""
    return _j(F.coalesce(F.element_at(content, F.lit("application/json")), F.get(F.map_values(content), 0)), "$.schema")


def _declared_field(name: Column, place: Column, schema: Column, typ: Column, example: Column) -> Column:
    """A field as the document declares it; ``_with_examples`` follows."""
    return F.struct(name.alias("name"), place.alias("place"), F.coalesce(_plain(_j(schema, "$.type")), _plain(typ), F.lit("string")).alias("type"), F.coalesce(_j(schema, "$.example"), example).alias("example"))


def _with_examples(fields: Column) -> Column:
    return F.transform(fields, lambda f: F.struct(f["name"].alias("name"), f["place"].alias("place"), example_type(f["type"]).alias("type"),
                                                  F.coalesce(f["example"], example_value(f["type"])).alias("example")))


def _properties(schema: Column) -> Column:
    """The properties of a JSON body's schema as fields of place ``body``."""
    none = F.lit(None).cast("string")
    return F.transform(F.map_entries(_object(_j(schema, "$.properties"))), lambda e: _declared_field(e["key"], F.lit("body"), e["value"], none, none))


def declared_fields(named: Column, body_schema: Column) -> Column:
    """O3: the fields a request is declared with, as an array of (name, place,
    type, example): the named parameters in order; ``query`` also takes path
    parameters; the properties of a JSON body, whether given as a body
    parameter or as a request body, have place ``body``."""
    place = lambda p: F.when(p["in"] == "header", F.lit("header")).otherwise(F.lit("query"))
    plain = F.transform(F.filter(named, lambda p: F.coalesce(p["in"].isin("query", "path", "header"), F.lit(False))),
                        lambda p: _declared_field(p["name"], place(p), p["schema"], p["type"], p["example"]))
    in_body = F.flatten(F.transform(F.filter(named, lambda p: F.coalesce(p["in"] == "body", F.lit(False))), lambda p: _properties(p["schema"])))
    return _with_examples(F.concat(plain, in_body, _properties(body_schema)))


def last_of_each(fields: Column) -> Column:
    """Of declared fields with one name and place the last, where the first stood."""
    key = lambda f: F.struct(f["name"], f["place"])
    last = F.map_from_entries(F.transform(fields, lambda f: F.struct(key(f), f)))          # LAST_WIN: a later entry replaces an earlier one
    return F.transform(F.array_distinct(F.transform(fields, key)), lambda k: F.element_at(last, k))


def with_request(ops: DataFrame) -> DataFrame:
    """O3: ``fields``, the request's fields: path-level parameters first, then
    operation-level ones; of one name and place the later stays, where the
    first stood. Each step's JSON is parsed once, into a column of its own."""
    none = F.array().cast(PARAM)
    d = ops.withColumns({"__named": F.concat(F.coalesce(F.from_json("path_params", PARAM), none), F.coalesce(F.from_json("op_params", PARAM), none)),
                         "__content": _j(F.col("op"), "$.requestBody.content")})
    d = d.withColumns({"__named": F.filter("__named", lambda p: F.coalesce(F.trim(p["name"]) != "", F.lit(False))), "__content": _object(F.col("__content"))})
    d = d.withColumn("__schema", json_content(F.col("__content")))
    d = d.withColumn("__declared", declared_fields(F.col("__named"), F.col("__schema")))
    return d.withColumn("fields", last_of_each(F.col("__declared"))).drop("__named", "__content", "__schema", "__declared")


def parameters(ops: DataFrame) -> DataFrame:
    """O3: one row per request field."""
    e = with_request(ops).select("spec_id", "method", "path", F.posexplode("fields").alias("i", "f"))
    return e.select("spec_id", "method", "path", "i", "f.name", "f.place", "f.type", "f.example")


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def example_type(typ: Column) -> Column:
    """Type aliases: int32/int64 -> integer, float/double -> number; other names stay."""
    return F.coalesce(_lookup({"int32": "integer", "int64": "integer", "float": "number", "double": "number"}, typ), typ)


def example_value(typ: Column) -> Column:
    """Example request values by type, as they stand in a request."""
    whole, fraction = dict.fromkeys(("integer", "long", "int32", "int64"), "1"), dict.fromkeys(("number", "float", "double"), "1.0")
    return F.coalesce(_lookup({**whole, **fraction, "boolean": "false"}, typ), F.lit("example"))


def with_response_schema(ops: DataFrame) -> DataFrame:
    """The schema of the first success response that has one."""
    d = ops.withColumn("__responses", _object(_j(F.col("op"), "$.responses")))
    d = d.withColumn("__found", F.filter(F.transform(F.array(*map(F.lit, SUCCESS_CODES)), lambda c: F.element_at("__responses", c)), lambda r: r.isNotNull()))
    d = d.withColumn("__found", F.transform("__found", lambda r: F.struct(_j(r, "$.schema").alias("direct"), _object(_j(r, "$.content")).alias("content"))))
    d = d.withColumn("__found", F.transform("__found", lambda r: F.coalesce(_plain(r["direct"]), json_content(r["content"]))))
    first = F.get(F.filter("__found", lambda x: x.isNotNull()), 0)
    return d.withColumn("response_schema", F.coalesce(first, F.lit("{}"))).drop("__responses", "__found")


def input_root(schema: Column) -> Column:
    """``$`` for an array, else the first property that is an array, else ``$``."""
    arrays = F.filter(F.map_entries(_object(_j(schema, "$.properties"))), lambda e: F.coalesce(_j(e["value"], "$.type") == "array", F.lit(False)))
    return F.when(F.coalesce(_j(schema, "$.type") == "array", F.lit(False)) | (F.size(arrays) == 0), F.lit("$")) \
            .otherwise(F.concat(F.lit("$."), F.get(arrays, 0)["key"]))


def record_fields(schema: Column, root: Column) -> Column:
    """Fields of a record with their types, as a map in document order."""
    items = F.when(root == "$", F.when(_j(schema, "$.type") == "array", _j(schema, "$.items")).otherwise(schema)) \
             .otherwise(_j(F.element_at(_object(_j(schema, "$.properties")), F.substring(root, 3, 1000000)), "$.items"))
    inner = F.when(_j(items, "$.type") == "array", _j(items, "$.items")).otherwise(items)
    return F.transform_values(_object(_j(inner, "$.properties")), lambda _, p: example_type(F.coalesce(_plain(_j(p, "$.type")), F.lit("string"))))


def envelope_of(schema: Column, root: Column) -> Column:
    """The fields beside the record array (none for a root array), each with its schema."""
    fields = _object(_j(schema, "$.properties"))
    return F.when(root == "$", F.create_map().cast(MAP)).otherwise(F.map_filter(fields, lambda k, _: F.concat(F.lit("$."), k) != root))


def with_response(ops: DataFrame) -> DataFrame:
    """response_schema, input_root, record_fields and envelope."""
    d = with_response_schema(ops)
    d = d.withColumn("input_root", input_root(F.col("response_schema")))
    return d.withColumns({"record_fields": record_fields(F.col("response_schema"), F.col("input_root")),
                          "envelope": envelope_of(F.col("response_schema"), F.col("input_root"))})


def _norm(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit("-"), F.lit("_"))


def _first_in(fields: Column, place: str, prio: tuple[str, ...]) -> Column:
    """The original name of the field that comes first in the priority list."""
    def of(n: str) -> Column:
        found = F.filter(fields, lambda f: (f["place"] == place) & (_norm(f["name"]) == n))
        return F.when(F.size(found) > 0, F.element_at(found, -1)["name"])
    return F.coalesce(*map(of, prio))


def path_by_names(envelope: Column, names: tuple[str, ...]) -> Column:
    """The path of the first envelope field with one of the names: a
    direct field, else one in ``meta``, ``pagination`` or ``page``."""
    def first(fields: Column) -> Column:
        return F.get(F.filter(F.map_keys(fields), lambda k: _norm(k).isin(*names)), 0)
    direct = F.concat(F.lit("$."), first(envelope))
    nested = []
    for c in CONTAINERS:
        held = F.element_at(envelope, F.lit(c))
        fields = _object(F.coalesce(F.when(F.ltrim(_j(held, "$.properties")).startswith("{"), _j(held, "$.properties")), held))
        nested.append(F.concat(F.lit(f"$.{c}."), first(fields)))
    return F.coalesce(direct, *nested)


def infer_pagination(ops: DataFrame) -> DataFrame:
    """GET operations only: ``offset_limit`` (offset/skip + limit),
    else ``cursor`` (a cursor-like query or body name), else
    ``page_page_size`` (a page name), else no strategy. Parameter names are
    matched lower-cased with ``-`` as ``_``, and returned as the document has
    them; fixed priority lists break ties."""
    d = with_response(with_request(ops.filter(F.col("method") == "GET")))
    f, env = F.col("fields"), F.col("envelope")
    d = d.withColumns({"__off": _first_in(f, "query", OFFSET_NAMES), "__lim": _first_in(f, "query", LIMIT_NAMES),
                       "__cq": _first_in(f, "query", CURSOR_NAMES), "__cb": _first_in(f, "body", CURSOR_NAMES),
                       "__page": _first_in(f, "query", PAGE_NAMES), "__size": _first_in(f, "query", PAGE_SIZE_NAMES)})
    cur = F.coalesce("__cq", "__cb")
    strategy = (F.when(F.col("__off").isNotNull() & F.col("__lim").isNotNull(), "offset_limit")
                 .when(cur.isNotNull(), "cursor").when(F.col("__page").isNotNull(), "page_page_size"))
    d = d.withColumn("strategy", strategy)
    s = F.col("strategy")
    paged = s.isin("offset_limit", "page_page_size")
    return d.select(
        "spec_id", "method", "path", "strategy",
        F.when((s == "cursor") & F.col("__cq").isNull(), "body").when(s.isNotNull(), "query").alias("location"),
        F.when(s == "offset_limit", "offset").when(s == "page_page_size", "page_number").alias("page_value_type"),
        F.when(s == "offset_limit", F.col("__off")).when(s == "page_page_size", F.col("__page")).when(s == "cursor", "page").alias("page_param"),
        F.when(s == "offset_limit", F.col("__lim")).when(s == "page_page_size", F.coalesce("__size", F.lit("page_size"))).when(s == "cursor", "page_size").alias("size_param"),
        F.when(s == "offset_limit", 0).when(s.isNotNull(), 1).alias("page_start"),
        F.when(s == "cursor", cur).when(s.isNotNull(), "cursor").alias("cursor_param"),
        F.when(s == "cursor", F.coalesce(path_by_names(env, NEXT_CURSOR_NAMES), F.lit("$.meta.nextCursor"))).when(s.isNotNull(), "$.meta.nextCursor").alias("cursor_response_path"),
        F.when(s == "cursor", F.coalesce(path_by_names(env, HAS_MORE_NAMES), F.lit("$.meta.hasMore"))).when(s.isNotNull(), "$.meta.hasMore").alias("has_more_path"),
        F.when(paged, path_by_names(env, TOTAL_NAMES)).alias("total_path"))


def connector_slug(operation_id: Column, method: Column, path: Column, suffix: Column | None = None) -> Column:
    """``openapi-`` + a lower-case slug of the operation id (else of method
    and path), cut to 48 (``operation`` if nothing is left), + a suffix. Slugs
    are names, not keys: cut ones may collide, so rows are keyed by document,
    method and path."""
    raw = F.coalesce(_plain(operation_id), F.concat(F.lower(method), F.lit("-"), F.regexp_replace(path, "^/", "")))
    s = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    base = F.concat(F.lit(SLUG_PREFIX), F.coalesce(F.when(s != "", F.left(s, F.lit(SLUG_MAX))), F.lit("operation")))
    return base if suffix is None else F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(base, F.lit("-"), suffix)).otherwise(base)


def filter_operations(ops: DataFrame, method: str | None = None, keyword: str | None = None) -> DataFrame:
    """By method and a case-insensitive keyword over method, path, summary and id."""
    out = ops
    if method and method.strip():
        out = out.filter(F.upper("method") == method.strip().upper())
    if keyword and keyword.strip():
        text = F.lower(F.concat_ws(" ", "method", "path", "summary", "operation_id"))
        out = out.filter(F.contains(text, F.lit(keyword.strip().lower())))
    return out
