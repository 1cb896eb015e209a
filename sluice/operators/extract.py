"""Record extraction from landed pages."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.jsonpath import is_json_null, jtext, parse_body, root_path, vkind
from sluice.plans.ordinal import null_safe_join, with_prefix_offset

RUN_KEYS = ("connector_id", "run_id")


def page_records_array(body_col, input_root: str | None = "$"):
    """Records of one body as ARRAY<VARIANT>: array -> its elements, any other
    non-null value -> one element, null/missing/blank/malformed -> NULL."""
    path, _ = root_path(input_root)
    r = F.try_variant_get(parse_body(body_col), path, "variant")
    k = vkind(r)
    return (F.when(k == "array", F.try_variant_get(r, "$", "array<variant>"))
             .when(~is_json_null(r), F.array(r)))


def extract_records(pages: DataFrame, input_root: str | None = "$.data",
                    keep: Sequence[str] = ("connector_id", "run_id", "page_idx")) -> DataFrame:
    """One row per record: ``keep`` columns, ``page_n`` (records on its
    page), ``pos`` within the page, ``rec`` VARIANT.

    The body is parsed once; the explode is a narrow generator, so extraction
    pipelines with the scan and the following projections."""
    path, _ = root_path(input_root)
    # Parse once into a staged column (referenced several times below, so it
    # is not re-inlined): one JSON parse per page, small generated code.
    staged = pages.select(*keep, F.try_variant_get(parse_body(F.col("body")), path, "variant").alias("__r"))
    staged = staged.select(*keep, "__r", vkind(F.col("__r")).alias("__k"))
    arr = (F.when(F.col("__k") == "array", F.try_variant_get("__r", "$", "array<variant>"))
            .when(F.col("__k") != "null", F.array(F.col("__r"))))
    sized = staged.select(*keep, arr.alias("__a"), F.size(arr).alias("page_n"))
    # An inner explode is preceded by a filter on its array, which moves to the
    # scan with the parse inlined at each mention; this one filters after it.
    return sized.select(*keep, "page_n", F.posexplode_outer("__a").alias("pos", "rec")).filter(F.col("pos").isNotNull())


def page_record_counts(pages: DataFrame, input_root: str | None = "$.data") -> DataFrame:
    """Records per page (0 for empty/none), for stop rules and page logs."""
    arr = page_records_array(F.col("body"), input_root)
    return pages.select(*RUN_KEYS, "page_idx", F.coalesce(F.size(arr), F.lit(0)).alias("n_records"))


def as_object(rec_col="rec"):
    """A non-object record becomes ``{"value": x}``."""
    rec = F.col(rec_col) if isinstance(rec_col, str) else rec_col
    return F.when(vkind(rec) == "object", rec).otherwise(
        F.to_variant_object(F.struct(rec.alias("value"))))


def with_record_index(records: DataFrame, run_keys: Sequence[str] = RUN_KEYS,
                      out: str = "record_index") -> DataFrame:
    """0-based index of each record across its run, ordered by
    (page_idx, pos): ``page_offset + pos``, from ``page_offsets``."""
    return index_with(records, page_offsets(records, run_keys), run_keys, out)


def page_offsets(records: DataFrame, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Records of a run before each page, one row per page. The page's size
    stands on its first record (``page_n``), so nothing is counted; a prefix
    sum over the small page table follows, in bounded windows."""
    if "page_n" in records.columns:
        counts = records.filter(F.col("pos") == 0).select(*run_keys, "page_idx", F.col("page_n").alias("__pn"))
    else:
        counts = records.groupBy(*run_keys, "page_idx").agg(F.count(F.lit(1)).alias("__pn"))
    return with_prefix_offset(counts, run_keys, "page_idx", "__pn", out="__poff").drop("__pn")


def index_with(rows: DataFrame, offsets: DataFrame, run_keys: Sequence[str] = RUN_KEYS,
               out: str = "record_index") -> DataFrame:
    """The run-wide index of rows that have (run keys, page_idx, pos)."""
    return (null_safe_join(rows, offsets, [*run_keys, "page_idx"])
                .withColumn(out, (F.col("__poff") + F.col("pos")).cast("bigint")).drop("__poff"))


def max_depth_of(df: DataFrame, json_text: Column) -> int:
    """The deepest nesting of objects and arrays in a column of JSON texts:
    one aggregate over the brackets outside of strings."""
    brackets = F.regexp_replace(F.regexp_replace(json_text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    steps = F.split(brackets, "")
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, state, lambda s, c: F.struct(
        (s["now"] + F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0)).alias("now"),
        F.greatest(s["most"], s["now"] + F.when(c.isin("{", "["), 1).otherwise(0)).alias("most")), lambda s: s["most"])
    return df.select(F.max(deepest).alias("d")).first()["d"] or 0


def walk_paths(records: DataFrame, rec_col: str = "rec", max_depth: int | None = None,
               group: Sequence[str] = ()) -> DataFrame:
    """Every object-field path and first-array-element path (``[*]``) of every
    record with its value: ``path``, ``v``.

    One linear chain of ``explode`` steps: each step keeps finished rows and
    replaces a pending container by itself (finished) plus its children
    (object fields; element 0 of an array, recorded as ``path[*]`` and walked
    as ``path[0]``). The chain is as long as the deepest record is deep (one
    aggregate finds that), or ``max_depth``."""
    group = list(group)
    if max_depth is None:
        max_depth = max_depth_of(records, F.to_json(F.col(rec_col)))
    node = "struct<rpath:string,wpath:string,v:variant,pending:boolean>"

    def is_container(v):
        return vkind(v).isin("object", "array")

    cur = records.select(*group, F.struct(
        F.lit("$").alias("rpath"), F.lit("$").alias("wpath"), F.col(rec_col).alias("v"),
        F.lit(True).alias("pending")).alias("n"))
    for _ in range(max_depth):
        n = F.col("n")
        k = vkind(n["v"])
        w = n["wpath"]
        kids_obj = F.transform(
            F.map_entries(F.try_variant_get(n["v"], "$", "map<string,variant>")),
            lambda e: F.struct(
                F.when(w == "$", F.concat(F.lit("$."), e["key"])).otherwise(F.concat(w, F.lit("."), e["key"])).alias("rpath"),
                F.when(w == "$", F.concat(F.lit("$."), e["key"])).otherwise(F.concat(w, F.lit("."), e["key"])).alias("wpath"),
                e["value"].alias("v"), is_container(e["value"]).alias("pending")))
        first = F.try_variant_get(n["v"], "$[0]", "variant")
        kids_arr = F.when(first.isNotNull(), F.array(F.struct(
            F.concat(w, F.lit("[*]")).alias("rpath"), F.concat(w, F.lit("[0]")).alias("wpath"),
            first.alias("v"), is_container(first).alias("pending"))))
        done_self = F.struct(n["rpath"], n["wpath"], n["v"], F.lit(False).alias("pending"))
        nxt = (F.when(~n["pending"], F.array(n))
                .when(k == "object", F.concat(F.array(done_self), kids_obj))
                .when(k == "array", F.concat(F.array(done_self), F.coalesce(kids_arr, F.array().cast(f"array<{node}>"))))
                .otherwise(F.array(done_self)))
        cur = cur.select(*group, F.explode_outer(nxt).alias("n"))       # never empty; an inner explode would evaluate the array again to see that
    return cur.select(*group, F.col("n.rpath").alias("path"), F.col("n.v").alias("v")).filter(F.col("path") != "$")


def path_catalogue(records: DataFrame, rec_col: str = "rec", max_depth: int | None = None,
                   group: Sequence[str] = ()) -> DataFrame:
    """The paths of ``walk_paths`` with the number of records containing
    each and the smallest scalar sample (JSON null samples as ``null``,
    containers have none). All records contribute; the result is a
    partial-aggregated ``groupBy(path)``."""
    group = list(group)
    out = walk_paths(records, rec_col, max_depth, group)
    kk = vkind(F.col("v"))
    sample = (F.when(kk == "null", F.lit("null"))
               .when(~kk.isin("object", "array"), jtext(F.col("v"), kk)))
    # A path occurs at most once per record (only element 0 of an array is
    # walked), so a plain count is the number of records containing it.
    # By sample first: that aggregate hashes, while the smallest text needs a
    # sort, which holds the distinct samples only and not each record's values.
    each = out.groupBy(*group, "path", sample.alias("sample")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*group, "path").agg(
        F.sum("n").alias("n_records"), F.min("sample").alias("sample"))
