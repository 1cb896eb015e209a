"""Request planning: connectors (+ state, + count pages) -> requests.

Page-number and offset strategies are planned up front as
``explode(sequence(first, last))`` -- every page request is independent, so
the plan is a table that partitions over executors. Cursor and link chains
are sequential by nature: the request for page i+1 is derived from landed
page i by an equi-join on (connector, run, page_idx) -- never a window over a
whole run -- and parallelism comes from many connectors at once.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.jsonpath import parse_body, vget, vkind, jtext
from sluice.functions.timefmt import format_time, overlap_seconds

RUN = ["connector_id", "run_id"]
DEFAULT_PAGE_SIZE = 100


def total_pages(total: Column, page_size: Column) -> Column:
    """``ceil(total / page_size)``; NULL when total is NULL or size <= 0."""
    return F.when(total.isNotNull() & (page_size > 0), F.ceil(total / page_size).cast("int"))


def last_page(page_start: Column, tp: Column, max_pages: Column) -> Column:
    """The loop stops after page p when ``p >= total_pages``, so the last
    page is ``greatest(page_start, total_pages)``; at most the connector's
    own ``max_pages`` pages. Unknown total: up to ``max_pages`` (empty pages
    stop it), or the first page alone where the connector sets no limit (the
    plan is then open-ended: each landed page asks for the next)."""
    cap = page_start + max_pages - 1
    return F.when(tp.isNull(), F.coalesce(cap, page_start)).otherwise(F.least(F.greatest(page_start, tp), cap))


def plan_pages(connectors: DataFrame, total_col: str = "total") -> DataFrame:
    """One row per page request. Needs connector_id, strategy,
    page_start, page_size, max_pages, page_value_type (optional) and a total
    column (NULL when unknown). Adds page, page_param_value, limit."""
    c = connectors
    ps = F.coalesce(F.col("page_size"), F.lit(DEFAULT_PAGE_SIZE))
    start = F.coalesce(F.col("page_start"), F.lit(1))
    mx = F.col("max_pages")
    tp = total_pages(F.col(total_col), ps)
    last = last_page(start, tp, mx)
    pvt = F.lower(F.coalesce(F.col("page_value_type"), F.lit(""))) if "page_value_type" in c.columns else F.lit("")
    offset_mode = (F.lower(F.col("strategy")) == "offset_limit") | (pvt == "skip_limit")
    out = c.select("*", F.explode(F.sequence(start, last)).alias("page"))
    return out.select(
        "*",
        (F.col("page") - start).alias("page_idx"),
        F.when(offset_mode, (F.col("page") - start) * ps).otherwise(F.col("page")).alias("page_param_value"),
        ps.alias("limit"),
        (tp.isNull() & mx.isNull()).alias("open_ended"),
    )


def separate_totals(pages: DataFrame, total_path: str = "$.total") -> DataFrame:
    """Totals read from ``kind='count'`` responses, one per (connector, run)."""
    cnt = pages.filter(F.col("kind") == "count")
    v = vget(parse_body(F.col("body")), total_path)
    k = vkind(v)
    t = F.when(k.isin("integer", "float"), F.try_variant_get(v, "$", "int")) \
         .when((k == "string") & jtext(v, k).rlike(r"^[+-]?[0-9]+$"), jtext(v, k).try_cast("int"))
    return cnt.select(*RUN, t.alias("total"))


def next_requests_cursor(pages: DataFrame, cursor_path: str, first_page_omit: bool = True,
                         input_root: str = "$.data") -> DataFrame:
    """P5: the cursor each page was requested with = the next-cursor read
    from the previous landed page (page 0: NULL if the first page omits
    it, else ``''``). A self equi-join on page_idx - 1, not a run-wide window."""
    p = pages.filter(F.col("kind") == "page").select(*RUN, "page_idx", "body")
    nxt = p.select(*RUN, (F.col("page_idx") + 1).alias("page_idx"),
                   jtext(vget(parse_body(F.col("body")), cursor_path)).alias("cursor"))
    j = p.select(*RUN, "page_idx").join(nxt, [*RUN, "page_idx"], "left")
    first = F.lit(None).cast("string") if first_page_omit else F.lit("")
    return j.select(*RUN, "page_idx",
                    F.when(F.col("page_idx") == 0, first).otherwise(F.coalesce("cursor", F.lit(""))).alias("cursor"))


# Fixed value: the Link-header entry pattern (URL in angle brackets, then
# parameters, among them the relation).
LINK_RE = r'(?i)<\s*([^>]+)\s*>\s*;(?:.*;)?\s*rel\s*=\s*"?([^",;]+)"?'


def link_next(headers: Column, header: str = "Link", rel: str = "next") -> Column:
    """URL of the entry of the ``Link`` header whose relation equals
    ``rel`` (header name and relation case-insensitive; entries split on
    commas); NULL when none."""
    link = F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == header.lower())), 0)
    found = F.filter(F.split(link, ","), lambda e: F.lower(F.trim(F.regexp_extract(e, LINK_RE, 2))) == rel.strip().lower())
    return F.when(F.size(found) > 0, F.trim(F.regexp_extract(F.get(found, 0), LINK_RE, 1)))


def next_requests_link(pages: DataFrame) -> DataFrame:
    """Request URL of each page: page 0 = configured URL (NULL here),
    later pages = the next link of the previous page."""
    p = pages.filter(F.col("kind") == "page").select(*RUN, "page_idx", "headers")
    nxt = p.select(*RUN, (F.col("page_idx") + 1).alias("page_idx"), link_next(F.col("headers")).alias("url"))
    return p.select(*RUN, "page_idx").join(nxt, [*RUN, "page_idx"], "left")


def assemble_url(url: Column, configured: Column, paging: Column) -> Column:
    """``url`` + ``?``/``&`` + ``k=v`` joined by ``&`` (values not
    encoded); paging parameters overwrite configured ones; keys sorted.
    Needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` (set by the session)."""
    m = F.map_concat(F.coalesce(configured, F.create_map().cast("map<string,string>")),
                     F.coalesce(paging, F.create_map().cast("map<string,string>")))
    q = F.array_join(F.transform(F.array_sort(F.map_entries(m)),
                                 lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), "&")
    sep = F.when(F.instr(url, "?") > 0, F.lit("&")).otherwise(F.lit("?"))
    return F.when(F.size(m) == 0, url).otherwise(F.concat(url, sep, q))


def body_type(explicit: Column, method: Column, has_body: Column, has_form: Column) -> Column:
    """GET/HEAD send no body; else explicit type > json if a body
    template > form-urlencoded if form fields > none."""
    m = F.upper(F.coalesce(method, F.lit("GET")))
    e = F.lower(F.trim(explicit))
    return (F.when(m.isin("GET", "HEAD"), F.lit("none"))
             .when(e.isNotNull() & (e != ""), e)
             .when(has_body, F.lit("json"))
             .when(has_form, F.lit("form-urlencoded"))
             .otherwise(F.lit("none")))


def timestamp_param(ts: Column, overlap: Column, time_format: str | None) -> Column:
    """P10: ``watermark - overlap`` as request text; NULL without watermark."""
    eff = ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), overlap_seconds(overlap))
    return format_time(eff, time_format)


def since_id_value(last_id: Column) -> Column:
    """Body form of ``since_id``: a JSON number when the id parses as a
    long, else a JSON string (query form is the text itself)."""
    n = F.when(last_id.rlike(r"^[+-]?[0-9]+$"), last_id.try_cast("bigint"))
    return F.when(last_id.isNull(), F.lit(None)).when(n.isNotNull(), n.cast("string")) \
        .otherwise(F.to_json(F.array(last_id)).substr(F.lit(2), F.length(F.to_json(F.array(last_id))) - 2))


# ---- P8: body composition (JSON template + values at dot paths) -------------

def compose_body(template: Column, values: dict[str, Column]) -> Column:
    """Set each value at its dot path in the JSON template, creating
    objects on the way (existing keys keep their place). An Arrow-batched
    ``pandas_udf`` over small per-request documents: the only Python helper
    on the request path. Values travel as one JSON object keyed by path, so
    their JSON types are kept."""
    from sluice.functions.pyhelpers import compose_json
    vals = F.to_json(F.struct(*[c.alias(p) for p, c in values.items()]), {"ignoreNullFields": "false"})
    return compose_json(template, vals)
