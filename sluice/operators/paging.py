"""Page selection, stop rules, failures and page logs.

All rules are per-page boolean columns; a chain is cut at its first stopping
page with a grouped ``min`` per (connector, run) joined back -- an aggregate
that combines map-side, not a window over the run.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.jsonpath import jtext, parse_body, vget, vkind
from sluice.operators.extract import page_records_array
from sluice.operators.requests import link_next

RUN = ["connector_id", "run_id"]
# Default stop rules per strategy.
CURSOR_STOP_DEFAULT = ("empty_page", "empty_cursor", "has_more_false")
LINK_STOP_DEFAULT = ("no_next_link", "empty_page")


def page_size_col(body: Column, input_root: str) -> Column:
    """Records on a page: array length, 1 for a non-array value, 0 for none."""
    return F.coalesce(F.size(page_records_array(body, input_root)), F.lit(0))


def cursor_stop_rule(v: Column, n: Column, headers: Column, cursor_path: str | None, has_more_path: str | None,
                     stop_when: Sequence[str] | None = None) -> Column:
    """G1 on a parsed body: OR of ``empty_page``, ``empty_cursor`` (NULL/blank
    next cursor) and ``has_more_false`` (exactly false; missing never stops)."""
    rules = [r.lower() for r in (stop_when or CURSOR_STOP_DEFAULT)]
    cur = jtext(vget(v, cursor_path)) if cursor_path else F.lit(None).cast("string")
    hm = vget(v, has_more_path) if has_more_path else F.lit(None).cast("variant")
    hm_false = (vkind(hm) == "boolean") & (~F.try_variant_get(hm, "$", "boolean"))
    stop = F.lit(False)
    if "empty_page" in rules:
        stop = stop | (n == 0)
    if "empty_cursor" in rules:
        stop = stop | cur.isNull() | (F.trim(cur) == "")
    if "has_more_false" in rules:
        stop = stop | F.coalesce(hm_false, F.lit(False))
    return stop


def link_stop_rule(v: Column, n: Column, headers: Column, cursor_path: str | None = None, has_more_path: str | None = None,
                   stop_when: Sequence[str] | None = None) -> Column:
    """``no_next_link`` / ``empty_page``."""
    rules = [r.lower() for r in (stop_when or LINK_STOP_DEFAULT)]
    stop = F.lit(False)
    if "empty_page" in rules:
        stop = stop | (n == 0)
    if "no_next_link" in rules:
        stop = stop | link_next(headers).isNull()
    return stop


def cursor_stop(pages: DataFrame, input_root: str, cursor_path: str | None,
                has_more_path: str | None, stop_when: Sequence[str] | None = None) -> DataFrame:
    """G1: per page ``n_records`` and ``stop``."""
    n = page_size_col(F.col("body"), input_root)
    stop = cursor_stop_rule(parse_body(F.col("body")), n, F.col("headers"), cursor_path, has_more_path, stop_when)
    return pages.select("*", n.alias("n_records"), stop.alias("stop"))


def link_stop(pages: DataFrame, input_root: str, stop_when: Sequence[str] | None = None) -> DataFrame:
    """Per page ``n_records`` and ``stop``."""
    n = page_size_col(F.col("body"), input_root)
    return pages.select("*", n.alias("n_records"), link_stop_rule(F.lit(None), n, F.col("headers"), stop_when=stop_when).alias("stop"))


def page_stop(pages: DataFrame, input_root: str, total_path: str | None, page_size: Column,
              page_start: Column) -> DataFrame:
    """Page/offset strategies: an empty page stops; with a total (read once,
    from the first page that has it) the page numbered ``>= total_pages``
    is the last one."""
    v = parse_body(F.col("body"))
    n = page_size_col(F.col("body"), input_root)
    tot = F.try_variant_get(vget(v, total_path), "$", "int") if total_path else F.lit(None).cast("int")
    return pages.select("*", n.alias("n_records"), tot.alias("__total"), page_size.alias("__ps"),
                        page_start.alias("__pstart"))


def _cap(max_pages: int | Column | None) -> Column:
    """The connector's own page limit; NULL: none."""
    return max_pages if isinstance(max_pages, Column) else F.lit(max_pages).cast("int")


def truncate_chain(flagged: DataFrame, max_pages: int | Column | None = None, stop_col: str = "stop") -> DataFrame:
    """Keep pages up to and including the first stopping page of each
    (connector, run). Only a connector's own ``max_pages`` cuts further, and
    ``run_truncated`` says so on every page of that run."""
    ends = flagged.groupBy(*RUN).agg(F.min(F.when(F.col(stop_col), F.col("page_idx"))).alias("__stop"),
                                     F.max("page_idx").alias("__last"))
    j = flagged.withColumn("__cap", _cap(max_pages)).join(ends, RUN, "left")
    end = F.coalesce("__stop", "__last")
    cut = F.coalesce(end >= F.col("__cap"), F.lit(False))
    keep = (F.col("page_idx") <= end) & F.coalesce(F.col("page_idx") < F.col("__cap"), F.lit(True))
    return j.filter(keep).withColumn("run_truncated", cut).drop("__stop", "__last", "__cap")


def truncate_pages_by_total(flagged: DataFrame, max_pages: int | None = None) -> DataFrame:
    """G3 for page/offset: stop index = least(first empty page,
    the page where ``page_number >= ceil(total / page_size)`` given the
    first page carrying a total, the connector's ``max_pages`` - 1)."""
    g = flagged.groupBy(*RUN).agg(
        F.max("page_idx").alias("__last"),
        F.min(F.when(F.col("n_records") == 0, F.col("page_idx"))).alias("__empty"),
        F.min(F.when(F.col("__total").isNotNull(), F.col("page_idx"))).alias("__j0"),
        F.min_by("__total", F.when(F.col("__total").isNotNull(), F.col("page_idx"))).alias("__tot"),
        F.first("__ps").alias("__ps0"), F.first("__pstart").alias("__pst"))
    tp = F.when((F.col("__ps0") > 0) & F.col("__tot").isNotNull(), F.ceil(F.col("__tot") / F.col("__ps0")))
    by_total = F.greatest(F.col("__j0"), tp - F.col("__pst"))
    end = F.coalesce(F.least(F.col("__empty"), by_total), F.col("__last"))
    s = g.select(*RUN, F.least(end, _cap(max_pages) - 1).alias("__stopidx"),
                 F.coalesce(end >= _cap(max_pages), F.lit(False)).alias("run_truncated"))
    return (flagged.join(s, RUN, "left").filter(F.col("page_idx") <= F.col("__stopidx"))
            .drop("__stopidx", "__total", "__ps", "__pstart"))


def failure_reason(broken: Column) -> Column:
    """Why a page failed: transport error, status >= 400, truncated body, or a
    body that is not JSON (``broken``); NULL: it did not."""
    return (F.when(F.col("error").isNotNull(), F.concat(F.lit("HTTP request failed: "), F.col("error")))
             .when(F.col("status") >= 400, F.concat(F.lit("HTTP status "), F.col("status").cast("string")))
             .when(F.coalesce(F.col("truncated"), F.lit(False)), F.lit("response body truncated"))
             .when(broken, F.lit("response body is not JSON")))


def page_failures(pages: DataFrame) -> DataFrame:
    """One row per failed run with its first failing page and the reason."""
    body = F.col("body")
    reason = failure_reason(body.isNotNull() & (F.trim(body) != "") & F.try_parse_json(body).isNull())
    # A failed count request fails its run too.
    bad = pages.filter(F.col("kind").isin("page", "count")).select(*RUN, "page_idx", reason.alias("reason")) \
        .filter(F.col("reason").isNotNull())
    return bad.groupBy(*RUN).agg(F.min("page_idx").alias("failed_page"),
                                 F.min_by("reason", "page_idx").alias("reason"))


def drop_failed_runs(df: DataFrame, failures: DataFrame) -> DataFrame:
    """No partial output from a failed run."""
    return df.join(failures.select(*RUN), RUN, "left_anti")


def page_log(pages: DataFrame, input_root: str) -> DataFrame:
    """Page number, record count and duration per landed page."""
    return pages.filter(F.col("kind") == "page").select(
        *RUN, "page_idx", page_size_col(F.col("body"), input_root).alias("n_records"),
        F.col("duration_ms"))
