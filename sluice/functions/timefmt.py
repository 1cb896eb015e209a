"""Datetime parsing/formatting by named format (T13-T15) and overlap text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.jsonpath import (
    DAHUA_UTC, ISO_INSTANT_RE, MEIYA_DATETIME, _c, is_number, jtext, vkind,
)

__all__ = [
    "parse_instant", "format_instant", "format_time",
    "overlap_seconds", "overlap_problem", "overlap_interval", "iso_instant_text",
]



def parse_instant(v, source_format: str | None = None, kind: Column | None = None,
                  text: Column | None = None) -> Column:
    """VARIANT value -> TIMESTAMP. JSON numbers are epoch ms whatever the
    format; text is parsed by ``source_format`` (default ISO instant); failure -> NULL."""
    v = _c(v)
    k = vkind(v) if kind is None else kind
    t = jtext(v, k) if text is None else text
    fmt = (source_format or "").strip() or "iso_instant"
    if fmt == "epoch_ms":
        txt = F.when(t.rlike(r"^[+-]?[0-9]+$"), F.timestamp_millis(t.try_cast("bigint")))
    elif fmt == "dahua_utc":
        txt = F.try_to_timestamp(t, F.lit(DAHUA_UTC))
    elif fmt == "meiya_datetime":
        txt = F.when(F.length(t) == 19, F.try_to_timestamp(t, F.lit(MEIYA_DATETIME)))
    else:
        txt = F.when(t.rlike(ISO_INSTANT_RE), F.try_to_timestamp(F.upper(t)))
    return (
        F.when(k == "null", F.lit(None).cast("timestamp"))
        .when(is_number(k), F.timestamp_millis(F.try_variant_get(v, "$", "bigint")))
        .otherwise(txt)
    )


def iso_instant_text(ts) -> Column:
    """ISO-8601 instant text with 0, 3 or 6 fraction digits (as Java prints)."""
    ts = _c(ts)
    frac = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(ts.isNotNull(), F.concat(
        base,
        F.when(frac == 0, F.lit(""))
        .when(F.pmod(frac, F.lit(1000)) == 0, F.concat(F.lit("."), F.lpad((frac / 1000).cast("int").cast("string"), 3, "0")))
        .otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))),
        F.lit("Z"),
    ))


def format_instant(ts, target_format: str | None = None) -> Column:
    """TIMESTAMP -> text in ``target_format`` (default ISO instant)."""
    ts = _c(ts)
    fmt = (target_format or "").strip() or "iso_instant"
    if fmt == "epoch_ms":
        return F.unix_millis(ts).cast("string")
    if fmt == "dahua_utc":
        return F.date_format(ts, DAHUA_UTC)
    if fmt == "meiya_datetime":
        return F.date_format(ts, MEIYA_DATETIME)
    return iso_instant_text(ts)


def format_time(ts, time_format: str | None = None) -> Column:
    """Request-parameter time text (P10/P12); same names as ``format_instant``."""
    return format_instant(ts, time_format)


def overlap_seconds(text) -> Column:
    """Overlap text -> seconds. ``Ns``/``Nm``/``Nh`` (case-insensitive,
    trimmed); blank/NULL -> 0; any other suffix -> 300; a bad number -> NULL
    (the caller reports it)."""
    t = F.lower(F.trim(_c(text)))
    num = F.regexp_extract(t, r"^([+-]?[0-9]+)[smh]$", 1)
    n = F.when(num != "", num.try_cast("bigint"))
    return (
        F.when(t.isNull() | (t == ""), F.lit(0).cast("bigint"))
        .when(t.endswith("m"), n * 60)
        .when(t.endswith("h"), n * 3600)
        .when(t.endswith("s"), n)
        .otherwise(F.lit(300).cast("bigint"))
    )


def overlap_problem(text) -> Column:
    """What is wrong with an overlap text whose number can't be read
    (``500ms``); NULL if nothing is."""
    t = _c(text)
    return F.when(t.isNotNull() & overlap_seconds(t).isNull(),
                  F.concat(F.lit("overlap must be a whole number with s, m or h: "), t))


def overlap_interval(text) -> Column:
    """Overlap as ``INTERVAL DAY TO SECOND``."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), overlap_seconds(text))
