"""Typed conversion of VARIANT values with an error flag.

Each conversion returns ``(value, bad)``: ``bad`` is true when a non-null
source value could not be converted, which is what the tolerant pipeline
(T17) routes to its error output. Conversions never raise.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.jsonpath import _c, is_number, jtext, vkind
from sluice.functions.timefmt import format_instant, parse_instant

__all__ = ["convert"]


def convert(v, typ: str | None, source_format: str | None = None,
            target_format: str | None = None, scale: int = 18,
            kind: Column | None = None, text: Column | None = None) -> tuple[Column, Column]:
    """Convert a VARIANT value to the mapping type; returns (value, bad).
    ``kind``/``text`` may be passed as precomputed columns (vkind / text)."""
    v = _c(v)
    t = (typ or "").strip().lower()
    k = vkind(v) if kind is None else kind
    s = jtext(v, k) if text is None else text
    null = k == "null"
    if typ is None:
        # No type: value passes through as text of the JSON value.
        return F.when(~null, s), F.lit(False)
    if t == "long":
        val = (F.when(is_number(k), F.try_variant_get(v, "$", "bigint"))
               .when((k == "string") & s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint")))
    elif t == "double":
        val = (F.when(is_number(k), F.try_variant_get(v, "$", "double"))
               .when(k == "string", F.trim(s).try_cast("double")))
    elif t == "boolean":
        val = F.when(~null, F.lower(s) == "true")
    elif t == "decimal":
        dt = f"decimal(38,{scale})"
        val = (F.when(is_number(k), F.try_variant_get(v, "$", dt))
               .when((k == "string") & s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
                     s.try_cast(dt)))
    elif t == "datetime":
        ts = parse_instant(v, source_format, kind=k, text=s)
        # An unparseable datetime passes through as its text.
        val = F.when(~null, F.coalesce(format_instant(ts, target_format), s))
    else:
        val = F.when(~null, s)
    bad = (~null) & val.isNull()
    return val, bad
