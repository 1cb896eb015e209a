"""JSON path access on VARIANT values.

Bodies are parsed once with ``try_parse_json``; every later access is a
``try_variant_get`` on the parsed value, so a record is never re-serialised
per field.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "normalize_path", "root_path", "parse_body", "vget", "vkind", "vtext", "jtext", "is_number", "NUMBER_KINDS",
    "read_integer", "read_string", "read_boolean", "read_instant",
    "read_monotonic_id", "is_json_null", "ISO_INSTANT_RE",
]

# Text shapes the Java ISO_INSTANT parser accepts (seconds are
# required, fraction up to 9 digits, Z or a numeric offset, case-insensitive).
ISO_INSTANT_RE = (
    r"^(?i)\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2}(:\d{2})?)$"
)
# The two named text formats (both read as UTC).
DAHUA_UTC = "yyyyMMdd'T'HHmmss'Z'"
MEIYA_DATETIME = "yyyy-MM-dd HH:mm:ss"


def normalize_path(path: str | None) -> str | None:
    """Bare names become ``$.name``; blank stays None."""
    if path is None or not str(path).strip():
        return None
    p = str(path).strip()
    return p if p.startswith("$") else "$." + p


def root_path(input_root: str | None) -> tuple[str, bool]:
    """Input root for record extraction: blank -> ``$``; a trailing ``[*]``
    is stripped (the array is exploded anyway). Returns (path, had_wildcard)."""
    p = normalize_path(input_root) or "$"
    wild = p.endswith("[*]")
    if wild:
        p = p[:-3] or "$"
    if re.search(r"\[\*\]|\.\.", p):
        raise ValueError(f"unsupported input_root {input_root!r}: wildcards only at the end")
    return p, wild


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_body(body) -> Column:
    """Body text -> VARIANT; malformed or blank text -> NULL."""
    return F.try_parse_json(_c(body))


def vget(v, path: str | None, typ: str = "variant") -> Column:
    """Value at a path (missing -> NULL). Bare names mean ``$.name``."""
    p = normalize_path(path)
    if p is None:
        return F.lit(None).cast(typ if typ != "variant" else "string")
    if "[*]" in p:
        found = _wild(_c(v), p.split("[*]"))
        out = F.when(found.isNotNull(), F.to_variant_object(F.filter(found, lambda x: x.isNotNull())))
        return out if typ == "variant" else F.try_variant_get(out, "$", typ)
    return F.try_variant_get(_c(v), p, typ)


def _wild(v: Column, parts: list[str]) -> Column:
    """The values a path with ``[*]`` steps reaches, as an array; NULL where
    the first step meets no array."""
    here = parts[0] if parts[0].startswith("$") else "$" + parts[0]
    if len(parts) == 1:
        return F.array(F.try_variant_get(v, here, "variant"))
    items = F.try_variant_get(v, here, "array<variant>")
    return F.flatten(F.transform(items, lambda x: F.coalesce(_wild(x, parts[1:]), F.array().cast("array<variant>"))))


def is_json_null(v) -> Column:
    """True for SQL NULL and for JSON null."""
    v = _c(v)
    return v.isNull() | F.is_variant_null(v)


_KIND_OF = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean",
            "VOID": "null", "DOUBLE": "float", "FLOAT": "float"}
NUMBER_KINDS = ("integer", "float")


def vkind(v) -> Column:
    """Kind of a VARIANT value: null, integer, float, string, boolean, object, array.

    ``float`` is any number written with a fraction or exponent (a JSON
    parser's double); Spark stores those as DECIMAL/DOUBLE.

    One ``schema_of_variant`` call, resolved through a constant map, so the
    expression stays small when it is inlined."""
    v = _c(v)
    head = F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)
    lut = F.create_map(*[F.lit(x) for kv in {**_KIND_OF, "DECIMAL": "float"}.items() for x in kv])
    return F.when(v.isNull(), F.lit("null")).otherwise(
        F.coalesce(F.element_at(lut, head), F.lit("integer")))


def is_number(k: Column) -> Column:
    return k.isin(*NUMBER_KINDS)


def jtext(v, kind: Column | None = None) -> Column:
    """Text of a value as a JSON tree prints it: floats in Java double
    notation (``19.0``, ``1.0E10``), other scalars as text, containers as
    JSON, JSON null -> NULL."""
    v = _c(v)
    k = vkind(v) if kind is None else kind
    return (F.when(k == "float", F.try_variant_get(v, "$", "double").cast("string"))
             .when(k != "null", F.try_variant_get(v, "$", "string")))


def vtext(v) -> Column:
    """Text of a value: scalars as text, containers as JSON, null -> NULL."""
    return jtext(v)


_INT_TEXT = r"^[+-]?[0-9]+$"


def read_integer(v, path: str | None, typ: str = "int") -> Column:
    """Number -> truncated integer; text -> strict integer parse; else NULL."""
    x = vget(v, path)
    k = vkind(x)
    t = F.try_variant_get(x, "$", "string")
    return (
        F.when(is_number(k), F.try_variant_get(x, "$", typ))
        .when((k == "string") & t.rlike(_INT_TEXT), t.try_cast(typ))
    )


def read_string(v, path: str | None) -> Column:
    """Value as text (objects as JSON text)."""
    return vtext(vget(v, path))


def read_boolean(v, path: str | None) -> Column:
    """JSON boolean, else text equal to 'true' ignoring case; NULL if missing."""
    x = vget(v, path)
    return F.when(~is_json_null(x), F.lower(F.try_variant_get(x, "$", "string")) == "true")


def _iso_ts(t: Column) -> Column:
    return F.when(t.rlike(ISO_INSTANT_RE), F.try_to_timestamp(F.upper(t)))


def read_instant(v, path: str | None) -> Column:
    """number = epoch ms, else ISO instant, else ``yyyyMMdd'T'HHmmss'Z'``,
    else ``yyyy-MM-dd HH:mm:ss`` (UTC); anything else NULL."""
    x = vget(v, path)
    k = vkind(x)
    t = F.try_variant_get(x, "$", "string")
    ms = F.try_variant_get(x, "$", "bigint")
    return (
        F.when(is_number(k), F.timestamp_millis(ms))
        .when(k.isin("string", "boolean", "object", "array"), F.coalesce(
            _iso_ts(t),
            F.try_to_timestamp(t, F.lit(DAHUA_UTC)),
            F.when(F.length(t) == 19, F.try_to_timestamp(t, F.lit(MEIYA_DATETIME))),
        ))
    )


def read_monotonic_id(v, path: str | None) -> Column:
    """Number -> integer text (truncated); text -> itself, blank -> NULL."""
    x = vget(v, path)
    k = vkind(x)
    t = F.try_variant_get(x, "$", "string")
    return (
        F.when(is_number(k), F.try_variant_get(x, "$", "bigint").cast("string"))
        .when(k != "null", F.when(F.trim(t) != "", t))
    )
