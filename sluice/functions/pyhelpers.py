"""Small per-request Python helpers run as Arrow-batched pandas UDFs.

Kept free of ``from __future__ import annotations`` so PySpark can read the
``pd.Series`` type hints.
"""
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _set_path(doc, path, value):
    cur = doc
    parts = [p for p in path.split(".") if p]
    for p in parts[:-1]:
        nxt = cur.get(p)
        if not isinstance(nxt, dict):
            nxt = {}
            cur[p] = nxt
        cur = nxt
    cur[parts[-1]] = value


@F.pandas_udf(T.StringType())
def compose_json(tmpl: pd.Series, vals: pd.Series) -> pd.Series:
    """Set each ``path -> value`` of the ``vals`` JSON object into the JSON
    template (objects created on the way, existing keys keep their place)."""
    out = []
    for t, row in zip(tmpl, vals):
        try:
            doc = json.loads(t) if isinstance(t, str) and t.strip() else {}
        except ValueError:
            doc = {}
        if not isinstance(doc, dict):
            doc = {}
        got = json.loads(row) if isinstance(row, str) else {}
        for path, value in got.items():
            _set_path(doc, path, value)
        out.append(json.dumps(doc, separators=(",", ":"), ensure_ascii=False))
    return pd.Series(out)


def _lookup(root: dict, ref: str):
    """What a local reference points to (``#/a/b``, with ``~1`` and ``~0`` escapes); else nothing."""
    if not isinstance(ref, str) or not ref.startswith("#/"):
        return {}
    node = root
    for part in ref[2:].split("/"):
        node = node.get(part.replace("~1", "/").replace("~0", "~")) if isinstance(node, dict) else None
    return node if isinstance(node, dict) else {}


def _resolved(root: dict, node, open_refs: frozenset = frozenset()):
    """A part of a document with references replaced by what they point to and
    ``allOf`` merged into one object; a reference inside itself becomes ``{}``."""
    if isinstance(node, list):
        return [_resolved(root, x, open_refs) for x in node]
    if not isinstance(node, dict):
        return node
    if "$ref" in node:
        ref = node["$ref"]
        return {} if ref in open_refs else _resolved(root, _lookup(root, ref), open_refs | {ref})
    if isinstance(node.get("allOf"), list):
        merged: dict = {}
        for part in node["allOf"]:
            got = _resolved(root, part, open_refs)
            merged.update(got.get("properties") or {} if isinstance(got, dict) else {})
        return {"type": "object", "properties": merged}
    return {k: _resolved(root, v, open_refs) for k, v in node.items()}


@F.pandas_udf(T.StringType())
def resolve_paths(docs: pd.Series) -> pd.Series:
    """The ``paths`` of API documents with references resolved, as JSON text;
    NULL for what is no JSON object."""
    out = []
    for d in docs:
        try:
            root = json.loads(d) if isinstance(d, str) else None
        except ValueError:
            root = None
        out.append(json.dumps(_resolved(root, root.get("paths") or {}), ensure_ascii=False) if isinstance(root, dict) else None)
    return pd.Series(out, dtype=object)
