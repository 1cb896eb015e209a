"""Record transform pipeline.

A pipeline is the ordered ``steps`` list of a connector's ``transform``
config: ``filter`` (condition), ``map_fields`` (mappings), ``expression``
(ordered name -> expression). Rows start as a ``rec`` VARIANT column plus
run metadata; ``map_fields`` projects to typed columns. Conditions and
expressions are **Spark SQL expressions**; ``${record.x}`` (or
``${record.x:type}``) refers to field ``x`` of the current record.

Every conversion is a built-in expression returning (value, bad), so a
tolerant run makes one pass and splits rows into good rows and error rows
without any Python on the record path.
"""
from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions.casts import convert
from sluice.functions.jsonpath import jtext, normalize_path, vkind
from sluice.operators.expressions import check_expression
from sluice.operators.extract import RUN_KEYS, as_object, index_with, page_offsets, with_record_index

log = logging.getLogger(__name__)

META = ("connector_id", "run_id", "page_idx", "page_n", "pos", "record_index")
ERR = "__err"
SAMPLE_LIMIT = 2000          # T18: sample text and messages are cut here
PULL_MAX_ERRORS = 20         # T17: error samples kept per pull run


STRICT_PREFIX = "strict transform failed: "


@dataclass
class TransformResult:
    """Good rows (typed columns), and what is known of the bad ones; those
    plans are built when they are asked for."""
    rows: DataFrame
    bad: DataFrame | None                   # None: no step of the pipeline can fail
    sample: Callable[[int | None, int | None], DataFrame]

    max_errors: int | None = PULL_MAX_ERRORS
    sample_limit: int | None = SAMPLE_LIMIT

    @cached_property
    def errors(self) -> DataFrame:
        """connector_id, run_id, record_index, message, sample_json (samples)."""
        return self.sample(self.max_errors, self.sample_limit)

    @cached_property
    def all_errors(self) -> DataFrame:
        """The same of every bad record, uncut."""
        return self.sample(None, None)

    @cached_property
    def errors_count(self) -> DataFrame:
        """connector_id, n: bad records of each connector that has some."""
        rows = self.errors if self.bad is None else self.bad
        return rows.groupBy("connector_id").agg(F.count(F.lit(1)).alias("n"))


_PLACEHOLDER = re.compile(r"\$\{record\.([^}:]+)(?::([a-z0-9(), ]+))?\}")


def compile_expression(text: str, columns: Sequence[str], has_rec: bool) -> Column:
    """T5: ``${record.x}`` -> column ``x`` when it exists, else the value at
    path ``$.x`` of the record VARIANT (as ``type``, default string)."""
    def sub(m):
        name, typ = m.group(1).strip(), (m.group(2) or "string").strip()
        if "'" in name or "`" in name:
            raise ValueError(f"quotes are not allowed in a field name: {m.group(0)!r}")
        if name in columns:
            return f"`{name}`"
        if has_rec:
            return f"try_variant_get(rec, '{normalize_path(name)}', '{typ}')"
        return "NULL"
    return F.expr(check_expression(_PLACEHOLDER.sub(sub, text), columns))


def _data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META and c not in ("rec", ERR, "__sample")]


def _ensure_rec(df: DataFrame) -> DataFrame:
    """map_fields reads from a record object; rebuild one from typed columns
    when an earlier map_fields already projected the record."""
    if "rec" in df.columns:
        return df
    cols = _data_columns(df)
    return df.withColumn("rec", F.to_variant_object(F.struct(*[F.col(c) for c in cols])))


def filter_step(df: DataFrame, condition: str | None) -> DataFrame:
    """Keep a record when the condition is true; NULL drops; blank keeps
    all. Rows that already failed stay (they go to the error output)."""
    if condition is None or not condition.strip():
        return df
    cond = compile_expression(condition, _data_columns(df), "rec" in df.columns)
    ok = F.coalesce(cond, F.lit(False))
    if ERR in df.columns:
        ok = F.col(ERR).isNotNull() | ok
    return df.filter(ok)


def map_fields_step(df: DataFrame, mappings: Sequence[dict] | None, decimal_scale: int = 18,
                    carry: Sequence[str] = ()) -> DataFrame:
    """Project to ``target <- source :: type``; other fields dropped
    (``carry`` names extra columns to keep alongside run metadata).
    No mappings: identity. The first failing mapping (in order) names the error."""
    if not mappings:
        return df
    df = _ensure_rec(df)
    extra = [c for c in _data_columns(df) if c not in carry]
    meta = [c for c in df.columns if c in META or c in carry]
    n = len(mappings)
    # Stage 1: the value at each source path (a column reference from here on,
    # so the record lookup is not repeated inside the conversions).
    vals = []
    for i, m in enumerate(mappings):
        src = m.get("source") or m.get("target")
        bare = src[2:] if src.startswith("$.") else src
        if bare in extra:
            v = F.try_variant_get(F.to_variant_object(F.struct(F.col(bare).alias("x"))), "$.x", "variant")
        else:
            v = F.try_variant_get(F.col("rec"), normalize_path(src), "variant")
        vals.append(v.alias(f"__v{i}"))
    prev_err = [ERR] if ERR in df.columns else []
    # The source record rides along as VARIANT (a column reference, no
    # cost); only error rows are ever serialised to sample text.
    sample = (F.col("__sample") if "__sample" in df.columns else F.col("rec")).alias("__sample")
    st = df.select(*meta, *prev_err, sample, *vals)
    # Stage 2: kind of each value; stage 2b: its text (uses the kind).
    st = st.select(*meta, *prev_err, "__sample", *[f"__v{i}" for i in range(n)],
                   *[vkind(F.col(f"__v{i}")).alias(f"__k{i}") for i in range(n)])
    st = st.select(*meta, *prev_err, "__sample", *[f"__v{i}" for i in range(n)],
                   *[f"__k{i}" for i in range(n)],
                   *[jtext(F.col(f"__v{i}"), F.col(f"__k{i}")).alias(f"__s{i}") for i in range(n)])
    # Stage 3: conversions and the first failing mapping.
    outs, errs = [], []
    for i, m in enumerate(mappings):
        typ = m.get("type", "string")
        target = m["target"]
        val, bad = convert(F.col(f"__v{i}"), typ, m.get("source_format"), m.get("target_format"),
                           scale=int(m.get("scale", decimal_scale)),
                           kind=F.col(f"__k{i}"), text=F.col(f"__s{i}"))
        outs.append(val.alias(f"__o{i}"))
        errs.append(F.when(bad, F.concat(
            F.lit(f"cannot convert field '{target}' to {typ}: "), F.coalesce(F.col(f"__s{i}"), F.lit("")))))
    err = F.coalesce(*[F.col(c) for c in prev_err], *errs) if (prev_err or n > 1) else errs[0]
    # Out of a generator: a filter on the error would else move below the stages
    # with all of them inlined, and convert every record once more.
    made = st.select(*meta, "__sample", F.explode_outer(F.array(F.struct(*outs, err.alias(ERR)))).alias("__made"))
    return made.select(*meta, *[F.col("__made")[f"__o{i}"].alias(m["target"]) for i, m in enumerate(mappings)], F.col("__made")[ERR].alias(ERR), "__sample")


def expression_step(df: DataFrame, expressions: dict[str, str] | Sequence[tuple[str, str]] | None) -> DataFrame:
    """T4: add or replace fields in declared order; later ones see earlier ones."""
    if not expressions:
        return df
    items = expressions.items() if isinstance(expressions, dict) else expressions
    for name, text in items:
        df = df.withColumn(name, compile_expression(text, _data_columns(df), "rec" in df.columns))
    return df


def apply_step(df: DataFrame, step: dict) -> DataFrame:
    kind = (step.get("type") or "").strip().lower()
    if kind == "filter":
        return filter_step(df, step.get("condition"))
    if kind == "map_fields":
        return map_fields_step(df, step.get("mappings"))
    if kind == "expression":
        return expression_step(df, step.get("expressions"))
    log.warning("unknown transform step type %r: passed through", kind)   # T6
    return df


def run_steps(records: DataFrame, steps: Sequence[dict] | None) -> DataFrame:
    """The step chain (records are first made objects, X9)."""
    df = records.withColumn("rec", as_object("rec"))
    for step in steps or ():
        df = df.transform(lambda d, s=step: apply_step(d, s))
    return df


def transform(records: DataFrame, steps: Sequence[dict] | None,
              max_errors: int | None = PULL_MAX_ERRORS,
              run_keys: Sequence[str] = RUN_KEYS, sample_limit: int | None = SAMPLE_LIMIT,
              stage: Callable[[DataFrame], DataFrame] | None = None, offsets: DataFrame | None = None) -> TransformResult:
    """Tolerant transform: good rows, and error rows
    ``(run keys, record_index, message, sample_json)`` with at most
    ``max_errors`` samples per run (``None`` keeps all), texts cut at
    ``sample_limit`` (``None``: not at all). ``all_errors`` has every bad
    record with whole texts. ``stage`` (write and read again) makes good rows
    and errors share one pass over the source where both are used; ``offsets``
    are the records before each page where they are known (see
    ``page_offsets``), so that the error rows need not read the source."""
    out = run_steps(records, steps)
    if stage is not None:
        out = stage(out)
    if ERR not in out.columns:
        empty = lambda *_: records.sparkSession.createDataFrame(
            [], "connector_id string, run_id bigint, record_index bigint, message string, sample_json string")
        return TransformResult(out.drop("__sample", "page_n"), None, empty, max_errors, sample_limit)
    good = out.filter(F.col(ERR).isNull()).drop(ERR, "__sample", "page_n")
    bad = out.filter(F.col(ERR).isNotNull())
    return TransformResult(good, bad, lambda n, cut: error_output(bad, records, n, run_keys, cut, offsets), max_errors, sample_limit)


def error_output(bad: DataFrame, records: DataFrame, max_errors: int | None,
                 run_keys: Sequence[str] = RUN_KEYS, sample_limit: int | None = SAMPLE_LIMIT, offsets: DataFrame | None = None) -> DataFrame:
    """Error rows with run-wide record index. Only the bad rows get one, from
    the offsets of their pages; the N smallest per run are kept by bounded
    top-N windows (page, page block, run) before that."""
    cut = (lambda c: c) if sample_limit is None else (lambda c: F.left(c, F.lit(sample_limit)))
    e = bad.select(*run_keys, "page_idx", "pos", F.col(ERR).alias("message"), F.col("__sample").alias("__s"))
    if max_errors is not None:
        e = _bounded_top_n(e, run_keys, ["page_idx", "pos"], max_errors)
    e = index_with(e, page_offsets(records, run_keys) if offsets is None else offsets, run_keys)
    return e.select(*run_keys, "record_index", cut(F.col("message")).alias("message"), cut(F.to_json("__s")).alias("sample_json"))


def _bounded_top_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Keep the ``n`` smallest ``order`` per ``keys`` with windows whose
    partitions are bounded: per page, per block of 1024 pages, per run."""
    keys = list(keys)
    for part in (["page_idx"], [(F.col("page_idx") / 1024).cast("bigint")], []):
        w = Window.partitionBy(*keys, *part).orderBy(*order)
        df = df.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")
    return df


def transform_strict(records: DataFrame, steps: Sequence[dict] | None,
                     run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Like ``transform`` but a bad record fails the query that reads the
    result, with its run-wide index and message. Nothing runs when the plan is
    built: the first bad record of each run, found by an aggregate over the
    bad rows, is a row of the result that raises when it is read, also if only
    a column of it is, or none. A join would hold the good rows of a run in
    one task, or broadcast them all where the run keys are constants."""
    res = transform(records, steps, max_errors=1, run_keys=run_keys)
    text = F.concat(F.lit(STRICT_PREFIX + "record "), F.col("record_index").cast("string"), F.lit(": "), F.col("message"))
    first = res.errors.groupBy(*run_keys).agg(F.min_by(text, "record_index").alias("__why"))
    fail = F.raise_error(F.col("__why"))
    bad = first.filter(fail.cast("boolean")).select(*[fail.cast(f.dataType).alias(f.name) for f in res.rows.schema])
    return bad.unionByName(res.rows)       # the bad ones first: a limit reads them before it has its rows


def preview(records: DataFrame, steps: Sequence[dict] | None, limit: int = 10,
            run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """The first ``limit`` records of each run through the strict pipeline."""
    head = limit_records(records, limit, run_keys)
    return transform_strict(head, steps, run_keys)


def limit_records(records: DataFrame, limit: int, run_keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Keep the first ``limit`` records of each run (by page_idx, pos)."""
    return with_record_index(records, run_keys).filter(F.col("record_index") < limit).drop("record_index")
