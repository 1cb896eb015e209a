"""Connector configs (S1): JSON text -> typed columns with defaults.

One row per connector (or version). Every setting is a column expression over
the config parsed once to VARIANT, so thousands of configs are read in one
projection. Blank texts count as missing. A config that is no JSON object
gets ``config_error`` and null settings instead of failing the others; an
overlap that can't be read is reported there too.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.jsonpath import jtext, read_boolean, read_integer, vget, vkind
from sluice.functions.timefmt import overlap_problem

# The defaults of the settings.
DEFAULT_STOP = ("empty_cursor", "empty_page")
DEFAULT_LINK_STOP = ("no_next_link", "empty_page")
NOT_OBJECT = "Connector config must be a JSON object"


def _text(v: Column, path: str, default: str | Column | None = None) -> Column:
    t = jtext(vget(v, path))
    d = default if isinstance(default, Column) else F.lit(default).cast("string")
    return F.coalesce(F.when(F.trim(t) != "", t), d)


def _int(v: Column, path: str, default: int) -> Column:
    return F.coalesce(read_integer(v, path), F.lit(default))


def _bool(v: Column, path: str, default: bool) -> Column:
    return F.coalesce(read_boolean(v, path), F.lit(default))


def _map(v: Column, path: str) -> Column:
    m = F.try_variant_get(vget(v, path), "$", "map<string,variant>")
    return F.coalesce(F.transform_values(m, lambda _, x: F.coalesce(jtext(x), F.lit(""))), F.create_map().cast("map<string,string>"))


def _texts(v: Column, path: str) -> Column:
    a = F.try_variant_get(vget(v, path), "$", "array<variant>")
    kept = F.filter(F.transform(a, lambda x: F.trim(jtext(x))), lambda t: F.coalesce(t != "", F.lit(False)))
    return F.coalesce(kept, F.array().cast("array<string>"))


def _has(v: Column, path: str) -> Column:
    return vget(v, path).isNotNull() & (vkind(vget(v, path)) != "null")


def parse_configs(connectors: DataFrame, config: str = "config") -> DataFrame:
    """All columns, and structs ``http``, ``pagination``, ``incremental``,
    ``sync``, ``transform``, ``sink``, ``schedule``, ``webhook``, the text
    ``config_mode`` (pull, push or both) and ``config_error``."""
    d = connectors.withColumn("__v", F.try_parse_json(F.col(config)))
    v = F.col("__v")
    ok = vkind(v) == "object"
    body = vget(v, "$.http.body")
    body_text = F.when(vkind(body) == "string", F.try_variant_get(body, "$", "string")).when(vkind(body) != "null", F.to_json(body))
    form = _map(v, "$.http.form")
    body_type = F.coalesce(_text(v, "$.http.body_type"), F.when(F.trim(body_text) != "", F.lit("json")).when(F.size(form) > 0, F.lit("form-urlencoded")).otherwise(F.lit("none")))
    timeout = _int(v, "$.http.timeout_ms", -1)
    http = F.struct(_text(v, "$.http.method", "GET").alias("method"), _text(v, "$.http.url").alias("url"), _map(v, "$.http.headers").alias("headers"),
                    _map(v, "$.http.query").alias("query"), body_type.alias("body_type"), body_text.alias("body"), form.alias("form"),
                    F.when(timeout < 0, _int(v, "$.http.timeoutMs", 30000)).otherwise(timeout).alias("timeout_ms"))
    pg = "$.pagination"
    strategy = _text(v, f"{pg}.strategy", "page_page_size")
    total_path = _text(v, f"{pg}.total_count.json_path")
    stops = _texts(v, f"{pg}.stop_when")
    default_stops = F.when(F.lower(strategy) == "link_header", F.array(*map(F.lit, DEFAULT_LINK_STOP))).otherwise(F.array(*map(F.lit, DEFAULT_STOP)))
    pagination = F.struct(
        strategy.alias("strategy"), _text(v, f"{pg}.location", "query").alias("location"), _text(v, f"{pg}.page_value_type", "page_number").alias("page_value_type"),
        _text(v, f"{pg}.page_param", "page").alias("page_param"), _text(v, f"{pg}.page_size_param", "page_size").alias("page_size_param"),
        _int(v, f"{pg}.page_start", 1).alias("page_start"), _int(v, f"{pg}.page_size", 100).alias("page_size"), total_path.alias("total_path"),
        _int(v, f"{pg}.max_pages", 1000).alias("max_pages"),
        _text(v, f"{pg}.total_count.source", F.when(total_path.isNotNull(), F.lit("json_path")).otherwise(F.lit("none"))).alias("total_source"),
        _text(v, f"{pg}.total_count.http.url").alias("count_url"),
        F.when(_has(v, pg), _text(v, f"{pg}.total_count.http.method", "POST")).alias("count_method"),
        _bool(v, f"{pg}.total_count.http.reuse_body", True).alias("count_reuse_body"),
        _text(v, f"{pg}.cursor_param").alias("cursor_param"), _text(v, f"{pg}.cursor_response_path").alias("cursor_response_path"),
        _text(v, f"{pg}.has_more_path").alias("has_more_path"), _bool(v, f"{pg}.first_page_omit_cursor", True).alias("first_page_omit_cursor"),
        F.when(F.size(stops) > 0, stops).otherwise(default_stops).alias("stop_when"),
        _text(v, f"{pg}.link_header_name", "Link").alias("link_header_name"), _text(v, f"{pg}.link_rel", "next").alias("link_rel"))
    inc = "$.incremental"
    on = _bool(v, f"{inc}.enabled", False)
    mode = F.lower(_text(v, f"{inc}.mode", "timestamp"))
    mode = F.when(~on, F.lit("timestamp")).when(mode.isin("monotonic_id", "rolling_window"), mode).otherwise(F.lit("timestamp"))
    target = _text(v, f"{inc}.request_target", "query")

    def by_mode(timestamp: Column, rolling: Column, monotonic: Column) -> Column:
        return F.when(mode == "rolling_window", rolling).when(mode == "monotonic_id", monotonic).otherwise(timestamp)

    null = F.lit(None).cast("string")
    ts, rw, mi = f"{inc}.timestamp", f"{inc}.rolling_window", f"{inc}.monotonic_id"
    incremental = F.struct(
        on.alias("enabled"), mode.alias("mode"),
        F.when(on, by_mode(_text(v, f"{ts}.response_path", "$.updated_at"), _text(v, f"{rw}.response_path", "$.updated_at"), _text(v, f"{mi}.response_path", "$.id"))).alias("response_path"),
        F.when(on, by_mode(_text(v, f"{ts}.request_param", "updated_after"), _text(v, f"{rw}.start_param", "startTime"), _text(v, f"{mi}.request_param", "since_id"))).alias("request_param"),
        F.when(on, by_mode(_text(v, f"{ts}.request_target", target), _text(v, f"{rw}.request_target", target), _text(v, f"{mi}.request_target", target))).otherwise(F.lit("query")).alias("request_target"),
        F.when(on, by_mode(_text(v, f"{ts}.request_body_path"), _text(v, f"{rw}.request_body_start_path"), _text(v, f"{mi}.request_body_path"))).alias("body_path"),
        F.when(on, by_mode(_text(v, f"{ts}.request_body_end_path"), _text(v, f"{rw}.request_body_end_path"), null)).alias("body_end_path"),
        F.when(on, by_mode(_text(v, f"{ts}.format", "iso_instant"), _text(v, f"{rw}.format", "iso_instant"), null)).otherwise(F.lit("iso_instant")).alias("format"),
        F.when(on, by_mode(_text(v, f"{ts}.overlap", "5m"), _text(v, f"{rw}.overlap", "5m"), null)).otherwise(F.lit("5m")).alias("overlap"),
        F.when(on & (mode == "rolling_window"), _text(v, f"{rw}.end_param", "endTime")).alias("end_param"))
    transform = F.struct(_text(v, "$.transform.input_root", "$.data").alias("input_root"),
                         F.coalesce(F.to_json(vget(v, "$.transform.steps")), F.lit("[]")).alias("steps"))
    sk = "$.sink"
    sink = F.when(_has(v, sk), F.struct(
        _text(v, f"{sk}.type", "postgresql").alias("type"), _text(v, f"{sk}.target.schema", "public").alias("schema"), _text(v, f"{sk}.target.table").alias("table"),
        _texts(v, f"{sk}.keys").alias("keys"), _text(v, f"{sk}.write_mode", "upsert").alias("write_mode"), _int(v, f"{sk}.batch_size", 500).alias("batch_size"),
        _text(v, f"{sk}.target.topic").alias("topic"), _text(v, f"{sk}.serialization", "json").alias("serialization")))
    sc = "$.schedule"
    schedule = F.struct((_has(v, sc) & _bool(v, f"{sc}.enabled", True)).alias("enabled"), _text(v, f"{sc}.type", "cron").alias("type"),
                        _text(v, f"{sc}.expression", "0 0/5 * * * ?").alias("expression"), read_integer(v, f"{sc}.interval_seconds").alias("interval_seconds"))
    wh = "$.webhook"
    webhook = F.struct(_bool(v, f"{wh}.enabled", True).alias("enabled"), _text(v, f"{wh}.path_suffix", "").alias("path_suffix"),
                       _bool(v, f"{wh}.verify_sign", False).alias("verify_sign"), _text(v, f"{wh}.plat_flag", "ivsp").alias("plat_flag"))
    parts = {"config_mode": _text(v, "$.mode", "pull"), "http": http, "pagination": pagination, "incremental": incremental,
             "sync": F.struct(_text(v, "$.sync.on_first_run", "full").alias("on_first_run")), "transform": transform, "sink": sink,
             "schedule": schedule, "webhook": webhook}
    # Settings only where the config is an object.
    return d.select(*connectors.columns, *[F.when(ok, c).alias(k) for k, c in parts.items()],
                    F.when(~ok, F.lit(NOT_OBJECT)).otherwise(overlap_problem(incremental["overlap"])).alias("config_error"))


def transform_steps(steps_json: str | None) -> list[dict]:
    """The steps text of a parsed config as the list ``transform`` takes:
    ``set`` of an expression step becomes its ``expressions``."""
    import json
    out = []
    for step in json.loads(steps_json or "[]") or []:
        step = dict(step)
        if "set" in step and "expressions" not in step:
            step["expressions"] = {k: str(v) for k, v in (step.get("set") or {}).items()}
        out.append(step)
    return out
