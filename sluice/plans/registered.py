"""Registered queries: each runs an operator over data Spark derives from the
driver tables, paired with an independent DuckDB SQL oracle over the raw
tables. Keys are ``<operator id>_<name>``."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import extract as X
from sluice.operators import sinks as K
from sluice.operators import transform as T
from sluice.sources.landed import event_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---- shared SQL fragments (DuckDB) -------------------------------------------

# ISO-8601 instant text of a zone-less timestamp as Java prints it.
ISO_TS = ("(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond({c}) % 1000000 = 0 THEN '' "
          "WHEN microsecond({c}) % 1000 = 0 THEN '.' || lpad(CAST((microsecond({c}) % 1000000) // 1000 AS VARCHAR), 3, '0') "
          "ELSE '.' || lpad(CAST(microsecond({c}) % 1000000 AS VARCHAR), 6, '0') END || 'Z')")


def iso_ts(c: str) -> str:
    return ISO_TS.format(c=c)


# Events as landed by `event_pages(page_size=100)`: one connector, 0-based
# ordinal by event_id -> page_idx / pos.
EV_PAGED = ("(SELECT *, CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 AS INTEGER) AS page_idx, "
            "CAST((row_number() OVER (ORDER BY event_id) - 1) % 100 AS INTEGER) AS pos FROM events)")

FLAGSHIP_STEPS = [
    {"type": "filter", "condition": "${record.event_type} <> 'error'"},
    {"type": "map_fields", "mappings": [
        {"source": "$.event_id", "target": "event_id", "type": "long"},
        {"source": "$.user_id", "target": "user_id", "type": "long"},
        {"source": "$.value", "target": "value", "type": "double"},
        {"source": "$.props.k", "target": "k", "type": "long"},
        {"source": "$.ts", "target": "ts", "type": "datetime", "target_format": "meiya_datetime"},
    ]},
]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2 -> X1 -> T1 -> T2 -> K2 (keyed on user_id, last (page_idx, pos) wins)."""
    pages = event_pages(spark, sf_dir, page_size=100)
    recs = X.extract_records(pages, "$.data")
    res = T.transform(recs, FLAGSHIP_STEPS)
    return K.upsert(None, res.rows.drop("connector_id", "run_id"), ["user_id"])


register("k2_flagship_upsert_by_user", """
SELECT event_id, user_id, value, k, ts FROM (
  SELECT event_id, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn
  FROM events WHERE event_type <> 'error') WHERE rn = 1
""")(flagship)


# Populate the registry (modules register on import).
from sluice.plans import q_records  # noqa: E402,F401
from sluice.plans import q_state  # noqa: E402,F401
from sluice.plans import q_runs  # noqa: E402,F401
from sluice.plans import q_stream  # noqa: E402,F401
from sluice.plans import q_infer  # noqa: E402,F401
from sluice.plans import q_rules  # noqa: E402,F401
