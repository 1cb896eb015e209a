"""Streams with state, and what is merged from parts: alerts, statistics, repeats, sketches, zones, ordinals."""
import datetime as dt

from pyspark.sql import functions as F

from sluice.operators import runs as J
from sluice.operators import watermark as W
from sluice.plans import ordinal as O
from sluice.session import scratch_path
from sluice.streaming import runs as R
from sluice.streaming.push import PUSH_SCHEMA, run_deduped_stream

T0 = dt.datetime(2024, 1, 1)


def run_rows(spark, rows):
    """(id, connector, seconds after T0 or None, status) as a run log."""
    made = [(i, c, "full", s, None if t is None else T0 + dt.timedelta(seconds=t), None, 1, 0) for i, c, t, s in rows]
    return spark.createDataFrame(made, R.RUN_SCHEMA)


def land(spark, folder, *parts):
    for rows in parts:
        run_rows(spark, rows).coalesce(1).write.mode("append").parquet(folder)


LOG = [(i, None if i % 11 == 0 else f"c{i % 3}", i * 200 + (i * 37) % 150, "failed" if (i * i) % 7 in (1, 2, 4) else "success") for i in range(120)]
TIES = [(200 + i, "tie", 5000, "failed") for i in range(4)] + [(210, "tie", 5000, "success"), (211, "tie", 6801, "failed")]


def test_alerts_equal_the_batch_operators_however_the_log_is_cut(spark):
    log = LOG + TIES
    batch = run_rows(spark, log)
    streaks = {tuple(r) for r in J.consecutive_failures(batch).select("connector_id", "id").collect()}
    near = {tuple(r) for r in J.failures_within(batch).select("connector_id", "id", "failures_in_window").collect()}
    assert streaks and near
    mixed = sorted(log, key=lambda r: (r[2] // 2000, (r[0] * 13) % 31))           # out of order within 2000 s
    beat = [(None, None, 10 ** 6, None)]
    for cuts in (1, 4):
        folder = scratch_path(spark, "t-runs")
        size = -(-len(mixed) // cuts)
        land(spark, folder, *[mixed[n * size:(n + 1) * size] for n in range(cuts)], [(500, "c0", None, "failed")], beat)
        got = R.run_alerts(spark, folder, scratch_path(spark, "t-alerts"), scratch_path(spark, "t-ckpt"), "1 hour", max_files_per_trigger=1).collect()
        assert {(r["connector_id"], r["id"]) for r in got if r["alert"] == R.STREAK} == streaks
        assert {(r["connector_id"], r["id"], r["failures"]) for r in got if r["alert"] == R.WINDOW} == near
        assert len(got) == len(streaks) + len(near)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


class Held:
    """A state variable, or the handle of some, in memory."""

    def __init__(self):
        self.value, self.timers = None, set()

    getListState = getValueState = lambda self, *_: Held()
    exists = lambda self: self.value is not None
    get = lambda self: self.value
    update = put = lambda self, value: setattr(self, "value", value)
    clear = lambda self: setattr(self, "value", None)
    appendValue = lambda self, value: setattr(self, "value", [*(self.value or []), value])
    appendList = lambda self, values: setattr(self, "value", [*(self.value or []), *values])
    registerTimer = lambda self, at: self.timers.add(at)
    deleteTimer = lambda self, at: self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_one_call_judges_all_connectors_of_a_part():
    """Connectors share a call, each judged by its own runs, and one timer; null is a connector too."""
    import pandas as pd
    state, handle = R.AlertState(3, 1800, 3), Held()
    state.init(handle)
    names = [None, *[f"c{i}" for i in range(300)]]

    def came(part, seconds):
        rows = [(n, i * 1000 + s, s * 1_000_000, i % 2 == 0, False) for i, n in enumerate(names) for s in seconds]
        rows.append(("beat", 0, 9_000_000_000, False, True))
        list(state.handleInputRows((part,), iter([pd.DataFrame(rows, columns=["connector_id", "id", "at", "failed", "beat"])]), At(0)))

    def judged(ms):
        handle.timers = {t for t in handle.timers if t > ms}
        return sorted((str(r[0]), *r[1:]) for d in state.handleExpiredTimer((1,), At(ms), None) for r in d.itertuples(index=False, name=None))
    came(1, (700, 10, 3000))
    came(1, (5, 20))
    assert handle.timers == {6000}
    failing = [(i, str(n)) for i, n in enumerate(names) if i % 2 == 0]
    assert judged(21000) == sorted((n, i * 1000 + 20, 20_000_000, kind, 3) for i, n in failing for kind in (R.STREAK, R.WINDOW))
    assert handle.timers == {701_000}
    assert judged(3_001_000) == sorted([(n, i * 1000 + s, s * 1_000_000, R.STREAK, k) for i, n in failing for s, k in ((700, 4), (3000, 5))]
                                       + [(n, i * 1000 + 700, 700_000_000, R.WINDOW, 4) for i, n in failing])
    assert handle.timers == set()


def test_the_state_has_no_partition_without_a_part(spark):
    folder, ckpt = scratch_path(spark, "t-runs"), scratch_path(spark, "t-ckpt")
    land(spark, folder, [(i, f"c{i}", 100 * k + i, "failed") for i in range(4) for k in range(3)], [(None, None, 10 ** 6, None)])
    got = R.run_alerts(spark, folder, scratch_path(spark, "t-alerts"), ckpt, "1 hour", parts=2)
    assert sorted({r["connector_id"] for r in got.collect()}) == ["c0", "c1", "c2", "c3"]
    from pathlib import Path
    assert len([p for p in Path(ckpt.removeprefix("file:"), "state", "0").iterdir() if p.name.isdigit()]) == 2
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"


def test_running_statistics_follow_each_batch_and_a_restart(spark):
    folder, table, ckpt = (scratch_path(spark, n) for n in ("t-runs", "t-stats", "t-ckpt"))
    for upto in (40, 80, 120):
        land(spark, folder, LOG[upto - 40:upto])
        got = R.run_statistics(spark, folder, table, ckpt)
        want = J.stats_by_connector(run_rows(spark, LOG[:upto]))
        cols = want.columns
        assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect()))
        assert R.total_of(got).first() == J.stats_global(run_rows(spark, LOG[:upto])).first()


def test_repeats_within_the_delay_pass_once(spark):
    def push(c, req, eid, minute):
        time = "" if minute is None else f',"EventTime":"2024-01-01 {minute // 60:02d}:{minute % 60:02d}:00"'
        return (c, req, "", 1, f'{{"EventID":{eid}{time}}}')
    folder = scratch_path(spark, "t-push")
    for rows in ([push("a", "1", '"x"', 0), push("b", "2", '"x"', 1), push("a", "3", '" "', 1), push("a", "4", "null", 1)],
                 [push("a", "5", '"x"', 20), push("a", "6", '"y"', 10), push("a", "7", "7", 0), ("a", "8", "", 1, "no json")],
                 [push("a", "9", '"z"', 600), push("a", "10", '"7"', 30)], [push("a", "12", '"z"', 620)], [push("a", "11", '"x"', 640)]):
        spark.createDataFrame(rows, PUSH_SCHEMA).coalesce(1).write.mode("append").json(folder)
    got = run_deduped_stream(spark, folder, scratch_path(spark, "t-out"), scratch_path(spark, "t-ckpt"), "1 hour", max_files_per_trigger=1)
    assert sorted((r["connector_id"], r["request_id"]) for r in got.collect()) == sorted(
        [("a", "1"), ("b", "2"), ("a", "3"), ("a", "4"), ("a", "6"), ("a", "7"), ("a", "8"), ("a", "9"), ("a", "11")])


def test_sketches_of_days_roll_up(spark):
    runs = spark.range(20000).select(F.col("id"), F.when(F.col("id") % 4 == 0, "x").otherwise("y").alias("run_type"),
                                     (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast("int"))).alias("started_at"))
    runs = runs.withColumn("finished_at", F.when(F.col("id") != 0, F.timestamp_millis(F.unix_millis("started_at") + F.col("id"))))
    days = J.duration_sketches(runs)
    assert days.count() == 28
    got = {r["run_type"]: r for r in J.duration_quantiles(days).collect()}
    assert (got["x"]["n"], got["y"]["n"]) == (4999, 15000)
    for r in got.values():
        assert abs(r["p50_ms"] - 10000) < 400 and abs(r["p95_ms"] - 19000) < 400


def zone_pages(spark, n):
    from sluice.sources.landed import PAGES_SCHEMA
    def body(i):
        at = [f'{{"t":"2024-01-{d:02d} 00:00:00"}}' for d in (i, i)] + (['{"t":null}'] if i == 9 else [])
        return '{"data":[' + ",".join(at) + "]}"
    rows = [("c", 1, i, "page", 200, 1, body(i), False, 1, None, {}) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, PAGES_SCHEMA)


def test_a_slice_reads_the_files_of_its_zone(spark):
    folder, zones = scratch_path(spark, "t-pages"), scratch_path(spark, "t-zones")
    pages = zone_pages(spark, 25)
    for lo in (1, 21):
        pages.filter(F.col("page_idx").between(lo, lo + 19)).repartitionByRange(25, "page_idx").write.mode("append").parquet(folder)
        if lo == 1:
            assert W.add_zones(spark, folder, zones, "$.data", "$.t") == 20
            assert W.add_zones(spark, folder, zones, "$.data", "$.t") == 0
    def days(start, end, closed=False):
        return sorted(r["page_idx"] for r in W.pages_within(spark, folder, zones, start, end, closed).collect())
    late = list(range(21, 26))           # no zone yet: always read
    assert days("2024-01-03", "2024-01-05") == [3, 4] + late
    W.add_zones(spark, folder, zones, "$.data", "$.t")
    assert days("2024-01-03", "2024-01-05") == [3, 4]
    assert days("2024-01-03", "2024-01-05", closed=True) == [3, 4, 5, 9]      # a record without a time stays
    assert days("2025-01-03", "2025-01-05") == []


def test_blocks_of_uneven_keys_stay_small(spark):
    n = 20000
    dense = spark.range(n).select(F.lit("g").alias("g"), F.col("id"), F.when(F.col("id") == 7, F.lit("0001-01-01 00:00:00").cast("timestamp"))
                                  .when(F.col("id") % 1000 == 8, F.lit(None)).otherwise(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).alias("at"))
    key = O._key_num(F.col("at"), "timestamp")
    lo, hi, rows, none, _, at = O._bounds(dense, key)
    ranges = O._ranges(lo, hi, rows - none, at, 500)
    most = dense.filter(F.col("at").isNotNull()).groupBy(O._block_of(key, ranges)).count().agg(F.max("count")).first()[0]
    assert most <= 4 * 500
    got = O.with_ordinal(dense, ["g"], "at", block=500, key_kind="timestamp", tiebreak=["id"]).select("id", "rn").collect()
    assert sorted(r["rn"] for r in got) == list(range(n))
    place = {r["id"]: r["rn"] for r in got}
    timed = [7] + [i for i in range(n) if i != 7 and i % 1000 != 8]
    assert [place[i] for i in timed] == list(range(len(timed)))


def test_even_and_equal_keys_have_one_range():
    at = [round(s * 1000) for s in O.SHARES]
    assert len(O._ranges(0, 999, 100_000, at, 1000)) == 1
    assert O._ranges(5, 5, 100_000, [5] * len(O.SHARES), 1000)[0][0] == 5
    assert O._ranges(0, 0, 0, [], 1000) == [(0, 1000, 0)]


def test_nested_schema_of_records_that_disagree(spark):
    import json
    from sluice.operators.infer import nested_schema
    from tests.conftest import one_body_records
    recs = one_body_records(spark, '{"data":[{"a":1,"b":{"c":"x\\"y","d":null},"e":[1,{"f":2}]},{"a":2.5,"b":7,"g":{}},3,null]}')
    got = nested_schema(recs).collect()
    assert len(got) == 1 and got[0]["connector_id"] == "c1"
    assert json.loads(got[0]["record_schema"]) == {"type": "object", "properties": {
        "a": {"type": "double", "example": 1}, "b": {"type": "object", "properties": {
            "c": {"type": "string", "example": 'x"y'}, "d": {"type": "string", "example": "null"}}},
        "e": {"type": "string", "example": '[1,{"f":2}]'}, "g": {"type": "object", "properties": {}}}}
    empty = nested_schema(one_body_records(spark, '{"data":[3]}'), group=()).collect()
    assert json.loads(empty[0]["record_schema"]) == {"type": "object", "properties": {}}
