"""The run log as a stream: alerts (J16, J17) and running statistics.

``run_alerts`` keeps per connector what an alert needs: the length of the
current failure streak, the failures of the trailing window as counts per
second, and the runs that wait for the watermark. Connectors are dealt over
``parts`` by their id, and the state of a part is held and judged as one
table, so the calls to the state store don't grow with the connectors. Runs are judged in the order
(started_at, id) once the watermark has passed the end of their second, so the
alerts don't depend on how the log is cut into micro-batches, and equal the
batch operators' on the same log. A run later than the delay is dropped by
Spark (and counted in the query's progress). Runs without a start time have no
place in event time: the batch operators judge them. A row without an id only
moves the watermark, as a heartbeat of an idle log.

The state of a connector is bounded by the runs within the delay, and by the
seconds of the window; a part costs the runs of its connectors in one
micro-batch, which ``max_files_per_trigger`` bounds, and a hot connector's
stand in one part.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from sluice.operators import runs as J
from sluice.operators import tables as B
from sluice.streaming.pages import stream_id

RUN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("connector_id", T.StringType()), T.StructField("run_type", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("started_at", T.TimestampType()), T.StructField("finished_at", T.TimestampType()),
    T.StructField("records_ok", T.LongType()), T.StructField("records_failed", T.LongType())])

STREAK, WINDOW = "streak", "window"
ALERT_SCHEMA = "connector_id string, id bigint, at bigint, alert string, failures bigint"
SECOND = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Parts of a log's connectors. A call of the state costs some milliseconds, whatever it brings. More parts, smaller
# tables and more tasks; a checkpoint must go on with the number it began with.
PARTS = 128
FOUND = ("connector_id", "id", "at", "alert", "failures")
WAITING = pa.schema([("connector_id", pa.string()), ("id", pa.int64()), ("at", pa.int64()), ("failed", pa.bool_())])
STREAKS = pa.schema([("connector_id", pa.string()), ("streak", pa.int64())])
TRAILING = pa.schema([("connector_id", pa.string()), ("second", pa.int64()), ("n", pa.int64())])


def _packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(pa.py_buffer(bytes(data))) as r:
        return r.read_all()


def _codes(tables: list[pa.Table]) -> tuple[pa.Array, list[np.ndarray]]:
    """The connectors of the tables, and the number of each row's; null is a connector too."""
    each = pa.chunked_array([c for t in tables for c in t["connector_id"].chunks], pa.string()).combine_chunks().dictionary_encode("encode")
    numbers = each.indices.to_numpy(zero_copy_only=False)
    return each.dictionary, np.split(numbers.astype(np.int64), np.cumsum([len(t) for t in tables])[:-1])


class AlertState(StatefulProcessor):
    """Failure streaks of ``streak`` runs, and ``least`` failures within ``window_s`` seconds (both ends included),
    of the connectors of one part, each by its own runs."""

    def __init__(self, streak: int, window_s: int, least: int):
        self.streak, self.window_s, self.least = streak, window_s, least

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "runs binary")
        self.seen = handle.getValueState("seen", "streaks binary, trailing binary")
        self.next = handle.getValueState("next", "due bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = [pa.Table.from_pandas(part.loc[~part["beat"], WAITING.names], WAITING, preserve_index=False) for part in rows]
        came = pa.concat_tables(came) if came else WAITING.empty_table()
        if len(came):
            self.waiting.appendValue((_packed(came),))
            self._wake(came)
        yield pd.DataFrame(columns=FOUND)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = pa.concat_tables([WAITING.empty_table(), *[_unpacked(r[0]) for r in self.waiting.get()]])
        is_due = self._due(waiting["at"].to_numpy()) <= now
        rest = waiting.filter(pa.array(~is_due))
        self.next.clear()                # its timer is the one that expired
        if len(rest):
            self.waiting.put([(_packed(rest),)])
            self._wake(rest)
        else:
            self.waiting.clear()
        yield self._judge(waiting.filter(pa.array(is_due)))

    def close(self) -> None:
        pass

    def _wake(self, runs: pa.Table) -> None:
        """One timer a part: when its first run falls due."""
        due = int(self._due(runs["at"].to_numpy().min()))
        before = self.next.get()[0] if self.next.exists() else None
        if before is None or due < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
            self.next.update((due,))

    @staticmethod
    def _due(at):
        """The watermark (ms) at which every run of this second has come."""
        return (at // SECOND + 1) * 1000

    def _judge(self, due: pa.Table) -> pd.DataFrame:
        if not len(due):
            return pd.DataFrame(columns=FOUND)
        streaks, trailing = map(_unpacked, self.seen.get()) if self.seen.exists() else (STREAKS.empty_table(), TRAILING.empty_table())
        names, (of, of_streak, of_second) = _codes([due, streaks, trailing])
        ids, at, failed = (due[c].to_numpy() for c in ("id", "at", "failed"))
        order = np.lexsort((failed, ids, at, of))
        of, ids, at, failed = of[order], ids[order], at[order], failed[order]
        second, place = at // SECOND, np.arange(len(of))
        ends = np.append(of[1:] != of[:-1], True)                       # the last run of each connector
        first = np.append(0, place[ends][:-1] + 1)[np.cumsum(ends) - ends]
        # Streaks: runs since the last one that did not fail, and what the connector came with if there is none.
        before = np.zeros(len(names), np.int64)
        before[of_streak] = streaks["streak"].to_numpy()
        broken = np.maximum.accumulate(np.where(failed, first - 1, place))
        run = place - broken + np.where(broken < first, before[of], 0)
        before[of[ends]] = run[ends]
        # Failures a second: whole seconds are due together, so runs of one second count for each other.
        known = np.append(trailing["second"].to_numpy(), second[failed])
        seconds, rank = np.unique(known, return_inverse=True)
        spot, where = np.unique(np.append(of_second, of[failed]) * len(seconds) + rank, return_inverse=True)
        n = np.bincount(where, np.append(trailing["n"].to_numpy(), np.ones(failed.sum(), np.int64)), len(spot)).astype(np.int64)
        upto, t, c = np.cumsum(n), seconds[spot % max(len(seconds), 1)], spot // max(len(seconds), 1)
        since = np.searchsorted(spot, c * len(seconds) + np.searchsorted(seconds, t - self.window_s))
        within = (upto - upto[since] + n[since])[where[len(trailing):]]   # of each failed run
        last = np.full(len(names), np.iinfo(np.int64).min)
        last[of[ends]] = second[ends] - self.window_s
        kept, on = t >= last[c], np.flatnonzero(before)
        self.seen.update((_packed(pa.table([names.take(pa.array(on)), before[on]], schema=STREAKS)),
                          _packed(pa.table([names.take(pa.array(c[kept])), t[kept], n[kept]], schema=TRAILING))))
        streak, near = np.flatnonzero(run >= self.streak), np.flatnonzero(failed)[within >= self.least]
        rows = np.append(streak, near)
        return pd.DataFrame(dict(zip(FOUND, (names.take(pa.array(of[rows])).to_pandas(), ids[rows], at[rows], np.repeat([STREAK, WINDOW], [len(streak), len(near)]),
                                             np.append(run[streak], within[within >= self.least])))))


@contextmanager
def state_store(spark, provider: str = ROCKSDB, most: int | None = None):
    """The state store of the queries started inside, in at most ``most`` partitions; the session keeps its own."""
    name, number = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {n: spark.conf.get(n) for n in (name, number)}
    spark.conf.set(name, provider)
    if most is not None and most < int(before[number]):
        spark.conf.set(number, most)
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)


def read_runs_stream(spark, landed: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(RUN_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(landed)


def alerts(runs: DataFrame, delay: str, streak: int = 3, window_s: int = J.FAILURE_WINDOW_SECONDS, least: int = 3, parts: int = PARTS) -> DataFrame:
    """J16 and J17 over a stream of runs: ``(connector_id, id, started_at, alert, failures)``,
    where ``failures`` is the streak so far, or the failures in the window."""
    timed = runs.filter(F.col("started_at").isNotNull()).withWatermark("started_at", delay)
    # Heartbeats go on to the state, which passes over them: a filter here would be pushed below the watermark.
    part = F.pmod(F.xxhash64("connector_id"), F.lit(parts)).cast("int")
    given = timed.select(part.alias("part"), "connector_id", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("beat"), "started_at", F.unix_micros("started_at").alias("at"), F.coalesce(F.col("status") == J.FAILED, F.lit(False)).alias("failed"))
    found = given.groupBy("part").transformWithStateInPandas(
        AlertState(streak, window_s, least), outputStructType=ALERT_SCHEMA, outputMode="append", timeMode="EventTime")
    return found.select("connector_id", "id", F.timestamp_micros("at").alias("started_at"), "alert", "failures")


def run_alerts(spark, landed: str, out: str, checkpoint: str, delay: str, max_files_per_trigger: int | None = None, parts: int = PARTS, **kw) -> DataFrame:
    """Judge the landed runs to completion; alerts are files written once. Returns all alerts so far."""
    found = alerts(read_runs_stream(spark, landed, max_files_per_trigger), delay, parts=parts, **kw)
    with state_store(spark, most=parts):      # a partition without a part would start a worker in each micro-batch
        q = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def run_statistics(spark, landed: str, table: str, checkpoint: str, aggregate: Callable[[DataFrame], DataFrame] = J.stats_by_connector,
                   keys: Sequence[str] = ("connector_id",), max_files_per_trigger: int | None = None) -> DataFrame:
    """J1, J19 kept up to date: a streaming aggregate in update mode; each
    micro-batch writes the groups it has changed into a keyed table, named by
    stream and batch, so a replayed batch changes nothing. The state holds one
    row a group (connector, or day and connector), not the runs. A null key is a
    group of its own. Rows without an id (heartbeats) don't count."""
    changed = aggregate(read_runs_stream(spark, landed, max_files_per_trigger).filter(F.col("id").isNotNull()))

    def batch(df, bid):
        # The batch number orders the states of a group; it is there as the run.
        named = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        B.upsert_table(df.withColumn("group_key", named).withColumn("run_id", F.lit(bid).cast("bigint")), table, ["group_key"], writer=stream_id(spark, checkpoint), batch_id=bid)

    with state_store(spark):
        q = changed.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return B.read_table(spark, table).drop("run_id", "group_key")


def total_of(by_connector: DataFrame) -> DataFrame:
    """J2 from the running J1 table: one row, without a pass over the runs."""
    return by_connector.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total_runs", "success_runs", "failed_runs", "records_ok", "records_failed")])
