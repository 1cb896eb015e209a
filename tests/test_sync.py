"""Runs of connectors: one commit, modes, limits, details, and external sinks."""
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from sluice.operators import config as C
from sluice.operators import sinks as K
from sluice.operators import sync as Y
from sluice.operators import tables as B
from sluice.sources.landed import PAGES_SCHEMA

STEPS = ({"type": "map_fields", "mappings": [{"source": "id", "target": "id", "type": "long"}]},)


def config(**changes):
    return Y.SyncConfig(**{"steps": STEPS, "keys": ("id",), "inc_enabled": True, "response_path": "$.at", **changes})


def pages(spark, run, rows, status=200, connector="c", cursor=None):
    """Pages of (id, day of January) pairs; ``rows``: a list a page."""
    rows = rows if rows and isinstance(rows[0], list) else [rows]
    out = []
    for i, page in enumerate(rows):
        body = '{"next":%s,"data":[' % json.dumps(cursor[i] if cursor else "x") + ",".join('{"id":%s,"at":"2024-01-%02dT00:00:00Z"}' % r for r in page) + "]}"
        out.append((connector, run, i, "page", status, 1, body, False, len(body), None, {}))
    return spark.createDataFrame(out, PAGES_SCHEMA)


def state(spark, base):
    return {r["connector_id"]: str(r["ts"]) for r in Y.read_state(spark, base).collect()}


def test_a_run_that_breaks_off_leaves_nothing(spark, tmp_path):
    base = str(tmp_path / "b")

    def crash():
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        Y.run_sync(pages(spark, 1, [(1, 1), (2, 2)]), config(), base, 1, "2024-02-01", "full", before_commit=crash)
    assert B.versions(spark, base) == [] and Y.read_state(spark, base).count() == 0 and Y.read_runs(spark, base).count() == 0
    for _ in range(2):                                    # again, and once more after it is done
        got = Y.run_sync(pages(spark, 1, [(1, 1), (2, 2), ('"bad"', 3)]), config(), base, 1, "2024-02-01", "full")
        assert got["version"] == 1 and state(spark, base) == {"c": "2024-01-03 00:00:00"} and B.read_table(spark, base).count() == 2
    Y.run_sync(pages(spark, 3, [(9, 9)], status=500), config(), base, 3, "2024-02-01", "full")
    runs = {r["run_id"]: (r["mode"], r["status"], r["records_ok"], r["records_failed"], r["error_message"]) for r in Y.read_runs(spark, base).collect()}
    assert runs == {1: ("full", "success", 2, 1, None), 3: ("full", "failed", 0, 0, "HTTP status 500")}
    assert state(spark, base) == {"c": "2024-01-03 00:00:00"} and B.read_table(spark, base).count() == 2
    details = sorted((r["run_id"], r["stage"], r["page_idx"], r["record_index"], r["message"]) for r in Y.read_details(spark, base).select("*").fillna(-1).collect())
    assert details == [(1, "http", 0, -1, "page fetched records=3 durationMs=1"), (1, "transform", -1, 2, "cannot convert field 'id' to long: bad"), (3, "http", 0, -1, "HTTP status 500")]


def test_watermark_modes(spark, tmp_path):
    base, as_of = str(tmp_path / "t"), "2024-02-01 00:00:00"
    Y.run_sync(pages(spark, 1, [(1, 5)]), config(), base, 1, as_of, "incremental")               # no watermark yet, on_first_run is full
    assert state(spark, base) == {"c": "2024-01-05 00:00:00"} and Y.read_runs(spark, base).first()["mode"] == "full"
    Y.run_sync(pages(spark, 2, [(1, 5)]), config(bump=False), base, 2, as_of)
    assert state(spark, base) == {"c": "2024-01-05 00:00:00"}
    Y.run_sync(pages(spark, 3, [(1, 5)]), config(), base, 3, as_of)                                # nothing newer: it becomes now
    assert state(spark, base) == {"c": as_of}
    Y.run_sync(pages(spark, 4, []), config(inc_mode="rolling_window"), base, 4, as_of)             # the window's end, without a record too
    assert state(spark, base) == {"c": "2024-02-01 00:01:00"}
    first = str(tmp_path / "f")
    Y.run_sync(pages(spark, 1, [(1, 5)]), config(on_first_run="incremental"), first, 1, as_of)
    assert state(spark, first) == {"c": as_of}
    ids = str(tmp_path / "i")
    for run, rows in ((1, [(9, 1), (12, 1)]), (2, [(10, 1)])):
        Y.run_sync(pages(spark, run, rows), config(inc_mode="monotonic_id", response_path="$.id"), ids, run, as_of)
        assert Y.read_state(spark, ids).first()["last_id"] == "12"


def test_pages_beyond_the_stop_and_the_limit_don_t_count(spark, tmp_path):
    three = [[(1, 1), (2, 2)], [(3, 3)], [(4, 4)]]
    base = str(tmp_path / "s")
    Y.run_sync(pages(spark, 1, three, cursor=["a", "", "b"]), config(strategy="cursor", cursor_path="$.next"), base, 1, "2024-02-01", "full")
    assert sorted(r["id"] for r in B.read_table(spark, base).collect()) == [1, 2, 3] and state(spark, base) == {"c": "2024-01-03 00:00:00"}
    base = str(tmp_path / "l")
    with pytest.raises(ValueError, match="limit"):
        Y.run_sync(pages(spark, 1, three), config(), base, 1, "2024-02-01", "sample")
    got = Y.run_sync(pages(spark, 1, three), config(), base, 1, "2024-02-01", "sample", record_limit=3)
    assert got["written"] == 3 and sorted(r["id"] for r in B.read_table(spark, base).collect()) == [1, 2, 3] and state(spark, base) == {}


def test_connectors_in_one_run_keep_their_own_keys(spark, tmp_path):
    both = pages(spark, 1, [(1, 1)]).unionByName(pages(spark, 1, [(1, 2), (5, 2)], connector="d")).unionByName(pages(spark, 1, [(7, 2)], status=404, connector="e"))
    with pytest.raises(K.SinkError, match="connector_column"):
        Y.run_sync(both, config(), str(tmp_path / "x"), 1, "2024-02-01", "full")
    base = str(tmp_path / "b")
    Y.run_sync(both, config(connector_column="connector_id"), base, 1, "2024-02-01", "full")
    assert sorted((r["connector_id"], r["id"]) for r in B.read_table(spark, base).collect()) == [("c", 1), ("d", 1), ("d", 5)]
    assert {r["connector_id"]: r["status"] for r in Y.read_runs(spark, base).collect()} == {"c": "success", "d": "success", "e": "failed"} and set(state(spark, base)) == {"c", "d"}


def test_inserts_keep_every_record_of_every_run(spark, tmp_path):
    base = str(tmp_path / "b")
    for run in (1, 2, 2):
        Y.run_sync(pages(spark, run, [(1, 1), (1, 1)]), config(write_mode="insert"), base, run, "2024-02-01", "full")
    assert [r["id"] for r in B.read_table(spark, base).collect()] == [1, 1, 1, 1]


def database(path, fail=0):
    """A connect(url) over a file; the first ``fail`` connections break off before their commit."""
    def connect(url):
        import sqlite3 as db
        conn = db.connect(url, timeout=60)

        class Connection:
            cursor, rollback, close = conn.cursor, conn.rollback, conn.close

            def commit(self):
                with open(url + ".tries", "a") as f:
                    f.write("x")
                import os
                if os.path.getsize(url + ".tries") <= fail:
                    raise RuntimeError("lost")
                conn.commit()
        return Connection()
    return connect


def rows_of(path, sql):
    with sqlite3.connect(path) as conn:
        return conn.execute(sql).fetchall()


def test_a_configured_run_ends_in_its_sink(spark, tmp_path, monkeypatch):
    text = json.dumps({"http": {"url": "http://x"}, "incremental": {"enabled": True, "timestamp": {"response_path": "$.at"}}, "transform": {"steps": [dict(STEPS[0])]},
                       "sink": {"target": {"schema": "main", "table": "t"}, "keys": ["id"], "batch_size": 2}})
    row = C.parse_configs(spark.createDataFrame([(text,)], "config string")).first()
    db = str(tmp_path / "db")
    with sqlite3.connect(db) as conn:
        conn.execute("CREATE TABLE t (id INTEGER PRIMARY KEY)")
    chosen = Y.SyncConfig.from_row(row, url=db, connect=database(db))
    assert (chosen.sink, chosen.table, chosen.schema, chosen.batch_size, chosen.strategy, chosen.max_pages) == ("postgresql", "t", "main", 2, "page_page_size", 1000)
    for run in (1, 2):
        assert Y.run_sync(pages(spark, run, [(i, 1) for i in range(5)]), chosen, str(tmp_path / "b"), run, "2024-02-01")["written"] == 5
    assert sorted(rows_of(db, "SELECT id FROM t")) == [(i,) for i in range(5)]
    kafka = json.loads(text)
    kafka["sink"] = {"type": "kafka", "target": {"topic": "events"}, "keys": ["id"]}
    chosen = Y.SyncConfig.from_row(C.parse_configs(spark.createDataFrame([(json.dumps(kafka),)], "config string")).first())
    sent = []
    monkeypatch.setattr(K, "write_kafka", lambda df, topic, keys, **o: sent.append((topic, keys, sorted(r["id"] for r in df.collect()))) or df.count())
    assert Y.run_sync(pages(spark, 1, [(1, 1), (2, 1)]), chosen, str(tmp_path / "k"), 1, "2024-02-01")["written"] == 2 and sent == [("events", ["id"], [1, 2])]
    blank = Y.replace(chosen, topic=" ")
    with pytest.raises(K.SinkError, match="topic"):
        Y.run_sync(pages(spark, 1, [(1, 1)]), blank, str(tmp_path / "z"), 1, "2024-02-01")


def test_inserts_of_a_repeated_load_leave_one_copy(spark, tmp_path, monkeypatch):
    """The first commits are lost; the load is sent again under its id, with the marks in the transaction of the rows."""
    db = str(tmp_path / "db")
    with sqlite3.connect(db) as conn:
        conn.execute("CREATE TABLE t (k INTEGER, v TEXT)")
        conn.execute("CREATE TABLE loads (load_id TEXT, part INTEGER)")
    staged = str(tmp_path / "staged-load")
    monkeypatch.setattr(K, "scratch_path", lambda s, n: staged)
    df = spark.range(40).select(F.col("id").alias("k"), F.lit("v").alias("v"))
    write = lambda fail: K.route("postgresql")(df, table="t", keys=["k"], write_mode="insert", url=db, connect=database(db, fail), loads_table="loads")
    with pytest.raises(Exception, match="lost"):
        write(2)
    kept = len(rows_of(db, "SELECT * FROM t"))
    assert kept < 40
    for n in range(2):                    # the same load id in other folders, as a retried task has it
        monkeypatch.setattr(K, "scratch_path", lambda s, name, n=n: str(tmp_path / f"again-{n}" / "staged-load"))
        assert write(0) == 40
        assert sorted(rows_of(db, "SELECT k FROM t")) == [(i,) for i in range(40)]
    marks = rows_of(db, "SELECT * FROM loads")
    assert len(marks) == len(set(marks)) == 5
