"""Keyed tables under a commit log, and the writers that share them."""
import json
import threading

import pytest
from pyspark.sql import functions as F

from sluice.operators import tables as B
from sluice.streaming import pages as pages_stream
from sluice.streaming import push


def frame(spark, rows, schema="k int, v string, run_id int, pos int"):
    return spark.createDataFrame(rows, schema)


def held(spark, base, version=None):
    return {r["k"]: r["v"] for r in B.read_table(spark, base, version=version).collect()}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    base = str(tmp_path / "t")
    B.upsert_table(frame(spark, [(i, f"v{i}", 1, i) for i in range(200)]), base, ["k"], buckets=8)
    B.upsert_table(frame(spark, [(7, "new", 2, 0), (7, "older", 1, 999)]), base, ["k"])
    before, after = (B.read_version(spark, base, n).tables["rows"].files for n in (1, 2))
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    got = held(spark, base)
    assert len(got) == 200 and got[7] == "new" and got[8] == "v8"
    B.upsert_table(frame(spark, [(7, "late", 0, 5)]), base, ["k"])
    assert held(spark, base)[7] == "new" and held(spark, base, 1)[7] == "v7"
    assert B.drop_old_versions(spark, base, keep=1) == [1, 2]
    assert B.versions(spark, base) == [3] and B.read_table(spark, base).count() == 200


def test_another_bucket_count_leaves_no_stale_rows(spark, tmp_path):
    base = str(tmp_path / "t")
    for n, buckets in enumerate((4, 8, 3)):
        B.upsert_table(frame(spark, [(i, f"v{n}", n, i) for i in range(50)]), base, ["k"], buckets=buckets)
        assert held(spark, base) == dict.fromkeys(range(50), f"v{n}")
    assert B.read_version(spark, base).tables["rows"].first == 4


def test_growing_table_splits_buckets_in_turn(spark, tmp_path):
    """20 batches: equal to one last-row-wins, no bucket above twice the target, untouched files unchanged."""
    base, target = str(tmp_path / "t"), 400
    rows = lambda n: spark.range(n * 700, n * 700 + 1000).select((F.col("id") % 9000).cast("int").alias("k"), F.concat(F.lit(f"b{n}-"), "id").alias("v"), F.lit(n).alias("run_id"), F.lit(0).alias("pos"))
    everything, splits = None, 0
    for n in range(20):
        before = B.read_version(spark, base)
        B.upsert_table(rows(n), base, ["k"], buckets=2, target=target)
        everything = rows(n) if everything is None else everything.unionByName(rows(n))
        now = B.read_version(spark, base).tables["rows"]
        assert max(r for _, r in now.files.values()) <= 2 * target
        if before is not None:
            old = before.tables["rows"]
            new_ids = set(range(old.buckets, now.buckets))
            touched = {r[0] for r in rows(n).select(old.address(F.xxhash64("k"))).distinct().collect()} | {old.parent(b) for b in new_ids} | new_ids
            assert all(now.files[b] == f for b, f in old.files.items() if b not in touched)
            splits += len(new_ids)
    want = {r["k"]: r["v"] for r in B.dedupe_last(everything, ["k"], ("run_id",)).collect()}
    assert held(spark, base) == want and now.rows == len(want) == 9000 and splits > 15
    every = B.read_table(spark, base).withColumn("b", now.address(F.xxhash64("k"))).groupBy("b").count().collect()
    assert {r["b"]: r["count"] for r in every} == {b: n for b, (_, n) in now.files.items()}


@pytest.mark.parametrize("first", [1, 2, 3, 16])
def test_buckets_come_from_their_parents(spark, first):
    """A key's bucket in a grown directory is its old one, or one that was split out of it."""
    small = B.Directory((("k", "int"),), "{}", first, 100)
    for rows in (0, 500, 5000, 40_000):
        big = small.grown(rows)
        assert big.buckets * 75 >= rows or big.buckets == first
        got = spark.range(2000).select(small.address(F.xxhash64("id")).alias("a"), big.address(F.xxhash64("id")).alias("b")).distinct().collect()
        assert all(0 <= r["b"] < big.buckets and small.parent(r["b"]) == r["a"] for r in got)


def test_new_columns_types_and_keys(spark, tmp_path):
    base = str(tmp_path / "t")
    B.upsert_table(frame(spark, [(1, "a", 1, 0), (2, "b", 1, 0)]), base, ["k"])
    B.upsert_table(frame(spark, [(2, 5, 2, 0)], "k bigint, extra int, run_id int, pos int"), base, ["k"])        # the key's type is the table's
    got = {r["k"]: (r["v"], r["extra"]) for r in B.read_table(spark, base).collect()}
    assert got == {1: ("a", None), 2: (None, 5)}
    with pytest.raises(B.SinkError, match="column 'v'"):
        B.upsert_table(frame(spark, [(1, 1, 1, 0)], "k int, v int, run_id int, pos int"), base, ["k"])
    with pytest.raises(B.SinkError, match="key"):
        B.upsert_table(frame(spark, [(1, "x", 1, 0)]), base, ["v"])
    assert B.versions(spark, base) == [1, 2]
    B.upsert_table(frame(spark, []), str(tmp_path / "e"), ["k"])
    assert B.read_table(spark, str(tmp_path / "e")).count() == 0


def test_of_two_writers_one_starts_again(spark, tmp_path):
    base = str(tmp_path / "t")
    B.upsert_table(frame(spark, [(0, "start", 0, 0)]), base, ["k"])
    a, b = (B.stage_batch(frame(spark, [(n, f"w{n}", n, 0), (9, f"w{n}", n, 0)]), ["k"], B.DEFAULT_ORDER) for n in (1, 2))
    change = lambda s: lambda v: B.replace(v, tables={**v.tables, "rows": B.merge(spark, base, "rows", v.tables["rows"], s)})
    raced = []

    def other():
        if not raced:
            raced.append(B.commit(spark, base, change(b), "two", 0))
    assert B.commit(spark, base, change(a), "one", 0, before_commit=other) == 3 and raced == [2]
    assert held(spark, base) == {0: "start", 1: "w1", 2: "w2", 9: "w2"}
    assert B.commit(spark, base, change(a), "one", 0) == 3 and B.read_version(spark, base).writers == {"one": 0, "two": 0}


def test_one_of_many_puts_the_version(spark, tmp_path):
    wins, path = [], str(tmp_path / "log" / "1.json")
    threads = [threading.Thread(target=lambda n=n: wins.append(n) if B.put_if_absent(spark, path, json.dumps(n)) else None) for n in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(wins) == 1 and json.loads((tmp_path / "log" / "1.json").read_text()) == wins[0]
    assert [p.name for p in (tmp_path / "log").iterdir() if p.name.endswith(".json")] == ["1.json"]


# ---- streams -------------------------------------------------------------------

def page(spark, ids, run=1):
    from sluice.sources.landed import PAGES_SCHEMA
    body = '{"data":[' + ",".join('{"id":%d}' % i for i in ids) + "]}"
    return spark.createDataFrame([("c", run, 0, "page", 200, 1, body, False, len(body), None, {})], PAGES_SCHEMA)


STEPS = [{"type": "map_fields", "mappings": [{"source": "$.id", "target": "id", "type": "long"}]}]


def test_page_streams_with_checkpoints_of_their_own_share_a_table(spark, tmp_path):
    table = str(tmp_path / "table")
    ids = lambda: sorted(r["id"] for r in B.read_table(spark, table).collect())
    for name, mine in (("a", [1, 2]), ("b", [3, 4])):
        page(spark, mine).write.parquet(str(tmp_path / name))
        pages_stream.run_pages_stream(spark, str(tmp_path / name), "$.data", STEPS, ["id"], table, str(tmp_path / f"ckpt-{name}"))
    assert ids() == [1, 2, 3, 4]
    page(spark, [5]).write.mode("append").parquet(str(tmp_path / "a"))
    for _ in range(2):                          # a restart takes the new page, another one nothing
        pages_stream.run_pages_stream(spark, str(tmp_path / "a"), "$.data", STEPS, ["id"], table, str(tmp_path / "ckpt-a"))
        assert ids() == [1, 2, 3, 4, 5] and len(B.versions(spark, table)) == 3
    pages_stream.run_pages_stream(spark, str(tmp_path / "b"), "$.data", STEPS, ["id"], table, str(tmp_path / "ckpt-renewed"))
    assert ids() == [1, 2, 3, 4, 5]


CONNECTORS = "connector_id string, mode string, published boolean, webhook_enabled boolean, verify_sign boolean, plat_flag string"
MAPS = [{"source": "$.EventID", "target": "event_id", "type": "string"}]


def test_push_replay_after_a_crash_loses_nothing(spark, tmp_path, monkeypatch):
    batch = spark.createDataFrame([("c", f"r{i}", "", i, '{"EventID":"E%d"}' % (i % 3)) for i in range(5)] + [("none", "r9", "", 9, "{}")], push.PUSH_SCHEMA)
    conns = spark.createDataFrame([("c", "push", True, True, False, "p")], CONNECTORS)
    paths = [str(tmp_path / p) for p in ("table", "results", "runs")]

    def crash(*a, **k):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(B, "upsert_table", crash)
        with pytest.raises(RuntimeError):
            push.process_batch(batch, 0, conns, MAPS, *paths)
    assert B.read_table(spark, paths[0]) is None
    for _ in range(2):      # the replay, and another one of a complete batch
        push.process_batch(batch, 0, conns, MAPS, *paths)
        assert sorted(r["event_id"] for r in B.read_table(spark, paths[0]).collect()) == ["E0", "E1", "E2"]
        assert spark.read.parquet(paths[1]).count() == 6 and spark.read.parquet(paths[2]).count() == 5
    push.process_batch(batch.limit(0).unionByName(spark.createDataFrame([("c", "r7", "", 7, '{"EventID":"E9"}')], push.PUSH_SCHEMA)), 0, conns, MAPS, *paths, writer="renewed")
    assert sorted(r["event_id"] for r in B.read_table(spark, paths[0]).collect()) == ["E0", "E1", "E2", "E9"]
    assert spark.read.parquet(paths[1]).count() == 7 and spark.read.parquet(paths[2]).count() == 6
