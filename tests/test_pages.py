"""Landed pages: the empty page after the last one, and pages streamed in parts."""
import json

from pyspark.sql import functions as F

from sluice.sources.landed import PAGE_COLUMNS, land_pages


def test_an_empty_page_follows_the_last_of_each_connector(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), (None, 3)], "c string, k bigint")
    pages = land_pages(rows, F.col("c"), "k", F.to_json(F.struct("k")), page_size=2, cursor=True, link=True, empty_tail=True)
    assert pages.columns == PAGE_COLUMNS
    got = {(r["connector_id"], r["page_idx"]): json.loads(r["body"]) for r in pages.collect()}
    assert {k: [x["k"] for x in b["data"]] for k, b in got.items()} == {
        ("a", 0): [0, 1], ("a", 1): [2, 3], ("a", 2): [4], ("a", 3): [], ("b", 0): [9], ("b", 1): [], (None, 0): [3], (None, 1): []}
    assert {k: b["meta"]["hasMore"] for k, b in got.items() if k[0] == "a"} == {("a", 0): True, ("a", 1): True, ("a", 2): False, ("a", 3): False}


def test_records_are_converted_once(spark):
    """Nothing that a record is parsed or converted with stands in a filter: below the stages it would run again, inlined."""
    import re
    from sluice.operators import extract as X
    from sluice.operators import transform as T
    rows = spark.createDataFrame([(i, str(i)) for i in range(6)] + [(6, "x")], "k bigint, q string")
    pages = land_pages(rows, F.lit("c"), "k", F.to_json(F.struct("k", "q")), page_size=3)
    steps = [{"type": "map_fields", "mappings": [{"source": "$.k", "target": "k", "type": "long"}, {"source": "$.q", "target": "q", "type": "long"}]}]
    res = T.transform(X.extract_records(pages, "$.data"), steps)
    plan = res.rows._jdf.queryExecution().optimizedPlan().toString()
    filters = re.findall(r"(?m)^\W*Filter .*$", plan)
    assert filters and not [f for f in filters if "parseJson" in f or "try_variant_get" in f]
    assert sorted((r["k"], r["q"]) for r in res.rows.collect()) == [(i, i) for i in range(6)]
    assert [(r["record_index"], r["message"]) for r in res.errors.collect()] == [(6, "cannot convert field 'q' to long: x")]


def test_few_bytes_and_much_work_are_dealt(spark, tmp_path):
    """One small file, whatever its rows: the configs, documents and deep records of it are made in many tasks."""
    import __spark_entry__ as E
    for name, column in (("customer", "c_custkey"), ("part", "p_partkey")):
        spark.range(64).select(F.col("id").alias(column)).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("s1_config_defaults", "o8_paging_paths"):
        df = E.queries()[query](spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 1 and df.count() == 64
    for query in ("g1_one_rule_each", "g2_one_rule_each"):
        df = E.queries()[query](spark, str(tmp_path))
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 4 * 64


def test_smallest_samples_and_counts_of_paths(spark):
    from sluice.operators import extract as X
    recs = spark.createDataFrame([('{"a":{"b":"y"}}',), ('{"a":{"b":"x"}}',), ('{"a":{"b":"x"},"c":null}',)], "j string").select(F.parse_json("j").alias("rec"))
    cat = X.path_catalogue(recs)
    assert {tuple(r) for r in cat.collect()} == {("$.a", 3, None), ("$.a.b", 3, "x"), ("$.c", 1, "null")}
    plan = cat._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.split("Generate explode")[0]      # no array is evaluated again to see that it is not empty


def test_micro_batches_do_not_grow_with_the_partitions(spark, tmp_path):
    from sluice.plans import q_stream as Q
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, per in ((1, 1), (8, 2), (200, 50)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert Q._files_a_batch(spark.range(1), 4) == per
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
