"""The registered queries on the smallest tables: against SQL where there is some, and the pipeline against brute force."""
import os

import pytest

import corpus_pipeline
from sluice.llm.registered import ORACLE, QUERIES
from tests.test_queries_oracle import SF, _digest, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols) and _digest(df.columns, rows) == _digest(cols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_covers_every_row(spark, name):
    df = QUERIES[name](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if name == "op3_permutation_search":
        n = spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 100 = 0").count()
        assert df.count() == 10 * n
    else:
        assert sorted(r[0] for r in df.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_a_query_for_each_operator_is_registered():
    assert {f"op{i}" for i in range(1, 14)} == {n.split("_")[0] for n in QUERIES}


def test_pipeline_matches_brute_force(spark, tmp_path):
    from sluice.llm import langid, sharding
    from tests.llm.test_near import brute
    from tests.llm.test_rows import shingles_any
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert out.columns == [*docs.columns, "shard", "slot"]
    model = langid.train_language_model(docs, learn=~langid.held_out())
    passed = {r["doc_id"]: r["text"] for r in langid.detect_language(docs, model).filter("accepted").collect()}
    roots = {i: c for i, _, c in brute(sorted(passed.items()))}
    kept = {i: t for i, t in passed.items() if roots[i] == i}
    items = [shingles_any(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, t in kept.items():
        mine = shingles_any(t)
        if not any(s and len(s & mine) / len(s) >= 0.8 for s in items):
            clean.add(i)
    assert {r["doc_id"] for r in rows} == clean and len(rows) == len(clean) < docs.count()
    homes = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, sharding.topology(8), carry=["doc_id"]).collect()}
    assert all(homes[r["doc_id"]] == r["shard"] for r in rows)
    for s in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_stages_keep_the_columns_and_take_clashing_names(spark, make_docs):
    docs = make_docs([(i, f"the words of document number {i} and that this with there are {i * 7} more", f"s{i % 3}") for i in range(30)] + [(40, None), (41, ""), (None, "a text that has no id of its own")])
    for name, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == [*docs.columns, "shard", "slot"] and 25 <= last.count() <= 31
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, make_docs([]), SF).count() == 0
    assert os.path.basename(SF) == "sf0.001"


def mix_positions(df):
    from sluice.llm.mixing import mix
    return {r["doc_id"]: (r["at"], r["place"]) for r in mix(df.select("doc_id", "source"), slot="at").collect()}


def assert_slots_follow_the_mix(out):
    places, rows = mix_positions(out), out.select("doc_id", "shard", "slot").collect()
    for s in {r["shard"] for r in rows}:
        mine = sorted((r["slot"], places[r["doc_id"]]) for r in rows if r["shard"] == s)
        assert [x[0] for x in mine] == list(range(len(mine)))
        assert all(a[1] < b[1] for a, b in zip(mine, mine[1:], strict=False)), s


def test_pipeline_slots_follow_the_mix(spark):
    from sluice.llm.common import stage
    assert_slots_follow_the_mix(stage(corpus_pipeline.run(spark, SF), "pipeline_out"))


def test_shard_slots_follow_the_mix_with_a_hot_source(spark, make_docs):
    docs = make_docs([(i, "a text", "hot" if i % 10 else f"s{i % 70}") for i in range(3000)])
    assert_slots_follow_the_mix(corpus_pipeline.shards(spark, docs, SF))
