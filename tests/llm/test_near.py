import pytest
from pyspark.sql import functions as F
"""SimHash near-dedup and permutation search against brute force."""
import random
import re

import numpy as np
import xxhash

from sluice.llm import simhash
from sluice.llm.permutation import search
from sluice.llm.simhash import forest, golay_decoder, keep_representatives, near_duplicates


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=3):
    fp = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= distance:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fp, root)), key=str)


def texts(seed):
    r = random.Random(seed)
    rows = []
    for i in range(60):
        words = [r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randint(0, 30)) for _ in range(r.randint(3, 300))]
        rows.append((i, " ".join(words)))
        for k in range(r.randint(0, 3)):
            w = list(words)
            w[r.randrange(len(w))] = "CHANGED"
            rows.append((100 + 10 * i + k, "  ".join(w)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two"), (None, "one two"), (None, "alone here now"), (7, rows[0][1])]


def run(make_docs, rows):
    got = near_duplicates(make_docs(rows)).collect()
    return sorted(((r[0], f"{r[1] & (2 ** 64 - 1):016x}", r[2]) for r in got), key=str)


def test_components_match_brute_force(make_docs):
    rows = texts(3)
    assert run(make_docs, rows) == brute(rows)


def test_large_anchors_are_compared_in_pieces(make_docs, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 1)
    monkeypatch.setattr(simhash, "PIECE", 2)
    rows = texts(5)
    assert run(make_docs, rows) == brute(rows)


def test_anchors_cover_every_close_pair():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 32, 400).astype(np.uint32)
    y = x ^ (np.uint32(1) << r.integers(0, 32, 400).astype(np.uint32))
    near = simhash.anchors_within(y, 1)
    assert all(h in row for h, row in zip(simhash.anchor(x), near))
    assert set(np.bincount(golay_decoder())) == {2048}


def test_chains_join_one_component(make_docs, spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100
    assert list(forest((np.array([3, 2, 0]), np.array([2, 1, 4])), 5)) == [0, 1, 1, 1, 0]


def test_representatives_stay(make_docs):
    docs = make_docs([(5, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (8, "quite another text here"), (None, "a b c d e")])
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "8"]
    assert keep_representatives(make_docs([])).count() == 0


def vectors(spark, n, seed=0, dim=16):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x, spark.createDataFrame([(i, [float(v) for v in row], "e") for i, row in enumerate(x)], "vec_id long, embedding array<float>, id string")


def nearest(x, q, k):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(x)), d))[:k], d


def test_search_recall_and_scores(spark):
    x, df = vectors(spark, 3000)
    got = search(df, df.filter("vec_id % 100 = 0"), wanted=600, n_pivots=64, prefix=16).collect()
    hits = 0
    for q in range(0, 3000, 100):
        rows = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        best, d = nearest(x, q, 10)
        assert [r["rank"] for r in rows] == list(range(1, 11)) and [r["score"] for r in rows] == sorted(r["score"] for r in rows)
        assert all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in rows)
        hits += len({r["vec_id"] for r in rows} & set(best.tolist()))
    assert hits / 300 >= 0.9


@pytest.mark.parametrize("rows,needed", [(10256, 1784), (51282, 6704), (200000, 16292), (1000000, 47712), (2000000, 83389)])
def test_candidates_reach_a_recall_of_095(rows, needed):
    """``needed``: measured by brute force, random unit vectors of 64 dimensions (51,282: the given table or random ones, the larger)."""
    from sluice.llm.permutation import candidates
    assert candidates(rows) >= needed


def test_search_recall_at_the_default_setting(spark):
    x, df = vectors(spark, 8000, 5, 64)
    got = search(df, df.filter("vec_id % 100 = 0")).collect()
    found = {(r["query_id"], r["vec_id"]) for r in got}
    assert sum((q, int(v)) in found for q in range(0, 8000, 100) for v in nearest(x, q, 10)[0]) / 800 >= 0.95


def test_search_is_exact_when_all_are_wanted(spark):
    x, df = vectors(spark, 700, 2)
    got = search(df, df.filter("vec_id % 100 = 0")).collect()
    for q in range(0, 700, 100):
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == nearest(x, q, 10)[0].tolist()


def test_search_leaves_out_unusable_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (7, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0]), (None, [1.0, 2.0]), (100, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in search(df, df.filter("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 7), (0, 2, 8), (0, 3, 8), (0, 4, 100), (100, 1, 0), (100, 2, 7), (100, 3, 8), (100, 4, 8)]
    assert search(df.limit(0), df).count() == 0


def test_search_leaves_out_the_own_row_only(spark):
    rows = [(1, [1.0, 0.1]), (1, [5.0, 5.0]), (2, [1.0, 2.0, 3.0]), (3, [1.0, 2.0, 4.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = lambda ids: sorted((r["query_id"], r["rank"], r["vec_id"]) for r in search(df, df.filter(F.col("vec_id").isin(ids)), k=3).collect())
    assert got([1]) == sorted([(1, 1, 100), (1, 2, 100), (1, 3, 100), (1, 1, 1), (1, 2, 100), (1, 3, 100)])
    assert got([2]) == [(2, 1, 3)] and got([3]) == [(3, 1, 2)]
    assert got([100]) == sorted([(100, 1, 100), (100, 2, 1), (100, 3, 100), (100, 1, 1), (100, 2, 100), (100, 3, 100)])


def test_rows_that_share_an_id_stay_by_their_own_text(make_docs):
    unique = "quite another text that nobody else has"
    docs = make_docs([(1, "a b c d e"), (2, "a b c d e"), (2, unique), (4, "x y z u v"), (4, "x y z u v"), (None, "x y z u v"), (None, "only null ids k l m"), (None, "only null ids k l m"), (7, None), (8, "")])
    kept = sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in keep_representatives(docs).collect())
    assert [(i, t) for _, i, t in kept] == [(1, "a b c d e"), (2, unique), (4, "x y z u v"), (7, ""), (None, "only null ids k l m")]
