"""Toxicity grammar, ranked lexical search, fill-in-middle."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.llm import fim, lexical, toxicity

# ---- fill-in-middle ----------------------------------------------------------


def kinds(offsets):
    return [c.kind for c in fim.BoundarySet(np.array(offsets, np.int64)).containers]


def test_containers_take_the_smallest_form():
    rng = random.Random(1)
    assert kinds(range(5000)) == ["run"]
    assert kinds(sorted(rng.sample(range(65536), 300))) == ["array"]
    assert kinds(sorted(rng.sample(range(65536), 30000))) == ["bitmap"]
    assert kinds([0, 70000, 70002, 200000]) == ["array"] * 3


@pytest.mark.parametrize("make", [lambda r: range(70000), lambda r: sorted(r.sample(range(1 << 18), 900)), lambda r: sorted(r.sample(range(1 << 18), 120000)),
                                  lambda r: sorted({*range(3, 9000), *r.sample(range(1 << 17), 50), 10**9})])
def test_select_finds_every_member(make):
    members = list(make(random.Random(5)))
    held = fim.BoundarySet(np.array(members, np.int64))
    assert len(held) == len(members)
    for k in {0, len(members) - 1, *random.Random(2).sample(range(len(members)), 300)}:
        assert held.select(k) == members[k]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n é\U0001f600<", max_size=60))
def test_line_boundaries_count_code_points(text):
    ends, at = [0], 0
    for unit in re.findall(r"[^\n]*\n|[^\n]+", text):
        at += len(unit)
        ends.append(at)
    assert fim.line_boundaries(text.encode()).tolist() == ends


def brute_fim(doc_id, text, plain_percent=0, spm_percent=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i:8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 < plain_percent:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm_percent else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_matches_brute_force_and_restores(spark, make_docs):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n\n", "no end", "one\n", "has <M> inside\nand\nmore", "<", "a<\n<P\nS>\n", "é\nüü\n\U0001f600\nlast", "x\n" * 70000, "y" * 300000 + "\nz\n"]
    texts += ["".join(rng.choice("ab\n<PSM>é") for _ in range(rng.randint(1, 200))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null\nid\n"), (4, "a second\nrow of id four"), (4, "no end")]
    docs = make_docs(rows)
    out = fim.fill_in_middle(docs)
    assert out.columns == [*docs.columns, *fim.ADDED]
    got = out.withColumn("back", fim.restore(F.col("form"), F.col("output"))).collect()
    want = Counter((i, *brute_fim(i, t)) for i, t in rows)
    assert Counter((r["doc_id"], *(r[c] for c in fim.ADDED)) for r in got) == want
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    some = {r["doc_id"]: r["form"] for r in fim.fill_in_middle(docs.filter("doc_id > 20"), plain_percent=50, spm_percent=0).collect()}
    assert set(some.values()) == {"plain", "psm"} and all(f == brute_fim(i, dict(rows)[i], 50, 0)[1] for i, f in some.items())


def test_fill_in_middle_takes_clashing_names_and_empty_tables(spark, make_docs):
    docs = make_docs([(1, "a\nb\nc")]).withColumns({"Output": F.lit("o"), "form": F.lit("f"), "__text": F.lit("t"), "__d1": F.lit(1)})
    out = fim.fill_in_middle(docs)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and out.select("output").first()[0] == brute_fim(1, "a\nb\nc")[4]
    assert fim.fill_in_middle(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs.withColumnRenamed("text", "output2").withColumn("form", F.lit("x")), text="form")


# ---- ranked lexical search ---------------------------------------------------


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, top):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    nn, ll = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for key, t in items:
        scored = []
        for i, b in bags:
            m = 25 + (75 * b.total() * nn) // ll if ll else 0
            s = sum(n * math.floor(1000 * math.log((2 * nn + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w, n in Counter(terms_of(t)).items() if b[w])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(key, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Über", "naïve", "X_1", "don't"]
    text = lambda n: " ".join(rng.choice(words[:rng.choice([4, 12, 44])]) for _ in range(n))
    docs = [(i, text(rng.choice([0, 1, 3, 8, 30]))) for i in range(400)]
    docs += [(500 + i, "w1 w2 the same copy w30") for i in range(200)] + [(900, None), (901, "..."), (None, "w30 w31 null id"), (None, "w30 w31 null id"), (7, "w35 repeated id w36"), (902, "w3 " * 50000)]
    items = [(i, text(rng.choice([1, 4, 12]))) for i in range(30)] + [(30, "w30 w31 w31 the same"), (31, "unseen words only"), (32, ""), (33, None), (34, "W1 w1. w2"), (34, "w36"), (None, "w35")]
    return docs, items


def frames(spark, docs, items, parts=5):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("terms", "item_id", "rank", "score", "part", "no")})
    return d.repartition(parts), spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(2)})


@pytest.mark.parametrize("top,chunk,block", [(10, 256, 200_000), (3, 1, 20), (1000, 7, 200_000)])
def test_search_matches_brute_force(spark, corpus, monkeypatch, top, chunk, block):
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    docs, items = corpus
    got = lexical.rank_documents(*frames(spark, docs, items), top=top, block_terms=block).collect()
    assert Counter(tuple(r) for r in got) == brute_search(docs, items, top)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    text = "one Two  three,four éé\x1ftwo " * 9 + "verylongwordwithoutend" * 3
    assert {k.decode(): n for k, n in lexical.term_counts(text).items()} == Counter(terms_of(text))


def test_groups_below_the_bound_are_not_scored(monkeypatch):
    """Of 300 masks only those that can reach the first ten are scored."""
    monkeypatch.setattr(lexical, "CHUNK", 10)
    words = [f"w{i}".encode() for i in range(9)]
    texts = [" ".join(f"w{j}" for j in range(9) if i >> j & 1) + " other" for i in range(512)]
    row = lexical.segment_row(lexical.pa.array(range(512)), lexical.pa.array(texts), {w: i for i, w in enumerate(words)})
    seg = lexical.Segment(row, 512, 3000)
    scored, plain = [], seg.score
    monkeypatch.setattr(seg, "score", lambda d, a, w: scored.append(len(d)) or plain(d, a, w))
    places, scores = seg.best(np.arange(9), np.full(9, 700), 10)
    everything = np.sort(plain(np.arange(512), np.arange(9), np.full(9, 700, np.int64)))[::-1]
    assert scores.tolist() == everything[:10].tolist() and sum(scored) < 200


def test_search_of_empty_tables(spark, corpus):
    docs, items = corpus
    d, i = frames(spark, docs, items)
    assert lexical.rank_documents(d.limit(0), i).count() == 0
    assert lexical.rank_documents(d, i.limit(0)).count() == 0
    assert lexical.rank_documents(d, i.filter("item_id = 32")).columns == ["item_id", "rank", "doc_id", "score"]


# ---- toxicity ----------------------------------------------------------------


def reading(text, insults=("zorg$",), **kw):
    return {k: v for k, v in toxicity.Scanner(toxicity.Grammar({s: 2.0 for s in insults}, {"kill$": 3.0})).read(text).items() if v}


def test_clauses_are_read_by_the_composed_transducers():
    assert reading("a zorg walks by") == {"plain": 2.0}
    assert reading("you are a zorg") == {"targeted": 2.0} == reading("what a zorg you are")
    assert reading("not a zorg") == {"negated": 2.0}
    assert reading("not that I would say it of this zorg") == {"reported": 2.0}
    assert reading("not one of the many other zorg") == {"plain": 2.0}
    assert reading("the \"zorg\" word") == {"reported": 2.0}
    assert reading("I will kill you") == {"threat": 3.0} and reading("they kill time") == {"threat": 3.0}
    assert reading("kill the lights") == {}
    assert reading("zorgs and zorgling", ("zorg",)) == {"plain": 4.0} and reading("zorgs") == {}


def test_only_matched_clauses_count():
    scan = toxicity.Scanner(toxicity.Grammar({"zorg$": 2.0, "blé": 1.0}, {}))
    f = dict(zip(toxicity.FEATURES, scan.features("You walk. A zorg! Not here; bléfoo\nÉnd ZORG"), strict=True))
    assert f["plain"] == pytest.approx(math.log1p(5.0)) and f["targeted"] == f["negated"] == 0
    assert not scan.features("nothing of the kind, zorgling. tablé").any() and not scan.features(None).any() and not scan.features("").any()
    assert scan.features("zorg").any() and scan.features("a zorg").any() and scan.features("x" * 10**6 + " zorg").any()


def noisy_corpus(n, rng):
    common = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["you", "not", "says"]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumblex", "vortig" + rng.choice("aeiou") + rng.choice("mnrst"), "snarfu"]))
        rows.append((i, " ".join(w + ("." if rng.random() < .1 else "") for w in words), int(toxic)))
    return rows


def test_toxicity_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = noisy_corpus(1600, rng)
    rows += [(10_000 + i, rows[0][1] + f" tail{i}", 1) for i in range(200)]        # copies are no evidence for the words they share
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "null id"), (50_000, None), (50_001, "")], "doc_id long, text string").withColumns({"score": F.lit("s"), "key": F.lit(1)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(docs.select("doc_id", "text"), labels, learn=~toxicity.held_out())
    assert {"grumblex$", "snarfu$", "vortig"} <= set(model.grammar.insults)
    out = toxicity.score_toxicity(docs.withColumn("held", toxicity.held_out()), model)
    assert sorted(out.columns) == sorted([*docs.columns, "held"])
    truth = {i: y for i, _, y in rows}
    got = [r for r in out.collect() if r["held"] and r["doc_id"] in truth]
    hits = Counter((truth[r["doc_id"]], r["score"] >= 0.7) for r in got)
    assert hits[1, True] / (hits[1, True] + hits[1, False]) > 0.97 and hits[0, True] / (hits[0, True] + hits[0, False]) < 0.01
    by_id = {r["doc_id"]: r["score"] for r in out.filter("doc_id >= 50000 or doc_id is null").collect()}
    assert len(by_id) == 3 and by_id[50_000] == by_id[50_001] == by_id[None] < 0.1


def test_without_labels_the_seeds_and_the_prior_are_left(spark):
    docs = spark.createDataFrame([(1, "you are an idiot, you moron"), (2, "the weather is fine"), (3, "he said nobody here is an idiot")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train_toxicity_model(docs, empty)
    s = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert s[1] > 0.7 > s[3] > s[2]
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    one_sided = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert toxicity.train_toxicity_model(docs, one_sided).grammar == toxicity.Grammar()
