"""Decontamination, mixing, sharding, URL filters, language ID and licences on small inputs, against brute force."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import decontam, langid, licences, mixing, sharding, urlfilter

POOL = "river stone cloud paper window garden silver motor ocean pepper lantern marble saddle violin copper meadow".split()


def prose(r, n):
    return " ".join(r.choice(POOL) + str(r.randint(0, 40)) for _ in range(n))


def shingles(text):
    w = [x for x in re.split(r"[^a-z0-9]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def shingles_any(text):
    """As shingles(), for words of any letters."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_decontamination_matches_brute_force(make_docs, spark):
    r = random.Random(2)
    items = [(i, prose(r, n)) for i, n in enumerate([1, 3, 5, 6, 9, 14, 20, 21, 40, 70, 200])] + [(50, None), (51, ""), (None, "no id here at all"), (52, items_text := prose(r, 30)), (53, items_text)]
    rows = [(100 + i, prose(r, r.randint(0, 3000))) for i in range(20)] + [(200, None), (201, ""), (202, "..."), (None, items[8][1])]
    for i, t in items[:11]:
        for k in range(3):
            words = t.upper().split()
            if k:
                words[r.randrange(len(words))] = "OTHER"
            rows.append((300 + 10 * i + k, prose(r, r.choice([0, 10, 2000])) + ", " + "! ".join(words) + ". " + prose(r, 40)))
    rows += [(400, items_text), (400, "another row of that id"), (401, items[0][1]), (402, items[1][1])]
    got = decontam.contaminated(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, set()).update(shingles(t))
    expected = {}
    for d, mine in texts.items():
        for i, t in items:
            s = shingles(t)
            if i is not None and s and len(s & mine) / len(s) >= 0.8:
                expected[d, i] = (len(s), len(s & mine))
    assert {(x["doc_id"], x["item_id"]): (x["n_shingles"], x["n_shared"]) for x in got} == expected and len(got) == len(expected)
    assert all(abs(x["containment"] - x["n_shared"] / x["n_shingles"]) < 1e-12 for x in got)
    docs = make_docs(rows)
    clean = decontam.remove_contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == sum(i is None or i not in {d for d, _ in expected} for i, _ in rows)


def test_decontamination_of_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = make_docs([(1, "a b c d e f")])
    assert decontam.contaminated(docs, none).count() == 0 and decontam.remove_contaminated(docs, none).count() == 1
    assert decontam.contaminated(make_docs([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert all(decontam.miss_probability(s) < 1e-6 for s in range(1, 5000))
    cut = {s: max(decontam.miss_probability(s, before=b) for b in range(math.ceil(0.8 * s) + 1)) for s in range(1, 300)}
    assert cut.pop(5) < 1.5e-6 and max(cut.values()) < 1e-7 and all(m < 1e-12 for s, m in cut.items() if s >= 17)


def simulate(parts):
    """Earliest deadline first, slot by slot, from the definition."""
    period, done, out = sum(parts.values()), dict.fromkeys(parts, 0), []
    for t in range(period):
        ready = [(math.ceil((done[k] + 1) * period / n), i, k) for i, (k, n) in enumerate(parts.items()) if done[k] < n and done[k] * period // n <= t]
        k = min(ready)[2]
        done[k] += 1
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_schedule_keeps_within_a_block(seed):
    r = random.Random(seed)
    weights = {f"s{i}": r.random() ** 3 + 0.001 for i in range(r.randint(1, 25))}
    parts = mixing.quantise(weights, 500)
    assert sum(parts.values()) == 500 and min(parts.values()) >= 1
    order = mixing.one_period(parts)
    assert order == simulate(parts)
    got = dict.fromkeys(parts, 0)
    for t, k in enumerate(order, 1):
        got[k] += 1
        assert all(abs(got[x] - t * n / 500) < 1 for x, n in parts.items())


def test_mix_places_every_document_once(make_docs):
    r = random.Random(3)
    rows = [(i, "t", r.choice(["a", "a", "a", "b", "c", None])) for i in range(900)] + [(5, "t", "a"), (None, None, "b"), (None, "", "rare")]
    weights = {"a": 0.2, "b": 0.5, "c": 0.3}
    out = mixing.mix(make_docs(rows), weights, block_rows=4, period=50, block="block_of").collect()
    assert len(out) == len(rows)
    assert len({(x["slot"], x["place"]) for x in out}) == len(rows)
    slots = {}
    for x in out:
        slots.setdefault(x["slot"], set()).add((x["source"], x["block_of"]))
        assert x["release"] <= x["slot"] < x["deadline"] and 0 <= x["place"] < 4
    assert all(len(v) == 1 for v in slots.values()) and sorted(slots) == list(range(len(slots)))
    line = [next(iter(slots[s]))[0] for s in sorted(slots)]
    unweighted = [i for i, s in enumerate(line) if s in (None, "rare")]
    assert unweighted and unweighted == list(range(unweighted[0], len(line)))
    blocks = {s: -(-sum(1 for x in rows if x[2] == s) // 4) for s in ("a", "b", "c")}
    first_out = min(blocks[s] / w for s, w in weights.items())
    for t in range(1, int(first_out)):
        assert all(abs(line[:t].count(s) - w * t) < 1 for s, w in weights.items())


def test_mix_order_and_empty(make_docs):
    docs = make_docs([(i, "t", f"s{i % 3}") for i in range(60)])
    laid = mixing.in_mix_order(docs)
    assert laid.columns == docs.columns and sorted(r["doc_id"] for r in laid.collect()) == list(range(60))
    assert mixing.in_mix_order(make_docs([])).count() == 0


def texts_shuffled(frame, capsys):
    """Shuffles of the plan, of those with the texts."""
    frame.explain("formatted")
    return len([x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", capsys.readouterr().out) if re.search(r"\btext#", x)])


def test_the_mix_shuffles_texts_once_and_null_sources_meet(make_docs, spark, capsys):
    rows = [(i, f"t{i}", None if i % 3 else ("", "a", "null")[i % 9 // 3]) for i in range(700)] + [(None, None, None), (3, "t3", None), (3, "t3", None)]
    docs = make_docs(rows)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        mixed = mixing.mix(docs)
        before = texts_shuffled(docs, capsys)
        assert texts_shuffled(mixed, capsys) - before == 1
        assert texts_shuffled(mixing.in_mix_order(docs), capsys) - before == 2
        out = mixed.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    places = {}
    for x in out:
        places.setdefault(x["source"], []).append(x["block"] * 8 + x["place"])
    assert {k: len(v) for k, v in places.items()} == collections.Counter(r[2] for r in rows)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())


def test_shards_move_only_into_the_new_one(make_docs):
    rows = [(i, "x" * (i % 7)) for i in range(4000)] + [(7, "again"), (7, "again"), (None, None), (None, "é")]
    out = sharding.shard(make_docs(rows), sharding.topology(8), grown=sharding.topology(9), carry=["doc_id"]).collect()
    assert len(out) == len(rows)
    by, homes = {}, {}
    for x in out:
        by.setdefault(x["shard"], []).append(x["slot"])
        homes.setdefault(x["doc_id"], set()).add(x["shard"])
        assert x["grown_shard"] in (x["shard"], 8)
    assert all(len(v) == 1 for v in homes.values())
    assert set(by) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(400 < len(v) < 600 for v in by.values()) and 300 < sum(x["grown_shard"] == 8 for x in out) < 600
    by_id = {(x["doc_id"], x["size"]): x for x in out}
    assert by_id[None, 1]["text_crc32"] == 0 and by_id[None, 3]["text_crc32"] == zlib.crc32("é".encode())
    assert sharding.shard(make_docs([]), sharding.topology(8)).count() == 0


def test_weights_confine_movement(make_docs):
    docs = make_docs([(i, "") for i in range(6000)])
    tree = sharding.topology(8)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    out = sharding.shard(docs, tree, grown=heavier, carry=["doc_id"]).collect()
    assert {x["grown_shard"] for x in out if x["shard"] < 4 and x["shard"] != x["grown_shard"]} <= {4, 5, 6, 7}
    assert not any(x["grown_shard"] < 4 for x in out if x["shard"] >= 4)
    assert sum(x["grown_shard"] == 5 for x in out) == pytest.approx(6000 * 0.3, rel=0.12)


def test_cascade_is_exact(spark):
    listed = spark.createDataFrame([(f"k{i}",) for i in range(0, 4000, 9)], "key string")
    universe = spark.createDataFrame([(f"k{i}",) for i in range(4000)], "key string")
    cascade = urlfilter.build_cascade(listed, universe)
    rows = urlfilter.hashed(universe).collect()
    got = cascade.lists(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]))
    assert [r["key"] for r, g in zip(rows, got) if g] == [r["key"] for r in rows if int(r["key"][1:]) % 9 == 0]
    assert len(cascade.levels) > 2 and cascade.nbytes() < 4000
    assert not urlfilter.Cascade().lists(np.arange(3), np.arange(3)).any()
    with pytest.raises(ValueError, match="bytes"):
        urlfilter.build_cascade(listed, universe, max_bytes=10)


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/e", "allow"), ("b.net/", "block"), (None, "allow")]


def plain_judge(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
    fits = [(len(r), r.find("/"), r, a) for r, a in RULES if r and (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.find("/"):])]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_match_brute_force(spark):
    urls = ["http://Example.COM/en/1", "https://www.example.com/en/x?q=1", "https://a.www.example.com/en/", "http://example.com/EN/", "http://example.com", "http://x.net/es/a", "http://x.net/ex", "ftp://a.b.net/es/q#f", "http://b.net?x=/es/",
            "no scheme", None, "", "http://", "http:///es/", "http://notexample.com/en/", "http://example.org/en/", "a://b://c.com/", "http://é.net/es/ü", "http://x.net/es/a"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, key string").repartition(3)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, spark.createDataFrame(RULES, "rule string, action string")).collect()}
    assert got == {i: plain_judge(u) for i, u in enumerate(urls)}
    none = spark.createDataFrame([], "rule string, action string")
    assert {r["verdict"] for r in urlfilter.judge_urls(pages, none).collect()} == {"allow"}
    assert urlfilter.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "rule string, action string")).count() == 0
    with pytest.raises(ValueError, match="both"):
        urlfilter.judge_urls(pages, spark.createDataFrame([("a/", "allow"), ("a/", "block")], "rule string, action string"))


def test_language_id_on_held_out_rows(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train_language_model(docs, learn=~langid.held_out(), per_label=150)
    out = langid.detect_language(docs.select("doc_id", "text", "lang", langid.held_out().alias("held")), model).collect()
    held = [r for r in out if r["held"]]
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert np.mean([r["accepted"] for r in out]) > 0.99 and all(0 <= r["score"] <= 1 for r in out)


def test_language_id_edges(make_docs, spark):
    rows = [(i, f"the and of that {i} this with there") for i in range(30)] + [(100, None), (101, ""), (102, "123 ... ?"), (103, "a"), (104, "wörld " * 3000)]
    docs = make_docs(rows)
    model = langid.train_language_model(docs)
    got = {r["doc_id"]: r for r in langid.detect_language(docs, model).collect()}
    assert len(got) == len(rows) and all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and not got[i]["accepted"] for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "en"
    unlabelled = docs.withColumn("lang", docs["n_chars"].cast("string")).replace("0", None, "lang")
    empty = langid.train_language_model(unlabelled)
    assert empty.labels == [] and {r["lang_pred"] for r in langid.detect_language(docs, empty).collect()} == {"und"}
    assert langid.detect_language(make_docs([]), model).count() == 0
    with pytest.raises(ValueError, match="labels"):
        langid.train_language_model(docs.withColumn("lang", docs["doc_id"].cast("string")), max_labels=5)


def test_scores_are_means_over_the_whole_text():
    table = np.random.default_rng(0).normal(size=(len(langid.GRAMS) << langid.BITS, 3)).astype(np.float32)
    texts = [b"Hello World", b"", b"x", "größe".encode() * 50]
    raw, off = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for row, t in zip(langid.text_scores(raw, off, table), texts):
        ids, n = langid.gram_counts(t)
        assert np.allclose(row, (table[ids] * n[:, None]).sum(axis=0) / n.sum(), atol=1e-5)


PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}


def test_licences_match_brute_force(make_docs):
    r = random.Random(1)
    bits = [*PHRASES.values(), "under the mit", "Licensed under CC BY-NC 4.0.", "cc by cc by nc", "MIT License", "apache license, version 2.0", "the mit license", "under", "nc"]
    rows = [(i, " ".join(r.choice([*bits, prose(r, 3)]) for _ in range(r.randint(0, 30)))) for i in range(80)] + [(200, None), (201, ""), (202, "!!"), (203, "über cc by nc")]
    rows += [(300, "This work is licensed under the GNU General Public License, version 3."), (301, "licensed under the gnu general manual license version 3"),
             (302, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction")]
    got = {x["doc_id"]: x for x in licences.scan_licences(make_docs(rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at = [(k, label) for label, p in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        x = got[i]
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"]) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert x["base_labels"] == ",".join(sorted({label for _, label in at})) and set(x["base_labels"].split(",")) - {""} <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert got[300]["labels"] == "gpl-3" and got[301]["labels"] == "" and got[302]["labels"] == "mit"
    assert licences.scan_licences(make_docs([])).count() == 0


# ---- rejection, clashing names, placement recomputed ---------------------------

def test_language_id_rejects_junk_and_unlearned_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train_language_model(docs, learn=~langid.held_out())
    assert 0.6 < model.coverage < 0.97
    strange = spark.createDataFrame([(-1, "Это русский текст о погоде и природе"), (-2, "Αυτό είναι ένα ελληνικό κείμενο για τον καιρό"), (-3, "xqzv kjwq zzxk pqvw wvkx qqj zxcv bnmq wqzx"), (-4, "Ez egy magyar szöveg az időjárásról, a természetről és a városokról")], "doc_id long, text string")
    got = langid.detect_language(docs.select("doc_id", "text").unionByName(strange), model).filter(F.col("text").rlike("\\p{L}")).collect()
    assert not any(r["accepted"] for r in got if r["doc_id"] < 0)
    clean = [r["accepted"] for r in got if r["doc_id"] >= 0]
    assert sum(clean) / len(clean) > 0.98


def test_a_language_left_out_is_rejected_where_it_differs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").filter("length(text) > 100")
    model = langid.train_language_model(docs.filter("lang <> 'es'"))
    rates = {r["lang"]: r["rate"] for r in langid.detect_language(docs, model).groupBy("lang").agg(F.avg(F.col("accepted").cast("int")).alias("rate")).collect()}
    assert rates["es"] < 0.1 and min(v for k, v in rates.items() if k != "es") > 0.97


def no_name_twice(df):
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    assert df.count() == df.select(*df.columns).count()


def test_added_columns_replace_those_of_their_name(spark):
    names = ["size", "Text_crc32", "law", "shard", "slot", "grown_shard", "block", "release", "deadline", "place", "n_words", "labels", "score", "lang_pred", "accepted", "host", "path", "rule", "verdict", "__keys", "__a", "__rule"]
    docs = spark.createDataFrame([(i, f"the words of text {i}", "en", f"s{i % 2}", f"http://www.example.com/en/{i}") for i in range(20)], "doc_id long, text string, lang string, source string, url string")
    docs = docs.withColumns({n: F.lit("mine") for n in names})
    out = sharding.shard(docs, sharding.topology(8), grown=sharding.topology(9))
    no_name_twice(out)
    assert dict(out.dtypes)["size"] == "bigint" and out.select("__keys").first()[0] == "mine"
    for made, kind in ((mixing.mix(docs), ("slot", "bigint")), (licences.scan_licences(docs), ("score", "double")), (langid.detect_language(docs, langid.train_language_model(docs)), ("score", "double")),
                       (urlfilter.judge_urls(docs, spark.createDataFrame([("Example.com/", "block")], "rule string, action string")), ("verdict", "string"))):
        no_name_twice(made)
        assert dict(made.dtypes)[kind[0]] == kind[1] and made.filter(F.col(kind[0]).cast("string") == "mine").isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(docs.withColumn("slot", F.col("source")), source="slot")


def test_rules_hold_whatever_the_case_of_their_host(spark):
    pages = spark.createDataFrame([(1, "http://example.com/x"), (2, "http://A.EXAMPLE.com/En/x"), (3, "http://other.org/x")], "page_id long, url string")
    rules = spark.createDataFrame([("Example.COM/", "block"), ("A.example.com/En/", "allow")], "rule string, action string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages, rules).collect()}
    assert got == {1: ("example.com/", "block"), 2: ("a.example.com/En/", "allow"), 3: (None, "allow")}
    long = spark.createDataFrame([(f"e.com/{'x' * i}", "block") for i in range(urlfilter.MAX_PATH_LENGTHS + 1)], "rule string, action string")
    with pytest.raises(ValueError, match="lengths"):
        urlfilter.judge_urls(pages, long)


def test_contaminated_rows_without_an_id_go(make_docs, spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, words)], "item_id long, text string")
    docs = make_docs([(None, f"before {words} after"), (None, "a clean text without an id, of some length"), (3, "another"), (3, words)])
    assert sorted(r["text"] for r in decontam.remove_contaminated(docs, items).collect()) == ["a clean text without an id, of some length", "another"]


def hash_of(*values):
    """Spark's xxhash64 of longs and texts: each value's XXH64, seeded with the hash before it, from 42."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h


def brute_place(key, tree):
    """The shard of a key, from the law alone: at each level the child with the largest log(u) / weight."""
    path, members = "", [m for m in tree if m.weight > 0]
    for level in range(3):
        name = lambda m: f"{path}/{(m.region, m.rack, m.shard)[level]}"  # noqa: B023, E731
        children = list(dict.fromkeys(map(name, members)))
        weight = {c: sum(m.weight for m in members if name(m) == c) for c in children}
        draw = {c: math.log(((hash_of(key, c) >> 12) + 0.5) / (1 << 52)) / weight[c] for c in children}
        path = max(children, key=draw.get)
        members = [m for m in members if f"{path.rsplit('/', 1)[0]}/{(m.region, m.rack, m.shard)[level]}" == path]
    return members[0].shard


def test_shards_and_slots_recomputed(spark):
    ids = [*range(300), 10**15, -5, -(1 << 62)]
    docs = spark.createDataFrame([(i, "é" * (i % 5)) for i in ids], "doc_id long, text string")
    grown = [*sharding.topology(8), sharding.Shard("r9", "k9", 8, 2.5)]
    got = {r["doc_id"]: r for r in sharding.shard(docs, sharding.topology(8), grown=grown).collect()}
    for i in ids:
        text = "é" * (i % 5)
        assert (got[i]["shard"], got[i]["grown_shard"]) == (brute_place(i, sharding.topology(8)), brute_place(i, grown))
        assert (got[i]["size"], got[i]["text_crc32"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()))
        assert got[i]["grown_shard"] in (got[i]["shard"], 8)
    for s in range(8):
        mine = sorted((i for i in ids if got[i]["shard"] == s), key=lambda i: hash_of("slot", i))
        assert [got[i]["slot"] for i in mine] == list(range(len(mine)))
