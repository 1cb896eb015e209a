"""Suffix-array dedup and substring dedup against brute force."""
import hashlib
import random

import numpy as np
import pytest

from sluice.llm import repeats
from sluice.llm.substring_dedup import SuffixAutomaton, remove_repeated_words
from sluice.llm.suffix_dedup import remove_repeated_bytes

BIG = 1 << 63


def rank(i):
    return BIG if i is None else i


def cover(n, span, starts):
    gone = [False] * n
    for s in starts:
        for j in range(s, s + span):
            gone[j] = True
    return gone


def brute_bytes(rows, span):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - span + 1):
            first[b[p:p + span]] = min(first.get(b[p:p + span], BIG), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = cover(len(b), span, [p for p in range(len(b) - span + 1) if first[b[p:p + span]] < rank(i)])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((rank(i), len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(rows, span):
    first, docs = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for p in range(len(w) - span + 1):
            k = tuple(w[p:p + span])
            first[k] = min(first.get(k, (BIG, BIG)), (rank(i), p))
    out = []
    for i, w in docs:
        gone = cover(len(w), span, [p for p in range(len(w) - span + 1) if first[tuple(w[p:p + span])] < (rank(i), p)])
        out.append((rank(i), len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def corpus(seed, alphabet, blank=""):
    r = random.Random(seed)
    common = [blank.join(r.choice(alphabet) for _ in range(r.randint(20, 90))) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [r.choice(common) if r.random() < 0.5 else blank.join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(r.randint(0, 4))]
        rows.append((r.choice([i, i, i, 3, None]), blank.join(parts)))
    rows += [(50, rows[5][1]), (51, rows[5][1]), (52, None), (53, ""), (54, blank.join(["a"] * 300)), (55, blank.join(["a"] * 120)), (56, "é" * 40), (57, " \t\n ")]
    return rows


@pytest.mark.parametrize("seed,alphabet", [(1, "ab"), (2, "abcdefgh"), (3, "aé ")])
def test_bytes_match_brute_force(make_docs, seed, alphabet):
    rows = corpus(seed, alphabet)
    got = remove_repeated_bytes(make_docs(rows), threshold=20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((rank(r[0]), *r[1:]) for r in got) == brute_bytes(rows, 20)


@pytest.mark.parametrize("seed,alphabet", [(1, ["a", "b"]), (2, ["one", "two", "three", "extraordinarily", "ü"])])
def test_words_match_brute_force(make_docs, seed, alphabet):
    rows = corpus(seed, alphabet, " ")
    got = remove_repeated_words(make_docs(rows), threshold=10).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((rank(r[0]), *r[1:]) for r in got) == brute_words(rows, 10)


def test_hot_keys_and_small_batches(make_docs, monkeypatch):
    """One common passage in ever different company, over many batches: stretches go window by window."""
    r = random.Random(9)
    line = "".join(r.choice("abcdefghij") for _ in range(30))
    rows = [(i, "".join(r.choice("abcdefghij") for _ in range(25)) + line + "".join(r.choice("abcdefghij") for _ in range(25))) for i in range(120)]
    words = [(i, " ".join(t)) for i, t in rows]
    expected, expected_words = brute_bytes(rows, 24), brute_words(words, 24)

    def run(name, value):
        monkeypatch.setattr(repeats, name, value)
    run("BATCH", 2000)
    run("PIECE", 700)
    answer = repeats._answer_keys

    def hot(group):       # in the worker the module's own limit holds, so it is set there
        import sluice.llm.repeats as m
        m.HOT = 3
        return answer(group)
    run("_answer_keys", hot)
    got = remove_repeated_bytes(make_docs(rows), threshold=24).collect()
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in got) == expected
    got = remove_repeated_words(make_docs(words), threshold=24).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got) == expected_words


def test_real_outputs_and_empty_table(make_docs):
    text = "The quick brown fox jumps over the lazy dog and runs far away from here."
    out = {r["doc_id"]: r for r in remove_repeated_bytes(make_docs([(1, text), (2, "xx" + text + "yy")]), threshold=50).collect()}
    assert bytes(out[2]["kept"]) == b"xxyy" and [(s["start"], s["end"]) for s in out[2]["spans"]] == [(2, 2 + len(text))]
    assert bytes(out[1]["kept"]).decode() == text
    assert remove_repeated_bytes(make_docs([])).count() == 0 and remove_repeated_words(make_docs([])).count() == 0


def test_suffix_automaton():
    r = random.Random(4)
    a, seen, at = SuffixAutomaton(), {}, 0
    for _ in range(30):
        words = [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(1, 30))]
        expected = []
        for i in range(len(words)):
            if i >= 3:
                expected.append(seen.setdefault(tuple(words[i - 3:i + 1]), at + i))
        assert a.add_and_match(words, at, 4) == expected
        at += len(words)


def test_names_and_messages():
    x = np.frombuffer(b"abcabcabcabcabcabcabcabcabcabc", np.uint8)
    n = repeats.byte_names(x, 13)
    assert len(n) == len(x) - 12 and n[0] == n[3] != n[1]
    a, b = np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int32)
    back = repeats.unpack(repeats.pack(a, b))
    assert (back[0] == a).all() and len(back[1]) == 0


@pytest.mark.parametrize("buckets", [64, 65536, 65537, 140000, 1 << 20, 1 << 32])
def test_buckets_grow_with_the_key(buckets):
    keys = np.sort(np.concatenate((np.random.default_rng(0).integers(0, 1 << 48, 100000), [0, (1 << 48) - 1])).astype(np.uint64))
    of = repeats.bucket_of(keys, buckets)
    assert of[0] == 0 and of[-1] == buckets - 1 and (np.diff(of) >= 0).all()


def test_more_buckets_than_16_bits_give_equal_results(make_docs):
    rows = corpus(2, "abcdefgh")
    got = remove_repeated_bytes(make_docs(rows), threshold=20, buckets=1 << 20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted((rank(r[0]), *r[1:]) for r in got) == brute_bytes(rows, 20)
    rows = corpus(2, ["one", "two", "three", "extraordinarily", "ü"], " ")
    got = remove_repeated_words(make_docs(rows), threshold=10, buckets=1 << 20).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted((rank(r[0]), *r[1:]) for r in got) == brute_words(rows, 10)
