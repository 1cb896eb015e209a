"""URL filters by a Bloom filter cascade: exact membership without joins.

The keys of a URL are its host and each parent domain, with each rule-length
prefix of its path: every key a rule could have if it fitted the URL. A
cascade answers for each key of the corpus's complete key universe whether it
is listed. Level 1 is a Bloom filter of the listed keys; level 2 of the
universe's keys that level 1 lets pass but are not listed; level 3 of listed
keys that level 2 lets pass, and so on until nothing is left over. A key's
answer is the parity of the first level it is absent from, and is exact for
every key of the universe.

The levels are built by Spark: each pass keeps only the keys that are still
confused, and the bits of a filter are gathered in words of a bit array by
``bit_or`` per word. Filters reach the driver to be broadcast; the cascade's
size is the listed keys' times about 1.5 * log2(universe / listed) bits, and
more than ``max_bytes`` is an error, not a silent cut.

Two rule lists (block and allow) have a cascade each. A rule fits its host and
all subdomains if the URL's path starts with the rule's; the longest rule that
fits decides (ties: the longer host). A URL that no rule fits gets the
default, ``allow``: it is not listed.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
is judged by rules for the empty host (none can be written), hence the
default; repeated URLs are judged alike; a rule listed twice counts once, one
listed as allow and block is an error; an empty table gives no rows; an empty
list gives a cascade that lists nothing.
"""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, stage, without

MAX_LEVELS = 40
MAX_PATH_LENGTHS = 1000    # of the rules: the paths of a URL that are looked up
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray


@dataclass
class Cascade:
    """Levels of filters over pairs of 64-bit key hashes."""
    levels: list[Level] = field(default_factory=list)

    def lists(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which keys are listed; right for every key of the universe it was built over."""
        answer = np.zeros(len(a), bool)
        todo = np.arange(len(a))
        for i, level in enumerate(self.levels):
            todo = todo[passes(level, i, a[todo], b[todo])]
            answer[todo] = i % 2 == 0
        return answer

    def nbytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def positions(i: int, level_bits: int, hashes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bit positions of keys in level i, a row for each key."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & ((1 << 64) - 1))
    x, y = a.view(np.uint64) ^ salt, b.view(np.uint64) | np.uint64(1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    step = np.arange(hashes, dtype=np.uint64)[None, :]
    mixed = x[:, None] + step * (y ^ salt)[:, None]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((mixed >> np.uint64(20)) % np.uint64(level_bits)).astype(np.int64)


def passes(level: Level, i: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return np.zeros(0, bool)
    at = positions(i, level.bits, level.hashes, a, b)
    return ((level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def _fill(keys: DataFrame, i: int, n: int, rate: float) -> Level:
    """A Bloom filter of n keys with the false-positive rate, its words gathered by Spark."""
    bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
    hashes = max(1, round(bits / n * math.log(2)))

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            at = positions(i, bits, hashes, p["a"].to_numpy(), p["b"].to_numpy()).ravel()
            word, back = np.unique(at >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, back, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pd.DataFrame({"word": word, "value": value.view(np.int64)})

    got = keys.select("a", "b").mapInPandas(post, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    words = np.zeros(-(-bits // 64), np.uint64)
    words[got["word"].to_numpy(np.int64)] = got["value"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, hashes, words)


def hashed(keys: DataFrame, key: str = "key") -> DataFrame:
    return keys.withColumns({"a": F.xxhash64(key, F.lit("a")), "b": F.xxhash64(F.lit("b"), key)})


def build_cascade(listed: DataFrame, universe: DataFrame, key: str = "key", max_bytes: int = 256 << 20) -> Cascade:
    """A cascade that is exact for the listed keys and for all keys of the universe."""
    inside = stage(hashed(listed.select(F.col(key).alias("key")).distinct()), "listed")
    n_in = inside.count()
    if not n_in:
        return Cascade()
    outside = universe.select(F.col(key).alias("key")).distinct().join(inside.select("key"), "key", "left_anti")
    outside = stage(hashed(outside), "universe")
    n_out = outside.count()
    out, here, there, n_here, n_there = Cascade(), inside, outside, n_in, n_out
    for i in range(MAX_LEVELS):
        rate = min(0.5, n_in * math.sqrt(0.5) / max(n_out, 1)) if i == 0 else 0.5
        expected = n_here * -math.log(rate) / math.log(2) ** 2 / 8
        if out.nbytes() + expected > max_bytes:
            raise ValueError(f"a cascade of {n_in} keys over {n_out} others needs more than {max_bytes} bytes")
        level = _fill(here, i, n_here, rate)
        out.levels.append(level)
        if not n_there:
            return out
        shared = here.sparkSession.sparkContext.broadcast(level)

        def confused(batches: Iterator[pd.DataFrame], i: int = i, shared=shared) -> Iterator[pd.DataFrame]:
            for p in batches:
                yield p[passes(shared.value, i, p["a"].to_numpy(), p["b"].to_numpy())]

        over = stage(there.mapInPandas(confused, there.schema), "confused")
        here, there, n_here, n_there = over, here, over.count(), n_here
        if not n_here:
            return out
    raise ValueError("the cascade does not end: two keys share both 64-bit hashes")


def url_keys(host: Column, path: Column, path_lengths: Sequence[int]) -> Column:
    """All keys a rule that fits this URL could have: each parent domain with each prefix of the path that is as long as a rule's."""
    labels = F.split(host, "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    paths = F.array_distinct(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(set(path_lengths))] or [F.lit(None).cast("string")]))
    paths = F.filter(paths, lambda p: p.isNotNull())
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", rule: str = "rule", action: str = "action",
               default: str = "allow", host: str = "host", path: str = "path", verdict: str = "verdict") -> DataFrame:
    """All columns, and each URL's host, path, deciding rule (null: none) and verdict.

    ``rules``: (rule, action) with actions ``allow`` and ``block``. A rule's
    host counts, and is returned, with A-Z lower-cased, as a URL's is. A column
    named like an added one is replaced."""
    spark = pages.sparkSession
    pages = without(pages, [host, path, rule, verdict], keep=[url])
    written = F.col(rule)
    folded = F.concat(F.translate(F.substring_index(written, "/", 1), UPPER, UPPER.lower()), F.substr(written, F.length(F.substring_index(written, "/", 1)) + 1))
    listed = stage(rules.filter(written.isNotNull()).select(folded.alias("key"), F.col(action).alias("action")).distinct(), "rules")
    if not listed.groupBy("key").count().filter("count > 1").isEmpty():
        raise ValueError("a rule is listed both as allow and as block")
    cut = F.locate("/", "key")
    lengths = [r[0] for r in listed.select(F.when(cut > 0, F.length("key") - cut + 1).otherwise(0).alias("n")).distinct().orderBy("n").limit(MAX_PATH_LENGTHS + 1).collect()]
    if len(lengths) > MAX_PATH_LENGTHS:
        raise ValueError(f"rules with paths of more than {MAX_PATH_LENGTHS} lengths: every URL would have as many keys; split the list, or raise MAX_PATH_LENGTHS")
    parts = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    seen = pages.select(F.col(url).alias("url")).distinct().select(host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p"))
    universe = stage(seen.filter("h <> ''").select(F.explode(url_keys(F.col("h"), F.col("p"), lengths)).alias("key")).distinct(), "keys")
    cascades = spark.sparkContext.broadcast({a: build_cascade(listed.filter(F.col("action") == a), universe) for a in ("block", "allow")})
    columns, out = len(parts.columns), parts.schema.names
    keys_c, a_c, b_c, rule_c, verdict_c = fresh(parts, "keys", "a", "b", "rule", "verdict")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            sizes = p[a_c].map(len).to_numpy(np.int64)
            a = np.concatenate([np.zeros(0, np.int64), *p[a_c]]).astype(np.int64)
            b = np.concatenate([np.zeros(0, np.int64), *p[b_c]]).astype(np.int64)
            keys = [k for row in p[keys_c] for k in row]
            of = np.repeat(np.arange(len(p)), sizes)
            best: list = [None] * len(p)
            for name, cascade in cascades.value.items():
                for j in np.flatnonzero(cascade.lists(a, b)):
                    mine = (len(keys[j]), keys[j].find("/"), keys[j], name)
                    if best[of[j]] is None or mine > best[of[j]]:
                        best[of[j]] = mine
            res = p.iloc[:, :columns].copy()
            res.columns = out
            res[rule_c] = [x and x[2] for x in best]
            res[verdict_c] = [x[3] if x else default for x in best]
            yield res

    keyed = parts.withColumn(keys_c, F.when(F.col(host) != "", url_keys(F.col(host), F.col(path), lengths)).otherwise(F.array().cast("array<string>")))
    keyed = keyed.withColumns({a_c: F.transform(keys_c, lambda k: F.xxhash64(k, F.lit("a"))), b_c: F.transform(keys_c, lambda k: F.xxhash64(F.lit("b"), k))})
    schema = parts.withColumns({rule_c: F.lit(None).cast("string"), verdict_c: F.lit(None).cast("string")}).schema
    return keyed.mapInPandas(run, schema).withColumnsRenamed({rule_c: rule, verdict_c: verdict})
