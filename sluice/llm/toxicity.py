"""Toxicity by a weighted finite-state pattern grammar.

Two transducers are composed. The lexical one (an Aho-Corasick automaton over
the folded text for insults and threats, word tables for the rest) turns words
into the classes insult, threat, target, negation and reported speech; insults
and threats carry weights. The clause transducer reads a clause's classes from
left to right; its state holds how near a negation is, whether speech is
reported and whether a target has been named, and it emits each insult or
threat in a reading: plain, targeted, negated, reported, threat. What is scored
are the matched clauses: a document's features are the summed weights of each
reading, its heaviest clause and the density of its matched clauses; a logistic
layer over them gives the score.

Weights come from labelled rows. A bounded sample (``per_class`` rows of each
label, chosen by a hash of the id) is thinned to one text for each min-hash of
its 4-word shingles, so that copies don't count as evidence; Spark counts the
word stems (prefixes of 3 to 12 characters, and whole words) in both classes;
stems whose association passes a likelihood-ratio test enter the lexicon with
the log ratio of their rates. Seed words keep their seed weight until 10
sampled texts hold them. The readings' weights are fitted on the sample with a
ridge towards the grammar's prior (targeted over plain over negated and
reported), so a reading the labels say nothing about behaves as the prior says.

Texts are judged whole, where they are: no shuffle of documents.

Edge cases: a null or empty text gets the score of a text without a matched
clause; rows without label, with a null label or a null id are not learned
from; an id that is labelled twice counts as toxic if one of its labels says
so; without any toxic label only the seeds are left; repeated rows get equal
scores; an empty table gives no rows; a column named like the one added is
replaced.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import slices_by_bytes, stage, unit_hash, without

READINGS = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = {"plain": 1.0, "targeted": 1.3, "negated": 0.4, "reported": 0.5, "threat": 1.3, "heaviest": 0.5, "density": 0.5, "bias": -3.0}
FEATURES = (*READINGS, "heaviest", "density")
HEAVIEST_WORD = 6.0
NEAR = 3                    # words a negation reaches

# Closed classes, in English, German, French and Spanish.
TARGETS = frozenset("you your yours he she him her they them their his du dich dir dein deine ihr euch euer er sie ihn ihnen tu te toi ton vous votre il elle ils elles leur usted ustedes tú te ti él ella ellos ellas vosotros".split())
NEGATIONS = frozenset("not no never isn't aren't don't nobody without nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans nunca jamás ningún sin".split())
REPORTS = frozenset("said says say called calls wrote writes quoted claimed according sagte sagt nannte schrieb laut dit disait appelé écrit selon dijo dice llamó escribió según".split())
THREATS = {w: 3.0 for w in "kill hurt destroy strangle stab beat töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()}
INSULTS = {w: 2.5 for w in "idiot moron stupid scum loser trash pathetic worthless disgusting dummkopf abschaum versager salaud crétin imbécile basura estúpido".split()}

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_BOUNDARY = np.zeros(256, bool)
_BOUNDARY[list(b".!?;:\n")] = True
_TOKEN = re.compile(r"[\w']+|[\"«»“”„]")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Grammar:
    """Insults and threats: folded stem -> weight; a stem ending in ``$`` is a whole word."""
    insults: Mapping[str, float] = field(default_factory=lambda: {f"{w}$": x for w, x in INSULTS.items()})
    threats: Mapping[str, float] = field(default_factory=lambda: {f"{w}$": x for w, x in THREATS.items()})
    targets: frozenset = TARGETS
    negations: frozenset = NEGATIONS
    reports: frozenset = REPORTS


@dataclass(frozen=True)
class ToxicityModel:
    grammar: Grammar
    weights: np.ndarray         # of FEATURES
    bias: float


def clause_transducer() -> dict[tuple[tuple[int, int, int], str], tuple[tuple[int, int, int], str]]:
    """(state, class) -> (state, reading emitted). A state is (words a negation still reaches, speech is reported, a target is named)."""
    out = {}
    for near in range(NEAR + 1):
        for told in (0, 1):
            for aimed in (0, 1):
                state, less = (near, told, aimed), max(near - 1, 0)
                read = "negated" if near else "reported" if told else "targeted" if aimed else "plain"
                out[state, "word"] = (less, told, aimed), ""
                out[state, "negation"] = (NEAR, told, aimed), ""
                out[state, "report"] = (less, 1, aimed), ""
                out[state, "target"] = (less, told, 1), ""
                out[state, "insult"] = (less, told, aimed), read
                out[state, "threat"] = (less, told, aimed), "threat" if read in ("plain", "targeted") else read
    return out


class Scanner:
    """The composed transducers over one text; built in each task from the grammar."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.steps = grammar, clause_transducer()
        self.words = {w: c for c, ws in (("report", grammar.reports), ("negation", grammar.negations), ("target", grammar.targets)) for w in ws}
        self.lexicon = {**{s: ("threat", x) for s, x in grammar.threats.items()}, **{s: ("insult", x) for s, x in grammar.insults.items()}}
        self.longest = max((len(s.rstrip("$")) for s in self.lexicon), default=0)
        self.machine = ahocorasick.Automaton()
        for s in self.lexicon:
            self.machine.add_word((" " + s.replace("$", " ")).encode().decode("latin-1"), s)
        if self.lexicon:
            self.machine.make_automaton()

    def of_word(self, word: str) -> tuple[str, float]:
        """The lexical transducer: a word's class and weight; the longest stem decides."""
        if f"{word}$" in self.lexicon:
            return self.lexicon[f"{word}$"]
        if word in self.words:
            return self.words[word], 0.0
        for n in range(min(len(word), self.longest), 0, -1):
            if word[:n] in self.lexicon:
                return self.lexicon[word[:n]]
        return "word", 0.0

    def read(self, clause: str) -> dict[str, float]:
        """The clause transducer: reading -> weight. A threat without a target in its clause is not one; a target named after an insult counts too."""
        state, found = (0, 0, 0), dict.fromkeys(READINGS, 0.0)
        for token in _TOKEN.findall(clause):
            kind, weight = ("report", 0.0) if token in "\"«»“”„" else self.of_word(token)
            state, reading = self.steps[state, kind]
            if reading:
                found[reading] += weight
        if state[2]:
            found["targeted"] += found.pop("plain")
        else:
            found["threat"] = 0.0
        return found

    def features(self, text: str | None) -> np.ndarray:
        """FEATURES of a text; only clauses in which the lexical automaton finds something are read."""
        out = np.zeros(len(FEATURES))
        if not text or not self.lexicon:
            return out
        low = text.lower().encode()
        folded = (b" " + low.translate(_FOLD) + b" ").decode("latin-1")
        ends = sorted({end for end, _ in self.machine.iter(folded)})
        if not ends:
            return out
        raw = np.frombuffer(low, np.uint8)
        cuts = np.concatenate([[-1], np.flatnonzero(_BOUNDARY[raw]), [len(raw)]])
        at = np.minimum(np.array(ends) - 1, len(raw) - 1)          # a byte of the match, in the unpadded text
        at = at - np.array([folded[e] == " " for e in ends])       # a whole word ends in a blank
        heaviest = total = 0.0
        sums = dict.fromkeys(READINGS, 0.0)
        for c in np.unique(np.searchsorted(cuts, at, side="left")).tolist():
            got = self.read(low[cuts[c - 1] + 1:cuts[c]].decode())
            mine = 0.0
            for k, x in got.items():
                sums[k] += x
                mine += x * PRIOR[k]
            heaviest, total = max(heaviest, min(mine, HEAVIEST_WORD)), total + min(mine, HEAVIEST_WORD)
        out[:len(READINGS)] = [math.log1p(sums[k]) for k in READINGS]
        out[len(READINGS):] = heaviest, total / math.sqrt(1 + len(raw) / 500)
        return out


def stems_of(word: str, shortest: int = 3, longest: int = 12) -> list[str]:
    return [f"{word}$", *(word[:n] for n in range(shortest, min(len(word), longest) + 1))]


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) -> (min-hash of the 4-word shingles, label, text)."""
    for whole in batches:
        for b in slices_by_bytes(whole, 1, 1 << 21):
            keys = []
            for t in b.column(1).to_pylist():
                words = _WORDS.findall(t.lower())
                keys.append(min((xxhash.xxh64_intdigest(" ".join(words[i:i + 4])) >> 1 for i in range(max(len(words) - 3, 1))), default=0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *b.columns], names=["key", "toxic", "text"])


def _count_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) -> (stem, toxic, texts, occurrences), summed over some texts at a time; stem '' counts the texts and words."""
    held: dict[tuple[str, int], list[int]] = {}

    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys]), pa.array([y for _, y in keys], pa.int32()), pa.array([held[k][0] for k in keys], pa.int64()),
                                           pa.array([held[k][1] for k in keys], pa.int64())], names=["stem", "toxic", "texts", "times"])

    for b in batches:
        for y, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            words: dict[str, int] = {}
            for m in _WORDS.finditer(t.as_py().lower()):
                words[m[0]] = words.get(m[0], 0) + 1
            mine: dict[str, int] = {"": sum(words.values())}
            for w, n in words.items():
                for s in stems_of(w):
                    mine[s] = mine.get(s, 0) + n
            for s, n in mine.items():
                x = held.setdefault((s, y), [0, 0])
                x[0] += 1
                x[1] += n
            if len(held) > 200_000:
                yield out()
                held.clear()
    if held:
        yield out()


def _association(a: Column, b: Column, n1: int, n0: int) -> Column:
    """The likelihood-ratio statistic of a stem in ``a`` of n1 toxic and ``b`` of n0 other texts."""
    rate = (a + b) / F.lit(float(n1 + n0))
    term = lambda seen, p: F.when(seen > 0, seen * F.ln(seen / p)).otherwise(0.0)
    return 2 * (term(a, n1 * rate) + term(n1 - a, n1 * (1 - rate)) + term(b, n0 * rate) + term(n0 - b, n0 * (1 - rate)))


def choose_stems(found: Sequence[tuple[str, int, int, int, int, float]], words1: int, words0: int) -> dict[str, float]:
    """(stem, toxic texts, other texts, toxic occurrences, others, statistic) -> weights.

    Strongest first, of equals the longest; a stem that begins another chosen one, or is begun by one, adds nothing."""
    out: dict[str, float] = {}
    begun: set[str] = set()
    for stem, _, _, o1, o0, _ in sorted(found, key=lambda r: (-r[5], -len(r[0]), r[0])):
        word = stem.rstrip("$")
        if word in begun or any(word[:n] in out for n in range(1, len(word) + 1)) or f"{word}$" in out:
            continue
        weight = math.log((o1 + 0.5) / (words1 + 1)) - math.log((o0 + 0.5) / (words0 + 1))
        if weight < 1:
            continue
        out[stem] = min(weight, HEAVIEST_WORD)
        begun.update(word[:n] for n in range(1, len(word) + 1))
    return out


def sample_labelled(docs: DataFrame, labels: DataFrame, learn: Column | None, per_class: int, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict[int, float]]:
    """(key, toxic, text) of about ``per_class`` labelled texts of each class, written once; and the share of each class that was taken."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    if learn is not None:
        known = known.filter(learn)
    known = known.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {y: min(1.0, per_class / counts[y]) if counts.get(y) else 1.0 for y in (0, 1)}
    taken = known.filter(unit_hash(F.xxhash64("id")) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    taken = taken.groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(taken), "id").select("toxic", "text")               # at most about 2 x per_class ids
    keyed = rows.mapInArrow(_with_key, "key long, toxic int, text string")
    thin = keyed.groupBy("key").agg(F.max(F.struct("toxic", F.xxhash64("text"), "text")).alias("r")).select("key", "r.toxic", "r.text")
    return stage(thin, "toxic-sample"), share


def train_toxicity_model(docs: DataFrame, labels: DataFrame, learn: Column | None = None, grammar: Grammar | None = None, per_class: int = 5000,
                         least_texts: int = 4, statistic: float = 22.0, max_stems: int = 5000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learn the lexicon and the readings' weights. ``learn``: a condition on the rows of ``labels``."""
    grammar = grammar or Grammar()
    prior = np.array([PRIOR[f] for f in FEATURES])
    sample, share = sample_labelled(docs, labels, learn, per_class, doc_id, text, label)
    sums = sample.select("toxic", "text").mapInArrow(_count_stems, "stem string, toxic int, texts long, times long")
    one, two = F.col("toxic") == 1, F.col("toxic") == 0
    stems = sums.groupBy("stem").agg(*[F.coalesce(F.sum(F.when(y, F.col(c))), F.lit(0)).alias(f"{c}{i}") for i, y in ((1, one), (0, two)) for c in ("texts", "times")])
    total = stems.filter("stem = ''").first()
    if total is None or not total["texts1"] or not total["texts0"]:
        return ToxicityModel(grammar, prior, PRIOR["bias"])
    n1, n0 = total["texts1"], total["texts0"]
    seeds = [*grammar.insults, *grammar.threats]
    g = _association(F.col("texts1"), F.col("texts0"), n1, n0)
    strong = (F.col("texts1") >= least_texts) & (F.col("texts1") / n1 > F.col("texts0") / n0) & (g >= statistic)
    rows = (stems.filter((F.col("stem") != "") & (strong | F.col("stem").isin(seeds))).withColumn("g", g)
            .orderBy(F.col("stem").isin(seeds).desc(), F.col("g").desc(), F.length("stem").desc(), "stem").limit(max_stems + len(seeds)).collect())
    seen = {r["stem"]: r for r in rows if r["texts1"] + r["texts0"] >= 10}
    learned = choose_stems([(r["stem"], r["texts1"], r["texts0"], r["times1"], r["times0"], r["g"]) for r in rows if r["texts1"] >= least_texts and r["texts1"] / n1 > r["texts0"] / n0 and r["g"] >= statistic], total["times1"], total["times0"])
    kept = Grammar({**{s: w for s, w in grammar.insults.items() if s not in seen}, **{s: w for s, w in learned.items() if s not in grammar.threats}},
                   {s: learned.get(s, w) for s, w in grammar.threats.items() if s not in seen or s in learned}, grammar.targets, grammar.negations, grammar.reports)
    got = sample.select("toxic", "text").mapInArrow(_features_of(kept), "toxic int, x array<double>").collect()       # at most about 2 x per_class short rows
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    weights, bias = fit_logistic(x, y, np.where(y > 0, 1 / share[1], 1 / share[0]), prior, PRIOR["bias"])
    return ToxicityModel(kept, weights, bias)


def _features_of(grammar: Grammar):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(grammar)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([scan.features(t.as_py()).tolist() for t in b.column(1)], pa.list_(pa.float64()))], names=["toxic", "x"])
    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, prior: np.ndarray, bias: float, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Newton steps to the weights near ``prior`` that fit best; ``share``: how many rows each row stands for."""
    a = np.hstack([x, np.ones((len(x), 1))])
    goal = np.append(prior, bias)
    w, pull = goal.copy(), np.diag(np.append(np.full(len(prior), ridge), 0.01))
    share = share / share.mean()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (share * (p - y)) + pull @ (w - goal)
        step = np.linalg.solve((a * (share * p * (1 - p))[:, None]).T @ a + pull, grad)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """All columns, and the probability that a text is toxic."""
    rows = without(docs, [score], keep=[text])
    at, n_cols = rows.columns.index(text), len(rows.columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scan = Scanner(m.grammar)
        for b in batches:
            x = np.array([scan.features(t.as_py()) for t in b.column(at)]).reshape(b.num_rows, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[:n_cols], pa.array(p)], names=[*b.schema.names, score])

    return rows.mapInArrow(run, rows.select("*", F.lit(0.0).alias(score)).schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept out of the learning: crc32 of the key's text, mod 3, is 1 (a null key: not held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))
