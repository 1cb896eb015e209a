"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (over
UTF-8 bytes, ASCII lower-cased, other ASCII characters as one blank); a linear
layer and softmax follow. Embeddings and weights are trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows; a temperature
and two rejection thresholds are calibrated on a part of that sample kept out
of the training.

A softmax is as sure of a text of no learned language as of any other, so a
text must also be covered: the share of its n-grams whose bucket the training
texts hold (with 10 covered ones added, so that a few words aren't judged
harshly) must reach a threshold. It lies a quarter of the way from what must be
rejected to what must stay: above passages with their characters shuffled, and
above each label's texts as the other labels' n-grams cover them where those
can be told from clean texts at all; below 99.9 % of the clean texts.

Since mean and layer are linear, the table embeddings x weights (n-gram bucket
-> class scores) is what tasks score with; its size is bounded by the buckets
times the labels (``max_labels``).

Edge cases: a null text, or one without a letter, gets ``und`` and score 0;
a text so short that it has no n-gram is scored by its padded form (every text
is padded with blanks); without any labelled row all texts are ``und``; rows
are judged one by one, so repeated rows get equal results; only the named
columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import fresh, slices_by_bytes, text_buffers, unit_hash, without

GRAMS = (3, 4)
BITS = 15           # of the bucket of an n-gram, for each n
DIM = 16
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    """Class scores per n-gram bucket; ``threshold``: below it a prediction is rejected; ``known`` buckets and the ``coverage`` a text must have."""
    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray | None = None
    coverage: float = 0.0
    report: dict = field(default_factory=dict)


def padded(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded texts with two blanks before and after each."""
    n = len(off) - 1
    out = np.full(len(raw) + 4 * n, 32, np.uint8)
    new = off + 4 * np.arange(n + 1)
    at = np.arange(len(raw)) + np.repeat(4 * np.arange(n) + 2, np.diff(off))
    out[at] = _FOLD[raw]
    return out, new


def gram_buckets(buf: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte; buckets of different n don't overlap."""
    b = buf.astype(np.uint32)
    g = b[: len(b) - n + 1].copy()
    for i in range(1, n):
        g |= b[i: len(b) - n + 1 + i] << np.uint32(8 * i)
    g *= np.uint32(2654435761)
    g ^= g >> np.uint32(15)
    g *= np.uint32(2246822519)
    return (g >> np.uint32(32 - BITS)) + np.uint32(GRAMS.index(n) << BITS)


def text_scores(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each text the mean of its n-grams' rows of the table."""
    docs = len(off) - 1
    total, count = np.zeros((docs, table.shape[1])), np.zeros(docs)
    if not docs:
        return total
    buf, new = padded(raw, off)
    for n in GRAMS:
        ids = gram_buckets(buf, n)
        cut = np.empty(2 * docs, np.int64)
        cut[::2], cut[1::2] = new[:-1], new[1:] - (n - 1)
        cut[-1] = min(cut[-1], len(ids))
        for k in range(table.shape[1]):
            col = np.append(table[:, k][ids], np.float32(0))
            total[:, k] += np.add.reduceat(col.astype(np.float64), cut)[::2]
        count += np.diff(new) - (n - 1)
    return total / count[:, None]


def gram_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text, np.uint8)
    buf, _ = padded(raw, np.array([0, len(raw)]))
    ids = np.concatenate([gram_buckets(buf, n) for n in GRAMS])
    return np.unique(ids, return_counts=True)


def covered(share: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The share of known n-grams of texts with so many, 10 known ones added to each."""
    return (share * grams + 10) / (grams + 10)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, label, text) -> n-gram counts of the ``whole`` text, of two ``part`` passages, so that short texts are learned too, and of a ``junk`` passage with its characters shuffled."""
    for batch in batches:
        rows = []
        for key, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = text.split()
            parts = [("whole", text)]
            for i in range(2):
                if len(words) > 12:
                    size = 3 + (key >> (8 * i + 3)) % 10
                    at = (key >> (16 * i + 7)) % (len(words) - size)
                    parts.append(("part", " ".join(words[at:at + size])))
            if len(text) > 40:
                at = key % (len(text) - 40)
                parts.append(("junk", "".join(np.random.default_rng(key).permutation(list(text[at:at + 400])))))
            for kind, part in parts:
                ids, counts = gram_counts(part.encode())
                rows.append((key, label, kind, ids.astype(np.int32).tobytes(), counts.astype(np.float32).tobytes()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)],
                                         names=["key", "label", "kind", "ids", "counts"])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple], labels: list[str], epochs: int = 6, rate: float = 0.5, seed: int = 7,
        precision: float = 0.995, keep: float = 0.999, ceiling: float = 0.45) -> LanguageModel:
    """Stochastic gradient descent over (key, label, kind, ids, counts); a fifth of the keys calibrates.

    The threshold of the probability is the smallest at which the predictions it lets pass are
    right in ``precision`` of cases, but it never rejects more than
    1 - ``keep`` of the whole texts that are predicted rightly, nor a text of
    which one language holds ``ceiling`` of the probability (texts in two
    languages are kept)."""
    rng = np.random.default_rng(seed)
    size = len(GRAMS) << BITS
    emb = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    index = {x: i for i, x in enumerate(labels)}
    every = [(k, index[y], kind, np.frombuffer(i, np.int32), np.frombuffer(c, np.float32)) for k, y, kind, i, c in
             sorted(samples, key=lambda r: (r[0], r[1], r[2], r[3]))]
    data = [d for d in every if d[2] != "junk"]
    train = [d for d in data if (d[0] >> 40) % 5] or data
    held = [d for d in data if not (d[0] >> 40) % 5] or data
    steps, done = epochs * len(train), 0
    for _ in range(epochs):
        for j in rng.permutation(len(train)):
            _, y, _, ids, counts = train[j]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            x = counts / counts.sum()
            mean = x @ emb[ids]
            grad = softmax(mean @ w + bias)
            grad[y] -= 1
            back = w @ grad
            w -= lr * np.outer(mean, grad)
            bias -= lr * np.float32(0.1) * grad
            emb[ids] -= (lr * np.float32(len(ids))) * np.outer(x, back) / np.float32(8)
    logits = np.array([(c / c.sum()) @ emb[i] @ w + bias for _, _, _, i, c in held])
    truth = np.array([y for _, y, *_ in held])
    whole = np.array([d[2] == "whole" for d in held])
    grid = [0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.5, 2.0, 3.0, 5.0]
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = grid[int(np.argmin(loss))]
    p = softmax(logits / temperature)
    conf, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-conf, kind="stable")
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero(share >= precision)
    threshold = 0.0 if len(ok) and ok[-1] == len(order) - 1 else float(conf[order[ok[-1]]]) if len(ok) else 1.0
    good = conf[whole & right]
    if len(good):
        threshold = min(threshold, ceiling, float(np.quantile(good, 1 - keep)) * 0.9)
    known, coverage = calibrate_coverage(train, held, [d for d in every if d[2] == "junk"], len(labels), keep)
    return LanguageModel(labels, (emb @ w).astype(np.float32), bias, temperature, threshold, known, coverage,
                         {"train": len(train), "held": len(held), "accuracy": float(right.mean())})


def calibrate_coverage(train: list[tuple], held: list[tuple], junk: list[tuple], labels: int, keep: float) -> tuple[np.ndarray, float]:
    """The buckets that training texts hold, and the coverage below which a text is rejected."""
    texts = np.zeros((labels, len(GRAMS) << BITS), np.int32)
    for _, y, kind, ids, _ in train:
        if kind == "whole":
            texts[y, ids] += 1
    total, least = texts.sum(axis=0), 2 if sum(d[2] == "whole" for d in train) >= 200 else 1

    def share(rows: list[tuple], known: np.ndarray) -> np.ndarray:
        n = np.array([c.sum() for *_, c in rows])
        return covered(np.array([c[known[i]].sum() for *_, i, c in rows]) / n, n) if rows else np.zeros(0)

    clean = share([d for d in held if d[2] == "whole"], total >= least)
    low = float(np.quantile(clean, 1 - keep)) if len(clean) else 0.0
    reject = [float(np.quantile(share(junk, total >= least), 0.99))] if junk else []
    for y in range(labels):
        left_out = share([d for d in held if d[2] == "whole" and d[1] == y], total - texts[y] >= least)
        if labels > 1 and len(left_out):
            reject.append(float(np.median(left_out)))
    reject = [r for r in reject if r < low - 0.05]
    return total >= least, max(reject) + (low - max(reject)) / 4 if reject else 0.9 * low


def train_language_model(docs: DataFrame, text: str = "text", label: str = "lang", learn: Column | None = None,
                         key: str = "doc_id", per_label: int = 400, max_labels: int = 256) -> LanguageModel:
    """Train on about ``per_label`` rows of each label, chosen by a hash of ``key`` (or by the text's hash where it is null).

    The sample is bounded by per_label x max_labels rows, and is turned into
    n-gram counts (at most 2 x 2**15 a text) by tasks before it reaches the
    driver; more labels than ``max_labels`` are an error. ``learn`` says which
    rows may be used."""
    usable = F.col(label).isNotNull() & F.col(text).rlike("\\p{L}")
    if learn is not None:
        usable = usable & learn
    rows = docs.filter(usable).select(F.coalesce(F.xxhash64(F.col(key)), F.xxhash64(F.col(text))).alias("k"), F.col(label).alias("y"), F.col(text).alias("x"))
    found = rows.groupBy("y").count().orderBy("y").limit(max_labels + 1).collect()
    if len(found) > max_labels:
        raise ValueError(f"more than {max_labels} labels in column {label!r}; raise max_labels")
    if not found:
        return LanguageModel([], np.zeros((len(GRAMS) << BITS, 0), np.float32), np.zeros(0, np.float32))
    labels = [r["y"] for r in found]
    share = F.element_at(F.create_map(*[F.lit(v) for r in found for v in (r["y"], min(1.0, per_label / r["count"]))]), F.col("y"))
    sample = rows.filter(unit_hash(F.col("k")) < share).select(F.shiftrightunsigned("k", 1).alias("k"), "y", "x")
    got = sample.mapInArrow(_features, "key long, label string, kind string, ids binary, counts binary").collect()
    return fit([tuple(r) for r in got], labels)


def detect_language(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred",
                    score: str = "score", accepted: str = "accepted") -> DataFrame:
    """All columns, and the predicted label, its calibrated probability, and whether the thresholds let it pass. A column named like an added one is replaced."""
    spark = docs.sparkSession
    docs = without(docs, [pred, score, accepted], keep=[text])
    letter, copy = fresh(docs, "letter", "text")
    shared = spark.sparkContext.broadcast(model)
    n_cols = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = np.hstack([m.table, m.known[:, None].astype(np.float32)]) if m.labels else m.table
        for whole in batches:
            for batch in slices_by_bytes(whole, n_cols, 1 << 21):
                raw, off = text_buffers(batch.column(n_cols))
                has = batch.column(n_cols + 1).fill_null(False).to_numpy(zero_copy_only=False) & bool(m.labels)
                names, probs, cover = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
                if has.any():
                    means = text_scores(raw, off, table)
                    cover = covered(means[:, -1], sum(np.diff(off) + 4 - (n - 1) for n in GRAMS))
                    p = softmax((means[:, :-1] + m.bias) / m.temperature)
                    names[has] = np.array(m.labels, object)[p.argmax(axis=1)][has]
                    probs[has] = p.max(axis=1)[has]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(names, pa.string()), pa.array(probs), pa.array(has & (probs >= m.threshold) & (cover >= m.coverage))],
                                                 names=[*batch.schema.names[:n_cols], pred, score, accepted])

    schema = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score), F.lit(True).alias(accepted)).schema
    return docs.withColumn(copy, F.col(text)).withColumn(letter, F.col(text).rlike("\\p{L}")).mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows kept out of the training: crc32 of the key's text, mod 4, is 2 (a null key: not held out)."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))
