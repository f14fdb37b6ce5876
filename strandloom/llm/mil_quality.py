"""Operator 4: quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. Every passage is encoded: frequencies of adjacent byte classes (square
roots) and repetition features of its words (repeats in the passage, four-word runs found elsewhere in the same stretch of
STRETCH bytes of the document, which nearly every document has only one of). A
projection gives its representation h; gated attention softmax(w . (tanh(V h) * sigmoid(U h))) over the document's passages
weighs them, and the weighted sum is scored by a logistic unit. All weights are learnt together from document labels.

Training is on the driver, over labelled documents whose crc32(doc_id) mod 4 is not 2, in the order of a hash of the id: at
most SAMPLE of them, of at most SAMPLE_CHARS characters each and SAMPLE_PASSAGES passages in all (parameters; the passages bound
the driver's memory, at some 5 KB each). Neither labels nor lang, source or doc_id enter a score. Scoring is one pass in Arrow
batches (Python, numpy) over every passage of every whole text; no shuffle. A long text is encoded stretch by stretch, and
attention runs over what is left of its passages, HIDDEN + 1 numbers each.

Defined results: null text = empty text = one passage without bytes; repeated rows are scored each; a null doc_id is not
held out; without labels every score is 0.5; of equal rows with one id one is learnt from, of different texts with one id each;
two labels of one id count as the higher; ties in the hash of the id go by id, then by text; empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PASSAGE = 1024
SAMPLE = 4000
SAMPLE_CHARS = 200_000
SAMPLE_PASSAGES = 24_000
STRETCH = 1 << 19  # a multiple of PASSAGE
FOLDS, HELD = 4, 2
THRESHOLD = 0.7
CHUNK = 1 << 18
HIDDEN, GATE, EPOCHS = 16, 8, 25


def _classes() -> np.ndarray:
    """Byte -> class: 26 letters, capital, digit, space, other white space, four kinds of marks, other marks, non-ASCII."""
    c = np.full(256, 34, np.int64)
    c[128:] = 35
    for group, chars in ((26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (27, "0123456789"), (28, " "), (29, "\t\n\x0b\x0c\r"), (30, "."), (31, ",;:"), (32, "!?"), (33, "#*$%&|<>_=+@~^\\{}[]")):
        c[[ord(x) for x in chars]] = group
    c[97:123] = np.arange(26)
    return c


CLASS, N_CLASS, N_STYLE = _classes(), 36, 8
WIDTH = N_CLASS * N_CLASS + N_STYLE
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 2 * STRETCH)
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(size, base & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
        del _powers[:-2]
    return _powers[0], _powers[1]


def stretches(texts: list[str | None]):
    """Groups of about CHUNK bytes of (number of the text, stretch); a text without bytes has one stretch."""
    held, size = [], 0
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for s in range(0, max(1, len(raw)), STRETCH):
            held.append((i, raw[s : s + STRETCH]))
            size += len(held[-1][1]) + PASSAGE // 4  # short texts too have a passage each
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and the number of passages of each stretch."""
    size = np.array([len(r) for r in raws], np.int64)
    passages = np.maximum(1, -(-size // PASSAGE))
    first = np.concatenate(([0], np.cumsum(passages)))
    x = np.zeros((first[-1], WIDTH), np.float32)
    joined = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    doc = np.repeat(np.arange(len(raws)), size + 1)
    at = np.arange(len(joined)) - start[doc]
    passage = first[doc] + np.minimum(at // PASSAGE, passages[doc] - 1)
    c = CLASS[joined]
    inner = doc[:-1] == doc[1:]
    pair = (passage[:-1] * (N_CLASS * N_CLASS) + c[:-1] * N_CLASS + c[1:])[inner]
    bigrams = np.bincount(pair, minlength=len(x) * N_CLASS * N_CLASS).reshape(len(x), -1)
    x[:, :-N_STYLE] = np.sqrt(bigrams / np.maximum(bigrams.sum(1, keepdims=True), 1))

    space = (c == 28) | (c == 29)
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    up, down = _power_tables(len(joined))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[: len(joined)], dtype=np.uint64)))
    h = (sums[end] - sums[begin]) * down[begin]
    h ^= h >> np.uint64(31)
    wp, wd = passage[begin], doc[begin]
    n = np.bincount(wp, minlength=len(x))
    many = np.maximum(n, 1)

    def distinct(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order by (group, key), and for each place there whether it equals the one before."""
        by = np.lexsort((keys, group))
        same = np.zeros(len(by), bool)
        same[1:] = (keys[by][1:] == keys[by][:-1]) & (group[by][1:] == group[by][:-1])
        return by, same

    if len(h):
        by, same = distinct(h, wp)
        repeated = np.bincount(wp[by][same], minlength=len(x))
        next_same = np.bincount(wp[1:][(h[1:] == h[:-1]) & (wd[1:] == wd[:-1])], minlength=len(x))
        runs = np.zeros(len(x))
        if len(h) > 4:
            g = ((h[:-3] * np.uint64(3) + h[1:-2]) * np.uint64(5) + h[2:-1]) * np.uint64(7) + h[3:]
            whole = wd[:-3] == wd[3:]
            g, gd, gp = g[whole], wd[:-3][whole], wp[:-3][whole]
            by, same = distinct(g, gd)
            twice = same.copy()
            twice[:-1] |= same[1:]
            runs = np.bincount(gp[by][twice], minlength=len(x))
        length = np.bincount(wp, weights=end - begin, minlength=len(x))
    else:
        repeated = next_same = runs = length = np.zeros(len(x))
    total = np.bincount(passage, minlength=len(x))
    lines = np.bincount(passage[joined == 10], minlength=len(x))
    x[:, -N_STYLE:] = np.stack([n / 200, length / many / 10, repeated / many, next_same / many, runs / many, lines / many * 5, total / PASSAGE, n == 0], 1)
    return x, passages


class Model:
    """The weights, and the forward and backward pass over bags of passages."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale, self.trained = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32), False
        self.w = {"W": r.normal(0, WIDTH**-0.5, (WIDTH, HIDDEN)), "b": np.zeros(HIDDEN), "V": r.normal(0, 0.3, (HIDDEN, GATE)), "U": r.normal(0, 0.3, (HIDDEN, GATE)), "a": r.normal(0, 0.3, GATE), "c": r.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def passages(self, x: np.ndarray):
        """Representations of passages, both parts of their gate, and what they weigh before the softmax."""
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, t, g, (t * g) @ w["a"]

    def forward(self, x: np.ndarray, bags: np.ndarray):
        h, t, g, e = self.passages(x)
        return self.attend(h, t, g, e, bags)

    def attend(self, h: np.ndarray, t: np.ndarray, g: np.ndarray, e: np.ndarray, bags: np.ndarray):
        w, at, doc = self.w, np.concatenate(([0], np.cumsum(bags)[:-1])), np.repeat(np.arange(len(bags)), bags)
        a = np.exp(e - np.maximum.reduceat(e, at)[doc])
        a /= np.add.reduceat(a, at)[doc]
        z = np.add.reduceat(a[:, None] * h, at, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        return p, (at, doc, h, t, g, a, z)

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict:
        w, (p, (at, doc, h, t, g, a, z)) = self.w, self.forward(x, bags)
        out = (p - y) / len(y)
        dz = (out[:, None] * w["c"])[doc]
        da = (dz * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, at)[doc])
        both = de[:, None] * w["a"]
        dt, dg = both * g * (1 - t * t), both * t * g * (1 - g)
        dh = (a[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ out, "d": out.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, decay: float = 1e-4, batch: int = 128, seed: int = 3) -> None:
        self.mean = x.mean(0)
        self.scale = 1 / (x.std(0) + 0.01)
        x -= self.mean
        x *= self.scale
        first, r, step = np.concatenate(([0], np.cumsum(bags))), np.random.default_rng(seed), 0
        m, v = ({k: np.zeros_like(a) for k, a in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(y))
            for s in range(0, len(y), batch):
                some = order[s : s + batch]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                grad, step = self.gradient(x[rows], bags[some], y[some]), step + 1
                for k, g in grad.items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = (self.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.trained = True

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not self.trained or not texts:
            return np.full(len(texts), 0.5)
        bags, parts = np.zeros(len(texts), np.int64), []
        for group in stretches(texts):
            x, n = encode([raw for _, raw in group])
            np.add.at(bags, [i for i, _ in group], n)
            x -= self.mean
            x *= self.scale
            h, _, _, e = self.passages(x)
            parts.append((h, e))
        h, e = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        return self.attend(h, None, None, e, bags)[0].astype(float)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, passages: int = SAMPLE_PASSAGES) -> Model:
    """A model fit to at most ``sample`` labelled documents, of at most ``passages`` passages in all, that are not held out."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    first = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE)).alias("n")
    # equal rows are combined before the exchange; texts are fetched only for what is within both bounds
    sized = docs.filter(F.length("text") <= chars).select("doc_id", F.xxhash64("text").alias("hash"), n).join(F.broadcast(first), "doc_id").groupBy("doc_id", "hash").agg(F.max("quality").alias("quality"), F.max("n").alias("n"))
    some = sized.orderBy(F.xxhash64("doc_id"), "doc_id", "hash").limit(sample)
    so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", "hash"))
    chosen = some.withColumn("so_far", so_far).filter(F.col("so_far") <= passages).drop("n", "so_far")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("doc_id", "hash").agg(F.first("text").alias("text"), F.max("quality").alias("quality"))
    rows = texts.toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
    model, y = Model(), np.array(rows.column("quality").to_pylist(), np.float32)
    if len(set(y.tolist())) > 1:
        parts = [encode([t.encode() for t in b.column("text").to_pylist()]) for b in rows.to_batches(max_chunksize=64)]
        model.fit(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), y)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches):
        model = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(model.score(b.column(1).to_pylist()))], ["doc_id", "held_out", "score"])

    scored = docs.withColumn("held_out", held_out()).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
