"""Operator 4: held-out accuracy, gradients, and odd inputs."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from strandloom.llm import mil_quality


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = mil_quality.score(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    y, s = np.array([r.quality for r in rows]), np.array([r.score for r in rows])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    print("auc", auc, "accuracy", np.mean((s >= 0.7) == y), "kept of label 1", (s[y == 1] >= 0.7).mean(), "of label 0", (s[y == 0] >= 0.7).mean())
    assert auc > 0.98 and np.mean((s >= 0.7) == y) > 0.96


def test_gradient():
    r = np.random.default_rng(1)
    m = mil_quality.Model()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, bags, y = r.normal(size=(7, mil_quality.WIDTH)), np.array([3, 1, 3]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(np.log(np.where(y == 1, p := m.forward(x, bags)[0], 1 - p)))
    grad = m.gradient(x, bags, y)
    for k, at in (("W", (5, 2)), ("V", (1, 3)), ("U", (2, 2)), ("a", (4,)), ("c", (3,)), ("d", (0,)), ("b", (1,))):
        w, e = m.w[k], 1e-5
        w[at] += e
        high = loss()
        w[at] -= 2 * e
        low = loss()
        w[at] += e
        assert abs((high - low) / (2 * e) - grad[k][at]) < 1e-6


def test_batching_does_not_change_scores():
    texts = ["", None, "one", "a b c d e a b c d e " * 300, "é " * 2000, "last\n\nlines\n"]
    raws = [(t or "").encode() for t in texts]
    x, bags = mil_quality.encode(raws)
    for i, t in enumerate(raws):
        alone, n = mil_quality.encode([t])
        assert n[0] == bags[i] and np.allclose(alone, x[bags[:i].sum() : bags[: i + 1].sum()])


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 1), (1, None, 1), (None, "x", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (1, 1)], "doc_id long, quality int")
    assert [r.score for r in mil_quality.score(docs, labels).collect()] == [0.5] * 3
    assert mil_quality.score(docs.limit(0), labels).count() == 0


def features(raw):
    """Of every passage, by counting."""
    n, size, step, text = max(1, -(-len(raw) // mil_quality.PASSAGE)), len(raw), mil_quality.PASSAGE, raw + b" "
    of = lambda at: min(at // step, n - 1)
    cls = mil_quality.CLASS.tolist()
    pairs = [Counter() for _ in range(n)]
    for j in range(size):
        pairs[of(j)][cls[text[j]], cls[text[j + 1]]] += 1
    words, at = [], 0
    for w in raw.replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" "):
        if w:
            words.append((w, of(at)))
        at += len(w) + 1
    runs = Counter(tuple(w for w, _ in words[i : i + 4]) for i in range(len(words) - 3))
    for k in range(n):
        own = [w for w, p in words if p == k]
        m = max(len(own), 1)
        total = sum(pairs[k].values())
        big = np.zeros(mil_quality.N_CLASS**2)
        for (a, b), c in pairs[k].items():
            big[a * mil_quality.N_CLASS + b] = math.sqrt(c / total)
        again = sum(1 for i, (w, p) in enumerate(words) if i and p == k and words[i - 1][0] == w)
        twice = sum(1 for i, (_, p) in enumerate(words[: max(len(words) - 3, 0)]) if p == k and runs[tuple(w for w, _ in words[i : i + 4])] > 1)
        here = sum(1 for j in range(size + 1) if of(j) == k)
        lines = sum(1 for j in range(size) if of(j) == k and raw[j] == 10)
        yield np.concatenate([big, [len(own) / 200, sum(map(len, own)) / m / 10, (len(own) - len(set(own))) / m, again / m, twice / m, lines / m * 5, here / step, not own]])


def brute(model, text):
    """The forward pass, passage by passage."""
    w, h, e = model.w, [], []
    for x in features((text or "").encode()):
        h.append(np.tanh(((x - model.mean) * model.scale) @ w["W"] + w["b"]))
        e.append(sum(math.tanh(h[-1] @ w["V"][:, i]) / (1 + math.exp(-(h[-1] @ w["U"][:, i]))) * w["a"][i] for i in range(mil_quality.GATE)))
    weights = [math.exp(v - max(e)) for v in e]
    z = sum(a / sum(weights) * x for a, x in zip(weights, h, strict=True))
    return 1 / (1 + math.exp(-(z @ w["c"] + w["d"][0])))


@pytest.fixture(scope="module")
def model(spark):
    d = "/root/testdata/sf0.01"
    return mil_quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"), sample=300)


def test_scores_equal_a_plain_forward_pass(spark, model):
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40).collect()]
    texts = [*some, None, "", " \n\t ", "one", "é" * 700, "a b c d e a b c d e\n" * 200, "x" * 1024, "x" * 1025]
    assert model.trained and model.score(texts) == pytest.approx([brute(model, t) for t in texts], abs=1e-5)


def test_a_very_long_text_is_scored_in_slices(spark, model, monkeypatch):
    text = "\n".join(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r.text)
    text = (text * 30)[: 10 << 20]
    tracemalloc.start()
    (sliced,) = model.score([text])
    assert tracemalloc.get_traced_memory()[1] < 3 * len(text.encode()) + 100e6
    tracemalloc.stop()
    parts = [mil_quality.encode([r])[0] for r in (text.encode()[s : s + mil_quality.STRETCH] for s in range(0, len(text.encode()), mil_quality.STRETCH))]
    x = (np.concatenate(parts) - model.mean) * model.scale
    assert sliced == pytest.approx(model.forward(x, np.array([len(x)]))[0][0], abs=1e-5)


def test_passages_of_the_sample_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(mil_quality.Model, "fit", lambda self, x, bags, y: seen.append((len(x), len(y))))
    rows = [(i, f"word{i} " * 300) for i in range(60)] * 3 + [(1, "another text")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    mil_quality.train(docs, labels)
    mil_quality.train(docs, labels, passages=20)
    mil_quality.train(docs, labels, sample=9)
    assert 40 < seen[0][1] < 61 and seen[1][0] <= 20 and seen[2][1] == 9
