"""Operator 8 against a Python walk over the documents, and its likeness on planted edits."""

import hashlib
import random
import re
import struct

import pytest
import xxhash
from strandloom.llm import syncmers


def edits(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for k, (i, t) in enumerate(rows):
        m, nxt = len(t) // 3, rows[(k + 1) % len(rows)][1]
        yield i, len(t), hashlib.sha256((t[: len(t) - m] + nxt[:m]).encode()).hexdigest()


def run(spark, rows):
    return syncmers.fingerprints(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_chars string")).collect()


def test_edited_texts(spark):
    few = [(5, "one two three four five six seven eight"), (9, None), (7, ""), (1, "é😀 " * 40), (1000000, "far away " * 30), (5, "one two three four five six seven eight"), (None, "no id at all"), (2, "x" * 5000)]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    for rows in (few, [(3, "alone again")], [tuple(r) for r in docs]):
        assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in run(spark, rows)), key=key) == sorted(edits(rows), key=key)


def test_likeness(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = syncmers.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r.text, r.fingerprint) == r.fingerprint
    long = [r for r in rows if len(r.text.split()) >= 60]
    assert sum(r.near_edited > 0.3 for r in long) > 0.95 * len(long)
    assert sum(r.near_next < 0.05 for r in long) > 0.9 * len(long)


def test_all_anchors_with_their_places(spark):
    long = [f"w{i * 7919 % 10007}" for i in range(6000)]
    whole, part = " ".join(long), " ".join(long[3000:3040])
    (r,) = [r for r in run(spark, [(2, part), (1, whole)]) if r.doc_id == 2]
    assert r.near_next == 1.0
    changed = {run(spark, [(1, " ".join([*long[:i], "other", *long[i + 1 :]]))])[0].fingerprint for i in range(1000, 1005)}
    assert len(changed) == 5
    (r,) = run(spark, [(1, whole)])
    gaps = [int(r.fingerprint[i], 16) for i in range(0, len(r.fingerprint), 9)]
    assert all(0 < g <= 2 for g in gaps[1:]) and len(gaps) > 3000
    runs = [" ".join(long[i : i + 6]) for i in range(0, 600, 6)]
    spread = " ".join(f"{x} {'y' * (1 + i % 9)} z{i}" for i, x in enumerate(runs))
    (r,) = [r for r in run(spark, [(2, " ".join(runs)), (1, spread)]) if r.doc_id == 2]
    assert 0 < r.near_next < 0.6


def test_empty(spark):
    assert run(spark, []) == []
    (r,) = run(spark, [(1, "")])
    assert (r.fingerprint, r.near_edited, r.near_next) == ("", 1.0, 1.0)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hashed(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else struct.pack("<q", v), seed)
    return signed(seed)


def anchors(text):
    """(hash, place) by comparing all inner runs of every run of four tokens."""
    h = [hashed(t.encode()) for t in re.findall(r"[^\x20\x09-\x0D]{1,16}", text)]
    found = []
    for i in range(len(h) - 3):
        inner = [hashed(*h[j : j + 2]) for j in range(i, i + 3)]
        if min(inner) in (inner[0], inner[2]):
            found.append((hashed(inner[0], inner[2]) & 0xFFFFFFFF, i))
    return found or ([(hashed(*h) & 0xFFFFFFFF, 0)] if h else [])


def written(found):
    return "".join(f"{p - b:X}{h:08X}" for (h, p), b in zip(found, [0, *(p for _, p in found)], strict=False))


def alike(a, b):
    if not a or not b:
        return float(not a and not b)
    link = lambda x: {(p[0], q[0], q[1] - p[1]) for p, q in zip(x, x[1:], strict=False)}
    a, b = ({h for h, _ in a}, {h for h, _ in b}) if min(len(a), len(b)) == 1 else (link(a), link(b))
    return len(a & b) / min(len(a), len(b))


def brute(rows):
    """Rows by descending id, none last, equal ids by the hash of their text."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), hashed(r[1].encode())))
    for k, (i, t) in enumerate(rows):
        m, nxt = len(t) // 3, rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - m] + nxt[:m]
        x, y, z = anchors(t), anchors(new), anchors(nxt)
        yield i, len(t), hashlib.sha256(new.encode()).hexdigest(), written(x), written(y), round(alike(x, y), 6), round(alike(x, z), 6)


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    pool = [f"t{i}" for i in range(12)] + ["日本", "😀" * 20, "x" * 50]
    texts = [" ".join(r.choice(pool) for _ in range(r.choice([0, 1, 2, 3, 4, 4, 4, 5, 6, 9, 40, 120]))) for _ in range(150)]
    big = (1 << 63) - 1
    ids = [r.choice([None, -big - 1, big, 0, 7, r.randint(-big, big), r.randint(0, 50)]) for _ in texts]
    rows = [*zip(ids, texts, strict=True), (3, None), (3, ""), (7, texts[40]), (7, texts[40])]
    key = lambda x: [(v is None, v or 0) for v in x[:1]] + list(map(str, x[1:]))
    for per_range in (512, 8, 1):
        monkeypatch.setattr(syncmers, "PER_RANGE", per_range)
        for got, want in zip(sorted(map(tuple, run(spark, rows)), key=key), sorted(brute(rows), key=key), strict=True):
            assert got[:5] == want[:5] and got[5:] == pytest.approx(want[5:])


def test_ranges_are_even_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "PER_RANGE", 50)
    r = random.Random(6)
    spread = [None] * 1500 + [r.randint(-(1 << 63), (1 << 63) - 1) for _ in range(1500)] + [5] * 1000 + list(range(1000)) + [1 << 62]
    df, _ = syncmers.with_next(spark.createDataFrame([(i, f"text {k}") for k, i in enumerate(spread)], "doc_id long, text string"))
    sizes = [x["count"] for x in df.groupBy("__range").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 300


def test_distinct_short_texts_are_not_alike(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(4))) for i in range(60)]
    got = run(spark, rows)
    assert all(x.fingerprint and x.near_next == 0 for x in got) and len({x.fingerprint for x in got}) == 60
