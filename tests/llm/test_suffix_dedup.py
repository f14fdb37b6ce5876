"""Operator 3 against all 200-byte strings in Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from strandloom.llm import suffix_dedup as sd


def brute(rows):
    raws, seen = [(t or "").encode() for _, t in rows], Counter()
    for r in raws:
        seen.update(r[i : i + 200] for i in range(len(r) - 199))
    for (i, _), r in zip(rows, raws, strict=True):
        gone = bytearray(len(r))
        for p in range(len(r) - 199):
            if seen[r[p : p + 200]] > 1:
                gone[p : p + 200] = b"\x01" * 200
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, hash string").repartition(3)
    key = lambda r: (str(r[0]), *r[1:])
    got, want = sorted((tuple(r) for r in sd.dedup(df, **options).collect()), key=key), sorted(brute(rows), key=key)
    for g, w in zip(got, want, strict=True):
        assert g == w


def made(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdéf") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages, rows = [prose(r.randint(20, 60)) for _ in range(6)], []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:
            p = r.choice(passages)
            a = r.randint(0, 40)
            rows.append((i, prose(r.randint(0, 30)) + p[a : len(p) - r.randint(0, 40)] + prose(r.randint(0, 30))))
        elif kind < 0.7 and rows:
            t = r.choice(rows)[1] or ""
            k = r.randint(0, len(t))
            rows.append((i, t[:k] + r.choice(["", "#", prose(3)]) + t[k:]))
        elif kind < 0.8:
            rows.append((i, r.choice(["ab", "a", prose(4)]) * r.randint(1, 400)))
        else:
            rows.append((i, prose(r.randint(1, 120))))
    return rows


ODD = [(1, None), (2, ""), (3, "x" * 199), (4, "y" * 200), (5, "y" * 200), (6, "z" * 201), (7, "short"), (7, "short"), (None, "q" * 100 + "r" * 150), (None, "q" * 100 + "r" * 150), (9, "\x00" * 300), (10, "é" * 150)]


def test_odd_inputs(spark):
    check(spark, ODD)
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random(spark, seed):
    check(spark, made(seed))


def test_large_groups_are_dealt_by_window(spark):
    check(spark, made(4, 90) + ODD[:4], group_limit=3)


def test_corpus(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)


def test_slices_of_a_long_text(monkeypatch):
    """A text in many slices has the same anchors as in one."""
    r = random.Random(5)
    raw = bytes(r.choice(b"abc ") for _ in range(30_000))
    group = next(sd._slices([(0, raw)]))
    want = sd._anchored(group)[4].tolist()
    monkeypatch.setattr(sd, "CHUNK", 4_096)
    got = [p for g in sd._slices([(0, raw)]) for p in sd._anchored(g)[4].tolist()]
    assert sorted(got) == sorted(want) and len(set(got)) == len(got)


def test_merge_and_front_coding():
    r = np.random.default_rng(2)
    s = r.integers(97, 99, (500, sd.FULL), np.uint8)
    s[:, :290] = s[r.integers(0, 9, 500), :290]
    rows = [x.tobytes() for x in s]
    parts = [sorted(rows[i::7]) for i in range(7)]
    blobs = [sd.encode_run(np.frombuffer(b"".join(p), np.uint8).reshape(-1, sd.FULL), (np.arange(len(p)),) * 3) for p in parts]
    out = list(sd.merged(blobs))
    assert [x[1] for x in out] == sorted(rows)
    for a, b in zip(out, out[1:], strict=False):
        assert b[0] == sd.common_prefix(a[1], b[1], 0)


def test_both_ways_to_decide_agree():
    r = np.random.default_rng(3)
    base = r.integers(97, 123, sd.FULL, np.uint8)
    m = np.tile(base, (6, 1))
    for i in range(6):
        m[i, sd.CORE + r.integers(30, 99)] = 65 + i
        m[i, sd.LENGTH + r.integers(30, 99)] = 65 + i
    rows = sorted(x.tobytes() for x in m)
    common = [0] + [sd.common_prefix(a, b, 0) for a, b in zip(rows, rows[1:], strict=False)]
    flat = lambda got: [{d for a, z in g for d in range(a, z + 1)} for g in got]
    few = flat(sd.decide(rows, common))
    limit, sd.PAIRS = sd.PAIRS, 1
    try:
        assert flat(sd.decide(rows, common)) == few
    finally:
        sd.PAIRS = limit
