"""Operator 10 against a symbol-by-symbol PPM and word counts in Python, and on held-out text."""

import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import pytest
from strandloom.llm import ppm


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute(rows):
    train = [(t or "").encode() for i, t in rows if not held(i)]
    words = Counter(w for t in train for w in t.lower().split())
    n_docs, n, v = len(train), sum(words.values()) + len(train), len(words) + bool(train)
    seen = defaultdict(Counter)
    for t in train:
        s = [255] * 4 + list(t) + [255]
        for p in range(4, len(s)):
            for k in range(5):
                seen[tuple(s[p - k : p])][s[p]] += 1
    for i, t in rows:
        raw = (t or "").encode()
        ws = raw.lower().split()
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws) + math.log10((n_docs + 1) / (n + v + 1))
        s, total = [255] * 4 + list(raw) + [255], 0.0
        for p in range(4, len(s)):
            excluded: set = set()
            for k in range(4, -1, -1):
                c = {x: y for x, y in seen.get(tuple(s[p - k : p]), {}).items() if x not in excluded}
                if not c:
                    continue
                whole = sum(c.values()) + len(c)
                if s[p] in c:
                    total += math.log10(c[s[p]] / whole)
                    break
                total += math.log10(len(c) / whole)
                excluded |= set(c)
            else:
                total -= math.log10(256 - len(excluded))
        yield i, held(i), len(ws) + 1, sum(w in words for w in ws) + (n_docs > 0), n, base, total


def run(spark, rows, **options):
    return ppm.score(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(2), **options).collect()


@pytest.mark.parametrize("top", [4, 1 << 18])
def test_equals_brute_force(spark, top):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(45).collect()]
    rows += [(None, "no id"), (1001, None), (1002, ""), (1003, "\x00 日本 unseen"), (1003, "\x00 日本 unseen")]
    key = lambda r: (str(r[0]), r[2])
    for got, want in zip(sorted(map(tuple, run(spark, rows, top=top)), key=key), sorted(brute(rows), key=key), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5], abs=1e-6) and got[6] == pytest.approx(want[6], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("nodes", [1, 500, 3000])
def test_pairs_beyond_the_broadcast_count(spark, nodes):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(25).collect()]
    rows += [(None, "no id"), (1001, None), (1003, "\x00 日本 unseen"), (1003, "\x00 日本 unseen")]
    assert any(held(i) for i, _ in rows)
    key = lambda r: (str(r[0]), r[2])
    for got, want in zip(sorted(map(tuple, run(spark, rows, nodes=nodes, bucket=1000)), key=key), sorted(brute(rows), key=key), strict=True):
        assert got[:5] == want[:5] and got[6] == pytest.approx(want[6], rel=1e-6, abs=1e-6)


def test_slices_that_lack_nothing_beside_some_that_do(spark):
    common = [(i, "abab abab " * 9) for i in range(40)]
    rare = [(100 + i, "".join(chr(33 + (i * 7 + j * j) % 90) for j in range(40))) for i in range(9)]
    parts = [spark.createDataFrame(x, "doc_id long, text string").repartition(n) for n, x in ((2, common), (1, rare))]
    got = sorted(map(tuple, ppm.score(parts[0].union(parts[1]), nodes=60, bucket=100).collect()))
    for g, want in zip(got, sorted(brute(common + rare)), strict=True):
        assert g[:5] == want[:5] and g[6] == pytest.approx(want[6], rel=1e-6, abs=1e-6)


def test_scores_of_a_partial_trie_that_lacks_nothing():
    keys = ppm.counted(next(ppm.gram_keys([b"ab ab ab"]))[1])
    trie = ppm.Trie({k: ppm.counted(keys[0] & ppm.np.uint64((1 << 8 * (k + 1)) - 1), keys[1]) for k in range(5)})
    (whole, _), (part, lacked) = ppm._scores(trie, [b"ab ab", b""]), ppm._scores(trie, [b"ab ab", b"ab"], partial=True)
    assert part[0] == whole[0] and lacked.to_pylist() == [[], []]
    assert ppm._scores(trie, [], partial=True)[1].to_pylist() == []


def test_held_out_text_is_likelier_than_noise(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    some = next(t for i, t in rows if held(i) and len(t) > 500)
    noise_id = next(i for i in range(5000, 6000) if held(i))
    got = {r.doc_id: r for r in run(spark, [*rows, (noise_id, some[::-1])])}
    text_id = next(i for i, t in rows if t == some)
    assert got[text_id].score > got[noise_id].score
    out = [r for r in got.values() if r.held_out and r.n_tokens > 50]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 1.2


def test_without_training_rows(spark):
    i = next(i for i in range(100) if held(i))
    (r,) = run(spark, [(i, "ab")])
    assert (r.n_known, r.train_tokens) == (0, 0) and r.score == pytest.approx(-3 * math.log10(256))
    assert run(spark, []) == []


def test_slices_do_not_matter(spark, monkeypatch):
    rows = [(i, ("one two three " * 9 + f"é{i} " + "x" * i) * (i % 4)) for i in range(30)] + [(None, "a\x0bb\tc d"), (40, " " * 50), (41, "y" * 90)]
    whole = list(ppm.gram_keys([(t or "").encode() for _, t in rows]))
    parts = list(ppm.gram_keys([(t or "").encode() for _, t in rows], size=7))
    for i in (0, 1):
        assert [x for p in parts for x in p[i].tolist()] == [x for p in whole for x in p[i].tolist()]
    for _, t in rows:
        assert [h for p in ppm.word_hashes(t.encode(), 5) for h in p.tolist()] == [h for p in ppm.word_hashes(t.encode()) for h in p.tolist()]


def test_memory_of_a_very_long_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    text = ("\n".join(r.text for r in docs if r.text).encode() * 200)[: 12 << 20]
    keys = ppm.counted(next(ppm.gram_keys([text[: 1 << 17]]))[1])
    trie = ppm.Trie({k: ppm.counted(keys[0] & ppm.np.uint64((1 << 8 * (k + 1)) - 1), keys[1]) for k in range(5)})
    tracemalloc.start()
    (score,), _ = ppm._scores(trie, [text])
    n = sum(len(h) for h in ppm.word_hashes(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 + 2 * len(text) and n == len(text.split()) and score < 0
    half = sum(trie.score(k).sum() for s in range(0, len(text), 1 << 21) for _, k in ppm.gram_keys([text[max(0, s - 4) : s + (1 << 21)]]))
    assert score == pytest.approx(half, rel=1e-4)
