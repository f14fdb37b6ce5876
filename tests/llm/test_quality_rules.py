"""Operator 1 against Python, and against labels."""

import re

from strandloom.llm import quality_rules as q


def brute(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(ws) - 7):
        at.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {p for g in at.values() if len(g) > 1 for i in g for p in range(i, i + 8)}
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e f g h", "a b c d e f g h i", "a " * 8, "a " * 9, "a " * 500, "x y z " * 30 + "w", "line one\nline one\n \nline two\r\nline two\n", "é😀 # * $ % & | < > " * 3,
    " ".join(f"w{i}" for i in range(40)) + " " + " ".join(f"w{i}" for i in range(5, 14)), "long" * 3000, "\x0bword\x0c" * 25, "no\xa0break\x85space " * 12,
]


def test_counts_equal_python(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "a b", ""), (3, "one", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000", "text", "lang"))
    key = lambda r: (str(r[0]), *r[1:])
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)
    got = q.quality_rules(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == want
    assert all(not (r.base_failed and r.kept) for r in got)
    assert q.keep_good(docs).columns == docs.columns and q.quality_rules(docs.limit(0)).count() == 0


def test_other_scripts_need_no_stop_words(spark):
    words = lambda first, n: " ".join(chr(first + i % 20) * (2 + i % 7) for i in range(n))
    texts = {1: words(0x430, 46), 2: words(0x4E00, 50), 3: words(0x67, 50), 4: words(0x430, 20) + " " + words(0x67, 30), 5: words(0x430, 30) + " “the” … of the – and " + words(0x67, 9)}
    got = {r.doc_id: r for r in q.quality_rules(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {i: r.n_latin_words for i, r in got.items()} == {1: 0, 2: 0, 3: 50, 4: 30, 5: 15}
    assert {i: r.kept for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_verdicts_follow_labels(spark):
    d = "/root/testdata/sf0.1"
    rows = q.quality_rules(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("n_words >= 20").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) > 0.995 * len(good) and sum(r.kept for r in bad) < 0.05 * len(bad)


def test_no_user_functions(spark):
    plan = q.quality_rules(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
