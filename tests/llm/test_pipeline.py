"""The pipeline against a plain Python run over the same documents, stage by stage."""

import re
from collections import defaultdict

import corpus_pipeline
from strandloom.llm import mixing
from tests.llm.test_ngram_join import brute as near_brute
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_quality_rules import brute as quality_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_join", "pii", "mixing", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}

    one = stages["quality_rules"](spark, docs, "").cache()
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == COLUMNS and kept <= {i for i, r in rows.items() if not quality_brute(r.text)[-1]}
    assert len(kept) > 0.7 * len(rows)

    two = stages["ngram_join"](spark, one, "").cache()
    want = {c for _, _, c in near_brute([(i, rows[i].text) for i in sorted(kept)], 5, 80)}
    assert two.columns == COLUMNS and {r.doc_id for r in two.collect()} == want

    three = stages["pii"](spark, two, "").cache()
    clean = {r.doc_id: r.text for r in three.collect()}
    assert three.columns == COLUMNS and set(clean) == want
    for i, t in clean.items():
        assert not base_spans(t), i
        if not base_spans(rows[i].text) and "=" not in rows[i].text:
            assert t == rows[i].text or re.search(r"\[[A-Z_]+\]", t)

    four = stages["mixing"](spark, three, "").cache()
    sampled = {r.doc_id for r in mixing.mix(three).collect() if r.sampled}
    assert four.columns == COLUMNS and {r.doc_id for r in four.collect()} == sampled and sampled

    five = stages["packing"](spark, four, "").collect()
    by_doc = defaultdict(list)
    for r in five:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert set(by_doc) == sampled
    for pieces in by_doc.values():
        at = 0
        for s, n, total in sorted(pieces):
            assert s == at
            at += n
        assert at == total
    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in whole} == sampled and sum(r.length for r in whole) == sum(r.length for r in five)


def test_odd_rows_pass_every_stage(spark):
    text = " ".join(f"the word{i} of a kind" for i in range(30))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text, "en", None, 9), (3, text, None, "s", 9), (3, text, None, "s", 9), (4, text + " me@mail.example 10.0.0.1", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, "")
            now.collect()
