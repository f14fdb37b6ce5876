"""Service surfaces and providers."""

import pytest
from pyspark.sql import functions as F
from strandloom.operators import providers
from strandloom.plans import services
from strandloom.streaming.ingest import Store


def test_dictionary(spark):
    d = services.Dictionary(spark.createDataFrame([("t1", "c", "a", "Alpha", ["al"], "x", 3, 0.9)], services.ENTRIES))
    d = d.add(spark.createDataFrame([("t1", "c", "a", "Alpha", ["al", "alf"], "x", 4, 0.9), ("t2", "c", "b", "Beta", [], "y", 1, 0.1)], services.ENTRIES))
    assert [r.frequency for r in d.lookup(" ALF ").collect()] == [4] and {r.measure: r.value for r in d.stats().collect()} == {"total": 2.0, "confident": 0.5, "domain:x": 1.0, "domain:y": 1.0}
    again = services.Dictionary(d.entries.limit(0)).load(d.export())
    assert sorted(r.term_id for r in again.entries.collect()) == ["t1", "t2"]


def test_thesaurus_refuses_cycles(spark):
    t = services.Thesaurus(spark.createDataFrame([("r1", "c", "cat", "animal", "hypernym", 1.0, False)], services.RELATIONS))
    t = t.add(spark.createDataFrame([("r2", "c", "animal", "being", "hypernym", 1.0, False), ("r3", "c", "x", "y", "odd", 1.0, False)], services.RELATIONS))
    assert t.relations.count() == 2 and t.search("Animal").count() == 2 and t.load(t.export()).relations.count() == 2
    with pytest.raises(ValueError):
        t.add(spark.createDataFrame([("r4", "c", "being", "Cat", "hypernym", 1.0, False)], services.RELATIONS))


def test_corpora(spark, tmp_path):
    c = services.Corpora(Store(spark, str(tmp_path)))
    c.create("a", "A")
    c.create("b", "B")
    c.start_job("j1", "a")
    c.start_job("j2", "b")
    assert [r.corpus_id for r in c.list().collect()] == ["a", "b"]
    assert c.delete("a") == {"corpora": 1}
    assert [r.corpus_id for r in c.list().collect()] == ["b"] and {r.job_id: r.status for r in c.jobs().collect()} == {"j1": "cancelled", "j2": "running"}


def test_paths():
    assert services.confined("/data", "a/b.md") == "/data/a/b.md"
    for bad in ("../x", "/etc/passwd", "a/../../b", "a\x00"):
        with pytest.raises(ValueError):
            services.confined("/data", bad)


def test_answers_fall_back(spark):
    def model(prompts, sample):
        return [None if p is None or "silent" in p else f"thinking\nFINAL: {'yes' if sample != 1 else 'no'}" for p in prompts]

    q = spark.createDataFrame([(1, "is it"), (2, "silent"), (3, None)], "id long, prompt string")
    got = {r.id: (r.answer, r.votes) for r in providers.answers(q, "id", "prompt", model, fallback=F.lit("template")).collect()}
    assert got == {"1": ("yes", 2), "2": ("template", 0), "3": ("template", 0)}


def test_retries():
    seen, waits = [], []

    def flaky(x):
        seen.append(x)
        if len(seen) < 3:
            raise ConnectionError
        return x

    assert providers.with_retries(flaky, sleep=waits.append)(5) == 5 and waits == [0.25, 0.5]


def test_vector_inputs(spark):
    n = spark.createDataFrame([("a", "x"), ("b", None)], "node_id string, label string")
    assert all(r.ok and r.dimensions == 8 for r in providers.vector_inputs(n).collect())
    bad = providers.vector_inputs(n, lambda ts: [[float("nan")] * 8 for _ in ts]).collect()
    assert not any(r.ok for r in bad)
