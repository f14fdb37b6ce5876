"""The engine end to end on the smallest tables."""

import pytest
from strandloom.plans.engine import Capabilities, Engine, Request
from strandloom.sources import tables

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    f = tables.facts(spark, DIR).cache()
    v = tables.vectors(spark, DIR).selectExpr("concat('passage:', id, ':0') AS id", "'passage' AS namespace", "embedding")
    return Engine(spark, tables.passages(spark, DIR), f, tables.schemas(f), v)


def test_query(engine, spark):
    vector = list(tables.vectors(spark, DIR).filter("id = 3").first().embedding)
    got = engine.query(Request("the nation in Asia", vector=vector, top_k=5, top_m=5))
    assert got["context"].startswith("## Relevant Passages") and 0 < got["confidence"] <= 1 and got["citations"]
    same = engine.query(Request("the nation in Asia", vector=vector, top_k=5, top_m=5))
    assert same == got


def test_comparison_puts_facts_first(engine):
    got = engine.query(Request("Which is larger, ASIA or EUROPE?", top_k=3, top_m=200))
    assert got["comparison"] and got["context"].startswith(("## Key Facts", "## Relevant Passages"))


def test_lifecycle(engine, spark):
    assert engine.integrity().count() == 0
    before, after = engine.stats().first(), engine.delete_document(3).stats().first()
    assert after.passages == before.passages - 1 and after.facts < before.facts
    assert engine.export(0, 7).count() == 7
    engine.views()
    assert spark.sql("SELECT count(*) AS n FROM edges JOIN nodes ON src = node_id").first().n > 0


@pytest.mark.parametrize("bad", [{"query": " "}, {"query": "x", "top_k": 0}, {"query": "x", "threshold": 2}, {"query": "x", "vector": []}, {"query": "x", "vector": [float("nan")]}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        Request(**bad)


def test_capabilities():
    assert Capabilities(nlp=["llm", "regex"]).best("nlp") == "llm" and Capabilities().best("embedding") == "none"
