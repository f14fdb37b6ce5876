"""All queries of the engine by name, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.plans import filter_queries, graph_queries, memory_queries, retrieval_queries, text_queries

ALL = {**text_queries.QUERIES, **retrieval_queries.QUERIES, **graph_queries.QUERIES, **memory_queries.QUERIES, **filter_queries.QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the documents for every benchmark text."""
    return ALL["top3_bm25"][0](spark, sf_dir)


def queries() -> dict:
    return {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
