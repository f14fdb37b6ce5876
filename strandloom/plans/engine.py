"""Engine: the callable surface of the library over one session and one set of tables.

A query runs candidate search, expansion (comparisons only), propagation and context building as DataFrame stages; only
the scalar distance of the propagation and the final context reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import text
from strandloom.operators import context, graph, memory, ppr, retrieval, stats
from strandloom.sources import store


@dataclass(frozen=True)
class Request:
    """FLT-9: a validated retrieval request."""

    query: str
    vector: list[float] | None = None
    top_k: int = 10
    top_m: int = 5
    threshold: float = 0.5
    context_tokens: int = 8000

    def __post_init__(self):
        if not self.query.strip():
            raise ValueError("the query is empty")
        for name in ("top_k", "top_m", "context_tokens"):
            v = getattr(self, name)
            if not isinstance(v, int) or isinstance(v, bool) or v <= 0:
                raise ValueError(f"{name} must be a positive whole number")
        if not -1 <= self.threshold <= 1:
            raise ValueError("threshold must be between -1 and 1")
        if self.vector is not None and (not self.vector or any(x != x or abs(x) == float("inf") for x in self.vector)):
            raise ValueError("the vector must be finite and not empty")


@dataclass
class Capabilities:
    """QA-7: which providers are there; the next one down takes over where one is missing."""

    nlp: list[str] = field(default_factory=lambda: ["regex"])
    embedding: list[str] = field(default_factory=lambda: ["none"])

    NLP_ORDER = ("sidecar", "llm", "regex")
    EMBEDDING_ORDER = ("remote", "local", "none")

    def best(self, kind: str) -> str:
        have, order = (self.nlp, self.NLP_ORDER) if kind == "nlp" else (self.embedding, self.EMBEDDING_ORDER)
        return next(x for x in order if x in have or x == order[-1])


class Engine:
    """Tables: passages, facts, schemas, and vectors (id of a passage, namespace, embedding) if there are any."""

    def __init__(self, spark: SparkSession, passages: DataFrame, facts: DataFrame, schemas: DataFrame, vectors: DataFrame | None = None):
        self.spark, self.passages, self.facts, self.schemas, self.vectors = spark, passages, facts, schemas, vectors
        self._transitions: DataFrame | None = None

    def transitions(self) -> DataFrame:
        """Compiled once per engine and kept in the shared folder."""
        if self._transitions is None:
            self._transitions = store.cut(ppr.compile_transitions(graph.transitions(graph.project_edges(self.facts))), "transitions")
        return self._transitions

    def candidates(self, r: Request) -> DataFrame:
        """Passage seeds (node_id, score): BM25, fused with the vector list where a query vector is given."""
        q = self.spark.createDataFrame([(0, r.query)], "query_id int, query_text string")
        lexical = retrieval.bm25(self.passages, q, r.top_k, key="passage_id")
        if r.vector is None or self.vectors is None:
            return lexical.select(F.concat(F.lit("passage:"), "passage_id").alias("node_id"), "score")
        near = retrieval.ranked(retrieval.vector_top(self.vectors, r.vector, r.top_k, "passage", r.threshold).withColumn("g", F.lit(0)), "g", "id").withColumnRenamed("id", "passage_id")
        fused = retrieval.hybrid(near, lexical, "passage_id", r.top_k)
        return fused.select(F.concat(F.lit("passage:"), "passage_id").alias("node_id"), F.col("similarity").alias("score"))

    def fact_seeds(self, r: Request) -> DataFrame:
        """Facts whose ends share terms with the query, by overlap."""
        terms = text.term_set(F.lit(r.query))
        score = text.jaccard(text.term_set(F.concat_ws(" ", "head_entity", "relation", "tail_entity")), terms)
        return self.facts.select("fact_id", F.round(score, 9).alias("score")).filter("score > 0").orderBy(F.col("score").desc(), "fact_id").limit(r.top_m)

    def retrieve(self, r: Request) -> DataFrame:
        """(node_id, score, rank) of the best passages and facts after propagation."""
        facts = self.fact_seeds(r)
        named = lambda df: df.select(F.concat(F.lit("fact:"), "fact_id").alias("node_id"), "score")
        comparison = self.spark.range(1).select(text.is_comparison(F.lit(r.query))).first()[0]
        expanded = named(ppr.expand_facts(facts, self.facts)) if comparison else named(facts).limit(0)
        seeds = ppr.seed_vector(named(facts), expanded, self.candidates(r), named(facts).limit(0))
        score, _ = ppr.run(self.transitions(), store.cut(seeds, "seeds"))
        return retrieval.ranked_layers(score, r.top_k, r.top_m)

    def query(self, r: Request) -> dict:
        """The prompt context, its confidence and the template answer."""
        nodes = store.cut(self.retrieve(r), "ranked")
        p = retrieval.materialize(nodes.filter(F.col("node_id").startswith("passage:")), self.passages, "passage_id", "passage:")
        f = retrieval.materialize(nodes.filter(F.col("node_id").startswith("fact:")), self.facts, "fact_id", "fact:")
        comparison = self.spark.range(1).select(text.is_comparison(F.lit(r.query))).first()[0]
        built = context.build_context(p, f, r.context_tokens, comparison).first()
        answer = context.template_answer(r.query, p, f).first()
        return {"context": built.context, "confidence": float(built.confidence), "answer": answer.answer, "citations": list(answer.citations), "comparison": bool(comparison)}

    def integrity(self) -> DataFrame:
        links = self.facts.select("fact_id", "passage_id")
        return memory.integrity(self.schemas, self.facts, self.passages, links, graph.project_nodes(self.facts, self.schemas, self.passages), graph.project_edges(self.facts))

    def stats(self) -> DataFrame:
        return stats.corpus_counts({"passages": self.passages, "facts": self.facts, "schemas": self.schemas})

    def export(self, offset: int = 0, limit: int = 10_000) -> DataFrame:
        return store.export_page(graph.project_nodes(self.facts, self.schemas, self.passages), offset, limit)

    def delete_document(self, doc) -> Engine:
        left = memory.delete_document(doc, self.passages, self.facts, self.schemas)
        return Engine(self.spark, left["passages"], left["facts"], left["schemas"], self.vectors)

    def views(self) -> None:
        """SRC-10: nodes and edges as SQL views, in place of a graph query language."""
        graph.project_nodes(self.facts, self.schemas, self.passages).createOrReplaceTempView("nodes")
        graph.project_edges(self.facts).createOrReplaceTempView("edges")
