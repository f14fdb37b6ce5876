"""Graph operators over (node_id, layer, label) and (src, dst, relation, weight) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import ids
from strandloom.operators.components import components
from strandloom.sources.store import cut

EMPTY_DST = "__none__"


def project_nodes(facts: DataFrame, schemas: DataFrame, passages: DataFrame) -> DataFrame:
    """GR-1: schema, fact, passage and entity nodes."""
    s = schemas.select(ids.node_id("schema", "schema_id").alias("node_id"), F.lit("schema").alias("layer"), F.concat_ws(" ", "head_type", "relation", "tail_type").alias("label"))
    f = facts.select(ids.node_id("fact", "fact_id").alias("node_id"), F.lit("fact").alias("layer"), F.concat_ws(" ", "head_entity", "relation", "tail_entity").alias("label"))
    p = passages.select(ids.node_id("passage", "passage_id").alias("node_id"), F.lit("passage").alias("layer"), F.col("passage_id").alias("label"))
    e = entity_rollup(facts).select(ids.node_id("entity", "entity_key").alias("node_id"), F.lit("entity").alias("layer"), F.col("name").alias("label"))
    return s.unionByName(f).unionByName(p).unionByName(e)


def mentions(facts: DataFrame) -> DataFrame:
    """Head and tail of each fact as rows (entity_key, name, fact_id, passage_id)."""
    side = F.explode(F.array(F.col("head_entity"), F.col("tail_entity"))).alias("name")
    return facts.select("fact_id", "passage_id", side).withColumn("entity_key", ids.entity_key("name"))


def entity_rollup(facts: DataFrame) -> DataFrame:
    """AGG-8: per entity its name, the number of fact sides and of distinct passages."""
    return mentions(facts).groupBy("entity_key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("n_facts"), F.countDistinct("passage_id").alias("n_passages"))


def project_edges(facts: DataFrame, per_document: bool = False) -> DataFrame:
    """GR-1: schema to fact, fact to passage, entity to entity and entity to passage, all of weight 1.

    GR-14: with ``per_document`` entities are scoped to their document and fact evidence weighs its confidence.
    """
    doc = F.concat(F.col("doc_id").cast("string"), F.lit(":")) if per_document else F.lit("")
    entity = lambda c: F.concat(F.lit("entity:"), doc, ids.entity_key(c))
    evidence = F.col("confidence").cast("double") if per_document else F.lit(1.0)
    one = F.lit(1.0)
    edge = lambda df, src, dst, rel, w=one: df.select(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("relation"), w.alias("weight"))
    a = edge(facts, ids.node_id("schema", "schema_id"), ids.node_id("fact", "fact_id"), "schema_instance")
    b = edge(facts, ids.node_id("fact", "fact_id"), ids.node_id("passage", "passage_id"), "fact-evidence" if per_document else "fact_evidence", evidence)
    c = edge(facts, entity("head_entity"), entity("tail_entity"), "entity_cooccurrence").filter("src <> dst").distinct()
    sides = facts.select("doc_id", "passage_id", F.explode(F.array("head_entity", "tail_entity")).alias("name"))
    d = edge(sides, F.concat(F.lit("entity:"), doc, ids.entity_key("name")), ids.node_id("passage", "passage_id"), "entity_mention").distinct()
    return a.unionByName(b).unionByName(c).unionByName(d)


def edge_ids(edges: DataFrame) -> DataFrame:
    """Edge identifiers: the relation with hyphens, then both ends."""
    return edges.withColumn("edge_id", F.concat_ws(":", F.translate("relation", "_", "-"), "src", "dst"))


def transitions(edges: DataFrame) -> DataFrame:
    """GR-5, FLT-4: edges with no entity at either end."""
    return edges.filter(~F.col("src").startswith("entity:") & ~F.col("dst").startswith("entity:"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR-5: nodes without an outgoing edge, over all edges."""
    return nodes.join(edges.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_anti")


def adjacency(edges: DataFrame, node: str) -> DataFrame:
    """GR-6: edges into or out of a node."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-6: nodes and edges without the nodes of ``gone`` (node_id) and the edges at them."""
    g = gone.select("node_id").distinct()
    left = edges.join(g.withColumnRenamed("node_id", "src"), "src", "left_anti").join(g.withColumnRenamed("node_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "node_id", "left_anti"), left.select(edges.columns)


def delete_by_document(nodes: DataFrame, document: str) -> DataFrame:
    """FLT-5, GR-6: nodes whose JSON ``ref`` names the document, as its own or among its sources."""
    own = F.get_json_object("ref", "$.metadata.documentId") == document
    sources = F.from_json(F.get_json_object("ref", "$.sourceDocumentIds"), "array<string>")
    return nodes.filter(F.coalesce(own, F.lit(False)) | F.coalesce(F.array_contains(sources, document), F.lit(False)))


# --- bridges ---------------------------------------------------------------------------------------------------------


def type_bridges(schemas: DataFrame) -> DataFrame:
    """JN-8: pairs of schemas that share a head or tail type, lower id first."""
    t = schemas.select("schema_id", F.explode(F.array_distinct(F.array(F.lower("head_type"), F.lower("tail_type")))).alias("type"))
    a, b = t.select(F.col("schema_id").alias("a"), "type"), t.select(F.col("schema_id").alias("b"), "type")
    return a.join(b, "type").filter("a < b").select("a", "b").distinct()


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def similarity_bridges(vectors: DataFrame, threshold: float = 0.7, first: int = 50) -> DataFrame:
    """JN-9: pairs among the first 50 vectors by id with a cosine of at least ``threshold``; the bound is the operator's own."""
    v = vectors.select("id", "embedding").orderBy("id").limit(first)
    a, b = v.select(F.col("id").alias("a"), F.col("embedding").alias("va")), v.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity")).filter(F.col("similarity") >= threshold)


def isa_bridges(schemas: DataFrame, relations: DataFrame) -> DataFrame:
    """JN-10: pairs of schemas whose head types are a hypernym or hyponym pair, either way round."""
    r = relations.filter(F.col("relation_type").isin("hypernym", "hyponym")).select(F.lower("source").alias("x"), F.lower("target").alias("y"))
    both = r.union(r.select("y", "x")).distinct()
    s = schemas.select("schema_id", F.lower("head_type").alias("t"))
    a, b = s.select(F.col("schema_id").alias("a"), F.col("t").alias("x")), s.select(F.col("schema_id").alias("b"), F.col("t").alias("y"))
    return a.join(both, "x").join(b, "y").filter("a < b").select("a", "b").distinct()


# --- iterative operators ---------------------------------------------------------------------------------------------


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """AGG-2: (node_id, component), component being the least id reachable; edges with unknown ends do not count.

    Nodes are numbered once, so that the rounds exchange numbers only; components are named at the end.
    """
    known = cut(nodes.select("node_id").distinct().withColumn("id", F.monotonically_increasing_id()), "nodes")
    end = lambda c, n: known.select(F.col("node_id").alias(c), F.col("id").alias(n))
    numbered = edges.select("src", "dst").filter("src <> dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst").select("a", "b")
    linked = cut(components(numbered).join(known, "id"), "components")
    named = linked.join(linked.groupBy("component").agg(F.min("node_id").alias("name")), "component").select("node_id", F.col("name").alias("component"))
    return named.unionByName(known.join(linked, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component")))


def multi_hop(edges: DataFrame, seeds: DataFrame, hops: int = 3, least_weight: float = 0.0, relations: list[str] | None = None, limit: int = 50) -> DataFrame:
    """GR-9: breadth-first, either direction, path weight as product; entity nodes are not entered, a node's first discovery wins.

    Within a hop the heaviest path to a node is kept (ties: least predecessor). Returns the ``limit`` heaviest (node_id, hop, path_weight).
    """
    e = edges.filter(F.col("weight") >= least_weight)
    if relations:
        e = e.filter(F.col("relation").isin(*relations))
    both = e.select("src", "dst", "weight").union(e.select("dst", "src", "weight")).filter(~F.col("dst").startswith("entity:"))
    frontier = seeds.select("node_id", F.lit(0).alias("hop"), F.lit(1.0).alias("path_weight")).distinct()
    visited = frontier
    best = Window.partitionBy("node_id").orderBy(F.col("path_weight").desc(), "via")
    for h in range(1, hops + 1):
        step = frontier.join(both, frontier.node_id == both.src).select(F.col("dst").alias("node_id"), (F.col("path_weight") * F.col("weight")).alias("path_weight"), F.col("src").alias("via"))
        step = step.join(visited.select("node_id"), "node_id", "left_anti").withColumn("rn", F.row_number().over(best)).filter("rn = 1")
        frontier = cut(step.select("node_id", F.lit(h).alias("hop"), "path_weight"), "frontier")
        visited = visited.unionByName(frontier)
    return visited.filter("hop > 0").orderBy(F.col("path_weight").desc(), "hop", "node_id").limit(limit)


def merge_articles(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GR-10: entity ``the_x`` is merged into ``x`` where both exist and x has two words or six characters.

    Edges are redirected; loops that this makes go, and so do repeated edges.
    """
    e = nodes.filter(F.col("layer") == "entity").select("node_id")
    the = e.filter(F.col("node_id").startswith("entity:the_")).select("node_id", F.concat(F.lit("entity:"), F.substring("node_id", 12, 1 << 20)).alias("into"))
    key = F.substring("into", 8, 1 << 20)
    the = the.filter(F.contains(key, F.lit("_")) | (F.length(key) >= 6)).join(e.withColumnRenamed("node_id", "into"), "into", "left_semi")
    out = edges
    for side in ("src", "dst"):
        out = out.join(the.select(F.col("node_id").alias(side), F.col("into").alias(f"into_{side}")), side, "left")
    moved = F.col("into_src").isNotNull() | F.col("into_dst").isNotNull()
    out = out.select(F.coalesce("into_src", "src").alias("src"), F.coalesce("into_dst", "dst").alias("dst"), "relation", "weight", moved.alias("moved"))
    out = out.filter(~(F.col("moved") & (F.col("src") == F.col("dst")))).drop("moved").dropDuplicates(["src", "dst", "relation"])
    return nodes.join(the.select("node_id"), "node_id", "left_anti"), out


def canonical_nodes(nodes: DataFrame, schemas: DataFrame) -> DataFrame:
    """GR-2: nodes with a marker: a schema node carries its schema's state, other nodes none."""
    s = schemas.select(ids.node_id("schema", "schema_id").alias("node_id"), F.col("state").alias("marker"))
    return nodes.join(s, "node_id", "left")


def select_nodes(nodes: DataFrame, corpus: str | None = None, layer: str | None = None) -> DataFrame:
    """FLT-1, FLT-3: a tenant's nodes, or those of a layer; both predicates reach the scan."""
    out = nodes if corpus is None else nodes.filter(F.col("corpus_id") == corpus)
    return out if layer is None else out.filter(F.col("layer") == layer)
