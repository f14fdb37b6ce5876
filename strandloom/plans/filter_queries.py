"""Filters, set operations, listings and small scalar operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import context, graph, lexicon, ppr
from strandloom.plans.graph_queries import SEEDS, STEPS, compiled, edges, nodes, seeds
from strandloom.sources import store, tables
from strandloom.sources.tables import table, with_ctes


def q_tenant(s, d):
    """Documents of one tenant (source) with a layer (language) predicate."""
    t = table(s, d, "documents").select("doc_id", F.col("source").alias("corpus_id"), F.col("lang").alias("layer"))
    return graph.select_nodes(t, "src3", "en").select("doc_id")


def q_states(s, d):
    f = tables.facts(s, d).withColumn("state", F.when(F.col("doc_id") % 4 == 0, "inactive").otherwise("active"))
    return f.filter("state = 'active' and relation in ('placed', 'in_nation')").groupBy("relation", "state").agg(F.count(F.lit(1)).alias("n"))


def q_sets(s, d):
    """Union, intersection and difference of two id sets."""
    t = table(s, d, "documents").select("doc_id")
    a, b = t.filter("doc_id % 2 = 0"), t.filter("doc_id % 3 = 0")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")).select(F.lit(name).alias("operation"), "n", "ids")
    return one(a.union(b).distinct(), "union").unionByName(one(a.join(b, "doc_id", "left_semi"), "intersection")).unionByName(one(a.join(b, "doc_id", "left_anti"), "difference"))


def q_semi(s, d):
    """Facts whose passage is of a document in French, by semi-join."""
    p = tables.passages(s, d).filter("language = 'fr'").select("passage_id")
    return tables.facts(s, d).join(p, "passage_id", "left_semi").groupBy("relation").agg(F.count(F.lit(1)).alias("n"))


def q_listing(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset(100).limit(50).select("o_orderkey")


def q_confidence(s, d):
    f = tables.facts(s, d).groupBy("doc_id").agg(F.countDistinct("passage_id").alias("p"), F.count(F.lit(1)).alias("f"))
    return f.select("doc_id", F.round(context.confidence(F.col("p"), F.col("f")), 6).cast("double").alias("confidence"))


def q_teleport(s, d):
    return ppr.seeds_in_graph(compiled(s, d), seeds(s, d)).filter("teleport > 0").select("node_id", F.round("teleport", 9).alias("teleport"))


def q_markers(s, d):
    f = tables.facts(s, d)
    return graph.canonical_nodes(nodes(s, d), tables.schemas(f)).groupBy("layer", "marker").agg(F.count(F.lit(1)).alias("n"))


def q_dictionary_upsert(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("term_id"), F.col("p_name").alias("canonical"), F.lit(1).alias("frequency"))
    new = p.filter("cast(term_id as int) % 10 = 0").withColumn("frequency", F.lit(2)).unionByName(s.createDataFrame([("new", "New", 5)], "term_id string, canonical string, frequency int"))
    return store.upsert(p, new, ["term_id"])


def q_papers(s, d):
    """Papers from a table in place of a remote search: the documents that contain a term, newest first, at most ten."""
    t = table(s, d, "documents").filter(F.lower("text").contains("license")).select(F.col("doc_id").alias("paper_id"), F.col("source").alias("domain"))
    return t.orderBy(F.col("paper_id").desc()).limit(10)


def q_bridges(s, d):
    """All three kinds of bridges as edges."""
    from strandloom.plans.graph_queries import relations

    sc = tables.schemas(tables.facts(s, d))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    v = tables.vectors(s, d).select("id", "embedding")
    rows = kind(graph.type_bridges(sc), "type").unionByName(kind(graph.similarity_bridges(v, 0.2), "similarity")).unionByName(kind(graph.isa_bridges(sc, relations(s, d)), "is_a"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("first"))


def q_sql_views(s, d):
    """Spark SQL over node and edge views, in place of a graph query language."""
    nodes(s, d).createOrReplaceTempView("strandloom_nodes")
    edges(s, d).createOrReplaceTempView("strandloom_edges")
    return s.sql("SELECT n.layer AS source_layer, e.relation, m.layer AS target_layer, count(*) AS n FROM strandloom_edges e JOIN strandloom_nodes n ON n.node_id = e.src JOIN strandloom_nodes m ON m.node_id = e.dst GROUP BY ALL")


def q_surfaces(s, d):
    """DICT-1 over whole tables of entries: every nation and region name in the conversations' and orders' texts."""
    e = table(s, d, "nation").select(F.col("n_name").alias("term"), F.lower("n_name").alias("canonical"), F.array(F.concat(F.lit("the "), "n_name")).alias("aliases"), F.lit(3).alias("frequency"), F.lit(0.8).alias("confidence"))
    t = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("made in "), "n_name", F.lit(", then x"), "n_name", F.lit("y.")).alias("text"))
    return lexicon.match_phrases(t, e).select("doc_id", "term", "matched", F.round("boost", 6).alias("boost"))


QUERIES = {
    "flt1_flt3_tenant_layer": (q_tenant, "SELECT doc_id FROM documents WHERE source = 'src3' AND lang = 'en'"),
    "flt3_states": (q_states, f"{with_ctes('facts')} SELECT relation, 'active' AS state, count(*) AS n FROM facts WHERE doc_id % 4 <> 0 AND relation IN ('placed', 'in_nation') GROUP BY 1"),
    "set2_set3_sets": (q_sets, "SELECT 'union' AS operation, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 UNION ALL SELECT 'intersection', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 6 = 0 UNION ALL SELECT 'difference', count(*), sum(doc_id)::BIGINT FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0"),
    "jn3_semi_joins": (q_semi, f"{with_ctes('facts', 'passages')} SELECT relation, count(*) AS n FROM facts WHERE passage_id IN (SELECT passage_id FROM passages WHERE language = 'fr') GROUP BY 1"),
    "top12_listing": (q_listing, "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100"),
    "win3_confidence": (q_confidence, f"{with_ctes('facts')} SELECT doc_id, round(least(1.0, count(DISTINCT passage_id) * 0.3 + count(*) * 0.1), 6)::DOUBLE AS confidence FROM facts GROUP BY 1"),
    "jn11_teleport": (q_teleport, f"{with_ctes('transitions')}, {SEEDS}, {STEPS} SELECT node_id, round(t, 9) AS teleport FROM base WHERE t > 0"),
    "gr2_markers": (q_markers, f"{with_ctes('nodes', 'schemas')} SELECT layer, CASE WHEN layer = 'schema' THEN (SELECT min(state) FROM schemas) END AS marker, count(*) AS n FROM nodes GROUP BY 1"),
    "gr3_bridges": (q_bridges, None),
    "dict2_upsert": (q_dictionary_upsert, "SELECT p_partkey::VARCHAR AS term_id, p_name AS canonical, CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END AS frequency FROM part UNION ALL SELECT 'new', 'New', 5"),
    "dict1_jn12_surfaces": (q_surfaces, "SELECT n_nationkey::BIGINT AS doc_id, n_name AS term, lower(n_name) AS matched, 2.1::DOUBLE AS boost FROM nation"),
    "src9_papers": (q_papers, "SELECT doc_id AS paper_id, source AS domain FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id DESC LIMIT 10"),
    "src10_sql_views": (q_sql_views, f"{with_ctes('nodes', 'edges')} SELECT n.layer AS source_layer, e.relation, m.layer AS target_layer, count(*) AS n FROM edges e JOIN nodes n ON n.node_id = e.src JOIN nodes m ON m.node_id = e.dst GROUP BY ALL"),
}
