"""Graph, propagation and export queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import graph, ppr, stats
from strandloom.sources import store, tables
from strandloom.sources.tables import table, with_ctes

EK = "regexp_replace(lower({}), '\\s+', '_', 'g')"


def nodes(s, d):
    f = tables.facts(s, d)
    return graph.project_nodes(f, tables.schemas(f), tables.passages(s, d))


def edges(s, d):
    return graph.project_edges(tables.facts(s, d))


def q_nodes(s, d):
    return nodes(s, d)


def q_edges(s, d):
    return edges(s, d)


def q_edge_ids(s, d):
    return graph.edge_ids(edges(s, d)).groupBy(F.substring_index("edge_id", ":", 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("edge_id").alias("last"))


def q_per_document(s, d):
    e = graph.project_edges(tables.facts(s, d), per_document=True)
    return e.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("weight"), F.countDistinct("src").alias("sources"))


def q_dangling(s, d):
    return graph.dangling(nodes(s, d), edges(s, d)).groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def q_adjacency(s, d):
    return graph.adjacency(edges(s, d), "entity:nation_2").select("src", "dst", "relation")


def q_edges_by_source(s, d):
    return edges(s, d).groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n >= 20")


def q_delete_nodes(s, d):
    n, e = nodes(s, d), edges(s, d)
    gone = n.filter("layer = 'entity' and node_id >= 'entity:s'")
    left_n, left_e = graph.delete_nodes(n, e, gone)
    count = lambda df, k: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("part"), "n")
    return count(left_n, "nodes").unionByName(count(left_e, "edges"))


def refs(s, d):
    """Nodes with a JSON reference that names their document, or a list of source documents."""
    f = tables.facts(s, d)
    own = tables.passages(s, d).select(F.concat(F.lit("passage:"), "passage_id").alias("node_id"), F.to_json(F.struct(F.struct(F.col("doc_id").cast("string").alias("documentId")).alias("metadata"))).alias("ref"))
    src = f.select(F.concat(F.lit("fact:"), "fact_id").alias("node_id"), F.to_json(F.struct(F.array(F.col("doc_id").cast("string")).alias("sourceDocumentIds"))).alias("ref"))
    return own.unionByName(src)


def q_json_predicate(s, d):
    return graph.delete_by_document(refs(s, d), "7").select("node_id")


def q_type_bridges(s, d):
    return graph.type_bridges(tables.schemas(tables.facts(s, d)))


def q_similarity_bridges(s, d):
    v = tables.vectors(s, d).select("id", "embedding")
    return graph.similarity_bridges(v, 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


def relations(s, d):
    """Hypernyms: nation to region, brand to manufacturer; synonyms: part names to types of parts."""
    n, r, p = table(s, d, "nation"), table(s, d, "region"), table(s, d, "part")
    cols = ["source", "target", "relation_type", "weight", "bidirectional"]
    a = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("hypernym").alias("relation_type"), F.lit(0.8).alias("weight"), F.lit(False).alias("bidirectional"))
    b = p.select(F.col("p_brand").alias("source"), F.lit("Brand").alias("target"), F.lit("hypernym").alias("relation_type"), F.lit(0.9).alias("weight"), F.lit(False).alias("bidirectional")).distinct()
    c = p.select(F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.lit("synonym").alias("relation_type"), F.round(F.col("p_size") / 50.0, 6).alias("weight"), F.lit(True).alias("bidirectional")).groupBy("source", "target", "relation_type", "bidirectional").agg(F.max("weight").alias("weight"))
    t = s.createDataFrame([("Customer", "Party", "hypernym", 1.0, False), ("Supplier", "Party", "hypernym", 1.0, False), ("Nation", "Customer", "hyponym", 0.5, False), ("Order", "Status", "related", 0.4, True)], "source string, target string, relation_type string, weight double, bidirectional boolean")
    rows = a.select(cols).unionByName(b.select(cols)).unionByName(c.select(cols)).unionByName(t)
    return rows.withColumn("relation_id", F.concat_ws(":", F.lit("rel"), F.lit("corpus"), F.lower("source"), F.lower("target"), "relation_type")).withColumn("corpus_id", F.lit("corpus"))


RELATIONS = """relations AS MATERIALIZED (SELECT *, 'rel:corpus:' || lower(source) || ':' || lower(target) || ':' || relation_type AS relation_id FROM (
SELECT n_name AS source, r_name AS target, 'hypernym' AS relation_type, 0.8::DOUBLE AS weight, false AS bidirectional FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT DISTINCT p_brand, 'Brand', 'hypernym', 0.9, false FROM part
UNION ALL SELECT p_name, p_type, 'synonym', max(round(p_size / 50.0, 6)), true FROM part GROUP BY ALL
UNION ALL VALUES ('Customer', 'Party', 'hypernym', 1.0, false), ('Supplier', 'Party', 'hypernym', 1.0, false), ('Nation', 'Customer', 'hyponym', 0.5, false), ('Order', 'Status', 'related', 0.4, true)))"""


def q_isa(s, d):
    return graph.isa_bridges(tables.schemas(tables.facts(s, d)), relations(s, d))


def q_components(s, d):
    c = graph.connected_components(nodes(s, d), graph.transitions(edges(s, d)))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def q_hops(s, d):
    e = graph.transitions(edges(s, d)).withColumn("weight", F.when(F.col("relation") == "fact_evidence", 0.9).otherwise(0.8))
    seeds = s.createDataFrame([("passage:passage:3:0",)], "node_id string")
    return graph.multi_hop(e, seeds, hops=2, limit=100_000).select("node_id", "hop", F.round("path_weight", 6).alias("path_weight"))


def q_merge_articles(s, d):
    n, e = nodes(s, d), edges(s, d)
    the = s.createDataFrame([("entity:the_nation_2", "entity", "The NATION_2"), ("entity:the_peru", "entity", "The Peru")], "node_id string, layer string, label string")
    more = s.createDataFrame([("entity:the_nation_2", "entity:nation_2", "entity_cooccurrence", 1.0), ("entity:the_nation_2", "entity:europe", "entity_cooccurrence", 1.0), ("entity:the_peru", "entity:america", "entity_cooccurrence", 1.0)], "src string, dst string, relation string, weight double")
    left_n, left_e = graph.merge_articles(n.unionByName(the), e.unionByName(more))
    a = left_n.filter("node_id like 'entity:the%'").select(F.lit("node").alias("part"), "node_id", F.lit("").alias("dst"))
    b = left_e.filter("src like 'entity:the%' or (src = 'entity:nation_2' and dst like 'entity:%')").select(F.lit("edge").alias("part"), F.col("src").alias("node_id"), "dst")
    return a.unionByName(b)


# --- propagation -----------------------------------------------------------------------------------------------------


def seeds(s, d):
    return tables.facts(s, d).filter("relation = 'in_nation'").select(F.concat(F.lit("fact:"), "fact_id").alias("node_id"), F.col("confidence").alias("score")).unionByName(s.createDataFrame([("fact:gone", 3.0), ("schema:schema:customer::in_nation::nation", 0.5)], "node_id string, score double"))


def q_compile(s, d):
    return ppr.compile_transitions(graph.transitions(edges(s, d)), 50).groupBy(F.substring_index("src", ":", 1).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("p"))


def compiled(s, d):
    return ppr.compile_transitions(graph.transitions(edges(s, d)), 50)


def q_fixed(s, d):
    return ppr.fixed_iterations(compiled(s, d), seeds(s, d), 4).select("node_id", F.round("score", 9).alias("score"))


def q_converged(s, d):
    score, _ = ppr.run(compiled(s, d), seeds(s, d))
    return score.select("node_id", F.round("score", 9).alias("score"))


def q_cyclic(s, d):
    """Entities and passages, edges both ways: a graph with cycles, run until it is at rest; the number of nodes and their mass per layer."""
    e = edges(s, d).filter("relation in ('entity_cooccurrence', 'entity_mention')")
    both = e.select("src", "dst", "weight").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    score, _ = ppr.run(ppr.compile_transitions(both), s.createDataFrame([("entity:nation_2", 1.0)], "node_id string, score double"))
    return score.groupBy(F.substring_index("node_id", ":", 1).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("mass"))


SEEDS = "seeds AS (SELECT 'fact:' || fact_id AS node_id, confidence AS score FROM facts WHERE relation = 'in_nation' UNION ALL VALUES ('fact:gone', 3.0), ('schema:schema:customer::in_nation::nation', 0.5))"
STEPS = """deg AS (SELECT n, count(*) AS d FROM (SELECT src AS n FROM transitions UNION ALL SELECT dst FROM transitions) GROUP BY n),
steps AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) * CASE WHEN starts_with(dst, 'schema:') AND d > 50 THEN 1 / log2(d + 2) ELSE 1 END AS p FROM transitions JOIN deg ON n = dst),
base AS MATERIALIZED (SELECT node_id, CASE WHEN sum(s) OVER () > 0 THEN s / sum(s) OVER () ELSE 1.0 / count(*) OVER () END AS t FROM (SELECT n AS node_id, coalesce(sum(score), 0) AS s FROM deg LEFT JOIN seeds ON node_id = n GROUP BY n))"""


def ppr_sql(iterations: int, alpha: float = 0.5) -> str:
    out = f"{with_ctes('transitions')}, {SEEDS}, {STEPS}, s0 AS (SELECT node_id, t AS score FROM base)"
    for i in range(1, iterations + 1):
        out += f", s{i} AS MATERIALIZED (SELECT node_id, {1 - alpha} * coalesce(f, 0) + {alpha} * t AS score FROM base LEFT JOIN (SELECT dst, sum(p * score) AS f FROM steps JOIN s{i - 1} ON node_id = src GROUP BY dst) ON dst = node_id)"
    return out + f" SELECT node_id, round(score, 9) AS score FROM s{iterations}"


def q_seed_vector(s, d):
    f = seeds(s, d)
    exp = f.select("node_id", F.lit(9.0).alias("score")).limit(0).unionByName(s.createDataFrame([("fact:gone", 9.0), ("fact:new", 0.2)], "node_id string, score double"))
    p = tables.passages(s, d).filter("doc_id < 10").select(F.concat(F.lit("passage:"), "passage_id").alias("node_id"), F.lit(0.5).alias("score"))
    c = s.createDataFrame([("schema:schema:customer::in_nation::nation", 0.7)], "node_id string, score double")
    v = ppr.seed_vector(f, exp, p, c)
    return v.groupBy(F.substring_index("node_id", ":", 1).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


def seed_facts(s, d):
    return tables.facts(s, d).filter("relation = 'in_region' and tail_entity = 'ASIA'").select("fact_id", F.round(F.length("head_entity") / 10.0, 6).alias("score"))


def q_expand(s, d):
    return ppr.expand_facts(seed_facts(s, d), tables.facts(s, d)).select("fact_id", F.round("score", 6).alias("score"))


def q_check_expansion(s, d):
    f = tables.facts(s, d)
    return stats.check_expansion(ppr.expand_facts(seed_facts(s, d), f), seed_facts(s, d), f).agg(F.count(F.lit(1)).alias("broken"))


def vec(s, d, mod):
    return tables.vectors(s, d).filter(F.col("id") % mod == 0).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), (F.col("id") % 10 + 1.0).alias("score"))


def q_blend(s, d):
    return ppr.blend(vec(s, d, 2), vec(s, d, 3), vec(s, d, 5)).select("node_id", F.round("score", 9).alias("score"))


def q_inject(s, d):
    base = seed_facts(s, d).select(F.concat(F.lit("fact:"), "fact_id").alias("node_id"), "score")
    ents = s.createDataFrame([("nation_1",), ("NATION_2",), ("europe",), ("Peru",)], "entity string")
    return ppr.inject_dictionary_facts(base, ents, tables.facts(s, d)).select("node_id", F.round("score", 9).alias("score"))


def q_paper_seeds(s, d):
    f = tables.facts(s, d)
    fs = f.select("fact_id", F.col("confidence").alias("score"))
    ss = tables.schemas(f).select(F.concat(F.lit("schema:"), "schema_id").alias("node_id"), (F.col("frequency") / 1000.0).alias("score"))
    ps = tables.passages(s, d).select("passage_id", F.lit(0.5).alias("score"))
    v = ppr.paper_seeds(fs, ss, ps, graph.mentions(f), graph.transitions(edges(s, d)))
    return v.groupBy(F.substring_index("node_id", ":", 1).alias("layer")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("score"))


# --- exports ---------------------------------------------------------------------------------------------------------


def q_export(s, d):
    return store.export_page(nodes(s, d), 1000, 500)


def q_page(s, d):
    return store.page_state(nodes(s, d), 1000, 500)


def q_pages(s, d):
    p = store.page_number(tables.schemas(tables.facts(s, d)).select("schema_id"), ["schema_id"], 2)
    return p.select("schema_id", F.col("page").cast("long").alias("page"))


def q_graphml(s, d):
    odd = s.createDataFrame([("entity:<&\">'", "entity", None)], "node_id string, layer string, label string")
    return store.graphml(nodes(s, d).unionByName(odd), edges(s, d).filter("relation = 'schema_instance'"))


def q_json(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    rows = store.to_json_rows(n).unionByName(s.createDataFrame([("broken",)], "json string"))
    return store.from_json_rows(rows, "n_nationkey int, n_name string").filter("n_name is not null")


QUERIES = {
    "gr1_nodes": (q_nodes, f"{with_ctes('nodes')} SELECT * FROM nodes"),
    "gr1_edges": (q_edges, f"{with_ctes('edges')} SELECT * FROM edges"),
    "gr1_edge_ids": (q_edge_ids, f"{with_ctes('edges')} SELECT replace(relation, '_', '-') AS kind, count(*) AS n, max(replace(relation, '_', '-') || ':' || src || ':' || dst) AS last FROM edges GROUP BY 1"),
    "gr14_document_scoped": (q_per_document, f"""{with_ctes('facts')}, f AS (SELECT *, 'entity:' || doc_id || ':' || {EK.format('head_entity')} AS h, 'entity:' || doc_id || ':' || {EK.format('tail_entity')} AS t FROM facts), e AS (SELECT 'schema_instance' AS relation, schema_id AS src, fact_id AS dst, 1.0::DOUBLE AS weight FROM f UNION ALL SELECT 'fact-evidence', fact_id, passage_id, confidence FROM f UNION ALL SELECT DISTINCT 'entity_cooccurrence', h, t, 1.0 FROM f WHERE h <> t UNION ALL SELECT DISTINCT 'entity_mention', e, passage_id, 1.0 FROM (SELECT h AS e, passage_id FROM f UNION ALL SELECT t, passage_id FROM f)) SELECT relation, count(*) AS n, round(sum(weight), 6) AS weight, count(DISTINCT src) AS sources FROM e GROUP BY 1"""),
    "agg8_entity_rollup": (lambda s, d: graph.entity_rollup(tables.facts(s, d)), f"""{with_ctes('facts')} SELECT {EK.format('n')} AS entity_key, min(n) AS name, count(*) AS n_facts, count(DISTINCT passage_id) AS n_passages FROM (SELECT head_entity AS n, passage_id FROM facts UNION ALL SELECT tail_entity, passage_id FROM facts) GROUP BY 1"""),
    "gr5_flt4_transitions": (lambda s, d: graph.transitions(edges(s, d)), f"{with_ctes('transitions')} SELECT * FROM transitions"),
    "gr5_dangling": (q_dangling, f"{with_ctes('nodes', 'edges')} SELECT layer, count(*) AS n FROM nodes WHERE node_id NOT IN (SELECT src FROM edges) GROUP BY 1"),
    "gr6_adjacency": (q_adjacency, f"{with_ctes('edges')} SELECT src, dst, relation FROM edges WHERE src = 'entity:nation_2' OR dst = 'entity:nation_2'"),
    "gr6_edges_by_source": (q_edges_by_source, f"{with_ctes('edges')} SELECT src, count(*) AS n FROM edges GROUP BY 1 HAVING n >= 20"),
    "gr6_flt7_delete_nodes": (q_delete_nodes, f"{with_ctes('nodes', 'edges')}, g AS (SELECT node_id FROM nodes WHERE layer = 'entity' AND node_id >= 'entity:s') SELECT 'nodes' AS part, count(*) AS n FROM nodes WHERE node_id NOT IN (FROM g) UNION ALL SELECT 'edges', count(*) FROM edges WHERE src NOT IN (FROM g) AND dst NOT IN (FROM g)"),
    "flt5_json_predicate": (q_json_predicate, f"{with_ctes('facts', 'passages')} SELECT 'passage:' || passage_id AS node_id FROM passages WHERE doc_id = 7 UNION ALL SELECT 'fact:' || fact_id FROM facts WHERE doc_id = 7"),
    "jn8_type_bridges": (q_type_bridges, f"{with_ctes('schemas')} SELECT a.schema_id AS a, b.schema_id AS b FROM schemas a, schemas b WHERE a.schema_id < b.schema_id AND (a.head_type IN (b.head_type, b.tail_type) OR a.tail_type IN (b.head_type, b.tail_type))"),
    "jn9_similarity_bridges": (q_similarity_bridges, "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings ORDER BY 1 LIMIT 50) SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a, v b WHERE a.id < b.id AND list_cosine_similarity(a.e, b.e) >= 0.1"),
    "jn10_isa_bridges": (q_isa, f"{with_ctes('schemas')}, {RELATIONS} SELECT DISTINCT a.schema_id AS a, b.schema_id AS b FROM schemas a, schemas b, relations r WHERE r.relation_type IN ('hypernym', 'hyponym') AND a.schema_id < b.schema_id AND ((lower(source) = a.head_type AND lower(target) = b.head_type) OR (lower(target) = a.head_type AND lower(source) = b.head_type))"),
    "agg2_components": (q_components, f"""{with_ctes('nodes', 'transitions')}, f AS (SELECT fact_id, schema_id, passage_id FROM facts), c AS (SELECT 'schema:' || schema_id AS n FROM schemas) , u AS (SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM transitions UNION SELECT dst FROM transitions)), j AS (SELECT node_id FROM nodes WHERE node_id IN (SELECT src FROM transitions UNION SELECT dst FROM transitions)) SELECT node_id AS component, 1::BIGINT AS n FROM u UNION ALL SELECT min(node_id), count(*) FROM j"""),
    "gr9_multi_hop": (q_hops, f"""{with_ctes('transitions')}, e AS (SELECT src, dst, CASE WHEN relation = 'fact_evidence' THEN 0.9 ELSE 0.8 END AS w FROM transitions), b AS (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e), h1 AS (SELECT dst AS node_id, max(w) AS path_weight FROM b WHERE src = 'passage:passage:3:0' GROUP BY 1), h2 AS (SELECT dst AS node_id, max(path_weight * w) AS path_weight FROM h1 JOIN b ON src = node_id WHERE dst <> 'passage:passage:3:0' AND dst NOT IN (SELECT node_id FROM h1) GROUP BY 1) SELECT node_id, 1 AS hop, round(path_weight, 6)::DOUBLE AS path_weight FROM h1 UNION ALL SELECT node_id, 2, round(path_weight, 6)::DOUBLE FROM h2"""),
    "gr10_merge_articles": (q_merge_articles, f"""{with_ctes('edges')} SELECT 'edge' AS part, 'entity:nation_2' AS node_id, 'entity:europe' AS dst WHERE NOT EXISTS (SELECT 1 FROM edges WHERE src = 'entity:nation_2' AND dst = 'entity:europe') UNION ALL SELECT 'node' AS part, 'entity:the_peru' AS node_id, '' AS dst UNION ALL SELECT 'edge', 'entity:the_peru', 'entity:america' UNION ALL SELECT DISTINCT 'edge', src, dst FROM edges WHERE src = 'entity:nation_2' AND starts_with(dst, 'entity:')"""),
    "gr7_compile": (q_compile, f"{with_ctes('transitions')}, {SEEDS}, {STEPS} SELECT split_part(src, ':', 1) AS layer, count(*) AS n, round(sum(p), 6) AS p FROM steps GROUP BY 1"),
    "gr8_ppr_fixed": (q_fixed, ppr_sql(4)),
    "gr8_ppr": (q_converged, ppr_sql(5)),
    "gr8_ppr_cyclic": (q_cyclic, None),
    "gr11_seed_vector": (q_seed_vector, f"""{with_ctes('facts', 'passages')}, {SEEDS} SELECT layer, count(*) AS n, round(sum(score), 6)::DOUBLE AS score FROM (SELECT 'fact' AS layer, score FROM seeds WHERE node_id LIKE 'fact:%' UNION ALL SELECT 'fact', 0.2 UNION ALL SELECT 'passage', 0.5 FROM passages WHERE doc_id < 10 UNION ALL SELECT 'schema', 0.7) GROUP BY 1"""),
    "gr12_top10_expand": (q_expand, f"""{with_ctes('facts')}, sd AS (SELECT fact_id, head_entity, tail_entity, round(length(head_entity) / 10.0, 6) AS s FROM facts WHERE relation = 'in_region' AND tail_entity = 'ASIA'), k AS (SELECT k, max(s) AS s FROM (SELECT lower(head_entity) AS k, s FROM sd UNION ALL SELECT lower(tail_entity), s FROM sd) GROUP BY k), e AS (SELECT fact_id, round(max(s) * 0.3, 9) AS score FROM facts JOIN k ON k = lower(head_entity) OR k = lower(tail_entity) WHERE fact_id NOT IN (SELECT fact_id FROM sd) GROUP BY 1 ORDER BY score DESC, fact_id LIMIT 20) SELECT fact_id, round(score, 6)::DOUBLE AS score FROM e"""),
    "check_expansion": (q_check_expansion, "SELECT 0::BIGINT AS broken"),
    "gr13_blend": (q_blend, """WITH v AS (SELECT vec_id AS i FROM embeddings), r AS (SELECT i, (i % 10 + 1.0) * (CASE WHEN i % 2 = 0 THEN 0.4 ELSE 0 END + CASE WHEN i % 3 = 0 THEN 0.3 ELSE 0 END + CASE WHEN i % 5 = 0 THEN 0.3 ELSE 0 END)::DOUBLE AS s FROM v WHERE i % 2 = 0 OR i % 3 = 0 OR i % 5 = 0) SELECT 'n' || i AS node_id, round(s / sum(s) OVER (), 9) AS score FROM r"""),
    "top11_injection": (q_inject, f"""{with_ctes('facts')}, b AS (SELECT 'fact:' || fact_id AS node_id, round(length(head_entity) / 10.0, 6)::DOUBLE AS score FROM facts WHERE relation = 'in_region' AND tail_entity = 'ASIA'), e AS (SELECT unnest(['nation_1', 'nation_2', 'europe', 'peru']) AS k), o AS (SELECT fact_id, first(k ORDER BY side, k) AS k FROM (SELECT fact_id, k, 0 AS side FROM facts JOIN e ON lower(head_entity) = k UNION ALL SELECT fact_id, k, 1 FROM facts JOIN e ON lower(tail_entity) = k) GROUP BY 1), c AS (SELECT 'fact:' || fact_id AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY fact_id) AS rn FROM o) WHERE rn <= 3 ORDER BY fact_id LIMIT 10), a AS (SELECT * FROM b UNION ALL SELECT node_id, 0.1 * (SELECT max(score) FROM b) FROM c WHERE node_id NOT IN (SELECT node_id FROM b)) SELECT node_id, round(score / sum(abs(score)) OVER (), 9) AS score FROM a"""),
    "gr15_paper_seeds": (q_paper_seeds, f"""{with_ctes('schemas', 'transitions', 'passages')}, m AS (SELECT fact_id, passage_id, {EK.format('n')} AS k, confidence FROM (SELECT fact_id, passage_id, head_entity AS n, confidence FROM facts UNION ALL SELECT fact_id, passage_id, tail_entity, confidence FROM facts)), e AS (SELECT avg(confidence) AS s FROM m GROUP BY k), dg AS (SELECT n, count(*) AS d FROM (SELECT src AS n FROM transitions UNION ALL SELECT dst FROM transitions) GROUP BY n), sc AS (SELECT frequency / 1000.0 / ln(d + 1.0) AS s FROM schemas JOIN dg ON n = 'schema:' || schema_id), pr AS (SELECT DISTINCT passage_id, k FROM m), idf AS (SELECT k, ln((SELECT count(DISTINCT passage_id) FROM pr) / count(*)) AS i FROM pr GROUP BY k), pw AS (SELECT passage_id, sum(i) / ln(count(*) + 1.0) AS x FROM pr JOIN idf USING (k) GROUP BY 1), ps AS (SELECT 0.5 * 0.05 / (1 + exp(-x)) AS s FROM pw JOIN passages USING (passage_id)), u AS (SELECT 'entity' AS layer, s FROM e UNION ALL SELECT 'schema', s FROM sc UNION ALL SELECT 'passage', s FROM ps) SELECT layer, count(*) AS n, round(sum(s) / (SELECT sum(s) FROM u), 6) AS score FROM u GROUP BY 1"""),
    "snk4_export_page": (q_export, f"{with_ctes('nodes')} SELECT * FROM nodes ORDER BY node_id LIMIT 500 OFFSET 1000"),
    "snk4_page_state": (q_page, f"{with_ctes('nodes')} SELECT count(*) AS total, count(*) > 1500 AS has_more, CASE WHEN count(*) > 1500 THEN 1500 END AS next_offset FROM nodes"),
    "src8_pages": (q_pages, f"{with_ctes('schemas')} SELECT schema_id, (row_number() OVER (ORDER BY schema_id) - 1) // 2 AS page FROM schemas"),
    "snk4_graphml": (q_graphml, f"""{with_ctes('nodes', 'edges')}, n AS (SELECT * FROM nodes UNION ALL VALUES ('entity:<&">''', 'entity', NULL)) SELECT '<node id="' || x(node_id) || '"><data key="layer">' || x(layer) || '</data><data key="label">' || x(coalesce(label, '')) || '</data></node>' AS element FROM n UNION ALL SELECT '<edge source="' || x(src) || '" target="' || x(dst) || '"><data key="relation">' || x(relation) || '</data></edge>' FROM edges WHERE relation = 'schema_instance'"""),
    "snk5_json_round_trip": (q_json, "SELECT n_nationkey, n_name FROM nation"),
}
_x = QUERIES["snk4_graphml"][1]
for col in ("node_id", "layer", "coalesce(label, '')", "src", "dst", "relation"):
    _x = _x.replace(f"x({col})", f"replace(replace(replace(replace(replace({col}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')")
QUERIES["snk4_graphml"] = (q_graphml, _x)
