"""The driver's parquet tables mapped to the memory model: passages, schemas, facts, evidence, vectors.

Each function has its DuckDB counterpart in CTES, built independently, so that every query's oracle starts from the raw tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import ids

CORPUS = "corpus"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.lit(CORPUS).alias("corpus_id"), "doc_id", F.concat(F.lit("passage:"), F.col("doc_id").cast("string"), F.lit(":0")).alias("passage_id"),
        "text", F.col("source").alias("source_url"), F.col("lang").alias("language"),
    )


def raw_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of the star schema with the document that evidences each."""
    t = lambda n: table(spark, sf_dir, n)
    n_docs = t("documents").agg(F.count(F.lit(1)).alias("n_docs"))
    cols = ["head_entity", "head_type", "relation", "tail_entity", "tail_type", "confidence", "temporal_scope", "k"]

    def triple(df, head, head_type, relation, tail, tail_type, confidence, k, scope=None):
        return df.select(head.alias("head_entity"), F.lit(head_type).alias("head_type"), F.lit(relation).alias("relation"), tail.alias("tail_entity"), F.lit(tail_type).alias("tail_type"), F.lit(confidence).alias("confidence"), (scope if scope is not None else F.lit(None).cast("string")).alias("temporal_scope"), k.cast("long").alias("k"))

    c, s, n, r, o = t("customer"), t("supplier"), t("nation"), t("region"), t("orders")
    order = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    rows = triple(c.join(n, c.c_nationkey == n.n_nationkey), F.col("c_name"), "Customer", "in_nation", F.col("n_name"), "Nation", 0.9, F.col("c_custkey"))
    rows = rows.unionByName(triple(s.join(n, s.s_nationkey == n.n_nationkey), F.col("s_name"), "Supplier", "in_nation", F.col("n_name"), "Nation", 0.9, F.col("s_suppkey")))
    rows = rows.unionByName(triple(n.join(r, n.n_regionkey == r.r_regionkey), F.col("n_name"), "Nation", "in_region", F.col("r_name"), "Region", 0.95, F.col("n_nationkey")))
    rows = rows.unionByName(triple(o.join(c, o.o_custkey == c.c_custkey), F.col("c_name"), "Customer", "placed", order, "Order", 0.8, F.col("o_orderkey"), F.year("o_orderdate").cast("string")))
    rows = rows.unionByName(triple(o, order, "Order", "has_status", F.col("o_orderstatus"), "Status", 0.7, F.col("o_orderkey")))
    return rows.select(*cols).join(F.broadcast(n_docs)).withColumn("doc_id", F.col("k") % F.col("n_docs")).drop("n_docs", "k")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fact_id (highest confidence), with schema_id and its document."""
    f = raw_facts(spark, sf_dir).withColumn("schema_id", ids.schema_id("head_type", "relation", "tail_type"))
    f = f.withColumn("fact_id", ids.fact_id("doc_id", "schema_id", "head_entity", "relation", "tail_entity"))
    keys = ["fact_id", "schema_id", "head_entity", "head_type", "relation", "tail_entity", "tail_type", "doc_id"]
    f = f.groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.min("temporal_scope").alias("temporal_scope"))
    return f.withColumn("passage_id", F.concat(F.lit("passage:"), F.col("doc_id").cast("string"), F.lit(":0"))).withColumn("state", F.lit("active")).withColumn("corpus_id", F.lit(CORPUS))


def schemas(facts: DataFrame, threshold: int = 2) -> DataFrame:
    """Schemas with the number of documents that contribute each; stable from ``threshold`` on."""
    g = facts.groupBy("schema_id", F.lower("head_type").alias("head_type"), "relation", F.lower("tail_type").alias("tail_type")).agg(F.countDistinct("doc_id").alias("frequency"))
    return g.withColumn("state", F.when(F.col("frequency") >= threshold, "stable").otherwise("pending"))


def conflict_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, has_returnflag, flag) per line item, with the year shipped as temporal scope and the line as parent."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws(":", F.lit("cf"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact_id"),
        F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("head_entity"), F.lit("has_returnflag").alias("relation"), F.col("l_returnflag").alias("tail_entity"),
        F.year("l_shipdate").cast("string").alias("temporal_scope"), F.col("l_linestatus").alias("parent"), F.lit("active").alias("state"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    namespaces = F.element_at(F.array(*map(F.lit, ("passage", "fact", "schema", "entity"))), F.pmod(F.col("vec_id"), F.lit(4)).cast("int") + 1)
    return e.select(F.col("vec_id").alias("id"), namespaces.alias("namespace"), "embedding", "label")


CTES = {
    "passages": "SELECT 'corpus' AS corpus_id, doc_id, 'passage:' || doc_id || ':0' AS passage_id, text, source AS source_url, lang AS language FROM documents",
    "raw_facts": """SELECT *, k % (SELECT count(*) FROM documents) AS doc_id FROM (
        SELECT c_name AS head_entity, 'Customer' AS head_type, 'in_nation' AS relation, n_name AS tail_entity, 'Nation' AS tail_type, 0.9::DOUBLE AS confidence, NULL::VARCHAR AS temporal_scope, c_custkey::BIGINT AS k FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT s_name, 'Supplier', 'in_nation', n_name, 'Nation', 0.9, NULL, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'Nation', 'in_region', r_name, 'Region', 0.95, NULL, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL SELECT c_name, 'Customer', 'placed', 'order_' || o_orderkey, 'Order', 0.8, year(o_orderdate)::VARCHAR, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT 'order_' || o_orderkey, 'Order', 'has_status', o_orderstatus, 'Status', 0.7, NULL, o_orderkey FROM orders)""",
    "facts": """SELECT *, 'passage:' || doc_id || ':0' AS passage_id, 'active' AS state, 'corpus' AS corpus_id FROM (
        SELECT regexp_replace('fact:' || doc_id || ':' || schema_id || ':' || head_entity || ':' || relation || ':' || tail_entity, '\\s+', '_', 'g') AS fact_id, schema_id,
          head_entity, head_type, relation, tail_entity, tail_type, doc_id, max(confidence) AS confidence, min(temporal_scope) AS temporal_scope
        FROM (SELECT *, 'schema:' || lower(head_type) || '::' || lower(relation) || '::' || lower(tail_type) AS schema_id FROM raw_facts) GROUP BY ALL)""",
    "schemas": """SELECT *, CASE WHEN frequency >= 2 THEN 'stable' ELSE 'pending' END AS state FROM (
        SELECT schema_id, lower(head_type) AS head_type, relation, lower(tail_type) AS tail_type, count(DISTINCT doc_id) AS frequency FROM facts GROUP BY ALL)""",
    "conflict_facts": """SELECT 'cf:' || l_orderkey || ':' || l_linenumber AS fact_id, 'Order ' || l_orderkey AS head_entity, 'has_returnflag' AS relation, l_returnflag AS tail_entity,
        year(l_shipdate)::VARCHAR AS temporal_scope, l_linestatus AS parent, 'active' AS state FROM lineitem""",
    "vectors": "SELECT vec_id AS id, ['passage', 'fact', 'schema', 'entity'][vec_id % 4 + 1] AS namespace, embedding, label FROM embeddings",
    "nodes": """SELECT DISTINCT 'schema:' || schema_id AS node_id, 'schema' AS layer, head_type || ' ' || relation || ' ' || tail_type AS label FROM schemas
        UNION ALL SELECT 'fact:' || fact_id, 'fact', head_entity || ' ' || relation || ' ' || tail_entity FROM facts
        UNION ALL SELECT DISTINCT 'passage:' || passage_id, 'passage', passage_id FROM passages
        UNION ALL SELECT 'entity:' || k, 'entity', min(name) FROM (SELECT regexp_replace(lower(n), '\\s+', '_', 'g') AS k, n AS name FROM (SELECT head_entity AS n FROM facts UNION ALL SELECT tail_entity FROM facts)) GROUP BY k""",
    "edges": """SELECT 'schema:' || schema_id AS src, 'fact:' || fact_id AS dst, 'schema_instance' AS relation, 1.0::DOUBLE AS weight FROM facts
        UNION ALL SELECT 'fact:' || fact_id, 'passage:' || passage_id, 'fact_evidence', 1.0 FROM facts
        UNION ALL SELECT DISTINCT 'entity:' || regexp_replace(lower(head_entity), '\\s+', '_', 'g') AS a, 'entity:' || regexp_replace(lower(tail_entity), '\\s+', '_', 'g') AS b, 'entity_cooccurrence', 1.0 FROM facts WHERE regexp_replace(lower(head_entity), '\\s+', '_', 'g') <> regexp_replace(lower(tail_entity), '\\s+', '_', 'g')
        UNION ALL SELECT DISTINCT 'entity:' || regexp_replace(lower(n), '\\s+', '_', 'g'), 'passage:' || passage_id, 'entity_mention', 1.0 FROM (SELECT head_entity AS n, passage_id FROM facts UNION ALL SELECT tail_entity, passage_id FROM facts)""",
    "transitions": "SELECT * FROM edges WHERE NOT starts_with(src, 'entity:') AND NOT starts_with(dst, 'entity:')",
}
NEEDS = {"facts": ["raw_facts"], "schemas": ["facts"], "nodes": ["schemas", "facts", "passages"], "edges": ["facts"], "transitions": ["edges"]}


def with_ctes(*names: str) -> str:
    """``WITH`` clause that defines the named tables and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
