"""Table storage: shared scratch space, upserts, snapshots, vectors, exports. Plain parquet, copy on write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which all executors share. Where that is unset, a local one in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/strandloom-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """The same rows, read back from the shared folder: iterations keep a short lineage and survive lost executors.

    Results are lazy and may read the table long after this returns, so it is deleted when the driver ends.
    """
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """SNK-1, SNK-2: rows of ``new`` replace rows of ``old`` with equal keys; columns in ``keep`` hold their old values."""
    rest = old.join(new.select(keys), keys, "left_anti").select(new.columns)
    if keep:
        held = old.select(*keys, *[F.col(c).alias(f"__old_{c}") for c in keep])
        new = new.join(held, keys, "left").select(*[F.coalesce(f"__old_{c}", c).alias(c) if c in keep else F.col(c) for c in new.columns])
    return new.unionByName(rest)


def latest_vectors(log: DataFrame) -> DataFrame:
    """SNK-3, SRC-7: the newest record of each (corpus_id, namespace, id) of an append-only log, without those deleted by it."""
    newest = log.groupBy("corpus_id", "namespace", "id").agg(F.max_by(F.struct("embedding", "deleted"), "version").alias("r"))
    return newest.select("corpus_id", "namespace", "id", "r.*").filter(~F.col("deleted")).drop("deleted")


def by_ids(df: DataFrame, key: str, wanted: list[str], longest: int = 4096) -> DataFrame:
    """SRC-4: rows by id in the order asked for; repeats, empty ids and ids over ``longest`` UTF-8 bytes drop out."""
    spark = df.sparkSession
    ask = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], f"pos int, {key} string").filter((F.col(key) != "") & (F.octet_length(key) <= longest))
    ask = ask.groupBy(key).agg(F.min("pos").alias("pos"))
    return df.join(F.broadcast(ask), key).orderBy("pos")


def facts_by_entities(facts: DataFrame, names: list[str], state: str = "active", limit: int = 1000) -> DataFrame:
    """SRC-5, JN-6: facts whose head or tail is one of the names, whatever the case; two equi semi-joins, no nested loop."""
    ask = F.broadcast(facts.sparkSession.createDataFrame([(n.lower(),) for n in names], "k string").distinct())
    f = facts if state == "any" else facts.filter(F.col("state") == state)
    side = lambda c: f.join(ask, F.lower(c) == F.col("k"), "left_semi")
    return side("head_entity").unionByName(side("tail_entity")).dropDuplicates(["fact_id"]).orderBy("fact_id").limit(limit)


def section_counts(schemas: DataFrame, facts: DataFrame, passages: DataFrame) -> DataFrame:
    """SRC-6"""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("section"), "n")
    return one(schemas, "schemas").unionByName(one(facts, "facts")).unionByName(one(passages, "passages"))


def snapshot(facts: DataFrame, passages: DataFrame) -> DataFrame:
    """SRC-3: passages with their nested fact ids, ordered."""
    f = facts.groupBy("passage_id").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"))
    return passages.join(f, "passage_id", "left").withColumn("fact_ids", F.coalesce("fact_ids", F.array().cast("array<string>")))


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def export_page(nodes: DataFrame, offset: int, limit: int, most: int = 100_000) -> DataFrame:
    """SNK-4: nodes by id from ``offset``, with the page's bounds; ``limit`` is clamped."""
    limit = max(0, min(limit, most))
    return nodes.orderBy("node_id").offset(max(0, offset)).limit(limit)


def page_state(nodes: DataFrame, offset: int, limit: int) -> DataFrame:
    """SNK-4: total, hasMore and nextOffset of a page."""
    n = F.count(F.lit(1))
    return nodes.agg(n.alias("total")).select("total", (F.col("total") > offset + limit).alias("has_more"), F.when(F.col("total") > offset + limit, offset + limit).alias("next_offset"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SNK-4: one GraphML element per row, escaped."""
    n = nodes.select(F.concat(F.lit('<node id="'), xml(F.col("node_id")), F.lit('"><data key="layer">'), xml(F.col("layer")), F.lit('</data><data key="label">'), xml(F.coalesce("label", F.lit(""))), F.lit("</data></node>")).alias("element"))
    e = edges.select(F.concat(F.lit('<edge source="'), xml(F.col("src")), F.lit('" target="'), xml(F.col("dst")), F.lit('"><data key="relation">'), xml(F.col("relation")), F.lit("</data></edge>")).alias("element"))
    return n.unionByName(e)


def to_json_rows(df: DataFrame) -> DataFrame:
    """SNK-5: one JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def from_json_rows(rows: DataFrame, schema: str) -> DataFrame:
    """SNK-5: rows from JSON objects; what cannot be read is left out."""
    return rows.select(F.from_json("json", schema).alias("r")).filter("r is not null").select("r.*")


def append_audit(rows: DataFrame, path: str) -> None:
    """SNK-6: append-only audit rows."""
    rows.write.mode("append").parquet(path)


def migrate(source: dict[str, DataFrame], path: str) -> DataFrame:
    """SNK-7: copies tables below ``path`` and reports counts on both sides."""
    report = None
    for name, df in source.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        copy = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")
        row = df.agg(F.count(F.lit(1)).alias("source_rows")).join(copy.agg(F.count(F.lit(1)).alias("target_rows"))).select(F.lit(name).alias("table"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("equal"))
        report = row if report is None else report.unionByName(row)
    return report


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC-1: every .md file below a path: id from the path, title from the name, text; ordered by path."""
    from strandloom.functions import ids

    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    plain = F.regexp_replace("path", "^file:", "")
    return f.select(ids.document_id(plain).alias("doc_id"), F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", "").alias("title"), F.decode("content", "UTF-8").alias("text"), plain.alias("path")).orderBy("path")


def inline_documents(spark: SparkSession, documents: list[dict]) -> DataFrame:
    """SRC-2: documents given in the call."""
    return spark.createDataFrame([(d["id"], d.get("title"), d.get("text"), d.get("source_url"), d.get("language")) for d in documents], "doc_id string, title string, text string, source_url string, language string")


def page_number(df: DataFrame, order: list, size: int) -> DataFrame:
    """SRC-8: rows of one version of a table with the page each belongs to."""
    return df.withColumn("page", F.floor((F.row_number().over(Window.orderBy(*order)) - 1) / size))
