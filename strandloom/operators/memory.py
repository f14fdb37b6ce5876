"""Schema and fact memory: stabilization, folds, conflicts, deletes, integrity (AGG-6, AGG-7, IDX-1 to IDX-6, JN-2, JN-7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import ids

STABLE_FROM = 2
ACTIVE_WINDOW = 100


def group_schemas(candidates: DataFrame) -> DataFrame:
    """AGG-6: candidates with one schema_id as one: summed frequency, aliases in order of first sight, document ids, and
    ``consistent`` = false where one id stands for different meanings."""
    meaning = F.countDistinct(F.struct("head_type", "relation", "tail_type"))
    aliases = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("alias").alias("label")))), lambda x: x.label))
    return candidates.groupBy("schema_id").agg(F.sum("frequency").alias("frequency"), aliases.alias("aliases"), F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), (meaning == 1).alias("consistent"))


def contributions(facts: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """IDX-2: (schema_id, doc_id) pairs, each counted once; with ``seen`` only pairs that are new."""
    c = facts.select("schema_id", "doc_id").distinct()
    return c if seen is None else c.join(seen, ["schema_id", "doc_id"], "left_anti")


def stabilize(old: DataFrame, new: DataFrame, threshold: int = STABLE_FROM) -> DataFrame:
    """IDX-1: frequencies of old (schema_id, frequency, state) and new (schema_id, doc_id) together; stable is kept once reached."""
    add = new.groupBy("schema_id").agg(F.count(F.lit(1)).alias("added"))
    j = old.join(add, "schema_id", "full_outer").select("schema_id", F.coalesce("frequency", F.lit(0)).alias("before"), F.coalesce("state", F.lit("pending")).alias("was"), F.coalesce("added", F.lit(0)).alias("added"))
    total = F.col("before") + F.col("added")
    now = F.when((F.col("was") == "stable") | (total >= threshold), "stable").otherwise("pending")
    return j.select("schema_id", total.alias("frequency"), now.alias("state"), ((F.col("was") != "stable") & (now == "stable")).alias("newly_stable"))


def activate(facts: DataFrame, schemas: DataFrame) -> DataFrame:
    """IDX-3: a fact is active if its schema is stable; facts without a schema are left out."""
    s = schemas.select("schema_id", F.col("state").alias("schema_state"))
    return facts.join(s, "schema_id").withColumn("state", F.when(F.col("schema_state") == "stable", "active").otherwise("inactive")).drop("schema_state")


def fold_facts(rows: DataFrame) -> DataFrame:
    """AGG-7: one row per fact_id: greatest confidence, passages and documents as sorted sets, ``consistent`` = one meaning."""
    meaning = F.struct("schema_id", "head_entity", "relation", "tail_entity", "head_type", "tail_type")
    return rows.groupBy("fact_id").agg(
        F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("passage_id")).alias("passage_ids"),
        F.array_sort(F.collect_set("doc_id")).alias("doc_ids"), (F.countDistinct(meaning) == 1).alias("consistent"),
    )


# --- conflicts -------------------------------------------------------------------------------------------------------


def conflict_type(a: str, b: str) -> Column:
    """JN-7: the first that holds: tails differ; temporal scopes differ; parents differ."""
    c = lambda s, n: F.col(f"{s}.{n}")
    tail = ids.term(c(a, "tail_entity")) != ids.term(c(b, "tail_entity"))
    scope = ~c(a, "temporal_scope").eqNullSafe(c(b, "temporal_scope"))
    parent = ~c(a, "parent").eqNullSafe(c(b, "parent"))
    return F.when(tail, "mutually_exclusive").when(scope, "temporal").when(parent, "granularity")


def conflicts(new: DataFrame, stored: DataFrame, limit: int | None = None) -> DataFrame:
    """JN-7: (fact_id, other_id, conflict_type) of new facts against stored active ones with the same head and relation.

    With ``limit`` a new fact is held against the first ``limit`` active facts by id other than itself; without, against all: rows are
    then as many as the pairs of facts that share head and relation.
    """
    keyed = lambda df: df.withColumn("h", ids.term("head_entity")).withColumn("r", ids.term("relation"))
    active = stored.filter(F.col("state") == "active")
    if limit is not None:
        # one more than the limit, for new facts that are among the first themselves
        first = active.orderBy("fact_id").limit(limit + 1).withColumn("__place", F.row_number().over(Window.orderBy("fact_id")))
        own = F.broadcast(first.select("fact_id", F.col("__place").alias("__own")))
        new, active = new.join(own, "fact_id", "left").withColumn("__own", F.coalesce("__own", F.lit(limit + 1))), F.broadcast(first)
    a, b = keyed(new).alias("a"), keyed(active).alias("b")
    j = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.r") == F.col("b.r")) & (F.col("a.fact_id") != F.col("b.fact_id")))
    if limit is not None:
        j = j.filter((F.col("b.__place") <= limit) | (F.col("a.__own") <= limit))
    return j.select(F.col("a.fact_id").alias("fact_id"), F.col("b.fact_id").alias("other_id"), conflict_type("a", "b").alias("conflict_type")).filter("conflict_type is not null")


def conflict_sets(new: DataFrame, stored: DataFrame, limit: int = 100) -> DataFrame:
    """JN-7: per new fact and type of conflict the facts in conflict, at most ``limit``."""
    found = conflicts(new, stored, limit)
    return found.groupBy("fact_id", "conflict_type").agg(F.array_sort(F.collect_list("other_id")).alias("others"))


def active_window(facts: DataFrame, limit: int = ACTIVE_WINDOW) -> DataFrame:
    """FLT-8: the first active facts by id; the limit is the operator's own."""
    return facts.filter(F.col("state") == "active").orderBy("fact_id").limit(limit)


def resolve(conflict_rows: DataFrame, confidence: DataFrame) -> DataFrame:
    """IDX-4 with a rule in place of a model: the more confident fact stays, equals both stay; (fact_id, other_id, resolution, inactivated)."""
    c = confidence.select("fact_id", "confidence")
    j = conflict_rows.join(c, "fact_id").join(c.select(F.col("fact_id").alias("other_id"), F.col("confidence").alias("other")), "other_id")
    how = F.when(F.col("confidence") > F.col("other"), "keep_new").when(F.col("confidence") < F.col("other"), "keep_existing").otherwise("keep_both")
    return j.withColumn("resolution", how).select("fact_id", "other_id", "resolution", inactivated(F.col("resolution"), F.col("fact_id"), F.col("other_id")).alias("inactivated"))


def inactivated(resolution: Column, new: Column, old: Column) -> Column:
    return F.when(resolution == "keep_new", F.array(old)).when(resolution == "keep_existing", F.array(new)).when(resolution == "discard_both", F.array(new, old)).otherwise(F.array().cast("array<string>"))


def parse_resolution(reply: Column) -> Column:
    """IDX-4: a model's reply as (resolution, confidence); what cannot be read keeps both at 0.3."""
    r = F.from_json(reply, "struct<resolution:string,confidence:double>")
    ok = r.resolution.isin("keep_new", "keep_existing", "keep_both", "discard_both")
    return F.struct(F.when(ok, r.resolution).otherwise("keep_both").alias("resolution"), F.when(ok, F.coalesce(r.confidence, F.lit(0.3))).otherwise(0.3).alias("confidence"))


def apply_resolutions(facts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """New facts that a resolution inactivates become inactive; stored losers keep their state."""
    lost = resolutions.select(F.explode("inactivated").alias("fact_id"), F.col("fact_id").alias("new")).filter("fact_id = new").select("fact_id").distinct().withColumn("lost", F.lit(True))
    return facts.join(lost, "fact_id", "left").withColumn("state", F.when(F.col("lost"), "inactive").otherwise(F.col("state"))).drop("lost")


# --- deletes and integrity -------------------------------------------------------------------------------------------


def delete_document(doc, passages: DataFrame, facts: DataFrame, schemas: DataFrame, threshold: int = STABLE_FROM) -> dict[str, DataFrame]:
    """IDX-5: the document's passages and facts go; its schemas lose one contribution (not below 0) and may fall back to pending."""
    hit = facts.filter(F.col("doc_id") == doc).select("schema_id").distinct().withColumn("hit", F.lit(1))
    s = schemas.join(hit, "schema_id", "left").withColumn("frequency", F.greatest(F.lit(0), F.col("frequency") - F.coalesce("hit", F.lit(0)))).drop("hit")
    s = s.withColumn("state", F.when(F.col("frequency") >= threshold, "stable").otherwise("pending"))
    return {"passages": passages.filter(F.col("doc_id") != doc), "facts": facts.filter(F.col("doc_id") != doc), "schemas": s}


def replace_document(doc, passages: DataFrame, facts: DataFrame, schemas: DataFrame, new_passages: DataFrame, new_facts: DataFrame) -> dict[str, DataFrame]:
    """IDX-6: delete and insert as one change."""
    left = delete_document(doc, passages, facts, schemas)
    old = left["schemas"].select("schema_id", "frequency", "state")
    return {"passages": left["passages"].unionByName(new_passages), "facts": left["facts"].unionByName(new_facts), "schemas": stabilize(old, contributions(new_facts)).drop("newly_stable")}


def integrity(schemas: DataFrame, facts: DataFrame, passages: DataFrame, links: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-2: messages for facts without their schema, evidence links without passage or fact, and edges without an end."""
    msg = lambda df, *parts: df.select(F.concat(*[F.lit(p) if p.startswith(" ") or p.endswith(" ") else F.col(p) for p in parts]).alias("message"))
    a = msg(facts.join(schemas.select("schema_id"), "schema_id", "left_anti"), "fact ", "fact_id", " has no schema ", "schema_id")
    b = msg(links.join(passages.select("passage_id"), "passage_id", "left_anti"), "link of ", "fact_id", " has no passage ", "passage_id")
    c = msg(links.join(facts.select("fact_id"), "fact_id", "left_anti"), "link to ", "passage_id", " has no fact ", "fact_id")
    known = nodes.select("node_id").distinct()
    lost = reduce(DataFrame.unionByName, [edges.join(known.withColumnRenamed("node_id", s), s, "left_anti").select("src", "dst", "relation") for s in ("src", "dst")]).distinct()
    d = msg(lost, "edge ", "src", " to ", "dst", " has no end ")
    return a.unionByName(b).unionByName(c).unionByName(d)


def violations(df: DataFrame, contract: dict[str, str]) -> DataFrame:
    """Structural contract as SQL predicates by name: rows with the names of those that do not hold."""
    bad = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(p), F.lit(False)), F.lit(n)) for n, p in contract.items()]))
    return df.withColumn("violations", bad).filter(F.size("violations") > 0)


def versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The newest row of each key of a versioned table."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
