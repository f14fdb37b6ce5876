"""Personalized PageRank: compile (GR-7), run (GR-8), seeds (GR-11 to GR-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.sources.store import cut

HUB_DEGREE = 50


def compile_transitions(edges: DataFrame, hub_degree: int = HUB_DEGREE) -> DataFrame:
    """GR-7: (src, dst, p): weight over the source's out-weight, damped where the target is a schema node of high degree.

    Parallel edges stay apart. The degree counts edges in and out; damping is 1 / log2(degree + 2). The edges, often a projection
    of several tables, are written once and read by the three parts. Degrees exist for schema nodes only; out-weights are joined
    on the key that they are grouped by.
    """
    edges = cut(edges.select("src", "dst", "weight"), "edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("dst"))
    degree = ends.filter(F.col("dst").startswith("schema:")).groupBy("dst").agg(F.count(F.lit(1)).alias("degree"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    damp = F.when(F.col("degree") > hub_degree, 1 / F.log2(F.col("degree") + 2.0)).otherwise(1.0)
    return edges.join(out, "src").join(degree, "dst", "left").select("src", "dst", (F.when(F.col("out") > 0, F.col("weight") / F.col("out")).otherwise(0.0) * damp).alias("p"))


def seeds_in_graph(transitions: DataFrame, seeds: DataFrame) -> DataFrame:
    """JN-11: teleport of every node of the graph: its share of the seeds that are in it; uniform if these sum to 0 or less."""
    nodes = transitions.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    joined = nodes.join(seeds, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("seed"))
    whole = joined.agg(F.sum("seed").alias("total"), F.count(F.lit(1)).alias("n"))
    return joined.join(F.broadcast(whole)).select("node_id", F.when(F.col("total") > 0, F.col("seed") / F.col("total")).otherwise(1.0 / F.col("n")).alias("teleport"))


def run(transitions: DataFrame, seeds: DataFrame, alpha: float = 0.5, epsilon: float = 1e-6, max_iterations: int = 100, every: int = 1) -> tuple[DataFrame, dict]:
    """GR-8: scores (node_id, score) and how the run ended. Mass at nodes without an outgoing edge leaks.

    ``alpha`` is the share of teleport. Each iteration is a join and an aggregation on keys; it is cut to the shared folder, and
    only the L1 distance reaches the driver, on every ``every``-th iteration.
    """
    base = cut(seeds_in_graph(transitions, seeds), "teleport")
    steps = cut(transitions, "transitions")
    score, state = base.select("node_id", F.col("teleport").alias("score")), {"iterations": 0, "converged": True, "l1": 0.0}
    if base.limit(1).count() == 0:
        return score, state
    for i in range(1, max_iterations + 1):
        flow = steps.join(score.withColumnRenamed("node_id", "src"), "src").groupBy("dst").agg(F.sum(F.col("p") * F.col("score")).alias("in")).withColumnRenamed("dst", "node_id")
        both = base.join(flow, "node_id", "left").join(score.withColumnRenamed("score", "old"), "node_id").select("node_id", ((1 - alpha) * F.coalesce("in", F.lit(0.0)) + alpha * F.col("teleport")).alias("score"), "old")
        both = cut(both, "scores")
        score, state = both.select("node_id", "score"), {"iterations": i, "converged": False, "l1": None}
        if i % every == 0 or i == max_iterations:
            l1 = both.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
            state["l1"] = l1
            if l1 < epsilon:
                state["converged"] = True
                break
    return score, state


def fixed_iterations(transitions: DataFrame, seeds: DataFrame, iterations: int, alpha: float = 0.5) -> DataFrame:
    """GR-8 as one plan of a fixed number of iterations over transitions and teleport that are written once."""
    transitions = cut(transitions, "transitions")
    base = cut(seeds_in_graph(transitions, seeds), "teleport")
    score = base.select("node_id", F.col("teleport").alias("score"))
    for _ in range(iterations):
        flow = transitions.join(score.withColumnRenamed("node_id", "src"), "src").groupBy("dst").agg(F.sum(F.col("p") * F.col("score")).alias("in")).withColumnRenamed("dst", "node_id")
        score = base.join(flow, "node_id", "left").select("node_id", ((1 - alpha) * F.coalesce("in", F.lit(0.0)) + alpha * F.col("teleport")).alias("score"))
    return score


def normed(rows: DataFrame, size=lambda c: F.col(c)) -> DataFrame:
    """Scores over their sum where that is positive; the sum is one broadcast row, so no task sees all rows."""
    total = rows.agg(F.sum(size("score")).alias("total"))
    return rows.join(F.broadcast(total)).select("node_id", F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(F.col("score")).alias("score"))


def seed_vector(facts: DataFrame, expanded: DataFrame, passages: DataFrame, schemas: DataFrame) -> DataFrame:
    """GR-11: one (node_id, score) table; later slots overwrite earlier ones, except that expanded facts never do."""
    slots = facts.withColumn("slot", F.lit(1)).unionByName(expanded.withColumn("slot", F.lit(0))).unionByName(passages.withColumn("slot", F.lit(2))).unionByName(schemas.withColumn("slot", F.lit(3)))
    return slots.groupBy("node_id").agg(F.max_by("score", "slot").alias("score"))


def expand_facts(seeds: DataFrame, facts: DataFrame, attenuation: float = 0.3, top: int = 20) -> DataFrame:
    """GR-12, TOP-10: further facts of the seed facts' entities: the higher of its ends' best seed score (0 at least) times ``attenuation``."""
    s = seeds.join(facts, "fact_id").select("fact_id", F.greatest("score", F.lit(0.0)).alias("score"), F.explode(F.array(F.lower("head_entity"), F.lower("tail_entity"))).alias("k"))
    best = s.groupBy("k").agg(F.max("score").alias("s"))
    side = lambda c: facts.join(best, F.lower(c) == F.col("k")).select("fact_id", "s")
    found = side("head_entity").unionByName(side("tail_entity")).join(seeds.select("fact_id"), "fact_id", "left_anti")
    return found.groupBy("fact_id").agg(F.round(F.max("s") * attenuation, 9).alias("score")).orderBy(F.col("score").desc(), "fact_id").limit(top)


def blend(original: DataFrame, hop1: DataFrame, hop2: DataFrame, weights=(0.4, 0.3, 0.3)) -> DataFrame:
    """GR-13: weighted sum of three seed vectors, normed to 1 where the sum is positive."""
    rows = None
    for df, w in zip((original, hop1, hop2), weights, strict=True):
        part = df.select("node_id", (F.col("score") * w).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    return normed(rows.groupBy("node_id").agg(F.sum("score").alias("score")))


def inject_dictionary_facts(base: DataFrame, entities: DataFrame, facts: DataFrame, per_entity: int = 3, total: int = 10) -> DataFrame:
    """TOP-11: facts of dictionary entities join the seeds at a tenth of the greatest positive score, a few per entity; then L1 norm."""
    e = entities.select(F.lower("entity").alias("k")).distinct()
    head = facts.join(e, F.lower("head_entity") == F.col("k")).select("fact_id", "k", F.lit(0).alias("side"))
    tail = facts.join(e, F.lower("tail_entity") == F.col("k")).select("fact_id", "k", F.lit(1).alias("side"))
    one = head.unionByName(tail).groupBy("fact_id").agg(F.min_by("k", F.struct("side", "k")).alias("k"))
    ranked = one.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("fact_id"))).filter(F.col("rn") <= per_entity)
    chosen = ranked.orderBy("fact_id").limit(total).select(F.concat(F.lit("fact:"), "fact_id").alias("node_id"))
    top = base.agg(F.max(F.when(F.col("score") > 0, F.col("score"))).alias("top"))
    added = chosen.join(base.select("node_id"), "node_id", "left_anti").join(F.broadcast(top)).select("node_id", (0.1 * F.coalesce("top", F.lit(0.0))).alias("score"))
    return normed(base.select("node_id", "score").unionByName(added), F.abs)


def paper_seeds(fact_scores: DataFrame, schema_scores: DataFrame, passage_scores: DataFrame, mentions: DataFrame, edges: DataFrame, alpha: float = 0.05) -> DataFrame:
    """GR-15: entity = mean of its facts; schema = score / log(degree + 1); passage = score * alpha * sigmoid(sum of IDF / log(entities + 1))."""
    ent = mentions.join(fact_scores, "fact_id").groupBy("entity_key").agg(F.avg("score").alias("score")).select(F.concat(F.lit("entity:"), "entity_key").alias("node_id"), "score")
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    sch = schema_scores.join(degree, "node_id").select("node_id", (F.col("score") / F.log(F.col("degree") + 1.0)).alias("score"))
    per = mentions.select("passage_id", "entity_key").distinct()
    n = per.agg(F.countDistinct("passage_id").alias("n"))
    idf = per.groupBy("entity_key").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("entity_key", F.log(F.col("n") / F.col("df")).alias("idf"))
    weight = per.join(idf, "entity_key").groupBy("passage_id").agg((F.sum("idf") / F.log(F.count(F.lit(1)) + 1.0)).alias("x"))
    pas = passage_scores.join(weight, "passage_id").select(F.concat(F.lit("passage:"), "passage_id").alias("node_id"), (F.col("score") * alpha / (1 + F.exp(-F.col("x")))).alias("score"))
    return normed(ent.unionByName(sch).unionByName(pas))
