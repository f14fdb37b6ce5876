"""Statistics and result checks (AGG-1, AGG-3 to AGG-5, AGG-20 to AGG-22, contract checks of retrieval results)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """AGG-1: one row of counts: rows of each table, stable schemas, active and inactive facts, facts with evidence (JN-4)."""
    one = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in tables.items()]
    out = one[0]
    for o in one[1:]:
        out = out.join(o)
    s = tables["schemas"].agg(F.count_if(F.col("state") == "stable").alias("stable_schemas"))
    f = tables["facts"].agg(F.count_if(F.col("state") == "active").alias("active_facts"), F.count_if(F.col("state") != "active").alias("inactive_facts"))
    linked = tables["facts"].join(tables["passages"].select("passage_id"), "passage_id", "left_semi").agg(F.countDistinct("fact_id").alias("linked_facts"))
    return out.join(s).join(f).join(linked)


def conflict_distribution(audit: DataFrame) -> DataFrame:
    """AGG-3: audit rows by the resolution state in their JSON detail."""
    return audit.groupBy(F.coalesce(F.get_json_object("detail", "$.resolutionState"), F.lit("unknown")).alias("resolution_state")).agg(F.count(F.lit(1)).alias("n"))


def dictionary_stats(entries: DataFrame, domain: str = "category") -> DataFrame:
    """AGG-4: total, share of entries with confidence of 0.5 or more, and entries per domain, as (measure, value)."""
    whole = entries.agg(F.count(F.lit(1)).cast("double").alias("total"), F.round(F.coalesce(F.avg((F.col("confidence") >= 0.5).cast("double")), F.lit(0.0)), 6).alias("confident"))
    a = whole.select(F.explode(F.array(F.struct(F.lit("total").alias("measure"), F.col("total").alias("value")), F.struct(F.lit("confident").alias("measure"), F.col("confident").alias("value")))).alias("x")).select("x.*")
    return a.unionByName(entries.groupBy(F.concat(F.lit("domain:"), F.col(domain)).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value")))


def thesaurus_stats(relations: DataFrame) -> DataFrame:
    """AGG-5: relations by type, with the bidirectional ones."""
    return relations.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("bidirectional").alias("bidirectional"))


def contributions(merged: DataFrame) -> DataFrame:
    """AGG-20: rows per database."""
    return merged.groupBy("db_id").agg(F.count(F.lit(1)).alias("n"))


def merge_metrics(rows: DataFrame) -> DataFrame:
    """AGG-20: summed counts, greatest latency, distinct expanded terms, any fallback; propagation counts start anew."""
    return rows.agg(F.sum("candidates").alias("candidates"), F.max("latency_ms").alias("latency_ms"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("expanded")))).alias("expanded"), F.bool_or("fallback").alias("fallback"), F.lit(0).alias("iterations"), F.lit(True).alias("converged"))


def timings(events: DataFrame, name: str, value: str) -> DataFrame:
    """AGG-21: count, total and mean per name."""
    return events.groupBy(name).agg(F.count(value).alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.avg(value), 6).alias("mean"))


def match_rate(expected: DataFrame, actual: DataFrame, by: str, item: str) -> DataFrame:
    """AGG-22, SET-3: per query the share of expected items that are in the actual list."""
    e, a = expected.select(by, item).distinct(), actual.select(by, item).distinct().withColumn("hit", F.lit(1))
    return e.join(a, [by, item], "left").groupBy(by).agg(F.round(F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("match_rate"))


# --- checks: each returns the rows that break a rule -------------------------------------------------------------------


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_order(df: DataFrame, by: str, key: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """Rows whose score is above the one before, or equal with a lower key."""
    w = Window.partitionBy(by).orderBy(rank)
    p = df.withColumn("before", F.lag(score).over(w)).withColumn("before_key", F.lag(key).over(w))
    return p.filter((F.col(score) > F.col("before")) | ((F.col(score) == F.col("before")) & (F.col(key) <= F.col("before_key")))).drop("before", "before_key")


def check_ranks(df: DataFrame, by: str, rank: str = "rank") -> DataFrame:
    """Rows whose rank is not their place, counted from 1."""
    w = Window.partitionBy(by).orderBy(rank)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") != F.col(rank))


def check_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(F.col(column).isNull() | F.isnan(column) | (F.col(column) < low) | (F.col(column) > high))


def check_limit(df: DataFrame, by: str, most: int) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)


def check_expansion(expanded: DataFrame, seeds: DataFrame, facts: DataFrame, attenuation: float = 0.3) -> DataFrame:
    """Expanded facts whose score is not ``attenuation`` times the best seed score at their ends."""
    s = seeds.join(facts, "fact_id").select(F.greatest("score", F.lit(0.0)).alias("s"), F.explode(F.array(F.lower("head_entity"), F.lower("tail_entity"))).alias("k")).groupBy("k").agg(F.max("s").alias("s"))
    ends = expanded.join(facts.select("fact_id", "head_entity", "tail_entity"), "fact_id").select("fact_id", "score", F.explode(F.array(F.lower("head_entity"), F.lower("tail_entity"))).alias("k"))
    best = ends.join(s, "k", "left").groupBy("fact_id", "score").agg(F.max("s").alias("s"))
    return best.filter(F.abs(F.col("score") - attenuation * F.coalesce("s", F.lit(0.0))) > 1e-6)


def check_ppr(state: dict, epsilon: float, max_iterations: int) -> list[str]:
    """Broken invariants of a propagation's end state."""
    out = []
    if state["l1"] is not None and state["converged"] != (state["l1"] < epsilon):
        out.append("converged disagrees with the distance")
    if not state["converged"] and state["iterations"] != max_iterations:
        out.append("stopped early without convergence")
    if state["iterations"] == 0 and not (state["converged"] and state["l1"] == 0):
        out.append("no iteration but not at rest")
    return out
