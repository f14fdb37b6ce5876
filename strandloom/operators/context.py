"""Context building and template answers (WIN-1 to WIN-4, QA-2), and answer-side operators (QA-1, QA-3 to QA-5, AGG-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import text


def within_budget(items: DataFrame, block: Column, limit: int, used: Column | int = 0) -> DataFrame:
    """Rows (with ``rank``) of the longest prefix whose summed tokens stay within the limit: building stops at the first overflow."""
    start = used if isinstance(used, Column) else F.lit(used)
    # a block that is not empty has a token at least: no more than ``limit`` of them can fit, and the rest is never gathered
    tokens = items.orderBy("rank").limit(limit + 1).withColumn("block", block).withColumn("tokens", text.context_tokens("block"))
    running = F.sum("tokens").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tokens.withColumn("running", start + running).filter(F.col("running") <= limit)


def section(items: DataFrame, title: str, end: str = "") -> DataFrame:
    """One row: the heading and all blocks by rank; an empty text if there are no items at all."""
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x.block), "")
    return items.agg(F.concat(F.lit(title), blocks, F.lit(end)).alias("section"))


def build_context(passages: DataFrame, facts: DataFrame, limit: int, comparison: bool) -> DataFrame:
    """WIN-1, WIN-3: the prompt context of ranked passages (rank, doc_id, text) and facts (rank, head, relation, tail).

    Facts come first for comparisons, and passages follow below 60 % of the limit; otherwise passages come first and facts
    follow below 80 %. Inputs are ranked lists that retrieval has already cut to a few rows.
    """
    p_block = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("] "), F.col("text"), F.lit("\n\n"))
    f_block = F.concat(F.lit("- "), F.col("head_entity"), F.lit(" → "), F.col("relation"), F.lit(" → "), F.col("tail_entity"), F.lit("\n"))
    kinds = {"p": (passages, p_block, "## Relevant Passages\n\n", ""), "f": (facts, f_block, "## Key Facts\n\n", "\n")}
    order, share = ("fp", 0.6) if comparison else ("pf", 0.8)

    def made(kind: str, used: DataFrame | None) -> DataFrame:
        items, block, title, end = kinds[kind]
        n = items.agg(F.count(F.lit(1)).alias("n"))
        rows = items.withColumn("used", F.lit(0)) if used is None else items.join(F.broadcast(used.select(F.col("tokens_used").alias("used"))))
        kept = within_budget(rows, block, limit, F.col("used"))
        text_ = section(kept.select("rank", "block"), title, end)
        return n.join(text_).select("n", F.when(F.col("n") > 0, F.col("section")).otherwise("").alias("section"))

    first = made(order[0], None).select(F.col("n").alias("n1"), F.col("section").alias("s1")).withColumn("tokens_used", text.context_tokens("s1"))
    second = made(order[1], first).select(F.col("n").alias("n2"), F.col("section").alias("s2"))
    n_p, n_f = ("n2", "n1") if comparison else ("n1", "n2")
    both = F.concat("s1", F.when(F.col("tokens_used") < limit * share, F.col("s2")).otherwise(""))
    return first.join(second).select(both.alias("context"), confidence(F.col(n_p), F.col(n_f)).alias("confidence"))


def confidence(n_passages: Column, n_facts: Column) -> Column:
    """WIN-3"""
    return F.least(F.lit(1.0), n_passages * 0.3 + n_facts * 0.1)


def alias_hints(hints: DataFrame, limit: int) -> DataFrame:
    """WIN-2: hint lines (rank, line) within a tenth of the context limit."""
    return within_budget(hints, F.col("line"), limit // 10)


def simple_context(passages: DataFrame, facts: DataFrame) -> DataFrame:
    """WIN-4: ``Passage:`` and ``Fact:`` lines without a budget; confidence is the top score."""
    p = passages.select(F.lit(0).alias("kind"), "rank", "score", F.concat(F.lit("Passage: "), "text").alias("line"))
    f = facts.select(F.lit(1).alias("kind"), "rank", "score", F.concat(F.lit("Fact: "), F.concat_ws(" ", "head_entity", "relation", "tail_entity")).alias("line"))
    rows = p.unionByName(f)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", "line"))), lambda x: x.line), "\n")
    return rows.agg(lines.alias("context"), F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"))


def template_answer(question: str, passages: DataFrame, facts: DataFrame) -> DataFrame:
    """QA-2: up to three snippets, up to eight entities, distinct citations; no model."""
    snippets = passages.orderBy("rank").limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.truncate("text").alias("t")))), lambda x: x.t), " ").alias("snippets"), F.array_sort(F.collect_set("doc_id")).alias("citations"))
    names = facts.select("rank", F.posexplode(F.array("head_entity", "tail_entity")).alias("pos", "name")).groupBy("name").agg(F.min(F.struct("rank", "pos")).alias("first"))
    entities = names.orderBy("first", "name").limit(8).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col("name").alias("n")))), lambda x: x.n), ", ").alias("entities"))
    return snippets.join(entities).select(F.lit(question).alias("question"), F.concat(F.col("snippets"), F.when(F.col("entities") != "", F.concat(F.lit(" Entities: "), "entities")).otherwise("")).alias("answer"), "citations")


def majority_vote(answers: DataFrame, group: str, answer: str, position: str) -> DataFrame:
    """AGG-18: the most frequent answer (trimmed, lower case), first seen wins ties; given back as first written."""
    norm = F.lower(F.trim(F.col(answer)))
    counts = answers.withColumn("norm", norm).filter("norm <> ''").groupBy(group, "norm").agg(F.count(F.lit(1)).alias("votes"), F.min(position).alias("first"), F.min_by(answer, position).alias("answer"))
    best = Window.partitionBy(group).orderBy(F.col("votes").desc(), "first")
    return counts.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(group, "answer", "votes")


def grounded(answer, passage) -> Column:
    """QA-5: short answers as whole words, others contained; or 60 % of two or more words; or all words of four letters of up to three.

    One-letter words don't count, and repeated words count each time.
    """
    a, p = text.normalize_grounding(answer), text.normalize_grounding(passage)
    w, pw = F.filter(F.split(a, " "), lambda x: F.length(x) > 1), F.split(p, " ")
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    inside = F.when(F.length(a) <= 3, F.contains(padded(p), padded(a))).otherwise(F.contains(p, a))
    share = F.size(F.filter(w, lambda x: F.array_contains(pw, x))) / F.size(w)
    long_words = F.filter(w, lambda x: F.length(x) >= 4)
    all_long = (F.size(w) <= 3) & (F.size(long_words) > 0) & F.forall(long_words, lambda x: F.contains(p, x))
    return F.coalesce(F.when(a == "", False).otherwise(inside | F.when(F.size(w) >= 2, share >= 0.6).otherwise(False) | all_long), F.lit(False))


# --- fixed values: what an explicit comparison looks like -------------------------------------------------------------
EXPLICIT = (
    r"(?i)\b(?:while|whereas|but|however|on the other hand)\b",
    r"(?i)(?:entity|first|second|former|latter)\b.*\b(?:is|was|has|had)\b",
    r"(?s)\b\d+[.)]\s+\w+.*\b\d+[.)]\s+\w+",
)
# ---------------------------------------------------------------------------------------------------------------------


def explicit_comparison(reply) -> Column:
    """QA-3: whether a reply to a comparison compares in so many words: a contrast, a statement about each, or two numbered items."""
    c = F.coalesce(F.col(reply) if isinstance(reply, str) else reply, F.lit(""))
    return c.rlike(EXPLICIT[0]) | c.rlike(EXPLICIT[1]) | c.rlike(EXPLICIT[2])


def decomposition(reply: Column) -> Column:
    """QA-4: (hop1, hop2, bridge_hint, fallback_reason) of a reply in JSON; the questions are null where there is a reason."""
    v = F.try_parse_json(reply)
    strip = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")

    def field(name: str) -> Column:
        """A field's trimmed text, null if it isn't a text."""
        is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING"
        return F.when(is_text, strip(F.try_variant_get(v, f"$.{name}", "string")))

    h1, h2, hint = field("hop1SubQuestion"), field("hop2SubQuestion"), field("bridgeEntityHint")
    slot = F.lit("{hop1Answer}")
    reason = (
        F.when(v.isNull(), "decomposition_parse_error").when(h1.isNull() | (h1 == "") | h2.isNull() | (h2 == ""), "decomposition_missing_field")
        .when(~F.contains(h2, slot), "decomposition_missing_placeholder").when(F.lower(h1) == F.lower(strip(F.replace(h2, slot, F.lit("")))), "decomposition_duplicate_hops")
    )
    usable = lambda c: F.when(reason.isNull(), c)
    return F.struct(usable(h1).alias("hop1"), usable(h2).alias("hop2"), usable(F.nullif(hint, F.lit(""))).alias("bridge_hint"), reason.alias("fallback_reason"))


def merged_context(passages: DataFrame, facts: DataFrame) -> DataFrame:
    """TOP-7: the prompt of merged passages and facts (rank in merged order), confidence being the first passage's score."""
    lines = simple_context(passages, facts).select("context")
    first = passages.agg(F.coalesce(F.min_by("score", "rank"), F.lit(0.0)).alias("confidence"))
    return lines.join(first)
