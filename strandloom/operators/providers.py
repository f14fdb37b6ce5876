"""Models behind provider functions (GR-4, SNK-8, QA-1, QA-6, QA-8): Arrow batches in, Arrow batches out, injectable and optional."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions import text
from strandloom.operators.context import decomposition, explicit_comparison, grounded, majority_vote

DIMENSIONS = 8
LONGEST = 7000
BATCH = 32
Embedder = Callable[[list[str]], list[list[float]]]
Answerer = Callable[[list[str], int], list[str | None]]


def hash_embedder(texts: list[str], dimensions: int = DIMENSIONS) -> list[list[float]]:
    """The offline stand-in: a unit vector from the text's digest."""
    out = []
    for t in texts:
        raw = hashlib.sha256(t.encode()).digest()[:dimensions]
        v = [b / 127.5 - 1 for b in raw]
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


def with_retries(call: Callable, tries: int = 3, first_wait: float = 0.25, sleep: Callable = time.sleep):
    """QA-8: a call that is repeated after transient errors, with doubled waits."""

    def run(*args):
        for i in range(tries):
            try:
                return call(*args)
            except (ConnectionError, TimeoutError):
                if i == tries - 1:
                    raise
                sleep(first_wait * 2**i)

    return run


def embed(df: DataFrame, key: str, body: str, embedder: Embedder = hash_embedder, batch: int = BATCH) -> DataFrame:
    """SNK-8: (key, embedding) by batches of ``batch`` texts, each cut to the model's input length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "embedding": embedder([str(t)[:LONGEST] for t in part[body].fillna("")])})

    return df.select(key, body).mapInPandas(run, f"{key} string, embedding array<double>")


def vector_inputs(nodes: DataFrame, embedder: Embedder = hash_embedder, dimensions: int = DIMENSIONS) -> DataFrame:
    """GR-4: label vectors of graph nodes, with ``ok`` = of the right length and finite."""
    e = embed(nodes, "node_id", "label", embedder)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.select("node_id", "embedding", F.size("embedding").alias("dimensions"), ((F.size("embedding") == dimensions) & finite).alias("ok"))


def answers(questions: DataFrame, key: str, prompt: str, answerer: Answerer, samples: int = 3, fallback: Column | None = None) -> DataFrame:
    """QA-1: ``samples`` replies per prompt, the final answer of each, majority vote; ``fallback`` where there is no reply."""
    schema = f"{key} string, sample int, reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(samples):
                yield pd.DataFrame({key: pdf[key], "sample": i, "reply": answerer(list(pdf[prompt]), i)})

    replies = questions.select(F.col(key).cast("string").alias(key), prompt).mapInPandas(run, schema)
    final = replies.filter("reply is not null").select(key, "sample", text.final_answer("reply").alias("answer"))
    voted = majority_vote(final, key, "answer", "sample")
    out = questions.withColumn(key, F.col(key).cast("string")).join(voted, key, "left")
    return out.withColumn("answer", F.coalesce("answer", fallback if fallback is not None else F.lit(""))).withColumn("votes", F.coalesce("votes", F.lit(0)))


def second_hop(hop2: Column, hop1_answer: Column, grounded: Column) -> Column:
    """QA-6: the second question with the first answer in it, or null where the answer is empty or not grounded."""
    return F.when((F.trim(hop1_answer) != "") & grounded, F.replace(hop2, F.lit("{hop1Answer}"), hop1_answer))


# --- fixed value ------------------------------------------------------------------------------------------------------
ENHANCED = (
    "IMPORTANT: Before giving your yes/no answer, you MUST explicitly state the relevant attribute or value for EACH entity being compared. "
    "Then derive your answer from those values."
)
# ---------------------------------------------------------------------------------------------------------------------


def _asked(df: DataFrame, prompt: Column, answerer: Answerer, sample: int, out: str) -> DataFrame:
    """``df`` with the replies to its prompts; a null prompt is not asked."""
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ask = pdf["__prompt"].notna()
            replies = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            if ask.any():
                replies[ask] = answerer(list(pdf.loc[ask, "__prompt"]), sample)
            yield pdf.drop(columns="__prompt").assign(**{out: replies})

    return df.withColumn("__prompt", prompt).mapInPandas(run, schema)


def verify_comparisons(replies: DataFrame, answerer: Answerer) -> DataFrame:
    """QA-3: rows (query, context, reply, answer) with ``verified``: a reply that doesn't compare explicitly is asked for once more.

    The second answer counts if its reply compares explicitly; otherwise the first one stays, not verified.
    """
    ok = explicit_comparison("reply")
    again = F.concat(F.col("query"), F.lit(f"\n\n{ENHANCED}\n\nContext:\n"), F.col("context"), F.lit("\n\nReasoning and answer:"))
    asked = _asked(replies, F.when(~ok, again), answerer, 0, "second")
    better = F.col("second").isNotNull() & explicit_comparison("second")
    return asked.withColumn("verified", ok | better).withColumn("answer", F.when(~ok & better, text.final_answer("second")).otherwise(F.col("answer"))).drop("second")


def reason_in_two_hops(questions: DataFrame, decomposer: Answerer, answerer: Answerer, samples: int = 1) -> DataFrame:
    """QA-6: rows (query, passages: array of (id, text)) with hop answers, ``answer`` and ``fallback_reason``.

    A reply of null is an error of the model. With several samples the second hop is asked that often; replies that fail are
    skipped, ungrounded answers count without passages, and the most frequent answer wins, the first seen on a tie.
    """
    listed = F.array_join(F.transform("passages", lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), p.id, F.lit(") "), p.text)), "\n\n")
    prompt = lambda q: F.when(q.isNotNull(), F.concat(F.lit("Passages:\n"), listed, F.lit("\n\nQuestion: "), q))
    cited = lambda a: F.transform(F.filter("passages", lambda p: grounded(a, p.text)), lambda p: p.id)
    decompose = F.concat(F.lit('Decompose this question into 2 sub-questions:\n\n"'), F.col("query"), F.lit('"'))
    df = _asked(questions, decompose, decomposer, 0, "__d").withColumn("d", decomposition(F.col("__d")))
    df = _asked(df, prompt(F.col("d.hop1")), answerer, 0, "__r1").withColumn("hop1_answer", text.final_answer("__r1"))
    df = df.withColumn("hop1_passages", cited(F.col("hop1_answer")))
    reason = (
        F.when(F.col("__d").isNull(), "llm_api_error").when(F.col("d.fallback_reason").isNotNull(), F.col("d.fallback_reason")).when(F.col("__r1").isNull(), "llm_api_error")
        .when(F.trim("hop1_answer") == "", "hop1_empty").when(F.size("hop1_passages") == 0, "hop1_ungrounded")
    )
    df = df.withColumn("reason", reason)
    second = F.when(F.col("reason").isNull(), F.replace(F.col("d.hop2"), F.lit("{hop1Answer}"), F.col("hop1_answer")))
    for i in range(samples):
        df = _asked(df, prompt(second), answerer, i, f"__r2_{i}")
    found = F.filter(F.transform(F.array(*[text.final_answer(f"__r2_{i}") for i in range(samples)]), lambda a: F.when(F.trim(a) != "", a)), lambda a: a.isNotNull())
    df = df.withColumn("found", found)
    votes = F.transform("found", lambda a, i: F.struct(F.size(F.filter("found", lambda b: text.normalize_grounding(b) == text.normalize_grounding(a))).alias("n"), (-i).alias("first"), a.alias("a")))
    df = df.withColumn("hop2_answer", F.array_max(votes).a).withColumn("hop2_passages", cited(F.col("hop2_answer")))
    late = F.when(F.size("found") == 0, F.when(F.coalesce(*[F.col(f"__r2_{i}") for i in range(samples)]).isNull() & F.lit(samples == 1), "llm_api_error").otherwise("hop2_empty"))
    late = late.when((F.size("hop2_passages") == 0) & F.lit(samples == 1), "hop2_ungrounded")
    df = df.withColumn("fallback_reason", F.coalesce("reason", late))
    answer = F.when(F.col("fallback_reason").isNull(), F.col("hop2_answer")).otherwise("")
    return df.select(*questions.columns, "hop1_answer", "hop2_answer", "hop2_passages", answer.alias("answer"), "fallback_reason")
