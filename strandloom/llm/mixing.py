"""Operator 6: mixing sources to target weights by iterative proportional fitting, on built-in expressions only.

Token totals of the cells (source, language, topic) are raked in turn to target marginals of each dimension; a document's
weight is its cell's fitted tokens over observed tokens. Sampling probabilities are the weights times one factor, capped at
1, with the factor calibrated so that the expected tokens kept are ``share`` of all. A document is kept if a hash of its id
falls below its probability, so that runs agree.

The corpus is read twice (cells, then documents) and aggregated map-side; raking works on the cells alone. Only scalars
reach the driver. The cells are broadcast if they are at most ``BROADCAST_CELLS``; beyond it the join is an ordinary one.

Defined results: null text = empty text = 0 tokens; null source or language is the value '(none)'; null doc_id hashes like
an empty id; rows with equal ids are kept or dropped together if their cells agree; a cell without tokens has weight 0 and
probability 0; empty tables give no rows; further columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import WS, written

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 6
FLATTEN = 0.5
SHARE = 0.6
BROADCAST_CELLS = 100_000
#: Topics by the first sign that a text contains; SQL LIKE patterns.
TOPICS = (("licensed", "%icensed under%"), ("contact", "%@%"), ("secret", "% = \"%"), ("tabular", "% | %"), ("figures", "%0%"))
NONE = "(none)"


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, sign in reversed(TOPICS):
        out = F.when(text.contains(sign.strip("%")), name).otherwise(out)
    return out


def with_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``__cell`` of source, lang, topic and n_tokens (words)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n = F.size(F.split(t, WS)) - F.when(t.rlike(r"^[\x20\x09-\x0D]|^$"), 1).otherwise(0) - F.when(t.rlike(r"[^\x20\x09-\x0D](?s:[\x20\x09-\x0D]+)\z"), 1).otherwise(0) - F.when(t.rlike(r"\A[\x20\x09-\x0D]+\z"), 1).otherwise(0)
    return docs.withColumn("__cell", F.struct(F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), topic(t).alias("topic"), n.cast("long").alias("n_tokens")))


def targets(cells: DataFrame, dimension: str, given: dict | None, flatten: float) -> Column:
    """Target tokens of the row's value of a dimension: given shares, or its observed total to the power ``flatten``, normed."""
    if given:
        share = F.coalesce(*[F.when(F.col(dimension) == k, F.lit(float(v))) for k, v in given.items()], F.lit(0.0))
        return share / float(sum(given.values()))
    return F.pow("__m", F.lit(flatten))


def rake(cells: DataFrame, given: dict[str, dict] | None = None, rounds: int = ROUNDS, flatten: float = FLATTEN) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``fitted``: tokens raked to the target marginals of each dimension."""
    given, df = given or {}, cells
    for d in DIMENSIONS:
        by = Window.partitionBy(d)
        df = df.withColumn("__m", F.sum("tokens").over(by).cast("double")).withColumn(f"__t_{d}", targets(df, d, given.get(d), flatten)).drop("__m")
    df = df.withColumn("fitted", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMENSIONS:
            total = F.sum("fitted").over(Window.partitionBy(d))
            df = df.withColumn("fitted", F.when(total > 0, F.col("fitted") * F.col(f"__t_{d}") / total).otherwise(0.0))
    return df.drop(*[f"__t_{d}" for d in DIMENSIONS])


def factor(fitted: DataFrame, share: float) -> float:
    """The factor by which weights become probabilities of at most 1 whose expected tokens are ``share`` of all; scalars only."""
    weight = F.col("fitted") / F.col("tokens")
    live = fitted.filter("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return 0.0
    budget, now, capped = share * total, 0.0, -1
    while True:
        at_cap = (weight * now >= 1) if now else F.lit(False)
        n, tokens, rest = live.agg(F.sum(at_cap.cast("long")), F.sum(F.when(at_cap, F.col("tokens")).otherwise(0)), F.sum(F.when(at_cap, 0.0).otherwise(F.col("fitted")))).first()
        if n == capped or not rest:
            return now
        capped, now = n, (budget - tokens) / rest


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from an id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def with_sample(docs: DataFrame, share: float = SHARE, given: dict[str, dict] | None = None, rounds: int = ROUNDS, flatten: float = FLATTEN, text: str = "text") -> DataFrame:
    """``docs`` with structs ``__cell`` and ``__mix`` (weight, probability, sampled)."""
    df = with_cells(docs, text)
    cells = df.groupBy(*[F.col(f"__cell.{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("__cell.n_tokens").alias("tokens"))
    fitted = written(rake(written(cells, "cells"), given, rounds, flatten), "raked")
    scale = factor(fitted, share)
    weight = F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)
    table = fitted.select(F.struct(*DIMENSIONS).alias("__key"), F.struct(weight.alias("weight"), F.least(F.lit(1.0), weight * scale).alias("probability")).alias("__w"))
    if fitted.count() <= BROADCAST_CELLS:
        table = F.broadcast(table)
    df = df.withColumn("__key", F.struct(*[F.col(f"__cell.{d}").alias(d) for d in DIMENSIONS])).join(table, "__key", "left")
    drawn = uniform(F.col("doc_id")) < F.col("__w.probability")
    return df.withColumn("__mix", F.struct(F.col("__w.weight").alias("weight"), F.col("__w.probability").alias("probability"), drawn.alias("sampled"))).drop("__key", "__w")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight (relative), probability, sampled."""
    df = with_sample(docs.select("doc_id", "text", "source", "lang"), **options)
    return df.select("doc_id", *[f"__cell.{c}" for c in (*DIMENSIONS, "n_tokens")], F.round("__mix.weight", 9).alias("weight"), F.round("__mix.probability", 6).alias("probability"), "__mix.sampled")


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    return with_sample(docs, **options).filter("__mix.sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle(share: float = SHARE, rounds: int = ROUNDS, flatten: float = FLATTEN) -> str:
    """DuckDB SQL for mix() over documents with its default targets."""
    cases = " ".join(f"WHEN contains(t, '{s.strip('%')}') THEN '{n}'" for n, s in TOPICS)
    dims = ", ".join(DIMENSIONS)
    sql = f"""
    WITH m_d AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, CASE {cases} ELSE 'prose' END AS topic,
             len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
    m_c AS MATERIALIZED (SELECT {dims}, sum(n_tokens)::BIGINT AS tokens FROM m_d GROUP BY {dims}),
    r_0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS fitted, {', '.join(f'pow((sum(tokens) OVER (PARTITION BY {d}))::DOUBLE, {flatten}) AS t_{d}' for d in DIMENSIONS)} FROM m_c)"""
    n = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            n += 1
            sql += f""",
    r_{n} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(fitted) OVER (PARTITION BY {d}) > 0 THEN fitted * t_{d} / sum(fitted) OVER (PARTITION BY {d}) ELSE 0 END AS fitted) FROM r_{n - 1})"""
    return sql + f""",
    w_r AS (SELECT *, CASE WHEN tokens > 0 THEN fitted / tokens ELSE 0 END AS weight FROM r_{n}),
    w_s AS (SELECT *, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              sum(fitted) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w_r WHERE tokens > 0 WINDOW o AS (ORDER BY weight DESC, {dims})),
    w_f AS (SELECT ({share} * (SELECT sum(tokens) FROM w_s) - before) / rest AS scale FROM w_s WHERE ({share} * (SELECT sum(tokens) FROM w_s) - before) / rest * weight < 1 ORDER BY weight DESC, {dims} LIMIT 1)
    SELECT doc_id, source, lang, topic, n_tokens, round(weight, 9) AS weight, round(least(1.0, weight * scale), 6) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE / {1 << 48} < least(1.0, weight * scale) AS sampled
    FROM m_d JOIN w_r USING ({dims}) CROSS JOIN w_f"""
