"""Lexical, vector and fused retrieval: BM25, exact cosine, rank fusion, federated merge."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import ids, text

K1, B = 1.2, 0.75
RRF_K = 60
#: Tables with a row per query term are broadcast up to so many rows; beyond it the joins are ordinary ones.
BROADCAST_TERMS = 200_000
#: Stands for a document among its terms; no term is a single space.
MARK = " "


# --- BM25 ------------------------------------------------------------------------------------------------------------


def term_frequencies(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """AGG-19: (key, term, tf, len); a document's length is its number of tokens, 1 at least."""
    t = docs.select(key, text.lexical_tokens(F.coalesce(body, F.lit(""))).alias("tokens"))
    t = t.select(key, F.greatest(F.lit(1), F.size("tokens")).alias("len"), F.explode("tokens").alias("term"))
    return t.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, body: str = "text") -> DataFrame:
    """AGG-19: number of documents and mean length."""
    n = F.greatest(F.lit(1), F.size(text.lexical_tokens(F.coalesce(body, F.lit("")))))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("avg_len"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25(docs: DataFrame, queries: DataFrame, top: int | None = None, key: str = "doc_id", k1: float = K1, b: float = B) -> DataFrame:
    """TOP-3: BM25 of every document that shares a term with a query (query_id, query_text); repeated query terms count again.

    Documents are scanned once: the terms that a query asks for and one marker per document are dealt by document, and frequencies,
    document frequencies and corpus statistics all read that one exchange, whose plan is therefore the same for the three.
    Scores of a document are summed where its terms are. Tables on query terms are broadcast up to ``BROADCAST_TERMS`` rows.
    Ties go to the lower document id; scores are rounded to 9 digits so that equal sums tie.
    """
    q = queries.select("query_id", F.explode(text.lexical_tokens("query_text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("n_query"))
    small = F.broadcast if q.count() <= BROADCAST_TERMS else lambda df: df
    mark = queries.sparkSession.createDataFrame([(MARK,)], "term string")
    t = docs.select(key, text.lexical_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    t = t.select(key, F.greatest(F.lit(1), F.size("tokens")).alias("len"), F.explode(F.concat("tokens", F.array(F.lit(MARK)))).alias("term"))
    t = t.join(small(q.select("term").union(mark).distinct()), "term").repartition(key)
    # a condition inside the sums, since a filter would be moved below the exchange
    stats = t.agg(F.sum(F.when(F.col("term") == MARK, 1)).alias("n"), F.avg(F.when(F.col("term") == MARK, F.col("len"))).alias("avg_len"))
    tf = t.groupBy(key, "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = document_frequencies(tf)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    per_query = q.join(small(df), "term").join(F.broadcast(stats)).select("term", "query_id", "avg_len", (idf * F.col("n_query") * (k1 + 1)).alias("part"))
    weight = F.col("part") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    out = tf.join(small(per_query), "term").groupBy("query_id", key).agg(F.round(F.sum(weight), 9).alias("score"))
    return out if top is None else ranked(out, "query_id", key).filter(F.col("rank") <= top)


def ranked(df: DataFrame, by: str, key: str, score: str = "score") -> DataFrame:
    """Adds ``rank`` from 1 within ``by``: finite scores first, highest first, then by key."""
    order = [(F.isnan(score) | F.col(score).isNull() | (F.abs(score) == float("inf"))).asc(), F.col(score).desc(), F.col(key).asc()]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def merge_full_text(passage_hits: DataFrame, fact_hits: DataFrame, evidence: DataFrame, k: int) -> DataFrame:
    """TOP-4: a passage's score is the higher of its own and its facts'; each branch gives 3k hits."""
    p = passage_hits.orderBy(F.col("score").desc(), "passage_id").limit(3 * k)
    f = fact_hits.orderBy(F.col("score").desc(), "fact_id").limit(3 * k).join(evidence, "fact_id").select("passage_id", "score")
    return p.select("passage_id", "score").unionByName(f).groupBy("passage_id").agg(F.max("score").alias("score")).orderBy(F.col("score").desc(), "passage_id").limit(k)


# --- vectors ---------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_scores(vectors: DataFrame, query: list[float], threshold: float | None = None) -> DataFrame:
    """TOP-1, FLT-2: cosine of every vector with a literal query; 0 where lengths differ or a norm is 0. Scores to 9 digits."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(x * x for x in query) ** 0.5
    e = F.col("embedding")
    score = F.when((F.size(e) != len(query)) | (F.lit(norm) == 0) | (dot(e, e) == 0), 0.0).otherwise(dot(e, q) / (F.sqrt(dot(e, e)) * norm))
    out = vectors.withColumn("score", F.round(score, 9)).drop("embedding")
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def vector_top(vectors: DataFrame, query: list[float], k: int, namespace: str | None = None, threshold: float | None = None) -> DataFrame:
    """TOP-1: the k nearest, ties by id; filters reach the scan."""
    v = vectors if namespace is None else vectors.filter(F.col("namespace") == namespace)
    return cosine_scores(v, query, threshold).orderBy(F.col("score").desc(), "id").limit(k)


def vector_slots(vectors: DataFrame, query: list[float], slots: dict[str, int], threshold: float | None = None) -> DataFrame:
    """TOP-6: the nearest of each namespace, each with its own k, in one pass."""
    s = cosine_scores(vectors.filter(F.col("namespace").isin(*slots)), query, threshold)
    k = F.coalesce(*[F.when(F.col("namespace") == n, F.lit(v)) for n, v in slots.items()])
    # the literal bound lets each task keep only its best of a namespace before the shuffle
    return ranked(s, "namespace", "id").filter(F.col("rank") <= max(slots.values())).filter(F.col("rank") <= k)


def vector_overfetch(vectors: DataFrame, query: list[float], k: int, namespace: str, threshold: float, factor: int = 10) -> DataFrame:
    """TOP-2: the ``factor`` * k nearest of all, of which those of the namespace and over the threshold, k at most."""
    wide = cosine_scores(vectors, query).orderBy(F.col("score").desc(), "id").limit(factor * k)
    return wide.filter((F.col("namespace") == namespace) & (F.col("score") >= threshold)).orderBy(F.col("score").desc(), "id").limit(k)


# --- fusion ----------------------------------------------------------------------------------------------------------


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over ranked lists (key, rank)."""
    rows = None
    for df in lists:
        part = df.select(key, (1.0 / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.round(F.sum("part"), 12).alias("rrf"))


def hybrid(vector_hits: DataFrame, lexical_hits: DataFrame, key: str, top: int) -> DataFrame:
    """TOP-5: fused order; a hit's similarity is its cosine if it has one, else 0.7 of its fused score."""
    fused = rrf([vector_hits, lexical_hits], key).join(vector_hits.select(key, F.col("score").alias("cosine")), key, "left")
    out = fused.select(key, "rrf", F.coalesce("cosine", F.col("rrf") * 0.7).alias("similarity"))
    return out.orderBy(F.col("rrf").desc(), key).limit(top)


def federate(hits: DataFrame, budget: int = 8000, ratio: float = 0.6, top: int = 10, k: int = RRF_K) -> DataFrame:
    """TOP-7: hits (db_id, passage_id, source_url, text, rank, weight) of several databases as one list.

    Score weight / (k + rank); of equal passages the best stays; with more than one database each may give at most
    ``ratio`` of the token budget, greedily, skipping what no longer fits; then the global top. The greedy skip is sequential
    within a database and runs over that database's hits (a ranked list whose length the caller bounds).
    """
    limit = int(budget * ratio)
    h = hits.withColumn("score", F.round(F.col("weight") / (k + F.col("rank")), 12)).withColumn("dedup", ids.passage_dedup_key("source_url", "text")).withColumn("tokens", text.context_tokens("text"))
    best = Window.partitionBy("dedup").orderBy(F.col("score").desc(), "db_id", "passage_id")
    h = h.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
    several = hits.agg(F.countDistinct("db_id").alias("n_db"))
    h = h.select("db_id", "passage_id", "rank", "score", "tokens").join(F.broadcast(several))

    def cap(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "passage_id"], ascending=[False, True])
        used, keep = 0, []
        for tokens, n in zip(pdf.tokens, pdf.n_db, strict=True):
            ok = n <= 1 or used + tokens <= limit
            used += tokens if ok else 0
            keep.append(ok)
        return pdf[keep][["db_id", "passage_id", "rank", "score", "tokens"]]

    capped = h.groupBy("db_id").applyInPandas(cap, "db_id string, passage_id string, rank int, score double, tokens long")
    return capped.orderBy(F.col("score").desc(), "db_id", "passage_id").limit(top)


def federate_facts(facts: DataFrame, top: int = 10, k: int = RRF_K) -> DataFrame:
    """TOP-7: facts (db_id, fact_id, ..., rank, weight) of several databases: of equal ids the best score stays, then the global top; no cap."""
    scored = facts.withColumn("score", F.round(F.col("weight") / (k + F.col("rank")), 12))
    best = Window.partitionBy("fact_id").orderBy(F.col("score").desc(), "db_id", "rank")
    once = scored.withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn", "weight")
    return once.orderBy(F.col("score").desc(), "db_id", "fact_id").limit(top)


def namespaced(df: DataFrame, columns: list[str], db: str = "db_id") -> DataFrame:
    """Federated identifiers: ``{db}:{id}``."""
    return df.withColumns({c: F.concat_ws(":", F.col(db), F.col(c)) for c in columns})


def ranked_layers(scores: DataFrame, top_k: int, top_m: int) -> DataFrame:
    """TOP-8: the best passages, and the best nodes of all other layers together; facts are taken from these only after the cut."""
    is_passage = F.col("node_id").startswith("passage:")
    best = lambda part, n: ranked(scores.filter(part).orderBy(F.col("score").desc(), "node_id").limit(n).withColumn("slot", F.lit(0)), "slot", "node_id").drop("slot")
    return best(is_passage, top_k).unionByName(best(~is_passage, top_m).filter(F.col("node_id").startswith("fact:")))


def materialize(ranked_nodes: DataFrame, items: DataFrame, key: str, prefix: str) -> DataFrame:
    """JN-5, TOP-9: items of ranked nodes, looked up without and then with the layer prefix; ranks run over what was found."""
    bare = F.regexp_replace("node_id", f"^{prefix}", "")
    # an id such as passage:passage:1 keeps one prefix after stripping, and a bare one is found as it is
    one = ranked_nodes.withColumn(key, bare).join(items, key).withColumn("__pref", F.lit(0))
    two = ranked_nodes.withColumn(key, F.col("node_id")).join(items, key).withColumn("__pref", F.lit(1))
    both = one.unionByName(two).withColumn("rn", F.row_number().over(Window.partitionBy("node_id").orderBy("__pref"))).filter("rn = 1").drop("rn", "__pref")
    return both.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "node_id")))
