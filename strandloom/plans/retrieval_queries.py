"""Retrieval, fusion and context queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import context, lexicon, retrieval, stats
from strandloom.sources import tables
from strandloom.sources.tables import table

TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({t}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) >= 2)"
K1, B, K = retrieval.K1, retrieval.B, retrieval.RRF_K


def docs(s, d):
    return table(s, d, "documents")


def questions(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def query_vector(s, d, vec: int = 0) -> list[float]:
    """One literal vector, as a caller would give it."""
    return list(table(s, d, "embeddings").filter(F.col("vec_id") == vec).first()["embedding"])


BM25 = f"""bm_t AS MATERIALIZED (SELECT doc_id, {TOKENS.format(t="coalesce(text, '')")} AS tokens FROM documents),
bm_l AS (SELECT doc_id, greatest(1, len(tokens)) AS len, tokens FROM bm_t),
bm_s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM bm_l),
bm_f AS MATERIALIZED (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(tokens) AS term FROM bm_l) GROUP BY ALL),
bm_d AS (SELECT term, count(*) AS df FROM bm_f GROUP BY term),
bm_q AS (SELECT query_id, term, count(*) AS n_query FROM (SELECT item_id AS query_id, unnest({TOKENS.format(t='text')}) AS term FROM benchmark) GROUP BY ALL),
bm AS MATERIALIZED (SELECT query_id, doc_id, round(sum(n_query * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * len / avg_len))), 9) AS score FROM bm_f JOIN bm_q USING (term) JOIN bm_d USING (term), bm_s GROUP BY ALL)"""
COS = """cs AS MATERIALIZED (SELECT vec_id AS id, ['passage', 'fact', 'schema', 'entity'][vec_id % 4 + 1] AS namespace, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS score FROM embeddings)"""


def q_bm25(s, d, top=10):
    out = retrieval.bm25(docs(s, d), questions(s, d), top)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def q_stats(s, d):
    tf = retrieval.term_frequencies(docs(s, d))
    return retrieval.document_frequencies(tf).join(tf.groupBy("term").agg(F.sum("tf").alias("n")), "term")


def q_slots(s, d):
    return retrieval.vector_slots(tables.vectors(s, d).drop("label"), query_vector(s, d), {"passage": 10, "fact": 10, "schema": 10}).select("namespace", "id", F.round("score", 6).alias("score"), "rank")


def q_top(s, d):
    return retrieval.vector_top(tables.vectors(s, d).drop("label"), query_vector(s, d), 10).select("id", "namespace", F.round("score", 6).alias("score"))


def q_threshold(s, d):
    return retrieval.vector_top(tables.vectors(s, d).drop("label"), query_vector(s, d), 10, "fact", 0.05).select("id", F.round("score", 6).alias("score"))


def q_over(s, d):
    return retrieval.vector_overfetch(tables.vectors(s, d).drop("label"), query_vector(s, d), 5, "schema", -1.0).select("id", F.round("score", 6).alias("score"))


def first_query(s, d):
    return retrieval.bm25(docs(s, d), questions(s, d).filter("query_id = 0"), 20)


def vector_hits(s, d):
    v = tables.vectors(s, d).select("id", "embedding")
    return retrieval.ranked(retrieval.vector_top(v, query_vector(s, d), 20).withColumn("g", F.lit(0)), "g", "id").select(F.col("id").alias("doc_id"), "score", "rank")


def q_hybrid(s, d):
    return retrieval.hybrid(vector_hits(s, d), first_query(s, d), "doc_id", 10).select("doc_id", F.round("rrf", 9).alias("rrf"), F.round("similarity", 6).alias("similarity"))


def federated_hits(s, d):
    """Each language is a database; its forty best documents by their best BM25 for any of the benchmark's questions."""
    h = retrieval.bm25(docs(s, d), questions(s, d)).groupBy("doc_id").agg(F.max("score").alias("score")).join(docs(s, d).select("doc_id", "lang", "source", "text"), "doc_id")
    r = retrieval.ranked(h, "lang", "doc_id").filter("rank <= 40")
    return r.select(F.col("lang").alias("db_id"), F.concat(F.lit("passage:"), F.col("doc_id").cast("string"), F.lit(":0")).alias("passage_id"), F.col("source").alias("source_url"), "text", "rank", F.lit(1.0).alias("weight"))


def q_federated(s, d):
    return retrieval.federate(federated_hits(s, d)).select("db_id", "passage_id", "rank", F.round("score", 9).alias("score"), "tokens")


def q_contributions(s, d):
    return stats.contributions(retrieval.federate(federated_hits(s, d)))


def q_federated_dedup(s, d):
    """All hits, no cap: the ratio allows each database everything."""
    out = retrieval.namespaced(retrieval.federate(federated_hits(s, d), ratio=1e6, top=25), ["passage_id"])
    return out.select("db_id", "passage_id", F.round("score", 9).alias("score"), "tokens")


FED = f"""WITH {BM25},
f_h AS (SELECT doc_id, max(score) AS score FROM bm GROUP BY doc_id),
f_r AS (SELECT lang AS db_id, 'passage:' || doc_id || ':0' AS passage_id, source, text, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM f_h JOIN documents USING (doc_id)),
f_s AS (SELECT db_id, passage_id, rank, round(1.0 / ({K} + rank), 12) AS score, ceil(length(text) / 4)::BIGINT AS tokens, source || '::' || substr(sha256(lower(trim(regexp_replace(text, '[\\s\\x{{A0}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g')))), 1, 16) AS k FROM f_r WHERE rank <= 40),
f_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, db_id, passage_id) AS rn FROM f_s) WHERE rn = 1)"""
# the greedy cap, row by row: what a database has used so far decides about its next hit
CAP = """,
g_o AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY score DESC, passage_id) AS i FROM f_d),
g_r AS (WITH RECURSIVE walk AS (SELECT db_id, i, CASE WHEN tokens <= 4800 THEN tokens ELSE 0 END AS used, tokens <= 4800 AS keep FROM g_o WHERE i = 1
  UNION ALL SELECT o.db_id, o.i, CASE WHEN w.used + o.tokens <= 4800 THEN w.used + o.tokens ELSE w.used END, w.used + o.tokens <= 4800 FROM walk w JOIN g_o o ON o.db_id = w.db_id AND o.i = w.i + 1) SELECT * FROM walk),
g AS (SELECT o.db_id, passage_id, rank, score, tokens FROM g_o o JOIN g_r r ON r.db_id = o.db_id AND r.i = o.i WHERE keep OR (SELECT count(DISTINCT db_id) FROM f_s) <= 1 ORDER BY score DESC, o.db_id, passage_id LIMIT 10)"""


def fact_hits(s, d):
    """Facts found by the terms of the first question's nation names: a fixed score per relation."""
    f = tables.facts(s, d).filter(F.col("relation") == "in_nation")
    return f.select("fact_id", "passage_id", F.round(F.length("tail_entity") / 20.0, 6).alias("score"))


def q_merge_full_text(s, d):
    p = first_query(s, d).select(F.concat(F.lit("passage:"), F.col("doc_id").cast("string"), F.lit(":0")).alias("passage_id"), "score")
    f = fact_hits(s, d)
    return retrieval.merge_full_text(p, f.select("fact_id", "score"), f.select("fact_id", "passage_id"), 10).select("passage_id", F.round("score", 6).alias("score"))


def layer_scores(s, d):
    """A score for every passage, fact and schema node, from its identifier."""
    from strandloom.operators import graph

    f, p = tables.facts(s, d), tables.passages(s, d)
    n = graph.project_nodes(f, tables.schemas(f), p)
    return n.select("node_id", (F.conv(F.substring(F.md5(F.col("node_id").cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)).alias("score"))


LAYERS = "ls AS MATERIALIZED (SELECT node_id, ('0x' || substr(md5(node_id), 1, 8))::BIGINT::DOUBLE / 4294967296 AS score FROM nodes)"


def q_layers(s, d):
    return retrieval.ranked_layers(layer_scores(s, d), 10, 200).select("node_id", F.round("score", 9).alias("score"), "rank")


def q_materialize(s, d):
    n = layer_scores(s, d).filter("score > 0.9 and node_id like 'passage:%'").unionByName(s.createDataFrame([("passage:passage:none:0", 2.0), ("passage:0:0", 1.5)], "node_id string, score double"))
    return retrieval.materialize(n, tables.passages(s, d).select("passage_id", "doc_id"), "passage_id", "passage:").select("doc_id", "rank")


def context_inputs(s, d, n=12):
    hits = first_query(s, d).join(docs(s, d).select("doc_id", "text"), "doc_id").filter(F.col("rank") <= n)
    f = tables.facts(s, d).filter("relation = 'in_region'")
    facts = retrieval.ranked(f.withColumn("g", F.lit(0)).withColumn("score", F.col("confidence")), "g", "fact_id").filter("rank <= 15")
    return hits.select("rank", "doc_id", F.substring("text", 1, 400).alias("text"), "score"), facts.select("rank", "doc_id", "head_entity", "relation", "tail_entity", "score")


P_IN = "p_in AS (SELECT rank, doc_id, substr(text, 1, 400) AS text, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE query_id = 0) JOIN documents USING (doc_id) WHERE rank <= 12)"
F_IN = "f_in AS (SELECT row_number() OVER (ORDER BY fact_id) AS rank, head_entity, relation, tail_entity, confidence AS score FROM facts WHERE relation = 'in_region' QUALIFY rank <= 15)"
PB = "p_b AS (SELECT rank, '[' || doc_id || '] ' || text || chr(10) || chr(10) AS block FROM p_in)"
FB = "f_b AS (SELECT rank, '- ' || head_entity || ' → ' || relation || ' → ' || tail_entity || chr(10) AS block FROM f_in)"


def context_sql(comparison: bool, limit: int = 800) -> str:
    first, second = ("f_b", "p_b") if comparison else ("p_b", "f_b")
    head = {"p_b": "'## Relevant Passages' || chr(10) || chr(10)", "f_b": "'## Key Facts' || chr(10) || chr(10)"}
    tail = {"p_b": "''", "f_b": "chr(10)"}
    share = 0.6 if comparison else 0.8
    part = lambda t, used: f"SELECT {head[t]} || coalesce(string_agg(block, '' ORDER BY rank), '') || {tail[t]} AS s FROM (SELECT *, {used} + sum(ceil(length(block) / 4)) OVER (ORDER BY rank) AS run FROM {t}) WHERE run <= {limit}"
    return f"""{tables.with_ctes('facts')}, {BM25}, {P_IN}, {F_IN}, {PB}, {FB},
    c1 AS ({part(first, '0')}), c2 AS ({part(second, '(SELECT ceil(length(s) / 4) FROM c1)')})
    SELECT (SELECT s FROM c1) || CASE WHEN (SELECT ceil(length(s) / 4) FROM c1) < {limit} * {share} THEN (SELECT s FROM c2) ELSE '' END AS context, least(1.0, (SELECT count(*) FROM p_in) * 0.3 + (SELECT count(*) FROM f_in) * 0.1)::DOUBLE AS confidence"""


def q_context(comparison):
    def run(s, d):
        p, f = context_inputs(s, d)
        return context.build_context(p, f, 800, comparison)

    return run


def q_simple_context(s, d):
    p, f = context_inputs(s, d)
    return context.simple_context(p, f).select("context", F.round("confidence", 6).alias("confidence"))


def q_alias_hints(s, d):
    p = table(s, d, "part")
    lines = p.select(F.col("p_partkey").cast("int").alias("rank"), F.concat(F.lit("- "), "p_name", F.lit(" ["), "p_type", F.lit("]")).alias("line"))
    return context.alias_hints(lines, 20_000).select("rank", "line", "running")


def q_template(s, d):
    p, f = context_inputs(s, d)
    return context.template_answer("What?", p, f).select("question", "answer", F.array_join("citations", ",").alias("citations"))


def q_vote(s, d):
    c = table(s, d, "conversations").select("conv_id", F.substring("text", 1, 1).alias("answer"), (F.col("turn") * 2 + (F.col("role") == "user").cast("int")).alias("pos"))
    return context.majority_vote(c, "conv_id", "answer", "pos")


def q_grounding(s, d):
    t = table(s, d, "conversations").join(docs(s, d).select(F.col("doc_id").alias("conv_id"), F.col("text").alias("passage")), "conv_id")
    return t.select("conv_id", "turn", context.grounded(F.array_join(F.slice(F.split("text", " "), 1, 2), " "), F.col("passage")).alias("grounded"))


REPLIES = (
    "Alpha was founded in 1990 while Beta came later.", "The former\nis older. The first of them has two.", "1. Alpha is 10\n2. Beta is 20", "Yes.", "On the Other Hand it may", "the butter thing", "", "Second was it", "1) a 2.b",
)
DECOMPOSITIONS = (
    '{"hop1SubQuestion": " Who wrote it? ", "hop2SubQuestion": "Where was {hop1Answer} born?", "bridgeEntityHint": " person "}', '{"hop1SubQuestion": "", "hop2SubQuestion": "x {hop1Answer}"}', "not json",
    '{"hop1SubQuestion": "a", "hop2SubQuestion": "b"}', "", '{"hop1SubQuestion": "Who is", "hop2SubQuestion": "WHO is {hop1Answer}"}', '{"hop1SubQuestion": 5, "hop2SubQuestion": "x {hop1Answer}"}',
    '{"hop1SubQuestion": "a", "hop2SubQuestion": "b {hop1Answer} {hop1Answer}", "bridgeEntityHint": ""}', '{"hop2SubQuestion": "x {hop1Answer}"}', "[1, 2]",
)


def quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def q_verify(s, d):
    """Turns of all conversations, and each followed by one of the fixed replies."""
    c = table(s, d, "conversations")
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("conv_id") + F.col("turn")).cast("int") % len(REPLIES) + 1)
    rows = c.select("conv_id", "turn", "text").unionByName(c.select("conv_id", (F.col("turn") + 1000).alias("turn"), reply.alias("text")))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), context.explicit_comparison("text").alias("explicit"))


def q_decompose(s, d):
    reply = F.element_at(F.array(*map(F.lit, DECOMPOSITIONS)), (F.col("conv_id") + F.col("turn")).cast("int") % len(DECOMPOSITIONS) + 1)
    return table(s, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), context.decomposition(reply).alias("r")).select("conv_id", "turn", "r.hop1", "r.hop2", "r.bridge_hint", "r.fallback_reason")


REPLY_SQL = lambda replies: f"[{', '.join(map(quoted, replies))}][((conv_id + turn) % {len(replies)} + 1)::INT]"
VERIFY = f"""SELECT conv_id, turn::BIGINT AS turn, coalesce(regexp_matches(t, '(?i)\\b(?:while|whereas|but|however|on the other hand)\\b') OR regexp_matches(t, '(?i)(?:entity|first|second|former|latter)\\b.*\\b(?:is|was|has|had)\\b')
    OR regexp_matches(t, '(?s)\\b\\d+[.)]\\s+\\w+.*\\b\\d+[.)]\\s+\\w+'), false) AS explicit FROM (SELECT conv_id, turn, text AS t FROM conversations UNION ALL SELECT conv_id, turn + 1000, {REPLY_SQL(REPLIES)} FROM conversations)"""
DECOMPOSE = f"""WITH c AS (SELECT conv_id, turn::BIGINT AS turn, {REPLY_SQL(DECOMPOSITIONS)} AS reply FROM conversations), v AS (SELECT *, CASE WHEN json_valid(reply) THEN reply::JSON END AS j FROM c),
    f AS (SELECT *, {', '.join(f"CASE WHEN json_type(j, '$.{n}') = 'VARCHAR' THEN trim(json_extract_string(j, '$.{n}')) END AS {a}" for n, a in (("hop1SubQuestion", "h1"), ("hop2SubQuestion", "h2"), ("bridgeEntityHint", "hint")))} FROM v),
    w AS (SELECT *, CASE WHEN j IS NULL THEN 'decomposition_parse_error' WHEN coalesce(h1, '') = '' OR coalesce(h2, '') = '' THEN 'decomposition_missing_field' WHEN NOT contains(h2, '{{hop1Answer}}') THEN 'decomposition_missing_placeholder'
    WHEN lower(h1) = lower(trim(replace(h2, '{{hop1Answer}}', ''))) THEN 'decomposition_duplicate_hops' END AS fallback_reason FROM f)
    SELECT conv_id, turn, CASE WHEN fallback_reason IS NULL THEN h1 END AS hop1, CASE WHEN fallback_reason IS NULL THEN h2 END AS hop2, CASE WHEN fallback_reason IS NULL AND hint <> '' THEN hint END AS bridge_hint, fallback_reason FROM w"""
GROUNDING = r"""WITH c AS (SELECT conv_id, turn, array_to_string(string_split(c.text, ' ')[1:2], ' ') AS answer, d.text AS passage FROM conversations c JOIN documents d ON d.doc_id = c.conv_id),
    n AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(coalesce(answer, '')), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(coalesce(passage, '')), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS p FROM c),
    w AS (SELECT *, list_filter(string_split(a, ' '), lambda x: length(x) > 1) AS w, string_split(p, ' ') AS pw FROM n)
    SELECT conv_id, turn, a <> '' AND (CASE WHEN length(a) <= 3 THEN contains(' ' || p || ' ', ' ' || a || ' ') ELSE contains(p, a) END OR (len(w) >= 2 AND len(list_filter(w, lambda x: list_contains(pw, x))) / len(w) >= 0.6)
    OR (len(w) <= 3 AND len(list_filter(w, lambda x: length(x) >= 4)) > 0 AND len(list_filter(w, lambda x: length(x) >= 4 AND NOT contains(p, x))) = 0)) AS grounded FROM w"""


def merged_facts(s, d):
    """Facts of the databases (languages) of their documents, by confidence within each; every fifth is also known to another one."""
    f = tables.facts(s, d).select("fact_id", "head_entity", "relation", "tail_entity", "confidence", F.concat(F.lit("db"), (F.length("fact_id") % 3).cast("string")).alias("db_id"))
    both = f.unionByName(f.filter(F.length("fact_id") % 5 == 0).withColumn("db_id", F.lit("db9")))
    return retrieval.ranked(both, "db_id", "fact_id", "confidence").select("db_id", "fact_id", "head_entity", "relation", "tail_entity", "rank", F.lit(1.0).alias("weight"))


def q_federated_facts(s, d):
    return retrieval.federate_facts(merged_facts(s, d)).select("db_id", "fact_id", F.round("score", 9).alias("score"))


def q_merged_context(s, d):
    p, f = context_inputs(s, d)
    return context.merged_context(p, f).select("context", F.round("confidence", 6).alias("confidence"))


MERGED_FACTS = f"""{tables.with_ctes('facts')}, b AS (SELECT fact_id, confidence, 'db' || length(fact_id) % 3 AS db_id FROM facts UNION ALL SELECT fact_id, confidence, 'db9' FROM facts WHERE length(fact_id) % 5 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY db_id ORDER BY confidence DESC, fact_id) AS rank FROM b), s AS (SELECT *, round(1.0 / ({K} + rank), 12) AS sc FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY sc DESC, db_id, rank) AS rn FROM s) SELECT db_id, fact_id, round(sc, 9) AS score FROM o WHERE rn = 1 ORDER BY sc DESC, db_id, fact_id LIMIT 10"""


def q_match_rate(s, d):
    b = retrieval.bm25(docs(s, d), questions(s, d), 10)
    return stats.match_rate(b.filter("rank <= 5"), b.filter("rank > 2"), "query_id", "doc_id")


def q_checks(s, d):
    """Broken rules of a BM25 result, by rule: none."""
    b = retrieval.bm25(docs(s, d), questions(s, d), 10)
    parts = {"unique": stats.check_unique(b, "query_id", "doc_id"), "order": stats.check_order(b, "query_id", "doc_id"), "ranks": stats.check_ranks(b, "query_id"), "range": stats.check_range(b, "score", 0, 1e6), "limit": stats.check_limit(b, "query_id", 10)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("broken")).select(F.lit(name).alias("rule"), "broken")
        out = row if out is None else out.unionByName(row)
    return out


def q_timings(s, d):
    return stats.timings(table(s, d, "events"), "event_type", "value")


def q_metrics(s, d):
    e = table(s, d, "events").select(F.lit(1).cast("long").alias("candidates"), F.round("value", 6).alias("latency_ms"), F.array("event_type").alias("expanded"), (F.col("user_id") % 7 == 0).alias("fallback"))
    return stats.merge_metrics(e).select("candidates", "latency_ms", F.array_join("expanded", ",").alias("expanded"), "fallback", "iterations", "converged")


def q_phrase_match(s, d):
    """Words of the corpus as dictionary: the benchmark texts' first two words as entries, found in all documents."""
    b = table(s, d, "benchmark")
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^a-z0-9_#'\-]+", " ")), " ")
    e = b.select(F.concat_ws(" ", w[0], w[1]).alias("term"), w[2].alias("canonical"), F.array(w[3]).alias("aliases"), (F.col("item_id") % 20).alias("frequency"), F.lit(0.75).alias("confidence")).dropDuplicates(["term"])
    m = lexicon.match_phrases(docs(s, d), e, longest=2)
    return m.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.sum("boost"), 6).alias("boost"))


QUERIES = {
    "top3_bm25": (q_bm25, f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 10"),
    "agg19_corpus_stats": (q_stats, f"WITH {BM25} SELECT term, count(*) AS df, sum(tf)::BIGINT AS n FROM bm_f GROUP BY term"),
    "agg19_lengths": (lambda s, d: retrieval.corpus_stats(docs(s, d)).select("n", F.round("avg_len", 6).alias("avg_len")), f"WITH {BM25} SELECT n, round(avg_len, 6) AS avg_len FROM bm_s"),
    "top1_cosine": (q_top, f"WITH {COS} SELECT id, namespace, round(score, 6) AS score FROM cs ORDER BY cs.score DESC, id LIMIT 10"),
    "flt2_threshold": (q_threshold, f"WITH {COS} SELECT id, round(score, 6) AS score FROM cs WHERE namespace = 'fact' AND cs.score >= 0.05 ORDER BY cs.score DESC, id LIMIT 10"),
    "top2_overfetch": (q_over, f"WITH {COS} SELECT id, round(score, 6) AS score FROM (SELECT * FROM cs ORDER BY score DESC, id LIMIT 50) WHERE namespace = 'schema' ORDER BY 2 DESC, id LIMIT 5"),
    "top6_vector_slots": (q_slots, f"WITH {COS} SELECT namespace, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, id) AS rank FROM cs WHERE namespace <> 'entity') WHERE rank <= 10"),
    "top4_full_text_merge": (q_merge_full_text, f"""{tables.with_ctes('facts')}, {BM25}, p AS (SELECT 'passage:' || doc_id || ':0' AS passage_id, score FROM bm WHERE query_id = 0 ORDER BY score DESC, doc_id LIMIT 20), f AS (SELECT passage_id, round(length(tail_entity) / 20, 6) AS score FROM facts WHERE relation = 'in_nation' ORDER BY 2 DESC, fact_id LIMIT 30) SELECT passage_id, round(max(score), 6) AS score FROM (SELECT * FROM p UNION ALL SELECT * FROM f) GROUP BY passage_id ORDER BY max(score) DESC, passage_id LIMIT 10"""),
    "top5_hybrid_rrf": (q_hybrid, f"""WITH {BM25}, {COS}, v AS (SELECT id AS doc_id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 20), l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm WHERE query_id = 0 QUALIFY rank <= 20), u AS (SELECT doc_id, round(sum(1.0 / ({K} + rank)), 12) AS rrf FROM (SELECT doc_id, rank FROM v UNION ALL SELECT doc_id, rank FROM l) GROUP BY 1) SELECT doc_id, round(rrf, 9) AS rrf, round(coalesce(score, rrf * 0.7), 6) AS similarity FROM u LEFT JOIN v USING (doc_id) ORDER BY u.rrf DESC, doc_id LIMIT 10"""),
    "top7_federated_cap": (q_federated, FED + CAP + " SELECT db_id, passage_id, rank::INT AS rank, round(score, 9) AS score, tokens FROM g"),
    "agg20_contributions": (q_contributions, FED + CAP + " SELECT db_id, count(*) AS n FROM g GROUP BY 1"),
    "top7_federated_dedup": (q_federated_dedup, FED + " SELECT db_id, db_id || ':' || passage_id AS passage_id, round(score, 9) AS score, tokens FROM f_d ORDER BY f_d.score DESC, db_id, f_d.passage_id LIMIT 25"),
    "top8_ranked_layers": (q_layers, f"""{tables.with_ctes('nodes')}, {LAYERS} SELECT node_id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT *, node_id LIKE 'passage:%' AS p, row_number() OVER (PARTITION BY node_id LIKE 'passage:%' ORDER BY score DESC, node_id) AS rank FROM ls) WHERE rank <= CASE WHEN p THEN 10 ELSE 200 END AND (p OR node_id LIKE 'fact:%')"""),
    "top9_jn5_materialize": (q_materialize, f"""{tables.with_ctes('nodes')}, {LAYERS}, n AS (SELECT node_id, score FROM ls WHERE score > 0.9 AND node_id LIKE 'passage:%' UNION ALL SELECT 'passage:0:0', 1.5) SELECT doc_id, row_number() OVER (ORDER BY score DESC, node_id)::INT AS rank FROM n JOIN passages p ON n.node_id = p.passage_id OR n.node_id = 'passage:' || p.passage_id"""),
    "win1_context": (q_context(False), context_sql(False)),
    "win1_context_comparison": (q_context(True), context_sql(True)),
    "win2_alias_hints": (q_alias_hints, "SELECT rank::INT AS rank, line, running::BIGINT AS running FROM (SELECT p_partkey AS rank, '- ' || p_name || ' [' || p_type || ']' AS line, sum(ceil(length('- ' || p_name || ' [' || p_type || ']') / 4)) OVER (ORDER BY p_partkey) AS running FROM part) WHERE running <= 2000"),
    "win4_simple_context": (q_simple_context, f"""{tables.with_ctes('facts')}, {BM25}, {P_IN}, {F_IN} SELECT (SELECT string_agg('Passage: ' || text, chr(10) ORDER BY rank) FROM p_in) || chr(10) || (SELECT string_agg('Fact: ' || head_entity || ' ' || relation || ' ' || tail_entity, chr(10) ORDER BY rank) FROM f_in) AS context, round(greatest((SELECT max(score) FROM p_in), (SELECT max(score) FROM f_in)), 6) AS confidence"""),
    "qa2_template_answer": (q_template, f"""{tables.with_ctes('facts')}, {BM25}, {P_IN}, {F_IN}, sn AS (SELECT string_agg(CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 159) || '…' END, ' ' ORDER BY rank) AS a, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS c FROM p_in WHERE rank <= 3), e AS (SELECT n, min(rank * 2 + p) AS f FROM (SELECT head_entity AS n, rank, 0 AS p FROM f_in UNION ALL SELECT tail_entity, rank, 1 FROM f_in) GROUP BY n ORDER BY f, n LIMIT 8) SELECT 'What?' AS question, a || ' Entities: ' || (SELECT string_agg(n, ', ' ORDER BY f, n) FROM e) AS answer, c AS citations FROM sn"""),
    "agg18_majority_vote": (q_vote, """SELECT conv_id, answer, votes FROM (SELECT conv_id, norm, count(*) AS votes, min(pos) AS first, arg_min(answer, pos) AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(pos)) AS rn FROM (SELECT conv_id, substr(text, 1, 1) AS answer, lower(trim(substr(text, 1, 1))) AS norm, turn * 2 + (role = 'user')::INT AS pos FROM conversations) WHERE norm <> '' GROUP BY conv_id, norm) WHERE rn = 1"""),
    "qa3_verification": (q_verify, VERIFY),
    "qa4_decomposition": (q_decompose, DECOMPOSE),
    "qa5_grounding": (q_grounding, GROUNDING),
    "top7_federated_facts": (q_federated_facts, MERGED_FACTS),
    "top7_merged_context": (q_merged_context, f"""{tables.with_ctes('facts')}, {BM25}, {P_IN}, {F_IN} SELECT (SELECT string_agg('Passage: ' || text, chr(10) ORDER BY rank) FROM p_in) || chr(10) || (SELECT string_agg('Fact: ' || head_entity || ' ' || relation || ' ' || tail_entity, chr(10) ORDER BY rank) FROM f_in) AS context, round((SELECT score FROM p_in WHERE rank = 1), 6) AS confidence"""),
    "agg22_match_rate": (q_match_rate, f"""WITH {BM25}, r AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) SELECT query_id, round(count(*) FILTER (rank > 2) / greatest(count(*), 1), 6) AS match_rate FROM r WHERE rank <= 5 GROUP BY query_id"""),
    "contract_checks": (q_checks, "SELECT unnest(['unique', 'order', 'ranks', 'range', 'limit']) AS rule, 0::BIGINT AS broken"),
    "agg21_timings": (q_timings, "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "agg20_metrics": (q_metrics, "SELECT count(*) AS candidates, max(round(value, 6)) AS latency_ms, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS expanded, bool_or(user_id % 7 = 0) AS fallback, 0 AS iterations, true AS converged FROM events"),
    "dict1_phrase_match": (
        q_phrase_match,
        r"""WITH b AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9_#''\-]+', ' ', 'g')), ' ') AS w FROM benchmark), e AS (SELECT w[1] || ' ' || w[2] AS term, min(item_id) AS item_id, first(w[3] ORDER BY item_id) AS canonical, first(w[4] ORDER BY item_id) AS alias FROM b GROUP BY 1),
        t AS MATERIALIZED (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_#''\-]+'), lambda x: x <> ''), ' ') || ' ' AS t FROM documents),
        m AS (SELECT term, e.item_id % 20 AS f FROM t JOIN e ON contains(t, ' ' || term || ' ') OR contains(t, ' ' || canonical || ' ') OR contains(t, ' ' || alias || ' ')) SELECT term, count(*) AS n_docs, round(sum(1.75 + least(f, 10) / 10), 6) AS boost FROM m GROUP BY term""",
    ),
}
