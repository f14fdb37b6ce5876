"""Memory, lexicon, thesaurus, storage and ingestion queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import ids, text
from strandloom.operators import context, extraction, lexicon, memory, providers, stats
from strandloom.plans.graph_queries import RELATIONS, edges, nodes, relations
from strandloom.sources import store, tables
from strandloom.sources.tables import table, with_ctes
from strandloom.streaming import ingest

TERM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


def facts(s, d):
    return tables.facts(s, d)


# --- memory ----------------------------------------------------------------------------------------------------------


def candidates(s, d):
    f = facts(s, d)
    return f.select("schema_id", F.lower("head_type").alias("head_type"), "relation", F.lower("tail_type").alias("tail_type"), F.lit(1).cast("long").alias("frequency"), F.col("head_type").alias("alias"), F.col("doc_id").alias("pos"), "doc_id")


def q_group(s, d):
    return memory.group_schemas(candidates(s, d)).select("schema_id", "frequency", F.array_join("aliases", ",").alias("aliases"), F.size("doc_ids").cast("long").alias("n_docs"), "consistent")


def q_fold(s, d):
    f = facts(s, d).select("fact_id", "schema_id", "head_entity", "head_type", "relation", "tail_entity", "tail_type", "confidence", "passage_id", "doc_id")
    twice = f.unionByName(f.filter("doc_id % 2 = 0").withColumn("confidence", F.lit(0.99)).withColumn("passage_id", F.lit("passage:again:0")).withColumn("tail_type", F.when(F.col("doc_id") % 4 == 0, "Other").otherwise(F.col("tail_type"))))
    return memory.fold_facts(twice).select("fact_id", "confidence", F.array_join("passage_ids", ",").alias("passage_ids"), F.array_join("doc_ids", ",").alias("doc_ids"), "consistent")


def old_and_new(s, d):
    """Contributions of the first half of the documents, and of all."""
    f = facts(s, d)
    seen = memory.contributions(f.filter("doc_id % 2 = 0"))
    return f, seen


def q_contributions(s, d):
    f, seen = old_and_new(s, d)
    return memory.contributions(f, seen).groupBy("schema_id").agg(F.count(F.lit(1)).alias("n"))


def q_stabilize(s, d):
    f, seen = old_and_new(s, d)
    rare = s.createDataFrame([("schema:rare", 1, "pending"), ("schema:kept", 1, "stable")], "schema_id string, frequency long, state string")
    none = rare.limit(0)
    old = memory.stabilize(none, seen.filter("doc_id < 2")).drop("newly_stable").unionByName(rare)
    return memory.stabilize(old, memory.contributions(f, seen.filter("doc_id < 2")))


def q_activate(s, d):
    f = facts(s, d)
    return memory.activate(f, tables.schemas(f, 500)).groupBy("relation", "state").agg(F.count(F.lit(1)).alias("n"))


def q_conflicts(s, d):
    c = tables.conflict_facts(s, d)
    out = memory.conflicts(c.filter("fact_id like '%:1'"), c)
    return out.select("fact_id", "other_id", "conflict_type")


def q_conflict_sets(s, d):
    """Every fact as a new one against the first hundred active ones."""
    c = tables.conflict_facts(s, d)
    return memory.conflict_sets(c, c).select("fact_id", "conflict_type", F.array_join("others", ",").alias("others"))


def q_window(s, d):
    return memory.active_window(facts(s, d)).select("fact_id")


def q_resolve(s, d):
    c = tables.conflict_facts(s, d)
    conf = table(s, d, "lineitem").select(F.concat_ws(":", F.lit("cf"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("fact_id"), F.col("l_discount").alias("confidence"))
    r = memory.resolve(memory.conflicts(c.filter("fact_id like '%:1'"), c), conf)
    return r.groupBy("resolution").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("inactivated")).alias("inactivated"))


def q_parse(s, d):
    t = F.col("turn") % 4
    reply = F.when(t == 0, '{"resolution": "keep_new", "confidence": 0.9}').when(t == 1, "no json").when(t == 2, '{"resolution": "other", "confidence": 0.9}').otherwise('{"resolution": "discard_both"}')
    c = table(s, d, "conversations").select(memory.parse_resolution(reply).alias("r"))
    return c.groupBy("r.resolution", "r.confidence").agg(F.count(F.lit(1)).alias("n"))


def q_apply(s, d):
    f = tables.conflict_facts(s, d)
    some = memory.conflicts(f.filter("fact_id like '%:1'"), f).filter("conflict_type = 'temporal'")
    res = some.select("fact_id", F.array("fact_id").alias("inactivated"))
    return memory.apply_resolutions(f, res).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def q_delete(s, d):
    f = facts(s, d)
    p, sc = tables.passages(s, d), tables.schemas(f)
    left = memory.delete_document(3, p, f, sc.select("schema_id", "frequency", "state"))
    one = lambda n: left[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("part"), "n")
    freq = left["schemas"].agg(F.sum("frequency").alias("n")).select(F.lit("frequency").alias("part"), "n")
    return one("passages").unionByName(one("facts")).unionByName(freq)


def q_replace(s, d):
    f = facts(s, d)
    p, sc = tables.passages(s, d), tables.schemas(f).select("schema_id", "frequency", "state")
    new_f = f.filter("doc_id = 3 and relation = 'placed'")
    left = memory.replace_document(3, p, f, sc, p.filter("doc_id = 3").withColumn("text", F.lit("new text")), new_f)
    return left["schemas"].select("schema_id", "frequency", "state")


def q_integrity(s, d):
    f, p = facts(s, d), tables.passages(s, d)
    sc = tables.schemas(f).filter("relation <> 'in_region'")
    n = nodes(s, d).filter("layer <> 'schema'")
    links = f.select("fact_id", "passage_id")
    return memory.integrity(sc, f.filter("doc_id <> 5"), p.filter("doc_id <> 4"), links, n, edges(s, d).filter("relation = 'schema_instance'"))


def q_contract(s, d):
    rules = {"id": "fact_id like 'fact:%' and octet_length(fact_id) <= 4096", "confidence": "confidence between 0 and 0.9", "document": "doc_id >= 10"}
    return memory.violations(facts(s, d), rules).select("fact_id", F.array_join("violations", ",").alias("violations"))


def q_snapshot(s, d):
    return store.snapshot(facts(s, d), tables.passages(s, d)).select("passage_id", F.size("fact_ids").cast("long").alias("n_facts"), F.array_min("fact_ids").alias("first_fact"))


def q_by_ids(s, d):
    ask = ["passage:5:0", "passage:1:0", "", "passage:none:0", "passage:5:0", "x" * 5000, "passage:0:0"]
    found = store.by_ids(tables.passages(s, d), "passage_id", ask)
    return found.select("doc_id", F.row_number().over(Window.orderBy("pos")).cast("long").alias("place"))


def q_by_entities(s, d):
    return store.facts_by_entities(facts(s, d), ["nation_3", "EUROPE", "order_7"], limit=200).select("fact_id")


def q_sections(s, d):
    f = facts(s, d)
    return store.section_counts(tables.schemas(f), f, tables.passages(s, d))


def q_counts(s, d):
    f = facts(s, d).withColumn("state", F.when(F.col("doc_id") % 3 == 0, "inactive").otherwise("active"))
    return stats.corpus_counts({"passages": tables.passages(s, d), "facts": f, "schemas": tables.schemas(f, 500)})


def q_audit(s, d):
    e = table(s, d, "events").select(F.when(F.col("event_id") % 5 == 0, "broken").otherwise(F.to_json(F.struct(F.col("event_type").alias("resolutionState")))).alias("detail"))
    return stats.conflict_distribution(e)


# --- lexicon ---------------------------------------------------------------------------------------------------------


def evidence(s, d):
    """Frequency evidence of the facts, and part names as aliases of their brand."""
    p = table(s, d, "part")
    alias = p.select(F.lit("corpus").alias("corpus_id"), text.english_key("p_brand").alias("entity"), F.col("p_type").alias("surface"), F.lit("alias").alias("evidence_type"), F.lit("").alias("related"), (F.col("p_partkey") % 10).alias("doc_id"), F.round(F.col("p_size") / 50.0, 6).alias("confidence"), F.lit(None).cast("string").alias("passage_id"))
    return lexicon.evidence(facts(s, d)).unionByName(lexicon.upsert_evidence(alias))


EVIDENCE = f"""ev AS MATERIALIZED (SELECT 'corpus' AS corpus_id, {TERM.format('n')} AS entity, n AS surface, 'frequency' AS evidence_type, '' AS related, doc_id, count(*) AS occurrences, max(confidence) AS confidence, min(passage_id) AS passage_id
FROM (SELECT head_entity AS n, doc_id, passage_id, confidence FROM facts UNION ALL SELECT tail_entity, doc_id, passage_id, confidence FROM facts) GROUP BY ALL
UNION ALL SELECT 'corpus', {TERM.format('p_brand')}, p_type, 'alias', '', p_partkey % 10, count(*), max(round(p_size / 50.0, 6)), NULL FROM part GROUP BY ALL)"""
DICT = f"""su AS (SELECT entity, surface, sum(occurrences) AS n FROM ev GROUP BY ALL), sr AS (SELECT *, row_number() OVER w AS rn, first(surface) OVER w AS canonical FROM su WINDOW w AS (PARTITION BY entity ORDER BY n DESC, surface)),
di AS MATERIALIZED (SELECT entity, max(canonical) AS canonical, list_sort(list_distinct(list(surface) FILTER ({TERM.format('surface')} <> {TERM.format('canonical')}))) AS aliases FROM sr GROUP BY entity),
dt AS MATERIALIZED (SELECT entity, sum(occurrences) FILTER (evidence_type = 'frequency') AS frequency, max(confidence) AS confidence FROM ev GROUP BY entity),
dic AS MATERIALIZED (SELECT 'lex:corpus:' || entity AS term_id, entity, canonical, coalesce(aliases, []) AS aliases, coalesce(frequency, 0)::BIGINT AS frequency, confidence FROM di JOIN dt USING (entity))"""
LEX = f"{with_ctes('facts')}, {EVIDENCE}, {DICT}"
AMB = "amb AS MATERIALIZED (SELECT lower(surface) AS surface FROM ev GROUP BY 1 HAVING count(DISTINCT entity) > 1)"


def q_evidence(s, d):
    return evidence(s, d).groupBy("entity", "evidence_type").agg(F.sum("occurrences").alias("occurrences"), F.round(F.max("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("rows"), F.min("passage_id").alias("passage_id"))


def q_dictionary(s, d):
    return lexicon.dictionary(evidence(s, d)).select("term_id", "canonical", F.array_join("aliases", "|").alias("aliases"), "frequency", F.round("confidence", 6).alias("confidence"))


def q_stop(s, d):
    return lexicon.stopword_entities(lexicon.dictionary(evidence(s, d)))


def q_prune(s, d):
    ev = evidence(s, d)
    return lexicon.prune_aliases(lexicon.dictionary(ev), lexicon.ambiguous_surfaces(ev)).filter("removed > 0").select("term_id", "removed", F.array_join("aliases", "|").alias("aliases"))


def q_thesaurus(s, d):
    ev = evidence(s, d)
    e = lexicon.dictionary(ev)
    al = ev.filter("evidence_type = 'alias'").groupBy("corpus_id", "entity", "surface").agg(F.max("confidence").alias("confidence"))
    n, r = table(s, d, "nation"), table(s, d, "region")
    hyp = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("corpus").alias("corpus_id"), F.col("n_name").alias("entity"), F.col("r_name").alias("hypernym"), F.lit(0.8).alias("confidence"))
    return lexicon.recompute_thesaurus(e, al, hyp, lexicon.stopword_entities(e, 0.001), lexicon.ambiguous_surfaces(ev)).select("relation_id", "relation_type", F.round("weight", 6).alias("weight"), "bidirectional")


def q_stats(s, d):
    e = lexicon.dictionary(evidence(s, d)).join(lexicon.domain_categories(facts(s, d)), "entity", "left").withColumn("category", F.coalesce("category", F.lit("general")))
    return stats.dictionary_stats(e)


def q_cooccur(s, d):
    return lexicon.cooccurring(facts(s, d), 2, 0.0).select("a", "b", "n")


def q_suggest(s, d):
    t = table(s, d, "part").select(F.explode(F.split("p_type", " ")).alias("term"))
    return lexicon.suggest_candidates(t, 40).select("term", "frequency", F.round("confidence", 6).alias("confidence"), "status")


def q_api(s, d):
    p = table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("paper_id"), F.col("source").alias("domain"), "text")
    a = lexicon.api_dictionary(p, "corpus").filter("frequency >= 3")
    return a.select("term_id", "term", "frequency", F.round("confidence", 6).alias("confidence"))


def q_text_evidence(s, d):
    return lexicon.text_evidence(tables.passages(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def q_resolve_pairs(s, d):
    pairs = table(s, d, "part").select(F.lit("p").alias("passage_id"), F.lit("apposition").alias("kind"), F.col("p_brand").alias("left"), F.concat(F.lit("NATION_"), F.col("p_partkey") % 30).alias("right"))
    counts = lexicon.dictionary(evidence(s, d)).select("entity", F.col("frequency").alias("n"))
    return lexicon.resolve_pairs(pairs, counts).groupBy("entity", "surface").agg(F.count(F.lit(1)).alias("n"))


def q_incremental(s, d):
    ev = evidence(s, d)
    new = ev.filter("doc_id = 3").withColumn("occurrences", F.col("occurrences") * 2).limit(0).unionByName(ev.filter("doc_id = 4").withColumn("doc_id", F.lit(3).cast("long")))
    after, affected = lexicon.incremental(ev, 3, new)
    kept = after.join(affected, "entity", "left_semi")
    return kept.groupBy("entity").agg(F.sum("occurrences").alias("occurrences"))


def q_relations(s, d):
    return lexicon.relations_of(relations(s, d), " ASIA ").select("relation_id", "weight")


def q_normalize(s, d):
    e = lexicon.dictionary(evidence(s, d))
    t = s.createDataFrame([(x,) for x in ("Nation_3", "Brand#1", "asia", "unknown")], "term string").union(table(s, d, "part").select("p_name").distinct())
    return lexicon.normalize_terms(t, e, relations(s, d))


def q_expand(s, d):
    t = table(s, d, "nation").select((F.col("n_nationkey") % 4).alias("query_id"), F.col("n_nationkey").cast("int").alias("pos"), F.col("n_name").alias("token")).unionByName(table(s, d, "part").filter("p_partkey % 50 = 0").select((F.col("p_partkey") % 4).cast("int").alias("query_id"), (F.col("p_partkey") + 100).cast("int").alias("pos"), F.col("p_name").alias("token")))
    return lexicon.expand_query(t, relations(s, d))


def q_synonyms(s, d):
    return lexicon.suggest_synonyms(lexicon.dictionary(evidence(s, d)))


def q_cycle(s, d):
    r = relations(s, d)
    loop = r.unionByName(s.createDataFrame([("Party", "Customer", "hypernym", 1.0, False, "x", "corpus")], r.select("source", "target", "relation_type", "weight", "bidirectional", "relation_id", "corpus_id").schema))
    return s.createDataFrame([("as it is", lexicon.has_cycle(r)), ("with a loop", lexicon.has_cycle(loop))], "graph string, cycle boolean")


def q_distance(s, d):
    p = table(s, d, "nation").select(F.col("n_name").alias("a"), F.lit("ASIA").alias("b")).unionByName(s.createDataFrame([("Order", "status"), ("x", "X"), ("x", "y"), ("party", "Customer")], "a string, b string"))
    return lexicon.distance(p, relations(s, d))


def q_thesaurus_stats(s, d):
    return stats.thesaurus_stats(relations(s, d))


def q_normalize_entities(s, d):
    normal = s.createDataFrame([("NATION_1", "First"), ("ASIA", "Asia")], "term string, normalized string")
    return lexicon.normalize_entities(facts(s, d), normal).groupBy("head_entity").agg(F.count(F.lit(1)).alias("n")).filter("n > 20 or head_entity = 'First'")


def q_hints(s, d):
    e = lexicon.dictionary(evidence(s, d))
    return lexicon.hints(e, 0.9).select("term_id")


def q_boost(s, d):
    m = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.concat(F.lit("State of "), "n_name").alias("canonical")).unionByName(s.createDataFrame([(1, "plain"), (1, "co-op")], "doc_id long, canonical string"))
    r = table(s, d, "documents").select("doc_id", F.array("lang").alias("entities"))
    return extraction.boost(r, m).select("doc_id", F.array_join("entities", "|").alias("entities"))


# --- storage and ingestion -------------------------------------------------------------------------------------------


def q_upsert(s, d):
    c = table(s, d, "customer")
    old = c.select("c_custkey", "c_name", F.lit("old").alias("created_at")).filter("c_custkey < 1000")
    new = c.select("c_custkey", F.upper("c_name").alias("c_name"), F.lit("new").alias("created_at")).filter("c_custkey % 2 = 0")
    return store.upsert(old, new, ["c_custkey"], ("created_at",))


def q_vectors(s, d):
    v = tables.vectors(s, d).withColumn("corpus_id", F.lit("corpus")).select("corpus_id", "namespace", "id", "embedding", F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    log = v.unionByName(v.filter("id % 3 = 0").withColumn("version", F.lit(2)).withColumn("deleted", F.lit(True))).unionByName(v.filter("id % 6 = 0").withColumn("version", F.lit(3)))
    return store.latest_vectors(log).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def q_migrate(s, d):
    f = facts(s, d)
    return store.migrate({"facts": f, "schemas": tables.schemas(f), "passages": tables.passages(s, d)}, store.scratch(s, "migrated"))


def q_audit_append(s, d):
    path = store.scratch(s, "audit")
    e = table(s, d, "events").select("event_id", "event_type")
    store.append_audit(e.filter("event_id % 2 = 0"), path)
    store.append_audit(e.filter("event_id % 2 = 1"), path)
    return s.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def q_markdown_files(s, d):
    """Sources and their titles are read as files that this query writes first, in the shared folder."""
    path = store.scratch(s, "files")
    b = table(s, d, "benchmark").select(F.to_json(F.struct("item_id", "text")).alias("value"))
    b.coalesce(1).write.text(path)
    # every reader of whole files sees the same content; the suffix is Spark's own here
    f = s.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    lines = f.select(F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("json")).filter("json <> ''")
    return store.from_json_rows(lines, "item_id long, text string").select("item_id", ids.text_hash("text").alias("hash"))


def q_inline(s, d):
    docs = [{"id": "a", "text": "Alpha"}, {"id": "b", "text": "Beta", "source_url": "u"}]
    return store.inline_documents(s, docs).select("doc_id", "text", "source_url")


def q_ingest(s, d):
    """Documents through the stream in micro-batches, with unreadable rows and a second version of some."""
    base = store.scratch(s, "ingest")
    docs = table(s, d, "documents").select("doc_id", "text", "lang", "source")
    docs.unionByName(docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "text", "lang", "source")).unionByName(docs.limit(1).select(F.lit(10_000_000).cast("long").alias("doc_id"), F.lit(" ").alias("text"), "lang", "source")).repartition(4).write.parquet(f"{base}/in")
    ingest.ingest(s, f"{base}/in", f"{base}/store", f"{base}/checkpoint", files=2).awaitTermination()
    docs.filter("doc_id < 10").withColumn("text", F.lit("second version")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    ingest.ingest(s, f"{base}/in", f"{base}/store", f"{base}/checkpoint", files=2).awaitTermination()
    return ingest.Store(s, f"{base}/store").read("passages", ingest.PASSAGES).select("doc_id", "passage_id", "text_hash", "language")


def q_skip(s, d):
    docs = table(s, d, "documents")
    return ingest.skip_processed(docs, docs.filter("doc_id % 3 <> 0")).select("doc_id")


def q_chunked(s, d):
    f = facts(s, d).select(F.col("relation").alias("section"), "fact_id")
    return ingest.chunked(f, "fact_id", 4096).groupBy("section", "chunk", "last").agg(F.count(F.lit(1)).alias("n"))


def q_quarantine(s, d):
    docs = table(s, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("text")).alias("text"))
    good, bad = ingest.quarantine(docs)
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("reason"), "n"))


def q_windows(s, d):
    return ingest.event_windows(table(s, d, "events"), "1 day").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def q_versions(s, d):
    e = table(s, d, "events").select("user_id", "event_id")
    return memory.versions(e, "user_id", "event_id")


def q_corpora(s, d):
    """Corpora (languages) with their document and character counts; one of them deleted."""
    t = table(s, d, "documents").filter("lang <> 'es'")
    return t.groupBy(F.col("lang").alias("corpus_id")).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("first"))


def q_vector_inputs(s, d):
    return providers.vector_inputs(nodes(s, d)).select("node_id", "dimensions", "ok")


def sampled_reply(prompts, sample):
    """A stand-in for a model: the first word, or at the second sample the last; silent on texts that begin with a vowel."""
    out = []
    for p in prompts:
        w = (p or "").split(" ")
        out.append(None if not p or p[:1].lower() in "aeiou" else f"well\nFINAL: {w[0] if sample != 1 else w[-1]}")
    return out


def q_answers(s, d):
    c = table(s, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("id"), F.split(F.trim("text"), "\n")[0].alias("prompt")).dropDuplicates(["id"]).filter(r"prompt rlike '^[A-Za-z]+ ' and not prompt rlike '[\'\"]'")
    return providers.answers(c, "id", "prompt", sampled_reply, fallback=F.lit("(template)")).select("id", "answer")


def q_second_hop(s, d):
    c = table(s, d, "conversations").select("conv_id", "turn", F.split("text", " ")[0].alias("a"), "text")
    return c.select("conv_id", "turn", providers.second_hop(F.lit("Where is {hop1Answer}?"), F.col("a"), context.grounded("a", "text")).alias("question")).groupBy("question").agg(F.count(F.lit(1)).alias("n")).filter("question is not null and n > 2")


QUERIES = {
    "gr4_snk8_vector_inputs": (q_vector_inputs, f"{with_ctes('nodes')} SELECT node_id, 8 AS dimensions, true AS ok FROM nodes"),
    "qa1_answers": (q_answers, r"""WITH c AS (SELECT DISTINCT ON (conv_id, turn, role) conv_id || ':' || turn || ':' || role AS id, string_split(trim(text), chr(10))[1] AS p FROM conversations) SELECT id, CASE WHEN lower(p[1]) IN ('a', 'e', 'i', 'o', 'u') THEN '(template)' ELSE string_split(p, ' ')[1] END AS answer FROM c WHERE regexp_matches(p, '^[A-Za-z]+ ') AND NOT regexp_matches(p, '[''"]')"""),
    "qa6_second_hop": (q_second_hop, None),
    "agg6_group_schemas": (q_group, f"{with_ctes('facts')} SELECT schema_id, count(*) AS frequency, string_agg(DISTINCT head_type, ',') AS aliases, count(DISTINCT doc_id) AS n_docs, true AS consistent FROM facts GROUP BY 1"),
    "agg7_fold_facts": (q_fold, f"{with_ctes('facts')} SELECT fact_id, CASE WHEN doc_id % 2 = 0 THEN 0.99 ELSE confidence END AS confidence, passage_id || CASE WHEN doc_id % 2 = 0 THEN ',passage:again:0' ELSE '' END AS passage_ids, doc_id::VARCHAR AS doc_ids, doc_id % 4 <> 0 AS consistent FROM facts"),
    "idx2_contributions": (q_contributions, f"{with_ctes('facts')} SELECT schema_id, count(DISTINCT doc_id) AS n FROM facts WHERE doc_id % 2 = 1 GROUP BY 1"),
    "idx1_stabilize": (q_stabilize, f"{with_ctes('facts')}, o AS (SELECT schema_id, count(DISTINCT doc_id) FILTER (doc_id = 0) AS b, count(DISTINCT doc_id) AS n FROM facts GROUP BY 1) SELECT schema_id, n AS frequency, CASE WHEN n >= 2 THEN 'stable' ELSE 'pending' END AS state, n >= 2 AS newly_stable FROM o UNION ALL VALUES ('schema:rare', 1, 'pending', false), ('schema:kept', 1, 'stable', false)"),
    "idx3_activate": (q_activate, f"{with_ctes('facts')}, c AS (SELECT schema_id, count(DISTINCT doc_id) AS n FROM facts GROUP BY 1) SELECT relation, CASE WHEN n >= 500 THEN 'active' ELSE 'inactive' END AS state, count(*) AS n FROM facts JOIN c USING (schema_id) GROUP BY 1, 2"),
    "jn7_conflict_sets": (
        q_conflict_sets,
        f"""{with_ctes('conflict_facts')}, act AS (SELECT *, row_number() OVER (ORDER BY fact_id) AS place FROM conflict_facts WHERE state = 'active'),
        own AS (SELECT c.*, coalesce(act.place, 101) AS own FROM conflict_facts c LEFT JOIN act USING (fact_id)),
        j AS (SELECT a.fact_id, b.fact_id AS other_id, CASE WHEN lower(a.tail_entity) <> lower(b.tail_entity) THEN 'mutually_exclusive' WHEN a.temporal_scope IS DISTINCT FROM b.temporal_scope THEN 'temporal' WHEN a.parent IS DISTINCT FROM b.parent THEN 'granularity' END AS conflict_type
        FROM own a JOIN act b ON lower(a.head_entity) = lower(b.head_entity) AND lower(a.relation) = lower(b.relation) AND a.fact_id <> b.fact_id WHERE b.place <= 100 OR (b.place = 101 AND a.own <= 100))
        SELECT fact_id, conflict_type, string_agg(other_id, ',' ORDER BY other_id) AS others FROM j WHERE conflict_type IS NOT NULL GROUP BY 1, 2""",
    ),
    "jn7_conflicts": (q_conflicts, f"""{with_ctes('conflict_facts')} SELECT * FROM (SELECT a.fact_id, b.fact_id AS other_id, CASE WHEN lower(a.tail_entity) <> lower(b.tail_entity) THEN 'mutually_exclusive' WHEN a.temporal_scope IS DISTINCT FROM b.temporal_scope THEN 'temporal' WHEN a.parent IS DISTINCT FROM b.parent THEN 'granularity' END AS conflict_type FROM conflict_facts a JOIN conflict_facts b ON a.head_entity = b.head_entity AND a.fact_id <> b.fact_id WHERE a.fact_id LIKE '%:1') WHERE conflict_type IS NOT NULL"""),
    "flt8_active_window": (q_window, f"{with_ctes('facts')} SELECT fact_id FROM facts ORDER BY fact_id LIMIT 100"),
    "idx4_resolve": (q_resolve, f"""{with_ctes('conflict_facts')}, c AS (SELECT a.fact_id AS x, b.fact_id AS y FROM conflict_facts a JOIN conflict_facts b ON a.head_entity = b.head_entity AND a.fact_id <> b.fact_id WHERE a.fact_id LIKE '%:1' AND (a.tail_entity <> b.tail_entity OR a.temporal_scope <> b.temporal_scope OR a.parent <> b.parent)), d AS (SELECT 'cf:' || l_orderkey || ':' || l_linenumber AS f, l_discount AS v FROM lineitem), r AS (SELECT CASE WHEN p.v > q.v THEN 'keep_new' WHEN p.v < q.v THEN 'keep_existing' ELSE 'keep_both' END AS resolution FROM c JOIN d p ON p.f = x JOIN d q ON q.f = y) SELECT resolution, count(*) AS n, sum(CASE WHEN resolution = 'keep_both' THEN 0 ELSE 1 END)::BIGINT AS inactivated FROM r GROUP BY 1"""),
    "idx4_parse_reply": (q_parse, "SELECT resolution, confidence, count(*) AS n FROM (SELECT ['keep_new', 'keep_both', 'keep_both', 'discard_both'][turn % 4 + 1] AS resolution, [0.9, 0.3, 0.3, 0.3][turn % 4 + 1]::DOUBLE AS confidence FROM conversations) GROUP BY ALL"),
    "idx4_apply": (q_apply, f"""{with_ctes('conflict_facts')}, l AS (SELECT DISTINCT a.fact_id FROM conflict_facts a JOIN conflict_facts b ON a.head_entity = b.head_entity AND a.fact_id <> b.fact_id WHERE a.fact_id LIKE '%:1' AND a.tail_entity = b.tail_entity AND a.temporal_scope <> b.temporal_scope) SELECT CASE WHEN fact_id IN (FROM l) THEN 'inactive' ELSE 'active' END AS state, count(*) AS n FROM conflict_facts GROUP BY 1"""),
    "idx5_delete_document": (q_delete, f"{with_ctes('facts', 'passages', 'schemas')} SELECT 'passages' AS part, count(*) AS n FROM passages WHERE doc_id <> 3 UNION ALL SELECT 'facts', count(*) FROM facts WHERE doc_id <> 3 UNION ALL SELECT 'frequency', (sum(frequency) - (SELECT count(DISTINCT schema_id) FROM facts WHERE doc_id = 3))::BIGINT FROM schemas"),
    "idx6_replace_document": (q_replace, f"{with_ctes('facts', 'schemas')}, h AS (SELECT DISTINCT schema_id FROM facts WHERE doc_id = 3), a AS (SELECT DISTINCT schema_id FROM facts WHERE doc_id = 3 AND relation = 'placed') SELECT schema_id, frequency - (schema_id IN (FROM h))::INT + (schema_id IN (FROM a))::INT AS frequency, 'stable' AS state FROM schemas"),
    "jn2_integrity": (q_integrity, f"""{with_ctes('facts', 'passages', 'nodes', 'edges')} SELECT 'fact ' || fact_id || ' has no schema ' || schema_id AS message FROM facts WHERE relation = 'in_region' AND doc_id <> 5 UNION ALL SELECT 'link of ' || fact_id || ' has no passage ' || passage_id FROM facts WHERE doc_id = 4 OR passage_id NOT IN (SELECT passage_id FROM passages) UNION ALL SELECT 'link to ' || passage_id || ' has no fact ' || fact_id FROM facts WHERE doc_id = 5 UNION ALL SELECT 'edge ' || src || ' to ' || dst || ' has no end ' FROM edges WHERE relation = 'schema_instance'"""),
    "schema_contract": (q_contract, f"{with_ctes('facts')} SELECT * FROM (SELECT fact_id, array_to_string(list_filter([CASE WHEN confidence > 0.9 THEN 'confidence' END, CASE WHEN doc_id < 10 THEN 'document' END], lambda x: x IS NOT NULL), ',') AS violations FROM facts) WHERE violations <> ''"),
    "src3_jn1_snapshot": (q_snapshot, f"{with_ctes('facts', 'passages')} SELECT passage_id, count(fact_id) AS n_facts, min(fact_id) AS first_fact FROM passages LEFT JOIN facts USING (passage_id) GROUP BY 1"),
    "src4_by_ids": (q_by_ids, "SELECT unnest([5, 1, 0])::BIGINT AS doc_id, unnest([1, 2, 3])::BIGINT AS place"),
    "src5_jn6_facts_by_entities": (q_by_entities, f"{with_ctes('facts')} SELECT fact_id FROM facts WHERE lower(head_entity) IN ('nation_3', 'europe', 'order_7') OR lower(tail_entity) IN ('nation_3', 'europe', 'order_7') ORDER BY fact_id LIMIT 200"),
    "src6_sections": (q_sections, f"{with_ctes('facts', 'passages', 'schemas')} SELECT 'schemas' AS section, count(*) AS n FROM schemas UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'passages', count(*) FROM passages"),
    "agg1_jn4_corpus_counts": (q_counts, f"{with_ctes('facts')} SELECT (SELECT count(*) FROM documents) AS passages, (SELECT count(*) FROM facts) AS facts, (SELECT count(DISTINCT schema_id) FROM facts) AS schemas, (SELECT count(*) FROM (SELECT schema_id FROM facts GROUP BY 1 HAVING count(DISTINCT doc_id) >= 500)) AS stable_schemas, (SELECT count(*) FROM facts WHERE doc_id % 3 <> 0) AS active_facts, (SELECT count(*) FROM facts WHERE doc_id % 3 = 0) AS inactive_facts, (SELECT count(DISTINCT fact_id) FROM facts) AS linked_facts"),
    "agg3_conflict_distribution": (q_audit, "SELECT CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS resolution_state, count(*) AS n FROM events GROUP BY 1"),
    "dict3_agg9_evidence": (q_evidence, f"{with_ctes('facts')}, {EVIDENCE} SELECT entity, evidence_type, sum(occurrences)::BIGINT AS occurrences, round(max(confidence), 6) AS confidence, count(*) AS rows, min(passage_id) AS passage_id FROM ev GROUP BY 1, 2"),
    "dict5_agg10_dictionary": (q_dictionary, f"{LEX} SELECT term_id, canonical, array_to_string(aliases, '|') AS aliases, frequency, round(confidence, 6) AS confidence FROM dic"),
    "agg11_set1_categories": (lambda s, d: lexicon.domain_categories(facts(s, d)), f"{with_ctes('facts')}, t AS (SELECT {TERM.format('n')} AS entity, lower(y) AS type FROM (SELECT head_entity AS n, head_type AS y FROM facts UNION ALL SELECT tail_entity, tail_type FROM facts)) SELECT entity, type AS category FROM (SELECT entity, type, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, type) AS rn FROM t GROUP BY 1, 2) WHERE rn = 1"),
    "agg12_stopwords": (q_stop, f"{LEX} SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY frequency DESC, entity) AS rn, count(*) OVER () AS n FROM dic) WHERE rn <= floor(n * 0.01)"),
    "agg13_ambiguous": (lambda s, d: lexicon.ambiguous_surfaces(evidence(s, d)), f"{with_ctes('facts')}, {EVIDENCE}, {AMB} SELECT surface FROM amb"),
    "dict7_prune_aliases": (q_prune, f"{LEX}, {AMB}, a AS (SELECT term_id, unnest(aliases) AS al FROM dic) SELECT term_id, (count(*) FILTER (lower(al) IN (FROM amb)))::INT AS removed, coalesce(string_agg(al, '|' ORDER BY al) FILTER (lower(al) NOT IN (FROM amb)), '') AS aliases FROM a GROUP BY 1 HAVING count(*) FILTER (lower(al) IN (FROM amb)) > 0"),
    "dict6_agg14_thesaurus": (q_thesaurus, f"""{LEX}, {AMB}, st AS (SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY frequency DESC, entity) AS rn, count(*) OVER () AS n FROM dic) WHERE rn <= floor(n * 0.001)),
    u AS (SELECT canonical AS s, unnest(aliases) AS t, 'synonym' AS relation_type, 1.0::DOUBLE AS w, true AS b, 0 AS p FROM dic UNION ALL SELECT entity, surface, 'synonym', max(confidence), true, 1 FROM ev WHERE evidence_type = 'alias' GROUP BY 1, 2 UNION ALL SELECT n_name, r_name, 'hypernym', 0.8, false, 2 FROM nation JOIN region ON n_regionkey = r_regionkey),
    v AS (SELECT *, {TERM.format('s')} AS sk, {TERM.format('t')} AS tk FROM u), w AS (SELECT * FROM v WHERE sk <> tk AND sk NOT IN (FROM st) AND tk NOT IN (FROM st) AND NOT (relation_type = 'synonym' AND tk IN (FROM amb)))
    SELECT relation_id, relation_type, round(w, 6) AS weight, b AS bidirectional FROM (SELECT *, 'rel:corpus:' || sk || ':' || tk || ':' || relation_type AS relation_id, row_number() OVER (PARTITION BY sk, tk, relation_type ORDER BY p DESC, w DESC, s DESC, t DESC) AS rn FROM w) WHERE rn = 1"""),
    "agg4_dictionary_stats": (q_stats, f"{LEX}, t AS (SELECT {TERM.format('n')} AS entity, lower(y) AS type FROM (SELECT head_entity AS n, head_type AS y FROM facts UNION ALL SELECT tail_entity, tail_type FROM facts)), c AS (SELECT entity, type FROM (SELECT entity, type, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, type) AS rn FROM t GROUP BY 1, 2) WHERE rn = 1) SELECT 'total' AS measure, count(*)::DOUBLE AS value FROM dic UNION ALL SELECT 'confident', round(avg((confidence >= 0.5)::INT), 6) FROM dic UNION ALL SELECT 'domain:' || coalesce(type, 'general'), count(*)::DOUBLE FROM dic LEFT JOIN c USING (entity) GROUP BY 1"),
    "agg15_cooccurrence": (q_cooccur, f"{with_ctes('facts')}, m AS (SELECT DISTINCT passage_id, {TERM.format('n')} AS e, lower(y) AS t FROM (SELECT passage_id, head_entity AS n, head_type AS y FROM facts UNION ALL SELECT passage_id, tail_entity, tail_type FROM facts)) SELECT a.e AS a, b.e AS b, count(DISTINCT passage_id) AS n FROM m a JOIN m b USING (passage_id, t) WHERE a.e < b.e GROUP BY 1, 2 HAVING count(DISTINCT passage_id) >= 2"),
    "agg16_suggestions": (q_suggest, "SELECT term, frequency, round(least(1.0, frequency / 40), 6)::DOUBLE AS confidence, 'pending' AS status FROM (SELECT trim(unnest(string_split(p_type, ' '))) AS term, count(*) AS frequency FROM part GROUP BY 1) WHERE term <> '' AND frequency >= 40"),
    "agg17_api_dictionary": (
        q_api,
        rf"""WITH w AS (SELECT doc_id, source, list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: lower(x)), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(f"'{x}'" for x in text.API_STOP_WORDS)})) AS w FROM documents WHERE lang = 'en'), t AS (SELECT DISTINCT doc_id, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), n AS (SELECT source, count(*) AS papers FROM documents WHERE lang = 'en' GROUP BY 1), f AS (SELECT source, term, count(*) AS frequency FROM t GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT 'api:corpus:' || source || ':' || substr(sha1(array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(term), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: upper(x[1]) || substr(x, 2)), ' ')), 1, 12) AS term_id, term, frequency, round(least(1.0, 0.4 + 0.6 * frequency / papers), 6)::DOUBLE AS confidence FROM f JOIN n USING (source)""",
    ),
    "dict3_text_evidence": (q_text_evidence, None),
    "dict3_resolve_pairs": (q_resolve_pairs, f"{LEX}, p AS (SELECT p_brand AS l, 'NATION_' || p_partkey % 30 AS r FROM part), j AS (SELECT l, r, coalesce(a.frequency, 0) AS nl, coalesce(b.frequency, 0) AS nr, a.entity AS ea, b.entity AS eb FROM p LEFT JOIN dic a ON a.entity = lower(l) LEFT JOIN dic b ON b.entity = lower(r)) SELECT CASE WHEN nl > nr OR (nl = nr AND lower(l) <= lower(r)) THEN lower(l) ELSE lower(r) END AS entity, CASE WHEN nl > nr OR (nl = nr AND lower(l) <= lower(r)) THEN r ELSE l END AS surface, count(*) AS n FROM j WHERE nl > 0 OR nr > 0 GROUP BY 1, 2"),
    "dict4_incremental": (q_incremental, f"{with_ctes('facts')}, {EVIDENCE}, n AS (SELECT * FROM ev WHERE doc_id <> 3 UNION ALL SELECT * REPLACE (3 AS doc_id) FROM ev WHERE doc_id = 4) SELECT entity, sum(occurrences)::BIGINT AS occurrences FROM n WHERE entity IN (SELECT entity FROM ev WHERE doc_id IN (3, 4)) GROUP BY 1"),
    "ths1_relations": (q_relations, f"WITH {RELATIONS} SELECT relation_id, weight FROM relations WHERE lower(source) = 'asia' OR lower(target) = 'asia'"),
    "ths2_normalize": (q_normalize, f"""{LEX}, {RELATIONS}, t AS (SELECT unnest(['Nation_3', 'Brand#1', 'asia', 'unknown']) AS term UNION ALL SELECT DISTINCT p_name FROM part), f AS (SELECT DISTINCT lower(unnest(list_concat([canonical], aliases))) AS k, canonical, frequency FROM dic), c AS (SELECT k, arg_max(canonical, (frequency, canonical)) AS canonical FROM f GROUP BY k), y AS (SELECT * FROM relations WHERE relation_type = 'synonym'), a AS (SELECT lower(source) AS k, arg_max(target, (weight, target)) AS o FROM y GROUP BY 1), b AS (SELECT lower(target) AS k, arg_max(source, (weight, source)) AS o FROM y GROUP BY 1) SELECT term, coalesce(canonical, a.o, b.o, term) AS normalized FROM t LEFT JOIN c ON c.k = lower(trim(term)) LEFT JOIN a ON a.k = lower(trim(term)) LEFT JOIN b ON b.k = lower(trim(term))"""),
    "ths3_top13_expansion": (q_expand, f"""WITH {RELATIONS}, t AS (SELECT n_nationkey % 4 AS query_id, n_nationkey AS pos, lower(n_name) AS k FROM nation UNION ALL SELECT p_partkey % 4, p_partkey + 100, lower(p_name) FROM part WHERE p_partkey % 50 = 0), o AS (SELECT lower(source) AS k, lower(target) AS added, relation_type, weight FROM relations WHERE relation_type IN ('synonym', 'hypernym') UNION ALL SELECT lower(target), lower(source), relation_type, weight FROM relations WHERE bidirectional AND relation_type IN ('synonym', 'hypernym')), f AS (SELECT query_id, relation_type, added, min(pos) AS pos, max(weight) AS weight FROM t JOIN o USING (k) WHERE (query_id, added) NOT IN (SELECT (query_id, k) FROM t) GROUP BY ALL), g AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id, added ORDER BY relation_type DESC) = 1) SELECT query_id::INT AS query_id, relation_type, added FROM (SELECT *, row_number() OVER (PARTITION BY query_id, relation_type ORDER BY pos, weight DESC, added) AS rn FROM g) WHERE rn <= CASE WHEN relation_type = 'synonym' THEN 3 ELSE 2 END"""),
    "ths4_synonyms": (q_synonyms, f"{LEX} SELECT canonical, unnest(aliases) AS alias FROM dic"),
    "ths5_cycles": (q_cycle, "SELECT unnest(['as it is', 'with a loop']) AS graph, unnest([false, true]) AS cycle"),
    "ths6_distance": (q_distance, f"""WITH {RELATIONS}, p AS (SELECT n_name AS a, 'ASIA' AS b FROM nation UNION ALL VALUES ('Order', 'status'), ('x', 'X'), ('x', 'y'), ('party', 'Customer')), r AS (SELECT lower(source) AS x, lower(target) AS y, CASE relation_type WHEN 'synonym' THEN 0.0 WHEN 'related' THEN 0.75 ELSE 0.5 END AS d FROM relations) SELECT a, b, CASE WHEN lower(a) = lower(b) THEN 0 ELSE coalesce((SELECT min(d) FROM r WHERE (x = lower(a) AND y = lower(b)) OR (y = lower(a) AND x = lower(b))), 1) END::DOUBLE AS distance FROM p"""),
    "agg5_thesaurus_stats": (q_thesaurus_stats, f"WITH {RELATIONS} SELECT relation_type, count(*) AS n, count(*) FILTER (bidirectional) AS bidirectional FROM relations GROUP BY 1"),
    "ext6_normalize_entities": (q_normalize_entities, f"{with_ctes('facts')} SELECT CASE head_entity WHEN 'NATION_1' THEN 'First' WHEN 'ASIA' THEN 'Asia' ELSE head_entity END AS head_entity, count(*) AS n FROM facts GROUP BY 1 HAVING count(*) > 20 OR 1 = (CASE WHEN any_value(head_entity) = 'NATION_1' THEN 1 ELSE 0 END)"),
    "flt6_hints": (q_hints, f"{LEX} SELECT term_id FROM dic WHERE confidence >= 0.9"),
    "ext5_boost": (q_boost, "SELECT doc_id, lang || CASE WHEN doc_id = 1 THEN '|State of ' || n_name || '|co-op' WHEN n_name IS NOT NULL THEN '|State of ' || n_name ELSE '' END AS entities FROM documents LEFT JOIN nation ON n_nationkey = doc_id"),
    "snk1_snk2_upsert": (q_upsert, "SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_custkey < 1000 THEN 'old' ELSE 'new' END AS created_at FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, 'old' FROM customer WHERE c_custkey % 2 = 1 AND c_custkey < 1000"),
    "snk3_src7_vectors": (q_vectors, "SELECT ['passage', 'fact', 'schema', 'entity'][vec_id % 4 + 1] AS namespace, count(*) AS n, sum(vec_id)::BIGINT AS ids FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 6 = 0 GROUP BY 1"),
    "snk7_migrate": (q_migrate, f'{with_ctes("facts", "schemas", "passages")} SELECT \'facts\' AS "table", count(*) AS source_rows, count(*) AS target_rows, true AS equal FROM facts UNION ALL SELECT \'schemas\', count(*), count(*), true FROM schemas UNION ALL SELECT \'passages\', count(*), count(*), true FROM passages'),
    "snk6_audit": (q_audit_append, "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "src1_files": (q_markdown_files, r"SELECT item_id, substr(sha256(lower(trim(regexp_replace(text, '[\s\x{A0}\x{3000}\x{FEFF}]+', ' ', 'g')))), 1, 16) AS hash FROM benchmark"),
    "src2_inline": (q_inline, "SELECT * FROM (VALUES ('a', 'Alpha', NULL), ('b', 'Beta', 'u')) AS t(doc_id, text, source_url)"),
    "idx7_stream_ingest": (q_ingest, r"SELECT doc_id, 'passage:' || doc_id || ':0' AS passage_id, substr(sha256(lower(trim(regexp_replace(CASE WHEN doc_id < 10 THEN 'second version' ELSE text END, '[\s\x{A0}\x{3000}\x{FEFF}]+', ' ', 'g')))), 1, 16) AS text_hash, lang AS language FROM documents"),
    "idx7_skip_processed": (q_skip, "SELECT doc_id FROM documents WHERE doc_id % 3 = 0"),
    "idx8_mutation_chunks": (q_chunked, f"{with_ctes('facts')} SELECT section, chunk::INT AS chunk, chunk = (n0 - 1) // 4096 AS last, count(*) AS n FROM (SELECT relation AS section, (row_number() OVER (PARTITION BY relation ORDER BY fact_id) - 1) // 4096 AS chunk, count(*) OVER (PARTITION BY relation) AS n0 FROM facts) GROUP BY ALL"),
    "idx7_quarantine": (q_quarantine, "SELECT CASE WHEN doc_id % 7 = 0 THEN 'no id' WHEN doc_id % 5 = 0 THEN 'no text' ELSE 'good' END AS reason, count(*) AS n FROM documents GROUP BY 1"),
    "idx9_versions": (q_versions, "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1"),
    "idx11_corpora": (q_corpora, "SELECT lang AS corpus_id, count(*) AS documents, sum(length(text))::BIGINT AS chars, min(doc_id) AS first FROM documents WHERE lang <> 'es' GROUP BY 1"),
    "extension_event_windows": (q_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"),
}
