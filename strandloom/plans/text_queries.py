"""Text, chunking and extraction queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import ids, match, text
from strandloom.operators import chunking, extraction
from strandloom.sources.tables import table

WSP = r"[\s\x{A0}\x{3000}\x{FEFF}]+"


def docs(s, d):
    return table(s, d, "documents")


def turns(s, d):
    """Conversation turns with the text before; a missing turn number comes last, as in the SQL."""
    w = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_last() for c in ("turn", "role", "text")])
    return table(s, d, "conversations").withColumn("before", F.lag("text").over(w))


TURNS = "(SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM conversations)"
JAPANESE = ["データベース", "サーバー", "ﾃﾞｰﾀ", "ＡＢＣ　１２３", "コンピューター システム", "すし", "カード", "東京タワー"]


def q_preprocess(s, d):
    return docs(s, d).select("doc_id", text.preprocess_markdown("text").alias("clean"))


def q_japanese(s, d):
    extra = s.createDataFrame([(-1 - i, t) for i, t in enumerate(JAPANESE)], "doc_id long, text string")
    rows = docs(s, d).select("doc_id", "text").unionByName(extra)
    return rows.select("doc_id", text.normalize_japanese("text").alias("normalized"), text.japanese_key("text").alias("key"))


def q_hop(s, d):
    return turns(s, d).filter("before is not null").select("conv_id", "turn", F.round(text.hop_similarity("text", "before"), 6).alias("similarity"))


def q_flags(s, d):
    f = docs(s, d).select("doc_id", text.markdown_flags("text").alias("flags"), text.chunk_features("text").alias("c"))
    return f.select("doc_id", F.array_join("flags", ",").alias("flags"), F.round(text.markdown_score("flags"), 6).alias("score"), "c.has_code", "c.has_table", "c.has_references")


def q_api_terms(s, d):
    t = docs(s, d).select("doc_id", text.api_terms("text").alias("terms"))
    return t.select("doc_id", F.size("terms").cast("long").alias("n_terms"), F.array_min("terms").alias("first_term"))


def q_hint(s, d):
    p = table(s, d, "part")
    return p.select("p_partkey", text.format_hint(F.col("p_name"), F.array("p_brand", "p_type"), F.lower("p_type")).alias("hint"), text.title_case(text.normalize_api_term("p_name")).alias("title"))


ANSWER_CASES = (
    ("Bill Clinton", "William Clinton"), ("American", "United States"), ("1", "1996"), ("1996", "in 1996"), ("It was **three** people", "3"), ("twenty eight", "28"), ("mp3 4k", "mp7k"), ("Atlantic Ocean", "Pacific Ocean"), ("Rob Zemeckis", "Robert Zemeckis"),
    ("the USA", "United States of America"), ("US", "bus stop"), ("cities", "city"), ("founding members played loud", "founded member play loudly here"), ("", "x"), ("x", ""), ("no idea", "Paris"), ("red green blue white", "green blue red white black"),
    ("Northern Irish writer", "Northern Ireland"), ("a the", "Paris"), ("1 2 3", "33"), ("wolves ran", "wolf ran"), ("Chuck Berry", "Charles Berry"), ("J Smithson", "John Smithson"),
)


def q_match(s, d):
    """Neighbouring turns of all conversations, and cases for every rule."""
    cases = s.createDataFrame([(-1, i, *c) for i, c in enumerate(ANSWER_CASES)], "conv_id long, turn long, response string, gold string")
    rows = turns(s, d).filter("before is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("before").alias("response"), F.substring("text", 1, 24).alias("gold"))
    return rows.unionByName(cases).select("conv_id", "turn", match.answer_matches(F.col("response"), F.col("gold")).alias("matches"))


PAIRS = "SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS response, substr(text, 1, 24) AS gold FROM conversations QUALIFY response IS NOT NULL"
CASES_SQL = " UNION ALL ".join(f"SELECT -1, {i}, '{r}', '{g}'" for i, (r, g) in enumerate(ANSWER_CASES))


def q_guards(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(ids.is_identifier("event_type")).alias("valid"), F.count_if(ids.is_identifier("props")).alias("valid_props"))


def q_chunks(s, d):
    return chunking.chunk_documents(docs(s, d)).select("doc_id", "chunk_id", "chunk_index", F.length("text").alias("chars"), F.size("section_path").alias("depth"), "offset_start", "offset_end", "language")


def q_sentence_chunks(s, d):
    return chunking.chunk_documents(docs(s, d), by_sentence=True).select("doc_id", "chunk_id", "chunk_index", F.length("text").alias("chars"), "language")


def marked(s, d):
    """Texts with a heading before every third line, so that headings are met in the corpus."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat(F.repeat(F.lit("#"), (i % 4 + 1).cast("int")), F.lit(" Part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    return docs(s, d).select("doc_id", F.array_join(lines, "\n").alias("text"))


def q_heading_chunks(s, d):
    return chunking.chunk_documents(marked(s, d)).select("doc_id", "chunk_index", F.array_join("section_path", " / ").alias("section"), F.length("text").alias("chars"), "offset_start", "offset_end")


def q_entities(s, d):
    return extraction.regex_entities(docs(s, d).withColumn("language", F.when(F.col("lang") == "en", "en").otherwise("mixed")))


def q_phrases(s, d):
    return extraction.noun_phrases(docs(s, d).withColumn("language", F.lit("en")))


def reply(t):
    """A deterministic stand-in for a model: JSON with one good and two bad relations."""
    import json

    def one(x):
        w = (x or "").split()[:3] + ["-"] * 3
        good = {"head": w[0], "headType": "Word", "relation": "before", "tail": w[1], "tailType": "Word", "confidence": 0.5}
        return "```json\n" + json.dumps({"relations": [good, {**good, "confidence": None}, {"head": w[2]}]}) + "\n```"

    return t.map(one)


def q_triples(s, d):
    return extraction.extract_with(docs(s, d), reply).select("doc_id", "head", "relation", "tail", "confidence")


def q_merge(s, d):
    e = table(s, d, "part")
    merged = extraction.merge_entities(F.split("p_type", " "), F.split("p_name", " "), F.array(F.concat(F.lit(" "), "p_brand")))
    return e.select("p_partkey", F.array_join(merged, "|").alias("entities"))


ENTITY = "regexp_extract_all(text, '{p}')"
QUERIES = {
    "txt1_preprocess": (q_preprocess, r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), '[\t ]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents"""),
    "txt2_txt3_language_tokens": (
        lambda s, d: docs(s, d).select("doc_id", text.detect_language("text").alias("language"), text.estimate_tokens("text").alias("tokens"), text.context_tokens("text").alias("context_tokens")),
        r"""SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]') THEN 'ja' ELSE 'en' END AS language, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens, ceil(length(text) / 4)::BIGINT AS context_tokens FROM documents""",
    ),
    "txt4_txt5_japanese": (q_japanese, None),
    "txt6_txt8_normalize": (
        lambda s, d: docs(s, d).select("doc_id", text.normalize_english("text").alias("normalized"), text.english_key("text").alias("key"), text.normalize_query("text").alias("query")),
        rf"""SELECT doc_id, trim(lower(text)) AS normalized, trim(regexp_replace(lower(text), '{WSP}', ' ', 'g')) AS key, trim(regexp_replace(text, '{WSP}', ' ', 'g')) AS query FROM documents""",
    ),
    "txt7_canonical_key": (
        lambda s, d: table(s, d, "part").select("p_partkey", ids.canonical_key("p_brand", F.lit(" Made  Of "), "p_type").alias("key"), ids.schema_id("p_brand", F.lit("of"), "p_type").alias("schema_id"), ids.entity_key("p_name").alias("entity_key"), ids.document_id("p_name").alias("document_id")),
        r"""SELECT p_partkey, trim(regexp_replace(lower(p_brand), '\s+', ' ', 'g')) || '::made of::' || trim(regexp_replace(lower(p_type), '\s+', ' ', 'g')) AS key, 'schema:' || lower(p_brand) || '::of::' || lower(p_type) AS schema_id, regexp_replace(lower(p_name), '\s+', '_', 'g') AS entity_key, 'doc_' || substr(sha1(p_name), 1, 12) AS document_id FROM part""",
    ),
    "txt9_lexical_tokens": (
        lambda s, d: docs(s, d).select("doc_id", text.lexical_tokens("text").alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.array_max("t").alias("last_token")),
        r"""SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, list_max(t) AS last_token FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: length(x) >= 2) AS t FROM documents)""",
    ),
    "txt10_term_jaccard": (
        lambda s, d: turns(s, d).filter("before is not null").select("conv_id", "turn", F.round(text.jaccard(text.term_set("text"), text.term_set("before")), 6).alias("jaccard")),
        rf"""SELECT conv_id, turn, round(CASE WHEN len(u) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(u) END, 6) AS jaccard FROM (SELECT *, list_distinct(list_concat(a, b)) AS u FROM (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(before), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS b FROM {TURNS} WHERE before IS NOT NULL))""",
    ),
    "txt11_hop_similarity": (
        q_hop,
        rf"""SELECT conv_id, turn, round(CASE WHEN a = '' OR b = '' THEN 0 WHEN len(wa) <= 3 THEN CASE WHEN contains(b, a) THEN 1 ELSE 0 END ELSE len(list_intersect(list_distinct(wa), list_distinct(wb))) / len(list_distinct(list_concat(wa, wb))) END, 6) AS similarity FROM (SELECT *, string_split(a, ' ') AS wa, string_split(b, ' ') AS wb FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(before), '[^a-z0-9_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM {TURNS} WHERE before IS NOT NULL))""",
    ),
    "txt12_txt13_markdown_quality": (
        q_flags,
        r"""SELECT doc_id, array_to_string(CASE WHEN len(f) = 0 THEN ['well-formed'] ELSE f END, ',') AS flags, round(greatest(0.2, 1 - len(f) * 0.2), 6) AS score, contains(text, '```') AS has_code, regexp_matches(text, '\|.+\|') AS has_table, regexp_matches(text, '(?m)^\[[0-9]+\]') AS has_references FROM (SELECT *, list_filter([CASE WHEN contains(text, '```') THEN 'code-heavy' END, CASE WHEN regexp_matches(text, '(?m)^\|.*\|$') THEN 'table-heavy' END, CASE WHEN regexp_matches(text, '(?m)^\[[0-9]+\]') OR regexp_matches(text, '(?im)^#+\s+references') THEN 'references-present' END], lambda x: x IS NOT NULL) AS f FROM documents)""",
    ),
    "txt14_dedup_hash": (
        lambda s, d: docs(s, d).select(ids.passage_dedup_key("source", "text").alias("dedup_key"), "doc_id").groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")),
        rf"""SELECT source || '::' || substr(sha256(lower(trim(regexp_replace(text, '{WSP}', ' ', 'g')))), 1, 16) AS dedup_key, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1""",
    ),
    "txt15_comparison": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.is_comparison("text").alias("comparison")).unionByName(docs(s, d).select(F.col("doc_id").alias("conv_id"), F.lit(-1).cast("long").alias("turn"), text.is_comparison("text").alias("comparison"))),
        f"""SELECT conv_id, turn, regexp_matches(text, $re$(?i){text.COMPARISON}$re$) AS comparison FROM conversations UNION ALL SELECT doc_id, -1, regexp_matches(text, $re$(?i){text.COMPARISON}$re$) FROM documents""",
    ),
    "txt16_bridge": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.is_bridge("text").alias("bridge")),
        "SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(text, $re$(?i){p}$re$)" for p in text.BRIDGE) + " AS bridge FROM conversations",
    ),
    "txt17_final_answer": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.final_answer(F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("\n FINAL:  '"), "role", F.lit("'"))).otherwise(""))).alias("answer")),
        r"""SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN len(m) > 0 THEN trim(substr(m[1], 7)) ELSE coalesce(ls[len(ls)], '') END, '^["'']', ''), '["'']$', '') AS answer FROM (SELECT conv_id, turn, list_filter(a, lambda x: starts_with(upper(x), 'FINAL:')) AS m, list_filter(a, lambda x: x <> '') AS ls FROM (SELECT conv_id, turn, list_transform(string_split(text || CASE WHEN turn % 2 = 0 THEN chr(10) || ' FINAL:  ''' || role || '''' ELSE '' END, chr(10)), lambda x: trim(x)) AS a FROM conversations))""",
    ),
    "txt18_truncate": (
        lambda s, d: docs(s, d).select("doc_id", text.truncate("text").alias("short")),
        "SELECT doc_id, CASE WHEN length(text) <= 160 THEN text ELSE substr(text, 1, 159) || '…' END AS short FROM documents",
    ),
    "txt19_api_terms": (
        q_api_terms,
        rf"""SELECT doc_id, len(list_distinct(list_concat(w, p)))::BIGINT AS n_terms, list_min(list_concat(w, p)) AS first_term FROM (SELECT doc_id, w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: lower(x)), lambda x: length(x) >= 4 AND x NOT IN ({', '.join(f"'{w}'" for w in text.API_STOP_WORDS)})) AS w FROM documents))""",
    ),
    "txt20_hints": (
        q_hint,
        r"""SELECT p_partkey, '- ' || p_name || ' (also: ' || p_brand || ', ' || p_type || ') [' || lower(p_type) || ']' AS hint, array_to_string(list_transform(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\s-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''), lambda x: upper(x[1]) || substr(x, 2)), ' ') AS title FROM part""",
    ),
    "txt21_lower": (lambda s, d: docs(s, d).select("doc_id", text.lower_unicode("text").alias("lowered")), "SELECT doc_id, lower(text) AS lowered FROM documents"),
    "txt22_escape": (
        lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.escape_lexical_query("text").alias("escaped")),
        r"""SELECT conv_id, turn, regexp_replace(text, '([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', '\\\1', 'g') AS escaped FROM conversations""",
    ),
    "txt23_answer_match": (q_match, match.answer_sql(f"({PAIRS}) UNION ALL {CASES_SQL}", "conv_id, turn")),
    "txt24_identifiers": (
        q_guards,
        r"""SELECT event_type, count(*) AS n, count(*) FILTER (regexp_full_match(event_type, '[A-Za-z0-9_-]{1,128}')) AS valid, count(*) FILTER (coalesce(regexp_full_match(props, '[A-Za-z0-9_-]{1,128}'), false)) AS valid_props FROM events GROUP BY 1""",
    ),
    "chk1_heading_chunks": (
        q_heading_chunks,
        r"""WITH l AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN repeat('#', (i % 4 + 1)::INT) || ' Part ' || i || chr(10) || x ELSE x END AS line, i % 4 + 1 AS level FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text <> ''))),
        p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, i // 3 AS c FROM l),
        h AS (SELECT doc_id, c, min(pos) AS a, string_agg(line, chr(10) ORDER BY i) AS t, arg_min(level, i) AS level, min(i) AS i0, max(pos + length(line) + 1) AS z, max(max(pos + length(line))) OVER (PARTITION BY doc_id) AS total FROM p GROUP BY doc_id, c),
        s AS (SELECT h.doc_id, h.c, array_to_string(list(q.i0 ORDER BY q.c).list_transform(lambda v: 'Part ' || v), ' / ') AS section FROM h JOIN h q ON q.doc_id = h.doc_id AND q.c <= h.c WHERE q.c = h.c OR q.level < (SELECT min(m.level) FROM h m WHERE m.doc_id = h.doc_id AND m.c > q.c AND m.c <= h.c) GROUP BY h.doc_id, h.c)
        SELECT h.doc_id, h.c::INT AS chunk_index, section, length(regexp_replace(t, '^\s+|\s+$', '', 'g'))::INT AS chars, a::INT AS offset_start, least(z, total)::INT AS offset_end FROM h JOIN s USING (doc_id, c)""",
    ),
    "chk2_chk3_chk4_chunks": (q_chunks, r"""SELECT doc_id, doc_id || ':0' AS chunk_id, 0 AS chunk_index, length(t)::INT AS chars, 0 AS depth, 0 AS offset_start, length(t)::INT AS offset_end, 'en' AS language FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents) WHERE t <> ''"""),
    "chk5_sentence_chunks": (q_sentence_chunks, None),
    "ext1_entities": (q_entities, None),
    "ext2_noun_phrases": (q_phrases, r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b'))) AS phrase FROM documents"),
    "ext3_triples": (
        q_triples,
        r"""SELECT doc_id, coalesce(w[1], '-') AS head, 'before' AS relation, coalesce(w[2], '-') AS tail, 0.5::DOUBLE AS confidence FROM (SELECT doc_id, list_filter(regexp_split_to_array(substr(text, 1, 3000), '[\s\x{85}\x{A0}]+'), lambda x: x <> '') AS w FROM documents)""",
    ),
    "ext4_merge_entities": (
        q_merge,
        """SELECT p_partkey, array_to_string(list_transform(list_filter(list_transform(a, lambda x, i: {'x': x, 'i': i, 'p': list_position(a, x)}), lambda r: r.i = r.p AND r.x <> ''), lambda r: r.x), '|') AS entities FROM (SELECT p_partkey, list_concat(string_split(p_type, ' '), string_split(p_name, ' '), [p_brand]) AS a FROM part)""",
    ),
}
