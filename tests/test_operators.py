"""Operators on hand-made frames and against plain Python."""

import math
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from strandloom.functions import ids, match, text
from strandloom.operators import chunking, context, extraction, graph, lexicon, memory, ppr, retrieval, stats
from strandloom.plans import text_queries
from strandloom.sources import store
from strandloom.streaming import ingest


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


# --- text ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("value", "want"),
    [("a\r\nb\rc", "a\nb\nc"), ("  x \t y  ", "x y"), ("a\n\n\n\nb", "a\n\nb"), ("ＡＢ①", "AB1"), ("a\x07b", "ab"), ("", "")],
)
def test_preprocess(spark, value, want):
    assert one(spark, text.preprocess_markdown("t"), t=value) == want


def test_language_and_tokens(spark):
    assert one(spark, text.detect_language("t"), t="東京 is") == "ja" and one(spark, text.detect_language("t"), t="plain") == "en"
    assert one(spark, text.estimate_tokens("t"), t=" two words ") == 2 and one(spark, text.estimate_tokens("t"), t="東京タワー") == 3


@pytest.mark.parametrize(("value", "want"), [("データベース", "データベース"), ("サーバー", "サーバ"), ("ﾃﾞｰﾀ", "データ"), ("ＡＢＣ　１", "ABC 1")])
def test_japanese(spark, value, want):
    assert one(spark, text.normalize_japanese("t"), t=value) == want


def test_japanese_key(spark):
    assert one(spark, text.japanese_key("t"), t="サーバー") == one(spark, text.japanese_key("t"), t="さーば")


@pytest.mark.parametrize(
    ("q", "comparison", "bridge"),
    [("Which is larger, A or B?", True, False), ("Who is older, X or Y?", True, False), ("Where was the person who wrote it born?", False, True), ("What is this?", False, False), ("Are both of them French and German?", True, False)],
)
def test_question_kinds(spark, q, comparison, bridge):
    assert one(spark, text.is_comparison("t"), t=q) is comparison and one(spark, text.is_bridge("t"), t=q) is bridge


@pytest.mark.parametrize(("reply", "want"), [("thinking\nFINAL: 'Paris'\nmore", "Paris"), ("a\n\nlast line \n", "last line"), ("", ""), ("final: x\nFINAL: y", "x")])
def test_final_answer(spark, reply, want):
    assert one(spark, text.final_answer("t"), t=reply) == want


@pytest.mark.parametrize(("response", "gold", "want"), [("It was three people", "3", True), ("The Eiffel Tower", "eiffel tower", True), ("no idea", "Paris", False), ("", "x", False), ("founding members played", "founded member play", True),
    ("Bill Clinton", "William Clinton", True), ("American", "United States", True), ("1", "1996", False), ("in 1996", "1996", True), ("twenty eight", "28", True), ("Atlantic Ocean", "Pacific Ocean", False), ("Rob Zemeckis", "Robert Zemeckis", True),
    ("the USA", "United States of America", True), ("x", "", False), ("cities", "city", True), ("red green blue white", "green blue red white black", True), ("green", "green blue red", True), ("1 2 3", "33", False), ("1 2 3", "3 3", False)])
def test_answer_match(spark, response, gold, want):
    assert one(spark, match.answer_matches(F.col("r"), F.col("g")), r=response, g=gold) is want


def test_answer_match_equals_its_sql_on_odd_texts(spark):
    odd = ["aêtre", "tre", "un tre bon", "éan", "aétre la", "être", "Thé", "the", "éan Paris", "é Paris", "İan", "an", "ian", "a\u0301n b", "\u212Aate", "katherine", "a_b", "naïve 3", "é1 é2", "3", "", " ", "a", "x\ny", "xy", "１２", "Zürich**the**", "zrich", "१ a", "USé", "usa", "12345678901234567890 1"]
    rows = [(i, r, g) for i, (r, g) in enumerate((r, g) for r in odd for g in odd)]
    got = spark.createDataFrame(rows, "i int, response string, gold string").select("i", match.answer_matches(F.col("response"), F.col("gold")).alias("matches"))
    con = duckdb.connect()
    con.execute("CREATE TABLE p (i INT, response VARCHAR, gold VARCHAR)")
    con.executemany("INSERT INTO p VALUES (?, ?, ?)", rows)
    want = dict(con.execute(match.answer_sql("SELECT * FROM p", "i")).fetchall())
    assert [rows[i] for i, m in got.collect() if m != want[i]] == []


def test_answer_match_with_missing_turns(spark, tmp_path):
    rows = [(1, None, "user", "Paris"), (1, 0, "user", "It is Paris"), (1, 1, "user", "London"), (2, 0, "user", None), (2, 1, "user", "x"), (None, 3, "user", "x y"), (None, 4, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = [tuple(r) for r in text_queries.q_match(spark, str(tmp_path)).collect()]
    want = con.execute(text_queries.QUERIES["txt23_answer_match"][1]).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)


def test_hop_similarity(spark):
    assert one(spark, text.hop_similarity("a", "b"), a="New York", b="in new york city") == 1.0
    assert one(spark, text.hop_similarity("a", "b"), a="a b c d", b="a b c e") == pytest.approx(3 / 5)


def test_identifiers(spark):
    assert one(spark, ids.fact_id(F.lit(7), F.lit("schema:a::b::c"), F.lit("New  York"), F.lit("in"), F.lit("US A"))) == "fact:7:schema:a::b::c:New_York:in:US_A"
    assert one(spark, ids.canonical_key(F.lit(" Big  City"), F.lit("IN"), F.lit("State"))) == "big city::in::state"
    assert one(spark, ids.text_hash(F.lit(" A  b\n"))) == one(spark, ids.text_hash(F.lit("a B")))
    assert one(spark, ids.is_identifier(F.lit("../x"))) is False and one(spark, ids.is_identifier(F.lit("a_b-1"))) is True


# --- chunking and extraction -------------------------------------------------------------------------------------------


def test_heading_chunks():
    got = chunking.chunk("before\n# A\nx\n## B\ny\n# C\n")
    assert [(t, p) for t, p, _, _ in got] == [("# A\nx", ["A"]), ("## B\ny", ["A", "B"]), ("# C", ["C"])]
    assert chunking.chunk("") == chunking.chunk(None) == chunking.chunk(" \n") == []


def test_paragraphs_overlap():
    body = "\n\n".join(f"{i} " + "w " * 299 for i in range(5))
    parts = [t for t, *_ in chunking.chunk(body)]
    assert len(parts) == 4 and all(b.startswith(f"{i} ") for i, b in enumerate(parts))


def test_japanese_headings_are_split():
    body = "# 見出し\n" + "\n\n".join("東京" * 150 for _ in range(5))
    got = chunking.chunk(body)
    assert len(got) > 1 and all(p == ["見出し"] for _, p, _, _ in got)


def test_entities(spark):
    rows = [(1, "Ada Lovelace met NASA and state-of-the-art Ada Lovelace", "en"), (2, "データと東京都", "ja"), (3, "Ada Lovelace", "unknown")]
    got = {(r.doc_id, r.text, r.label, r.start, r.end) for r in extraction.regex_entities(spark.createDataFrame(rows, "doc_id long, text string, language string")).collect()}
    assert got == {(1, "Ada Lovelace", "ENTITY", 0, 12), (1, "NASA", "ACRONYM", 17, 21), (1, "state-of-the-art", "COMPOUND", 26, 42), (2, "データ", "KATAKANA", 0, 3), (2, "東京都", "KANJI_COMPOUND", 4, 7)}


def test_triples_are_filtered(spark):
    reply = '```json\n{"relations": [{"head":"a","headType":"t","relation":"r","tail":"b","tailType":"t","confidence":1.5},{"head":"a"},{"head":"a","headType":"t","relation":"r","tail":"b","tailType":"t"}]}\n```'
    got = one(spark, extraction.parse_triples(F.col("t")), t=reply)
    assert len(got) == 1 and got[0].confidence == 1.5
    assert one(spark, extraction.parse_triples(F.col("t")), t="no json") == []


# --- retrieval ---------------------------------------------------------------------------------------------------------


def test_bm25_scans_documents_once_and_agrees_without_broadcasts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, None), (4, "nothing asked"), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red fox"), (1, "blue blue"), (2, "absent"), (3, None)], "query_id long, query_text string")
    key = lambda r: (r.query_id, r.doc_id)
    df = retrieval.bm25(docs, q)
    got = {key(r): r.score for r in df.collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)}
    # by hand: five documents of 3, 2, 1, 2 and 1 words (1 at least); "fox" is in two of them
    part = lambda df, tf, n: math.log(1 + (5 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 1.8))
    assert abs(got[0, 1] - part(1, 2, 3) - part(2, 1, 3)) < 1e-8 and abs(got[0, 2] - part(2, 1, 2)) < 1e-8 and abs(got[1, 2] - 2 * part(1, 1, 2)) < 1e-8
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 0)
    assert {key(r): r.score for r in retrieval.bm25(docs, q).collect()} == got


def test_bm25_counts_repeated_terms(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "red green"), (3, "")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red red absent")], "query_id long, query_text string")
    got = {r.doc_id: r.score for r in retrieval.bm25(docs, q).collect()}
    avg, idf = 2.0, math.log(1 + (3 - 2 + 0.5) / 2.5)
    want = {d: 2 * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg)) for d, tf, n in ((1, 2, 3), (2, 1, 2))}
    assert got == pytest.approx(want, abs=1e-8)


def test_cosine_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [0.6, 0.8])], "id long, embedding array<float>")
    got = {r.id: r.score for r in retrieval.cosine_scores(v, [1.0, 0.0]).collect()}
    assert got == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0, 4: 0.6}, abs=1e-6)


def test_cap_skips_and_goes_on(spark):
    rows = [("a", f"p{i}", "u", "x" * n, i + 1, 1.0) for i, n in enumerate((160, 400, 40))] + [("b", "q", "u", "y" * 40, 1, 0.5)]
    hits = spark.createDataFrame(rows, "db_id string, passage_id string, source_url string, text string, rank int, weight double")
    assert [r.passage_id for r in retrieval.federate(hits, budget=100, ratio=0.6).collect()] == ["p0", "p2", "q"]
    assert retrieval.federate(hits.filter("db_id = 'a'"), budget=100, ratio=0.1).count() == 3


def test_rank_puts_nan_last(spark):
    df = spark.createDataFrame([(1, "a", float("nan")), (1, "b", 1.0), (1, "c", 2.0), (1, "d", 2.0)], "g int, id string, score double")
    assert [r.id for r in retrieval.ranked(df, "g", "id").orderBy("rank").collect()] == ["c", "d", "b", "a"]


# --- context -----------------------------------------------------------------------------------------------------------


def test_budget_breaks_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, "x" * 40), (2, "x" * 400), (3, "x" * 4)], "rank int, t string")
    assert [r["rank"] for r in context.within_budget(df, F.col("t"), 50).collect()] == [1]


@pytest.mark.parametrize(("answer", "passage", "want"), [("UK", "the uk is", True), ("UK", "duke", False), ("Ada Lovelace", "it was ada lovelace", True), ("red green blue paint", "green blue red car", True), ("", "x", False), ("a b green blue red", "green blue", True), ("vitamin c", "vitamin d", True), ("x y", "a x y b", True), ("go on", "on", False)])
def test_grounding(spark, answer, passage, want):
    assert one(spark, context.grounded("a", "p"), a=answer, p=passage) is want


def test_vote(spark):
    df = spark.createDataFrame([(1, "Paris ", 1), (1, "Rome", 0), (1, "paris", 2), (2, "b", 1), (2, "a", 0), (3, " ", 0)], "q int, answer string, pos int")
    assert {r.q: r.answer for r in context.majority_vote(df, "q", "answer", "pos").collect()} == {1: "Paris ", 2: "a"}


# --- graph and propagation ----------------------------------------------------------------------------------------------


def random_graph(n=40, m=160, seed=2):
    r = random.Random(seed)
    return [(f"{r.choice(['schema', 'fact'])}:{r.randrange(n)}", f"{r.choice(['schema', 'passage'])}:{r.randrange(n)}", r.randint(1, 5) / 2) for _ in range(m)]


def ppr_loop(edges, seeds, alpha, iterations, hub):
    nodes = sorted({x for s, d, _ in edges for x in (s, d)})
    out, degree = {}, dict.fromkeys(nodes, 0)
    for s, d, w in edges:
        out[s] = out.get(s, 0) + w
        degree[s] += 1
        degree[d] += 1
    known = {k: v for k, v in seeds.items() if k in degree}
    total = sum(known.values())
    t = {x: known.get(x, 0) / total if total > 0 else 1 / len(nodes) for x in nodes}
    s = dict(t)
    for _ in range(iterations):
        flow = dict.fromkeys(nodes, 0.0)
        for a, b, w in edges:
            damp = 1 / math.log2(degree[b] + 2) if b.startswith("schema:") and degree[b] > hub else 1
            flow[b] += s[a] * w / out[a] * damp
        s = {x: (1 - alpha) * flow[x] + alpha * t[x] for x in nodes}
    return s


@pytest.mark.parametrize("seeds", [{"fact:1": 1.0, "gone:1": 5.0, "schema:2": 0.5}, {"gone:1": 1.0}])
def test_ppr_equals_a_loop(spark, seeds):
    edges = random_graph()
    e = spark.createDataFrame(edges, "src string, dst string, weight double")
    s = spark.createDataFrame(list(seeds.items()), "node_id string, score double")
    t = ppr.compile_transitions(e, hub_degree=6)
    got = {r.node_id: r.score for r in ppr.fixed_iterations(t, s, 3, alpha=0.3).collect()}
    assert got == pytest.approx(ppr_loop(edges, seeds, 0.3, 3, 6), abs=1e-12)
    score, state = ppr.run(t, s, alpha=0.3, epsilon=1e-4, max_iterations=40)
    assert stats.check_ppr(state, 1e-4, 40) == [] and state["converged"]
    assert {r.node_id: r.score for r in score.collect()} == pytest.approx(ppr_loop(edges, seeds, 0.3, state["iterations"], 6), abs=1e-9)


def test_ppr_of_nothing(spark):
    e = spark.createDataFrame([], "src string, dst string, weight double")
    _, state = ppr.run(ppr.compile_transitions(e), spark.createDataFrame([("a", 1.0)], "node_id string, score double"))
    assert state == {"iterations": 0, "converged": True, "l1": 0.0}


def test_components_equal_union_find(spark):
    r = random.Random(4)
    nodes, edges = [f"n{i:03}" for i in range(90)], [(f"n{r.randrange(90):03}", f"n{r.randrange(100):03}") for _ in range(60)] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(20)]
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = graph.connected_components(spark.createDataFrame([(n,) for n in nodes], "node_id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {x.node_id: x.component for x in got.collect()} == {n: find(n) for n in nodes}


def test_multi_hop_takes_first_discovery(spark):
    e = spark.createDataFrame([("a", "b", "r", 0.5), ("c", "a", "r", 1.0), ("b", "d", "r", 1.0), ("c", "d", "r", 0.9), ("d", "entity:x", "r", 1.0), ("d", "e", "r", 0.1)], "src string, dst string, relation string, weight double")
    got = graph.multi_hop(e, spark.createDataFrame([("a",)], "node_id string"), hops=3, least_weight=0.2)
    assert [(r.node_id, r.hop, round(r.path_weight, 6)) for r in got.collect()] == [("c", 1, 1.0), ("d", 2, 0.9), ("b", 1, 0.5)]


def test_checks_find_what_is_wrong(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 2.0, 2), (1, "b", 0.5, 4)], "g int, id string, score double, rank int")
    assert stats.check_unique(df, "g", "id").count() == 1 and stats.check_order(df, "g", "id").count() == 1
    assert stats.check_ranks(df, "g").count() == 1 and stats.check_range(df, "score", 0, 1).count() == 1 and stats.check_limit(df, "g", 2).count() == 1


# --- memory, lexicon, storage, ingestion ---------------------------------------------------------------------------------


def test_stable_is_sticky_and_repeats_do_not_count(spark):
    new = spark.createDataFrame([("s", 1), ("s", 1), ("s", 2), ("t", 1)], "schema_id string, doc_id long")
    seen = spark.createDataFrame([("s", 2)], "schema_id string, doc_id long")
    add = memory.contributions(new, seen)
    old = spark.createDataFrame([("s", 1, "pending"), ("u", 1, "stable")], "schema_id string, frequency long, state string")
    got = {r.schema_id: (r.frequency, r.state, r.newly_stable) for r in memory.stabilize(old, add).collect()}
    assert got == {"s": (2, "stable", True), "t": (1, "pending", False), "u": (1, "stable", False)}


def test_conflict_types(spark):
    cols = "fact_id string, head_entity string, relation string, tail_entity string, temporal_scope string, parent string, state string"
    new = spark.createDataFrame([("n", "A  b", "Is", "x", "1999", None, "active")], cols)
    old = spark.createDataFrame([("1", "a b", "is", "y", None, None, "active"), ("2", "a b", "is", "X", "2000", None, "active"), ("3", "a b", "is", "x", "1999", "p", "active"), ("4", "a b", "is", "x", "1999", None, "active"), ("5", "a b", "is", "z", None, None, "inactive"), ("n", "a b", "is", "q", None, None, "active")], cols)
    assert {r.other_id: r.conflict_type for r in memory.conflicts(new, old).collect()} == {"1": "mutually_exclusive", "2": "temporal", "3": "granularity"}


def test_phrase_match_needs_boundaries(spark):
    e = spark.createDataFrame([("art", "Art", ["fine art"], 20, 0.5), ("new york", "NYC", ["big apple"], 2, 0.9)], "term string, canonical string, aliases array<string>, frequency int, confidence double")
    t = spark.createDataFrame([(1, "a party of FINE ART, no more"), (2, "The Big Apple!"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.term): (r.matched, round(r.boost, 6)) for r in lexicon.match_phrases(t, e).collect()}
    assert got == {(1, "art"): ("art", 2.5), (2, "new york"): ("big apple", 2.1)}


def test_text_evidence(spark):
    p = spark.createDataFrame([("p", "Acme, also known as Apex; the World Bank (WB) works. Rover, a dog, barks")], "passage_id string, text string")
    got = {(r.kind, r.left, r.right) for r in lexicon.text_evidence(p).collect()}
    assert ("apposition", "Acme", "Apex") in got and any(k == "parenthetical" and r == "WB" for k, _, r in got) and any(k == "hypernym" and r == "dog" for k, _, r in got)


def test_request_order_and_repeats(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert [r.id for r in store.by_ids(df, "id", ["b", "", "a", "b", "none"]).collect()] == ["b", "a"]


def test_markdown_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("# B")
    (tmp_path / "a.md").write_text("# A é")
    (tmp_path / "c.txt").write_text("no")
    got = store.markdown_files(spark, str(tmp_path)).collect()
    assert [(r.title, r.text) for r in got] == [("a", "# A é"), ("b", "# B")] and all(r.doc_id.startswith("doc_") and len(r.doc_id) == 16 for r in got)


def test_stream_restarts_where_it_stopped(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string"
    src, db, ck = (str(tmp_path / x) for x in ("in", "db", "ck"))
    spark.createDataFrame([(1, "one", "en", "s"), (2, " ", "en", "s"), (None, "x", "en", "s")], cols).coalesce(1).write.parquet(src)
    batches = []
    ingest.ingest(spark, src, db, ck, on_batch=batches.append).awaitTermination()
    ingest.ingest(spark, src, db, ck, on_batch=batches.append).awaitTermination()
    assert batches == [0]
    spark.createDataFrame([(1, "changed", "en", "s"), (3, "three", "en", "s")], cols).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(spark, src, db, ck, on_batch=batches.append).awaitTermination()
    got = {r.doc_id: r.text for r in ingest.Store(spark, db).read("passages", ingest.PASSAGES).collect()}
    assert batches == [0, 1] and got == {1: "changed", 3: "three"}
    assert {r.reason for r in spark.read.parquet(f"{db}/quarantine").collect()} == {"no id", "no text"}


def test_deltas_are_merged(spark, tmp_path):
    db = ingest.Store(spark, str(tmp_path))
    docs = lambda *rows: spark.createDataFrame([(i, t, "en", "s") for i, t in rows], ingest.SCHEMA)
    read = lambda: {r.doc_id: r.text for r in db.read("passages", ingest.PASSAGES).collect()}
    assert read() == {}
    ingest.index_batch(db, docs((1, "a"), (2, "b")), 1, compact=2)
    assert read() == {1: "a", 2: "b"} and db.versions("passages") == []
    ingest.index_batch(db, docs((2, "c"), (None, "x")), 2, compact=2)
    assert read() == {1: "a", 2: "c"} and db.versions("passages") == [2]
    ingest.index_batch(db, docs((2, "c"), (None, "x")), 2, compact=2)  # again, after it was merged
    ingest.index_batch(db, docs((3, "d"), (1, "e")), 3, compact=2)
    assert read() == {1: "e", 2: "c", 3: "d"} and db.versions("passages") == [2] and db.deltas("passages", 2) == [3]


def test_versioned_cache():
    now, calls = [0.0], []

    def load(v):
        calls.append(v)
        if v == "bad":
            raise OSError
        return f"value {v}"

    c = ingest.VersionedCache(load, first_wait=1, clock=lambda: now[0])
    with pytest.raises(OSError):
        c.get("bad")
    assert c.get("1") == "value 1" and c.get("1") == "value 1" and calls == ["bad", "1"]
    assert c.get("bad") == "value 1" and c.get("bad") == "value 1" and calls.count("bad") == 2
    now[0] = 1.5
    assert c.get("bad") == "value 1" and calls.count("bad") == 3 and c.until == 3.5
    assert c.get("2") == "value 1"
    now[0] = 4.0
    assert c.get("2") == "value 2"


def test_gather_tolerates_some_failures():
    ok, failed = ingest.gather({"a": lambda: 1, "b": lambda: 1 / 0})
    assert ok == {"a": 1} and "division" in failed["b"]
    with pytest.raises(RuntimeError):
        ingest.gather({"b": lambda: 1 / 0})


def test_provider_batches(spark):
    def provider(t: pd.Series) -> pd.Series:
        return t.map(lambda x: '{"relations": [{"head":"%s","headType":"t","relation":"r","tail":"b","tailType":"t","confidence":0.5}]}' % len(x))

    df = spark.createDataFrame([(1, "x" * 5000), (2, "yy")], "doc_id long, text string")
    assert {r.doc_id: r.head for r in extraction.extract_with(df, provider).collect()} == {1: "3000", 2: "2"}


# --- replies of models -------------------------------------------------------------------------------------------------


def test_comparisons_are_asked_again(spark):
    from strandloom.operators import providers

    asked = []

    def answerer(prompts, sample):
        asked.extend(prompts)
        return ["Alpha is old, but Beta is new.\nFINAL: Alpha" if "Q2" in p else "FINAL: no" if "Q3" in p else None for p in prompts]

    rows = [("Q1", "c", "A is 1 while B is 2", "A"), ("Q2", "c", "Yes", "Yes"), ("Q3", "c", "Yes", "Yes"), ("Q4", "c", "Yes", "Yes")]
    df = spark.createDataFrame(rows, "query string, context string, reply string, answer string")
    got = {r.query: (r.answer, r.verified) for r in providers.verify_comparisons(df, answerer).collect()}
    assert got == {"Q1": ("A", True), "Q2": ("Alpha", True), "Q3": ("Yes", False), "Q4": ("Yes", False)}


def test_two_hops(spark):
    from strandloom.operators import providers

    good = '{"hop1SubQuestion": "Who wrote Emma?", "hop2SubQuestion": "Where was {hop1Answer} born?"}'
    plans = {"ok": good, "json": "nope", "none": None, "lost": good.replace("Emma", "Lost"), "hop1": good.replace("Emma", "Void"), "hop2": good.replace("born", "buried"), "again": good.replace("born", "schooled")}

    def decomposer(prompts, _):
        return [plans[p.split('"')[1]] for p in prompts]

    def answerer(prompts, sample):
        reply = {"Who wrote Emma?": "FINAL: Jane Austen", "Who wrote Lost?": "FINAL: Nobody Known", "Who wrote Void?": "", "Where was Jane Austen born?": "thought\nFINAL: Steventon", "Where was Jane Austen buried?": "FINAL: Atlantis", "Where was Jane Austen schooled?": ["FINAL: Oxford", "FINAL: Reading", "FINAL: reading"][sample]}
        return [reply[p.split("Question: ")[1]] for p in prompts]

    passages = [("p1", "Jane Austen wrote Emma."), ("p2", "She was born in Steventon and went to school in Reading or Oxford.")]
    df = spark.createDataFrame([(q, passages) for q in plans], "query string, passages array<struct<id:string,text:string>>")
    got = {r.query: (r.answer, r.fallback_reason) for r in providers.reason_in_two_hops(df, decomposer, answerer).collect()}
    assert got == {"ok": ("Steventon", None), "json": ("", "decomposition_parse_error"), "none": ("", "llm_api_error"), "lost": ("", "hop1_ungrounded"), "hop1": ("", "hop1_empty"), "hop2": ("", "hop2_ungrounded"), "again": ("Oxford", None)}
    voted = {r.query: (r.answer, r.hop2_passages) for r in providers.reason_in_two_hops(df, decomposer, answerer, samples=3).collect()}
    assert voted["again"] == ("Reading", ["p2"]) and voted["ok"] == ("Steventon", ["p2"])


def test_active_limit_of_conflicts(spark):
    rows = [(f"f{i}", "h", "r", f"t{i}", None, None, "active") for i in range(6)]
    facts = spark.createDataFrame(rows, "fact_id string, head_entity string, relation string, tail_entity string, temporal_scope string, parent string, state string")
    got = {r.fact_id: r.others for r in memory.conflict_sets(facts, facts, 2).collect()}
    assert got == {"f0": ["f1", "f2"], "f1": ["f0", "f2"], **{f"f{i}": ["f0", "f1"] for i in range(2, 6)}}
    assert memory.conflicts(facts, facts).count() == 30
