"""Operator 9 against all pairs in Python."""

import random

from strandloom.llm import ngram_join
from strandloom.llm.components import components


def brute(rows, n=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * (k := len(sets[i] & sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                comp[a] = b
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    least = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return ordered((rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows)))


def ordered(found):
    return sorted(found, key=lambda r: [(x is None, x or 0) for x in r])


def run(spark, rows, n=3, percent=90):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, size int").repartition(3)
    return ordered((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar(df, n, percent).collect())


def test_edges(spark):
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "Hello"), (5, "hello"), (4, "HELLO world"), (3, "hello World\n"), (2, "world hello"), (12, "a b c"), (11, "a b c a b c"), (10, "É a b c"), (13, "é a b c"), (5, "hello")]
    assert run(spark, rows) == brute(rows)


def test_random_near_copies(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    rows, bases = [], [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(15)]
    for i in range(260):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.3:
            w = w[: r.randint(5, 30)] + passage
        if r.random() < 0.2:
            w = w[: -r.randint(1, 6)]
        rows.append((1000 - i, " ".join(w)))
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_corpus(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_one_is_kept(spark):
    df = spark.createDataFrame([(1, "a b c d", "x"), (2, "A b c d", "y"), (3, "", "z"), (None, "q", "n"), (3, "", "z")], "doc_id long, text string, component string")
    assert sorted((str(r.doc_id), r.component) for r in ngram_join.first_of_each(df, 3, 90).collect()) == [("1", "x"), ("3", "z"), ("None", "n")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 150: 100}


def test_empty(spark):
    assert run(spark, []) == []


def test_shared_and_missing_ids(spark):
    word = lambda k: [f"{k}{i}" for i in range(40)]
    a, b, c, d = (" ".join(word(k)) for k in "abcd")
    near = lambda t: t + " z"
    rows = [(7, a), (7, b), (5, near(a)), (3, near(b)), (None, c), (None, c), (None, near(c)), (None, d), (9, near(d)), (None, ""), (None, "e"), (7, a)]
    assert run(spark, rows) == brute(rows)
    assert {(i, x) for i, _, x in run(spark, rows)} >= {(7, 5), (7, 3), (5, 5), (3, 3), (None, None), (None, 9), (9, 9)}
    assert len({x for i, _, x in run(spark, [(1, a), (1, b), (9, near(b))])}) == 1


def test_no_text_without_a_near_copy_is_lost(spark):
    r = random.Random(8)
    bases = [" ".join(f"{r.choice('abcdefgh')}{r.randint(0, 30)}" for _ in range(r.randint(20, 60))) for _ in range(25)]
    rows = [(r.choice([None, None, 1, 2, 3, r.randint(0, 400)]), r.choice(bases) + r.choice(["", "", " x", " y z", " " + r.choice(bases)])) for _ in range(250)]
    got = [(x.doc_id, x.text) for x in ngram_join.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 90).collect()]
    numbered = [(i, t) for i, (_, t) in enumerate(rows)]
    component = {i: x for i, _, x in brute(numbered)}
    groups = {}
    for i, x in component.items():
        groups.setdefault(x, []).append(rows[i])
    assert len(got) == len(groups)
    want = ordered((min((j for j, _ in g if j is not None), default=None),) for g in groups.values())
    assert ordered((i,) for i, _ in got) == want and all(any(x in g for x in got) for g in groups.values())
