"""Operator 6: marginals after raking, calibration, and odd inputs. The SQL of the query covers the corpus."""

from pyspark.sql import functions as F
from strandloom.llm import mixing


def test_marginals_and_calibration(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    df = mixing.with_sample(docs, share=0.5, rounds=30).select("__cell.*", "__mix.*").cache()
    fitted = {r[0]: r[1] for r in df.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
    seen = {r[0]: r[1] for r in df.groupBy("source").agg(F.sum("n_tokens")).collect()}
    for s in fitted:
        assert abs(fitted[s] / sum(fitted.values()) - seen[s] ** 0.5 / sum(v**0.5 for v in seen.values())) < 1e-3
    total, expected, got = df.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability")), F.sum(F.when(F.col("sampled"), F.col("n_tokens")))).first()
    assert abs(expected / total - 0.5) < 1e-6 and abs(got / total - 0.5) < 0.05


def test_production_rounds_meet_the_marginals(spark):
    """The query's own rounds: every source, language and topic within half a percent of its target share."""
    df = mixing.with_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("__cell.*", "__mix.*").cache()
    for d in mixing.DIMENSIONS:
        rows = df.groupBy(d).agg(F.sum(F.col("n_tokens") * F.col("weight")).alias("fitted"), F.sum("n_tokens").alias("seen")).collect()
        target, total = sum(r.seen**0.5 for r in rows), sum(r.fitted for r in rows)
        assert max(abs(r.fitted / total - r.seen**0.5 / target) for r in rows) < 5e-3


def test_given_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {"lang": {"en": 0.25, "fr": 0.25, "de": 0.25, "es": 0.25}}
    df = mixing.with_sample(docs, given=want, rounds=30).select("__cell.*", "__mix.*")
    fitted = [r[1] for r in df.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()]
    assert max(fitted) / min(fitted) < 1.05


def test_odd_inputs(spark):
    rows = [(1, None, None, None, 1), (2, "", "a", "en", 1), (None, "one two", "a", "en", 1), (4, "  spaced  out ", "a", "en", 1), (4, "  spaced  out ", "a", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.source, r.n_tokens) for r in mixing.mix(df).collect()))
    assert got == [(0, "a", 2), (1, "(none)", 0), (2, "a", 0), (4, "a", 2), (4, "a", 2)]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.sample(df).columns == df.columns
