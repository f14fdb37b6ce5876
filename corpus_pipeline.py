"""The corpus pipeline: five stages over documents, each calling one operator of strandloom.llm.

Rejected documents go (1), one document of each near-duplicate group stays (9; five-word shingles, Jaccard 0.8), personal data is replaced in the text (5),
documents are sampled to target weights (6), and what is left is packed into token windows (7). Every stage but the last
returns the columns of documents. Nulls, ties and odd inputs are treated as the operators' docstrings say.
"""

from __future__ import annotations

from strandloom.llm import mixing, ngram_join, packing, pii, quality_rules
from strandloom.llm.common import written

STAGES = [
    ("quality_rules", lambda spark, docs, sf_dir: quality_rules.keep_good(docs)),
    ("ngram_join", lambda spark, docs, sf_dir: ngram_join.first_of_each(docs, n=5, percent=80)),
    ("pii", lambda spark, docs, sf_dir: pii.redact(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.sample(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack(docs)),
]
#: SQL has no tokenizer: the last stage can't be expressed. tests/llm/test_pipeline.py holds run() against a brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, in order; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
