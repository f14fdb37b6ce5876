"""The training-data queries and their SQL, by name."""

from __future__ import annotations

from strandloom.llm import mil_quality, mixing, ngram_join, oracles, packing, pii, ppm, quality_rules, suffix_dedup, syncmers, word_bpe
from strandloom.llm.common import documents, labels


def queries() -> dict:
    return {
        "op1_quality_rules": lambda s, d: quality_rules.quality_rules(documents(s, d)),
        "op2_token_counts": lambda s, d: word_bpe.token_counts(documents(s, d)),
        "op3_suffix_dedup": lambda s, d: suffix_dedup.dedup(documents(s, d)),
        "op4_mil_quality": lambda s, d: mil_quality.score(documents(s, d), labels(s, d)),
        "op5_pii": lambda s, d: pii.find_personal_data(documents(s, d)),
        "op6_mixing": lambda s, d: mixing.mix(documents(s, d)),
        "op7_packing": lambda s, d: packing.pack(documents(s, d)),
        "op8_fingerprints": lambda s, d: syncmers.fingerprints(documents(s, d)),
        "op9_ngram_join": lambda s, d: ngram_join.similar(documents(s, d), n=3, percent=90),
        "op10_ppm": lambda s, d: ppm.score(documents(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.oracle(),
        "op3_suffix_dedup": oracles.SUFFIX_DEDUP,
        "op6_mixing": mixing.oracle(),
        "op9_ngram_join": oracles.NGRAM_JOIN,
    }
