"""Entity and triple extraction (EXT-1 to EXT-5) and the provider interface for models."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandloom.functions.text import ascii_boundaries

# --- fixed values: entity patterns by label and language -----------------------------------------------------------------
PATTERNS = (
    ("ENTITY", "en", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
    ("ACRONYM", "en", r"\b[A-Z]{2,6}\b"),
    ("COMPOUND", "en", r"\b[A-Za-z]+-[A-Za-z]+(?:-[A-Za-z]+)*\b"),
    ("KATAKANA", "ja", r"[\x{30A0}-\x{30FF}]{2,}"),
    ("KANJI_COMPOUND", "ja", r"[\x{4E00}-\x{9FFF}]{2,}"),
)
# ---------------------------------------------------------------------------------------------------------------------
Provider = Callable[[pd.Series], pd.Series]


def regex_entities(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """EXT-1: (key, text, label, start, end) of pattern matches in texts of the pattern's language (or 'mixed').

    Of equal surfaces in a document the first in the order pattern, place stays. Offsets follow from the split around the
    matches, so nothing leaves the JVM.
    """
    found = None
    for order, (label, lang, pattern) in enumerate(PATTERNS):
        pattern = ascii_boundaries(pattern)
        rows = docs.filter(F.col("language").isin(lang, "mixed"))
        gaps = F.transform(F.split("text", pattern, -1), lambda x: F.length(x))
        hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        step = lambda acc, x: F.struct((acc["at"] + x.g + F.length(x.m)).alias("at"), F.concat(acc.out, F.array(F.struct(x.m.alias("text"), (acc["at"] + x.g).alias("start")))).alias("out"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))
        both = F.filter(F.zip_with(gaps, hits, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda x: x.m.isNotNull())
        part = rows.select(key, F.lit(order).alias("order"), F.lit(label).alias("label"), F.explode(F.aggregate(both, zero, step, lambda acc: acc.out)).alias("e"))
        part = part.select(key, "order", "label", "e.text", "e.start", (F.col("e.start") + F.length("e.text")).alias("end"))
        found = part if found is None else found.unionByName(part)
    first = Window.partitionBy(key, "text").orderBy("order", "start")
    return found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select(key, "text", "label", "start", "end")


def noun_phrases(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """EXT-2 offline: title-case phrases as noun phrases; a language model or parser can stand in as a provider."""
    return docs.filter(F.col("language").isin("en", "mixed")).select(key, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ascii_boundaries(PATTERNS[0][2])), F.lit(0)))).alias("phrase"))


def parse_triples(reply: Column) -> Column:
    """EXT-3: relations of a model's JSON reply, fences stripped; those without any of the five strings or a finite confidence go."""
    body = F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    rel = "struct<head:string,headType:string,relation:string,tail:string,tailType:string,confidence:double>"
    rows = F.coalesce(F.from_json(body, f"struct<relations:array<{rel}>>").relations, F.array().cast(f"array<{rel}>"))
    ok = lambda r: r.head.isNotNull() & r.headType.isNotNull() & r.relation.isNotNull() & r.tail.isNotNull() & r.tailType.isNotNull() & r.confidence.isNotNull() & ~F.isnan(r.confidence)
    return F.filter(rows, ok)


def extract_with(docs: DataFrame, provider: Provider, key: str = "doc_id", longest: int = 3000) -> DataFrame:
    """EXT-3: triples from a provider that maps texts (cut to ``longest`` characters, as the model's input) to JSON replies, batch by batch."""

    def reply(texts: pd.Series) -> pd.Series:
        return provider(texts)

    call = F.pandas_udf(reply, StringType())
    return docs.select(key, F.explode(parse_triples(call(F.substring("text", 1, longest)))).alias("r")).select(key, "r.*")


def merge_entities(*lists: Column) -> Column:
    """EXT-4: distinct trimmed names of all lists, in order; empty ones go."""
    return F.array_distinct(F.filter(F.transform(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists]), lambda x: F.trim(x)), lambda x: x != ""))


def boost(records: DataFrame, matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """EXT-5: composite canonical forms (with a space or hyphen) found in a text join its entities."""
    add = matches.filter(F.col("canonical").rlike("[ -]")).groupBy(key).agg(F.array_sort(F.collect_set("canonical")).alias("__add"))
    return records.join(add, key, "left").withColumn("entities", F.array_union("entities", F.coalesce("__add", F.array().cast("array<string>")))).drop("__add")
