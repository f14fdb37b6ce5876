"""Chunking (CHK-1 to CHK-5): one document to many chunks.

Greedy filling is sequential within a document, so chunking runs in Arrow batches with mapInPandas; no shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values ----------------------------------------------------------------------------------------------------
MOST_TOKENS = {"en": 800, "ja": 500}
HEADING = re.compile(r"^(#{1,6})[^\S\n]+(.*)$|^(#{1,6})\s+(.*)$", re.M)
JAPANESE = re.compile("[぀-ゟ゠-ヿ一-鿿㐀-䶿]")
SENTENCE = re.compile(r".*?(?:[。.!?]|$)", re.S)
# ---------------------------------------------------------------------------------------------------------------------
SCHEMA = "doc_id long, chunk_id string, chunk_index int, text string, section_path array<string>, offset_start int, offset_end int, language string"


def language(text: str) -> str:
    return "ja" if JAPANESE.search(text) else "en"


def tokens(text: str) -> int:
    return math.ceil(0.5 * len(text)) if JAPANESE.search(text) else len(text.split())


def paragraphs(text: str, most: int, overlap: int = 1) -> list[str]:
    """CHK-2: paragraphs filled up to ``most`` tokens; the last ones of a chunk begin the next."""
    chunks, now, size = [], [], 0
    for p in (p for p in re.split(r"\n{2,}", text) if p.strip()):
        n = tokens(p)
        if now and size + n > most:
            chunks.append("\n\n".join(now))
            now = now[-overlap:] if overlap else []
            size = sum(map(tokens, now))
        now.append(p)
        size += n
    return [*chunks, "\n\n".join(now)] if now else chunks


def sentences(text: str, most: int, overlap: int = 1) -> list[str]:
    """CHK-5: the same over sentences, split at sentence marks."""
    chunks, now, size = [], [], 0
    for s in (m[0].strip() for m in SENTENCE.finditer(text) if m[0].strip()):
        n = tokens(s)
        if now and size + n > most:
            chunks.append("".join(now) if language(text) == "ja" else " ".join(now))
            now = now[-overlap:] if overlap else []
            size = sum(map(tokens, now))
        now.append(s)
        size += n
    return [*chunks, "".join(now) if language(text) == "ja" else " ".join(now)] if now else chunks


def chunk(text: str | None, by_sentence: bool = False) -> list[tuple[str, list[str], int, int]]:
    """CHK-1, CHK-3, CHK-4: (text, section path, start, end) of a document's chunks; text before the first heading is left out."""
    if not text or not text.strip():
        return []
    lang = language(text)
    most, split = MOST_TOKENS[lang], sentences if by_sentence else paragraphs
    heads = list(HEADING.finditer(text))
    if not heads:
        body = text.strip()
        if tokens(body) > most:
            return [(p, [], 0, len(p)) for p in split(body, most)]
        return [(body, [], 0, len(body))]
    out, stack = [], []
    for i, m in enumerate(heads):
        level, title = len(m[1] or m[3]), (m[2] if m[1] else m[4]).strip()
        end = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        body = text[m.start() : end].strip()
        if not body:
            continue
        path = [t for _, t in stack]
        parts = split(body, most) if lang == "ja" and tokens(body) > most else [body]
        out += [(p, path, m.start(), end) for p in parts]
    return out


def chunk_documents(docs: DataFrame, by_sentence: bool = False) -> DataFrame:
    """Chunks of (doc_id, text) rows; see SCHEMA. Null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, f"{d}:{i}", i, t, path, a, z, language(t)) for d, text in zip(pdf.doc_id, pdf.text, strict=True) for i, (t, path, a, z) in enumerate(chunk(text, by_sentence))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, SCHEMA)
