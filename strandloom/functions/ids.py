"""Identifier rules: join keys that every operator must build alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of identifiers and keys: ASCII, no-break and ideographic space, byte-order mark.
SPACE = r"[\s\x{A0}\x{3000}\x{FEFF}]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def document_id(path) -> Column:
    """``doc_`` and twelve hex digits of the path's SHA-1."""
    return F.concat(F.lit("doc_"), F.substring(F.sha1(_c(path).cast("binary")), 1, 12))


def chunk_id(document, index) -> Column:
    return F.concat(_c(document).cast("string"), F.lit(":"), _c(index).cast("string"))


def passage_id(chunk) -> Column:
    return F.concat(F.lit("passage:"), _c(chunk))


def term(x) -> Column:
    """A schema term for keys: lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_c(x)), SPACE, " "))


def canonical_key(head_type, relation, tail_type) -> Column:
    return F.concat_ws("::", term(head_type), term(relation), term(tail_type))


def schema_id(head_type, relation, tail_type) -> Column:
    return F.concat(F.lit("schema:"), canonical_key(head_type, relation, tail_type))


def fact_id(document, schema, head, relation, tail) -> Column:
    """Every run of white space in the whole id becomes an underscore."""
    return F.regexp_replace(F.concat_ws(":", F.lit("fact"), _c(document).cast("string"), _c(schema), _c(head), _c(relation), _c(tail)), SPACE, "_")


def entity_key(name) -> Column:
    return F.regexp_replace(F.lower(_c(name)), SPACE, "_")


def node_id(layer: str, ref) -> Column:
    return F.concat(F.lit(f"{layer}:"), _c(ref))


def text_hash(text) -> Column:
    """Sixteen hex digits of the SHA-256 of a text in lower case with white space collapsed and trimmed."""
    return F.substring(F.sha2(F.lower(F.trim(F.regexp_replace(_c(text), SPACE, " "))), 256), 1, 16)


def passage_dedup_key(url, text) -> Column:
    return F.concat(F.coalesce(_c(url), F.lit("")), F.lit("::"), text_hash(text))


def is_identifier(x) -> Column:
    """Letters, digits, underscore and hyphen, 1 to 128 of them."""
    return F.coalesce(_c(x).rlike(r"^[A-Za-z0-9_-]{1,128}$"), F.lit(False))
