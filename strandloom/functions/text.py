"""Text operators as column expressions; Python only for Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandloom.functions.ids import SPACE

# --- fixed values ----------------------------------------------------------------------------------------------------
JAPANESE = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
COMPARISON = (
    r"\b(who is (more|less|taller|shorter|older|younger|bigger|smaller|larger|heavier|lighter)"
    r"|(?:compare|comparison|differ(?:ent|ence)?|between)\b.*\b(?:and|or|vs)\b"
    r"|(?:which|who)\b.*\b(?:more|less|earlier|later|first|last|bigger|smaller|larger|longer|shorter|higher|lower|greater|fewer|older|younger|taller|heavier|lighter)\b"
    r"|(?:both)\b.*\b(?:and|or)\b|\b(?:are both|were both|is both)\b"
    r"|(?:which is a|which was a|which is an|which was an)\b.*\b(?:,|or)\b"
    r"|(?:which \w+)\b.*\b(?:,\s*\w+\s+(?:\w+\s+)*or\s+)"
    r"|(?:^are |^were |^did |^do |^is |^was |^have |^has ).*\b(?:and|or)\b"
    r"|(?:\w+\s+or\s+\w+).*(?:\?|$).*\b(?:which|what)\b|\bolder\b|\bnewer\b"
    r"|\bfounded (?:earlier|later|first|before|after)\b|\b(?:was|were)\b.*\b(?:before|after)\b"
    r"|\bboth (?:held|share|hold|have|had)\b|\bhave in common\b|\bin common\b"
    r"|\bsame (?:type|kind|genre|country|city|decade|century|year)\b)"
)
BRIDGE = (
    r"\bthe (?:person|one|man|woman|city|country|team|company|organization|film|movie|book|album|song|show|series|band|group|school|university) (?:who|that|which)\b",
    r"\bwho(?:'s| is| was| has| had| did)\b.+\b(?:also|then|later|before|after)\b",
    r"\bwhere (?:did|does|was|is)\b.+\b(?:who|that|which)\b",
    r"\b(?:born|founded|located|headquartered|based) in\b.+\b(?:who|that|which)\b",
)
API_STOP_WORDS = (
    "about after also analysis and approach based between data deep for from into method methods model models new paper "
    "study system that the their these this using with within without"
).split()
HALF_KATAKANA_MARKS = ("ー", "-‐‑–—―−ｰ")
# ---------------------------------------------------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def ascii_boundaries(pattern: str) -> str:
    """The pattern with word boundaries that know ASCII words only."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def preprocess_markdown(text) -> Column:
    """TXT-1: NFKC, no control characters, one kind of line end, single spaces, at most one empty line, trimmed."""
    t = F.regexp_replace(nfkc(_c(text)), CONTROL, "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\r\n?", "\n"), "[\t ]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def detect_language(text) -> Column:
    """TXT-2"""
    return F.when(_c(text).rlike(JAPANESE), "ja").otherwise("en")


def words(text) -> Column:
    return F.filter(F.split(_c(text), r"\s+"), lambda w: w != "")


def estimate_tokens(text) -> Column:
    """TXT-3: words, or half a token per character of a Japanese text."""
    t = _c(text)
    return F.when(t.rlike(JAPANESE), F.ceil(F.length(t) * 0.5)).otherwise(F.size(words(t))).cast("long")


def context_tokens(text) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(F.length(_c(text)) / 4).cast("long")


def fullwidth_to_ascii(t: Column) -> Column:
    return F.translate(t, "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))) + " ")


def normalize_japanese(text) -> Column:
    """TXT-4: NFKC, full width to half, no long-vowel mark at the end of a katakana run, trimmed."""
    t = fullwidth_to_ascii(nfkc(_c(text)))
    return F.trim(F.regexp_replace(t, r"([\x{30A0}-\x{30FB}\x{30FD}-\x{30FF}])ー+(?![\x{30A0}-\x{30FF}])", "$1"))


def japanese_key(text) -> Column:
    """TXT-5: TXT-4, dashes as long-vowel marks, katakana as hiragana, no long-vowel mark at the end, lower case, single spaces."""
    t = F.translate(normalize_japanese(text), "‐‑–—―−", "ー" * 6)
    t = F.translate(t, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, "ー+$", "")), SPACE, " "))


def normalize_english(text) -> Column:
    """TXT-6"""
    return F.trim(F.lower(_c(text)))


def english_key(text) -> Column:
    return F.trim(F.regexp_replace(F.lower(_c(text)), SPACE, " "))


def normalize_query(text) -> Column:
    """TXT-8"""
    return F.trim(F.regexp_replace(_c(text), SPACE, " "))


def lexical_tokens(text) -> Column:
    """TXT-9: lower case, other than a-z and 0-9 to spaces, words of two characters or more, in order, with repeats."""
    return F.filter(F.split(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) >= 2)


def term_set(text) -> Column:
    """TXT-10: distinct runs of letters and numbers, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def normalize_grounding(text) -> Column:
    """TXT-11"""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def hop_similarity(a, b) -> Column:
    """TXT-11: containment for up to three words, else Jaccard of the words."""
    na, nb = normalize_grounding(a), normalize_grounding(b)
    wa, wb = F.split(na, " "), F.split(nb, " ")
    some = F.when(F.size(wa) <= 3, F.when(F.contains(nb, na), 1.0).otherwise(0.0)).otherwise(jaccard(F.array_distinct(wa), F.array_distinct(wb)))
    return F.when((na == "") | (nb == ""), 0.0).otherwise(some)


def chunk_features(text, section=None) -> Column:
    """TXT-12: code, table and reference signs of a chunk."""
    t = _c(text)
    refs = t.rlike(r"(?m)^\[[0-9]+\]")
    if section is not None:
        refs = refs | F.exists(_c(section), lambda s: F.lower(s).contains("references"))
    return F.struct(t.contains("```").alias("has_code"), t.rlike(r"\|.+\|").alias("has_table"), refs.alias("has_references"))


def markdown_flags(text) -> Column:
    """TXT-13: which signs a document shows; ``well-formed`` if none."""
    t = _c(text)
    found = F.array_compact(
        F.array(
            F.when(t.contains("```"), "code-heavy"),
            F.when(t.rlike(r"(?m)^\|.*\|$"), "table-heavy"),
            F.when(t.rlike(r"(?m)^\[[0-9]+\]") | t.rlike(r"(?im)^#+\s+references"), "references-present"),
        )
    )
    return F.when(F.size(found) == 0, F.array(F.lit("well-formed"))).otherwise(found)


def markdown_score(flags) -> Column:
    bad = F.size(F.filter(_c(flags), lambda f: f != "well-formed"))
    return F.greatest(F.lit(0.2), 1 - bad * 0.2)


def is_comparison(text) -> Column:
    """TXT-15"""
    return _c(text).rlike("(?i)" + ascii_boundaries(COMPARISON))


def is_bridge(text) -> Column:
    """TXT-16"""
    out = F.lit(False)
    for p in BRIDGE:
        out = out | _c(text).rlike("(?i)" + ascii_boundaries(p))
    return out


def final_answer(text) -> Column:
    """TXT-17: what follows the first ``FINAL:`` line, else the last line that is not empty; one quote off each end."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.trim(x))
    marked = F.try_element_at(F.filter(lines, lambda x: F.upper(x).startswith("FINAL:")), F.lit(1))
    last = F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(-1))
    chosen = F.when(F.exists(lines, lambda x: F.upper(x).startswith("FINAL:")), F.trim(F.substring(marked, 7, 1 << 20))).otherwise(F.coalesce(last, F.lit("")))
    return F.regexp_replace(F.regexp_replace(chosen, "^[\"']", ""), "[\"']$", "")


def truncate(text, limit: int = 160) -> Column:
    """TXT-18"""
    t = _c(text)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def api_terms(text) -> Column:
    """TXT-19: distinct words of four characters or more that are no stop words, then pairs of neighbours among these."""
    t = F.trim(F.regexp_replace(F.regexp_replace(_c(text), r"[^a-zA-Z0-9\s-]", " "), r"\s+", " "))
    w = F.filter(F.transform(F.split(t, " "), lambda x: F.lower(x)), lambda x: (F.length(x) >= 4) & ~x.isin(*API_STOP_WORDS))
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))))


def normalize_api_term(text) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9\s-]", " "), r"\s+", " "))


def title_case(text) -> Column:
    """Each word's first character in upper case, the rest as it is."""
    w = F.filter(F.split(_c(text), " "), lambda x: x != "")
    return F.array_join(F.transform(w, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))), " ")


def format_hint(term, aliases, category) -> Column:
    """TXT-20: a dictionary hint with at most three aliases and the category."""
    some = F.slice(_c(aliases), 1, 3)
    also = F.when(F.size(some) > 0, F.concat(F.lit(" (also: "), F.array_join(some, ", "), F.lit(")"))).otherwise("")
    return F.concat(F.lit("- "), _c(term), also, F.concat(F.lit(" ["), _c(category), F.lit("]")))


def escape_lexical_query(text) -> Column:
    """TXT-22: a backslash before each character that a full-text query language reads as an operator."""
    return F.regexp_replace(_c(text), r'([+\-!(){}\[\]^"~*?:\\/]|&&|\|\|)', r"\\$1")


def lower_unicode(text) -> Column:
    """TXT-21: full lower case, a capital sigma at the end of a word as the final form."""
    t = F.regexp_replace(_c(text), r"(?<=\p{L})Σ(?!\p{L})", "ς")
    return F.lower(t)
