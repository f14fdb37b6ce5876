"""Operator 1: quality rules, one threshold table compiled into one projection.

Every rule is a row of RULES: two metrics and a bound on their ratio. The table compiles to one boolean SQL expression
over metric columns; metrics are built-in expressions only (no user functions). A document costs one pass and no shuffle.

Stop words are known for languages in Latin letters, so their share is taken of the words without a letter of another script: a
text wholly in another script has none and the rule lets it pass.

Defined results: a null text counts as empty; an empty text has 0 in every metric and fails; repeated rows each get their
own verdict; an empty table gives an empty result; further columns of the input never clash, since metrics are kept in one
struct until the end. Very long texts are handled in the row: window hashes are sorted, O(n log n).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import let, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a and are as at be by for from in is it not of on or that the this to was with "
    "au ce dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "als auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "al con del el es las lo los no por se su una y"
).split()
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ"
#: Letters of scripts that the stop words are not written in: Greek to Georgian and on, East Asian, the supplementary planes without emoji.
OTHER_SCRIPT = r"[\x{0370}-\x{1DFF}\x{2E80}-\x{D7FF}\x{F900}-\x{FAFF}\x{10000}-\x{1EFFF}\x{20000}-\x{3FFFF}]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


@dataclass(frozen=True)
class Rule:
    """Keeps a document if ``low * of <= 100 * metric <= high * of`` (either bound may be None)."""

    name: str
    metric: str
    of: str
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        parts = [f"{self.low} * {self.of} <= 100 * {self.metric}"] if self.low is not None else []
        parts += [f"100 * {self.metric} <= {self.high} * {self.of}"] if self.high is not None else []
        return " AND ".join(parts)

    def on(self, m: Column) -> Column:
        """The same over a struct of metrics."""
        x, y = 100 * m.getField(self.metric), m.getField(self.of)
        low = x >= self.low * y if self.low is not None else F.lit(True)
        return low & (x <= self.high * y) if self.high is not None else low


#: The thresholds, in percent of the second metric.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 2500),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 20),
    Rule("exclamations_per_word", "n_exclaim", "n_words", None, 30),
    Rule("capitals_per_character", "n_capitals", "word_chars", None, 40),
    Rule("stop_words_per_latin_word", "n_stop_words", "n_latin_words", 2, None),
    Rule("stutter", "n_adjacent", "n_words", None, 20),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 40),
    Rule("repeated_words", "n_repeat_words", "n_words", None, MAX_REPEAT_PERCENT),
    Rule("words_per_line", "n_words", "n_lines", 100, None),
)


def base_sql() -> str:
    return f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def verdict_sql(rules=RULES) -> str:
    return " AND ".join(f"({r.sql()})" for r in rules)


def _removed(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeat_words(ws: Column, n: Column) -> Column:
    """Words that lie in a window of eight words found at two or more places of the text."""
    h = F.transform(ws, lambda w: F.xxhash64(w))

    def doubled(a: Column, k: int) -> Column:
        return F.zip_with(a, F.slice(a, k + 1, n), lambda x, y: F.xxhash64(x, y))

    def covered(h8: Column) -> Column:
        at = F.array_sort(F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when(x.h == y.h, F.array(x.i, y.i)).otherwise(F.array().cast("array<int>")))
            return F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda a: a.isNotNull()))))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc.n + WINDOW - F.greatest(F.lit(0), acc.end - p)).alias("n"))
        return F.aggregate(let(at, marked), zero, step, lambda acc: acc.n)

    def found(h1: Column) -> Column:
        h8 = let(doubled(h1, 1), lambda h2: let(doubled(h2, 2), lambda h4: F.slice(doubled(h4, 4), 1, n - WINDOW + 1)))
        return let(h8, lambda a: F.when(F.size(F.array_distinct(a)) < F.size(a), covered(a)).otherwise(F.lit(0).cast("long")))

    return F.when(n > WINDOW, let(h, found)).otherwise(F.lit(0).cast("long"))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaim", "n_capitals", "n_stop_words", "n_latin_words", "n_adjacent", "n_lines")


def with_quality(docs: DataFrame, text: str = "text", out: str = "__quality", rules=RULES) -> DataFrame:
    """``docs`` with a struct column ``out`` of all metrics, base_failed and kept."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def metrics(x: Column) -> Column:
        ws, ls, n = x.words, x.lines, F.size(x.words)
        pairs = F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(1))), F.slice(ws, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b)
        values = {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": _removed(t, SYMBOLS),
            "n_exclaim": _removed(t, "!"),
            "n_capitals": _removed(t, CAPITALS),
            "n_stop_words": F.size(F.filter(F.split(F.lower(t), "[\\x20\\x09-\\x0D.,;:!?]+"), lambda w: w.isin(*STOP_WORDS))).cast("long"),
            "n_latin_words": F.when(t.rlike(OTHER_SCRIPT), F.size(F.filter(ws, lambda w: ~w.rlike(OTHER_SCRIPT)))).otherwise(n).cast("long"),
            "n_adjacent": F.when(n > 1, F.size(F.filter(pairs, lambda same: same))).otherwise(0).cast("long"),
            "n_lines": F.size(ls).cast("long"),
            "n_dup_lines": (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"),
            "n_repeat_words": repeat_words(ws, n),
        }
        return F.struct(*[values[k].alias(k) for k in METRICS])

    def judged(m: Column) -> Column:
        failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
        kept = ~failed
        for r in rules:
            kept = kept & r.on(m)
        return F.struct(*[m.getField(k).alias(k) for k in METRICS], failed.alias("base_failed"), kept.alias("kept"))

    # each step is bound once: a filter on the verdict would otherwise compute words and metrics again wherever they are named
    return docs.withColumn(out, let(let(F.struct(words(t).alias("words"), lines.alias("lines")), metrics), judged))


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, then the further metrics."""
    q = with_quality(docs.select("doc_id", "text"), rules=rules)
    first = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return q.select("doc_id", *[f"__quality.{c}" for c in [*first, "n_exclaim", "n_capitals", "n_stop_words", "n_latin_words", "n_adjacent", "n_lines"]])


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return with_quality(docs, rules=rules).filter("__quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])


def metrics_sql(table: str = "documents") -> str:
    """DuckDB SQL for with_quality's metrics and verdicts over a table or subquery."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    capitals = f"[{CAPITALS}]"
    return f"""
    WITH q_t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {table}),
    q_w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
              list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM q_t),
    q_g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM q_w WHERE len(ws) > 8)),
    q_d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM q_g) WHERE n > 1),
    q_r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM q_d) GROUP BY rid),
    q_m AS (SELECT q_w.rid, doc_id, len(ws)::BIGINT AS n_words,
              length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
              (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
              (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim,
              (length(t) - length(regexp_replace(t, '{capitals}', '', 'g')))::BIGINT AS n_capitals,
              len(list_filter(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D.,;:!?]+'), lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
              len(list_filter(ws, lambda x: NOT regexp_matches(x, '{OTHER_SCRIPT}')))::BIGINT AS n_latin_words,
              len(list_filter(list_transform(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]), lambda x: x))::BIGINT AS n_adjacent,
              len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
              coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
            FROM q_w LEFT JOIN q_r USING (rid)),
    q_v AS (SELECT *, ({base_sql()}) AS base_failed, (NOT ({base_sql()}) AND {verdict_sql()}) AS kept FROM q_m)"""


def oracle() -> str:
    return metrics_sql() + """
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_exclaim, n_capitals, n_stop_words, n_latin_words, n_adjacent, n_lines FROM q_v"""
