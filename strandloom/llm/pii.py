"""Operator 5: personal data by candidate gradient boosting, on built-in expressions only.

Generators of high recall propose spans that may overlap. The four base kinds (email, ip, card, phone) are fixed by format
and always stay. Further candidates (secrets, national phone numbers, identity numbers, account numbers, card numbers in longer
runs of digits, named passwords, version 6 addresses) are judged by boosted depth-two trees over format and context features; a threshold for each kind, calibrated on a held-back half of the
training cases, selects the redactions; where two of these overlap, the higher score wins, and none may overlap a base span.

The trees are trained on the driver from ``CASES`` generated texts (a fixed number; nothing is read from the corpus), whose
features come from the same expressions, and compiled to one CASE expression. Nothing runs in Python on executors.
One pass, no shuffle. Every pattern is possessive or guarded so that long runs of one character class take linear time, and
places come from running sums in blocks, so that time is linear in the number of matches too (but for candidates that overlap
each other, which are compared with one another).

Defined results: null text = empty text = no spans; offsets are code points, end exclusive; ties in start go by kind in the
order of KINDS; repeated rows are treated each; empty tables give no rows; further columns of the input never clash; a very
long text takes memory in proportion to its length and matches, in one task.
"""

from __future__ import annotations

import random
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import let

KINDS = ("email", "ip", "card", "phone", "secret", "national_phone", "identity_number", "account_number", "card_number", "password", "ip_v6")
CASES = 2400
BLOCK = 64
CONTEXT = 24
ROUNDS = 30
RATE = 0.4
PRECISION = 0.98

_RUN = "A-Za-z0-9._%+-"
_KEY = "A-Za-z0-9+/_=-"
_CARD = r"[0-9]{4}(?:[\x20-]?[0-9]{4}){3}"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Proposals of one pattern do not overlap; those of different ones may.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_RUN}]))[{_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": rf"(?:\G|(?<![{_KEY}]))[{_KEY}]{{20,}}+",
    "national_phone": r"(?<![0-9+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "identity_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account_number": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "card_number": (rf"(?<![0-9]){_CARD}(?![\x20-]?[0-9])", rf"(?<![0-9])(?<![0-9][\x20-]){_CARD}(?![0-9])"),
    "password": r"(?<=(?i:password|passwd|passphrase|passcode|pwd)[\x20\"']{0,2}[=:][\x20\"']{0,2})[^\s\"',;]{6,64}+",
    "ip_v6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![0-9A-Za-z:.])",
}
#: A cheap necessary condition of each kind.
GATES = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
    "secret": lambda t: t.rlike(rf"[{_KEY}]{{20}}"),
    "national_phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
    "identity_number": lambda t: t.rlike(r"-[0-9]{2}-[0-9]{4}"),
    "account_number": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11}|\x20[A-Z0-9]{4}\x20[A-Z0-9]{4})"),
    "card_number": lambda t: t.rlike(_CARD),
    "password": lambda t: t.rlike(r"(?i)pass|pwd"),
    "ip_v6": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f:]*:[0-9A-Fa-f]"),
}
#: start, end: code points; at, to: bytes; before: the end of what stands between the last match and this one, and of that match
SPAN = "array<struct<start:int,end:int,kind:int,at:int,to:int,body:string,before:string>>"
FEATURES = ("kind", "length", "digits", "capitals", "smalls", "marks", "distinct", "quoted", "assigned", "named_key", "named_number", "luhn")


def running(values: Column, merge, zero: Column) -> Column:
    """For every value the merge (associative) of all before it, in blocks: time is linear but for a 1 / BLOCK share per block."""
    n = F.size(values)

    def of_blocks(blocks: Column) -> Column:
        def of_wholes(wholes: Column) -> Column:
            def block(b: Column, k: Column) -> Column:
                return let(F.aggregate(F.slice(wholes, 1, k), zero, merge), lambda start: F.transform(b, lambda _, i: F.aggregate(F.slice(b, 1, i), start, merge)))

            return F.flatten(F.transform(blocks, block))

        return let(F.transform(blocks, lambda b: F.aggregate(b, zero, merge)), of_wholes)

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return F.when(n > 0, let(cut(values), of_blocks)).otherwise(F.slice(values, 1, 0))


def matches(text: Column, kinds: tuple = KINDS) -> Column:
    """All matches of the kinds' patterns, of each pattern leftmost and not overlapping, as SPAN.

    A pattern cuts the text into gaps and matches, the last gap included, so that the pieces of each pattern whose gate is open
    add up to the whole text; running sums over the pieces of all patterns together, modulo the text's length, are the places.
    """
    def pieces(kind: str, pattern: str) -> Column:
        piece = lambda p, m: F.struct(p.alias("gap"), m.alias("m"), F.lit(KINDS.index(kind)).alias("kind"))
        found = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), piece)
        return F.when(GATES[kind](text), found).otherwise(F.array().cast("array<struct<gap:string,m:string,kind:int>>"))

    def sums(items: Column, size) -> Column:
        width = F.transform(items, lambda x: (size(x.gap) + F.coalesce(size(x.m), F.lit(0))).cast("long"))
        return let(width, lambda v: running(v, lambda a, b: a + b, F.lit(0).cast("long")))

    def placed(p: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = (F.get(p.chars, i) % p.n_chars + F.length(x.gap)).cast("int")
            at = (F.get(p.bytes, i) % p.n_bytes + F.octet_length(x.gap)).cast("int")
            before = F.right(F.concat(F.coalesce(F.get(p["items"], i - 1).m, F.lit("")), x.gap), F.lit(CONTEXT))
            ends = (start + F.length(x.m)).cast("int"), (at + F.octet_length(x.m)).cast("int")
            return F.struct(start.alias("start"), ends[0].alias("end"), x.kind.alias("kind"), at.alias("at"), ends[1].alias("to"), x.m.alias("body"), before.alias("before"))

        return F.filter(F.transform(p["items"], lambda x, i: F.when(x.m.isNotNull(), span(x, i))), lambda s: s.isNotNull())

    def over(items: Column) -> Column:
        sizes = F.length(text).cast("long").alias("n_chars"), F.octet_length(text).cast("long").alias("n_bytes")
        return let(F.struct(items.alias("items"), sums(items, F.length).alias("chars"), sums(items, F.octet_length).alias("bytes"), *sizes), placed)

    patterns = [(k, p) for k in kinds for p in (PATTERNS[k] if isinstance(PATTERNS[k], tuple) else (PATTERNS[k],))]
    return let(F.concat(*[pieces(k, p) for k, p in patterns]), lambda items: F.when(F.size(items) > 0, over(items)).otherwise(F.array().cast(SPAN)))


def luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    value = F.transform(F.filter(each, lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(value, F.lit(0), lambda a, v: (a + v - F.when(v > 9, 9).otherwise(0)).cast("int")) % 10 == 0


def _valid(kind: str, s: Column) -> Column:
    digits = F.regexp_replace(s.body, "[^0-9]", "")
    n = F.length(digits)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    if kind == "ip":
        return F.forall(F.split(s.body, r"\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda v: F.when(F.length(v) <= 3, v.cast("int") <= 255).otherwise(F.lit(False))))
    return F.lit(True)


def base_spans(found: Column) -> Column:
    """Of all matches the spans of the four base kinds."""
    def good(s: Column) -> Column:
        valid = F.lit(False)
        for k, kind in enumerate(KINDS[:4]):
            valid = F.when(s.kind == k, _valid(kind, s)).otherwise(valid)
        return valid

    return F.filter(found, good)


def candidates(found: Column) -> Column:
    """Of all matches what the further generators propose, with features: array of (start, end, kind, at, to, features)."""
    proposed = F.filter(found, lambda s: s.kind >= 4)

    def count(body: Column, chars: str) -> Column:
        return F.length(F.regexp_replace(body, f"[^{chars}]", ""))

    def features(s: Column) -> Column:
        n = F.length(s.body)
        context = F.lower(s.before)
        values = {
            "kind": s.kind, "length": n, "digits": 100 * count(s.body, "0-9") / n, "capitals": 100 * count(s.body, "A-Z") / n, "smalls": 100 * count(s.body, "a-z") / n,
            "marks": 100 * count(s.body, "+/_=-") / n, "distinct": F.size(F.array_distinct(F.split(s.body, ""))), "quoted": context.rlike("[\"']$").cast("int"),
            "assigned": context.rlike("[=:][\\x20\"']*$").cast("int"), "named_key": context.rlike("token|key|secret|passw|auth|bearer|credential").cast("int"),
            "named_number": context.rlike("tel|phone|call|fax|mobil|ssn|social|iban|account|konto|compte|cuenta").cast("int"),
            "luhn": F.when(s.kind == KINDS.index("card_number"), luhn(F.regexp_replace(s.body, "[^0-9]", "")).cast("int")).otherwise(0),
        }
        return F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"), s["at"].alias("at"), s["to"].alias("to"), *[values[f].cast("double").alias(f"f_{f}") for f in FEATURES])

    return F.transform(proposed, features)


# --- training --------------------------------------------------------------------------------------------------------


def cases(n: int = CASES, seed: int = 5) -> list[tuple[str, int]]:
    """Generated training texts, each with one candidate at least, and whether it is personal or secret."""
    r = random.Random(seed)
    word = lambda k=None: "".join(r.choice("abcdefghilmnoprstuvwäé") for _ in range(k or r.randint(2, 9)))
    some = lambda chars, a, b: "".join(r.choice(chars) for _ in range(r.randint(a, b)))
    digits, hexes, mixed = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = lambda: r.choice([some(hexes, 24, 64), some(hexes.upper(), 24, 64), some(mixed, 24, 48), some(mixed + "+/_-", 24, 64), some(mixed[:26] + digits, 20, 40)])
    number = lambda: f"{some(digits, 3, 3)}{r.choice('-. ')}{some(digits, 3, 3)}{r.choice('-. ')}{some(digits, 4, 4)}"
    grouped = lambda d, by: by.join(d[i : i + 4] for i in range(0, len(d), 4))
    group = lambda: format(r.randint(1, 65535), "x")

    def card(valid: bool) -> str:
        d = some(digits, 15, 15)
        total = sum(x - 9 if x > 9 else x for x in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(d))))
        last = -total % 10
        return grouped(d + str(last if valid else (last + r.randint(1, 9)) % 10), r.choice([" ", "-", ""]))

    aside = lambda: r.choice([some(digits, 2, 3), some(digits, 5, 6)])  # noqa: E731  four digits would make a second candidate

    def in_run(valid: bool) -> str:
        return r.choice([lambda: f"{aside()} {card(valid)}", lambda: f"{card(valid)} {aside()}", lambda: f"{aside()}-{card(valid)}"])()

    named = lambda: f"{r.choice(['password', 'Password', 'passwd', 'pwd', 'passphrase'])}{r.choice([' = ', '=', ': ', ':'])}{r.choice(['', chr(34)])}"
    good = [
        lambda: in_run(True),
        lambda: in_run(True),
        lambda: named() + some(mixed, 5, 10) + some(digits, 1, 4) + r.choice(["", "!", "#", "$x"]),
        lambda: named() + word(r.randint(4, 8)) + some(digits, 1, 3) + r.choice(["", word(4), "!"]),
        lambda: ":".join(group() for _ in range(8)),
        lambda: ":".join(group() for _ in range(r.randint(1, 4))) + "::" + ":".join(group() for _ in range(r.randint(1, 3))),
        lambda: f"{r.choice(['IBAN', 'account', 'Konto', word()])} {some('DEFRSBIT', 2, 2)}{some(digits, 2, 2)} {grouped(some(digits, 12, 22), ' ')}",
        lambda: f'{r.choice(["token", "api_key", "secret", "password", "auth key"])} {r.choice(["=", ":", "= ", ": "])} "{key()}"',
        lambda: f'{r.choice(["TOKEN=", "key=", "Bearer ", "secret: "])}{key()}',
        lambda: f'{word()} "{some(hexes, 32, 64)}"',
        lambda: f"{r.choice(['tel', 'phone', 'call', 'fax', 'mobile'])} {number()}",
        lambda: f"({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}",
        lambda: f"{r.choice(['SSN', 'social security', word()])} {some(digits, 3, 3)}-{some(digits, 2, 2)}-{some(digits, 4, 4)}",
        lambda: f"{r.choice(['IBAN', 'account', 'Konto', word()])} {some('DEFRSBIT', 2, 2)}{some(digits, 14, 24)}",
    ]
    bad = [
        lambda: in_run(False), lambda: in_run(False), lambda: named() + word(r.randint(6, 11)), lambda: named() + r.choice(["required", "optional", "<none>", "********", "[hidden]", "string"]),
        lambda: f"{some('abcdef', 1, 4)}::{some('abcdef', 1, 4)}", lambda: f"{some('ABCDEF', 2, 4)}::{some('abcdef', 2, 4)}", lambda: f"{some('ABCDEFGH', 2, 2)}{some(digits, 2, 2)} {grouped(some('ABCDEFGHIJKLMNOP', 8, 20), ' ')}",
        lambda: some("abcdefghilmnoprstuvw", 20, 45), lambda: some("ABCDEFGHILMNOPRSTUVW", 20, 45), lambda: "-".join(word() for _ in range(6)) + "-abcdefghij", lambda: "_" * r.randint(20, 60), lambda: "=" * r.randint(20, 60),
        lambda: "-" * r.randint(20, 60), lambda: "/".join(some("abcdefghilm", 3, 9) for _ in range(6)) + "/usr/share", lambda: some(digits, 20, 40), lambda: f"{some('ABCDEFGH', 2, 2)}{some(digits, 2, 2)}{some('ABCDEFGHIJKLMNOP', 14, 20)}",
        lambda: f"part {some('0', 3, 3)} {some('01', 3, 3)} {some('0', 4, 4)}", lambda: "Key" + some("abcdefghilmnoprstuvw", 20, 30), lambda: "https://" + "/".join(some("abcdefghilm", 3, 9) for _ in range(5)) + "/page=index",
    ]
    return [(f"{word()} {word()} {r.choice(good)()} {word()}", 1) if i % 2 else (f"{word()} {word()} {r.choice(bad)()} {word()}", 0) for i in range(n)]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple]:
    """Boosted depth-two trees for the logistic loss: (feature, cut, left, right), where a side is (feature, cut, low, high)."""
    score, trees = np.zeros(len(y)), []
    cuts = [np.unique(np.round(np.quantile(x[:, f], np.linspace(0.02, 0.98, 16)), 3)) for f in range(x.shape[1])]

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        found = (-1.0, 0, 0.0)
        for f in range(x.shape[1]):
            for c in cuts[f]:
                low = x[rows, f] <= c
                gain = sum(g[rows][m].sum() ** 2 / (h[rows][m].sum() + 1) for m in (low, ~low))
                found = max(found, (gain, f, float(c)))
        return found[1:]

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, c = best(np.arange(len(y)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, f] <= c), np.flatnonzero(x[:, f] > c)):
            if not len(rows):
                sides.append((0, 0.0, 0.0, 0.0))
                continue
            f2, c2 = best(rows, g, h)
            leaf = []
            for m in (x[rows, f2] <= c2, x[rows, f2] > c2):
                v = rate * g[rows][m].sum() / (h[rows][m].sum() + 1)
                score[rows[m]] += v
                leaf.append(round(float(v), 6))
            sides.append((f2, c2, *leaf))
        trees.append((f, c, *sides))
    return trees


def predict(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for f, c, left, right in trees:
        l, r = (np.where(x[:, s[0]] <= s[1], s[2], s[3]) for s in (left, right))
        out += np.where(x[:, f] <= c, l, r)
    return out


def thresholds(score: np.ndarray, y: np.ndarray, kind: np.ndarray, precision: float = PRECISION) -> dict[int, float]:
    """For each kind the lowest score from which the held-back cases have the wanted precision."""
    out = {}
    for k in range(4, len(KINDS)):
        s, t = score[kind == k], y[kind == k]
        fit_for = [c for c in np.unique(s) if t[s >= c].mean() >= precision]
        out[k] = float(min(fit_for)) - 1e-6 if fit_for else 1e9
    return out


_trained: dict[int, tuple] = {}


def trained(spark: SparkSession, n: int = CASES) -> tuple[list[tuple], dict[int, float]]:
    """Trees and thresholds; the features of the generated cases come from the expressions that also see the corpus."""
    if n not in _trained:
        all_cases = cases(n)
        rows = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(c for c, _ in all_cases)), "\n")).alias("i", "t")).select("i", F.explode(candidates(matches(F.col("t"), KINDS[4:]))).alias("c")).select("i", *[f"c.f_{f}" for f in FEATURES])
        got = sorted(map(tuple, rows.collect()))
        x, at = np.array([g[1:] for g in got]), np.array([g[0] for g in got])
        y, held = np.array([all_cases[i][1] for i in at]), (at // 2) % 2 == 1
        trees = fit(x[~held], y[~held])
        _trained[n] = trees, thresholds(predict(trees, x[held]), y[held], x[held][:, 0].astype(int))
    return _trained[n]


def _score(c: Column, trees: list[tuple]) -> Column:
    feature = lambda f: c.getField(f"f_{FEATURES[f]}")
    side = lambda s: F.when(feature(s[0]) <= s[1], F.lit(s[2])).otherwise(F.lit(s[3]))
    total = F.lit(0.0)
    for f, cut, left, right in trees:
        total = total + F.when(feature(f) <= cut, side(left)).otherwise(side(right))
    return total


def _meets(a: Column, b: Column) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def clear_of(spans: Column, base: Column) -> Column:
    """The spans that meet none of ``base``: of the base spans that start before a span's end, none ends after its start."""
    event = lambda key, kind, end, span: F.struct(key.alias("key"), F.lit(kind).alias("kind"), end.alias("end"), span.alias("span"))
    asked = F.transform(spans, lambda s: event(s.end, 0, F.lit(0), s))
    none = F.get(spans, F.lit(-1))

    def over(events: Column) -> Column:
        reach = let(F.transform(events, lambda e: e.end), lambda ends: running(ends, lambda a, b: F.greatest(a, b), F.lit(0)))
        return F.filter(F.zip_with(events, reach, lambda e, r: F.when((e.kind == 0) & (r <= e.span.start), e.span)), lambda s: s.isNotNull())

    events = F.array_sort(F.concat(asked, F.transform(base, lambda b: event(b.start, 1, b.end, none))))
    return F.when(F.size(base) == 0, spans).otherwise(let(events, over))


def accepted(spans: Column) -> Column:
    """Of spans with a margin those that meet no accepted one, by descending margin, then start and kind. Most meet none at all."""
    def over(by_start: Column) -> Column:
        def alone(s: Column, i: Column, reach: Column) -> Column:
            return (F.get(reach, i) <= s.start) & F.coalesce(F.get(by_start, i + 1).start >= s.end, F.lit(True))

        marked = lambda reach: F.transform(by_start, lambda s, i: F.struct(s.alias("s"), alone(s, i, reach).alias("alone")))
        return let(let(F.transform(by_start, lambda s: s.end), lambda ends: running(ends, lambda a, b: F.greatest(a, b), F.lit(0))), marked)

    def chosen(marked: Column) -> Column:
        rest = F.transform(F.filter(marked, lambda m: ~m.alone), lambda m: m.s)
        by_rank = F.array_sort(F.transform(rest, lambda c: F.struct((-c.margin).alias("rank"), c.start.alias("start"), c.kind.alias("kind"), c.alias("span"))))
        add = lambda acc, c: F.when(F.exists(acc, lambda b: _meets(b, c.span)), acc).otherwise(F.concat(acc, F.array(c.span)))
        return F.concat(F.transform(F.filter(marked, lambda m: m.alone), lambda m: m.s), F.aggregate(by_rank, F.filter(rest, lambda c: F.lit(False)), add))

    return let(let(F.array_sort(spans), over), chosen)


def with_spans(docs: DataFrame, text: str = "text", out: str = "__pii") -> DataFrame:
    """``docs`` with struct ``out``: base and spans, arrays of (start, end, kind) in order of start, then kind."""
    trees, limits = trained(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    bare = lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "at", "to")])

    def over(c: Column) -> Column:
        cut = F.lit(1e9)
        for k, v in limits.items():
            cut = F.when(c.kind == k, F.lit(v)).otherwise(cut)
        return cut

    df = docs.withColumn("__found", matches(t)).withColumn("__base", F.array_sort(F.transform(base_spans(F.col("__found")), bare)))
    scored = F.transform(candidates(F.col("__found")), lambda c: F.struct(*[c[x].alias(x) for x in ("start", "kind", "end", "at", "to")], (_score(c, trees) - over(c)).alias("margin")))
    df = df.withColumn("__scored", F.filter(scored, lambda c: c.margin >= 0))
    df = df.withColumn("__free", clear_of(F.col("__scored"), F.col("__base")))
    best = accepted(F.col("__free"))
    df = df.withColumn(out, F.struct(F.col("__base").alias("base"), F.array_sort(F.concat("__base", F.transform(best, bare))).alias("spans")))
    return df.drop("__found", "__base", "__scored", "__free")


def _is_kind(k: int, s: Column) -> Column:
    return s.kind == k


def _digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s.kind + 1), F.lit(":"), s.start, F.lit(":"), s.end)), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256 and all spans."""
    df = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("__pii.base", partial(_is_kind, k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return df.select("doc_id", *counts, F.sha2(_digest(F.col("__pii.base")), 256).alias("base_sha256"), _digest(F.col("__pii.spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with each span, or union of overlapping spans, replaced by [KIND] of the first; columns as they came."""
    df = with_spans(docs, text)
    t = F.col(f"`{text}`")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    def replaced(raw: Column, spans: Column, done: Column) -> Column:
        """``done``: for each span the byte up to which the spans before it reach."""
        part = lambda a, b: F.substring(raw, a + 1, b - a).cast("string")
        piece = lambda s, i: F.when(s["at"] >= F.get(done, i), F.concat(part(F.get(done, i), s["at"]), F.element_at(names, s.kind + 1))).otherwise("")
        end = F.array_max(F.transform(spans, lambda s: s["to"]))
        return F.concat(F.array_join(F.transform(spans, piece), ""), part(end, F.octet_length(raw)))

    spans = F.col("__pii.spans")
    reach = let(F.transform(spans, lambda s: s["to"]), lambda ends: running(ends, lambda a, b: F.greatest(a, b), F.lit(0)))
    clean = let(F.struct(t.cast("binary").alias("raw"), reach.alias("done")), lambda x: replaced(x.raw, spans, x.done))
    clean = F.when(F.size("__pii.spans") > 0, clean).otherwise(t)
    return df.withColumn("__clean", clean).select(*[(F.col("__clean") if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
