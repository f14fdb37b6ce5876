"""Operator 8: document fingerprints of closed syncmers, on built-in expressions only.

A text is a sequence of tokens (pieces of at most 16 characters of its words). A run of K tokens is a closed syncmer if the
least hash among its inner runs of S tokens stands at its first or last place; that depends on the run alone, so equal
passages choose equal anchors wherever they stand. The fingerprint is all syncmers of the text in order of place, each as a
hash of 32 bits and its distance from the one before (in tokens; at most K - S, so one digit), in hex; it grows with the text.
Likeness of two fingerprints is the containment of their links: a link is two successive anchors and the tokens between their
places, so that two texts share it only if both anchors match at one offset; those that both have count over those of the one
that has fewer, distinct ones each. If one text has a single anchor, thus no link, anchors are compared instead.

The edited text takes its end from the next document by descending id; rows with equal ids, or none, are ordered by a hash of
their text. By bounds from a sample of these keys (at most MAX_RANGES; ids may be spread anyhow, and many rows may lack one)
documents are dealt to ranges; within a range a window gives the next one, and each range gets a copy of the first row of the
range below as its last row. One shuffle of the texts, into partitions of about PART_CHARS; no global sort, no task with more
than a few ranges. Only rows equal in id and text can't be dealt to different ranges.

Defined results: null text and text without words = text without tokens, whose fingerprint is empty; likeness of two empty
ones is 1, of an empty and another 0; a text without a syncmer (fewer than K tokens, or K by chance) has one hash, of all its
tokens, at place 0; any 64-bit id will do, a null id comes after all others; a single document is its own next; a very long
text takes memory in proportion to its tokens, in one task; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import let

K = 4
S = 2
PER_RANGE = 512
MAX_RANGES = 1 << 14
SAMPLED = 16  # keys of the sample a range
PART_CHARS = 32 << 20


def syncmers(text: Column) -> Column:
    """The closed syncmers of a text, all of them in order of place: structs of hash and place."""
    tokens = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,16}"), F.lit(0))
    shifted = lambda a, k, n: F.slice(a, k + 1, n)

    def anchor(x: Column, i: Column) -> Column:
        return F.struct(x.bitwiseAND(0xFFFFFFFF).alias("hash"), i.alias("place"))

    def whole(h: Column) -> Column:
        return F.array(anchor(F.xxhash64(h), F.lit(0)))

    def chosen(h: Column) -> Column:
        n = F.size(h)
        runs = F.greatest(n - K + 1, F.lit(0))

        def over(g: Column) -> Column:  # g: hashes of inner runs of S = 2 tokens; a run of K = 4 has the three g[i] .. g[i + 2]
            edge = F.zip_with(F.slice(g, 1, runs), shifted(g, K - S, runs), lambda a, b: F.struct(F.least(a, b).alias("least"), F.xxhash64(a, b).alias("whole")))
            closed = F.zip_with(edge, shifted(g, 1, runs), lambda e, inner: F.when(e.least <= inner, e.whole))
            some = F.filter(F.transform(closed, anchor), lambda x: x.hash.isNotNull())
            return let(some, lambda found: F.when(F.size(found) > 0, found).otherwise(whole(h)))

        pairs = F.zip_with(F.slice(h, 1, n - 1), shifted(h, 1, n), lambda a, b: F.xxhash64(a, b))
        return F.when(n >= K, let(pairs, over)).when(n > 0, whole(h)).otherwise(F.array().cast("array<struct<hash:bigint,place:int>>"))

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), chosen)


def links(a: Column) -> Column:
    """Distinct hashes of successive anchors with the distance of their places."""
    n = F.size(a)
    return F.array_distinct(F.zip_with(F.slice(a, 1, F.greatest(n - 1, F.lit(0))), F.slice(a, 2, n), lambda x, y: F.xxhash64(x.hash, y.hash, y.place - x.place)))


def likeness(a: Column, b: Column) -> Column:
    def of_sets(pair: Column) -> Column:
        return F.size(F.array_intersect(pair.a, pair.b)) / F.least(F.size(pair.a), F.size(pair.b))

    def matched(pair: Column) -> Column:
        fewer = F.least(F.size(pair.a), F.size(pair.b))
        sets = lambda f: let(F.struct(f(pair.a).alias("a"), f(pair.b).alias("b")), of_sets)
        both_empty = (F.size(pair.a) == 0) & (F.size(pair.b) == 0)
        return F.when(both_empty, 1.0).when(fewer == 0, 0.0).when(fewer == 1, sets(lambda x: F.array_distinct(x.hash))).otherwise(sets(links))

    return let(F.struct(a.alias("a"), b.alias("b")), matched)


def digest(anchors: Column) -> Column:
    def part(x: Column, before: Column) -> Column:
        return F.concat(F.hex(x.place - F.coalesce(before.place, F.lit(0))), F.lpad(F.hex(x.hash), 8, "0"))

    shifted = F.concat(F.array(F.lit(None).cast("struct<hash:bigint,place:int>")), anchors)
    return F.array_join(F.zip_with(anchors, F.slice(shifted, 1, F.size(anchors)), part), "")


def _key(no_id: Column, doc_id: Column, h: Column) -> Column:
    return F.struct(no_id.alias("n"), doc_id.alias("i"), h.alias("h"))


def range_bounds(keys: DataFrame) -> tuple[list, int, int]:
    """Sorted bounds (no_id, id, hash) that cut the keys (key, n_chars) into ranges, the number of rows and of characters."""
    n, chars = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_chars"), F.lit(0))).first()
    ranges = min(MAX_RANGES, n // PER_RANGE)
    if ranges < 2:
        return [], n, chars
    # rows are drawn by a hash of their key: about SAMPLED a range, a bound on what is collected
    drawn = F.pmod(F.xxhash64("key.i", "key.h", F.lit(17)), F.lit(1 << 30)) < max(1, min(1 << 30, (ranges * SAMPLED << 30) // n))
    sample = sorted((r.n, r.i, r.h) for r in keys.filter(drawn).select("key.*").distinct().limit(4 * SAMPLED * MAX_RANGES).collect())
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else [], n, chars


def range_of(key: Column, bounds: list) -> Column:
    """How many bounds are at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    listed = F.from_json(F.lit(json.dumps([{"n": b[0], "i": b[1], "h": b[2]} for b in bounds])), "array<struct<n:boolean,i:bigint,h:bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def search(k: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, width: F.when((at + width <= len(bounds)) & (F.get(listed, at + width - 1) <= k), at + width).otherwise(at))

    return let(key, search)


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """Rows of docs (doc_id, text) and, in each range, a last row copied from the range below (``__copy``); and the window."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    # ascending: null ids, which come last, are the least; the negated hash makes equal ids go by ascending hash when the order is descending
    df = df.withColumn("__key", _key(F.col("doc_id").isNotNull(), F.coalesce("doc_id", F.lit(0)), F.bitwise_not("__h"))).drop("__h")
    bounds, n, chars = range_bounds(df.select(F.col("__key").alias("key"), F.length("text").alias("n_chars")))
    df = df.withColumn("__range", range_of(F.col("__key"), bounds)).withColumn("__copy", F.lit(False))
    ranges = df.groupBy("__range").agg(F.max("__key").alias("__top"))  # at most MAX_RANGES rows, whatever the input
    order = Window.orderBy(F.col("__range").desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = ranges.select("__top", F.col("__range").alias("__of"), F.coalesce(F.lag("__range").over(order), F.min("__range").over(whole)).alias("__to"))
    firsts = df.join(F.broadcast(at), (F.col("__range") == F.col("__of")) & (F.col("__key") == F.col("__top")))
    copies = firsts.groupBy("__to").agg(F.first("doc_id").alias("doc_id"), F.min("text").alias("text"), F.first("__key").alias("__key"))
    copies = copies.select("doc_id", "text", "__key", F.col("__to").alias("__range"), F.lit(True).alias("__copy"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 16, chars // PART_CHARS + 1))
    both = df.select("doc_id", "text", "__key", "__range", "__copy").unionByName(copies).repartition(parts, "__range")
    return both, Window.partitionBy("__range").orderBy("__copy", F.col("__key").desc(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    df, by = with_next(docs.select(F.col("doc_id").cast("long"), "text"))
    # anchors are made behind the exchange, which so carries texts alone
    df = df.withColumn("n_chars", F.length("text").cast("long")).withColumn("__after", F.lead("text").over(by)).filter(~F.col("__copy"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("__after"), F.lit(1), cut))
    df = df.select("doc_id", "n_chars", syncmers(F.col("text")).alias("__own"), syncmers(F.col("__after")).alias("__next"), edited.alias("__edited"))
    df = df.withColumn("__new", syncmers(F.col("__edited")))
    return df.select(
        "doc_id", "n_chars", F.sha2("__edited", 256).alias("edited_sha256"), digest(F.col("__own")).alias("fingerprint"), digest(F.col("__new")).alias("edited_fingerprint"),
        F.round(likeness(F.col("__own"), F.col("__new")), 6).alias("near_edited"), F.round(likeness(F.col("__own"), F.col("__next")), 6).alias("near_next"),
    )
