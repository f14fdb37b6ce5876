"""Operator 9: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles, each a 64-bit hash. Two sets with Jaccard >= percent/100 share one of
their first n - ceil(percent * n / 100) + 1 elements in any common order; the order here puts frequent shingles last.
  1. Count shingles over all documents: sorted, delta-coded runs are exchanged and summed; the most frequent ones (at most
     ``FREQUENT`` of them, a bound on what is broadcast) come last in the order. The count only guides the order: links are
     the same whatever it says.
  2. Documents with equal sets (by a 128-bit hash) become one node, numbered without regard to ids; nodes with equal size and
     prefix become one group. A node's text is that of its least row, which is found by hashes of the row.
  3. Groups that share a prefix element, fit in size and whose positions leave enough overlap are candidates. Instead of all
     pairs of a list, first a document's nearest of few is verified: of its neighbours in lists, of each list's document
     with the earliest place, and of its neighbour among its group's members; connected components of these links follow. Then candidates are made only between members of different components of a
     list, those outside its largest component against all, so that a large group of near copies costs its size, not its square.
     A pair also has to pass a parity sketch: sets differ in at least as many elements as their SKETCH parity bits differ.
  4. Verified links of both rounds give the components; every link between different components has been verified. Only then
     do components get their names, the least ids.

Style: shingle sets and their intersection in Arrow batches (Python, numpy); all joins and counts are DataFrame operations.
The set is recomputed from the text where it is needed rather than stored. A document that many pairs hold (the earliest of a
large group) has its pairs dealt to several tasks, each of which gets its text. Long lists are streamed from a sorted shuffle.

Defined results: null text, empty text and text without words have an empty set, n_shingles 0 and are their own component;
repeated rows share a component, named by the least id; rows with one id and different texts are different documents, each in
its own text's component; rows without doc_id take part like others, and their component is null if none in it has an id;
a very long text takes memory in proportion to its words, in one task; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import small_batches, written
from strandloom.llm.components import components

WORDS = 5
PERCENT = 80
FREQUENT = 1 << 20
FREQUENT_FROM = 12
RUN = 1 << 20
BROADCAST_IDS = 500_000
SALTS = 16
CACHE = 200_000
SKETCH = 512
BITMAP = 1 << 28
#: Pairs of one node that one task verifies, about; a node with more is dealt to several tasks by its partners.
DEALT = 32
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_hash_of = _WordHash()


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text (A-Z lower-cased)."""
    ws = (text or "").encode().lower().split()  # bytes: ASCII case and white space only
    if not ws:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash_of.__getitem__, ws), np.uint64, len(ws))
    k = min(n, len(h))
    x = np.full(len(h) - k + 1, k if k < n else 0, np.uint64)
    for i in range(k):
        x = (x ^ h[i : len(h) - k + 1 + i]) * _A
        x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return np.unique(x)


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _batches(out: dict, schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out.values(), schema, strict=True)], schema=schema)


def shingle_counts(docs: DataFrame, n: int = WORDS, least: int = FREQUENT_FROM, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper 32 bits and number of documents of the most frequent shingles, sorted by the former, and a bitmap of those met twice.

    The bitmap is addressed by the upper bits of a hash and has at most BITMAP bits; sharing of bits only lets more through.
    """
    bits = int(np.clip(np.ceil(np.log2(4 * max(1, docs.rdd.getNumPartitions()))), 4, 18))
    room = int(np.clip(np.ceil(np.log2(512 * max(1, docs.count()))), 18, int(np.log2(BITMAP))))
    schema = pa.schema([("part", pa.int32()), ("run", pa.binary()), ("counts", pa.binary())])

    def runs(batches):
        held, size = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(k >> np.uint32(32 - bits), np.arange((1 << bits) + 1))
            out = {"part": [], "run": [], "counts": []}
            for p in range(1 << bits):
                if (a := at[p]) < (b := at[p + 1]):
                    out["part"].append(p)
                    out["run"].append(zlib.compress(np.diff(k[a:b], prepend=np.uint32(0)).astype("<u4").tobytes(), 1))
                    out["counts"].append(zlib.compress(c[a:b].astype("<u4").tobytes(), 1))
            return _batches(out, schema)

        for b in batches:
            for t in b.column(0).to_pylist():
                held.append((shingles(t, n) >> np.uint64(32)).astype(np.uint32))
                size += len(held[-1])
                if size >= RUN:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        ks = [np.cumsum(np.frombuffer(zlib.decompress(x), "<u4"), dtype=np.uint32) for x in table.column("run").to_pylist()]
        cs = [np.frombuffer(zlib.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
        k, at = np.unique(np.concatenate(ks), return_inverse=True)
        c = np.bincount(at, weights=np.concatenate(cs)).astype(np.int64)
        keep, twice = c >= least, np.zeros(1 << max(room - bits, 3), bool)
        twice[((k[c > 1] >> np.uint32(32 - room)) & np.uint32((1 << (room - bits)) - 1)).astype(np.int64)] = True
        part = table.column("part")[0].as_py()
        rows = int(keep.sum())
        return pa.table({"k": pa.array([*k[keep].tolist(), part], pa.int64()), "c": pa.array([*c[keep].tolist(), 0], pa.int64()), "seen": pa.array([None] * rows + [np.packbits(twice).tobytes()], pa.binary())})

    counted = written(docs.select("text").mapInArrow(runs, "part int, run binary, counts binary").groupBy("part").applyInArrow(merge, "k long, c long, seen binary"), "counts")
    top = counted.filter("seen is null").select("k", "c").orderBy(F.col("c").desc(), "k").limit(most).toArrow()
    k, c = top.column("k").to_numpy().astype(np.uint32), top.column("c").to_numpy()
    seen = np.zeros(1 << (room - 3), np.uint8)
    for r in counted.filter("seen is not null").select("k", "seen").toLocalIterator():
        seen[r.k << (room - bits - 3) :][: len(r.seen)] = np.frombuffer(r.seen, np.uint8)
    by = np.argsort(k)
    return k[by], c[by], seen


def identity():
    """Two hashes by which a row is found again: of its id and text, and of its text."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), F.hash("text").alias("check")


def small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def prefixes(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, check, size, key, gkey, prefix, parity) per document.

    ``row`` and ``check`` are hashes of the row's id and text; ``key`` identifies the set, ``gkey`` size and prefix together; ``prefix`` holds the prefix's elements that occur in
    another document, each with its place in the global order; ``parity`` is the sketch.
    """
    with small_batches(docs.sparkSession):
        known = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, n))

    def run(batches):
        k, c, seen = known.value
        shift = np.uint32(32 - int(np.log2(8 * len(seen))))
        place = pa.struct([("pos", pa.int32()), ("token", pa.int64())])
        schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("check", pa.int32()), ("size", pa.int32()), ("key", pa.binary()), ("gkey", pa.int64()), ("prefix", pa.list_(place)), ("parity", pa.list_(pa.int64()))])
        for b in batches:
            size, key, gkey, parity, at, pos, token = [], [], [], [], [0], [], []
            for t in b.column(3).to_pylist():
                s = shingles(t, n)
                m = len(s)
                size.append(m)
                key.append(xxhash.xxh3_128_digest(s.tobytes()) if m else b"")
                parity.append(np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).view(np.int64))
                if not m:
                    gkey.append(0)
                    at.append(at[-1])
                    continue
                top = (s >> np.uint64(32)).astype(np.uint32)
                if len(k):
                    i = np.minimum(np.searchsorted(k, top), len(k) - 1)
                    order = np.argsort(np.where(k[i] == top, c[i], 0), kind="stable")[: prefix_length(m, percent)]
                    s, top = s[order], top[order]
                else:
                    s, top = s[: prefix_length(m, percent)], top[: prefix_length(m, percent)]
                gkey.append(xxhash.xxh3_64_intdigest(s.tobytes(), m) - (1 << 63))
                bit = top >> shift
                keep = np.flatnonzero((seen[(bit >> np.uint32(3)).astype(np.int64)] >> (np.uint32(7) - (bit & np.uint32(7))).astype(np.uint8)) & 1)
                pos.append(keep.astype(np.int32))
                token.append(s[keep].view(np.int64))
                at.append(at[-1] + len(keep))
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(pos) if pos else [], pa.int32()), pa.array(np.concatenate(token) if token else [], pa.int64())], ["pos", "token"])
            cols = [*b.columns[:3], pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(gkey, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat), pa.array(parity, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), *identity(), "text").mapInArrow(run, "doc_id long, row long, check int, size int, key binary, gkey long, prefix array<struct<pos:int,token:bigint>>, parity array<long>")


def apart(px, py):
    """A lower bound of the elements in which two sets differ, from their parity sketches."""
    return sum((F.bit_count(px[i].bitwiseXOR(py[i])) for i in range(SKETCH // 64)), F.lit(0))


def may_link(nx, px, ny, py, percent: int):
    """Whether sets of sizes nx, ny and parity sketches px, py can have the wanted Jaccard."""
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * apart(px, py) <= (100 - percent) * (nx + ny))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a Jaccard of at least ``percent``/100; texts meet, as they pack better than sets."""
    pairs = written(pairs, "pairs")
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts"))
    ids = written(asked.join(nodes.select("node", "rep.row", "rep.check"), "node"), "ids")
    hot = small(written(ids.filter("parts > 1").select("node", "parts"), "hot"))
    ids = small(ids)

    def check(batches):
        held: dict[str, np.ndarray] = {}

        def shingles_of(t: str) -> np.ndarray:
            if t not in held:
                if len(held) >= 64:
                    held.clear()
                held[t] = shingles(t, n)
            return held[t]

        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = shingles_of(x), shingles_of(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    # equal rows have one text; they are combined before the exchange
    found = docs.select(*identity(), "text").join(ids, ["row", "check"]).groupBy("node", "parts").agg(F.first("text").alias("text"))
    side = lambda x: found.select(F.col("node").alias(x), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(f"part_{x}"), F.col("text").alias(f"t{x}"))
    for x, other in ("ab", "ba"):
        pairs = pairs.join(hot.withColumnRenamed("node", x), x, "left")
        pairs = pairs.withColumn(f"part_{x}", F.coalesce(F.pmod(F.xxhash64(other), "parts").cast("int"), F.lit(0))).drop("parts")
    joined = pairs.join(side("a"), ["a", "part_a"]).join(side("b"), ["b", "part_b"])
    with small_batches(docs.sparkSession):
        return written(joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long").distinct(), "links")


def labelled(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The prefixes of all rows; and per node of rows with equal sets: key, number of rows, least row, and that of its component if it is linked."""
    with small_batches(docs.sparkSession):
        rows = written(prefixes(docs, n, percent), "prefixes")
    full = rows.filter("size > 0")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "check")).alias("rep")
    nodes = full.groupBy("key").agg(least_row, F.count(F.lit(1)).alias("n_rows"), *[F.first(x).alias(x) for x in ("size", "gkey", "prefix", "parity")])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = nodes.groupBy("gkey", "size").agg(F.min("node").alias("gid"), F.first("prefix").alias("prefix"))

    by = Window.partitionBy("token").orderBy("size", "gid")
    last = lambda c: F.lag(c).over(by)
    least_pos = Window.partitionBy("token").orderBy("pos", "size", "gid")
    lists = groups.select("gid", "size", F.explode("prefix").alias("p")).select("gid", "size", "p.pos", "p.token")
    lists = lists.withColumn("prev", last("gid")).withColumn("prev_size", last("size")).withColumn("prev_pos", last("pos")).withColumn("more", F.lead("gid").over(by))
    lists = lists.filter("prev is not null or more is not null").withColumn("hub", F.first(F.struct("gid", "size", "pos")).over(least_pos))
    lists = written(lists.drop("more"), "lists")

    def fits(nx, px, ny, py):
        """Sizes allow the similarity, and so do the elements that may follow the shared one."""
        sizes = (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
        room = F.least(nx - px, ny - py)
        return sizes & ((100 + percent) * room >= percent * (nx + ny))

    c = F.col
    chain = lists.filter(c("prev").isNotNull() & fits(c("size"), c("pos"), c("prev_size"), c("prev_pos"))).select(F.least("prev", "gid").alias("a"), F.greatest("prev", "gid").alias("b"))
    star = lists.filter((c("hub.gid") != c("gid")) & fits(c("size"), c("pos"), c("hub.size"), c("hub.pos"))).select(F.least("hub.gid", "gid").alias("a"), F.greatest("hub.gid", "gid").alias("b"))
    inside = nodes.withColumn("a", F.lag("node").over(Window.partitionBy("gkey", "size").orderBy("node"))).filter("a is not null").select("a", c("node").alias("b"))
    sketch = nodes.select("node", c("size").alias("n"), "parity")
    near = chain.union(star).union(inside).filter("a <> b").distinct()
    for e in "ab":
        near = near.join(sketch.select(c("node").alias(e), c("n").alias(f"n{e}"), c("parity").alias(f"p{e}")), e)
    near = written(near.filter(may_link(c("na"), c("pa"), c("nb"), c("pb"), percent)).select("a", "b", apart(c("pa"), c("pb")).alias("d")), "near")
    # of these only each document's nearest is verified now; the others still meet below, unless they are linked by then
    best = near.select(c("a").alias("x"), F.struct("d", "a", "b").alias("p")).union(near.select(c("b").alias("x"), F.struct("d", "a", "b").alias("p"))).groupBy("x").agg(F.min("p").alias("p"))
    links = verified(best.select("p.a", "p.b").distinct(), docs, nodes, n, percent)
    label = written(components(links), "labels")

    members = nodes.join(nodes.groupBy("gkey", "size").agg(F.min("node").alias("gid")), ["gkey", "size"]).select("gid", "node")
    members = members.join(label, members.node == label.id, "left").select("gid", "node", F.coalesce("component", "node").alias("component"))
    alone = nodes.groupBy("gkey", "size").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("gid")).filter("n > 1").select("gid", F.col("gid").alias("token"), F.lit(-1).alias("size"), F.lit(0).alias("pos"))
    listed = lists.select("gid", "token", "size", "pos").unionByName(alone)
    # size -1: the list of a group's own members, under the group's id; every other list is under its element
    full_lists = written(listed.join(members, "gid").select("token", "size", "pos", "node", "component"), "members")
    own = c("size") < 0
    # per list its largest component: members of others are held against all, so that a large component costs its size
    per = full_lists.groupBy("token", own.alias("own"), "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = per.groupBy("token", "own").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    some = written(full_lists.withColumn("own", own).join(mixed, ["token", "own"]).join(sketch, "node"), "mixed")
    side = lambda df, s: df.select("token", "own", *[c(k).alias(f"{k}_{s}") for k in ("component", "top", "size", "pos", "node", "n", "parity")])
    x, y = side(some.filter("component <> top"), "x"), side(some, "y")
    once = (c("component_x") != c("component_y")) & ((c("component_y") == c("top_y")) | (c("component_x") < c("component_y")))
    may = (c("own") | fits(c("size_x"), c("pos_x"), c("size_y"), c("pos_y"))) & may_link(c("n_x"), c("parity_x"), c("n_y"), c("parity_y"), percent)
    far = x.join(y.withColumnsRenamed({"token": "t", "own": "o"}), (c("token") == c("t")) & (c("own") == c("o")) & once & may)
    far = far.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()
    more = verified(far, docs, nodes, n, percent)
    final = written(components(links.union(more)), "labels")

    linked = final.join(nodes.select(c("node").alias("id"), "rep"), "id")
    per = written(linked.groupBy("component").agg(F.min("rep").alias("first")), "components")
    if per.count() <= BROADCAST_IDS:
        named = linked.join(F.broadcast(per), "component")
    else:  # a component may hold a third of all nodes
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        named = linked.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(per.select("*", salt), ["component", "salt"])
    named = named.select(c("id").alias("node"), "first")
    return rows, nodes.select("node", "key", "rep", "n_rows").join(named, "node", "left")


def similar(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows, nodes = labelled(docs, n, percent)
    named = nodes.select("key", F.coalesce("first.doc_id", "rep.doc_id").alias("component_id"))
    done = rows.filter("size > 0").select("doc_id", F.col("size").cast("long").alias("n_shingles"), "key").join(named, "key", "left")
    return done.select("doc_id", "n_shingles", "component_id").union(rows.filter("size = 0").select("doc_id", F.col("size").cast("long"), "doc_id"))


def first_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each component, with the columns it came with: the row with the least id, rows without one last (any one of equal rows).

    Texts without words are linked with nothing and stay, but for rows that repeat an id.
    """
    _, nodes = labelled(docs, n, percent)
    best = nodes.filter(F.col("first").isNull() | (F.col("first") == F.col("rep"))).select("rep.row", "rep.check", (F.col("n_rows") > 1).alias("many"))
    best = small(written(best.withColumnsRenamed({"row": "__row", "check": "__check", "many": "__many"}), "kept"))
    row, check = identity()
    found = docs.join(best, (row == F.col("__row")) & (check == F.col("__check")))
    once = found.filter("not __many").select(docs.columns)
    equal = found.filter("__many").dropDuplicates(["__row", "__check"]).select(docs.columns)
    bare = docs.filter(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(equal).unionByName(bare.filter("doc_id is not null").dropDuplicates(["doc_id"])).unionByName(bare.filter("doc_id is null"))
