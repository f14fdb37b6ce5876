"""Operator 10: language-model scoring by prediction by partial matching.

Model: a byte-context trie of order ORDER, trained on all documents but the held-out ones. In a context with total T and q
distinct symbols a seen symbol with count c has probability c / (T + q), and the escape to the next shorter context q / (T + q);
there, symbols seen in the longer context are excluded from both. Below order 0 the remaining symbols are equally likely. A
text starts after an end mark and is followed by one, which is scored too. Since the trie is fixed after training, escapes
and exclusions are compiled into one table per order, and texts are scored by table look-ups, SLICE bytes at a time: a very
long text, or many short ones, take the memory of one slice beyond their bytes.

Training counts (context, symbol) of all training texts: sorted runs are exchanged by key range and summed. No pair is dropped.
Broadcast are orders 0 to ORDER - 2 (at most 256^3 pairs whatever the input) and of each longer order all pairs or, beyond NODES
of them, those of its most frequent contexts, each context with all its symbols. A suffix is at least as frequent, so what a
broadcast context scores is exact; bytes in other contexts leave their document and are joined with exact scores, which are
made in buckets of contexts with equal last ORDER - 1 bytes. Base: word counts, summed in the same exchange. The TOP most
frequent words are broadcast (a bound); all other words are joined with the table of counts and summed per document.

Style: Arrow batches (Python, numpy) for counting and scoring; joins and sums are DataFrame operations.

Defined results: null text = empty text: the end token alone and the end mark alone; a null doc_id is a training row;
without training rows counts are 0 and all symbols equally likely; repeated rows are counted and scored each; empty tables
give no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import small_batches, written

ORDER = 4
END = 0xFF  # not a byte of UTF-8
FOLDS, HELD = 7, 2
NODES = 1 << 20
BUCKET = 1 << 18
TOP = 1 << 18
RUN_WORDS = 1 << 21
RUN_BYTES = 1 << 23
SLICE = 1 << 18
CACHE = 1 << 16
WORD, GRAM = 0, 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_hash_of = _WordHash()


def word_hashes(raw: bytes, size: int = SLICE):
    """Arrays of the hashes of a text's words, one for about ``size`` bytes; no word is cut."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > size and (space := SPACE.search(raw, at + size)):
            end = space.end()
        ws = raw[at:end].lower().split()
        yield np.fromiter(map(_hash_of.__getitem__, ws), np.uint64, len(ws))
        at = end


def gram_keys(raws: list[bytes], order: int = ORDER, size: int = SLICE):
    """For every byte of every text, and its end mark: the preceding ``order`` bytes and the byte, packed.

    Pairs (numbers of the texts, keys) of at most ``size`` places; slices of one text carry their contexts.
    """
    mark = bytes([END])
    joined = np.frombuffer(mark * order + b"".join(x for r in raws for x in (r, mark * order)), np.uint8)
    lengths = np.fromiter(map(len, raws), np.int64, len(raws))
    starts = np.cumsum(lengths + order) - lengths - order  # a text's places, its end mark, then order - 1 places that do not count
    for a in range(0, len(joined) - order, size):
        z = min(len(joined) - order, a + size)
        keys = np.zeros(z - a, np.uint64)
        for i in range(order + 1):
            keys = (keys << np.uint64(8)) | joined[a + i : z + i]
        place = np.arange(a, z)
        text = np.searchsorted(starts, place, "right") - 1
        keep = place - starts[text] <= lengths[text]
        yield text[keep], keys[keep]


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_training(docs: DataFrame) -> DataFrame:
    """(kind, key, c): words and packed contexts with symbols of all training rows, with their counts."""
    bits = int(np.clip(np.ceil(np.log2(2 * max(1, docs.rdd.getNumPartitions()))), 4, 20))
    schema = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def runs(batches):
        def flush(kind):
            k, c = counted(*(np.concatenate(x) for x in zip(*held[kind], strict=True)))
            held[kind], size[kind] = [], 0
            # spread by a mixed key, so that ranges of similar contexts are dealt evenly
            part = ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            k, c, at = k[by], c[by], np.searchsorted(part[by], np.arange((1 << bits) + 1))
            out = ([], [], [], [])
            for p in range(1 << bits):
                if (a := at[p]) < (b := at[p + 1]):
                    out[0].append(kind)
                    out[1].append(p)
                    out[2].append(zlib.compress(np.diff(k[a:b], prepend=np.uint64(0)).tobytes(), 1))
                    out[3].append(zlib.compress(c[a:b].astype("<u4").tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

        # slices are counted at once, and their counts held until a run is full
        held, size, most = {WORD: [], GRAM: []}, {WORD: 0, GRAM: 0}, {WORD: RUN_WORDS, GRAM: RUN_BYTES}

        def add(kind, keys):
            held[kind].append(counted(keys))
            size[kind] += len(keys)
            if size[kind] >= most[kind]:
                yield flush(kind)

        for b in batches:
            raws = [(t or "").encode() for t in b.column(0).to_pylist()]
            words, n = [], 0
            for h in (h for raw in raws for h in word_hashes(raw)):
                words.append(h)
                n += len(h)
                if n >= SLICE:
                    yield from add(WORD, np.concatenate(words))
                    words, n = [], 0
            if n:
                yield from add(WORD, np.concatenate(words))
            for _, keys in gram_keys(raws):
                yield from add(GRAM, keys)
        for kind in held:
            if held[kind]:
                yield flush(kind)

    def merge(table: pa.Table) -> pa.Table:
        ks = [np.cumsum(np.frombuffer(zlib.decompress(x), np.uint64), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        cs = [np.frombuffer(zlib.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
        k, c = counted(np.concatenate(ks), np.concatenate(cs).astype(np.int64))
        return pa.table({"kind": pa.array(np.full(len(k), table.column("kind")[0].as_py(), np.int32)), "key": pa.array(k.view(np.int64)), "c": pa.array(c)})

    train = docs.filter(~held_out()).select("text")
    return train.mapInArrow(runs, "kind int, part int, keys binary, counts binary").groupBy("kind", "part").applyInArrow(merge, "kind int, key long, c long")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


class Trie:
    """The compiled model: per order a table of (context, symbol) pairs and one of contexts."""

    def __init__(self, pairs: dict[int, tuple[np.ndarray, np.ndarray]]):
        """``pairs``: order -> sorted packed (context, symbol) and counts; every pair of an order has its suffix in the order below."""
        self.orders, self.pairs = sorted(pairs), pairs
        self.pair, self.context = {}, {}
        below = None
        for k in self.orders:
            keys, c = pairs[k]
            if not len(keys):
                continue
            ctx, at, q = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
            total = np.add.reduceat(c, at).astype(float)
            of = np.repeat(np.arange(len(ctx)), q)
            self.pair[k] = _Table(keys, np.stack([np.log10(c / (total + q)[of]), np.log10(c)]).astype(np.float32))
            own = np.log10(q / (total + q))
            if below is None:
                self.left = 256 - len(keys)
                rest = np.zeros((2, len(ctx)))
            else:
                bk, bc, b_ctx, b_total, b_q = below
                mask = np.uint64((1 << 8 * k) - 1)  # drops the oldest byte of a pair
                seen = np.add.reduceat(bc[np.searchsorted(bk, keys & mask)], at)
                y = np.searchsorted(b_ctx, ctx & np.uint64((1 << 8 * (k - 1)) - 1))
                t, r = b_total[y] - seen, (b_q[y] - q).astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    rest = np.stack([np.where(t + r > 0, np.log10(np.maximum(t + r, 1)), 0.0), np.where(r > 0, np.log10(np.maximum(r, 1) / np.maximum(t + r, 1)), 0.0)])
            self.context[k] = _Table(ctx, np.stack([own, *rest]).astype(np.float32))
            below = keys, c, ctx, total, q
        if not self.pair:
            self.left = 256

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}

    def lacks(self, keys: np.ndarray) -> np.ndarray:
        """Which packed keys have a context that is not among those of the longest order."""
        k = self.orders[-1]
        return self.context[k].find(keys >> np.uint64(8)) < 0 if k in self.context else np.ones(len(keys), bool)

    def score(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each packed (context, symbol) of full order."""
        out, open_, x, longer = np.zeros(len(keys)), np.arange(len(keys)), keys, None
        for k in reversed(self.orders):
            if k not in self.pair:
                continue
            pair = x & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self.pair[k].find(pair)
            hit = at >= 0
            top, log_c = self.pair[k].values
            if longer is None:
                out[open_[hit]] += top[at[hit]]
                fresh = np.ones(len(x), bool)
            else:
                fresh = longer < 0  # not escaped yet: no context of a longer order was known
                gain = np.where(fresh[hit], top[at[hit]], log_c[at[hit]] - longer_table.values[1][longer[hit]])
                out[open_[hit]] += gain
            miss = ~hit
            open_, x, fresh = open_[miss], x[miss], fresh[miss]
            known = self.context[k].find((x & np.uint64((1 << 8 * (k + 1)) - 1)) >> np.uint64(8))
            if longer is not None:
                longer = longer[miss]
                out[open_] += np.where(fresh, 0.0, longer_table.values[2][np.maximum(longer, 0)])
            out[open_] += np.where(fresh & (known >= 0), self.context[k].values[0][np.maximum(known, 0)], 0.0)
            longer, longer_table = known, self.context[k]
            if not len(open_):
                return out
        out[open_] -= np.log10(max(self.left, 1))
        return out


class _Table:
    """Sorted keys with values; found through a table of slots addressed by the mixed key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.slots = None

    def __getstate__(self):
        return self.keys, self.values

    def __setstate__(self, state):
        self.keys, self.values = state
        self.slots = None

    def _build(self) -> None:
        bits = max(4, int(np.ceil(np.log2(2 * max(1, len(self.keys))))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(self.keys), dtype=np.int32), self._place(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if self.slots is None:
            self._build()
        at = self._place(keys)
        found = self.slots[at]
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        at = at[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            found[wrong] = got = self.slots[at]
            stay = (got >= 0) & (self.keys[got] != keys[wrong])
            wrong, at = wrong[stay], at[stay]
        return found


def _sorted_pairs(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = table.select("key", "c").toArrow()
    key, c = rows.column("key").to_numpy().astype(np.uint64), rows.column("c").to_numpy()
    by = np.argsort(key)
    return key[by], c[by]


def train(counts: DataFrame, order: int = ORDER, nodes: int = NODES) -> tuple[Trie, DataFrame | None]:
    """The trie that is broadcast, from summed counts; and where it lacks contexts of full order, the table of all pairs of that order.

    Beyond ``nodes`` pairs an order keeps whole contexts, those whose totals reach the least power of two that leaves at most ``nodes``.
    """
    grams = counts.filter(F.col("kind") == GRAM).select("key", "c")
    pairs, least = {}, 1
    for k in range(order + 1):
        table = grams if k == order else grams.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.sum("c").alias("c"))
        if k > order - 2:
            table = written(table, f"grams{k}").withColumn("context", F.shiftrightunsigned("key", 8))
            if least > 1 or table.count() > nodes:
                contexts = table.groupBy("context").agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("q"))
                sizes = contexts.groupBy(F.floor(F.log2("total")).alias("p")).agg(F.sum("q").alias("n")).collect()
                while sum(r.n for r in sizes if 2**r.p >= least) > nodes:
                    least *= 2
                full, table = table, table.join(contexts.filter(F.col("total") >= least), "context", "left_semi")
        pairs[k] = _sorted_pairs(table)
    return Trie(pairs), full.select("key", "c") if least > 1 else None


def exact(keys: DataFrame, table: DataFrame, trie: Trie, order: int = ORDER, bucket: int = BUCKET) -> DataFrame:
    """(key, value): the log10 probabilities of distinct packed keys by all pairs of full order in ``table``, in buckets of about ``bucket`` rows.

    A bucket has whole contexts of order - 1 bytes, so that the two longest orders are complete in it; one such context has at most 256^2 rows
    of either kind. ``trie`` has the shorter orders.
    """
    n = (table.count() + keys.count()) // bucket + 1
    short = keys.sparkSession.sparkContext.broadcast({k: trie.pairs[k] for k in range(order - 1)})

    def values(rows: pa.Table) -> pa.Table:
        key, c = rows.column("key").to_numpy().astype(np.uint64), rows.column("c").to_numpy()
        ask, top = key[c == 0], counted(key[c > 0], c[c > 0])
        below = counted(top[0] & np.uint64((1 << 8 * order) - 1), top[1])
        value = Trie({**short.value, order - 1: below, order: top}).score(ask)
        return pa.table({"key": pa.array(ask.view(np.int64)), "value": pa.array(value)})

    both = table.select("key", F.col("c").cast("long").alias("c")).union(keys.select("key", F.lit(0).cast("long")))
    context = F.shiftrightunsigned("key", 8).bitwiseAND((1 << 8 * (order - 1)) - 1)
    return both.withColumn("bucket", F.pmod(F.xxhash64(context), F.lit(n))).groupBy("bucket").applyInArrow(values, "key long, value double")


def score(docs: DataFrame, top: int = TOP, nodes: int = NODES, bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    with small_batches(spark):
        counts = written(count_training(docs), "counts")
    words = counts.filter(F.col("kind") == WORD).select(F.col("key").alias("word"), "c")
    n_docs = docs.filter(~held_out()).count()
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, room = tokens + n_docs, tokens + n_docs + distinct + (n_docs > 0) + 1
    best = words.orderBy(F.col("c").desc(), "word").limit(top).toArrow()
    key = best.column("word").to_numpy().view(np.uint64)
    by = np.argsort(key)
    trie, pairs = train(counts, nodes=nodes)
    shared = spark.sparkContext.broadcast((key[by], best.column("c").to_numpy()[by], trie))
    partial = pairs is not None
    log_room = float(np.log10(room))

    def run(batches):
        from pyspark import TaskContext

        key, c, trie = shared.value
        gain = np.log10(c + 1.0) - log_room
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            n, known, base, rare = [], [], [], []
            for raw in raws:
                n.append(1)
                known.append(0)
                base.append(0.0)
                rare.append([np.empty(0, np.int64)])
                for h in word_hashes(raw):
                    at = np.minimum(np.searchsorted(key, h), len(key) - 1)
                    hit = key[at] == h if len(key) else np.zeros(len(h), bool)
                    n[-1] += len(h)
                    known[-1] += int(hit.sum())
                    base[-1] += float(gain[at[hit]].sum())
                    rare[-1].append(h[~hit].view(np.int64))
            rare = [np.concatenate(r) for r in rare]
            scores, grams = _scores(trie, raws, partial)
            ids = pa.array(np.arange(row, row + len(raws)))
            row += len(raws)
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(scores), grams]
            yield pa.RecordBatch.from_arrays([ids, b.column(0), b.column(2), *columns], [f.split()[0] for f in fields.split(", ")])

    fields = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, rare array<long>, score double, grams array<struct<key:bigint,n:bigint>>"
    with small_batches(spark):
        rows = written(docs.withColumn("held_out", held_out()).mapInArrow(run, fields), "scored")
    looked_up = rows.select("row", F.explode("rare").alias("word")).join(words, "word", "left")
    rest = looked_up.groupBy("row").agg(F.count("c").alias("more"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0) - log_room).alias("rest"))
    end = float(np.log10(n_docs + 1) - log_room)
    out = rows.drop("rare", "grams").join(rest, "row", "left")
    if partial:
        asked = rows.select("row", F.explode("grams").alias("g")).select("row", "g.key", "g.n")
        value = exact(written(asked.select("key").distinct(), "asked"), pairs, trie, bucket=bucket)
        lacked = asked.join(value, "key").groupBy("row").agg(F.sum(F.col("n") * F.col("value")).alias("lacked"))
        out = out.join(lacked, "row", "left").withColumn("score", F.col("score") + F.coalesce("lacked", F.lit(0.0)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) + end).alias("base_score"), "score",
    )


def _scores(trie: Trie, raws: list[bytes], partial: bool = False) -> tuple[np.ndarray, pa.ListArray]:
    """Scores of texts, a slice at a time.

    With a ``partial`` trie also, per text, the distinct keys whose contexts it lacks, with their numbers; those are not in the scores.
    """
    out, lacked = np.zeros(len(raws)), [[] for _ in raws]
    for text, keys in gram_keys(raws):
        each = trie.score(keys)
        if partial:
            lacks = trie.lacks(keys)
            each[lacks] = 0.0
            of, some = text[lacks], keys[lacks]
            for a, z in pairwise([*np.flatnonzero(np.diff(of, prepend=-1)), len(of)]):  # none where a slice lacks nothing
                lacked[of[a]].append(counted(some[a:z]))
        if len(text):
            out[text[0] : text[-1] + 1] += np.bincount(text - text[0], weights=each)
    none = [counted(np.empty(0, np.uint64))]
    lacked = [counted(*(np.concatenate(x) for x in zip(*(found or none), strict=True))) for found in lacked]
    at = np.cumsum([0, *[len(k) for k, _ in lacked]])
    flat = [np.concatenate([x[s] for x in lacked]) if lacked else np.empty(0) for s in (0, 1)]
    flat = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in flat], ["key", "n"])
    return out, pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
