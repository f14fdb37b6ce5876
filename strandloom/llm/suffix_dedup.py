"""Operator 3: removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte is removed if a LENGTH-byte string that covers it starts anywhere else too. Suffixes are sampled so that this stays
exact: of every LENGTH-byte window the CORE-byte string with the least hash (leftmost on ties) is its anchor, and equal
windows have equal anchors at equal offsets. Only suffixes at anchors are sorted, each as the string
    core, right context up to LENGTH bytes, then the left context reversed,
so that all that decides about the windows of an anchor is in one string. Places beyond a document are filled with a byte
that UTF-8 lacks, and windows over it are not considered; matches never cross documents.
  1. Anchor hashes are exchanged as sorted, delta-coded runs; those met twice set a bit in a bitmap of at most BITMAP bits.
     It is only a filter: more input than it has room for lets more suffixes through and changes no result.
  2. Each task sorts the suffixes that pass, collapses equal ones (which are then known to repeat, in full), front-codes the
     run and sends its pieces to key ranges whose bounds come from a sample of anchors.
  3. Each range merges its runs with a loser tree. Every run's head carries its common prefix with the last output, so known
     prefixes are never compared again; equal suffixes of different runs meet as full-length common prefixes.
  4. Suffixes with one core form a group: for each pair, or each offset in larger groups, equal windows mark their bytes. A
     group with more than GROUP distinct contexts is dealt out by window and decided by aggregation.
Style: Arrow batches (Python, numpy) for sampling, sorting and merging; exchange, aggregation and join are DataFrame
operations. Equal copies are collapsed before the exchange, so a large group of copies costs a range one suffix per run.

Defined results: null text = empty text: 0 bytes, nothing removed, the hash of no bytes; texts under LENGTH bytes stay whole;
rows with equal text are copies of each other, whatever their id; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import written

LENGTH = 200
CORE = 100
PAD = 0xFF
SLOTS = LENGTH - CORE + 1  # windows per anchor: it may start at the window's byte 0 to SLOTS - 1
LEFT = SLOTS - 1
FULL = LENGTH + LEFT
BITMAP = 1 << 29
CHUNK = 1 << 21
RUN_ANCHORS = 1 << 20
RUN_SUFFIXES = 1 << 16
GROUP = 20_000
PAIRS = 6
BROADCAST_ITEMS = 1_000_000  # documents and spans together: some 50 MB
NO_ID = -(1 << 63)
_ODD = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            steps = np.full(max(n, CHUNK + (CHUNK >> 2)), base & ((1 << 64) - 1), np.uint64)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=np.uint64))
        _powers[:] = tables
    return _powers[0], _powers[1]


def anchors(b: np.ndarray, doc: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all windows of ``b`` that lie in one document (``doc``: its number per byte), and their hashes."""
    n = len(b)
    if n < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[:n], out=sums[1:])
    h = (sums[core:] - sums[:-core]) * down[: n - core + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    low = np.uint64(0xFFFFFF)  # the place, which breaks ties to the left
    assert n <= int(low), "a slice is longer than places can be packed"
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    w, step = length - core + 1, 1
    while 2 * step <= w:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < w:
        m = np.minimum(m[: len(m) - (w - step)], m[w - step :])
    whole = doc[: n - length + 1] == doc[length - 1 :]
    chosen = np.zeros(len(h), bool)
    chosen[(m[: n - length + 1][whole] & low).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, h[at]


def _slices(rows):
    """Groups of slices (row, text bytes, begin, end, own begin) of about CHUNK bytes in all.

    A longer text comes in slices; each has the anchors from its own begin on, CHUNK bytes of them, and reaches far enough
    to both sides to hold all windows over these anchors and their contexts.
    """
    held, size = [], 0
    for row, raw in rows:
        if len(raw) < LENGTH:
            continue
        for s in range(0, len(raw), CHUNK):
            held.append((row, raw, max(0, s - LENGTH), min(len(raw), s + CHUNK + 2 * LENGTH), s))
            size += held[-1][3] - held[-1][2] + LENGTH
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchored(held):
    """For a group of slices: joined bytes with padding, places of the anchors that the slices own, hashes, rows, places in the text."""
    gap = bytes([PAD]) * LENGTH
    parts, lengths = [gap], []
    for _, raw, a, z, _ in held:
        parts += [raw[a:z], gap]
        lengths.append(z - a)
    b = np.frombuffer(b"".join(parts), np.uint8)
    starts = LENGTH + np.concatenate(([0], np.cumsum(np.array(lengths) + LENGTH)[:-1]))
    doc = -1 - np.arange(len(b))  # no window over padding
    for i, (at, n) in enumerate(zip(starts.tolist(), lengths, strict=True)):
        doc[at : at + n] = i
    place, h = anchors(b, doc)
    of = doc[place]
    row, begin, own = (np.array([g[i] for g in held]) for i in (0, 2, 4))
    pos = place - starts[of] + begin[of]
    mine = (pos >= own[of]) & (pos < own[of] + CHUNK)
    return b, place[mine], h[mine], row[of[mine]], pos[mine]


def _test(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set."""
    at = h >> np.uint64(64 - int(np.log2(8 * len(bitmap))))
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def suffix_strings(b: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The sorted strings' bytes, one row per anchor: LENGTH bytes from it, then the LEFT bytes before it, backwards."""
    right = np.lib.stride_tricks.sliding_window_view(b, LENGTH)[place]
    left = np.lib.stride_tricks.sliding_window_view(b, LEFT)[place - LEFT][:, ::-1]
    s = np.concatenate([right, left], axis=1)
    # after the first padding byte everything is padding: what follows is another document
    for a, z in ((0, LENGTH), (LENGTH, FULL)):
        part = s[:, a:z]
        part[np.logical_or.accumulate(part == PAD, axis=1)] = PAD
    return s


def offsets_of(s: bytes) -> tuple[int, int]:
    """Least and greatest offset of the anchor in windows that lie within the document."""
    right, left = s.find(PAD, 0, LENGTH), s.find(PAD, LENGTH)
    return (LENGTH - right if right >= 0 else 0), (left - LENGTH if left >= 0 else LEFT)


# --- runs ------------------------------------------------------------------------------------------------------------


def encode_run(s: np.ndarray, ids: tuple[np.ndarray, ...]) -> bytes:
    """A sorted piece of a run, front-coded: common prefixes with the string before, the rests, and per string doc, text hash, place."""
    common = np.zeros(len(s), np.int64)
    if len(s) > 1:
        differ = s[1:] != s[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), FULL)
    rest = s[np.arange(FULL) >= common[:, None]]
    head = np.array([len(s)], "<i8").tobytes()
    return zlib.compress(head + common.astype("<u2").tobytes() + b"".join(np.ascontiguousarray(i, "<i8").tobytes() for i in ids) + rest.tobytes(), 1)


class Run:
    """Reads a piece of a run in order."""

    def __init__(self, blob: bytes):
        raw = zlib.decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.common = np.frombuffer(raw, "<u2", n, 8).tolist()
        self.ids = np.frombuffer(raw, "<i8", 3 * n, 8 + 2 * n).reshape(3, n).T.tolist()
        self.rest, self.at, self.i, self.n, self.s = raw, 8 + 26 * n, 0, n, b""

    def next(self) -> int:
        """Moves to the next string; returns its common prefix with the one before, or -1 at the end."""
        if self.i == self.n:
            return -1
        c = self.common[self.i]
        z = self.at + FULL - c
        self.s = self.s[:c] + self.rest[self.at : z]
        self.id = self.ids[self.i]
        self.at = z
        self.i += 1
        return c


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of two strings of equal length that agree up to ``start``."""
    n = len(a)
    while start < n:
        x = int.from_bytes(a[start : start + 32]) ^ int.from_bytes(b[start : start + 32])
        if x:
            return start + min(32, n - start) - (x.bit_length() + 7) // 8
        start += 32
    return n


def merged(blobs: list[bytes]):
    """Loser-tree merge: yields (common prefix with the last string, string, id) in order."""
    runs = [Run(x) for x in blobs]
    k = 1
    while k < len(runs):
        k *= 2
    head = [r.next() for r in runs] + [-1] * (k - len(runs))  # of each run's head: common prefix with the last winner it met
    lost, win = [0] * k, [0] * (2 * k)
    for i in range(k):
        win[k + i] = i

    def duel(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's head is left with its common prefix with the winner."""
        x, y = head[a], head[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        s, t = runs[a].s, runs[b].s
        c = common_prefix(s, t, x)
        if c == len(s) or s[c] < t[c]:
            head[b] = c
            return a, b
        head[a] = c
        return b, a

    for node in range(k - 1, 0, -1):
        win[node], lost[node] = duel(win[2 * node], win[2 * node + 1])
    w = win[1] if k > 1 else 0
    while head[w] >= 0:
        run = runs[w]
        yield head[w], run.s, run.id
        head[w] = run.next()
        node, a = (w + k) >> 1, w
        while node:
            b = lost[node]
            x, y = head[a], head[b]
            if x < y:
                lost[node], a = a, b
            elif x == y and x >= 0:
                a, lost[node] = duel(a, b)
            node >>= 1
        w = a


# --- groups ----------------------------------------------------------------------------------------------------------


def decide(strings: list[bytes], common: list[int]) -> list[list[tuple[int, int]]]:
    """For distinct sorted strings with one core: per string the intervals of offsets whose windows another string has too.

    ``common[i]``: common prefix of strings i - 1 and i, as the merge found it.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    if len(strings) <= PAIRS:
        for j in range(1, len(strings)):
            right = FULL
            for i in range(j - 1, -1, -1):
                right = min(right, common[i + 1])
                r = min(right, LENGTH)
                left = common_prefix(strings[i][LENGTH:], strings[j][LENGTH:], 0)
                for x in (i, j):
                    lo, hi = offsets_of(strings[x])
                    if (a := max(lo, LENGTH - r)) <= (z := min(hi, left)):
                        out[x].append((a, z))
        return out
    m = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), FULL)
    line = np.concatenate([m[:, LENGTH:][:, ::-1], m[:, CORE:LENGTH]], axis=1).astype(np.uint64)  # left context, then what follows the core
    up, down = _power_tables(line.shape[1] + 1)
    sums = np.zeros((len(strings), line.shape[1] + 1), np.uint64)
    np.cumsum((line + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) * up[: line.shape[1]], axis=1, out=sums[:, 1:])
    hit = np.zeros((len(strings), SLOTS), bool)
    for d in range(SLOTS):
        a = LEFT - d  # the window without the core: d bytes to the left, LEFT - d to the right
        h = (sums[:, a + LEFT] - sums[:, a]) * down[a]
        by = np.argsort(h, kind="stable")
        same = np.flatnonzero(h[by][1:] == h[by][:-1])
        same = same[(line[by[same], a : a + LEFT] == line[by[same + 1], a : a + LEFT]).all(1)]
        hit[by[same], d] = hit[by[same + 1], d] = True
    for i, s in enumerate(strings):
        lo, hi = offsets_of(s)
        got = np.flatnonzero(hit[i, lo : hi + 1]) + lo
        if len(got):
            cut = np.flatnonzero(np.diff(got) > 1)
            out[i] = list(zip(got[np.concatenate(([0], cut + 1))].tolist(), got[np.concatenate((cut, [len(got) - 1]))].tolist(), strict=True))
    return out


def _bytes(texts):
    return [(t or "").encode() for t in texts]


def _bitmap(docs: DataFrame, parts: int) -> tuple[np.ndarray, list[bytes]]:
    """Step 1: bits of the anchor hashes that occur twice or more, and a sample of anchor strings' beginnings."""
    bits, thin = int(np.clip(np.ceil(np.log2(4 * parts)), 4, 18)), np.uint64(min(24, 10 + int(np.log2(parts))))
    schema = pa.schema([("part", pa.int32()), ("run", pa.binary())])

    def runs(batches):
        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            at = np.searchsorted(k, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(40 - bits))
            keyed = (k << np.uint64(1)) | (c > 1)
            rows = [(p, zlib.compress(np.diff(keyed[a:b], prepend=np.uint64(0)).tobytes(), 1)) for p in range(1 << bits) if (a := at[p]) < (b := at[p + 1])]
            rows.append((-1, b"".join(sampled)))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=schema)

        held, size, sampled = [], 0, []
        for batch in batches:
            for group in _slices(enumerate(_bytes(batch.column(0).to_pylist()))):
                b, place, h, _, _ = _anchored(group)
                held.append(h >> np.uint64(24))
                size += len(h)
                sampled += [b[p : p + 16].tobytes() for p in place[(h & ((np.uint64(1) << thin) - np.uint64(1))) == 0]]
                if size >= RUN_ANCHORS:
                    yield flush()
                    held, size, sampled = [], 0, []
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return table.select(["part", "run"]).cast(schema)
        k = np.sort(np.concatenate([np.cumsum(np.frombuffer(zlib.decompress(x), np.uint64), dtype=np.uint64) for x in table.column("run").to_pylist()]))
        one, twice = k >> np.uint64(1), (k & np.uint64(1)).astype(bool)
        twice[1:] |= one[1:] == one[:-1]
        got = np.unique(one[twice])
        return pa.table({"part": table.column("part").slice(0, 1), "run": pa.array([got.tobytes()], pa.binary())}, schema=schema)

    found = written(docs.select("text").mapInArrow(runs, "part int, run binary").groupBy("part").applyInArrow(merge, "part int, run binary"), "anchors")
    n = found.filter("part >= 0").agg(F.coalesce(F.sum(F.octet_length("run")), F.lit(0))).first()[0] // 8
    room = int(np.clip(np.ceil(np.log2(64 * max(n, 1))), bits + 3, int(np.log2(BITMAP))))

    def segments(batches):
        """A part's stretch of the bitmap, packed: all of them together are as long as the bitmap."""
        for batch in batches:
            for p, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p >= 0:
                    stretch = np.zeros(1 << (room - bits), bool)
                    stretch[((np.frombuffer(run, np.uint64) >> np.uint64(40 - room)) & np.uint64((1 << (room - bits)) - 1)).astype(np.int64)] = True
                    run = np.packbits(stretch).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([run], pa.binary())], schema=schema)

    bitmap, sample = np.zeros(1 << (room - 3), np.uint8), []
    for r in found.mapInArrow(segments, "part int, run binary").toLocalIterator():
        if r.part >= 0:
            bitmap[r.part << (room - bits - 3) :][: len(r.run)] = np.frombuffer(r.run, np.uint8)
        else:
            sample += [bytes(r.run[i : i + 16]) for i in range(0, len(r.run), 16)]
    return bitmap, sorted(sample)


def repeated(docs: DataFrame, group_limit: int = GROUP) -> DataFrame:
    """(doc_id, hash, s, e): byte intervals of texts that repeated strings cover; ``hash`` is xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    inputs = max(1, docs.rdd.getNumPartitions())
    bitmap, sample = _bitmap(docs, inputs)
    ranges = 4 * max(inputs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    shared = spark.sparkContext.broadcast((bitmap, bounds))
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])

    def runs(batches):
        bitmap, bounds = shared.value
        salt = 0

        def flush():
            nonlocal salt
            s, doc, hashes, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            raw = s.tobytes()
            rows = [raw[i : i + FULL] for i in range(0, len(raw), FULL)]
            by = sorted(range(len(rows)), key=rows.__getitem__)
            same = np.zeros(len(by) + 1, bool)  # equal to the one before
            same[1:-1] = np.fromiter((rows[a] == rows[b] for a, b in zip(by, by[1:], strict=False)), bool, len(by) - 1)
            by = np.array(by)
            many = same[:-1] | same[1:]
            out = []
            if many.any():  # known to repeat in full; dealt to any range, since only the representative matters to others
                marks = by[many]
                lim = np.array([offsets_of(rows[i]) for i in marks])
                salt += 1
                out.append((salt * 7919 % (len(bounds) + 1), 1, np.stack([doc[marks], hashes[marks], pos[marks] - lim[:, 1], pos[marks] - lim[:, 0] + LENGTH]).astype("<i8").tobytes()))
            first = by[~same[:-1]]
            pos = np.where(np.isin(np.arange(len(rows)), by[many]), -1, pos)  # place -1: repeats already, no more marks needed
            part = [bisect_right(bounds, rows[i][:16]) for i in first]
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(first)]
            for a, z in zip(cut, cut[1:], strict=False):
                some = first[a:z]
                out.append((part[a], 0, encode_run(s[some], (doc[some], hashes[some], pos[some]))))
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(schema)], schema=schema)

        held, size = [], 0
        for batch in batches:
            ids, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for group in _slices(enumerate(_bytes(batch.column(2).to_pylist()))):
                b, place, h, row, pos = _anchored(group)
                ok = _test(bitmap, h)
                place, row, pos = place[ok], row[ok], pos[ok]
                for a in range(0, len(place), RUN_SUFFIXES):
                    r = row[a : a + RUN_SUFFIXES]
                    held.append((suffix_strings(b, place[a : a + RUN_SUFFIXES]), ids[r], th[r], pos[a : a + RUN_SUFFIXES]))
                    size += len(r)
                    if size >= RUN_SUFFIXES:
                        yield flush()
                        held, size = [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        marks = [array("q") for _ in range(4)]
        over: list[tuple] = []
        blobs = []
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            if kind == 0:
                blobs.append(blob)
                continue
            for to, values in zip(marks, np.frombuffer(blob, "<i8").reshape(4, -1), strict=True):
                to.frombytes(values.tobytes())

        def mark(who, lo: int, hi: int):
            for to, v in zip(marks, (who[0], who[1], who[2] - hi, who[2] - lo + LENGTH), strict=True):
                to.append(v)

        def close(group, large: bool):
            """group: [common, string, first id, whether it repeats in full]"""
            if large:
                over.extend((g[1], *g[2]) for g in group)
            elif len(group) > 1:
                for g, found in zip(group, decide([g[1] for g in group], [g[0] for g in group]), strict=True):
                    if not g[3]:
                        for lo, hi in found:
                            mark(g[2], lo, hi)

        group: list[list] = []
        large = False  # a group of more than GROUP contexts: all of it is dealt out by window
        for common, s, who in merged(blobs):
            if common == FULL and group:  # equal to the last
                last = group[-1]
                lo, hi = offsets_of(s)
                if not last[3]:
                    last[3] = True
                    mark(last[2], lo, hi)
                if who[2] >= 0:
                    mark(who, lo, hi)
                continue
            if common < CORE:
                close(group, large)
                group, large = [], False
            elif len(group) >= group_limit:
                close(group, True)
                group, large = [], True
            group.append([common, s, who, who[2] < 0])
        close(group, large)
        n, m = len(marks[0]), len(over)
        pad = [None] * n
        return pa.table(
            {
                "doc_id": pa.array([*marks[0], *(o[1] for o in over)], pa.int64()), "hash": pa.array([*marks[1], *(o[2] for o in over)], pa.int64()),
                "s": pa.array([*marks[2], *(o[3] for o in over)], pa.int64()), "e": pa.array([*marks[3], *([0] * m)], pa.int64()), "rest": pa.array(pad + [o[0] for o in over], pa.binary()),
            }
        )

    merged_rows = docs.select("doc_id", "hash", "text").mapInArrow(runs, "part int, kind int, blob binary").groupBy("part").applyInArrow(merge, "doc_id long, hash long, s long, e long, rest binary")
    found = written(merged_rows, "marks")
    marks = found.filter("rest is null").select("doc_id", "hash", "s", "e")
    if found.filter("rest is not null").limit(1).count():
        marks = marks.unionByName(_by_window(found.filter("rest is not null")))
    return marks


def _by_window(rows: DataFrame) -> DataFrame:
    """Large groups: each window (offset and bytes) is a key; keys of two or more places mark them."""
    def windows(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("s", pa.int64()), ("key", pa.binary())])
        for b in batches:
            out = ([], [], [], [])
            for doc, th, pos, s in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                line = s[LENGTH:][::-1] + s[:LENGTH]
                lo, hi = offsets_of(s)
                for d in range(lo, hi + 1):
                    for to, v in zip(out, (doc, th, pos - d if pos >= 0 else -1, hashlib.blake2b(b"%d:" % d + line[LEFT - d : LEFT - d + LENGTH], digest_size=16).digest()), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)

    each = rows.select("doc_id", "hash", "s", "rest").mapInArrow(windows, "doc_id long, hash long, s long, key binary")
    often = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    return each.filter("s >= 0").join(often, "key", "left_semi").select("doc_id", "hash", "s", (F.col("s") + LENGTH).alias("e"))


def dedup(docs: DataFrame, keep_text: bool = False, group_limit: int = GROUP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes, if asked for)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = repeated(docs, group_limit).groupBy("doc_id", "hash").agg(F.collect_set(F.col("s") * (1 << 31) + F.col("e")).alias("spans"))

    def union(batches):
        """Overlapping and touching intervals as one."""
        for b in batches:
            out = []
            for packed in b.column(2).to_pylist():
                merged = []
                for x in sorted(packed):
                    s, e = x >> 31, x & ((1 << 31) - 1)
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                out.append([(s << 31) + e for s, e in merged])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "hash", "spans"])

    spans = written(found.mapInArrow(union, "doc_id long, hash long, spans array<long>"), "spans").withColumnsRenamed({"doc_id": "__id", "hash": "__hash"})
    n_docs, n_spans = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    if n_docs + n_spans <= BROADCAST_ITEMS:
        spans = F.broadcast(spans)
    rows = docs.withColumn("__id2", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("__hash2", F.xxhash64("text"))
    rows = rows.join(spans, (F.col("__id2") == F.col("__id")) & (F.col("__hash2") == F.col("__hash")), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for b in batches:
            out = ([], [], [], [], [])
            for t, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw, keep, end, n = (t or "").encode(), [], 0, 0
                for x in sorted(packed or ()):
                    s, e = x >> 31, x & ((1 << 31) - 1)
                    if s > end or n == 0:
                        keep.append(raw[end:s])
                        n += 1
                    end = max(end, e)
                keep.append(raw[end:])
                left = b"".join(keep)
                for to, v in zip(out, (len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest(), left if keep_text else None), strict=True):
                    to.append(v)
            cols = [b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if keep_text else done.drop("kept")
