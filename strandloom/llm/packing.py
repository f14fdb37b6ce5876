"""Operator 7: packing by best-fit decreasing.

A document is its token ids followed by an end id. Overlong documents are first cut into full windows; what is left of each
is placed, longest first, into the open window with the least room that still takes it. A segment tree indexed by remaining
capacity finds that window in log2(window) steps. At the end of a block the gaps that best fit leaves are closed by cutting:
the emptiest windows give their tokens to the fullest ones, and the last open window is written as sequences whose lengths
are powers of two, which need no padding. Every id lies in exactly one piece.

Style: Arrow batches in Python (a tokenizer library and a sequential placement). Packing happens within a task, block by
block (``block`` tokens, a memory bound), so nothing is shuffled and sequence ids are (partition, counter). A lost task
gives the same rows again, as its split of the input is the same.

Defined results: null text = empty text = the end id alone, one piece of length 1; repeated rows are packed each; an empty
table gives no rows; further columns are ignored; a text of any length is cut into windows.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.word_bpe import byte_alphabet

WINDOW = 2048
END_ID = 1
BLOCK = 1 << 22


class CapacityTree:
    """Open windows by remaining capacity; finds the least capacity of at least ``need``."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        if room <= 0:
            return
        self.open.setdefault(room, []).append(window)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, window) of the tightest fit, or None."""
        count, i = self.count, need + self.leaves
        while not count[i]:
            while i & 1:  # a right child: go up until there is a right sibling
                i >>= 1
                if i <= 1:
                    return None
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        window = self.open[room].pop()
        self._change(room, -1)
        return room, window


#: Fixed value: the split of byte-level pre-tokenizers.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """ids of a text as little-endian 32-bit bytes, equal to the tokenizers library's.

    Where the ids of the vocabulary are in the order of its merges, texts of common characters without special strings go
    through the faster rank-based encoder over the same file; all others go through the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.rare = re.compile(r"[^\x00-\u024f\u2000-\u206f]").search
        spec = json.load(open(path, encoding="utf-8"))
        vocab, byte = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
        made = [vocab["".join(m)] for m in spec["model"]["merges"]]
        ordered = made == sorted(made) and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy if ordered else None

    def __call__(self, text: str) -> bytes:
        if self.fast is None or self.rare(text) or any(s in text for s in self.special):
            return _packed(self.lib.encode(text, add_special_tokens=False).ids)
        return self.fast(text, disallowed_special=()).astype("<u4").tobytes()


def _packed(ids) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def pack_block(items: list[tuple[int, int, bytes, int]], window: int) -> list[list[tuple[int, int, bytes, int]]]:
    """Sequences of pieces (doc_id, start, ids, doc_tokens). ``items``: pieces of at most ``window`` ids."""
    items = sorted(items, key=lambda p: -len(p[2]))
    tree, full, bins = CapacityTree(window), [], []
    for p in items:
        n = len(p[2]) // 4
        if n == window:
            full.append([p])
            continue
        got = tree.take(n)
        if got is None:
            bins.append([p])
            tree.add(window - n, len(bins) - 1)
        else:
            bins[got[1]].append(p)
            tree.add(got[0] - n, got[1])
    return full + _close_gaps(bins, window)


def _close_gaps(bins, window: int):
    used = lambda b: sum(len(p[2]) for p in b) // 4
    sized = sorted(((used(b), i) for i, b in enumerate(bins)), reverse=True)
    done, lo, hi = [], 0, len(sized) - 1
    while lo < hi:
        n, i = sized[lo]
        target = bins[i]
        while n < window and lo < hi:
            donor = bins[sized[hi][1]]
            doc, start, ids, total = donor.pop()
            room = (window - n) * 4
            target.append((doc, start, ids[:room], total))
            n += min(room, len(ids)) // 4
            if len(ids) > room:
                donor.append((doc, start + room // 4, ids[room:], total))
            if not donor:
                hi -= 1
        if n < window:
            break
        done.append(target)
        lo += 1
    if lo <= hi or (sized and not done):
        rest = bins[sized[lo][1]]
        left = used(rest)
        while left:
            size, part = 1 << (left.bit_length() - 1), []
            if size > window:
                size = window
            left -= size
            while size:
                doc, start, ids, total = rest.pop()
                part.append((doc, start, ids[: size * 4], total))
                if len(ids) > size * 4:
                    rest.append((doc, start + size, ids[size * 4 :], total))
                size -= min(size, len(ids) // 4)
            done.append(part)
    return done


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_tokens: dict[str, Tokens] = {}


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """One row per piece of each document (see SCHEMA)."""

    def run(batches):
        from pyspark import TaskContext

        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        if path not in _tokens:
            _tokens[path] = Tokens(path)
        ids_of, last = _tokens[path], _packed([end_id])
        base, items, held = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            nonlocal base
            cols = [array("q") for _ in range(7)]
            for seq in pack_block(items, window):
                at = 0
                for doc, start, ids, total in seq:
                    n = len(ids) // 4
                    for c, v in zip(cols[1:], (start, n, zlib.crc32(ids), total, base, at), strict=True):
                        c.append(v)
                    names.append(doc)
                    at += n
                base += 1
            out = [pa.array(names, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[1:])]
            names.clear()
            items.clear()
            return pa.RecordBatch.from_arrays(out, [f.split()[0] for f in SCHEMA.split(", ")])

        names: list = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = ids_of(text or "") + last
                total = len(ids) // 4
                for s in range(0, total, window):
                    items.append((doc, s, ids[s * 4 : (s + window) * 4], total))
                held += total
                if held >= block:
                    yield flush()
                    held = 0
        if items:
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
