"""Operator 2: token counts by heap-and-linked-list byte-pair merging.

A word's symbols stand in a doubly linked list; every adjacent pair that has a rank is on a heap; the lowest rank (leftmost
first on ties) is popped and merged until the heap is empty. The count is the number of initial symbols minus merges; no
identifier is produced. Words repeat, so each worker keeps counts of words it met, in a cache of bounded size.

Style: Arrow batches in Python; a heap with stale entries has no built-in counterpart. One pass, no shuffle. Texts are read
batch by batch, so memory is bounded by a batch and the cache. Texts beyond ASCII are normalized and split by the tokenizer
library's own rules, whose Unicode tables may be newer or older than Python's; the merging is ours.

Defined results: null text = empty text = 0 tokens and 0 bytes; exactly 2048 tokens are not over the limit; repeated rows
count separately; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
CACHE = 400_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes are themselves, the rest count up from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCounter(dict):
    """Maps a white-space-free, normalized string to its number of tokens; computes on first sight."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        spec = json.load(open(path, encoding="utf-8"))
        self.rank = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.vocab = spec["model"]["vocab"]
        self.alphabet = byte_alphabet()
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), split["behavior"].lower(), split["invert"])
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of normalized text."""
        return [p for p, _ in self.splitter.pre_tokenize_str(text)]

    def __missing__(self, word: str) -> int:
        n = sum(map(self.merged, self.pieces(word)))
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n

    def merged(self, piece: str) -> int:
        """Symbols of one pre-token after all merges."""
        sym = [self.alphabet[b] for b in piece.encode("utf-8")]
        sym[-1] += self.end
        n = len(sym)
        if n == 1:
            return 1
        rank, before, after = self.rank, list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one side has been merged meanwhile
            sym[i], sym[j] = a + b, ""
            count -= 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[k]))
            if (h := before[i]) >= 0 and (r := rank.get((sym[h], sym[i]))) is not None:
                heapq.heappush(heap, (r, h, sym[h], sym[i]))
        return count

    def text(self, text: str) -> int:
        if "<|" not in text:
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))

    def plain(self, text: str) -> int:
        """No special strings. Words between white space never share a token, so they count one by one."""
        text = text.lower() if text.isascii() else self.normalize(text)
        if SEPARATORS.search(text):  # str.split takes these as white space, the pattern does not
            return sum(map(self.merged, self.pieces(text)))
        return sum(map(self.__getitem__, text.split()))


SEPARATORS = re.compile("[\x1c-\x1f]")
_counters: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _counters:
        _counters[path] = WordCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. ``vocabulary``: path of a word-end BPE file."""

    def count(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        c = counter(path)
        for b in batches:
            n = [c.text(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return src.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
