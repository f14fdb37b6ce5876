"""Operators 2 and 7 against the tokenizer library, brute force and an exact round trip."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from strandloom.llm import packing, word_bpe
from tokenizers import Tokenizer

TEXTS = [
    None, "", " ", "a", "Hello, world! it's 2024 and we'll see", "x<|endoftext|>y <|startoftext|>", "ΑΣΑΣ ΣΑΣ", "İstanbul İ", "été café",
    "tab\tnew\nline\r\n\n  two  spaces   end   ", "a\x1cb \x85c\xa0d e　f", "日本語の文章です。", "emoji 😀😀 x", "“quoted” – it’s", "don't DON'T o'clock 'tis", "x" * 3000,
    "\ucb12\ua7cb\u0160\u1edc", "\U00010d50 \ua7da\u1c89 x", "word " * 5000, "½ ² ٣٤ 12345 1.5", "á ́b", "Ünïcödé straße ǅ ŉ ﬁ", "\x00\x07 ctl", " leading", "trailing ", "a<|endoftext|", "<|endoftext|>",
]
SCHEMA = "doc_id long, text string, n_tokens string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], None), (None, "no id", None)]
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000", "text", "lang")
    return spark.createDataFrame(rows, SCHEMA).union(more)


def test_counts_equal_the_library(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    want = sorted((i, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)) for i, t in texts)
    got = word_bpe.token_counts(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_random_unicode_equals_the_library():
    lib, mine = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), word_bpe.counter(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(7)
    ranges = [(0, 0x80), (0x80, 0x250), (0x250, 0x2000), (0x2000, 0xD800), (0xA700, 0xA800), (0xE000, 0x110000)]
    for _ in range(5000):
        text = "".join(chr(rng.integers(*ranges[rng.integers(len(ranges))])) for _ in range(rng.integers(1, 12)))
        assert mine.text(text) == len(lib.encode(text, add_special_tokens=False).ids), ascii(text)


def test_packing_is_an_exact_round_trip(spark, docs):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows.collect()}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in packing.pack(rows, block=20_000).collect():
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(ids) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for d, got in pieces.items():
        at = 0
        for s, n in sorted(got):
            assert s == at and n > 0
            at += n
        assert at == len(want[d])
    for got in seqs.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_capacity_tree_finds_the_tightest():
    t = packing.CapacityTree(2048)
    for i, room in enumerate((5, 9, 2048, 9, 700)):
        t.add(room, i)
    assert t.take(6)[0] == 9 and t.take(6)[0] == 9 and t.take(6)[0] == 700 and t.take(701) == (2048, 2) and t.take(6) is None and t.take(1) == (5, 0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert word_bpe.token_counts(none).count() == 0 and packing.pack(none).count() == 0
