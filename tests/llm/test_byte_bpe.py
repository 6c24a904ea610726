from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

from gritstone.llm import byte_bpe
from gritstone.llm.byte_bpe import Cuts, encode, packed, read_ranks, stretches, unpacked

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", "a", " a", "a  b", "a   b \n", "\n\n x", "it's we'll  I'm", "tab\t x \t y", "日本語 の テキスト 😀😀", "x" * 300, "<|endoftext|> é ü  z", "1234 56,7..!! \r\n q", "end ", " \n ", "  a", "a  b  c", "\x1c x", "a\x85 b", "Āb Ā ĀĀ", "Ā"]


def test_same_as_tiktoken(spark, sf):
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 5, "y") for i, t in docs], "doc_id bigint, text string, ids int, kind string").repartition(3)
    got = {r.doc_id: r for r in encode(df, RANKS, P.PATTERN, full=True).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        want = own.encode_ordinary(text or "")
        r = got[i]
        assert (r.n_tokens, r.ids, bytes(r.decoded)) == (len(want), want, (text or "").encode()), text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_stretches_never_cut_a_match():
    import regex

    for text in ODD:
        parts = stretches(text or "")
        assert " ".join(parts) == (text or "")
        assert [w for k, s in enumerate(parts) for w in regex.findall(P.PATTERN, " " * (k > 0) + s)] == regex.findall(P.PATTERN, text or "")


def test_long_words_are_cut_where_no_token_lies_across(spark):
    import random

    ranks, rnd = read_ranks(RANKS), random.Random(2)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = ["".join(rnd.choice("qxzjkvwQZX日本語的ßé") for _ in range(3000)), "x" * 700, "".join(chr(rnd.randrange(0x4E00, 0x9FA5)) for _ in range(20_000))]
    for w in words:
        parts = Cuts(ranks)(w.encode())
        assert b"".join(parts) == w.encode() and [i for p in parts for i in own._core_bpe.encode_single_piece(p)] == own.encode_ordinary(w)
    got = {r.doc_id: r.ids for r in encode(spark.createDataFrame(list(enumerate(words)), "doc_id int, text string"), RANKS, P.PATTERN, full=True).collect()}
    assert all(got[k] == own.encode_ordinary(w) for k, w in enumerate(words))


def test_numbers_survive_packing():
    rnd = np.random.default_rng(1)
    for top in (1, 191, 192, 193, 12_479, 12_480, 12_481, 1_061_055, 1_061_056, 1 << 31):
        x = np.append(rnd.integers(0, top + 1, 500), [top, 0, 191, 192 % (top + 1)])
        assert np.array_equal(unpacked(packed(x)), x)
    assert len(unpacked(packed(np.zeros(0, np.int64)))) == 0


def test_repeated_null_and_no_rows(spark):
    schema = "doc_id bigint, text string"
    assert encode(spark.createDataFrame([], schema), RANKS, P.PATTERN).collect() == []
    rows = encode(spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], schema), RANKS, P.PATTERN).collect()
    assert len(rows) == 3 and len({r.ids_sha256 for r in rows}) == 1


def test_any_part_of_the_result(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "a  bc a")], "doc_id bigint, text string")
    got = encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, full=True)
    whole = {r.doc_id: r for r in got.collect()}
    for c in got.columns:
        assert sorted((str(r[0]) for r in got.select(c).collect())) == sorted(str(r[c]) for r in whole.values())
    assert got.count() == 3
    assert got.agg({"n_tokens": "sum"}).first()[0] == sum(r.n_tokens for r in whole.values())


def test_cells_hold_every_pair_and_no_other():
    rnd = random.Random(2)
    ranks = {bytes([k]): k for k in range(256)}
    for _ in range(400):
        a, b = rnd.choices(list(ranks), k=2)
        ranks.setdefault(a + b, len(ranks))
    shift, owner, joined = byte_bpe.pair_cells(ranks)
    names = {r: t for t, r in ranks.items()}
    for a in range(len(ranks)):
        for b in range(len(ranks)):
            at = shift[a] + b
            assert (joined[at] if 0 <= at < len(owner) and owner[at] == a else None) == ranks.get(names[a] + names[b])
    assert byte_bpe.merged(b"ab", {b"a": 0, b"b": 1}) == [b"a", b"b"] and byte_bpe.merged(b"abc", {b"a": 0, b"b": 1, b"c": 2, b"bc": 3, b"abc": 4}) == [b"abc"]


def test_a_token_that_merging_does_not_reach_is_found_whole(spark):
    ranks = {bytes([k]): k for k in range(256)} | {b"abc": 256, b"bd": 257}
    words = spark.createDataFrame([("abc",), ("abcd",), ("abd",), ("b",), ("\u00ff\u0000",)], "word string")
    got = [r[0] for r in words.select(byte_bpe._let(byte_bpe.tables(ranks), lambda t: byte_bpe.fold(F.col("word"), t))).collect()]
    assert got == [[256], [97, 98, 99, 100], [97, 257], [98], [255, 0]]
