from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gritstone.llm import id_files, media

SCHEMA = "html string, doc_id bigint, text string, digest int"
ODD = [None, "", "one", "é" * 300, "x" * 576, "tab\t x  y\n\n z", "<|endoftext|> a   b", "a  <|endoftext|> b  ", "😀 日本 & <b>"]


def test_images_hold_whole_texts(spark):
    rows = [("h", i, t, 1) for i, t in enumerate(ODD)] + [("h", None, "one", 1), ("h", 2, "one", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = media.resolve(media.sequences(docs.mapInArrow(media._compose, "id bigint, html string")), media.described(media.stored_media(docs))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = (rows[r.id][2] if r.id is not None else "one") or ""
        raw = raw.encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        stored = media.to_image(raw)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and r.feature.startswith("24x")


def test_sequences_keep_order_and_captions():
    page = '<p>a &amp; b<img src="sha256:ab" alt="x">c</p><figure><img src="sha256:cd"><figcaption>two  words</figcaption></figure><img src="http://x/y.png"><script>no</script>tail'
    got = [(x["pos"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.sequence_of(page)]
    assert got == [(0, "text", "a & b", None), (1, "media", "ab", "x"), (2, "text", "c", None), (3, "media", "cd", "two words"), (4, "media", None, None), (5, "text", "tail", None)]
    assert media.sequence_of(None) == media.sequence_of("") == []


def test_captions_stay_with_their_figure():
    page = '<figure><figcaption>cap one</figcaption><img src="sha256:aa"></figure><figure><img src="sha256:bb"><img src="sha256:cc"><figcaption>cap <b>two</b></figcaption></figure><figure><figcaption>alone</figcaption></figure><img src="sha256:dd" alt="x"><figure><img src="sha256:ee"><figcaption>open'
    got = [(x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.sequence_of(page)]
    assert got == [("media", "aa", "cap one"), ("media", "bb", "cap two"), ("media", "cc", None), ("text", "alone", None), ("media", "dd", "x"), ("media", "ee", "open")]


def test_no_media_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert media.described(media.stored_media(docs)).collect() == []


def test_coder_round_trip_and_damage():
    rnd = random.Random(1)
    some = [rnd.randrange(50_257) for _ in range(60)]
    for ids in ([], [7], [0] * 5000, [rnd.choice(some) for _ in range(9000)], [rnd.randrange(65_536) for _ in range(4096)], [1, 2, 3] * 3000):
        ids = np.array(ids, np.int64)
        data = id_files.encode_ids(ids)
        assert np.array_equal(id_files.decode_ids(data), ids)
    assert len(data) < 1000  # predictable ids take little
    bad = bytearray(data)
    bad[-9] ^= 255
    bad[60] ^= 255
    with pytest.raises(ValueError):
        id_files.decode_ids(bytes(bad))


def test_files_are_smaller_than_deflate(sf):
    import duckdb

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet' where text is not null").fetchall()]
    ids = np.array([i for e in own.encode_batch(texts, add_special_tokens=False) for i in [*e.ids, 0]], np.int64)
    data = id_files.encode_ids(ids)
    assert np.array_equal(id_files.decode_ids(data), ids)
    assert len(data) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_files_hold_what_the_tokenizer_gives(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)]
    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = spark.createDataFrame([("h", i, t, 1) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in id_files.read_ids(id_files.write_ids(df, P.path("byte_bpe_50k.json"))).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
        start += len(ids)


def test_id_files_of_odd_tables(spark):
    path = P.path("byte_bpe_50k.json")
    assert id_files.read_ids(id_files.write_ids(spark.createDataFrame([], SCHEMA), path)).collect() == []
    got = id_files.read_ids(id_files.write_ids(spark.createDataFrame([("h", 5, "a", 1), ("h", 5, "a", 1), ("h", None, None, 1)], SCHEMA), path)).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in got), key=str) == [(5, 1, 2), (5, 3, 2), (None, 0, 1)]
