"""Byte-level BPE by folds of Spark's higher-order functions over the bytes of distinct words.

A word is one match of the pre-tokenizing pattern. Documents are read once into blocks of bounded
size: a block numbers its distinct words and holds its documents as sequences of these numbers.
The words of all blocks meet by a hash of their bytes, each distinct word of the corpus is
encoded and decoded once, and the answers go back to the blocks that asked. A fold merges, step by
step, the leftmost of the adjacent pieces whose union has the least rank. Pieces are ids; what two of
them make is looked up in literal arrays of numbers, in which the pairs of each left piece lie
shifted into each other's gaps; decoding looks up the piece of each id in a literal array and
concatenates the pieces.

Blocks are kept as a table bucketed by block, so only words and answers are shuffled, never the
documents; of decoded words, only those that differ from the word asked for travel. Word hashes are even, blocks are bounded: no key is hot.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import shared_dir

#: Distinct stretches, distinct words and bytes of text after which a block of documents ends, and documents of one of its rows.
STRETCHES, WORDS, BLOCK_BYTES, DOCS = 350_000, 300_000, 48 << 20, 500
#: Hash buckets of words; a block sends one row to each that it has words of.
BUCKETS = 4096
#: A word of more bytes is cut where no token can lie across, so that folds stay short.
LONG = 64
NONE = 1 << 30
#: Between words, and between their ids: bytes are the characters up to U+00FF.
_SEP = "\u0100"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merged(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The pieces that merging by rank leaves of a token's bytes."""
    parts = [token[k : k + 1] for k in range(len(token))]
    while len(parts) > 1:
        least, k = min((ranks.get(a + b, NONE), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if least == NONE:
            break
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts


def pair_cells(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shift, owner, joined: pieces a and b make the piece joined[shift[a] + b] if owner[shift[a] + b] is a, else none; a place out of range is none as well."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                rows.setdefault(a, []).append((b, rank))
    most, total = max(ranks.values()) + 1, sum(map(len, rows.values()))
    size = 3 * total + 2 * most
    shift, owner, joined = np.full(most, -NONE), np.full(size, -1), np.zeros(size, np.int64)
    draw = np.random.default_rng(0)
    for a, row in sorted(rows.items(), key=lambda x: -len(x[1])):  # the long ones first, where there is room
        b, made = np.array(row).T
        for n in count(1):
            if n % 2_000 == 0:  # no room; as much again
                owner, joined = np.append(owner, np.full(size, -1)), np.append(joined, np.zeros(size, np.int64))
                size = len(owner)
            tried = draw.integers(-int(b.min()), size - int(b.max()), 64)
            free = np.flatnonzero((owner[tried[:, None] + b] < 0).all(1))
            if len(free):
                break
        shift[a] = tried[free[0]]
        owner[shift[a] + b], joined[shift[a] + b] = a, made
    return shift, owner, joined


def _numbers(values: np.ndarray | list) -> Column:
    return F.from_json(F.lit(json.dumps([int(x) for x in values], separators=(",", ":"))), "array<int>")


def tables(ranks: dict[bytes, int]) -> Column:
    """The ranks as literals: ids of the bytes, the cells of pair_cells, and the tokens that merging doesn't reach."""
    shift, owner, joined = pair_cells(ranks)
    alone = {t.decode("latin-1"): r for t, r in ranks.items() if len(merged(t, ranks)) > 1}
    return F.struct(
        _numbers([ranks[bytes([k])] for k in range(256)]).alias("bytes"), _numbers(shift).alias("shift"), _numbers(owner).alias("owner"), _numbers(joined).alias("joined"),
        (F.from_json(F.lit(json.dumps(alone)), "map<string,int>") if alone else F.lit(None).cast("map<string,int>")).alias("alone"),
    )


def piece_array(ranks: dict[bytes, int]) -> Column:
    """The piece of each id as a literal array<string>, a character for a byte; ids must be below 2 ** 20."""
    held = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        held[rank] = token.decode("latin-1")
    return F.from_json(F.lit(json.dumps(held)), "array<string>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(word: Column, table: Column) -> Column:
    """The ids of one word (a string of one character a byte), merged by rank; an id is its piece's rank."""
    at = lambda a, i: F.get(a, i)
    bytes_, shift, owner, joined = (table[c] for c in ("bytes", "shift", "owner", "joined"))

    def rank(left: Column, right: Column) -> Column:
        place = at(shift, left) + right
        return F.when(at(owner, place) == left, at(joined, place)).otherwise(F.lit(NONE))

    def merge(state: Column) -> Column:
        """Join the two pieces at the least rank and look up the pairs on either side anew."""
        ids, ranks, least = state["ids"], state["ranks"], state["least"]

        def join(i: Column) -> Column:  # i: 0-based place of the left piece
            before = F.when(i > 0, F.array(rank(at(ids, i - 1), least))).otherwise(F.array().cast("array<int>"))
            after = F.when(i + 2 < F.size(ids), F.array(rank(least, at(ids, i + 2)))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(ids, 1, i), F.array(least), F.slice(ids, i + 3, F.size(ids))).alias("ids"),
                F.concat(F.slice(ranks, 1, F.greatest(i - 1, F.lit(0))), before, after, F.slice(ranks, i + 3, F.size(ranks) + 1)).alias("ranks"),
            )

        return F.when(least < NONE, _let((F.array_position(ranks, least) - 1).cast("int"), lambda i: whole_state(join(i)))).otherwise(state)

    def whole_state(new: Column) -> Column:
        """The least rank is found once for each merge and kept, so that steps after the last merge look at one number only."""
        return _let(new, lambda s: F.struct(s["ids"].alias("ids"), s["ranks"].alias("ranks"), F.coalesce(F.array_min(s["ranks"]), F.lit(NONE)).alias("least")))

    def pieces(ids: Column) -> Column:
        n = F.size(ids)
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: rank(at(ids, i), at(ids, i + 1)))).otherwise(F.array().cast("array<int>"))
        start = whole_state(F.struct(ids.alias("ids"), pairs.alias("ranks")))
        steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        return F.aggregate(steps, start, lambda state, _: merge(state))["ids"]

    ids = _let(F.transform(F.split(word, ""), lambda c: at(bytes_, F.ascii(c))), pieces)
    return F.when(table["alone"].isNull(), ids).otherwise(_let(F.try_element_at(table["alone"], word), lambda whole: F.when(whole.isNull(), ids).otherwise(F.array(whole))))


class Cuts:
    """Where a long word can be cut: between two bytes that no token has side by side in the setting they stand in."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.pairs = {t for t in ranks if len(t) == 2}
        self.triples = {t[k : k + 3] for t in ranks for k in range(len(t) - 2)}

    def __call__(self, word: bytes) -> list[bytes]:
        """The word in parts. A piece of two bytes across a cut would be a token, a longer one would have a triple across it."""
        if len(word) <= LONG:
            return [word]
        out, lo = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs and word[i - 1 : i + 2] not in self.triples and (i < 2 or word[i - 2 : i + 1] not in self.triples):
                out.append(word[lo:i])
                lo = i
        return [*out, word[lo:]]


_LOOSE = r" (?=\s|$)"


def stretches(text: str, loose: Callable | None = None) -> list[str]:
    """The text cut before each space that a non-space follows: the pattern never matches across such a cut. All but the first begin with a space, which is left out."""
    if loose is None:
        import regex

        loose = regex.compile(_LOOSE).search
    parts = text.split(" ")
    if not loose(text):
        return parts
    import regex

    space = regex.compile(r"\s").match
    out = [parts[0]]
    for part in parts[1:]:
        if not part or space(part):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in one byte below 192, two below 12,480, three below 1,061,056 (all in four if any is beyond), first, second and third bytes apart, compressed."""
    if len(numbers) and numbers.max() >= 12_480 + (16 << 16):
        return b"4" + zlib.compress(numbers.astype("<u4").tobytes(), 1)
    x = numbers.astype(np.int64)
    more = x >= 192
    y = x[more] - 192
    three = y >= 48 << 8
    z = y[three] - (48 << 8)
    first, second = x.astype(np.uint8), (y & 255).astype(np.uint8)
    lead = 192 + (y >> 8)
    lead[three], second[three] = 240 + (z >> 16), z >> 8 & 255
    first[more] = lead
    return b"1" + struct.pack("<II", len(x), len(y)) + zlib.compress(first.tobytes() + second.tobytes() + (z & 255).astype(np.uint8).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"4":
        return np.frombuffer(zlib.decompress(data[1:]), "<u4").astype(np.int64)
    n, m = struct.unpack_from("<II", data, 1)
    raw = np.frombuffer(zlib.decompress(data[9:]), np.uint8)
    x = raw[:n].astype(np.int64)
    more = x >= 192
    lead, second = x[more] - 192, raw[n : n + m].astype(np.int64)
    y = lead << 8 | second
    three = lead >= 48
    y[three] = (48 << 8) + ((lead[three] - 48) << 16 | second[three] << 8 | raw[n + m :])
    x[more] = y + 192
    return x


_DOC_ROW = {"doc_ids": pa.list_(pa.int64()), "sizes": pa.list_(pa.int32()), "payload": pa.binary()}
_WORD_ROW = {"bucket": pa.int32(), "words": pa.string(), "steps": pa.list_(pa.int32())}
_ROW = pa.schema([("block", pa.int64()), *_WORD_ROW.items(), *_DOC_ROW.items()])


def _rows(block: int, **columns: list) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array([block] * n if f.name == "block" else columns.get(f.name, [None] * n), f.type) for f in _ROW], schema=_ROW)


def _index(pattern: str, ranks: dict[bytes, int]) -> Callable:
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents (doc_ids, sizes, payload) and rows of words (bucket, words, steps), block by block.

        A block's words are numbered from the most frequent on; steps are the differences of the
        numbers of a bucket's words, in ascending order.
        """
        import regex
        from pyspark import TaskContext

        find, loose, cuts = regex.compile(pattern).findall, regex.compile(_LOOSE).search, Cuts(ranks)
        numbers: dict[str | bytes, int] = {}  # words as text, parts of long ones as bytes
        known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})  # stretches at the start of a text, and after a space
        held: list[tuple[int | None, bytes]] = []
        block, size = TaskContext.get().partitionId() << 32, 0

        def whole(words: list[str]) -> list[str | bytes]:
            """Words, each long one in its parts."""
            return [x for w in words for x in ([w] if len(w) <= LONG // 4 or len(w.encode()) <= LONG else cuts(w.encode()))]

        def learn(at: int, parts: list[str]) -> None:
            own, number = known[at], numbers.setdefault
            for x in set(parts):
                if x not in own:
                    words = find(" " + x if at else x)
                    words = whole(words) if len(x) > LONG // 4 - 1 else words
                    own[x] = array("I", [number(w, len(numbers)) for w in words]).tobytes()

        def rows() -> Iterator[pa.RecordBatch]:
            words = [(w if isinstance(w, bytes) else w.encode()).decode("latin-1") for w in numbers]
            seen = np.frombuffer(b"".join([x for _, x in held]), "<u4")
            place = np.empty(len(words), np.int64)
            place[np.argsort(-np.bincount(seen, minlength=len(words)), kind="stable")] = np.arange(len(words))
            end = 0
            for lo in range(0, len(held), DOCS):
                sizes = [len(x) // 4 for _, x in held[lo : lo + DOCS]]
                yield _rows(block, doc_ids=[[d for d, _ in held[lo : lo + DOCS]]], sizes=[sizes], payload=[packed(place[seen[end : end + sum(sizes)]])])
                end += sum(sizes)
            if len(words):
                bucket = np.array([zlib.crc32(w.encode("latin-1")) % BUCKETS for w in words], np.int64)
                order = np.lexsort((place, bucket))
                parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)
                yield _rows(block, bucket=[int(bucket[x[0]]) for x in parts], words=[_SEP.join([words[k] for k in x.tolist()]) for x in parts], steps=[np.diff(place[x], prepend=0).tolist() for x in parts])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                first, *parts = stretches(text, loose)
                learn(0, [first])
                learn(1, parts)
                held.append((doc_id, known[0][first] + b"".join(map(known[1].__getitem__, parts))))
                size += len(text)
                if size > BLOCK_BYTES or len(numbers) > WORDS or len(known[0]) + len(known[1]) > STRETCHES:
                    yield from rows()
                    numbers, known, held, block, size = {}, ({}, {}), [], block + 1, 0
        if held:
            yield from rows()

    return index


def _join(full: bool) -> Callable:
    def join(held: pa.Table, told: pa.Table) -> pa.Table:
        """Documents of a block from the answers to its words."""
        answers = {x["bucket"]: (x["ids"], x["others"]) for x in told.column("told").to_pylist()}
        asked = [x for x in zip(*(held.column(c).to_pylist() for c in _WORD_ROW), strict=True) if x[1] is not None]
        n = sum(len(steps) for _, _, steps in asked)
        ids, pieces = [b""] * n, [b""] * n
        for bucket, words, steps in asked:
            coded, others = answers[bucket]
            own = words.split(_SEP)
            for x in others:  # where decoding doesn't give the word
                own[x["at"]] = x["piece"]
            for place, i, w in zip(np.cumsum(steps).tolist(), coded.split(_SEP), own, strict=True):
                ids[place], pieces[place] = i.encode() + b",", w.encode("latin-1")
        count = np.array([x.count(b",") for x in ids], np.int64)
        out: list[list] = [[], [], [], [], [], []]
        for doc_ids, sizes, payload in zip(*(held.column(c).to_pylist() for c in _DOC_ROW), strict=True):
            if doc_ids is None:
                continue
            numbers, end = unpacked(payload), 0
            for doc_id, size in zip(doc_ids, sizes, strict=True):
                own = numbers[end : end + size]
                end += size
                places = own.tolist()
                joined, decoded = b"".join(map(ids.__getitem__, places))[:-1], b"".join(map(pieces.__getitem__, places))
                out[0].append(doc_id)
                out[1].append(int(count[own].sum()))
                out[2].append(hashlib.sha256(joined).hexdigest())
                out[3].append(hashlib.sha256(decoded).hexdigest())
                if full:
                    out[4].append([int(x) for x in joined.split(b",") if x])
                    out[5].append(decoded)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        return pa.table({n: pa.array(x, t) for n, x, t in list(zip(names, out, types, strict=True))[: 6 if full else 4]})

    return join


def _blocks(df: DataFrame) -> DataFrame:
    """df written once to the shared folder as a table bucketed by block, so that what is joined by block needn't be shuffled."""
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, rank_path: str, pattern: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if full, ids and decoded of each row of docs(doc_id, text).

    Null texts are empty: no ids. Repeated rows and null doc_ids get a row each, an empty table
    none; other columns are ignored. Special tokens in a text are ordinary text. A text of any
    length is read whole and makes a block of its own where it must; a fold takes time with the
    square of a word's length, so words of over LONG bytes are first cut where no token can lie
    across (a run of one repeated letter can't be cut). The rank file is read on the driver; its
    ranks travel with the plan. It must hold all 256 single bytes.
    """
    ranks = read_ranks(rank_path)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = _blocks(texts.mapInArrow(_index(pattern, ranks), "block bigint, bucket int, words string, steps array<int>, doc_ids array<bigint>, sizes array<int>, payload binary"))
    asked = held.filter("words is not null").select("bucket", "block", "words").repartition("bucket")
    each = asked.select("bucket", "block", F.posexplode(F.split("words", _SEP)).alias("at", "word")).groupBy("bucket", "word").agg(F.collect_list(F.struct("block", "at")).alias("asked"))
    piece = lambda ids, pieces: F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")
    answer = _let(
        F.struct(tables(ranks).alias("ranks"), piece_array(ranks).alias("pieces")),
        lambda t: _let(fold(F.col("word"), t["ranks"]), lambda ids: F.struct(F.array_join(ids, ",").alias("ids"), F.nullif(piece(ids, t["pieces"]), F.col("word")).alias("piece"))),
    )
    told = each.select("bucket", "asked", answer.alias("answer")).select("bucket", F.explode("asked").alias("asked"), "answer")
    back = told.groupBy("bucket", F.col("asked.block").alias("block")).agg(F.sort_array(F.collect_list(F.struct("asked.at", "answer.ids", "answer.piece"))).alias("told"))
    others = F.transform(F.filter("told", lambda x: x["piece"].isNotNull()), lambda x: F.struct(x["at"].alias("at"), x["piece"].alias("piece")))  # what decoding gives where that isn't the word
    # one struct: of a cogroup's separate columns, the optimizer drops some when a caller takes only part of the result
    back = back.select("block", F.struct("bucket", F.array_join("told.ids", _SEP).alias("ids"), others.alias("others")).alias("told"))
    return held.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_join(full), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * full)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
