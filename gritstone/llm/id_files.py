"""Token ids in files of an adaptive context-mixing range coder.

A segment file holds whole documents in ascending doc_id order: an index of them and up to LANES
blocks of BLOCK ids. Every block starts from a reset model and has a CRC-32 of its ids, so it can
be decoded alone. Orders 2 and 1 predict an id from the last two ids and from the last one, each
with a confidence; order 0 keeps the block's ids in a list in which an id moves forward, to half
its place, whenever it is coded through it. What is range coded is how an id came: predicted by
order 2, by order 1, from the list at a place of so many bits, or new. The frequencies of these
outcomes adapt in two contexts, the confidence of either prediction, and the two are mixed by
adding them. Bits of a place, and new ids, follow evenly within the same code interval. All blocks
of a segment are coded side by side, one id of each at a time, with integers only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import stretches
from .store import saved

BLOCK, LANES = 4096, 2048
#: Cells of the predictions of orders 1 and 2 in a block.
ONE, TWO = 2048, 4096
#: Outcomes: predicted by order 2, by order 1, from the list at a place of 0 to 12 bits, new.
OUTCOMES, LISTED, NEW = 16, 2, 15
#: What an outcome adds to its frequency, and the sum from which frequencies are halved.
STEP, MOST = 32, 1 << 14
#: Stretches of text between spaces whose ids a Python worker remembers, over all its tasks; then it forgets the older half.
STRETCHES = 250_000
MAGIC = b"IDS2"
_EXTRA = np.array([0, 0, 0, 0, *range(1, 12), 16], np.int64)  # bits that follow an outcome
_FROM = np.array([0, 0, 0, *(1 << k for k in range(12)), 0], np.int64)  # least place of a listed outcome
_BITS = np.array([int(k).bit_length() for k in range(BLOCK + 1)], np.int64)
#: The code interval has 48 bits and gives off 16 at a time.
_TOP, _MASK = 1 << 32, (1 << 48) - 1


#: What an outcome adds to the running sums.
_MORE = np.triu(np.full((OUTCOMES, OUTCOMES), STEP, np.uint16))
_ROW = np.dtype(("V", 2 * OUTCOMES))


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """table[at], a row as one piece of memory."""
    return table.view(_ROW)[:, 0][at].view(np.uint16).reshape(-1, OUTCOMES)


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    table.view(_ROW)[:, 0][at] = rows.view(_ROW)[:, 0]


class _Model:
    """What `n` blocks side by side predict, and learn."""

    def __init__(self, n: int, nobody: int) -> None:
        self.lane = np.arange(n)
        self.cells = [np.zeros(n * size, np.int32) for size in (TWO, ONE)]  # id << 4 | confidence
        self.runs = [np.tile(np.arange(1, OUTCOMES + 1, dtype=np.uint16), (n * 16, 1)) for _ in range(2)]  # running sums of frequencies
        self.list = np.full(n * (BLOCK + 1), nobody, np.uint16)  # its last place is for ids that weren't coded through it
        self.listed = np.zeros(n, np.int64)
        self.last, self.before = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def predict(self, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the first m blocks: the ids that orders 2 and 1 predict, and the running sums of the mixed frequencies after a 0."""
        lane, last = self.lane[:m], self.last[:m]
        mixed = last * 40503
        self.at = [lane * TWO + ((mixed + self.before[:m] * 30011 >> 3) & TWO - 1), lane * ONE + ((mixed >> 4) & ONE - 1)]
        self.held = [self.cells[k][self.at[k]] for k in range(2)]
        self.row = [lane * 16 + (h & 15) for h in self.held]
        self.own = [_rows(self.runs[k], self.row[k]) for k in range(2)]
        sums = np.zeros((m, OUTCOMES + 1), np.uint16)
        np.add(*self.own, out=sums[:, 1:])
        return self.held[0] >> 4, self.held[1] >> 4, sums

    def move(self, m: int, outcome: np.ndarray, place: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Move names coded through the list forward, and put new ones at its end. Gives who was moved back, from where and to where."""
        base, fresh = self.lane[:m] * (BLOCK + 1), outcome == NEW
        place = np.where(outcome < LISTED, BLOCK, np.where(fresh, self.listed[:m], place))
        to = np.where(fresh | (outcome < LISTED), place, place >> 1)
        self.list[base + np.where(fresh, place, BLOCK)] = name
        other = self.list[base + to]
        self.list[base + place] = other
        self.list[base + to] = name
        self.listed[:m] += fresh
        return other, place, to

    def learn(self, m: int, ids: np.ndarray, outcome: np.ndarray) -> None:
        more = _rows(_MORE, outcome)
        for k in range(2):
            runs = self.own[k] + more
            full = np.flatnonzero(runs[:, -1] > MOST)
            if len(full):
                own = runs[full]
                own[:, 1:] -= own[:, :-1].copy()
                runs[full] = np.cumsum((own + 1) >> 1, axis=1)
            _put(self.runs[k], self.row[k], runs)
            held = self.held[k]
            sure = held & 15
            missed = np.where(sure <= 1, ids << 4 | 1, held - sure + (sure >> 1))
            self.cells[k][self.at[k]] = np.where(held >> 4 == ids, held + (sure < 15), missed)
        self.before[:m] = self.last[:m]
        self.last[:m] = ids


def _blocks(ids: np.ndarray) -> tuple[np.ndarray, int, int]:
    """ids as a table of a block to a row, its rows, and the length of the last."""
    n = -(-len(ids) // BLOCK)
    table = np.zeros(n * BLOCK, np.int32)
    table[: len(ids)] = ids
    return table.reshape(n, BLOCK), n, len(ids) - (n - 1) * BLOCK


def encode_ids(ids: np.ndarray) -> bytes:
    """A coded stream of ids under 65,536: for each block lengths and a checksum, then the blocks."""
    if not len(ids):
        return struct.pack("<I", 0)
    table, n, rest = _blocks(ids)
    names = np.stack([np.unique(row, return_inverse=True)[1].astype(np.int16) for row in table])
    steps = BLOCK if n > 1 else rest
    model, lane = _Model(n, BLOCK), np.arange(n)
    places = np.full(n * (BLOCK + 1), -1, np.int16)  # of a name in the list
    out, pos = np.zeros((n, steps * 2 + 8), np.uint16), np.zeros(n, np.int64)
    low, width = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
    for step in range(steps):
        m = n if step < rest else n - 1
        now, name, base = table[:m, step], names[:m, step].astype(np.int64), lane[:m] * (BLOCK + 1)
        two, one, sums = model.predict(m)
        place = places[base + name].astype(np.int64)
        outcome = np.where(two == now, 0, np.where(one == now, 1, np.where(place < 0, NEW, LISTED + _BITS[place])))
        flat, at, bits = sums.reshape(-1), lane[:m] * (OUTCOMES + 1) + outcome, _EXTRA[outcome]
        start = flat[at].astype(np.int64)
        own = flat[at + 1] - start
        r = width[:m] // sums[:, -1]
        more = np.where(outcome == NEW, now, place - _FROM[outcome]) * (bits > 0)
        width[:m] = own * r >> bits
        low[:m] += start * r + more * width[:m]
        while len(x := np.flatnonzero(((low[:m] ^ (low[:m] + width[:m])) < _TOP) | (width[:m] < _TOP))):
            a, b = low[x], width[x]
            out[x, pos[x]] = a >> 32
            pos[x] += 1
            low[x], width[x] = a << 16 & _MASK, np.where((a ^ (a + b)) < _TOP, b, -a & _TOP - 1) << 16
        other, came, to = model.move(m, outcome, place, np.where(outcome < LISTED, BLOCK, name).astype(np.uint16))
        places[base + other] = came
        through = np.flatnonzero(outcome >= LISTED)
        places[(base + name)[through]] = to[through]
        model.learn(m, now, outcome)
    for k in range(3):
        out[lane, pos] = low >> (32 - 16 * k) & 65535
        pos += 1
    heads = [struct.pack("<III", len(own), int(p), zlib.crc32(own.astype("<u4").tobytes())) for own, p in zip([*table[:-1], table[-1, :rest]], pos, strict=True)]
    return struct.pack("<I", n) + b"".join(heads) + b"".join([out[i, : pos[i]].astype("<u2").tobytes() for i in range(n)])


def decode_ids(data: bytes) -> np.ndarray:
    """What encode_ids was given; a damaged block raises ValueError."""
    (n,) = struct.unpack_from("<I", data)
    if not n:
        return np.zeros(0, np.int64)
    heads = np.frombuffer(data, "<u4", 3 * n, 4).reshape(n, 3).astype(np.int64)
    raw = np.concatenate([np.frombuffer(data, "<u2", int(heads[:, 1].sum()), 4 + 12 * n), np.zeros(8, "<u2")]).astype(np.int64)
    pos = np.cumsum(heads[:, 1]) - heads[:, 1]
    steps, rest = int(heads[0, 0]), int(heads[-1, 0])
    if steps > BLOCK or (heads[:-1, 0] != steps).any() or rest > steps:
        raise ValueError("lengths of blocks are damaged")
    model, table, lane, last = _Model(n, 0), np.zeros((n, steps), np.int32), np.arange(n), len(raw) - 1
    low, width = np.zeros(n, np.int64), np.full(n, 1 << 48, np.int64)
    code = raw[pos] << 32 | raw[pos + 1] << 16 | raw[pos + 2]
    pos = pos + 3
    for step in range(steps):
        m = n if step < rest else n - 1
        two, one, sums = model.predict(m)
        total = sums[:, -1].astype(np.int64)
        r = np.maximum(width[:m] // total, 1)  # never 0 but in damaged data
        ahead = code[:m] - low[:m]
        beyond = (sums[:, 1:] <= np.clip(ahead // r, 0, total - 1).astype(np.uint16)[:, None]).view(np.uint64)  # eight 0 or 1 to a number
        outcome = ((beyond[:, 0] + beyond[:, 1]) * np.uint64(0x0101010101010101) >> np.uint64(56)).astype(np.int64)
        flat, at, bits = sums.reshape(-1), lane[:m] * (OUTCOMES + 1) + outcome, _EXTRA[outcome]
        start = flat[at].astype(np.int64)
        own = flat[at + 1] - start
        start *= r
        width[:m] = own * r >> bits
        more = np.clip((ahead - start) // np.maximum(width[:m], 1), 0, (1 << bits) - 1) * (bits > 0)
        low[:m] += start + more * width[:m]
        place = np.where(outcome == NEW, 0, _FROM[outcome] + more)
        now = np.where(outcome == 0, two, np.where(outcome == 1, one, np.where(outcome == NEW, more, model.list[lane[:m] * (BLOCK + 1) + place])))
        while len(x := np.flatnonzero(((low[:m] ^ (low[:m] + width[:m])) < _TOP) | (width[:m] < _TOP))):
            a, b = low[x], width[x]
            low[x], width[x] = a << 16 & _MASK, np.where((a ^ (a + b)) < _TOP, b, -a & _TOP - 1) << 16
            code[x] = (code[x] << 16 & _MASK) | raw[np.minimum(pos[x], last)]
            pos[x] += 1
        table[:m, step] = now
        model.move(m, outcome, place, now.astype(np.uint16))
        model.learn(m, now, outcome)
    out = table.reshape(-1)[: (n - 1) * steps + rest]
    for i in range(n):
        if zlib.crc32(out[i * steps : i * steps + heads[i, 0]].astype("<u4").tobytes()) != heads[i, 2]:
            raise ValueError(f"block {i} is damaged")
    return out.astype(np.int64)


def segment(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    index = b"".join(struct.pack("<?qI", d is not None, d or 0, n) for d, n in zip(doc_ids, lengths, strict=True))
    return MAGIC + struct.pack("<I", len(doc_ids)) + index + encode_ids(ids)


def read_segment(data: bytes) -> tuple[list, list[int], np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not an id file")
    (n,) = struct.unpack_from("<I", data, 4)
    rows = [struct.unpack_from("<?qI", data, 8 + 13 * k) for k in range(n)]
    return [d if there else None for there, d, _ in rows], [x[2] for x in rows], decode_ids(data[8 + 13 * n :])


#: Ids of stretches by tokenizer, at the start of a text and after a space; kept by a Python worker from task to task.
KNOWN: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}


def _coded(tokenizer_path: str):  # noqa: ANN202
    """A function from a text to its ids as 16-bit numbers, as the tokenizer gives them without special tokens added.

    The tokenizer never joins what a cut before a space parts, so stretches are encoded once and
    remembered. A text that names one of the tokenizer's added tokens is encoded as it is.
    """
    import os
    from importlib import import_module

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path)
    added = regex.compile("|".join(regex.escape(t.content) for t in coder.get_added_tokens_decoder().values()) or "(?!)").search
    loose = regex.compile(r" (?=\s|$)").search
    known = import_module(__name__).KNOWN.setdefault(tokenizer_path, ({}, {}))
    packed = lambda e: np.array(e.ids, "<u2").tobytes()

    def learn(at: int, parts: list[str]) -> None:
        own = known[at]
        new = [x for x in set(parts) if x not in own]
        for lo in range(0, len(new), 5_000):
            part = new[lo : lo + 5_000]
            own.update(zip(part, map(packed, coder.encode_batch([" " * at + x for x in part], add_special_tokens=False)), strict=True))

    def coded(text: str) -> bytes:
        if added(text):
            return packed(coder.encode(text, add_special_tokens=False))
        first, *parts = stretches(text, loose)
        for own in known:
            if len(own) > STRETCHES:
                older = list(islice(own, len(own) // 2))
                for x in older:
                    del own[x]
        learn(0, [first])
        learn(1, parts)
        return known[0][first] + b"".join(map(known[1].__getitem__, parts))

    return coded


def _write(tokenizer_path: str, end_id: int):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coded = _coded(tokenizer_path)
        part, seq = TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u2").tobytes()
        total, doc_ids, lengths, held = 0, [], [], []

        def full() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u2")
            data = segment(doc_ids, lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.large_binary()).cast(pa.binary())], ["part", "seq", "n_ids", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                held.append(coded(text.as_py() or "") + end)
                doc_ids.append(doc_id.as_py())
                lengths.append(len(held[-1]) // 2)
                total += lengths[-1]
                if total >= BLOCK * LANES or len(lengths) >= 20_000:
                    yield full()
                    seq, total, doc_ids, lengths, held = seq + 1, 0, [], [], []
        if lengths:
            yield full()

    return write


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seq, data in zip(batch.column("part"), batch.column("seq"), batch.column("data"), strict=True):
            doc_ids, lengths, ids = read_segment(data.as_py())
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(lengths, ends.tolist(), strict=True)]
            k = len(doc_ids)
            columns = [pa.array([part.as_py()] * k, pa.int32()), pa.array([seq.as_py()] * k, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(ends - np.array(lengths), pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_id", "ahead", "n_tokens", "ids_crc32"])


def write_ids(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """part, seq, n_ids, data: the segment files of docs(doc_id, text) in the shared folder, in ascending doc_id order.

    Null texts are empty and have the end id alone. Null doc_ids come first; repeated doc_ids
    follow each other, each row with its own ids. A text of any length is encoded whole, into one
    segment that may outgrow LANES blocks. Ids must be under 65,536. The strings of the tokenizer's
    added tokens in a text become those tokens, as the library has it by default. Other columns
    are ignored; an empty table makes no file.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return saved(ordered.mapInArrow(_write(tokenizer_path, end_id), "part int, seq bigint, n_ids bigint, data binary"), "ids")


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files of write_ids, read back block by block."""
    spark = files.sparkSession
    own = files.select("part", "seq", "n_ids")
    parts = own.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each task that wrote
    ahead = np.concatenate([[0], np.cumsum([r.n for r in parts])]).tolist()
    bases = spark.createDataFrame([(r.part, a) for r, a in zip(parts, ahead, strict=False)], "part int, base bigint")
    in_part = own.withColumn("before", F.expr("sum(n_ids) over (partition by part order by seq) - n_ids")).join(F.broadcast(bases), "part").select("part", "seq", (F.col("before") + F.col("base")).alias("first"))
    told = files.select("part", "seq", "data").mapInArrow(_load, "part int, seq bigint, doc_id bigint, ahead bigint, n_tokens bigint, ids_crc32 bigint")
    return told.join(in_part, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("ahead")).alias("start"), "n_tokens", "ids_crc32")


def op9_context_mixing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return read_ids(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_50k.json")))
