"""Quality by a weak-label model.

Overlapping heuristic labellers vote good, bad or nothing on every document. Their accuracies
are estimated without any given label, by expectation-maximisation over the counts of all vote
patterns (at most 3 ** labellers of them, counted over all documents). The posterior of its
pattern labels each row of a bounded sample, on which a linear scorer over hashed word shapes
and binned text statistics is trained; it then scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows with posterior labels that the scorer is trained on: those whose doc_id hashes lowest; equal rows count once.
TRAIN_ROWS = 6_000
DIMS = 1 << 10
_SHAPE = bytes(ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256))


class Shapes(dict):
    """What counts of a word by its shape: symbols, capitals, bar, lone, letters, plain, slot. Forgotten beyond 100,000 shapes."""

    def __missing__(self, w: bytes) -> tuple[int, ...]:
        told = (
            len(w) > 2 and w[-1:] not in b"aA0" and w[-1] == w[-2] == w[-3],
            len(w) > 1 and b"a" not in w and b"A" in w,
            w == b"|",
            len(w) == 1 and w not in b"aA0",
            w.count(b"a") + w.count(b"A"),
            w.rstrip(b".,;:!?").strip(b"a") in (b"", b"A"),
            zlib.crc32(w[:1] + w[-3:]) % DIMS,
        )
        if len(self) > 100_000:
            self.clear()
        if len(w) <= 64:
            self[w] = told
        return told


def described(text: str, shapes: Shapes) -> tuple[dict[str, float], dict[int, float]]:
    """Statistics of a text, and its features: word shapes (first and last three characters, letters as a or A) by share, statistics by tenth."""
    raw, words = text.encode().translate(_SHAPE).split(), text.split()
    n = max(1, len(raw))
    symbols = capitals = bars = lone = letters = plain = size = 0
    slots: dict[int, int] = {}
    for w, k in Counter(raw).items():  # a few shapes make up most words
        is_symbols, is_capitals, is_bar, is_lone, own, is_plain, slot = shapes[w]
        symbols, capitals, bars, lone = symbols + k * is_symbols, capitals + k * is_capitals, bars + k * is_bar, lone + k * is_lone
        letters, plain, size = letters + k * own, plain + k * is_plain, size + k * len(w)
        slots[slot] = slots.get(slot, 0) + k
    stats = {
        "words": float(len(raw)),
        "symbols": symbols / n,
        "capitals": capitals / n,
        "bangs": text.count("!!") / n,
        "bars": bars / n,
        "lone": lone / n,
        "letters": letters / max(1, size),
        "fresh": len(set(words)) / n,
        "same": sum(map(eq, words, islice(words, 1, None))) / n,
        "plain": plain / n,
    }
    out = {slot: k / n for slot, k in slots.items()}
    for name, v in stats.items():
        bin_ = int(min(9, 10 * v)) if name != "words" else int(min(9, np.log2(v + 1)))
        slot = _slot(f"{name}={bin_}")
        out[slot] = out.get(slot, 0.0) + 0.5
    out[0] = out.get(0, 0.0) + 1.0
    return stats, out


#: name: (statistic, bad beyond, good on the other side of); a text of few words gets no vote where the statistic needs many
LABELLERS = {
    "symbols": ("symbols", lambda v, n: -1 if v > 0.08 else 1 if v == 0 else 0),
    "capitals": ("capitals", lambda v, n: -1 if v > 0.3 else 1 if v < 0.05 and n > 5 else 0),
    "bangs": ("bangs", lambda v, n: -1 if v > 0.1 else 0),
    "bars": ("bars", lambda v, n: -1 if v > 0.08 else 1 if v == 0 and n > 5 else 0),
    "lone": ("lone", lambda v, n: -1 if v > 0.08 else 1 if v == 0 and n > 5 else 0),
    "letters": ("letters", lambda v, n: 0 if n < 5 else -1 if v < 0.86 else 1 if v > 0.92 else 0),
    "repeats": ("fresh", lambda v, n: 0 if n < 20 else -1 if v < 0.35 else 1 if v > 0.48 else 0),
    "runs": ("same", lambda v, n: 0 if n < 10 else -1 if v > 0.3 else 1 if v < 0.1 else 0),
    "plain": ("plain", lambda v, n: 0 if n < 3 else -1 if v < 0.4 else 1 if v > 0.8 else 0),
}


#: Share of bad, no and good votes on bad and on good documents that is assumed with a tenth of the weight of all rows: complaints about good ones are rare mistakes.
PRIOR = np.array([[0.3, 0.0, 0.7], [0.003, 0.0, 0.997]])


def votes(stats: dict[str, float]) -> str:
    return "".join("-0+"[rule(stats[of], stats["words"]) + 1] for of, rule in LABELLERS.values())


def fit_labellers(counts: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Vote pattern -> probability that such a document is good."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([["-0+".index(c) for c in p] for p in patterns])
    good = np.array([0.05 if "-" in p else 0.95 if "+" in p else 0.5 for p in patterns])  # where the estimate starts
    for _ in range(rounds):
        prior = np.clip((n * good).sum() / n.sum(), 0.02, 0.98)
        log = np.tile(np.log([1 - prior, prior]), (len(patterns), 1))
        for k in range(seen.shape[1]):
            for c, weight in enumerate((n * (1 - good), n * good)):
                share = np.bincount(seen[:, k], weight, 3) + 0.1 * n.sum() * PRIOR[c]
                share[1] = share[0] + share[2]  # no vote says nothing
                log[:, c] += np.log(share / share[1])[seen[:, k]]
        good = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -40, 40)))
    return dict(zip(patterns, good.tolist(), strict=True))


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMS


def train(rows: list[dict[int, float]], target: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights of a logistic regression to soft targets, the rarer class weighted up."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, row in enumerate(rows):
        for k, v in row.items():
            x[i, k] = v
    share = np.clip(target.mean(), 0.02, 0.98) if len(rows) else 0.5
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    target, weight = target.astype(np.float32), (weight / max(1, len(rows))).astype(np.float32)
    w, speed = np.zeros(DIMS, np.float32), np.zeros(DIMS, np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = (weight * (p - target)) @ x + np.float32(1e-4) * w
        speed = np.float32(0.9) * speed + grad
        w -= speed
    return w.astype(float)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(described(t.as_py() or "", shapes)[0]) for t in batch.column("text")], pa.string())], ["votes"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        told, slots, values = [], [], []
        for t in batch.column("text"):
            stats, row = described(t.as_py() or "", shapes)
            told.append(votes(stats))
            slots.append(list(row))
            values.append(list(row.values()))
        yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("t"), pa.array(told, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))], ["h", "t", "votes", "slots", "values"])


def _score(weights: np.ndarray):  # noqa: ANN202
    w = weights.tolist()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            out, told = [], []
            for t in batch.column("text"):
                stats, row = described(t.as_py() or "", shapes)
                told.append(votes(stats))
                z = sum(w[k] * v for k, v in row.items())
                out.append(0.0 if not stats["words"] else 1 / (1 + float(np.exp(-max(-40.0, min(40.0, z))))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns)), pa.array(told, pa.string()), pa.array(out, pa.float64())], [*batch.schema.names, "votes", "score"])

    return score


def fitted(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, dict[str, float]]:
    """The scorer's weights, and the posterior of each vote pattern, of docs(doc_id, text).

    Patterns are counted over all rows. The scorer is trained on at most train_rows of them, whose
    shapes, not texts, come to the driver.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = {r.votes: r.n for r in texts.select("text").mapInArrow(_vote, "votes string").groupBy("votes").agg(F.count("*").alias("n")).collect()}
    keyed = texts.select(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), "text")
    few = keyed.select("h", "t").orderBy("h", "t").limit(train_rows).distinct()  # bounded by train_rows; texts stay in their tasks
    told_rows = keyed.join(F.broadcast(few), ["h", "t"]).mapInArrow(_features, "h bigint, t bigint, votes string, slots array<int>, values array<double>")
    sample = told_rows.dropDuplicates(["h", "t"]).orderBy("h", "t").collect() if counts else []  # at most train_rows short rows
    told = fit_labellers(counts) if counts else {}
    return train([dict(zip(r.slots, r["values"], strict=True)) for r in sample], np.array([told.get(r.votes, 0.5) for r in sample])), told


def scored(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """docs(doc_id, text) with votes (a sign for each labeller), score, the probability of good quality, and posterior.

    Null and empty texts score 0. Repeated rows and rows with a null doc_id are scored like
    others; equal texts score alike, and a text of any length is read whole; an empty table gives
    an empty table. Only doc_id and text come back.
    """
    weights, told = fitted(docs, train_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = texts.mapInArrow(_score(weights), texts.schema.simpleString()[7:-1] + ",votes:string,score:double")
    posterior = F.create_map(*(F.lit(x) for p in told.items() for x in p)) if told else None
    return out.withColumn("posterior", F.element_at(posterior, F.col("votes")) if told else F.lit(None).cast("double"))


def kept(docs: DataFrame, least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose own text scores at least `least`, with all their columns as they are."""
    weights, _ = fitted(docs, train_rows)
    names = [f"own_{k}" for k in range(len(docs.columns))]  # names of no one else
    rows = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")]).cast("string"))
    types = ",".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    out = rows.mapInArrow(_score(weights), f"{types}, text string, votes string, score double").filter(F.col("score") >= least)
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return told.select("doc_id", "score", "votes", F.round("posterior", 6).alias("posterior"), (F.col("score") >= 0.5).alias("kept"))
