"""Near-duplicate documents by b-bit MinHash.

1. Every text becomes its set of distinct five-word shingles. Documents with equal sets form
   one class, named by the MD5 of the set, so a group of copies is one row from here on.
2. Of 512 minima of each set, 190 make 38 bands of 5; the low 4 bits of each scrambled minimum
   make a packed signature. At a similarity of 0.75 a pair misses every band once in 30,000 times.
3. Classes that share a band are candidates. Each band has a pivot, the class with the most
   company over all its bands, as an original has among its edited copies. Each class is first
   held against the pivot most alike, then against its other pivots that it isn't linked with yet.
4. What is then still apart in a band of three or more is compared across its components. Exact
   bounds come first: with D the symmetric difference to the band's pivot and q the number of
   shingles that no other class at stake has, two classes x and y differ in at least
   |Dx| + |Dy| - 2 min(|Dx| - qx, |Dy| - qy) shingles, which at the least similarity is at most
   (|x| + |y|) / 7. Edited copies that are too far from their original mostly end there.
5. The similarity estimate of a pair comes from bit counts of the signatures, corrected for
   chance equality of 4 bits; below 0.67, four deviations from 0.75, a pair is dropped.
6. The others are confirmed on the full sets; components of confirmed links are the groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import words as W
from .graph import components, extended
from .store import light, rows_of, saved

BANDS, ROWS, BITS = 38, 5, 4
BANDED = BANDS * ROWS
#: Minima in a signature; the first BANDED of them make the bands.
MINIMA = 512
LONGS = -(-MINIMA // 64)
#: Estimated similarity under which a candidate isn't held against full sets.
LEAST_ESTIMATE = 0.67
#: Sets whose minima are worked out together, so that a task holds little.
TOGETHER = 256
_SCHEMA = "doc_id bigint, text_key string, n_shingles bigint, set_key binary, bands array<bigint>, signature array<bigint>"


def _factors() -> np.ndarray:
    return W.mix(np.arange(1, MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, n, data, offsets in W.slices(batch.column("text")):
        h, _, _, rows = W.words(data, offsets, lower=True)
        yield lo, n, *W.distinct(*W.shingles(h, rows))


def signatures(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (rows x BANDS) and packed signatures (rows x BITS * LONGS) of non-empty sets."""
    n = len(rows) - 1
    minima, held = np.empty((n, MINIMA), np.uint64), np.empty_like(values)
    for k, factor in enumerate(_factors()):
        np.multiply(values, factor, out=held)
        minima[:, k] = np.minimum.reduceat(held, rows[:-1])
    keys = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        keys = W.mix(keys + minima[:, r:BANDED:ROWS] + np.uint64(r + 1))
    keys = W.mix(keys + np.arange(BANDS, dtype=np.uint64))
    low = W.mix(minima)
    planes = np.zeros((n, BITS, LONGS * 64), np.uint8)
    for b in range(BITS):
        planes[:, b, :MINIMA] = (low >> np.uint64(b)) & np.uint64(1)
    packed = np.packbits(planes, axis=2, bitorder="little").reshape(n, -1).view(np.int64)
    return keys.view(np.int64), packed


def _lists(flat: np.ndarray, width: int, full: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(full) + 1, np.int32)
    np.cumsum(full * width, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.reshape(-1)))


def _set_keys(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.array([hashlib.md5(values[a:b]).digest() if b > a else None for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary())


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n, values, rows in _sets(batch):
            for k in range(0, n, TOGETHER):
                own = rows[k : k + TOGETHER + 1]
                part, own = values[own[0] : own[-1]], own - own[0]
                count = np.diff(own)
                full = count > 0
                bands, packed = signatures(part, np.append(own[:-1][full], own[-1])) if full.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo + k, len(count)) for c in ("doc_id", "text_key")), pa.array(count), _set_keys(part, own), _lists(bands, BANDS, full), _lists(packed, BITS * LONGS, full)],
                    ["doc_id", "text_key", "n_shingles", "set_key", "bands", "signature"],
                )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, values, rows in _sets(batch):
            yield pa.RecordBatch.from_arrays([_set_keys(values, rows), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(values.view(np.int64)))], ["set_key", "shingles"])


def estimate(a: str, b: str) -> Column:
    """Similarity of two packed signatures: the share of equal minima, less what 4 bits have in common by chance."""
    unlike = reduce(
        lambda x, y: x + y,
        (F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), (F.get(a, F.lit(p * LONGS + w)).bitwiseXOR(F.get(b, F.lit(p * LONGS + w))) for p in range(BITS)))) for w in range(LONGS)),
    )
    chance = 2.0**-BITS
    return ((1 - unlike / F.lit(MINIMA)) - chance) / (1 - chance)


def _shared(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def near_duplicates(docs: DataFrame, least: int = 75, keyed: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and, if keyed, text_key (MD5 of the text) and set_key (of its shingles) for each row of docs(doc_id, text).

    Null and empty texts have no shingles and stay alone. A null doc_id stays alone too, with a
    null component_id, and is kept. Repeated rows of a doc_id each get a row; with different
    texts, each row follows its own text. A text of any length is read whole, by its own slice.
    Columns besides doc_id and text are ignored; an empty table gives an empty table. Shingles
    are compared by 64-bit hashes. `least` below 75 would need a lower LEAST_ESTIMATE and more bands.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = saved(texts.withColumn("text_key", F.md5("text") if keyed else F.lit(None).cast("string")).mapInArrow(_describe, _SCHEMA), "shingled")
    named = told.filter("doc_id is not null and n_shingles > 0")
    first = lambda c: F.first(c).alias(c)  # noqa: E731  equal sets have equal bands and signatures
    reps = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), first("bands"), first("signature")), "classes")

    banded = reps.select("set_key", F.explode("bands").alias("band"))
    full = saved(banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "bands")
    weight = F.sum("members").over(Window.partitionBy("set_key")).alias("weight")  # at most BANDS rows a key
    shared = saved(banded.join(light(full), "band").select("band", "set_key", "members", weight), "shared")
    pivots = saved(shared.groupBy("band").agg(F.max(F.struct("weight", "set_key")).alias("p")).select("band", F.col("p.set_key").alias("pivot")), "pivots")
    stars = shared.join(light(pivots), "band").filter("set_key <> pivot").select(F.col("set_key").alias("a"), F.col("pivot").alias("b")).distinct()
    marks = reps.select("set_key", "signature")
    guessed = saved(
        stars.join(marks.toDF("a", "mark_a"), "a").join(marks.toDF("b", "mark_b"), "b")
        .withColumn("guess", estimate("mark_a", "mark_b")).filter(F.col("guess") >= LEAST_ESTIMATE).select("a", "b", "guess"),
        "guessed",
    )

    def sets_of(keys: DataFrame) -> DataFrame:
        """set_key, shingles of the classes in keys(set_key), from one text of each."""
        own = rows_of(reps.select("set_key", "rep"), keys, "set_key")
        return saved(rows_of(texts, own.select("rep"), "doc_id").mapInArrow(_full_sets, "set_key binary, shingles array<bigint>").dropDuplicates(["set_key"]), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """100 * intersection size >= least * union size, on full sets."""
        both = _shared("set_a", "set_b")
        held = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return saved(held.filter(100 * both >= least * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), "links")

    keys = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("set_key"))
    sets = sets_of(saved(keys(guessed).distinct(), "keys"))
    best = guessed.groupBy("a").agg(F.max(F.struct("guess", "b")).alias("top")).select("a", F.col("top.b").alias("b"))
    groups = components(confirmed(best, sets))

    def placed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(light(groups.toDF(key, "held_" + name)), key, "left").withColumn(name, F.coalesce("held_" + name, key))

    apart = placed(placed(guessed, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b")
    groups = extended(groups, confirmed(apart, sets))

    # across the components of a band: bounds, estimates, then full sets
    labelled = placed(shared.filter("members > 2"), "set_key", "component")
    split = saved(labelled.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band"), "split")
    rest = saved(labelled.join(light(split), "band").join(light(pivots), "band").select("band", "set_key", "component", "pivot"), "rest")
    if not rest.isEmpty():
        sets = sets_of(saved(rest.select("set_key").distinct(), "keys"))
        lone = sets.select("set_key", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("set_key").alias("set_key")).filter("n = 1")
        unique = saved(sets.select("set_key", F.size("shingles").alias("size")).join(lone.groupBy("set_key").agg(F.count("*").alias("q")), "set_key", "left").select("set_key", "size", F.coalesce("q", F.lit(0)).alias("q")), "unique")
        differing = rest.filter("set_key <> pivot").select(F.col("set_key").alias("a"), F.col("pivot").alias("b")).distinct()
        differing = differing.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select(F.col("a").alias("set_key"), F.col("b").alias("pivot"), (F.size("set_a") + F.size("set_b") - 2 * _shared("set_a", "set_b")).alias("d"))
        # d(x) + d(y) - 2 min(d(x) - q(x), d(y) - q(y)) <= t (|x| + |y|), times the denominator of t, as near(x) + wide(y) >= 0 and the reverse
        num, den = 100 - least, 100 + least
        measured = rest.join(differing, ["set_key", "pivot"], "left").join(light(unique), "set_key").withColumn("d", F.coalesce("d", F.lit(0))).withColumn("q", F.when(F.col("set_key") == F.col("pivot"), 0).otherwise(F.col("q")))
        measured = saved(measured.select("band", "set_key", "component", (num * F.col("size") - den * F.col("d")).alias("near"), (num * F.col("size") + den * (F.col("d") - 2 * F.col("q"))).alias("wide")), "measured")
        most = measured.groupBy("band").agg(F.max("near").alias("most_near"), F.max("wide").alias("most_wide"))
        alive = measured.join(light(saved(most, "bounds")), "band").filter("near + most_wide >= 0 and wide + most_near >= 0").join(marks, "set_key").select("band", "set_key", "component", "near", "wide", "signature")
        alive = saved(alive, "alive")
        x, y = alive.toDF("band", "a", "ca", "na", "wa", "mark_a"), alive.toDF("band_y", "b", "cb", "nb", "wb", "mark_b")
        across = x.join(y, F.expr("band = band_y and ca < cb and na + wb >= 0 and nb + wa >= 0") & (estimate("mark_a", "mark_b") >= LEAST_ESTIMATE)).select("a", "b").distinct()
        groups = extended(groups, confirmed(across, sets))

    # classes are named by hashes: the smallest doc_id speaks for a component
    grouped = groups.toDF("set_key", "component")
    least_of = saved(grouped.join(reps.select("set_key", "rep"), "set_key").groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    by_set = reps.select("set_key", "rep").join(light(saved(grouped.join(light(least_of), "component").select("set_key", "component_id"), "groups")), "set_key", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = told.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(by_set, "set_key", "left")
    return out.select(
        *(["text_key", "set_key"] if keyed else []),
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def op2_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
