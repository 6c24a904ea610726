"""Benchmark decontamination by SimHash of item-sized windows. DataFrame functions only.

1. Items and documents become sequences of shingle hashes (five lower-cased words; an item of
   fewer words is one shingle of its own size). A window can only be similar to an item if they
   share a shingle, so each shared shingle lines the document up with the item, and the
   item-sized window found there is kept, once for each distinct sequence of words.
2. A window and an item get a 128-bit SimHash of their shingles, each counted as often as it
   occurs. Fingerprints are cut into 8 blocks of 16 bits. Of two fingerprints that differ in at
   most 39 bits, some block differs in at most 4; the index holds every item block with up to 3
   bits flipped and is asked for every window block with up to 1 bit flipped, so it returns
   every pair within the radius. At a similarity of 0.75 the radius is four deviations off.
3. Candidates are verified by the exact weighted Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .store import light, rows_of, saved

SIZE = 5
BLOCKS, BLOCK_BITS = 8, 16
ITEM_FLIPS, WINDOW_FLIPS = 3, 1
RADIUS = BLOCKS * (ITEM_FLIPS + WINDOW_FLIPS) + BLOCKS - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once: the optimizer would copy it to each place, inside loops too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: str) -> Column:
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\n\x0b\x0c\r", "abcdefghijklmnopqrstuvwxyz     ")
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), " "), "")


def _shingles(words: str, size: int) -> Column:
    """Hashes of `size` consecutive words; none for shorter texts."""
    return _let(
        F.col(words),
        lambda w: F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(F.lit(size), *(F.get(w, i + k) for k in range(size))))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )


def _fingerprint(hashes: str) -> Column:
    """Two longs: bit k is set if most of the shingles have it set."""
    zero = F.lit(0).cast("bigint")

    def half(own: Column) -> Column:
        votes = lambda b: F.aggregate(own, F.lit(0), lambda n, h: n + F.call_function("bit_get", h, b).cast("int"))
        bit = lambda b: F.when(votes(b) * 2 > F.size(own), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(zero)
        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), zero, lambda out, b: out.bitwiseOR(bit(b)))

    salted = lambda h, salt: _let(F.transform(h, lambda x: F.xxhash64(x, F.lit(salt))), half)
    return _let(F.col(hashes), lambda h: F.array(salted(h, 1), salted(h, 2)))


def _probes(print_: str, flips: int) -> Column:
    """block * 65536 + value, for every value of each block with up to `flips` bits changed."""
    masks = [sum(1 << k for k in c) for n in range(flips + 1) for c in combinations(range(BLOCK_BITS), n)]
    per = 64 // BLOCK_BITS
    values = F.array(*(F.call_function("shiftrightunsigned", F.get(print_, F.lit(b // per)), F.lit(b % per * BLOCK_BITS)).bitwiseAND(F.lit(65535)) + F.lit(b << BLOCK_BITS) for b in range(BLOCKS)))
    flip = F.lit(masks) if len(masks) > 1 else F.array(F.lit(0))
    return F.flatten(F.transform(values, lambda v: F.transform(flip.cast("array<bigint>"), lambda m: v.bitwiseXOR(m))))


def _counted(hashes: str) -> Column:
    """Every shingle with its number among its equals, so that set sizes are those of multisets."""
    return _let(F.sort_array(F.col(hashes)), lambda held: F.transform(held, lambda h, i: F.xxhash64(h, i - F.array_position(held, h).cast("int"))))


def _starts() -> Column:
    """Every start of a window of `shingles` shingles with at least `wanted` of the ascending places `at` in it, inside the text.

    The first of `wanted` places in a row is not before the start, the last of them not past the window.
    """
    last = lambda j: F.get("at", j + F.col("wanted") - 1)
    spans = F.transform(
        F.sequence(F.lit(0), F.size("at") - F.col("wanted")),
        lambda j: _let(
            F.struct(F.greatest(F.lit(0), last(j) - F.col("shingles") + 1).alias("lo"), F.least(F.get("at", j), F.col("n") - F.col("length")).alias("hi")),
            lambda x: F.when(x["lo"] <= x["hi"], F.sequence(x["lo"], x["hi"])).otherwise(F.array().cast("array<int>")),
        ),
    )
    return F.array_distinct(F.flatten(spans))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.75) -> DataFrame:
    """doc_id, item_id, similarity, start: the documents that hold a window like a benchmark item.

    A window has as many words as the item, or all words of a shorter document. For each document
    and item the most similar window is returned, the first of equals; start counts words from 0.
    Null and empty texts, on either side, and rows with a null doc_id or item_id match nothing.
    Repeated rows count once. A text of any length is read whole. Other columns are ignored; empty
    tables give an empty table. doc_id and item_id may be of any type that can be joined on.
    """
    items = (
        benchmark.select(F.col("item_id").alias("item_id"), _words("text").alias("item_words")).dropna().filter(F.size("item_words") > 0)
        .distinct().withColumn("size", F.least(F.size("item_words"), F.lit(SIZE)))
    )
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most SIZE numbers
    grams = lambda frame, words: {s: frame.filter(F.col("size") == s).withColumn("hashes", _shingles(words, s)) for s in sizes}
    if not sizes:
        return docs.select("doc_id").filter("false").crossJoin(benchmark.select("item_id").filter("false")).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("start"))
    told = None
    for part in grams(items, "item_words").values():
        part = part.select("item_id", F.size("item_words").alias("length"), "size", "hashes")
        told = part if told is None else told.union(part)
    told = saved(told, "items")
    held = saved(told.select(F.explode("hashes").alias("hash"), F.col("length").alias("item_length"), "size").distinct(), "item_shingles")
    known = held.select("hash").distinct()

    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null").withColumn("text_key", F.xxhash64("text"))
    worded = texts.select("doc_id", "text_key", _words("text").alias("words"))
    hits = None
    for s in sizes:
        hashed = worded.select("doc_id", "text_key", F.size("words").alias("n"), _shingles("words", s).alias("hashes"))
        part = hashed.select("doc_id", "text_key", "n", F.posexplode("hashes").alias("pos", "hash")).join(light(known), "hash", "left_semi")
        hits = part if hits is None else hits.union(part)
    hits = saved(hits, "hits")
    at = hits.join(light(held), "hash").groupBy("doc_id", "text_key", "n", "size", "item_length").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    at = at.withColumn("length", F.least("item_length", "n")).withColumn("shingles", F.col("length") - F.col("size") + 1)
    wanted = F.greatest(F.lit(1), F.ceil((F.col("shingles") + F.col("item_length") - F.col("size") + 1) * least / (1 + least) - 1e-9).cast("int"))
    aligned = at.withColumn("wanted", wanted).filter(F.size("at") >= F.col("wanted")).select("doc_id", "text_key", "size", "item_length", "length", F.explode(_starts()).alias("start"))
    near = rows_of(texts, hits.select("doc_id"), "doc_id").dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", _words("text").alias("words"))
    cut = near.join(aligned, ["doc_id", "text_key"]).select("doc_id", "start", "size", "item_length", F.slice("words", F.col("start") + 1, F.col("length")).alias("window"))
    cut = saved(cut.withColumn("window_key", F.md5(F.array_join("window", " "))), "windows")
    marked = None
    for s in sizes:
        part = cut.filter(F.col("size") == s).groupBy("window_key", "item_length").agg(F.first("window").alias("window")).select("window_key", "item_length", F.lit(s).alias("size"), _shingles("window", s).alias("hashes"))
        marked = part if marked is None else marked.union(part)
    windows = saved(marked.withColumn("print", _fingerprint("hashes")), "window_prints")
    prints = saved(told.withColumn("print", _fingerprint("hashes")), "item_prints")

    index = prints.select("item_id", F.col("length").alias("item_length"), "size", F.col("print").alias("item_print"), F.explode(_probes("print", ITEM_FLIPS)).alias("probe"))
    asked = windows.select("window_key", "item_length", "size", "print", F.explode(_probes("print", WINDOW_FLIPS)).alias("probe"))
    apart = F.bit_count(F.get("print", F.lit(0)).bitwiseXOR(F.get("item_print", F.lit(0)))) + F.bit_count(F.get("print", F.lit(1)).bitwiseXOR(F.get("item_print", F.lit(1))))
    candidates = asked.join(index.hint("merge"), ["size", "item_length", "probe"])  # the index is large for its table: never broadcast
    candidates = candidates.filter(apart <= RADIUS).select("window_key", "size", "item_id", "item_length").distinct()
    both = F.size(F.array_intersect("own", "wanted"))
    similarity = both / (F.size("own") + F.size("wanted") - both)
    verified = (
        candidates.join(windows.select("window_key", "item_length", "size", _counted("hashes").alias("own")), ["window_key", "item_length", "size"])
        .join(prints.select("item_id", F.col("length").alias("item_length"), "size", _counted("hashes").alias("wanted")), ["item_id", "item_length", "size"])
        .select("window_key", "item_length", "size", "item_id", similarity.alias("similarity")).filter(F.col("similarity") >= least)
    )
    found = cut.join(verified, ["window_key", "item_length", "size"])
    best = F.max_by(F.struct("similarity", "start"), F.struct(F.col("similarity"), -F.col("start")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.similarity", "best.start")


def op1_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
