"""Exact n-gram Jaccard join: size-banded tiles, bitmap bounds, then sorted-array intersection.

1. Every text becomes its set of distinct five-word shingles; documents with equal sets are one
   class from here on. A set's bitmap has one bit of parity for each of 64 * 2**k groups of
   shingles, at least as many as the set has; an unequal bit stands for at least one shingle of
   the symmetric difference, so bit counts bound the overlap from above.
2. How many classes hold a shingle is counted over all texts, in hash buckets. Shingles have one
   order for all sets: by falling rarity among the MOST_COMMON commonest, the others before them,
   ties by hash. Two sets with a similarity of at least j share one of the first |x| - ceil(j |x|) + 1
   of each. Any order is exact; this one keeps common passages out of all but the sets that hold little else.
3. Sizes are cut in bands, each at least 1/j times as far as the one before, so linked sets lie in one band or in
   neighbours. A tile is a shingle of those first ones and two neighbouring bands. Tiles are named by a
   hash of their members: copies that share dozens of shingles share one tile (should two
   names ever fall together, the tile holds both, which loses nothing).
4. Each tile has a pivot, the class with the most company. Classes are held against their pivots: bitmaps
   first, full sorted sets for those that remain. Links make components.
5. What is still apart in a tile is compared across its components, behind exact bounds: the difference
   from the pivot, less what the set alone holds, and bitmaps. Pairs within a component aren't looked at again, so a
   group of copies costs as many comparisons as it has members, not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import words as W
from .graph import components, extended
from .near_dups import _full_sets, _set_keys, _sets, _shared
from .store import light, rows_of, saved

#: Commonest shingles whose counts order them: 8 bytes each in every task. A bound on the order's detail, not on the result.
MOST_COMMON = 1 << 20
#: Classes that must hold a shingle for it to be one of them.
COMMON = 8
#: Shingles gathered in a task before they are sorted and sent, and shingles aimed at in a bucket.
GATHERED, BUCKET = 1 << 21, 1 << 20
_PACKED = "bucket int, keys binary, counts binary, classes binary, sizes binary"


def _bitmaps(values: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        width = 64 << max(0, math.ceil(math.log2(max(1, (b - a) / 64))))
        parity = np.bincount((values[a:b] >> np.uint64(20)).astype(np.int64) & (width - 1), minlength=width).astype(np.uint8) & 1
        yield np.packbits(parity, bitorder="little").view(np.int64) if b > a else None


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, n, values, rows in _sets(batch):
            marks = pa.array(_bitmaps(values, rows), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), pa.array(np.diff(rows)), _set_keys(values, rows), marks], ["doc_id", "n_shingles", "set_key", "bitmap"])


def unlike_bits(a: str, b: str) -> Column:
    """Unequal bits of two bitmaps; the longer one is folded to the length of the other."""

    def folded(x: Column, n: Column) -> Column:  # linked sets' bitmaps differ by one doubling at most; others fold once and get a weaker bound
        return F.when(F.size(x) > n, F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

    x, y = F.col(a), F.col(b)
    n = F.least(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(folded(x, n), folded(y, n), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)


def _cut(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32-bit key within it) of hashes; rising hashes have rising pairs."""
    return values >> np.uint64(64 - bits), (values >> np.uint64(32 - bits)).astype(np.uint32)


def _counted(bits: int):
    """Packed (key, count) of each bucket of a task's shingles."""

    def flush(gathered: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(gathered), return_counts=True)
        bucket, key = _cut(values, bits)
        at = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 40))), len(bucket))
        counts = np.minimum(counts, 65535).astype(np.uint16)
        spans = list(zip(at[:-1], at[1:], strict=True))
        none = pa.nulls(len(spans), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[at[:-1]].astype(np.int32)), pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()), none, none],
            ["bucket", "keys", "counts", "classes", "sizes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, held = [], 0
        for batch in batches:
            for _, _, values, _ in _sets(batch):
                gathered.append(values)
                held += len(values)
                if held >= GATHERED:
                    yield flush(gathered)
                    gathered, held = [], 0
        if held:
            yield flush(gathered)

    return run


def _common(table: pa.Table) -> pa.Table:
    """(key, n) of a bucket's shingles that at least COMMON classes hold."""
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table["counts"].to_pylist()]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys.astype(np.int64), prepend=-1))
    total = np.add.reduceat(counts[order], first)
    hit = total >= COMMON
    key = keys[first][hit].astype(np.int64) | table["bucket"][0].as_py() << 32
    return pa.table({"key": key, "n": total[hit]})


def commonest(counts: DataFrame) -> np.ndarray:
    """Keys of at most MOST_COMMON common shingles, rising, with the binary logarithm of the count in the low 6 bits. counts is a saved table."""
    power = F.floor(F.log2("n")).cast("bigint")
    by_power = {r.p: r.k for r in counts.groupBy(power.alias("p")).agg(F.count("*").alias("k")).collect()}  # at most 64 rows
    least, sum_ = 64, 0
    for p in sorted(by_power, reverse=True):
        sum_ += by_power[p]
        if sum_ > MOST_COMMON:
            break
        least = p
    told = counts.filter(power >= least).select(F.shiftleft("key", 6).bitwiseOR(power).alias("k")).toArrow()  # at most MOST_COMMON rows of 8 bytes
    return np.sort(np.asarray(told["k"].combine_chunks(), np.int64))


def _first(values: np.ndarray, rows: np.ndarray, bits: int, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, row) of the first shingles of each set in the common order."""
    size = np.diff(rows)
    row = np.repeat(np.arange(len(size)), size)
    power = np.zeros(len(values), np.int64)
    if len(common):
        key = (values >> np.uint64(32 - bits)).astype(np.int64)
        at = np.minimum(np.searchsorted(common, key << 6), len(common) - 1)
        found = common[at]
        power = np.where(found >> 6 == key, found & 63, 0)
    # values rise within a row, so a stable sort by (row, power) keeps ties by hash
    order = np.argsort(row << 6 | power, kind="stable")
    place = np.arange(len(values)) - np.repeat(rows[:-1], size)
    taken = order[place < np.repeat(size - (-(-least * size // 100)) + 1, size)]
    return values[taken], row[taken]


def _posted(bits: int, common, least: int):
    """Packed postings of each bucket: keys, owners as places in a list of classes with their sizes."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        shift = np.cumsum([0, *(len(h[2]) for h in held)])
        values, owner = np.concatenate([h[0] for h in held]), np.concatenate([h[1] + s for h, s in zip(held, shift, strict=False)])
        names, sizes = np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held]).astype(np.uint32)
        bucket, key = _cut(values, bits)
        order = np.argsort(bucket, kind="stable")
        bucket, key, owner = bucket[order], key[order], owner[order]
        at = np.append(np.flatnonzero(np.diff(bucket, prepend=np.uint64(1 << 40))), len(bucket))
        out = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            mine, place = np.unique(owner[a:b], return_inverse=True)
            out.append((int(bucket[a]), key[a:b].tobytes(), place.astype(np.uint32).tobytes(), names[mine].tobytes(), sizes[mine].tobytes()))
        return pa.RecordBatch.from_pylist([dict(zip(("bucket", "keys", "counts", "classes", "sizes"), o, strict=True)) for o in out], pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "counts", "classes", "sizes"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for _, _, values, rows in _sets(batch):
                if not len(values):
                    continue
                size = np.diff(rows)
                full = np.flatnonzero(size)
                names = np.frombuffer(b"".join(k for k in _set_keys(values, rows).to_pylist() if k), "V16")
                first, row = _first(values, rows, bits, common.value, least)
                held.append((first, np.searchsorted(full, row), names, size[full]))
                many += len(first)
                if many >= GATHERED // 4:
                    yield flush(held)
                    held, many = [], 0
        if held:
            yield flush(held)

    return run


def band_edges(least: int, top: int) -> np.ndarray:
    """The first size of each band: a band ends 100 / least times as far as it begins, or one further."""
    edges = [1]
    while edges[-1] <= top:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * 100 // least)))
    return np.array(edges, np.int64)


def _tiles(least: int):
    """(tile, set_key) of a bucket's tiles that hold two classes or more, tiles of equal members once."""

    def run(table: pa.Table) -> pa.Table:
        parts = [{c: np.frombuffer(r[c], t) for c, t in (("keys", np.uint32), ("counts", np.uint32), ("classes", "V16"), ("sizes", np.uint32))} for r in table.to_pylist()]
        shift = np.cumsum([0, *(len(p["classes"]) for p in parts)])
        key = np.concatenate([p["keys"] for p in parts]).astype(np.int64)
        owner = np.concatenate([p["counts"] + np.int64(s) for p, s in zip(parts, shift, strict=False)])
        names, sizes = np.concatenate([p["classes"] for p in parts]), np.concatenate([p["sizes"] for p in parts]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        more = np.flatnonzero(np.diff(key) == 0)
        keep = np.zeros(len(key), bool)
        keep[more], keep[more + 1] = True, True
        key, owner = key[keep], owner[keep]
        low, high = (a.astype("<u8") for a in names.view("<u8").reshape(-1, 2).T) if len(names) else (np.zeros(0, np.uint64),) * 2
        band = np.searchsorted(band_edges(least, int(sizes.max())), sizes, "right")[owner]
        # a tile holds its band and the next one; without a class of its own band it adds nothing
        tile = np.concatenate([key << 31 | band, key << 31 | (band - 1)])
        own = np.repeat([1, 0], len(key))
        owner = np.concatenate([owner, owner])
        order = np.lexsort((high[owner], low[owner], tile))
        tile, own, owner = tile[order], own[order], owner[order]
        same = np.zeros(len(tile), bool)  # repeated rows of a class
        same[1:] = (tile[1:] == tile[:-1]) & (low[owner[1:]] == low[owner[:-1]]) & (high[owner[1:]] == high[owner[:-1]])
        tile, own, owner = tile[~same], own[~same], owner[~same]
        if not len(tile):
            return pa.table({"tile": pa.array([], pa.int64()), "set_key": pa.array([], pa.binary())})
        first = np.flatnonzero(np.diff(tile, prepend=-1))
        count = np.diff(np.append(first, len(tile)))
        good = (count > 1) & (np.add.reduceat(own, first) > 0)
        name = np.add.reduceat(W.mix(low[owner] ^ W.mix(high[owner])), first).view(np.int64)
        good &= np.isin(np.arange(len(first)), np.unique(np.where(good, name, 0), return_index=True)[1]) | (good & (name == 0))
        taken = np.repeat(good, count)
        return pa.table({"tile": pa.array(np.repeat(name, count)[taken]), "set_key": pa.array([n.tobytes() for n in names[owner[taken]]], pa.binary())})

    return run


def jaccard_join(docs: DataFrame, least: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs(doc_id, text): components of links with 100 * intersection >= least * union.

    Every link between different sets is found or lies within a component that other links make.
    Null and empty texts have no shingles and stay alone. A null doc_id stays alone too, with a null
    component_id. Repeated rows of a doc_id each get a row; with different texts, each row follows its own.
    A text of any length is read whole. Columns besides doc_id and text are ignored; an empty table gives
    an empty table. Shingles are compared by 64-bit hashes. `least` may be 50 to 100.
    """
    if not 50 <= least <= 100:
        raise ValueError("least must be 50 to 100")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = saved(texts.mapInArrow(_describe, "doc_id bigint, n_shingles bigint, set_key binary, bitmap array<bigint>"), "shingled")
    named = told.filter("doc_id is not null and n_shingles > 0")
    reps = saved(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bitmap").alias("bitmap")), "classes")
    total = reps.agg(F.sum("size")).first()[0] or 0
    bits = min(24, max(8, math.ceil(math.log2(max(1, total / BUCKET)))))
    own = rows_of(texts.filter("doc_id is not null"), reps.select("rep"), "doc_id")  # one row a class, but for repeated ids

    counts = saved(own.mapInArrow(_counted(bits), _PACKED).groupBy("bucket").applyInArrow(_common, "key bigint, n bigint"), "common")
    common = spark.sparkContext.broadcast(commonest(counts))
    tiled = own.mapInArrow(_posted(bits, common, least), _PACKED).groupBy("bucket").applyInArrow(_tiles(least), "tile bigint, set_key binary")
    tiles = saved(tiled.distinct(), "tiles")

    members = saved(tiles.groupBy("tile").agg(F.count("*").alias("members")), "members")
    weight = tiles.join(light(members), "tile").groupBy("set_key").agg(F.sum("members").alias("weight"))
    shared = saved(tiles.join(light(members), "tile").join(light(saved(weight, "weights")), "set_key"), "shared")
    pivots = saved(shared.groupBy("tile").agg(F.max(F.struct("weight", "set_key")).alias("p")).select("tile", F.col("p.set_key").alias("pivot")), "pivots")
    marks = reps.select("set_key", "size", "bitmap")

    def may_link(pairs: DataFrame) -> DataFrame:
        """pairs(a, b) whose bitmaps leave room for a link."""
        held = pairs.join(marks.toDF("a", "size_a", "mark_a"), "a").join(marks.toDF("b", "size_b", "mark_b"), "b")
        return held.filter(_room("size_a", "size_b") >= (100 + least) * unlike_bits("mark_a", "mark_b")).select("a", "b")

    def _room(x: str, y: str) -> Column:
        """(100 + least) times the largest symmetric difference of linked sets of these sizes; negative where sizes alone forbid a link."""
        fits = 100 * F.least(x, y) >= least * F.greatest(x, y)
        return F.when(fits, (100 - least) * (F.col(x) + F.col(y))).otherwise(-1)

    def sets_of(keys: DataFrame) -> DataFrame:
        """set_key, shingles (sorted) of the classes in keys(set_key), from one text of each."""
        wanted = rows_of(reps.select("set_key", "rep"), keys, "set_key")
        return saved(rows_of(texts, wanted.select("rep"), "doc_id").mapInArrow(_full_sets, "set_key binary, shingles array<bigint>").dropDuplicates(["set_key"]), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = _shared("set_a", "set_b")
        held = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        return saved(held.filter(100 * both >= least * (F.size("set_a") + F.size("set_b") - both)).select("a", "b"), "links")

    stars = shared.join(light(pivots), "tile").filter("set_key <> pivot").select(F.col("set_key").alias("a"), F.col("pivot").alias("b")).distinct()
    guessed = saved(may_link(stars), "guessed")
    sets = sets_of(saved(guessed.select(F.explode(F.array("a", "b")).alias("set_key")).distinct(), "keys"))
    groups = components(confirmed(guessed, sets))

    labelled = shared.filter("members > 2").join(light(groups.toDF("set_key", "held")), "set_key", "left").select("tile", "set_key", F.coalesce("held", "set_key").alias("component"))
    labelled = saved(labelled, "labelled")
    split = saved(labelled.groupBy("tile").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("tile"), "split")
    rest = saved(labelled.join(light(split), "tile").join(light(pivots), "tile").select("tile", "set_key", "component", "pivot"), "rest")
    if not rest.isEmpty():
        sets = sets_of(saved(rest.select("set_key").distinct(), "keys"))
        lone = sets.select("set_key", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("set_key").alias("set_key")).filter("n = 1")
        alone = saved(sets.select("set_key", F.size("shingles").alias("size")).join(lone.groupBy("set_key").agg(F.count("*").alias("q")), "set_key", "left").select("set_key", "size", F.coalesce("q", F.lit(0)).alias("q")), "alone")
        differing = rest.filter("set_key <> pivot").select(F.col("set_key").alias("a"), F.col("pivot").alias("b")).distinct()
        differing = differing.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").select(F.col("a").alias("set_key"), F.col("b").alias("pivot"), (F.size("set_a") + F.size("set_b") - 2 * _shared("set_a", "set_b")).alias("d"))
        # d(x) + d(y) - 2 min(d(x) - q(x), d(y) - q(y)) is at most the difference of x and y: near(x) + wide(y) >= 0 and the reverse
        measured = rest.join(differing, ["set_key", "pivot"], "left").join(light(alone), "set_key").withColumn("d", F.coalesce("d", F.lit(0))).withColumn("q", F.when(F.col("set_key") == F.col("pivot"), 0).otherwise(F.col("q")))
        num, den = 100 - least, 100 + least
        measured = saved(measured.select("tile", "set_key", "component", (num * F.col("size") - den * F.col("d")).alias("near"), (num * F.col("size") + den * (F.col("d") - 2 * F.col("q"))).alias("wide")), "measured")
        most = measured.groupBy("tile").agg(F.max("near").alias("most_near"), F.max("wide").alias("most_wide"))
        alive = saved(measured.join(light(saved(most, "bounds")), "tile").filter("near + most_wide >= 0 and wide + most_near >= 0").join(marks, "set_key").select("tile", "set_key", "component", "near", "wide", "size", "bitmap"), "alive")
        x, y = alive.toDF("tile", "a", "ca", "na", "wa", "size_a", "mark_a"), alive.toDF("tile_y", "b", "cb", "nb", "wb", "size_b", "mark_b")
        across = x.join(y, F.expr("tile = tile_y and ca < cb and na + wb >= 0 and nb + wa >= 0") & (_room("size_a", "size_b") >= den * unlike_bits("mark_a", "mark_b"))).select("a", "b").distinct()
        groups = extended(groups, confirmed(across, sets))

    grouped = groups.toDF("set_key", "component")
    least_of = saved(grouped.join(reps.select("set_key", "rep"), "set_key").groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    by_set = reps.select("set_key", "rep").join(light(saved(grouped.join(light(least_of), "component").select("set_key", "component_id"), "groups")), "set_key", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    out = told.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(by_set, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op11_tiled_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every pair of distinct sets of fitting sizes that shares a shingle, counted, and what their links reach.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
 k AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS h FROM s),
 r AS MATERIALIZED (SELECT h, min(doc_id) AS doc_id, any_value(n) AS n FROM k WHERE n > 0 GROUP BY h),
 e AS MATERIALIZED (SELECT doc_id, n, md5_number_lower(unnest(s)) AS x FROM s JOIN r USING (doc_id)),
 l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
 t AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
 c(id, r) AS (SELECT doc_id, doc_id FROM r UNION SELECT c.id, t.b FROM c JOIN t ON t.a = c.r),
 m AS (SELECT id, min(r) AS component_id FROM c GROUP BY id)
SELECT k.doc_id, k.n AS n_shingles, coalesce(m.component_id, k.doc_id) AS component_id FROM k LEFT JOIN r ON r.h = k.h AND k.n > 0 LEFT JOIN m ON m.id = r.doc_id"""
