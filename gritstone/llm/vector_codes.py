"""Product codes of embeddings, with LAESA pivots sparing most of the exact distances.

1. Vectors become integers and are cut into 8 equal parts; each part position has a codebook
   of 16 entries, at first the parts of the 16 smallest ids.
2. The first PIVOTS entries of that codebook stay the position's pivots for good. The distance of
   every part to them is computed once and saved beside the parts.
3. A round works out the distances between pivots and the entries of the day. By the triangle
   inequality |d(part, pivot) - d(entry, pivot)| is at most d(part, entry), so the greatest such
   difference bounds an entry from below. A part tries its entries by rising bound, and an entry
   is evaluated, in whole numbers, only if its bound doesn't exceed the best distance so far.
4. Sums and counts by entry leave a task as at most 128 rows, so a vector that a third of all rows
   share is no hot key; a codebook is 128 short rows, the only thing that passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import light, saved
from .vectors import finite, matrix, one_length, scaled

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Pivots of a part position.
PIVOTS = 4
#: Whole numbers up to this size keep squared distances of parts of 256 entries within 64 bits.
LARGEST = 1 << 26
#: Added to what a bound is compared with: square roots of whole numbers below 2**62 are off by less than this share.
_SLACK = 1e-9


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, rows x entries, in whole numbers."""
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1) if len(entries) else np.zeros((len(x), 0), np.int64)


def nearest(x: np.ndarray, to_pivots: np.ndarray, pivots: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance) of each row, ties to the lower index, and the number of exact evaluations."""
    between = np.sqrt(_distances(entries, pivots).astype(np.float64))
    bound = np.abs(to_pivots[:, None, :] - between[None, :, :]).max(axis=2)
    order = np.argsort(bound, axis=1, kind="stable")
    rows = np.arange(len(x))
    best, at, tried = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(entries)), 0
    reach = np.full(len(x), np.inf)
    for k in range(len(entries)):
        entry = order[:, k]
        open_ = np.flatnonzero(bound[rows, entry] <= reach)
        if not len(open_):  # bounds rise with k
            break
        entry, tried = entry[open_], tried + len(open_)
        exact = ((x[open_] - entries[entry]) ** 2).sum(axis=1)
        wins = (exact < best[open_]) | ((exact == best[open_]) & (entry < at[open_]))
        hit = open_[wins]
        best[hit], at[hit] = exact[wins], entry[wins]
        reach[hit] = np.sqrt(exact[wins].astype(np.float64)) * (1 + _SLACK) + _SLACK
    return at, best, tried


def _measure(width: int, pivots: np.ndarray):
    """Adds the distances of all parts to their pivots, PARTS x PIVOTS numbers a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width).reshape(batch.num_rows, PARTS, -1)
            told = np.stack([np.sqrt(_distances(x[:, p], pivots[p]).astype(np.float64)) for p in range(PARTS)], axis=1).reshape(batch.num_rows, -1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * told.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), pa.ListArray.from_arrays(ends, pa.array(told.reshape(-1)))], ["vec_id", "label", "x", "to_pivots"])

    return run


def _assign(batch: pa.RecordBatch, width: int, pivots: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(parts, codes, squared distances) of a batch."""
    x = matrix(batch.column("x"), width).reshape(batch.num_rows, PARTS, -1)
    d = matrix(batch.column("to_pivots"), PARTS * pivots.shape[1]).reshape(batch.num_rows, PARTS, -1)
    found = [nearest(x[:, p], d[:, p], pivots[p], books[p]) for p in range(PARTS)]
    return x, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _sums(width: int, pivots: np.ndarray, books: np.ndarray):
    """Count and componentwise sums of the parts of each (part, entry) of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            x, codes, _ = _assign(batch, width, pivots, books)
            for p in range(PARTS):
                count[p] += np.bincount(codes[:, p], minlength=books.shape[1])
                np.add.at(total[p], codes[:, p], x[:, p])
        p, e = np.nonzero(count)
        sums = total[p, e].reshape(-1)
        ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * books.shape[2])
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.ListArray.from_arrays(ends, pa.array(sums))], ["part", "entry", "n", "total"])

    return run


def _codes(width: int, pivots: np.ndarray, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, d = _assign(batch, width, pivots, books)
            text = pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(d.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return run


def codebooks(parts: DataFrame, width: int, pivots: np.ndarray, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """PARTS x entries x length after the given rounds over parts, a saved table with to_pivots."""
    length = books.shape[2]
    for _ in range(rounds):
        found = parts.mapInArrow(_sums(width, pivots, books), "part bigint, entry bigint, n bigint, total array<bigint>").groupBy("part", "entry")
        told = found.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("total", F.lit(k))) for k in range(length))).alias("total")).collect()  # at most PARTS x ENTRIES rows
        books = books.copy()
        for r in told:
            books[r.part, r.entry] = [t // r.n for t in r.total]  # floors, below zero too
    return books


def product_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of vectors(vec_id, embedding, label).

    Rows whose vector is null or holds null or non-finite entries are dropped. Repeated ids and rows
    each get a row; the first codebook takes rows by vec_id (null ids last), then by vector, and
    is shorter than 16 where there are fewer rows. Null labels are one group. Other columns, whatever their
    names, are ignored; an empty table gives an empty table. Lengths that differ, or can't be cut into 8
    equal parts, and entries of LARGEST / 4096 or more are a ValueError.
    """
    own = finite(vectors).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), scaled("embedding", SCALE).alias("x"))
    whole = saved(own, "integers")
    width = one_length(whole, "x")
    if width is None:
        return whole.selectExpr("vec_id", "'' as code", "0L as error", "0L as label_error", "'' as codebooks_sha256")
    if width % PARTS:
        raise ValueError(f"vectors of {width} entries can't be cut into {PARTS} equal parts")
    if (whole.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] or 0) >= LARGEST:
        raise ValueError(f"entries of {LARGEST / SCALE:g} or more")
    first = whole.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    books = np.array([r.x for r in first], np.int64).reshape(len(first), PARTS, -1).transpose(1, 0, 2)
    pivots = books[:, :PIVOTS]
    parts = saved(whole.mapInArrow(_measure(width, pivots), "vec_id bigint, label bigint, x array<bigint>, to_pivots array<double>"), "parts")
    books = codebooks(parts, width, pivots, books)
    coded = saved(parts.mapInArrow(_codes(width, pivots, books), "vec_id bigint, label bigint, code string, error bigint"), "codes")
    sums = saved(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"), "label_errors")
    digest = hashlib.sha256(",".join(str(v) for v in books.reshape(-1).tolist()).encode()).hexdigest()
    return coded.join(light(sums), F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_laesa_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle_sql() -> str:
    """Six rounds of full searches, written out."""
    entry = "from (select i, part, entry, d, row_number() over (partition by i, part order by d, entry) as k from (select p.i, p.part, b.entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from parts p join {book} b using (part))) where k = 1"
    with_ = [
        "kept as materialized (select row_number() over (order by vec_id, embedding) as i, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)",
        f"parts as materialized (select i, g.part::bigint as part, list_slice(x, g.part * len(x) // {PARTS} + 1, (g.part + 1) * len(x) // {PARTS}) as v from kept, range({PARTS}) g(part))",
        f"b0 as materialized (select part, i - 1 as entry, v from parts where i <= {ENTRIES})",
    ]
    for r in range(ROUNDS):
        with_ += [
            f"a{r} as materialized (select i, part, entry {entry.format(book=f'b{r}')})",
            f"m{r} as materialized (select part, entry, list(value order by pos) as v from (select a.part, a.entry, u.pos, (sum(p.v[u.pos])::bigint - (sum(p.v[u.pos])::bigint % count(*) + count(*)) % count(*)) // count(*) as value from a{r} a join parts p using (i, part), (select unnest(range(1, (select len(v) from parts limit 1) + 1)) as pos) u group by all) group by all)",
            f"b{r + 1} as materialized (select b.part, b.entry, coalesce(m.v, b.v) as v from b{r} b left join m{r} m using (part, entry))",
        ]
    last = f"b{ROUNDS}"
    with_ += [
        f"final as materialized (select i, part, entry, d {entry.format(book=last)})",
        f"told as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) as digest from {last})",
        "coded as (select i, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from final group by i)",
    ]
    return f"with {', '.join(with_)} select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, digest as codebooks_sha256 from coded join kept using (i), told"


ORACLE_SQL = _oracle_sql()
