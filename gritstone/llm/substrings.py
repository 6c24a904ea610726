"""Repeated passages by recompression.

Texts are parsed in rounds. A round first names runs of one symbol, then pairs of a left and a
right symbol; a symbol's side in a round is a bit of its hash. A name is a hash of what it
stands for, so all tasks give equal runs and pairs equal names without a dictionary to join.
Whether two neighbours merge depends on them alone, hence equal passages get equal symbols
inside, and only symbols near a passage's borders depend on what surrounds it. The parse keeps
for each symbol the stretch of words that it depends on.

Each window of `span` words takes as its anchor the least-named group of four neighbouring symbols
of the highest level that has one depending on nothing outside the window. This is a function of the window's words
alone, so equal windows have equal anchors: only windows whose anchor occurs in two documents
need to be compared, and none is missed. Those are compared by 128-bit hashes of all their words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .store import rows_of, saved

ROUNDS = 4
#: Neighbouring symbols that make an anchor; one alone may be a frequent word.
GROUP = 4
_RUN, _PAIR = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def levels(h: np.ndarray, rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(name, first word, last word that it depends on) of the symbols after 0, 1 ... ROUNDS rounds.

    What depends on a document's border depends on a word beyond it.
    """
    at = np.arange(len(h))
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    name, low, high = h, at, at
    out = [(name, low, high)]
    for k in range(ROUNDS):
        if not len(name):
            break
        apart = np.ones(len(name) + 1, bool)  # whether a document ends before symbol i
        apart[1:-1] = row[1:] != row[:-1]
        starts = np.flatnonzero(apart[:-1] | np.concatenate([[True], name[1:] != name[:-1]]))
        ends = np.append(starts[1:], len(name))
        length = ends - starts
        run = name[starts]
        run = np.where(length > 1, W.mix(run * _RUN + length.astype(np.uint64)), run)
        run_low = np.where(apart[starts], rows[row[starts]] - 1, low[starts - 1])
        run_high = np.where(apart[ends], rows[row[starts] + 1], high[np.minimum(ends, len(name) - 1)])
        name, low, high, row = run, run_low, run_high, row[starts]

        n = len(name)
        apart = np.ones(n + 1, bool)
        apart[1:-1] = row[1:] != row[:-1]
        left = (W.mix(name + np.uint64(k + 1)) & np.uint64(1)).astype(bool)
        joins = np.zeros(n, bool)  # symbol i with the next
        joins[:-1] = left[:-1] & ~left[1:] & ~apart[1:-1]
        second = np.zeros(n, bool)
        second[1:] = joins[:-1]
        here = np.flatnonzero(~second)
        after, before = np.minimum(here + 1, n - 1), np.maximum(here - 1, 0)
        merged, single_left = joins[here], left[here] & ~joins[here]
        single_right = ~left[here]
        new_low = np.where(single_right, np.where(apart[here], rows[row[here]] - 1, low[before]), low[here])
        new_high = np.where(merged, high[after], np.where(single_left, np.where(apart[here + 1], rows[row[here] + 1], high[after]), high[here]))
        name = np.where(merged, W.mix(name[here] * _PAIR + W.mix(name[after])), name[here])
        low, high, row = new_low, new_high, row[here]
        out.append((name, low, high))
    return out


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for each pair lo <= hi."""
    width = hi - lo + 1
    power = np.frexp(width.astype(np.float64))[1] - 1
    out, table = np.empty(len(lo), np.uint64), values
    for p in range(int(power.max(initial=0)) + 1):
        now = power == p
        out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << p) + 1])
        if len(table) > 1 << p:
            table = np.minimum(table[: -(1 << p)], table[1 << p :])
    return out


def anchors(h: np.ndarray, rows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and anchor of each window of `span` words inside a row."""
    count = np.maximum(np.diff(rows) - span + 1, 0)
    base = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(base[-1]) + np.repeat(rows[:-1] - base[:-1], count)
    chosen = np.zeros(len(start), np.uint64)
    left = np.arange(len(start))
    for k, (name, low, high) in reversed(list(enumerate(levels(h, rows)))):
        if not len(left):
            break
        g = min(GROUP, span)
        if len(name) < g:
            continue
        m, own = len(name) - g + 1, name
        name, low, high = own[:m], low[:m], high[g - 1 :]
        for j in range(1, g):
            name = W.mix(name * _PAIR + own[j : m + j])
        p = start[left]
        lo, hi = np.searchsorted(low, p, "left"), np.searchsorted(high, p + span - 1, "right") - 1
        has = lo <= hi
        chosen[left[has]] = W.mix(_least(name, lo[has], hi[has]) + np.uint64(k))
        left = left[~has]
    return start, chosen


def window_hashes(h: np.ndarray, start: np.ndarray, span: int) -> list[np.ndarray]:
    """Two hashes of all words of each window, from words scrambled in two ways: 128 bits together."""
    up, down = W._power(len(h) + 1)
    out = []
    for own in (h, W.mix(h + _PAIR)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(own * up[: len(h)], out=total[1:])
        out.append(W.mix((total[start + span] - total[start]) * down[start]))
    return out


def _hex(h: np.ndarray) -> str:
    return hashlib.md5(h).hexdigest()


def _survey(span: int):  # noqa: ANN202
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, data, offsets in W.slices(batch.column("text")):
                h, first, end, rows = W.words(data, offsets, lower=False)
                start, chosen = anchors(h, rows, span)
                names, of = W.distinct(chosen, np.searchsorted(start, rows))
                raw = data.tobytes()
                kept = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, n), pa.array(np.diff(rows)), pa.array([_hex(h[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]), pa.array(kept),
                     pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(names.view(np.int64)))],
                    ["doc_id", "n_words", "text_key", "kept_sha256", "anchors"],
                )

    return survey


def _compare(span: int):  # noqa: ANN202
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, n, data, offsets in W.slices(batch.column("text")):
                h, _, _, rows = W.words(data, offsets, lower=False)
                start, chosen = anchors(h, rows, span)
                wanted, own = batch.column("shared").slice(lo, n), np.searchsorted(start, rows)
                pick = np.zeros(len(start), bool)
                for i, (a, b) in enumerate(zip(own[:-1], own[1:], strict=True)):
                    pick[a:b] = np.isin(chosen[a:b].view(np.int64), wanted[i].values.to_numpy(zero_copy_only=False))
                of = np.concatenate([[0], np.cumsum(pick)])[own].astype(np.int32)
                at = start[pick] - np.repeat(rows[:-1], np.diff(of))
                lists = [pa.ListArray.from_arrays(pa.array(of), x) for x in (pa.array(at.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in window_hashes(h, start[pick], span)))]
                keys = pa.array([_hex(h[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, n), keys, *lists], ["doc_id", "text_key", "at", "window", "more"])

    return compare


def _cut(span: int):  # noqa: ANN202
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, removed = [], [], []
            for text, starts, key in zip(batch.column("text"), batch.column("starts"), batch.column("text_key"), strict=True):
                parts = (text.as_py() or "").encode().split()
                gone = np.zeros(len(parts) + 1, np.int64)
                s = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(gone, s, 1)
                np.add.at(gone, s + span, -1)
                out = np.cumsum(gone[:-1]) > 0
                keys.append(key.as_py())
                removed.append(int(out.sum()))
                texts.append(b" ".join(w for w, o in zip(parts, out.tolist(), strict=True) if not o).decode())
            sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())], ["text_key", "n_removed", "kept_sha256", "kept_text"])

    return cut


def repeats(docs: DataFrame, span: int = 50) -> tuple[DataFrame, DataFrame]:
    """(told, cuts): doc_id, n_words, text_key, kept_sha256 of every row of docs(doc_id, text) as it
    came, and text_key, owner, n_removed, kept_sha256, kept_text of each word sequence of `span`
    words or more that loses some. Rows of a later doc_id than owner lose all words."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = saved(texts.mapInArrow(_survey(span), "doc_id bigint, n_words bigint, text_key string, kept_sha256 string, anchors array<bigint>"), "surveyed")
    long = told.filter((F.col("n_words") >= span) & F.col("doc_id").isNotNull())
    owners = saved(long.groupBy("text_key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")), "owners")
    own = long.join(owners, (long.text_key == owners.text_key) & (long.doc_id == owners.owner), "left_semi").dropDuplicates(["doc_id", "text_key"])
    named = own.select("doc_id", F.explode("anchors").alias("anchor"))
    both = saved(named.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor"), "anchors")  # a table of its own, so that a hot anchor's rows can be split
    shared = saved(named.join(both, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared")), "shared")
    near = rows_of(texts, shared.select("doc_id"), "doc_id").join(shared, "doc_id")
    compared = saved(near.mapInArrow(_compare(span), "doc_id bigint, text_key string, at array<int>, window array<bigint>, more array<bigint>"), "windows")
    windows = compared.select("doc_id", "text_key", F.inline(F.arrays_zip("at", "window", "more")))
    earliest = saved(windows.groupBy("window", "more").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("window", "more", "low"), "earliest")
    starts = saved(windows.join(earliest, ["window", "more"]).filter("low < doc_id").groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("starts")), "starts")
    cut = (
        rows_of(texts, starts.select("doc_id"), "doc_id").join(starts, "doc_id")
        .withColumn("own_key", _text_key("text")).filter("own_key = text_key").dropDuplicates(["doc_id", "text_key"])
        .mapInArrow(_cut(span), "text_key string, n_removed bigint, kept_sha256 string, kept_text string")
    )
    cuts = owners.join(cut, "text_key", "left").filter("owner < last or n_removed > 0").select("text_key", "owner", "n_removed", "kept_sha256", "kept_text")
    return told.drop("anchors"), saved(cuts, "cuts")


def _text_key(column: str):  # noqa: ANN202
    @F.pandas_udf("string")
    def key(texts):  # noqa: ANN001, ANN202
        out = []
        for _, _, data, offsets in W.slices(pa.array(texts, pa.large_string())):
            h, _, _, rows = W.words(data, offsets, lower=False)
            out += [_hex(h[a:b]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
        import pandas as pd

        return pd.Series(out, dtype=object)

    return key(column)


def repeat_report(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs(doc_id, text).

    A word goes if a window of `span` words that covers it also starts in a document with a
    smaller doc_id. Null and empty texts have no words. Rows with a null doc_id lose nothing and
    take nothing from others. Repeated rows of a doc_id are judged alike; a doc_id isn't smaller
    than itself, so they take nothing from each other. A text of any length is read whole. Other
    columns are ignored; an empty table gives an empty table.
    """
    told, cuts = repeats(docs, span)
    marked = told.join(cuts.drop("kept_text").withColumnRenamed("kept_sha256", "cut_sha256"), "text_key", "left")
    copy = (F.col("doc_id") > F.col("owner")) & F.col("owner").isNotNull()
    mine = F.col("owner").isNotNull() & F.col("doc_id").isNotNull()
    return marked.select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).when(mine, F.coalesce("n_removed", F.lit(0))).otherwise(0).cast("bigint").alias("n_removed"),
        F.when(copy, F.lit(EMPTY_SHA)).when(mine, F.coalesce("cut_sha256", "kept_sha256")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """docs with the repeated words cut out of text, and n_chars, if there is such a column, counted anew. Texts that lose nothing stay as they are; of others the kept words are joined by one space."""
    _, cuts = repeats(docs, span)
    key, owner, left = (f"{c}_{uuid.uuid4().hex}" for c in ("key", "owner", "kept"))
    keyed = docs.withColumn(key, _text_key("text"))
    marked = keyed.join(cuts.select(F.col("text_key").alias(key), F.col("owner").alias(owner), F.col("kept_text").alias(left)), key, "left")
    text = F.when(F.col("doc_id") > F.col(owner), F.lit("")).when(F.col("doc_id").isNotNull(), F.coalesce(left, "text")).otherwise(F.col("text"))
    out = marked.withColumn("text", text).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op4_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
