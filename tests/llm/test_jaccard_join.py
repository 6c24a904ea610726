from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest

from gritstone.llm import jaccard_join as J

from .test_near_dups import SCHEMA, documents, shingle_set


def brute(rows, least=80):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= least * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def joined(spark, rows, least=80):
    df = spark.createDataFrame([("x", i, t, 1) for i, t in rows], SCHEMA).repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df, least).collect()}


def test_same_as_brute_force(spark):
    rows = documents()
    assert joined(spark, rows) == brute(rows)


@pytest.mark.parametrize("least", [50, 90])
def test_other_thresholds(spark, least):
    rows = documents()
    assert joined(spark, rows, least) == brute(rows, least)


def test_given_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_join(df).collect()} == brute(rows)


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as from '{sf}/documents.parquet'")
    want = sorted(con.sql(f"select doc_id, n_shingles, component_id from ({J.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in J.op11_tiled_jaccard_join(spark, sf).collect()) == want


def test_exact_borders_common_passages_and_edited_copies(spark, monkeypatch):
    """Pairs at, just over and just under the threshold; a passage that most texts hold; copies of a common original that link with each other but not with it."""
    monkeypatch.setattr(J, "GATHERED", 3000)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(5000)}"
    rows, n = [], 0
    for size, cut in ((90, 10), (91, 10), (89, 10), (45, 5), (44, 5), (46, 5), (5, 1), (9, 1), (10, 1)):
        base = [word() for _ in range(size + 4)]
        for words in (base, base[:-cut] if cut < len(base) else base, [*base[cut:], *(word() for _ in range(cut))]):
            rows.append((n := n + 1, " ".join(words)))
    passage = [word() for _ in range(60)]
    rows += [((n := n + 1), " ".join([*(word() for _ in range(rnd.choice([3, 8, 14, 40]))), *passage])) for _ in range(60)]
    origin = [word() for _ in range(200)]
    for k in range(40):
        copy = list(origin)
        for at in rnd.sample(range(200), rnd.choice([2, 4, 6])):
            copy[at] = f"edit{k % 7}-{at}"
        rows += [((n := n + 1), " ".join(copy))] * 1
    rows.append((n + 1, " ".join(word() for _ in range(9000))))  # a long text, and a near copy of it
    rows.append((n + 2, rows[-1][1] + " end"))
    assert joined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    assert J.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("x", None, "a b c d e f", 1), ("x", 3, "a b c d e f", 1), ("x", 3, "a b c d e f", 1), ("x", 2, "A b c d e f", None), ("y", 5, None, 2), ("y", 6, "", 2), ("y", 3, "quite another text it is", 0)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, None), (3, 2, 2), (3, 2, 2), (2, 2, 2), (5, 0, 5), (6, 0, 6), (3, 1, 3)], key=str)
    with pytest.raises(ValueError):
        J.jaccard_join(spark.createDataFrame([], SCHEMA), 40)


def test_bitmaps_bound_the_overlap(spark):
    rnd = np.random.default_rng(2)
    rows = []
    for _ in range(60):
        a = np.unique(rnd.integers(0, 1 << 63, rnd.integers(1, 700)).astype(np.uint64))
        b = np.unique(np.concatenate([rnd.choice(a, max(1, int(len(a) * rnd.uniform(0.8, 1))), replace=False), rnd.integers(0, 1 << 63, rnd.integers(0, len(a) // 8 + 1)).astype(np.uint64)]))
        marks = list(J._bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        rows.append((marks[0].tolist(), marks[1].tolist(), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, d int")
    got = df.select("d", J.unlike_bits("a", "b").alias("bits")).collect()
    assert all(r.bits <= r.d for r in got) and sum(r.bits for r in got) > 0.5 * sum(r.d for r in got)


def test_bands_reach_every_partner():
    for least in (50, 80, 99, 100):
        edges = J.band_edges(least, 3000)
        band = lambda n: int(np.searchsorted(edges, n, "right"))  # noqa: B023, E731
        assert all(band(100 * n // least) - band(n) <= 1 for n in range(1, 3000))
