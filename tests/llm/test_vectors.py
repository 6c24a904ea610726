from __future__ import annotations

import hashlib
import math

import duckdb
import numpy as np
import pytest

from gritstone.llm import vector_codes, whitening

SCHEMA = "x int, vec_id bigint, embedding array<float>, label int, part string, number int, to_pivots string"


def frame(spark, rows):
    return spark.createDataFrame([(1, i, None if v is None else [None if e is None else float(e) for e in v], label, "p", 7, None) for i, v, label in rows], SCHEMA)


def some(count, width, seed, spread=1.0):
    rnd = np.random.default_rng(seed)
    rows = [(int(i), (rnd.normal(size=width) * spread).astype(np.float32).tolist(), int(rnd.integers(3)) if i % 5 else None) for i in rnd.permutation(count)]
    copy = rows[0][1]
    rows += [(1000 + k, copy, 1) for k in range(count // 2)]
    return [*rows, (5000, None, 1), (5001, [*copy[1:], None], 1), (5002, [*copy[1:], math.nan], 0), (5003, [*copy[1:], math.inf], 0), (None, rows[1][1], 2), rows[2], rows[2]]


def kept(rows):
    return [r for r in rows if r[1] is not None and all(e is not None and math.isfinite(e) for e in r[1])]


def brute_codes(rows):
    rows = kept(rows)
    x = np.array([[math.floor(4096 * e) for e in r[1]] for r in rows], dtype=object).reshape(len(rows), 8, -1)
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, list(x[k].reshape(-1))))[:16]
    books = [[x[k][p].copy() for k in first] for p in range(8)]

    def assign():
        return [[min((int(((v[p] - e) ** 2).sum()), k) for k, e in enumerate(books[p])) for p in range(8)] for v in x]

    for _ in range(6):
        found = assign()
        for p in range(8):
            for k in range(len(first)):
                mine = [x[i][p] for i in range(len(rows)) if found[i][p][1] == k]
                if mine:
                    books[p][k] = sum(mine) // len(mine)
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(rows, found, errors, strict=True)), key=str)


@pytest.mark.parametrize(("count", "width", "seed"), [(60, 16, 1), (5, 8, 2), (40, 24, 3)])
def test_codes_same_as_brute_force(spark, count, width, seed):
    rows = some(count, width, seed)
    got = vector_codes.product_codes(frame(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_codes(rows)


def test_codes_same_as_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as from '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"select vec_id, code, error, label_error, codebooks_sha256 from ({vector_codes.ORACLE_SQL})").fetchall())
    assert sorted(tuple(r) for r in vector_codes.op12_laesa_vector_codes(spark, sf).collect()) == want


def test_pivots_spare_evaluations_and_keep_ties():
    rnd = np.random.default_rng(4)
    entries = rnd.integers(-3, 4, (16, 8)) * 100
    entries[9], entries[12] = entries[3], entries[3]
    x = np.concatenate([entries[rnd.integers(16, size=500)] + rnd.integers(-9, 10, (500, 8)), entries, (entries[:8] + entries[8:]) // 2])
    pivots = entries[:4]
    at, best, tried = vector_codes.nearest(x, np.sqrt(vector_codes._distances(x, pivots).astype(float)), pivots, entries)
    full = vector_codes._distances(x, entries)
    assert (at == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert tried < 0.6 * full.size


def test_odd_tables(spark):
    nothing = frame(spark, [(1, None, 0), (2, [math.nan] * 8, 0)])
    for work in (vector_codes.product_codes, whitening.whitened):
        assert work(nothing).collect() == [] and work(nothing.limit(0)).collect() == []
        with pytest.raises(ValueError):
            work(frame(spark, [(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)]))
    with pytest.raises(ValueError):
        vector_codes.product_codes(frame(spark, [(1, [1.0] * 7, 0)]))
    with pytest.raises(ValueError):
        vector_codes.product_codes(frame(spark, [(1, [1e9] * 8, 0)]))
    assert whitening.whitened(frame(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 4, 0)])).collect() == []


@pytest.mark.parametrize(("count", "width", "seed"), [(90, 24, 5), (40, 6, 6), (10, 20, 7)])
def test_whitening_same_as_local(spark, monkeypatch, count, width, seed):
    monkeypatch.setattr(whitening, "ROWS", 7)  # many blocks
    monkeypatch.setattr(whitening, "BLOCKS_A_TASK", 2)
    rows = some(count, width, seed)
    own = kept(rows)
    x = [tuple(math.floor(64 * e) + 1_000_000 for e in r[1]) for r in own]
    fit = np.array(sorted(set(x)), dtype=np.int64)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    use = min(16, int((values > values[0] * 1e-12).sum()))
    assert use == min(16, width, n - 1)
    got = whitening.whitened(frame(spark, rows).repartition(6)).collect()
    assert len(got) == use * len(own) and {r.n for r in got} == {n} and got[0].identity_error < 1e-9
    by_id = {}
    for r in got:
        by_id.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for row, v in zip(own, x, strict=True):
        c = n * np.array(v) - s
        for k in range(use):
            mine = by_id[row[0], k + 1]
            want = float((c / n) @ directions[:, k] / math.sqrt(values[k]))
            assert {r.deviation for r in mine} == {int((c * c).sum())}
            assert abs(mine[0].explained - values[k] / values.sum()) < 1e-10
            if k + 1 not in signs and abs(want) > 0.1:
                signs[k + 1] = math.copysign(1, want * mine[0].whitened)
            for r in mine:
                assert abs(abs(r.whitened) - abs(want)) < 1e-8 and (abs(want) <= 0.1 or math.copysign(1, want * r.whitened) == signs[k + 1])
