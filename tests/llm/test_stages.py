from __future__ import annotations

import pytest

from gritstone.llm import stages, substrings
from gritstone.llm.near_dups import near_duplicates

SCHEMA = "_key string, doc_id int, text string, score int, votes string, _owner int, n_chars bigint"
GOOD = "The committee met on Tuesday and decided, after a long debate, that the new bridge would be built next year. Everyone was pleased with the plan."
OTHER = "Rain fell over the quiet valley for three days, and the river rose until the old mill had to close its doors to every visitor from town."
FILTERS = [stages.keep_quality, stages.keep_one_of_each_group, stages.cut_repeats, stages.drop_leaks]


def table(spark, rows):
    return spark.createDataFrame([("k", i, t, 1, "v", 2, len(t or "")) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("stage", FILTERS)
def test_empty_tables_and_own_columns(spark, sf, stage):
    out = stage(spark, table(spark, []), sf)
    assert out.collect() == [] and out.schema == table(spark, []).schema


@pytest.mark.parametrize("stage", FILTERS)
def test_odd_rows_pass_or_go_without_harm(spark, sf, stage):
    rows = [(1, GOOD), (2, OTHER), (3, None), (4, ""), (None, GOOD + " Indeed it was."), (5, " ".join([GOOD.upper()] * 400))]
    out = stage(spark, table(spark, rows), sf).collect()
    assert {(r._key, r.score, r.votes, r._owner) for r in out} <= {("k", 1, "v", 2)}
    assert {1, 2} <= {r.doc_id for r in out}


def test_rows_of_one_doc_id_fare_each_for_itself(spark, sf):
    item = next(r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    docs = table(spark, [(1, GOOD), (2, GOOD), (2, OTHER), (2, OTHER), (3, OTHER.upper()), (4, item), (4, "A clean text of its own that nobody else has ever written down anywhere.")])
    one = sorted((r.doc_id, r.text) for r in stages.keep_one_of_each_group(spark, docs, sf).filter("doc_id < 4").collect())
    assert one == [(1, GOOD), (2, OTHER)]
    clean = [r.text for r in stages.drop_leaks(spark, docs, sf).filter("doc_id = 4").collect()]
    assert clean == ["A clean text of its own that nobody else has ever written down anywhere."]


def test_copies_under_one_doc_id_leave_one(spark, sf):
    docs = table(spark, [(7, GOOD), (7, GOOD), (7, GOOD.upper()), (8, GOOD)])
    out = stages.keep_one_of_each_group(spark, docs, sf).collect()
    assert len(out) == 1 and out[0].doc_id == 7


def thue_morse(n, a="a", b="b"):
    return "".join(a if bin(k).count("1") % 2 == 0 else b for k in range(n))


def test_words_made_to_collide_stay_apart(spark):
    x, y = thue_morse(1024), thue_morse(1024, "b", "a")
    rows = spark.createDataFrame([(1, x), (2, y), (3, x)], "doc_id int, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(rows).collect()} == {1: 1, 2: 2, 3: 1}
    long = [" ".join([w] * 60) for w in (x, y)]
    told = substrings.repeat_report(spark.createDataFrame(list(enumerate(long)), "doc_id int, text string")).collect()
    assert [r.n_removed for r in told] == [0, 0]
    mixed = [" ".join(thue_morse(64, u, v).replace(u, u + " ").replace(v, v + " ").split()) for u, v in (("p", "q"), ("q", "p"))]
    rows = [(i, t) for i, t in enumerate(mixed)]
    words = {i: t.split() for i, t in rows}
    seen = {tuple(words[0][k : k + 50]) for k in range(15)}
    want = {j for k in range(15) if tuple(words[1][k : k + 50]) in seen for j in range(k, k + 50)}
    got = {r.doc_id: r.n_removed for r in substrings.repeat_report(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == {0: 0, 1: len(want)}


def test_family_of_copies_around_an_original(spark):
    import random

    from tests.llm.test_near_dups import brute

    rnd = random.Random(11)
    base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for k in range(150):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 3, 5, 6, 8])):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(300)}"
        rows.append((k, " ".join(words)))
        if k % 10 == 0:  # a copy far from the original has a close copy of its own
            words[0] = "own"
            rows.append((2000 + k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert got == brute(rows)
