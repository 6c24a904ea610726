from __future__ import annotations

import math

from gritstone.llm.quality import scored
from gritstone.llm.toxicity import Grammar, toxicity

SF = "/root/testdata/sf0.01"
SCHEMA = "score int, doc_id bigint, text string, votes string"


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = scored(docs).join(labels, "doc_id").selectExpr("quality", "score >= 0.5 as kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.03 * len(bad)


def test_quality_of_odd_rows(spark):
    rows = [(1, 1, None, "v"), (1, 2, "", "v"), (1, None, "One plain sentence of words.", "v"), (1, 3, "x " * 50_000, "v"), (1, 4, "Eder heed of the reorouha, erth. " * 3, None), (1, 4, "Eder heed of the reorouha, erth. " * 3, None)]
    got = scored(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and [r.score for r in got if r.doc_id in (1, 2)] == [0.0, 0.0] and all(0 <= r.score <= 1 for r in got)
    assert scored(spark.createDataFrame([], SCHEMA)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity(docs, labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hit, said, there = (sum(f(r) for r in rows) for f in (lambda r: r.toxic and r.predicted, lambda r: r.predicted, lambda r: r.toxic))
    assert len(rows) > 50 and hit >= 0.9 * said and hit >= 0.6 * there


def test_grammar_scores_clauses():
    g = Grammar({"fool": 2.0, "vequ*": 1.5})
    weight = lambda text: g.features(text)[2]
    assert weight("you are a fool") > weight("a fool stands there") > weight("he said: a fool") - 1e-9
    assert weight("you are not a fool") < weight("you are a fool")
    assert weight("they said you fool") < weight("they meant you fool")
    assert weight("la vequique") == 1.5 and weight("") == weight("plain words") == 0.0


def test_grammar_reads_all_words_and_whole_clauses(spark):
    g = Grammar({"idiot": 2.0})
    best, count = (lambda text: g.features(text)[2]), (lambda text: round(math.expm1(g.features(text)[3])))
    assert all(count(t) == 1 for t in ("l'idiot", "l\u2019idiot", "you-idiot", "fine.Idiot", "and/or/idiot", "x_idiot", "1idiot"))
    assert best("you-idiot") == best("you idiot") == 2.5 and best("you.idiot") == 2.0
    assert best("it isn't-idiot") == best("it isn't idiot") == best("it not idiot") < 2.0
    assert best("they said " + "plain " * 90 + "idiot") == 0.4 * 2.0
    assert best("idiot " + "plain " * 90 + "you idiot") == 2.0 + 2.5
    assert count("you idiot. " * 37) == 37 and count("idiot 3.5 idiot, idiot") == 2
    docs = spark.createDataFrame([(1, 1, "you kill, " * 25, "v")], SCHEMA)
    assert [r.n_clauses for r in toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()] == [25]


def test_toxicity_of_odd_rows(spark):
    labels = "doc_id bigint, toxic int, score int"
    docs = spark.createDataFrame([(1, None, "a", "v"), (1, 2, None, "v"), (1, 3, "", "v"), (1, 3, "", "v")], SCHEMA)
    for rows in ([], [(1, 1, 0), (None, 1, 0), (4, None, 0), (4, 7, 0)]):
        got = toxicity(docs, spark.createDataFrame(rows, labels)).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], labels)).collect() == []
