from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from gritstone.functions import text as T
from gritstone.operators import conditions as C, graphs, search
from gritstone.sources import tables

AGE = {"field": "age", "operator": "GTE", "value": 18}


def test_conditions_are_three_valued(spark):
    df = spark.createDataFrame([("25", None), ("16", "x"), (None, "y")], "age string, b string")
    facts = {"age": F.col("age"), "b": F.col("b")}
    both = {"all": [AGE, {"field": "b", "operator": "EQ", "value": "X"}]}
    either = {"any": [AGE, {"field": "b", "operator": "EQ", "value": "y"}]}
    told = lambda t: [r[0] for r in df.select(C.truth(C.condition(t, facts))).collect()]
    assert told(AGE) == ["TRUE", "FALSE", "UNKNOWN"]
    assert told(both) == ["UNKNOWN", "FALSE", "FALSE"] and told(either) == ["TRUE", "FALSE", "TRUE"]
    assert told({"not": AGE}) == ["FALSE", "TRUE", "UNKNOWN"] and told(None) == ["TRUE"] * 3 == told({"all": []}) and told({"any": []}) == ["FALSE"] * 3
    assert told({"field": "b", "operator": "EXISTS"}) == ["FALSE", "TRUE", "TRUE"] and told({"field": "none", "operator": "GT", "value": 1}) == ["UNKNOWN"] * 3
    assert [r[0] for r in df.select(C.unresolved(both, facts)).collect()] == [["b"], [], []]
    assert C.fields(both) == ["age", "b"]


def test_requirement_groups(spark):
    rows = [("ANY_OF", 1, 3, 1, 0, True), ("ANY_OF", 1, 3, 0, 0, False), ("ALL_OF", 1, 3, 2, 0, False), ("ALL_OF", 1, 3, 3, 0, True), ("AT_LEAST_N", 2, 3, 1, 0, False), ("AT_LEAST_N", 2, 3, 2, 0, True), ("ANY_OF", 1, 3, 0, 1, None), ("ANY_OF", 1, 0, 0, 0, True)]
    df = spark.createDataFrame(rows, "mode string, need int, members int, have int, open int, want boolean")
    got = df.select(C.group_truth(*(F.col(c) for c in ("mode", "need", "members", "have", "open"))).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_scopes_and_traversal(spark):
    tree = spark.createDataFrame([("in", None), ("gj", "in"), ("ah", "gj"), ("x", "lost")], "id string, parent_id string")
    assert sorted(map(tuple, graphs.closure(tree).filter("id in ('ah', 'x')").collect())) == [("ah", "ah", 0), ("ah", "gj", 1), ("ah", "in", 2), ("x", "x", 0)]
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    assert sorted(map(tuple, graphs.reached(edges, spark.createDataFrame([("a",)], "id string"), 5).collect())) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_cycles_are_left_after_peeling(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("y", "z"), (None, "a")], "src string, dst string")
    assert sorted(map(tuple, graphs.cyclic(edges).collect())) == [("a", "b"), ("b", "c"), ("c", "a")]
    assert graphs.cyclic(edges.filter("src <> 'c'")).collect() == [] == graphs.cyclic(edges.limit(0)).collect()


def test_upsert_keeps_other_rows(spark):
    stored, seed = spark.createDataFrame([(1, "old"), (2, "old")], "id int, v string"), spark.createDataFrame([(2, "new"), (3, "new")], "id int, v string")
    assert sorted(map(tuple, tables.upserted(stored, seed, ["id"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]


def test_text_functions(spark):
    df = spark.createDataFrame([("Rs. 20/- ફી", "**Bold** [link](http://x) <b>a</b>\n- item", "https://www.Ex.org/a/?utm_source=x&q=1#f")], "a string, b string, u string")
    r = df.select(T.tokens(F.col("a")).alias("a"), T.norm(F.col("b")).alias("b"), T.clean_url(F.col("u")).alias("u"), T.host(F.col("u")).alias("h")).first()
    assert r.a == ["rs", "20", "ફી"] and r.b == "bold link a item" and r.u == "https://www.ex.org/a?q=1" and r.h == "ex.org"


def test_bundles_and_ledgers(spark, tmp_path):
    bundle = {"id": "demo", "nodes": [{"id": "service:a", "type": "SERVICE", "name": "A"}], "edges": [{"id": "e1", "from": "service:a", "to": "b", "type": "REQUIRES"}], "sources": [], "requirementGroups": []}
    (tmp_path / "g").mkdir()
    (tmp_path / "g/demo.json").write_text(json.dumps(bundle, indent=1))
    (tmp_path / "g/jurisdictions.json").write_text("[]")
    got = tables.bundles(spark, str(tmp_path / "g")).select("bundle", F.col("nodes")[0]["name"], F.col("edges")[0]["to"]).collect()
    assert [tuple(r) for r in got] == [("demo", "A", "b")]
    (tmp_path / "l.jsonl").write_text('{"k": 1, "v": "a", "t": 1}\nbroken\n{"k": 1, "v": "b", "t": 2}\n')
    assert [(r.k, r.v) for r in tables.ledger(spark, str(tmp_path / "l.jsonl"), "k int, v string, t int", "k", "t").collect()] == [(1, "b")]


def test_bounded_top_same_as_full_ranking(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    weights = [60 / (k + 1) for k in range(60)]
    text = lambda n: " ".join(rnd.choices(words, weights, k=n))
    docs = spark.createDataFrame([(k, text(rnd.randrange(1, 40)), k % 3 == 0) for k in range(150)] + [(900, None, True), (901, "", False)], "doc_id int, text string, odd boolean")
    queries = spark.createDataFrame([(k, text(rnd.randrange(1, 15))) for k in range(12)] + [(90, "nowhere to be found"), (91, None)], "item_id int, text string")
    told = lambda df: sorted((r.item_id, r.doc_id, r["rank"], round(r.score, 6)) for r in df.collect())
    for k in (1, 5, 500):
        for keep in (None, F.col("odd")):
            assert told(search.bm25_top(docs, queries, k, keep, seeds=2)) == told(search.ranked(search.bm25(docs, queries, keep), k))
    assert search.bm25_top(docs.limit(0), queries, 3).collect() == []


def test_scores_where_a_document_lies_are_those_of_the_joins(spark, monkeypatch):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    text = lambda n: " ".join(rnd.choices(words, [50 / (k + 1) for k in range(50)], k=n))
    same = text(20)
    docs = spark.createDataFrame([(k, same if k % 2 else text(rnd.randrange(1, 40))) for k in range(300)] + [(None, same), (900, None), (901, "")], "doc_id bigint, text string").repartition(7)
    queries = spark.createDataFrame([(f"q{k}", text(12)) for k in range(20)] + [("q0", text(9)), (None, "w1 w2"), ("none", "nowhere")], "item_id string, text string")
    told = lambda df: sorted(((str(r.item_id), str(r.doc_id), r["rank"], round(r.score, 6)) for r in df.collect()))
    seen = {k: told(search.ranked(search.bm25(docs, queries), k)) for k in (1, 7, 1000)}
    monkeypatch.setattr(search, "_weighed", None)  # the joins aren't needed for a few queries
    monkeypatch.setattr(search, "CELLS", 100)
    for k, rows in seen.items():
        assert told(search.bm25_top(docs, queries, k)) == rows


def test_few_texts_are_normalised_once_and_unmarked_only_where_marked(spark):
    texts = ["plain  text\n here", "a • b", "\n - item one", "- top", "x—y", "“q” ’s", "[a](b) *c*", "a 　b", "\r\n+ z", "\x85- n", "a﻿b", "<b>x</b>", " ", "", None, "tab\tend\t", "\x0b\x1c", "a-b\n-c", " • k"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    every = F.col("t")
    for pattern, to in T.UNMARK:
        every = F.regexp_replace(every, pattern, to)
    assert df.filter(~T.norm(F.col("t")).eqNullSafe(F.lower(F.trim(every)))).isEmpty()
    docs = spark.createDataFrame([(1, "so it goes on and on for ever"), (2, None)], "doc_id int, text string")
    items = spark.createDataFrame([(5, "it goes  on and on")], "item_id int, text string")
    found = search.contained(docs, items)
    assert [tuple(r) for r in found.collect()] == [(1, 5)]
    assert search.contained(docs, items)._jdf.queryExecution().optimizedPlan().toString().count("{0,200}") == 1
