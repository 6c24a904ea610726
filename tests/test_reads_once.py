"""Texts are searched once: how often a pattern stands in a plan, and that the cheap tests before it leave results as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.functions import blocks as B, claims as C, sites as S
from gritstone.operators import research as R, validation as V
from gritstone.plans import assembly_queries, catalogue


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def times(df, words):
    return planned(df).count(words)


def test_a_sentence_is_read_once_for_outputs_and_authorities(spark, sf):
    queries = catalogue.queries()
    assert times(queries["q_claim_outputs"](spark, sf), "shall\\s+receive") == 2  # searched, then its phrase taken
    assert times(queries["q_claim_authorities"](spark, sf), "must\\s+be\\s+obtained") == 2


def test_the_assembly_reads_a_sentence_once(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(assembly_queries.A, "kept", lambda df: seen.append(planned(df)) or df)
    assembly_queries._assembled(spark, sf)
    assert len(seen) == 1 and seen[0].count("shall\\s+receive") == 2 and seen[0].count("must\\s+be\\s+obtained") == 2


def test_words_looked_for_first_leave_readings_as_they_are(spark):
    texts = ["THE PERMIT WILL BE ISSUED BY THE LAKE BOARD", "İt is GRANTED by the Lake Board", "the Lake Board Issues it", " A permit card is generated upon it", "An applicant is Granted a Permit Card", "It is verifİed by the Board", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for p in C._MUST:
        rows = rows.withColumn("low", F.lower("s"))
        assert rows.filter(F.col("s").rlike(p) & ~C._reads(F.col("s"), F.col("low"), p)).isEmpty()
    odd = spark.createDataFrame([(t,) for t in (" a ", "\x0b\ta ", "a\n", "  ", "", None, "a \x85", "a  ", "é \r\n", " a")], "s string")
    assert odd.filter(~C.stripped(F.col("s")).eqNullSafe(F.regexp_replace("s", r"^\s+|\s+$", ""))).isEmpty()


def test_states_are_looked_for_only_where_one_is_named(spark):
    texts = ["in west bengal", "West Bengal and Goa", "of Gujarat and Goa", "Uttarakhand", "Goan", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", S.other_state(F.col("s")).alias("x"))
    assert [r.x for r in got.orderBy("i").collect()] == ["West Bengal", None, None, "Uttarakhand", None, None, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("bgujarat") == 1


def test_claims_of_a_case_are_read_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(R, "kept", lambda df: seen.append(df) or df.checkpoint())
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    rows = [(1, None, "A", "h1", "over 5", None, 1), (1, None, "a", "h2", "Over  5", None, 2), (1, "a", "B", "h2", "over 6", "", 3), (2, None, None, None, None, "x", 4), (2, None, None, "h1", "", None, 5)]
    claims = spark.createDataFrame(rows, "case_id int, permission_id string, permission string, host string, trigger string, exemption string, at long")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        calls.add(1)
        return x

    told = R.judged(cases, claims.withColumn("host", counted.asNondeterministic()("host")))
    got = sorted(tuple(r) for r in told.collect())
    assert got == [(1, "CONFLICTING", 3, 1, ["A", "a", "B"]), (2, "VERIFIED", 2, 0, [None]), (3, "UNVERIFIED", 0, 0, [])]
    assert len(seen) == 1 and calls.value == len(rows)


def test_numbered_facts_are_read_once(spark):
    rows = [(1, k, "ACTION", "", f"{k}) Visit desk {k}") for k in (1, 2, 3)] + [(1, 4, "ACTION", "", "3) Pay late"), (2, 1, "ACTION", "", "1) Visit"), (2, 2, "ACTION", "", "3) Visit"), (2, 3, "ACTION", "", "4) Visit"), (3, 1, "ACTION", "", "1) Visit"), (3, 2, "ACTION", "", "2) Which form?"), (3, 3, "ACTION", "", "3) Visit")]
    steps = B.ordered_steps(spark.createDataFrame(rows, "page_id int, fact_id int, kind string, claim string, evidence string"))
    assert sorted(tuple(r) for r in steps.collect()) == [(1, 1, 1, "Visit desk 1"), (1, 2, 2, "Visit desk 2"), (1, 3, 3, "Visit desk 3")]
    assert planned(steps).count("LogicalRDD") == 1


def test_validation_makes_no_cycles_that_it_drops(spark, sf, monkeypatch):
    monkeypatch.setattr(V, "cyclic", lambda pairs: 1 / 0)
    assert not catalogue.queries()["q_validate"](spark, sf).isEmpty()


def test_passages_go_to_python_by_the_hundred(spark, sf):
    plan = catalogue.queries()["q_chunks"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_divergence_normalises_only_texts_that_hold_a_beginning(spark, sf):
    assert "LeftSemi" in planned(catalogue.queries()["q_divergence"](spark, sf))
