from __future__ import annotations

from pyspark.sql import functions as F

from gritstone.operators import retrieval as R
from gritstone.plans import catalogue


def test_topicality_by_words_that_were_split_once(spark, sf):
    rows = [("Income certificate", "https://a.b/x", "a.b"), ("other", "https://a.b/income/certificate", "a.b"), ("other", "https://own/1", "own"), (None, "https://c.d/1", "c.d")]
    df = spark.createDataFrame(rows, "heading string, url string, host string")
    own = F.array(F.array(F.lit("income"), F.lit("certificate"))), F.array(F.lit("https://own/1")), F.array(F.lit("own"))
    by_words = R.topicality_of(R.tokens(F.col("heading")), R.tokens(F.col("url")), F.col("url"), F.col("host"), *own)
    assert [tuple(r) for r in df.select(R.topicality(F.col("heading"), F.col("url"), F.col("host"), *own), by_words).collect()] == [(2, 2), (1, 1), (3, 3), (0, 0)]
    assert not any("documents" in f for f in catalogue.queries()["q_retrieve"](spark, sf).inputFiles())  # no text is split again for what was found
