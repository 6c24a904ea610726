from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gritstone.operators import retrieval as R
from gritstone.sources import files


def test_json_lines_and_lists(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "x.jsonl")
    assert files.json_lines(spark, path, "k int, v string").collect() == []
    files.write_json_lines(rows, path)
    files.write_json_lines(rows.filter("k = 1"), path, append=True)
    assert sorted(map(tuple, files.json_lines(spark, path, "k int, v string").collect())) == [(1, "a"), (1, "a"), (2, "b")]
    (tmp_path / "u.txt").write_text("http://b # note\n\n# all\nhttp://a\nhttp://b\nhttp://c#frag\n")
    assert [r.url for r in files.url_list(spark, str(tmp_path / "u.txt")).collect()] == ["http://b", "http://a", "http://c#frag"]
    (tmp_path / "r.tsv").write_text("# host\tname\nx.org\tThe X\n")
    assert [tuple(r) for r in files.registry(spark, str(tmp_path / "r.tsv"), "host string, name string").collect()] == [("x.org", "The X")]


def test_files_and_evidence(spark, tmp_path):
    import hashlib

    (tmp_path / "c/d").mkdir(parents=True)
    (tmp_path / "c/d/one.bin").write_bytes(b"abc")
    assert [tuple(r) for r in files.cached_files(spark, str(tmp_path / "c")).collect()] == [("one.bin", 3, hashlib.sha256(b"abc").hexdigest())]
    (tmp_path / "research").mkdir()
    (tmp_path / "research/demo.json").write_text('{"facts": [{"claim": "x"}]}')
    got = files.evidence(spark, str(tmp_path / "research"), "facts array<struct<claim:string>>").collect()
    assert [(r.journey, r.facts[0].claim) for r in got] == [("demo", "x")] and files.evidence(spark, str(tmp_path / "none"), "facts string").collect() == []


def test_a_shrunken_table_is_refused(spark, tmp_path):
    path = str(tmp_path / "o")
    assert files.checked_overwrite(spark.range(10), path) == 10 and files.checked_overwrite(spark.range(8), path) == 8
    with pytest.raises(ValueError):
        files.checked_overwrite(spark.range(6), path)
    assert spark.read.json(path).count() == 8


def test_differences_see_order_of_nothing(spark):
    a = spark.createDataFrame([(1, {"x": 1, "y": 2}), (2, {}), (3, None)], "k int, m map<string,int>")
    b = spark.createDataFrame([({"y": 2, "x": 1}, 1), ({"z": 1}, 2), (None, 4)], "m map<string,int>, k int")
    assert files.differences(a, a, ["k"]).collect() == []
    assert sorted(map(tuple, files.differences(a, b, ["k"]).collect())) == [(2, "CHANGED"), (3, "EXTRA"), (4, "MISSING")]
    assert sorted(r.k for r in files.pruned(a, b, ["k"]).collect()) == [1, 2]


def test_sources_resolve(spark):
    refs = spark.createDataFrame([("n", "s1", 0), ("n", "s9", 1)], "subject string, source_id string, ord int")
    assert [(r.subject, r.url) for r in files.resolved_sources(refs, spark.createDataFrame([("s1", "http://x", "X")], "id string, url string, title string")).collect()] == [("n", "http://x")]


def test_topicality_and_anchors(spark):
    df = spark.createDataFrame([("Fees for Income Certificate", "http://x/a", "x"), ("Other", "http://x/income-certificate", "y"), ("Other", "http://own/", "z"), ("Other", "http://q/", "own"), ("Other", "http://q/", "q")], "heading string, url string, host string")
    phrases = F.array(F.array(F.lit("income"), F.lit("certificate")))
    got = df.select(R.topicality(F.col("heading"), F.col("url"), F.col("host"), phrases, F.array(F.lit("http://own/")), F.array(F.lit("own"))).alias("t"), R.anchors(F.lit("Income Certificate fee"), ["fee"]).alias("a")).collect()
    assert [r.t for r in got] == [2, 1, 3, 1, 0] and got[0].a == ["income", "certificate"]


def test_verdicts_are_freshened(spark):
    lists = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.4)], "question_id int, chunk_id int, score double")
    old = spark.createDataFrame([(1, 7, 3.0, 0.9), (1, 9, 3.0, 0.9)], "question_id int, chunk_id int, relevance double, score double")
    assert sorted(map(tuple, R.freshened(old, lists).collect())) == [(1, 7, 0.5, 3.0), (1, 8, 0.4, None)]
