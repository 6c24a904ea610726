from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from gritstone.sources.jdbc import graph_tables, whole_table


@pytest.fixture(scope="module")
def url(spark):
    """An embedded database, in this process alone."""
    return f"jdbc:derby:{tempfile.mkdtemp(prefix='spark-derby-')}/db;create=true"


def stored(df, url, name):
    df.write.jdbc(url, name, mode="overwrite", properties={"createTableColumnTypes": ", ".join(f"{c} VARCHAR(200)" for c, t in df.dtypes if t == "string")} if any(t == "string" for _, t in df.dtypes) else {})


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_dense_sparse_text_and_null_keys(spark, sf, url):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    tables = {
        "dense": orders.withColumnRenamed("o_orderkey", "id"),
        "sparse": orders.withColumn("id", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") * F.col("o_orderkey") - 5000)).drop("o_orderkey"),
        "texts": orders.withColumn("id", F.concat(F.lit("it's "), F.md5(F.col("o_orderkey").cast("string")))).drop("o_orderkey"),
        "hot": orders.withColumn("id", F.when(F.col("o_orderkey") % 3 > 0, "same").otherwise(F.concat(F.lit("k"), "o_orderkey"))).drop("o_orderkey"),
    }
    for name, df in tables.items():
        stored(df, url, name)
        got = whole_table(spark, url, name, "id", part_rows=200)
        got = got.toDF(*(c.lower() for c in got.columns)).select(df.columns)
        assert same(got, df), name
        sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(sizes) >= (2 if name == "hot" else 5)
        if name != "hot":
            assert max(sizes) < 3 * 200 + (name == "sparse") * 200  # null keys are in the first part


def test_small_empty_and_one_valued(spark, url):
    for name, rows in (("tiny", [(1, 2)]), ("nothing", []), ("one_valued", [(7, k) for k in range(50)]), ("all_null", [(None, k) for k in range(50)])):
        df = spark.createDataFrame(rows, "id int, v int")
        stored(df, url, name)
        got = whole_table(spark, url, name, "id", part_rows=10)
        assert same(got.toDF("id", "v"), df)


def test_filters_and_columns_reach_the_database(spark, url, capsys):
    stored(spark.range(2000).select(F.col("id"), (F.col("id") % 7).alias("v"), F.lit("x").alias("w")), url, "pushed")
    got = whole_table(spark, url, "pushed", "id", part_rows=500)
    got.filter(F.col(got.columns[1]) == 3).select(got.columns[0]).explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters" in plan and "EqualTo" in plan and "*" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert "W" not in plan.split("ReadSchema")[1].split("\n")[0].upper().replace("STRUCT", "")


def test_tables_of_a_graph(spark, url):
    for name, key in (("nodes", "id"), ("questions", "field")):
        stored(spark.createDataFrame([(f"{name}{k}", k) for k in range(30)], f"{key} string, v int"), url, name)
    got = graph_tables(spark, url, {"nodes": "id", "questions": "field"}, part_rows=10)
    assert {n: df.count() for n, df in got.items()} == {"nodes": 30, "questions": 30}
    assert all(df.rdd.getNumPartitions() >= 2 for df in got.values())
