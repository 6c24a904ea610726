from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gritstone.operators.layout import COLUMN, ROW, laid_out, topological


def ordered(spark, nodes, pairs):
    n = spark.createDataFrame([(1, x, i) for i, x in enumerate(nodes)], "request_id int, node string, place int")
    p = spark.createDataFrame([(1, *x) for x in pairs], "request_id int, before string, after string")
    got = sorted(topological(n, p).collect(), key=lambda r: r.ord)
    assert [r.ord for r in got] == list(range(1, len(nodes) + 1))
    return [r.node for r in got], {r.node for r in got if r.unordered}


@pytest.mark.parametrize(
    ("nodes", "pairs", "order", "stuck"),
    [
        ("dl", [("l", "d")], "ld", ""),
        ("cab", [], "cab", ""),
        ("ab", [("a", "b"), ("a", "b")], "ab", ""),
        ("ab", [("a", "b"), ("b", "a")], "ab", "ab"),
        ("edcba", [("a", "e"), ("b", "d")], "cbdae", ""),  # b frees d, which came before a
        ("xabc", [("a", "b"), ("b", "a"), ("b", "c"), ("c", "zz"), ("zz", "x")], "xabc", "abc"),
        ("ab", [("a", "a")], "ba", "a"),
    ],
)
def test_orders(spark, nodes, pairs, order, stuck):
    assert ordered(spark, list(nodes), pairs) == (list(order), set(stuck))


def drawn(spark, nodes, edges, root):
    n = spark.createDataFrame([(1, x, i) for i, x in enumerate(nodes)], "request_id int, node string, place int")
    e = spark.createDataFrame([(1, *x) for x in edges], "request_id int, src string, dst string")
    return {r.node: r for r in laid_out(n, e, spark.createDataFrame([(1, root)], "request_id int, root string")).collect()}


def test_columns_rows_and_centres(spark):
    got = drawn(spark, "gabcd", [("g", "a"), ("g", "b"), ("a", "c"), ("g", "c"), ("c", "g"), ("c", "c"), ("q", "a")], "g")
    assert {n: r.col for n, r in got.items()} == {"g": 0, "a": 1, "b": 1, "c": 2, "d": 0}
    assert got["c"].x == 2 * COLUMN and got["c"].y == (0 + 0.5) * ROW and {got["g"].row, got["d"].row} == {0, 1}
    cycle = drawn(spark, "gabc", [("g", "a"), ("a", "b"), ("b", "c"), ("c", "b")], "g")
    assert {n: r.col for n, r in cycle.items()} == {"g": 0, "a": 1, "b": 3, "c": 3}  # past the widest column, b's first guess of 2 among them


def test_turns_leave_fewer_crossings(spark):
    rnd = random.Random(4)
    less = more = 0
    for _ in range(6):
        left, right = [f"l{k}" for k in range(8)], [f"r{k}" for k in range(8)]
        mate = rnd.sample(right, 8)
        edges = [*(("root", x) for x in left), *zip(left, mate, strict=True)]
        got = drawn(spark, ["root", *left, *right], edges, "root")

        def crossings(place):
            e = [(place[a], place[b]) for a, b in zip(left, mate, strict=True)]
            return sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for i, a in enumerate(e) for b in e[:i])

        after, before = crossings({n: r.row for n, r in got.items()}), crossings({n: int(n[1:]) for n in (*left, *right)})
        assert sorted(got[x].row for x in left) == list(range(8))
        less, more = less + (after < before), more + (after > before)
    assert less == 6 and not more


def test_many_requests_share_a_call(spark):
    n = spark.range(2500).selectExpr("id as request_id", "explode(array('a', 'b', 'c')) as node", "1 as place")
    p = spark.range(2500).selectExpr("id as request_id", "if(id % 2 = 0, 'c', 'b') as before", "'a' as after").withColumn("src", F.col("before")).withColumn("dst", F.col("after"))
    order = topological(n, p)
    plot = laid_out(n, p.select("request_id", "src", "dst"), spark.createDataFrame([(0, "a")], "request_id bigint, root string"))
    for told in (order, plot):  # a call into Python for each request took most of the time
        assert "CoGroup" not in told._jdf.queryExecution().toString()
    got = {r.request_id: r.nodes for r in order.orderBy("ord").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("ord", "node")))["node"].alias("nodes")).collect()}
    assert got == {k: list("bca") if k % 2 == 0 else list("bac") for k in range(2500)}
    cols = plot.filter("node = 'a'").groupBy("col").agg(F.collect_set("request_id").alias("of")).collect()
    assert {r.col: len(r.of) for r in cols} == {0: 1, 1: 2499}
