from __future__ import annotations

import json

from pyspark.sql import functions as F

from gritstone.functions import chunks, fields as X, text as T
from gritstone.operators import conditions as C, graphs, journeys as J, ledgers as L, validation as V
from gritstone.operators.programs import PROGRAM, evaluated, program, programs

REQUEST = "request_id string, goal string, chain array<string>, facts map<string,string>"
EDGE = f"id string, src string, dst string, type string, scope string, program {PROGRAM}, status string, valid_until date"
GROUP = f"id string, owner string, mode string, need int, scope string, program {PROGRAM}"
MEMBER = f"group_id string, node string, program {PROGRAM}"


def test_malformed_conditions_are_unknown(spark):
    df = spark.createDataFrame([("NaN", "ab", ["X", "y"]), ("25", "a", [])], "age string, b string, many array<string>")
    facts = {"age": F.col("age"), "b": F.col("b"), "many": F.col("many")}
    told = lambda t: [r[0] for r in df.select(C.truth(C.condition(t, facts, frozenset(["many"])))).collect()]
    assert told({"field": "age", "operator": "GTE", "value": 18}) == ["UNKNOWN", "TRUE"]
    for bad in ({"field": "b", "operator": "IN", "value": "ab"}, {"field": "b", "operator": "IN", "value": 3}, {"operator": "EQ", "value": 1}, {"field": "b", "operator": "NEAR", "value": 1}, {"field": "age", "operator": "GT", "value": "much"}, {"all": 3}, "text"):
        assert told(bad) == ["UNKNOWN"] * 2, bad
    assert told({"field": "many", "operator": "IN", "value": ["x"]}) == ["TRUE", "FALSE"] and told({"field": "b", "operator": "IN", "value": ["A"]}) == ["FALSE", "TRUE"]


def test_programs_agree_with_conditions(spark):
    trees = [None, {"all": []}, {"any": []}, {"field": "a", "operator": "GTE", "value": 18}, {"not": {"field": "a", "operator": "EQ", "value": "x"}}, {"all": [{"field": "a", "operator": "GT", "value": 1}, {"any": [{"field": "b", "operator": "IN", "value": ["Q"]}, {"field": "c", "operator": "EXISTS"}]}]}, {"field": "a", "operator": "IN", "value": 5}, {"any": [{"field": "b", "operator": "NEQ", "value": "q"}, {"field": "z", "operator": "LT", "value": 3}]}]
    rows = [("20", "q"), ("x", None), (None, "r"), ("Infinity", "Q")]
    df = spark.createDataFrame([(i, json.dumps(t) if t is not None else None, a, b) for i, t in enumerate(trees) for a, b in rows], "i int, tree string, a string, b string")
    got = df.select("i", "a", "b", evaluated(programs(F.col("tree")), F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("t")).collect()
    facts = {"a": F.col("a"), "b": F.col("b"), "c": F.lit(None).cast("string")}
    for i, t in enumerate(trees):
        want = [(r[0], r[1]) for r in spark.createDataFrame(rows, "a string, b string").select(C.condition(t, facts), C.unresolved(t, facts)).collect()]
        assert [(r.t.truth, r.t.pending) for r in got if r.i == i] == want, t


def test_edges_apply_by_scope_status_and_truth(spark):
    chain, facts, asks = ["s", "c"], {"age": "20"}, program({"field": "age", "operator": "GTE", "value": 18})
    open_ = program({"field": "x", "operator": "EQ", "value": 1})
    rows = [("state", "s", asks, None, None), ("all", None, [], None, None), ("other", "t", [], None, None), ("no", None, program({"field": "age", "operator": "LT", "value": 18}), None, None), ("open", "c", open_, None, None), ("rejected", None, [], "REJECTED", None)]
    df = spark.createDataFrame([(i, s, p, st, v, chain, facts) for i, s, p, st, v in rows], f"id string, scope string, program {PROGRAM}, status string, valid_until date, chain array<string>, facts map<string,string>")
    got = {r.id: (r.truth, r.specificity, r.pending) for r in J.filtered(df, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"state": (True, 2, []), "all": (True, 0, []), "open": (None, 1, ["x"])}


def test_expansion_groups_and_order(spark):
    asked = spark.createDataFrame([("r", "a", ["s"], {}), ("h", "a", ["s"], {})], REQUEST)
    nodes = spark.createDataFrame([(x, "DOCUMENT" if x != "maker" else "SERVICE", None) for x in ("a", "b", "c", "d", "g", "m1", "m2", "maker")], "id string, type string, scope string")
    edge = lambda i, s, t, kind="REQUIRES": (i, s, t, kind, None, [], None, None)
    edges = spark.createDataFrame([edge("1", "a", "b"), edge("2", "a", "c"), edge("3", "b", "d"), edge("4", "c", "d"), edge("5", "d", "a"), edge("6", "a", "g"), edge("7", "maker", "m1", "PRODUCES"), edge("8", "b", "lost")], EDGE)
    groups = spark.createDataFrame([("G", "g", "ANY_OF", None, None, [])], GROUP)
    members = spark.createDataFrame([("G", "m1", []), ("G", "m2", [])], MEMBER)
    held = J.held_closure(asked, spark.createDataFrame([("h", "m2"), ("h", "b")], "request_id string, node string"), groups, members)
    assert sorted(map(tuple, held.collect())) == [("h", "b"), ("h", "g"), ("h", "m2")]
    reached, used = J.expand(asked, nodes, edges, groups, members, held, F.lit("2024-01-01").cast("date"))
    got = {}
    for r in reached.collect():
        got.setdefault(r.request_id, {})[r.node] = r.depth
    assert got == {"r": {"a": 0, "b": 1, "c": 1, "g": 1, "d": 2, "m1": 2, "m2": 2, "maker": 3}, "h": {"a": 0, "b": 1, "c": 1, "g": 1, "d": 2}}
    assert {r.id for r in used.filter("request_id = 'r'").collect()} == {"1", "2", "3", "4", "5", "6", "7", "8", "rg:G:m1", "rg:G:m2"}
    pairs = J.order_pairs(used.filter("request_id = 'h' and id <> '5'"))
    layers = {r.node: r.layer for r in J.layered(reached.filter("request_id = 'h'").withColumn("ord", F.col("node")), pairs).collect()}
    assert layers == {"a": 2, "b": 0, "c": 1, "d": 0, "g": 0}
    ring = {r.node: r.layer for r in J.layered(reached.filter("request_id = 'r'").withColumn("ord", F.col("node")), J.order_pairs(used.filter("request_id = 'r'"))).collect()}
    assert ring["a"] is None and ring["d"] is None and ring["maker"] == 0


def test_scopes_without_end(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), *((f"x{k}", f"x{k + 1}") for k in range(20)), ("x20", None)], "id string, parent_id string")
    got = graphs.closure(ring)
    assert sorted((r.ancestor_id, r.distance) for r in got.filter("id = 'a'").collect()) == [("a", 0), ("b", 1), ("c", 2)]
    assert got.filter("id = 'x0'").agg(F.max("distance")).first()[0] == 20


def test_page_functions(spark):
    page = """<html><head><title>Income &amp; &#67;ert</title><meta content='two  words' name="description"></head><body><h1>Office</h1><script>var x = "<h1>no</h1>"</script>
    <a href='/a?x=1#top'>One &lt;b&gt;</a><a class="k" href="b/c">Two</a><a href="/a?x=1">again</a><a href="mailto:x@y.z">m</a><a href="#f">f</a><a href="//o.org/p">Three</a></body></html>"""
    r = spark.createDataFrame([(page, "http://h.org/d/e?q=1")], "html string, url string").select(
        T.anchors(F.col("html"), F.col("url")).alias("a"), T.element(T.bare(F.col("html")), "title").alias("t"), T.element(T.bare(F.col("html")), "h1").alias("h"), T.description(F.col("html")).alias("d"), T.soft_404(F.col("html")).alias("s")
    ).first()
    assert [(x.url, x.title) for x in r.a] == [("http://h.org/a?x=1", "One <b>"), ("http://h.org/d/b/c", "Two"), ("http://o.org/p", "Three")]
    assert (r.t, r.h, r.d, r.s) == ("Income & Cert", "Office", "two words", False)
    short = spark.createDataFrame([("<p>Sorry, not found</p>",), ("<title>404</title>",), ("<p>welcome</p>",)], "html string").select(T.soft_404(F.col("html"))).collect()
    assert [x[0] for x in short] == [True, True, False]


def test_verbatim_normaliser(spark):
    cases = {r"a\_b \*c\* 5 < 6 and 7 > 2": "ab c 5 < 6 and 7 > 2", "+ one\n• two​’s": "one two's", "x<br>y <B class='k'>z</B>": "x y z", "  A　b ": "a b"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(T.norm(F.col("t"))).collect()] == list(cases.values())


def test_passages_are_slices(spark):
    text = "\n".join(["# Fees", "| a | b |", *["| 1 | 2 |"] * 400, "", "Who can apply", "Anyone who lives in the district and has an income. " * 8, "x" * 250, "Step 1 do it", "word " * 700])
    got = chunks.passages(text)
    assert [h for _, _, h in got][0] == "Fees" and any("| a | b |" in text[a:b] and text[a:b].count("| 1 | 2 |") == 400 for a, b, _ in got)
    assert not any("x" * 200 in text[a:b] for a, b, _ in got) and chunks.passages("") == chunks.passages(None) == chunks.passages(" \n ") == []
    plain = "Para one here.\n\n" * 300
    whole = chunks.passages(plain)
    assert "".join(plain[a:b] for a, b, _ in whole) == plain and all(b - a <= 2250 for a, b, _ in whole)
    df = spark.createDataFrame([(1, plain), (2, None)], "page_id int, text string")
    assert [r.text for r in chunks.chunked(df).orderBy("chunk_no").collect()] == [plain[a:b] for a, b, _ in whole]


def test_keyed_hash_and_details(spark):
    import hashlib
    import hmac

    r = spark.createDataFrame([("+91 98", {"a": "૧૨", "b": "", "c": None})], "p string, d map<string,string>").select(X.hmac_sha256(F.col("p"), b"key").alias("h"), X.sane(F.col("d")).alias("d")).first()
    assert r.h == hmac.new(b"key", "+91 98".encode(), hashlib.sha256).hexdigest() and r.d == {"a": "12"}


def test_budget_never_falls_below_nothing(spark):
    rows = [("k", i, a) for i, a in enumerate([5, -9, 3, 4, -2])]
    got = L.clamped_balance(spark.createDataFrame(rows, "k string, i int, amount bigint"), ["k"], ["i"]).orderBy("i").collect()
    assert [r.spent for r in got] == [5, 0, 3, 7, 5]


def test_sound_graph_has_no_issues(spark):
    nodes = spark.createDataFrame([("service:a", "SERVICE", None, [], None), ("doc:b", "PAYMENT", "in", [], None)], f"id string, type string, scope string, program {PROGRAM}, store_id string")
    edges = spark.createDataFrame([("e:1", "service:a", "doc:b", "REQUIRES", None, [], "VERIFIED", None, None)], f"id string, src string, dst string, type string, scope string, program {PROGRAM}, status string, valid_from date, valid_until date")
    groups = spark.createDataFrame([], f"id string, owner string, mode string, need int, program {PROGRAM}")
    refs = spark.createDataFrame([("node", "service:a", "s", "words", 0.5, None)], "kind string, subject string, source_id string, evidence string, confidence double, status string")
    places = spark.createDataFrame([("in", None, "COUNTRY")], "id string, parent_id string, level string")
    sources = spark.createDataFrame([("s", "https://x")], "id string, url string")
    members = spark.createDataFrame([], "group_id string, node string")
    assert V.graph_issues(nodes, edges, groups, members, sources, refs, places).collect() == []
    bad = V.graph_issues(nodes, edges.union(edges), groups, members, sources, refs.withColumn("confidence", F.lit(None).cast("double")), places).collect()
    assert {(r.code, r.subject) for r in bad} == {("DUPLICATE_EDGE", "e:1"), ("BAD_CONFIDENCE", "service:a")}


def test_an_alias_of_many_services_leads_to_the_first(spark):
    services = spark.range(2000).selectExpr("concat('s', id) as id", "2000 - id as ord", "concat('Service ', id) as name", "array('Town', null) as aliases")
    asked = spark.range(3000).selectExpr("id as request_id", "case id % 4 when 0 then 'town' when 1 then 'nobody' when 2 then concat('service ', id % 7) end as name")
    told = graphs.named_goal(asked, services, [])
    assert "Aggregate" not in told._jdf.queryExecution().optimizedPlan().toString()  # names are looked up before requests come in, not for each request
    got = {tuple(r) for r in told.collect()}
    want = {0: ("s1999", 4), 1: (None, None), 3: (None, None)}
    assert got == {(k, *(want[k % 4] if k % 4 != 2 else (f"s{k % 7}", 3))) for k in range(3000)}


def test_edges_are_read_once_and_conditions_answered_once_a_request(spark, monkeypatch):
    asked = spark.createDataFrame([("r", "a", ["s"], {"age": "20"}), ("q", "a", ["s"], {})], REQUEST)
    nodes = spark.createDataFrame([(x, "DOCUMENT", None) for x in "abcd"], "id string, type string, scope string")
    rule = program({"field": "age", "operator": "GTE", "value": 18})
    rows = spark.createDataFrame([(i, s, t, "REQUIRES", None, p, None, None) for i, s, t, p in (("1", "a", "b", rule), ("2", "b", "c", []), ("3", "c", "d", rule), ("4", "a", "c", rule))], EDGE)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    empty = spark.createDataFrame([], GROUP), spark.createDataFrame([], MEMBER), spark.createDataFrame([], "request_id string, node string")
    for pairs in (J.ANSWERS, 0):  # answered for all requests beforehand, and for the pairs that come up
        monkeypatch.setattr(J, "ANSWERS", pairs)
        read.value = 0
        reached, used = J.expand(asked, nodes, rows.mapInPandas(counted, rows.schema), *empty, F.lit("2024-01-01").cast("date"))
        assert read.value == 4
        assert {(r.request_id, r.id, r.truth, tuple(r.pending)) for r in used.collect()} == {("r", i, True, ()) for i in "1234"} | {("q", i, None, ("age",)) for i in "14"}
        assert {(r.request_id, r.node, r.depth) for r in reached.collect()} == {("r", "a", 0), ("r", "b", 1), ("r", "c", 1), ("r", "d", 2), ("q", "a", 0)}


def test_a_round_of_a_walk_is_few_tables(spark, monkeypatch):
    made = []
    keep = J.cut
    monkeypatch.setattr(J, "cut", lambda df: made.append(1) or keep(df))
    own = "array<struct<op:string,field:string,values:array<string>,arity:int>>"

    def cuts(n):
        """Tables made for a chain of n nodes."""
        made.clear()
        asked = spark.createDataFrame([("r", "n0", ["x"], {})], "request_id string, goal string, chain array<string>, facts map<string,string>")
        nodes = spark.createDataFrame([(f"n{k}", "DOCUMENT", None) for k in range(n)], "id string, type string, scope string")
        edges = spark.createDataFrame([(f"e{k}", f"n{k}", f"n{k + 1}", "REQUIRES", None, [], None, None) for k in range(n - 1)], f"id string, src string, dst string, type string, scope string, program {own}, status string, valid_until date")
        none = (spark.createDataFrame([], f"id string, owner string, mode string, need int, scope string, program {own}"), spark.createDataFrame([], f"group_id string, node string, program {own}"))
        reached, told, _ = J.journeys(asked, nodes, edges, *none, spark.createDataFrame([], "request_id string, node string"), F.lit("2024-01-01").cast("date"))
        assert {r.node: r.depth for r in reached.collect()} == {f"n{k}": k for k in range(n)} and told.count() == n - 1
        return len(made)

    few = cuts(3)
    assert cuts(7) - few <= 4 * 3 + 3  # three walks of one table a round, and some put together; it was six and more a round


def test_what_a_satisfied_group_gives_is_held_within_the_walk(spark):
    own = "array<struct<op:string,field:string,values:array<string>,arity:int>>"
    asked = spark.createDataFrame([("r", "s", ["x"], {})], "request_id string, goal string, chain array<string>, facts map<string,string>")
    nodes = spark.createDataFrame([(n, "DOCUMENT", None) for n in ("s", "a", "b", "c", "d", "e", "far")], "id string, type string, scope string")
    edge = lambda i, a, b: (i, a, b, "REQUIRES", None, [], None, None)
    edges = spark.createDataFrame([edge("1", "s", "a"), edge("2", "a", "far"), edge("3", "s", "d")], f"id string, src string, dst string, type string, scope string, program {own}, status string, valid_until date")
    groups = spark.createDataFrame([("g", "a", "ALL_OF", None, None, []), ("h", "b", "ANY_OF", None, None, []), ("i", "d", "ALL_OF", None, None, [])], f"id string, owner string, mode string, need int, scope string, program {own}")
    members = spark.createDataFrame([("g", "b", []), ("h", "c", []), ("i", "c", []), ("i", "e", [])], f"group_id string, node string, program {own}")
    reached, told, held = J.journeys(asked, nodes, edges, groups, members, spark.createDataFrame([("r", "c"), ("r", "elsewhere")], "request_id string, node string"), F.lit("2024-01-01").cast("date"))
    assert {(r.node, r.depth) for r in reached.collect()} == {("s", 0), ("a", 1), ("d", 1), ("c", 2), ("e", 2)}  # c gives b, and b gives a
    assert {r.id for r in told.collect()} == {"1", "3", "rg:i:c", "rg:i:e"} and {r.node for r in held.collect()} == {"a", "c"}
