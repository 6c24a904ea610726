from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gritstone.functions import names as N
from gritstone.operators import naming as O

WORDS = ["lake", "permit", "boat", "online", "system", "scheme", "form"]


def test_longest_match_same_as_trying_all(spark):
    rnd = random.Random(2)
    patterns = list(dict.fromkeys("".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 5))) for _ in range(20)))
    texts = ["".join(rnd.choice("aab -.C9") for _ in range(rnd.randrange(14))) for _ in range(80)] + ["", None]
    dictionary = spark.createDataFrame([(p, f"code {p}", i) for i, p in enumerate(patterns)], "pattern string, code string, place int")
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    first = sorted(patterns, key=lambda p: -len(p))
    for whole in (True, False):

        def hit(t):
            low = t.lower()
            words = "".join(c if "a" <= c <= "z" else " " for c in low).split()
            flat = "".join(words)
            return next((f"code {p}" for p in first if (p in words if whole else p in flat)), None)

        want = {t: hit(t) for t in texts if t is not None and hit(t)}
        assert {r.text: r.code for r in O.longest_match(df, dictionary, whole).collect()} == want and want


def absorbs(short, long):
    return short != long and long.startswith(short + "_") and all(w in O.SAME_SERVICE for w in long[len(short) + 1 :].split("_"))


def fold(ids):
    """One after another, the longest first, as somebody would by hand."""
    left, into = dict.fromkeys(ids), {}
    by_length = sorted(ids, key=lambda i: -len(i))
    for short in by_length:
        target = next((x for x in by_length if absorbs(short, x) and x in left), None)
        if target:
            into[short] = target
            del left[short]
    heads = set()
    for i in left:
        if "_" not in i:
            rest = [[w for w in x.split("_") if w not in O.SAME_SERVICE] for x in left if x != i]
            if sum(len(r) > 1 and i in r for r in rest) >= 2:
                heads.add(i)
    return into, set(left) - heads, heads


def test_absorption_and_headings_same_as_by_hand(spark):
    rnd = random.Random(6)
    for _ in range(4):
        ids = list(dict.fromkeys("_".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 5))) for _ in range(40)))
        into, stay, heads = fold(ids)
        rows = [("j", i, i.replace("_", " ").title(), f"alias {k}", f"p{k}", k) for k, i in enumerate(ids)]
        services, over = O.grouped_services(spark.createDataFrame(rows, "journey string, id string, name string, alias string, page string, place int"))
        got = {r.id: r for r in services.collect()}
        assert set(got) == stay and {r.id for r in over.collect()} == heads
        for short, long in into.items():
            if long in stay:
                assert short.replace("_", " ") in got[long].aliases and f"alias {ids.index(short)}" in got[long].aliases
        assert sum(r.pages for r in got.values()) == len(ids) - len(heads) - sum(v in heads for v in into.values())


def test_names_of_bodies(spark):
    cases = [
        ("Website Visits 583", "-::-Lake Health Mission :: Govt", "-::-Lake Health Mission :: Govt"),
        ("Food and Drugs Control", "FDCA", "Food and Drugs Control"),
        ("", "Home | Garvi", "Garvi"), ("Banner", "Home | Garvi", "Garvi"), ("", "", None), (None, None, None), ("12345", "abc", None), ("યોજના માહિતી", "", "યોજના માહિતી"), ("x" * 121, "Lake", "Lake"),
    ]
    df = spark.createDataFrame([(k, h, t) for k, (h, t, _) in enumerate(cases)], "k int, h string, t string")
    assert [r.n for r in df.select("k", N.read_name(F.col("h"), F.col("t")).alias("n")).orderBy("k").collect()] == [c[2] for c in cases]


def test_types_names_and_labels(spark):
    kinds = {"District Panchayat, Lake": "District Panchayat", "Taluka Panchayat": "Taluka Panchayat", "Lake Gram Panchayat": "Gram Panchayat", "RTO Lake": "Regional Transport Office", "Courtyard": "Court", "Lake": None}
    df = spark.createDataFrame([(k,) for k in kinds], "n string")
    assert {r.n: r.t for r in df.select("n", N.office_type(F.col("n")).alias("t")).collect()} == kinds
    rows = [({"name": "Dr. Vale", "institute": " Lake \n House"}, None, "x", "Lake House", "EXTRACTED"), ({"name": "Address"}, "jan_seva_kendra", "x", "Jan seva kendra", "EXTRACTED"), ({}, "lake", "Forms | Jan Seva Kendra", "Jan Seva Kendra", "NORMALIZED"), (None, None, None, None, None)]
    df = spark.createDataFrame([(k, *r[:3]) for k, r in enumerate(rows)], "k int, d map<string,string>, o string, t string").select("k", N.name_of(F.col("d"), F.col("o"), F.col("t")).alias("x")).orderBy("k")
    assert [(r.x and r.x.name, r.x and r.x.status) for r in df.collect()] == [r[3:] for r in rows]
    labels = {"IN": "India", "IN-GJ": "Gujarat", "IN-GJ-GIR_SOMNATH": "Gir Somnath district, Gujarat", "IN-MH": "IN-MH"}
    df = spark.createDataFrame([(k,) for k in labels], "s string")
    assert {r.s: r.x for r in df.select("s", N.scope_label(F.col("s")).alias("x")).collect()} == labels


def test_ids_that_people_own(spark):
    nodes = spark.createDataFrame([("service:nsp", "SERVICE", "NSP", None, ["Scholarship's", ""]), ("service:boat", "OFFICE", "Permit", None, None)], "id string, type string, name string, official string, aliases array<string>")
    mine = spark.createDataFrame([("nsp",), ("scholarship",), ("boat",), ("permit",), ("lake",)], "id string")
    assert {r.id for r in O.unprotected(mine, nodes).collect()} == {"permit", "lake"}


def test_asks_only_for_new_phrases_and_stops_at_one_half(spark):
    cache = spark.createDataFrame([("a card", True, 1), ("name", False, 1), ("old", True, 0)], "phrase string, document boolean, version int")
    wanted = spark.createDataFrame([("a card",), ("name",), ("old",), ("slip",), ("slip",)], "phrase string")
    seen, kept = [], []

    def ask(asked):
        seen.extend(sorted(r.phrase for r in asked.collect()))
        return spark.createDataFrame([("slip", True), ("never asked", True)], "phrase string, document boolean")

    def keep(fresh):
        kept.extend(map(tuple, fresh.collect()))
        return fresh

    got = {r.phrase: r.document for r in O.classified(wanted, cache, 1, ask, keep).collect()}
    assert got == {"a card": True, "name": False, "old": None, "slip": True} and seen == ["old", "slip"] and kept == [("slip", True, 1)]
    with pytest.raises(O.Unclassified):
        O.classified(wanted, cache, 1, lambda asked: asked.withColumn("document", F.lit(None).cast("boolean")), keep)
    assert O.classified(wanted.limit(0), cache, 1, ask, keep).collect() == []


def test_searches(spark):
    services = spark.createDataFrame([("s1", "Varsai Certificate For Legal Heirs", "IN-GJ", ["bad", "https://collectorkheda.gov.example/v"]), ("s2", "fee_receipt", None, None), ("s3", " ", None, None)], "service_id string, name string, scope_id string, urls array<string>")
    dictionary = spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(N.district_patterns())], "pattern string, code string, place int")
    scopes = O.service_scopes(services, dictionary, N.ROOT)
    assert {r.service_id: r.scope for r in scopes.collect()} == {"s1": "IN-GJ-KHEDA", "s2": None, "s3": None}
    edges = spark.createDataFrame([("s1", "p", 0), ("s1", "o", 1), ("s1", "q", 2)], "src string, dst string, place int")
    nodes = spark.createDataFrame([("p", "PORTAL", "Gate", None), ("o", "OFFICE", "lake_desk", None), ("q", "OFFICE", "Other", None)], "id string, type string, name string, official string")
    missing = services.select("service_id", "name", F.explode(F.array(F.lit("OFFICE"), F.lit("FEE"))).alias("dimension"))
    got = O.queries_for(missing, scopes, O.neighbours(edges, nodes), {"OFFICE": ["office", "कार्यालय"], "FEE": ["fee"]}).orderBy("service_id", "dimension", "place").collect()
    k = "IN-GJ-KHEDA"
    long = "Varsai Certificate For Legal Heirs"
    assert [(r.service_id, r.dimension, r.place, r.query, r.scope) for r in got] == [
        ("s1", "FEE", 1, f"{long} fee", k), ("s1", "FEE", 2, f"{long} fee", None), ("s1", "FEE", 3, "lake desk Varsai Certificate Legal Heirs fee", k), ("s1", "FEE", 4, "Varsai Certificate Legal Heirs fee", k),
        ("s1", "OFFICE", 1, f"{long} office", k), ("s1", "OFFICE", 2, f"{long} office", None), ("s1", "OFFICE", 3, f"{long} कार्यालय", k), ("s1", "OFFICE", 4, "lake desk Varsai Certificate Legal Heirs office", k), ("s1", "OFFICE", 5, "Varsai Certificate Legal Heirs office", k),
        ("s2", "FEE", 1, "fee receipt fee", None), ("s2", "OFFICE", 1, "fee receipt office", None), ("s2", "OFFICE", 2, "fee receipt कार्यालय", None),
    ]
    with pytest.raises(ValueError):
        O.queries_for(missing, scopes, O.neighbours(edges, nodes), {"FEE": ["fee"]})
