from __future__ import annotations

import pytest

from gritstone.operators import assembly
from gritstone.operators.assembly import assembled, kept as keep

FACTS = "fact_id bigint, service string, service_name string, host string, url string, kind string, object string, detail map<string,string>, claim string, promoted boolean"


def fact(n, kind, object_=None, claim="x", promoted=False, service="boat", **detail):
    return (n, service, f"the {service} permit", f"{service}.gov.in", "u", kind, object_, detail or None, claim, promoted)


def built(spark, facts, documents=(("Card", True), ("Box", False), ("Boat licence", True)), taken=(), authored=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = assembled(frame(facts, FACTS), frame(documents, "phrase string, document boolean"), frame([(t,) for t in taken], "id string"), frame([(a,) for a in authored], "id string"))
    nodes = {r.id: (r.type, r.name) for r in out["nodes"].collect()}
    edges = {(r.src, r.type, r.dst): r.note for r in out["edges"].collect()}
    return nodes, edges, out["services"].collect(), sorted((r.fact_id, r.reason) for r in out["refused"].collect() if r.fact_id is not None)


S = "service:boat"


@pytest.fixture(scope="module")
def whole(spark):
    facts = [
        fact(1, "DOCUMENT_REQUIREMENT", "card"), fact(2, "DOCUMENT_REQUIREMENT", "box"), fact(3, "DOCUMENT_REQUIREMENT", "unknown_thing"), fact(4, "DOCUMENT_REQUIREMENT", "full_name"), fact(5, "DOCUMENT_REQUIREMENT", None),
        fact(6, "OFFICE", "form", "The Lake Board is located at Pier", address="1 Road"), fact(7, "OFFICE", "lake_house", "x"), fact(8, "HELPLINE", number="100"), fact(9, "CHANNEL", url="https://a.gov.in"), fact(10, "TRACKING", url="https://face.example/x"),
        fact(11, "CHANNEL", email="Desk@Lake.gov.in"), fact(12, "GRIEVANCE"), fact(13, "ACTION", None, "Submit the form.", True), fact(14, "ACTION", None, "Click here", True), fact(15, "APP"), fact(16, "FEE", None, "The fee is 9", amount="9"), fact(17, "FEE", None, "The unit cost is 9", amount="9"),
        fact(18, "ELIGIBILITY", "card", "The card is issued by the Lake Board"), fact(19, "ELIGIBILITY", None, "The applicant receives a boat licence", True), fact(20, "ELIGIBILITY", None, "It is issued by any one of the officers", True), fact(21, "DOCUMENT_REQUIREMENT", "boat_licence"), fact(22, "TIMELINE", None, "It takes 5 days", days="5"),
        *(fact(30 + k, "ELIGIBILITY", None, f"Boats must be of class {k % 8}") for k in range(16)),
    ]
    return built(spark, facts)


def test_nodes_edges_and_services(whole):
    nodes, edges, services, _ = whole
    assert nodes["document:card"] == ("DOCUMENT", "Card") and nodes["office:lake_board"] == ("OFFICE", "Lake Board") and nodes["helpline:100"][1] == "The Boat Permit Helpline" and "document:box" not in nodes
    assert {(S, "REQUIRES", "document:card"), (S, "VISIT_AT", "office:lake_board"), (S, "CALL_IF", "helpline:100"), (S, "APPLY_AT", "portal:a_gov_in"), (S, "CALL_IF", "helpline:desk_lake_gov_in"), (S, "ESCALATE_TO", "grievance:boat"), (S, "REQUIRES", "payment:boat_fee"), (S, "APPLY_AT", "portal:boat_gov_in")} <= set(edges)
    assert ("document:card", "ISSUED_BY", "department:lake_board") in edges  # the document is issued, not the service
    assert (S, "PRODUCES", "document:boat_licence") in edges and (S, "REQUIRES", "document:boat_licence") not in edges
    (own,) = services
    assert own.fee == "The fee is 9" and own.timeline == "It takes 5 days" and own.eligibility == [f"Boats must be of class {k}" for k in range(6)] and own.name == "The Boat Permit"


def test_reasons(whole):
    reasons = whole[3]
    assert [r for r in reasons if r[0] < 22 or r[0] > 45] == [
        (2, "NOT_A_DOCUMENT"), (3, "UNKNOWN_CANONICAL_ENTITY"), (4, "NOT_A_DOCUMENT"), (5, "INVALID_SCHEMA"), (7, "UNKNOWN_CANONICAL_ENTITY"), (10, "UNTRUSTED_HOST"), (14, "NOT_A_CITIZEN_STEP"), (15, "UNSUPPORTED_KIND"), (17, "NOT_A_CITIZEN_FEE"),
        (18, "NOT_A_CRITERION"), (19, "NOT_A_CRITERION"), (20, "NOT_A_CRITERION"), (20, "NO_ACTOR"),
    ]


def test_owned_ids_dangling_edges_and_silent_services(spark):
    facts = [fact(1, "DOCUMENT_REQUIREMENT", "card"), fact(2, "DOCUMENT_REQUIREMENT", "card", service="mute"), fact(3, "ACTION", None, "Submit it", True), fact(4, "FEE", None, "The fee is 9", amount="9")]
    nodes, edges, services, reasons = built(spark, facts, taken=["document:card"], authored=[S])
    assert "document:card" not in nodes and (S, "REQUIRES", "document:card") in edges  # linked to, not written again
    assert "service:mute" not in nodes and not [e for e in edges if e[0] == "service:mute"] and (3, "ALREADY_OWNED") in reasons
    nodes, edges, services, _ = built(spark, facts, taken=[S])
    assert services == [] and S not in nodes and (S, "REQUIRES", "document:card") in edges  # an owned service keeps its own node
    assert built(spark, [])[:3] == ({}, {}, [])


def test_large_part_numbers_keep_the_order_of_lines(spark, tmp_path):
    import duckdb

    from gritstone.plans import catalogue

    spark.createDataFrame([(1, 1, 200_005), (1, 2, 5)], "l_orderkey bigint, l_linenumber int, l_partkey bigint").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1,)], "o_orderkey bigint").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in catalogue.queries()["q_assembled_services"](spark, str(tmp_path)).select("id", "host").collect()]
    held = duckdb.connect()
    held.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = held.execute(f"select id, host from ({catalogue.oracle_sql()['q_assembled_services']})").fetchall()
    assert got == want == [("service:s1", "h1.gov.in")]  # the first line's, though its part has six digits


def test_facts_are_kept_narrow_and_ends_are_held_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(assembly, "kept", lambda df: kept.append(df) or keep(df))
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = assembly.assembled(frame([fact(1, "ACTION", claim="Submit form 3;", promoted=True), fact(2, "GRIEVANCE"), fact(3, "ACTION", claim="Submit form 4;", promoted=True, service="cart")], FACTS), frame([("Card", True)], "phrase string, document boolean"), frame([], "id string"), frame([("service:cart",)], "id string"))
    assert not {"detail", "kind"} & set(kept[0].columns)
    assert out["edges"]._jdf.queryExecution().optimizedPlan().toString().count("Join LeftSemi") == 1
    assert sorted((r.src, r.dst) for r in out["edges"].collect() if r.type == "REQUIRES") == [("service:boat", "action:boat_submit_form_3")]
    assert [r.reason for r in out["refused"].collect() if r.fact_id == 3] == ["ALREADY_OWNED"]
