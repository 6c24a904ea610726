from __future__ import annotations

from gritstone.operators import reports as R

NODES = "id string, type string, sources int, eligibility int, step int, statuses array<string>"


def graph(spark):
    nodes = [("full", "SERVICE", 1, 0), ("bare", "SERVICE", 0, 0), ("said", "SERVICE", 0, 2), ("lone", "SERVICE", 0, 0)]
    ends = [("doc", "DOCUMENT_GROUP"), ("rule", "ELIGIBILITY"), ("a1", "ACTION"), ("a2", "ACTION"), ("fee", "PAYMENT"), ("desk", "OFFICE"), ("call", "HELPLINE"), ("dept", "DEPARTMENT"), ("check", "VERIFICATION"), ("web", "PORTAL")]
    rows = [(*n, None, None) for n in nodes] + [(i, t, 1, 0, int(i[1]) if t == "ACTION" else None, ["CONFLICTING", "CONFLICTING"] if i == "doc" else None) for i, t in ends]
    edges = [("full", i, "REQUIRES") for i, _ in ends] + [("full", "web", t) for t in ("APPLY_AT", "TRACK_AT", "ESCALATE_TO", "PRODUCES")] + [("bare", "a1", "REQUIRES"), ("bare", "gone", "ISSUED_BY"), ("doc", "a1", "REQUIRES")]
    return spark.createDataFrame(rows, NODES), spark.createDataFrame([(*e, "CONFLICTING" if k == 0 else "VERIFIED", None) for k, e in enumerate(edges)], "src string, dst string, type string, status string, statuses array<string>")


def test_gaps_and_what_to_search_for(spark):
    got = {r.id: r for r in R.measured(R.answers(*graph(spark))).collect()}
    assert got["full"].missing == [] and got["full"].retrievable == [] and got["full"].answered == 13 and got["full"].place == 4
    assert got["bare"].known == ["ISSUING_AUTHORITY"] and got["said"].known == ["ELIGIBILITY"] and got["lone"].answered == 0 and got["lone"].place == 1
    assert got["lone"].retrievable == ["ACTIONS", "DOCUMENTS", "ELIGIBILITY", "FEES", "OFFICE", "HELPLINE", "TRACKING", "ESCALATION", "OUTPUT", "ISSUING_AUTHORITY", "VERIFICATION"]


def test_depth(spark):
    r = R.depth_report(R.answers(*graph(spark))).first()
    assert (r.services, r.source, r.documents, r.eligibility, r.actions, r.output) == (4, 1, 1, 2, 1, 1)
    assert (r.steps_one, r.steps_two_to_three, r.ordered, r.thin, r.middling, r.deep, r["mean"]) == (3, 1, 1, 3, 0, 1, 2.75)


def test_statistics(spark):
    nodes, edges = graph(spark)
    others = {n: spark.range(k) for k, n in enumerate(("jurisdictions", "requirement_groups", "sources", "questions"))}
    r = R.statistics(nodes, edges, others).first().asDict()
    assert r == {"services": 4, "documents": 1, "actions": 4, "eligibility_rules": 1, "portals": 1, "mobile_apps": 0, "offices": 1, "departments": 1, "helplines": 1, "edges": 17, "verified_edges": 16, "jurisdictions": 0, "requirement_groups": 1, "sources": 2, "questions": 3, "conflicts": 2}
    assert R.statistics(nodes.limit(0), edges.limit(0), others).first().conflicts == 0
