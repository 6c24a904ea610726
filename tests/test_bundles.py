from __future__ import annotations

import json
import random
from itertools import pairwise

from pyspark.sql import functions as F

from gritstone.operators import bundles as B, journeys as J, validation as V
from gritstone.sources.tables import bundles

REF = [{"sourceId": "src:page", "evidence": "Every boat shows the policy that covers the season.", "confidence": 0.9, "verificationStatus": "VERIFIED"}]
HARBOUR = {
    "id": "harbour",
    "sources": [{"id": "src:page", "url": "https://harbour.example/berth", "title": "Berths"}],
    "nodes": [
        {"id": "service:berth", "type": "SERVICE", "name": "A berth for the season", "sources": REF},
        {"id": "document:policy", "type": "DOCUMENT", "name": "Insurance policy", "sources": REF},
        {"id": "document:crewlist", "type": "DOCUMENT", "name": "Crew list", "sources": REF},
        {"id": "document:skipper", "type": "DOCUMENT", "name": "Skipper's licence", "sources": REF},
        {"id": "document:crew", "type": "DOCUMENT_GROUP", "name": "Who sails", "sources": REF},
        {"id": "payment:dues", "type": "PAYMENT", "name": "Harbour dues", "sources": REF},
        {"id": "portal:quay", "type": "PORTAL", "name": "Quay office online", "sources": REF},
        {"id": "eligibility:of_age", "type": "ELIGIBILITY", "name": "Of age", "sources": REF, "metadata": {"rule": {"field": "age", "operator": "GTE", "value": 18}, "blockedBy": "CITIZEN"}},
    ],
    "edges": [
        {"id": "e:1", "from": "service:berth", "to": "document:policy", "type": "REQUIRES", "verificationStatus": "VERIFIED", "sources": REF},
        {"id": "e:2", "from": "service:berth", "to": "payment:dues", "type": "REQUIRES", "condition": {"field": "age", "operator": "LT", "value": 60}, "sources": REF},
        {"id": "e:3", "from": "service:berth", "to": "portal:quay", "type": "APPLY_AT", "sources": REF},
        {"id": "e:4", "from": "service:berth", "to": "eligibility:of_age", "type": "REQUIRES", "sources": REF},
        {"id": "e:5", "from": "service:berth", "to": "document:crew", "type": "REQUIRES", "sources": REF},
    ],
    "requirementGroups": [{"id": "rg:crew", "ownerNodeId": "document:crew", "mode": "ANY_OF", "members": [{"nodeId": "document:crewlist"}, {"nodeId": "document:skipper"}], "sources": REF}],
    "questions": [{"field": "age", "label": "How old is the skipper?", "inputType": "NUMBER"}],
}
PACK = {"id": "pack", "nodes": [{"id": "grievance:master", "type": "GRIEVANCE_CHANNEL", "name": "Harbour master"}], "edges": [], "sources": [], "requirementGroups": [], "questions": [], "edgeTemplates": [{"id": "e:*_escalate*", "from": "*", "to": "grievance:master", "type": "ESCALATE_TO"}]}


def test_a_bundle_from_file_to_journey(spark, tmp_path):
    for name, text in (("harbour", HARBOUR), ("a_pack", PACK), ("jurisdictions", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(text, indent=1))
    g = B.graph_tables(bundles(spark, str(tmp_path)))
    assert {r.id: (r.src, r.type) for r in g["edges"].collect() if r.id.startswith("e:s")} == {"e:service:berth_escalate*": ("service:berth", "ESCALATE_TO")}
    assert [tuple(r) for r in g["questions"].select("field", "inputType").collect()] == [("age", "NUMBER")]
    places = spark.createDataFrame([("XX", None, "COUNTRY")], "id string, parent_id string, level string")
    faults = V.graph_issues(g["nodes"], g["edges"], g["groups"], g["members"], g["sources"], g["refs"], places).collect()
    assert [(r.code, r.subject) for r in faults if r.severity == "ERROR"] == []
    asked = spark.createDataFrame([("young", "service:berth", ["XX"], {"age": "30"}), ("old", "service:berth", ["XX"], {"age": "70"}), ("mute", "service:berth", ["XX"], {})], "request_id string, goal string, chain array<string>, facts map<string,string>")
    held = J.held_closure(asked, spark.createDataFrame([("old", "document:skipper")], "request_id string, node string"), g["groups"], g["members"])
    reached, used = J.expand(asked, g["nodes"], g["edges"], g["groups"], g["members"], held, F.lit("2024-01-01").cast("date"))
    got = {}
    for r in reached.collect():
        got.setdefault(r.request_id, set()).add(r.node.split(":")[1])
    assert got["young"] == {"berth", "policy", "dues", "of_age", "crew", "crewlist", "skipper"} and got["old"] == {"berth", "policy", "of_age", "crew"} and got["mute"] == got["young"] - {"dues"}
    assert [(r.request_id, r.id, r.pending) for r in used.filter("truth is null").collect()] == [("mute", "e:2", ["age"])]
    layers = {(r.request_id, r.node): r.layer for r in J.layered(reached.withColumn("ord", F.col("node")), J.order_pairs(used)).collect()}
    assert layers["young", "payment:dues"] < layers["young", "service:berth"] and layers["young", "document:crewlist"] < layers["young", "document:crew"] < layers["young", "service:berth"]
    tied = J.attached(reached, asked, g["nodes"], g["edges"], ["APPLY_AT", "ESCALATE_TO"], places.select("id", F.col("id").alias("ancestor_id")), F.lit("2024-01-01").cast("date"))
    assert {(r.dst, r.type) for r in tied.collect()} == {("portal:quay", "APPLY_AT"), ("grievance:master", "ESCALATE_TO")}


def test_passages_are_slices_that_leave_nothing_out():
    from gritstone.functions.chunks import JUNK, edges, passages

    rnd = random.Random(7)
    lines = ["# Head", "**Bold thing:**", "Step 1: do", "What is it for now?", "Title Words Here", "", "   ", "| a | b |", "| c |", "plain text. " * 20, "x" * 250, "word " * 700, "A short. ", "12) item"]
    for _ in range(300):
        page = "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 30)))
        most, least = rnd.choice([(1500, 200), (100, 30)])
        found, starts = passages(page, most, least), {0, *(at for at, _ in edges(page, most, least)[0])}
        assert all(a < b and a in starts and (b in starts or b == len(page)) for a, b, _ in found)
        assert all(x[1] <= y[0] for x, y in pairwise(found))
        gaps = [page[x:y] for x, y in pairwise([0, *(e for a, b, _ in found for e in (a, b)), len(page)])][::2]
        assert all(not g.strip() or JUNK.search(g) for g in gaps) and not any(JUNK.search(page[a:b]) for a, b, _ in found)
        rows = page.split("\n")
        tables = [sum(len(r) + 1 for r in rows[:k]) for k in range(1, len(rows)) if rows[k].startswith("|") and rows[k - 1].startswith("|")]
        assert not {a for a, _, _ in found} & set(tables)  # a table stays whole
