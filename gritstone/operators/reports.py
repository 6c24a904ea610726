"""Reports on a whole graph: its counts, what each service can answer, how deep services are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .bundles import completeness

#: Fixed: rows of the statistics that count nodes, with their types.
NODE_ROWS = {
    "services": ("SERVICE",), "documents": ("DOCUMENT", "DOCUMENT_GROUP"), "actions": ("ACTION", "VERIFICATION", "PAYMENT"), "eligibility_rules": ("ELIGIBILITY",), "portals": ("PORTAL",),
    "mobile_apps": ("MOBILE_APP",), "offices": ("OFFICE",), "departments": ("DEPARTMENT",), "helplines": ("HELPLINE", "GRIEVANCE_CHANNEL"),
}
#: Fixed: the thirteen questions of a service: edge types and node types that answer each, and what to search for where it is open.
QUESTIONS: dict[str, tuple[tuple[str, ...], tuple[str, ...], str | None]] = {
    "SOURCE": ((), (), None),
    "APPLICATION_CHANNEL": (("APPLY_AT", "AVAILABLE_VIA"), (), "ACTIONS"),
    "DOCUMENTS": ((), ("DOCUMENT", "DOCUMENT_GROUP"), "DOCUMENTS"),
    "ELIGIBILITY": ((), ("ELIGIBILITY",), "ELIGIBILITY"),
    "ACTIONS": ((), (), "ACTIONS"),
    "FEES": ((), ("PAYMENT",), "FEES"),
    "OFFICE": ((), ("OFFICE",), "OFFICE"),
    "HELPLINE": ((), ("HELPLINE",), "HELPLINE"),
    "TRACKING": (("TRACK_AT",), (), "TRACKING"),
    "ESCALATION": (("ESCALATE_TO",), (), "ESCALATION"),
    "OUTPUT": (("PRODUCES",), (), "OUTPUT"),
    "ISSUING_AUTHORITY": (("ISSUED_BY",), ("DEPARTMENT",), "ISSUING_AUTHORITY"),
    "VERIFICATION": (("VERIFIED_BY",), ("VERIFICATION",), "VERIFICATION"),
}
#: Fixed: the ten of them that the depth report asks.
DEPTH = ("SOURCE", "APPLICATION_CHANNEL", "DOCUMENTS", "ELIGIBILITY", "ACTIONS", "TRACKING", "OFFICE", "HELPLINE", "ESCALATION", "OUTPUT")


def statistics(nodes: DataFrame, edges: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """One row of sixteen counts of nodes(type, statuses), edges(status, statuses) and the other tables (jurisdictions, requirement_groups, sources, questions) by name.

    `statuses` are those of a row's citations; a node or edge with a CONFLICTING one counts as a conflict, once, as does an edge that is CONFLICTING itself.
    """
    cited = F.array_contains(F.coalesce("statuses", F.array().cast("array<string>")), "CONFLICTING")
    n = nodes.agg(*(F.count_if(F.col("type").isin(*types)).alias(name) for name, types in NODE_ROWS.items()), F.count_if(cited).alias("_n"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("status") == "VERIFIED").alias("verified_edges"), F.count_if(cited | F.coalesce(F.col("status") == "CONFLICTING", F.lit(False))).alias("_e"))
    row = n.crossJoin(F.broadcast(e))  # both are one row
    for name in ("jurisdictions", "requirement_groups", "sources", "questions"):
        row = row.crossJoin(F.broadcast(others[name].agg(F.count("*").alias(name))))
    return row.withColumn("conflicts", F.col("_n") + F.col("_e")).drop("_n", "_e")


def answers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, a boolean for each of QUESTIONS, steps (actions) and numbered of the services of nodes(id, type, sources, eligibility, step), by edges(src, dst, type).

    `sources` and `eligibility` are numbers of citations and of rules on the node itself, `step` is the number that a source gave an action. Two
    actions make an answer, one doesn't. Edges are joined once with their ends and summed by service before they meet it.
    """
    ends = nodes.select(F.col("id").alias("dst"), F.col("type").alias("to"), "step")
    services = nodes.filter("type = 'SERVICE'").select("id", "sources", "eligibility")
    own = edges.select(F.col("src").alias("id"), "dst", "type").join(services.select("id"), "id", "left_semi").join(ends, "dst", "left")
    has = lambda q: F.bool_or(F.col("type").isin(*QUESTIONS[q][0]) if not QUESTIONS[q][1] else F.coalesce(F.col("to").isin(*QUESTIONS[q][1]), F.lit(False)) | F.col("type").isin(*QUESTIONS[q][0])).alias(f"has_{q}")
    action = F.coalesce(F.col("to") == "ACTION", F.lit(False))
    told = own.groupBy("id").agg(*(has(q) for q in QUESTIONS if any(QUESTIONS[q][:2])), F.count_if(action).alias("steps"), F.count_if(action & F.col("step").isNotNull()).alias("numbered"))
    held = services.join(told, "id", "left")
    at_all = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))

    def flag(q: str) -> Column:
        if q == "SOURCE":
            return at_all("sources")
        if q == "ACTIONS":
            return F.coalesce(F.col("steps") >= 2, F.lit(False))
        return F.coalesce(F.col(f"has_{q}"), F.lit(False)) | (at_all("eligibility") if q == "ELIGIBILITY" else F.lit(False))

    return held.select("id", *(flag(q).alias(q) for q in QUESTIONS), F.coalesce("steps", F.lit(0)).alias("steps"), F.coalesce("numbered", F.lit(0)).alias("numbered"))


def measured(told: DataFrame) -> DataFrame:
    """id, known, missing, retrievable, answered, depth, share and place (the least answered first) of what answers() gives: `retrievable` is what to search for, each once, in the order of what is missing."""
    search = F.create_map(*(F.lit(x) for q, (_, _, s) in QUESTIONS.items() if s for x in (q, s)))
    rows = completeness(told, "id", {q: F.col(q) for q in QUESTIONS})
    return rows.withColumn("retrievable", F.array_distinct(F.filter(F.transform("missing", lambda m: F.try_element_at(search, m)), lambda s: s.isNotNull())))


def depth_report(told: DataFrame) -> DataFrame:
    """One row for all services of answers(): services, a count for each of the ten questions of DEPTH, services by number of steps, those with an order, and thin, middling and deep ones."""
    n = sum((F.col(q).cast("int") for q in DEPTH[1:]), F.col(DEPTH[0]).cast("int"))
    rows = told.withColumn("n", n)
    count = lambda c, name: F.count_if(c).alias(name)
    a = F.col("steps")
    return rows.agg(
        F.count("*").alias("services"), *(count(F.col(q), q.lower()) for q in DEPTH), count(a <= 1, "steps_one"), count(a.between(2, 3), "steps_two_to_three"), count(a.between(4, 6), "steps_four_to_six"), count(a >= 7, "steps_seven_plus"),
        count(F.col("numbered") >= 2, "ordered"), count(F.col("n") <= 3, "thin"), count(F.col("n").between(4, 6), "middling"), count(F.col("n") >= 7, "deep"), F.round(F.avg("n"), 6).alias("mean"),
    )
