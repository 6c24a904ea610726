"""Rules that a graph must keep: each gives rows of (severity, code, subject)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .graphs import cyclic
from .programs import OPERATORS

#: Fixed: allowed values by field.
ENUMS = {
    "node_type": "SERVICE DOCUMENT DOCUMENT_GROUP PAYMENT PORTAL ELIGIBILITY OFFICE ACTION OUTPUT MOBILE_APP HELPLINE GRIEVANCE_CHANNEL AUTHORITY DEPENDENCY".split(),
    "edge_type": "REQUIRES DEPENDS_ON PRODUCES NEXT BLOCKS APPLY_AT AVAILABLE_VIA TRACK_AT VISIT_AT CALL_IF ESCALATE_TO ISSUED_BY VERIFIED_BY".split(),
    "status": "DISCOVERED EXTRACTED VERIFIED REVIEWED REJECTED CONFLICTING".split(),
    "mode": "ALL_OF ANY_OF AT_LEAST_N".split(),
    "level": "COUNTRY STATE DISTRICT TALUKA CITY".split(),
}
NEED_SOURCE = ("SERVICE", "DOCUMENT", "PORTAL", "OFFICE")


def issues(severity: str, code: str, rows: DataFrame, subject: Column | str) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"))


def repeated(code: str, rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, each told once."""
    return issues("ERROR", code, rows.groupBy(key).count().filter("count > 1"), key)


def unknown(code: str, rows: DataFrame, key: str, known: DataFrame, of: str, subject: str) -> DataFrame:
    """Rows whose key isn't among known; a null key passes."""
    ids = known.select(F.col(of).alias(key)).distinct()
    return issues("ERROR", code, rows.filter(F.col(key).isNotNull()).join(ids, key, "left_anti"), subject)


def outside(rows: DataFrame, field: str, allowed: list[str], subject: str) -> DataFrame:
    return issues("ERROR", "UNKNOWN_ENUM", rows.filter(F.col(field).isNotNull() & ~F.col(field).isin(allowed)), subject)


def bad_rules(rows: DataFrame, program: str, subject: str) -> DataFrame:
    """Predicates without a field, and operators that aren't known, in the programs of rows."""
    steps = rows.select(F.col(subject).alias("_of"), F.explode(program).alias("s"))
    lost = issues("ERROR", "BAD_RULE", steps.filter("s.op = 'UNKNOWN' and s.field is null").distinct(), "_of")
    known = sorted(OPERATORS | {"ALL", "ANY", "NOT"})
    return lost.union(issues("ERROR", "UNKNOWN_ENUM", steps.filter(F.col("s.field").isNotNull() & ~F.col("s.op").isin(known)).distinct(), "_of"))


def checked_refs(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs(subject, source_id, evidence, confidence, status) against sources(id)."""
    known = sources.select(F.col("id").alias("source_id"), F.lit(True).alias("known")).distinct()
    told = refs.join(known, "source_id", "left")
    quiet = told.filter(F.col("known") & (F.trim(F.coalesce("evidence", F.lit(""))) == ""))
    return reduce(
        DataFrame.union,
        [
            issues("ERROR", "DANGLING_SOURCE", told.filter("known is null"), "subject"), issues("WARNING", "NO_EVIDENCE", quiet, "subject"),
            issues("ERROR", "BAD_CONFIDENCE", told.filter("confidence is null or isnan(confidence) or confidence < 0 or confidence > 1"), "subject"), outside(told, "status", ENUMS["status"], "subject"),
        ],
    )


def graph_issues(nodes: DataFrame, edges: DataFrame, groups: DataFrame, members: DataFrame, sources: DataFrame, refs: DataFrame, places: DataFrame) -> DataFrame:
    """row_issues(...) and cycle_issues(edges)."""
    return row_issues(nodes, edges, groups, members, sources, refs, places).union(cycle_issues(edges))


def cycle_issues(edges: DataFrame) -> DataFrame:
    """Nodes in a dependency cycle of edges(src, dst, type), once each."""
    turned = F.col("type").isin("REQUIRES", "DEPENDS_ON")
    pairs = edges.filter(F.col("type").isin("REQUIRES", "DEPENDS_ON", "PRODUCES", "NEXT", "BLOCKS")).select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return issues("ERROR", "DEPENDENCY_CYCLE", cyclic(pairs).select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id")


def row_issues(nodes: DataFrame, edges: DataFrame, groups: DataFrame, members: DataFrame, sources: DataFrame, refs: DataFrame, places: DataFrame) -> DataFrame:
    """severity, code, subject of what is wrong in a graph, but for its cycles.

    nodes(id, type, scope, program, store_id), edges(id, src, dst, type, scope, program, status,
    valid_from, valid_until), groups(id, owner, mode, need, program), members(group_id, node),
    sources(id, url), refs(kind, subject, source_id, evidence, confidence, status) with kind node,
    edge or group, places(id, parent_id, level). An edge that starts and ends nowhere is told
    twice.
    """
    kinds = nodes.select(F.col("id").alias("owner"), F.col("type").alias("owner_type")).distinct()
    sized = groups.join(members.groupBy(F.col("group_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").withColumn("n", F.coalesce("n", F.lit(0))).join(kinds, "owner", "left")
    cited = lambda kind: refs.filter(F.col("kind") == kind).select(F.col("subject").alias("id")).distinct()
    choice = F.col("mode") != "ALL_OF"
    many = groups.groupBy("owner").agg(F.count("*").alias("owned")).filter("owned > 1")
    told = [
        *(repeated(c, t, "id") for c, t in (("DUPLICATE_NODE", nodes), ("DUPLICATE_EDGE", edges), ("DUPLICATE_GROUP", groups), ("DUPLICATE_SOURCE", sources), ("DUPLICATE_JURISDICTION", places))),
        unknown("DANGLING_PARENT", places, "parent_id", places, "id", "id"), outside(places, "level", ENUMS["level"], "id"),
        outside(nodes, "type", ENUMS["node_type"], "id"), outside(edges, "type", ENUMS["edge_type"], "id"), outside(edges, "status", ENUMS["status"], "id"), outside(groups, "mode", ENUMS["mode"], "id"),
        bad_rules(nodes, "program", "id"), bad_rules(edges, "program", "id"), bad_rules(groups, "program", "id"),
        unknown("UNKNOWN_JURISDICTION", nodes, "scope", places, "id", "id"), unknown("UNKNOWN_JURISDICTION", edges, "scope", places, "id", "id"),
        issues("ERROR", "BAD_SOURCE_URL", sources.filter("url is null or not startswith(url, 'http')"), "id"),
        issues("WARNING", "UNNAMESPACED_ID", nodes.filter(~F.contains("id", F.lit(":"))), "id"),
        issues("WARNING", "UNSOURCED_NODE", nodes.filter(F.col("type").isin(*NEED_SOURCE)).join(cited("node"), "id", "left_anti"), "id"),
        issues("WARNING", "APP_WITHOUT_STORE_ID", nodes.filter("type = 'MOBILE_APP' and store_id is null"), "id"),
        unknown("DANGLING_EDGE", edges, "src", nodes, "id", "id"), unknown("DANGLING_EDGE", edges, "dst", nodes, "id", "id"),
        issues("ERROR", "INVERTED_WINDOW", edges.filter("valid_from > valid_until"), "id"),
        issues("ERROR", "DANGLING_GROUP_OWNER", sized.filter("owner_type is null"), "id"), issues("ERROR", "EMPTY_GROUP", sized.filter("n = 0"), "id"),
        issues("ERROR", "MISSING_MINIMUM", sized.filter("mode = 'AT_LEAST_N' and coalesce(need, 0) = 0"), "id"), issues("ERROR", "IMPOSSIBLE_MINIMUM", sized.filter("mode = 'AT_LEAST_N' and need > n"), "id"),
        issues("ERROR", "SINGLE_MEMBER_CHOICE", sized.filter(choice & (F.col("n") == 1)), "id"),
        issues("ERROR", "DUPLICATE_MEMBER", members.groupBy("group_id", "node").count().filter("count > 1"), "group_id"),
        issues("ERROR", "SELF_REFERENTIAL_GROUP", groups.join(members.select(F.col("group_id").alias("id"), F.col("node").alias("owner")).distinct(), ["id", "owner"], "left_semi"), "id"),
        issues("ERROR", "UNSOURCED_GROUP", groups.join(cited("group"), "id", "left_anti"), "id"),
        issues("WARNING", "ALTERNATIVES_WITHOUT_GROUP_NODE", sized.filter(choice & (F.col("owner_type") != "DOCUMENT_GROUP")), "id"),
        issues("WARNING", "MULTIPLE_GROUPS_PER_NODE", groups.join(many, "owner", "left_semi"), "id"),
        unknown("DANGLING_MEMBER", members, "node", nodes, "id", "group_id"), checked_refs(refs, sources),
    ]
    return reduce(DataFrame.union, told)
