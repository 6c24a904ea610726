"""Bundles of nodes and edges, one row a bundle, as one graph and as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritstone.sources.tables import cut

from .programs import programs


def journeys(bundles: DataFrame) -> DataFrame:
    """bundles without the template packs: those that stamp no templates."""
    return bundles.filter("templates is null or size(templates) = 0")


def folded(bundles: DataFrame, part: str, key: str = "id") -> DataFrame:
    """The rows of one part of all bundles(bundle, part, templates), the first of each key: journeys before template packs, then by bundle and place in it."""
    pack = F.coalesce(F.size("templates"), F.lit(0)) > 0
    rows = bundles.select(pack.alias("_pack"), "bundle", F.posexplode(part).alias("_at", "_row")).select("_pack", "bundle", "_at", "_row.*")
    first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (key, "_pack", "_at")]), F.struct("_pack", "bundle", "_at")).alias("x"))
    return first.select(key, "x.*")


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with ord, their place in a total order from 1: places within a range of keys, after those of the ranges before it.

    Which range a row lies in is kept with the rows, once, so that whoever reads them later finds the same.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).select("_part", "_before")  # a row a range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn("ord", F.col("_before") + own).drop("_part", "_before")


def small(rows: DataFrame, most: int = 10_000) -> DataFrame:
    """rows, marked for broadcast if there are no more than `most`."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def stamped(bundles: DataFrame) -> DataFrame:
    """bundle, edge columns: all edges, and each template from * once for every service, the first * in its id replaced by the service's id.

    Templates are a few rows of the packs, so they travel to the services.
    """
    plain = bundles.select("bundle", F.inline("edges"))
    services = folded(bundles, "nodes").filter("type = 'SERVICE'").select(F.col("id").alias("service"))
    templates = bundles.filter("size(templates) > 0").select("bundle", F.inline("templates"))
    wild = small(templates.filter("src = '*'"))
    made = services.join(wild, F.lit(True)).select("bundle", F.regexp_replace("id", F.lit(r"^([^*]*)\*"), F.concat(F.lit("$1"), "service")).alias("id"), F.col("service").alias("src"), "dst", "type")
    return plain.unionByName(made).unionByName(templates.filter("src <> '*'"))


def to_rows(bundles: DataFrame, part: str) -> DataFrame:
    """bundle, ord and the columns of one part, a row each; empty lists and maps become null."""
    rows = bundles.select("bundle", F.posexplode(part).alias("ord", "row")).select("bundle", "ord", "row.*")
    empty = lambda f: F.when(F.size(f.name) > 0, F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("array", "map") else F.col(f.name)
    return rows.select(*map(empty, rows.schema.fields))


def to_bundles(rows: DataFrame, part: str) -> DataFrame:
    """What to_rows made, as bundles again, the rows of each in their order."""
    own = [c for c in rows.columns if c not in ("bundle", "ord")]
    held = rows.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("ord", *own))).alias("_rows"))
    return held.select("bundle", F.transform("_rows", lambda x: F.struct(*(x[c].alias(c) for c in own))).alias(part))


def completeness(rows: DataFrame, key: str, dimensions: dict[str, Column]) -> DataFrame:
    """key, known, missing, answered, depth, share and place (the least answered first) by dimensions, each a condition; null is no answer."""
    names = list(dimensions)
    known = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in dimensions.items())))
    told = rows.select(key, known.alias("known"), F.array_except(F.array(*map(F.lit, names)), known).alias("missing"), F.size(known).alias("answered"))
    depth = F.when(F.col("answered") <= 3, "thin").when(F.col("answered") <= 6, "middling").otherwise("deep")
    share = F.round(100.0 * F.col("answered") / len(names))
    before = told.groupBy("answered").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("answered")) - F.col("_n")).select("answered", "_before")  # a row a count
    place = F.col("_before") + F.row_number().over(Window.partitionBy("answered").orderBy(key))
    return told.join(F.broadcast(before), "answered").select(key, "known", "missing", "answered", depth.alias("depth"), share.alias("share"), place.alias("place"))


def registered(hosts: DataFrame, exact: DataFrame, rules: list[tuple[str, str]], aliases: DataFrame) -> DataFrame:
    """host, owner, basis of hosts(host): by exact(host, name), else by the first of the rules (pattern, name), else by aliases(label, name) on the host's first label where only one row has it."""
    label = F.split_part(F.col("host"), F.lit("."), F.lit(1))
    sure = aliases.groupBy("label").agg(F.min("name").alias("alias"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    by_rule = reduce(lambda w, r: w.when(F.col("host").rlike(r[0]), r[1]), rules, F.when(F.lit(False), ""))
    told = hosts.join(exact.select("host", F.col("name").alias("exact")), "host", "left").withColumn("label", label).join(sure, "label", "left").withColumn("rule", by_rule)
    basis = F.when(F.col("exact").isNotNull(), "EXACT").when(F.col("rule").isNotNull(), "RULE").when(F.col("alias").isNotNull(), "ALIAS").otherwise("NONE")
    return told.select("host", F.coalesce("exact", "rule", "alias").alias("owner"), basis.alias("basis"))


def graph_tables(bundles: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, groups, members, sources, refs and questions of bundles as they are read: one graph, as the operators on journeys and rules take it.

    Of things with one id the first counts, journeys before template packs. Templates from * become
    an edge of every service. Conditions become programs.
    """
    held = bundles.withColumn("templates", F.coalesce("edgeTemplates", F.array().cast(bundles.schema["edgeTemplates"].dataType))).drop("edgeTemplates")
    edge = lambda c: F.transform(F.coalesce(c, F.array().cast(bundles.schema["edges"].dataType)), lambda e: F.struct(e["id"].alias("id"), e["from"].alias("src"), e["to"].alias("dst"), e["type"].alias("type"), e["condition"].alias("condition"), e["jurisdictionId"].alias("scope"), e["verificationStatus"].alias("status"), e["validFrom"].alias("valid_from"), e["validUntil"].alias("valid_until"), e["sources"].alias("cited")))
    held = held.withColumn("edges", edge(F.col("edges"))).withColumn("templates", edge(F.col("templates")))
    part = {c: held.withColumn("part", F.col(c)) for c in ("nodes", "requirementGroups", "sources", "questions")}
    nodes = folded(part["nodes"], "part").withColumnRenamed("jurisdictionId", "scope").withColumn("program", programs(F.try_element_at("metadata", F.lit("rule")))).withColumn("store_id", F.coalesce(F.try_element_at("metadata", F.lit("androidAppId")), F.try_element_at("metadata", F.lit("iosAppId"))))
    plain = held.select("bundle", "templates", F.filter("edges", lambda e: e["id"].isNotNull()).alias("part"))
    own = folded(plain, "part").drop("bundle")
    services = nodes.filter("type = 'SERVICE'").select(F.col("id").alias("service"))
    wild = small(held.select(F.inline("templates")).filter("src = '*'"))
    made = services.join(wild, F.lit(True))  # every template for every service
    everyone = made.select(*(F.regexp_replace("id", F.lit(r"^([^*]*)\*"), F.concat(F.lit("$1"), "service")).alias("id") if c == "id" else F.col("service").alias("src") if c == "src" else F.col(c) for c in own.columns))
    edges = own.unionByName(everyone).withColumn("program", programs(F.col("condition"))).withColumn("valid_from", F.col("valid_from").try_cast("date")).withColumn("valid_until", F.col("valid_until").try_cast("date"))
    groups = folded(part["requirementGroups"], "part").withColumn("program", programs(F.col("condition")))
    groups = groups.select("id", F.col("ownerNodeId").alias("owner"), "mode", F.col("minimumRequired").alias("need"), F.col("jurisdictionId").alias("scope"), "program", "members", F.col("sources").alias("cited"))
    member = groups.select(F.col("id").alias("group_id"), F.inline("members")).select("group_id", F.col("nodeId").alias("node"), programs(F.col("condition")).alias("program"))
    ref = lambda kind, rows, c: rows.select(F.lit(kind).alias("kind"), F.col("id").alias("subject"), F.inline(c)).select("kind", "subject", F.col("sourceId").alias("source_id"), "evidence", "confidence", F.col("verificationStatus").alias("status"))
    return {
        "nodes": nodes, "edges": edges.drop("condition", "cited"), "groups": groups.drop("members", "cited"), "members": member, "sources": folded(part["sources"], "part"),
        "refs": ref("node", nodes, "sources").union(ref("edge", edges, "cited")).union(ref("group", groups, "cited")), "questions": folded(part["questions"], "part", "field"),
    }
