"""Facts of pages as nodes and edges, offices and channels for readers, plans of several goals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Fixed: kinds of facts that are placed whatever their details.
HARD = ("ELIGIBILITY", "DOCUMENT_REQUIREMENT", "FEE", "TIMELINE", "ACTION", "APP")
#: Fixed: names of form fields, which are no documents.
FIELDS = (
    "name full_name applicant_name father_name mother_name gender age date_of_birth address applicant_address mobile_number phone_number email email_id contact_details "
    "bank_name bank_account_number ifsc_code account_number format documents document details information signature declaration application_form form fee amount"
).split()
#: Fixed: states of a geocoded place that a reader may be sent to.
USABLE = ("DERIVED_HIGH", "DERIVED_MEDIUM")


def given(detail: Column, *names: str) -> Column:
    """Whether a map of details has one of these with something in it."""
    return reduce(lambda a, b: a | b, (F.coalesce(F.try_element_at(detail, F.lit(n)) != "", F.lit(False)) for n in names))


def placeable(kind: Column, detail: Column) -> Column:
    return (
        F.when(kind.isin(*HARD), True).when(kind == "HELPLINE", given(detail, "phone", "number")).when(kind == "OFFICE", given(detail, "address"))
        .when(kind.isin("CHANNEL", "TRACKING"), given(detail, "url")).otherwise(kind == "GRIEVANCE")
    )


def why_not(kind: Column, detail: Column) -> Column:
    """The reason why a fact that can't be placed can't be."""
    return (
        F.when(kind == "OFFICE", F.when(given(detail, "name"), "NO_LOCATION").otherwise("UNKNOWN_CANONICAL_ENTITY")).when(kind == "HELPLINE", "NO_CONTACT_VALUE")
        .when(kind == "TRACKING", F.when(given(detail, "url"), "UNTRUSTED_HOST").otherwise("FAILED_NORMALIZATION")).when(kind == "BLOCKER", "NO_REASON")
        .when(kind.isin("DEPENDENCY", "EXTERNAL_DEPENDENCY", "ACCEPTED_ALTERNATIVES"), "AMBIGUOUS_RELATION").otherwise("UNSUPPORTED_KIND")
    )


def destination(value: Column, trusted: str) -> Column:
    """(host, url, root) of what a fact points at, as https and without a fragment, if its host matches `trusted`; else null. A scheme may lack, blanks may not be there."""
    raw = F.trim(value)
    full = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))
    part = lambda k: F.regexp_extract(full, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)(?::[0-9]+)?([^?#]*)(\?[^#]*)?", k)
    name, path, search = F.lower(part(1)), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("/")), part(3)
    host = F.regexp_replace(name, r"^www\.", "")
    told = F.struct(host.alias("host"), F.concat(F.lit("https://"), name, path, search).alias("url"), ((path == "/") & (search == "")).alias("root"))
    return F.when(F.contains(raw, F.lit(".")) & ~raw.rlike(r"\s") & host.rlike(trusted), told)


def channel_type(kind: Column, told: Column) -> Column:
    """What a channel says it is, else by its node's type."""
    return F.coalesce(told, F.when(kind == "MOBILE_APP", "ANDROID_APP").when(kind == "OFFICE", "PHYSICAL_OFFICE").when(kind == "HELPLINE", "PHONE").when(kind == "GRIEVANCE_CHANNEL", "GRIEVANCE_PORTAL").otherwise("WEB"))


def office_line(name: Column, address: Column) -> Column:
    return F.when(F.coalesce(address, F.lit("")) == "", F.concat(name, F.lit(" (address not verified yet)"))).when(F.contains(address, name), address).otherwise(F.concat(name, F.lit(", "), address))


def nearest_scope(offices: DataFrame, chains: DataFrame, most: int) -> DataFrame:
    """request_id, id, place of offices(id, name, scope) by how near chains(request_id, chain) have their scope, then by name: the first `most` of each request.

    Offices on a chain are joined by scope; only if there are too few do others fill up, in order of name.
    """
    near = chains.select("request_id", F.posexplode("chain").alias("at", "scope")).join(offices, "scope").select("request_id", "id", "name", "at")
    rest = offices.orderBy("name", "id").limit(2 * most)  # whoever is off the chain comes after all on it
    fill = chains.select("request_id", F.size("chain").alias("at"), "chain").join(F.broadcast(rest), F.lit(True)).filter(F.col("scope").isNull() | ~F.array_contains("chain", F.col("scope"))).select("request_id", "id", "name", F.col("at") + 1)
    w = Window.partitionBy("request_id").orderBy("at", "name", "id")
    return near.union(fill).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("request_id", "id", "place")


def placed(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, refused) of facts(fact_id, service, kind, object, detail, url): what each adds to the graph.

    A requirement becomes a document that its service requires, an output one that it produces,
    a helpline, office, portal or grievance channel a node that it leads to. Of facts that make
    the same node the first by fact_id names it; a document that a service produces isn't
    required by it too; form fields are no documents. An edge carries the urls of its facts, twelve at most, in order.
    """
    kind, detail, thing = F.col("kind"), F.col("detail"), F.lower(F.regexp_replace(F.col("object"), "[^A-Za-z0-9]+", "_"))
    can = placeable(kind, detail) | (kind == "OUTPUT")
    field = (kind == "DOCUMENT_REQUIREMENT") & thing.isin(FIELDS)
    type_ = F.when(kind == "DOCUMENT_REQUIREMENT", "DOCUMENT").when(kind == "OUTPUT", "DOCUMENT").when(kind == "HELPLINE", "HELPLINE").when(kind == "OFFICE", "OFFICE").when(kind.isin("CHANNEL", "TRACKING"), "PORTAL").when(kind == "GRIEVANCE", "GRIEVANCE_CHANNEL").when(kind == "ACTION", "ACTION").when(kind == "FEE", "PAYMENT")
    edge = F.when(kind == "OUTPUT", "PRODUCES").when(kind.isin("DOCUMENT_REQUIREMENT", "FEE", "ACTION"), "REQUIRES").when(kind == "CHANNEL", "APPLY_AT").when(kind == "TRACKING", "TRACK_AT").when(kind == "OFFICE", "VISIT_AT").when(kind == "HELPLINE", "CALL_IF").when(kind == "GRIEVANCE", "ESCALATE_TO")
    told = facts.withColumn("ok", can & ~field & type_.isNotNull() & thing.isNotNull()).withColumn("node", F.concat(F.lower(type_), F.lit(":"), thing)).withColumn("type", type_).withColumn("edge", edge)
    good = told.filter("ok")
    nodes = good.groupBy("node").agg(F.first("type").alias("type"), F.min_by("object", "fact_id").alias("name")).withColumnRenamed("node", "id")
    each = good.select("service", "edge", "node", "url", "fact_id")
    made = each.filter("edge = 'PRODUCES'").select("service", "node").distinct().withColumn("edge", F.lit("REQUIRES"))
    kept = each.join(made, ["service", "node", "edge"], "left_anti")
    first = kept.groupBy("service", "edge", "node", "url").agg(F.min("fact_id").alias("fact_id"))
    few = first.withColumn("k", F.row_number().over(Window.partitionBy("service", "edge", "node").orderBy("fact_id"))).filter("k <= 12")
    edges = few.groupBy("service", "edge", "node").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]).alias("urls"))
    reason = F.when(field, "FORM_FIELD").otherwise(why_not(kind, detail))
    return nodes, edges.select(F.concat_ws("|", F.col("service"), F.col("edge"), F.col("node")).alias("id"), F.col("service").alias("src"), F.col("node").alias("dst"), F.col("edge").alias("type"), "urls"), told.filter("not ok").select("fact_id", reason.alias("reason"))


def admissible(pages: DataFrame, facts: DataFrame, foreign: DataFrame, least: int = 1) -> DataFrame:
    """page_id, n of pages that have `least` placeable facts or more and aren't among the foreign ones, by number of facts."""
    n = facts.filter(placeable(F.col("kind"), F.col("detail"))).groupBy("page_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return pages.select("page_id").join(n, "page_id").join(foreign.select("page_id").distinct(), "page_id", "left_anti")


def journeys_of(services: DataFrame, taken: DataFrame, least: int = 3) -> DataFrame:
    """journey, services, aliases of services(journey, id, alias) whose id nobody has taken, journeys with `least` services or more."""
    own = services.join(taken.select("id").distinct(), "id", "left_anti")
    return own.groupBy("journey").agg(F.count_distinct("id").alias("services"), F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases")).filter(F.col("services") >= least)


def goal_order(goals: DataFrame, needs: DataFrame) -> DataFrame:
    """(plan_id, goal, ord) with needs of (goal, other) only between goals of one plan: pairs(request_id, before, after) for layering."""
    ids = goals.select("plan_id", "goal")
    both = ids.join(needs, "goal").join(ids.withColumnRenamed("goal", "other"), ["plan_id", "other"], "left_semi")
    return both.select(F.col("plan_id").alias("request_id"), F.col("other").alias("before"), F.col("goal").alias("after")).distinct()


def grouped_by_stage(steps: DataFrame, stages: list[str]) -> DataFrame:
    """steps(journey, step, stage, verified) with grouped: whether putting them by stages leaves the verified numbers ascending."""
    rank = reduce(lambda w, s: w.when(F.col("stage") == s[1], s[0]), list(enumerate(stages))[1:], F.when(F.col("stage") == stages[0], 0)).otherwise(len(stages))
    w = Window.partitionBy("journey").orderBy("rank", "step")
    seen = steps.withColumn("rank", rank).filter("verified").withColumn("rises", F.coalesce(F.lag("step").over(w) < F.col("step"), F.lit(True)))
    return steps.join(seen.groupBy("journey").agg(F.bool_and("rises").alias("grouped")), "journey", "left").withColumn("grouped", F.coalesce("grouped", F.lit(True)))
