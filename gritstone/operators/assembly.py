"""A graph put together from all facts of all services at once: nodes, edges, what services say of themselves, and what was refused and why.

A fact makes up to three placements (by its kind, by the authority and by the output that its sentence names); all of them are rows of
one table, and everything else is grouping and joins on it. Whoever comes first, by fact_id, names a node and speaks on an edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritstone.functions import blocks as B, claims as C, sites as S
from gritstone.functions.fields import display, name_slug, title
from gritstone.sources.tables import kept, light

from .placement import FIELDS, destination, given, why_not

#: Fixed: hosts that prove themselves, quotes of a node or an edge, and rules that a service shows.
TRUSTED, QUOTES, SHOWN = r"(^|\.)(gov\.in|nic\.in)$", 12, 6
#: Fixed: kinds whose quotes speak for a service even where they make no node.
LOAD_BEARING = ("ELIGIBILITY", "DOCUMENT_REQUIREMENT", "FEE", "TIMELINE", "ACTION", "APP", "CHANNEL")
_PLACED = "struct<k:int,node:string,type:string,name:string,edge:string,at_document:string,cites:boolean>"


def _get(detail: Column, *names: str) -> Column:
    return F.coalesce(*(F.nullif(F.try_element_at(detail, F.lit(n)), F.lit("")) for n in names))


def _email(detail: Column) -> Column:
    value = F.lower(C.stripped(_get(detail, "email")))
    return F.when(value.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & F.regexp_extract(value, "@(.*)$", 1).rlike(TRUSTED), value)


def _placements() -> Column:
    """struct(found, reasons), an array of placements and one of reasons, of a fact with `document`, what is known of its object as a document, and `authored`, whether its service has steps already."""
    kind, detail, claim, thing, service, name, promoted = (F.col(c) for c in ("kind", "detail", "claim", "object", "service", "service_name", "promoted"))
    label = B.step_label(claim)
    office = C.office_name(detail, thing, claim, FIELDS)
    line, url = _get(detail, "phone", "number"), _get(detail, "url")

    def put(k: int, node: Column, type_: str, called: Column, edge: Column, cites: bool, document: Column | None = None) -> Column:
        return F.struct(F.lit(k).alias("k"), node.alias("node"), F.lit(type_).alias("type"), called.alias("name"), edge.alias("edge"), (document if document is not None else F.lit(None).cast("string")).alias("at_document"), F.lit(cites).alias("cites")).cast(_PLACED)

    def portal(d: Column) -> Column:
        path = F.regexp_extract(d["url"], r"^https?://[^/]+([^?#]*)", 1)
        node = F.concat(F.lit("portal:"), name_slug(d["host"]), F.when(d["root"], "").otherwise(F.concat(F.lit("_"), F.left(F.sha1(d["url"]), F.lit(6)))))
        return put(0, node, "PORTAL", F.when(d["root"], d["host"]).otherwise(F.concat(d["host"], path)), F.when(kind == "TRACKING", "TRACK_AT").otherwise("APPLY_AT"), True)

    both = kind.isin("CHANNEL", "TRACKING")
    lit, pre = F.lit, lambda p, s: F.concat(F.lit(p), s)
    step = (kind == "ACTION") & promoted & ~C.is_micro(claim) & ~F.col("authored") & (label != "")
    main = F.coalesce(
        F.when((kind == "DOCUMENT_REQUIREMENT") & ~thing.isin(FIELDS) & F.col("document"), put(0, pre("document:", thing), "DOCUMENT", title(thing), lit("REQUIRES"), False)),
        F.when(kind == "OFFICE", C.let(office, lambda o: F.when(o.isNotNull() & given(detail, "address", "phone"), put(0, pre("office:", name_slug(o)), "OFFICE", display(o), lit("VISIT_AT"), False)))),
        F.when((kind == "HELPLINE") & line.isNotNull(), put(0, pre("helpline:", name_slug(line)), "HELPLINE", display(F.coalesce(_get(detail, "name", "title"), F.concat(name, lit(" helpline")))), lit("CALL_IF"), False)),
        F.when(both, C.let(destination(url, TRUSTED), lambda d: F.when(d.isNotNull(), portal(d)))),
        F.when(kind == "CHANNEL", C.let(_email(detail), lambda e: F.when(e.isNotNull(), put(0, pre("helpline:", name_slug(e)), "HELPLINE", F.concat(display(name), lit(" by email")), lit("CALL_IF"), True)))),
        F.when(kind == "GRIEVANCE", put(0, pre("grievance:", name_slug(service)), "GRIEVANCE_CHANNEL", F.concat(lit("Grievances about "), F.lower(name)), lit("ESCALATE_TO"), False)),
        F.when(step, put(0, F.concat(lit("action:"), service, lit("_"), F.left(name_slug(label), lit(48))), "ACTION", display(label), lit("REQUIRES"), True)),
    )
    authority = lambda read: C.let(read["told"], lambda a: F.when(a.isNotNull(), put(1, pre("department:", name_slug(a["authority"])), "DEPARTMENT", display(a["authority"]), a["type"], True, F.when(a["type"] == "ISSUED_BY", pre("document:", thing)))))
    output = lambda read: F.when(promoted, C.let(read["told"], lambda o: F.when(o.isNotNull(), put(2, pre("output:", name_slug(o)), "OUTPUT", display(o), lit("PRODUCES"), True, pre("document:", name_slug(o))))))

    why = (
        F.when(kind == "DOCUMENT_REQUIREMENT", F.when(F.coalesce(thing, lit("")) == "", "INVALID_SCHEMA").when(thing.isin(FIELDS) | (F.col("document") == False), "NOT_A_DOCUMENT").otherwise("UNKNOWN_CANONICAL_ENTITY"))  # noqa: E712
        .when(kind == "APP", "UNSUPPORTED_KIND").when(both & url.isNotNull(), F.when(url.rlike(r"\s") | ~F.contains(url, lit(".")), "FAILED_NORMALIZATION").otherwise("UNTRUSTED_HOST"))
        .when((kind == "ACTION") & promoted & C.is_micro(claim), "NOT_A_CITIZEN_STEP").when((kind == "ACTION") & promoted & F.col("authored"), "ALREADY_OWNED")
        .when(kind == "FEE", F.when(~S.is_fee(kind, detail, claim), "NOT_A_CITIZEN_FEE")).when(kind == "TIMELINE", F.when(~S.is_wait(kind, detail, claim), "NOT_A_PROCESSING_TIME"))
        .when(kind == "ELIGIBILITY", F.when(~S.is_criterion(kind, claim), "NOT_A_CRITERION")).when(kind.isin("ACTION", "CHANNEL"), lit(None).cast("string")).otherwise(why_not(kind, detail))
    )
    nothing = F.lit(None).cast("struct<read:boolean,told:string>")
    reads = F.struct(C.authority_read(claim, promoted).alias("a"), F.when(promoted, C.output_read(claim)).otherwise(nothing).alias("o"))  # a sentence is read once, for what it places and for why it doesn't

    def told(r: Column, found: Column) -> Column:
        placed = F.exists(found, lambda p: p["k"] == 0)
        return F.struct(found.alias("found"), F.array_compact(F.array(F.when(~placed, why), F.when(C.refused(r["a"]), "NO_ACTOR"), F.when(promoted & C.refused(r["o"]), "NO_OUTPUT_NAMED"))).alias("reasons"))

    return C.let(reads, lambda r: C.let(F.array_compact(F.array(main, authority(r["a"]), output(r["o"]))), lambda found: told(r, found)))


def assembled(facts: DataFrame, documents: DataFrame, taken: DataFrame, authored: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, services and refused of facts(fact_id, service, service_name, host, url, kind, object, detail, claim, promoted).

    documents(phrase, document) tells which objects, as titles, are documents; taken(id) are ids that people's own graphs hold, which are linked to but not written again;
    authored(id) are services whose steps a person wrote. Null claims and details say nothing; `promoted` null is false.

    - An authority that issues something is an edge of the document, where any fact makes that one, else of the service; an output is the document of that name, where there is one, else a node of its own.
    - Edges are one for each id; a service doesn't require what it produces; an edge has both ends among the nodes or the taken.
    - A service with a quote that bears it gets a node with its first fee and wait and up to six rules, a payment node for its fees, and its host as a portal; without, it is refused as NO_QUOTABLE_EVIDENCE
      and none of its edges stay.
    """
    told = facts.withColumn("claim", F.coalesce("claim", F.lit(""))).withColumn("promoted", F.coalesce("promoted", F.lit(False))).withColumn("detail", F.coalesce("detail", F.create_map().cast("map<string,string>")))
    known = documents.select(F.col("phrase").alias("_phrase"), "document")
    held = told.withColumn("_phrase", title(F.col("object"))).join(known, "_phrase", "left").drop("_phrase")
    acts = F.coalesce((F.col("kind") == "ACTION") & F.col("promoted"), F.lit(False))  # of these alone it matters who wrote their service's steps, so only these are shuffled for it
    owned = held.filter(acts).join(authored.select(F.col("id").alias("_owned"), F.lit(True).alias("authored")).distinct(), F.concat(F.lit("service:"), "service") == F.col("_owned"), "left").drop("_owned").withColumn("authored", F.coalesce("authored", F.lit(False)))
    held = held.filter(~acts).withColumn("authored", F.lit(False)).unionByName(owned)
    fee, wait, rule = S.is_fee(F.col("kind"), F.col("detail"), F.col("claim")), S.is_wait(F.col("kind"), F.col("detail"), F.col("claim")), S.is_criterion(F.col("kind"), F.col("claim"))
    placed = held.select("fact_id", "service", "service_name", "host", "kind", "claim", fee.alias("fee"), wait.alias("wait"), rule.alias("rule"), F.inline(F.array(_placements())))
    bears = F.col("kind").isin(*LOAD_BEARING) & ~F.array_contains("reasons", "INVALID_SCHEMA") & ~F.col("kind").isin("DOCUMENT_REQUIREMENT", "APP") & ~F.exists("reasons", lambda r: r.isin("NOT_A_CITIZEN_STEP", "ALREADY_OWNED", "UNTRUSTED_HOST", "FAILED_NORMALIZATION"))
    speaks = bears | F.exists("found", lambda p: p["cites"])
    read = kept(placed.select("fact_id", "service", "service_name", "host", "claim", "fee", "wait", "rule", speaks.alias("speaks"), "found", "reasons"))  # sentences are read once, for all that is made of them

    each = read.select("fact_id", "service", "claim", F.explode("found").alias("p")).select("fact_id", "service", "claim", "p.*")
    made = each.filter("type = 'DOCUMENT'").select(F.col("node").alias("at_document"), F.lit(True).alias("there")).distinct()
    each = each.join(light(made), "at_document", "left").withColumn("there", F.coalesce("there", F.lit(False)))
    output = F.col("type") == "OUTPUT"
    service = F.concat(F.lit("service:"), "service")
    each = each.withColumn("src", F.when((F.col("type") == "DEPARTMENT") & F.col("there"), F.col("at_document")).otherwise(service)).withColumn("node", F.when(output & F.col("there"), F.col("at_document")).otherwise(F.col("node"))).withColumn("type", F.when(output & F.col("there"), "DOCUMENT").otherwise(F.col("type")))

    first = lambda c, v, name: F.min_by(v, F.when(c, F.col("fact_id"))).alias(name)
    one = read.groupBy("service").agg(F.bool_or("speaks").alias("speaks"), F.min_by("service_name", "fact_id").alias("name"), F.min_by("host", "fact_id").alias("host"), first(F.col("fee"), F.col("claim"), "fee"), first(F.col("wait"), F.col("claim"), "wait"))
    rules = read.filter("rule").groupBy("service", "claim").agg(F.min("fact_id").alias("fact_id"))
    w = Window.partitionBy("service").orderBy("fact_id")
    shown = rules.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= SHOWN).groupBy("service").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "claim"))), lambda x: x["claim"]).alias("rules"))
    held_ids = taken.select("id").distinct()
    own = one.join(shown, "service", "left").withColumn("id", service)
    services = own.filter("speaks").join(held_ids, "id", "left_anti").select("id", display(F.col("name")).alias("name"), "host", "fee", F.col("wait").alias("timeline"), F.coalesce("rules", F.array().cast("array<string>")).alias("eligibility"))
    silent = own.filter("not speaks").select(F.lit(None).cast("bigint").alias("fact_id"), "service", F.lit("NO_QUOTABLE_EVIDENCE").alias("reason"))

    extra = [
        services.filter("fee is not null").select(F.lit(None).cast("bigint").alias("fact_id"), F.col("id").alias("src"), F.concat(F.lit("payment:"), F.substr("id", F.lit(9)), F.lit("_fee")).alias("node"), F.lit("PAYMENT").alias("type"), F.concat(F.lit("Pay the fee for "), "name").alias("name"), F.lit("REQUIRES").alias("edge"), F.col("fee").alias("claim")),
        services.select(F.lit(None).cast("bigint").alias("fact_id"), F.col("id").alias("src"), F.concat(F.lit("portal:"), name_slug(F.col("host"))).alias("node"), F.lit("PORTAL").alias("type"), F.col("host").alias("name"), F.lit("APPLY_AT").alias("edge"), F.concat(F.lit("Published on "), "host", F.lit(".")).alias("claim")),
    ]
    links = reduce(DataFrame.unionByName, extra, each.select("fact_id", "src", "node", "type", "name", "edge", "claim"))
    rank = F.coalesce("fact_id", F.lit((1 << 63) - 1))  # what a service adds itself comes after its facts
    nodes = links.groupBy("node").agg(F.min_by("type", rank).alias("type"), F.min_by("name", F.struct(rank, "name")).alias("name")).withColumnRenamed("node", "id").join(held_ids, "id", "left_anti")
    nodes = nodes.unionByName(services.select("id", F.lit("SERVICE").alias("type"), "name"))

    made_id = F.left(F.concat(F.lit("e:"), name_slug(F.col("src")), F.lit("__"), F.lower("edge"), F.lit("__"), name_slug(F.col("node"))), F.lit(120))
    edges = links.groupBy("src", "node", "edge").agg(F.min_by("claim", F.struct(rank, "claim")).alias("note"), F.min(rank).alias("at"))
    produced = edges.filter("edge = 'PRODUCES'").select("src", "node", F.lit("REQUIRES").alias("edge"))
    edges = edges.join(produced, ["src", "node", "edge"], "left_anti").withColumn("id", made_id)
    edges = edges.groupBy("id").agg(F.min(F.struct("at", "src", "node", "edge", "note")).alias("e")).select("id", "e.src", F.col("e.node").alias("dst"), F.col("e.edge").alias("type"), "e.note")
    live = nodes.select("id").union(held_ids).distinct()
    whole = edges.filter("dst is not null").join(live.withColumnRenamed("id", "src"), "src", "left_semi").select("id", "src", "dst", "type", "note")  # what an edge leads to is a node or taken: nodes are made from these same links
    refused = read.select("fact_id", "service", F.explode("reasons").alias("reason")).union(silent)
    return {"nodes": nodes, "edges": whole, "services": services, "refused": refused}
