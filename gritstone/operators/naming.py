"""Names held against dictionaries and against each other: longest matches, absorption, headings, protection, queries, cached classes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gritstone.functions.fields import name_slug, readable, shorten

#: Dictionary rows up to which a join broadcasts it (a few MB); a larger one is joined by a shuffle.
SMALL = 50_000
#: Fixed: words that may follow a service's name and leave it the same service.
SAME_SERVICE = frozenset("system scheme schemes portal online service services application form gujarat registration".split())
#: Most queries of a service and dimension.
MOST_QUERIES = 5


def _light(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def longest_match(texts: DataFrame, dictionary: DataFrame, whole_words: bool) -> DataFrame:
    """text, code of each distinct text of texts(text) with a pattern of dictionary(pattern, code, place): the longest pattern wins, then the least place.

    Patterns are of letters a to z. With whole_words a pattern is one of the text's words; without, it may lie
    anywhere among its letters, whatever stands between them. Pieces of the dictionary's lengths are joined by
    equality, so a row's work grows with its own length and the number of lengths, not with the dictionary.
    """
    own = texts.select("text").filter("text is not null").distinct()
    words = dictionary.select("pattern", "code", "place")
    if whole_words:
        pieces = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "))
    else:
        lengths = [r.n for r in words.select(F.length("pattern").alias("n")).distinct().collect()]  # a few numbers
        flat = F.regexp_replace(F.lower("text"), "[^a-z]", "")
        cut = lambda n: F.when(F.length(flat) >= n, F.transform(F.sequence(F.lit(1), F.length(flat) - (n - 1)), lambda i: F.substr(flat, i, F.lit(n))))
        pieces = F.array_distinct(F.flatten(F.array(*(F.coalesce(cut(n), F.array().cast("array<string>")) for n in sorted(lengths)))))
    hits = own.select("text", F.explode(pieces).alias("pattern")).join(_light(words), "pattern")
    best = F.min(F.struct((-F.length("pattern")).alias("n"), "place", "code"))
    return hits.groupBy("text").agg(best.alias("b")).select("text", "b.code")


def absorbed(services: DataFrame) -> DataFrame:
    """journey, id, into of services(journey, id, place): `into` is the longest id of the journey that is this one followed by filler words only, the least place on a tie; null for those that stay.

    An id's prefixes before its closing filler words are joined by equality. Whoever is absorbed by an id that is absorbed itself is
    absorbed by the longer one too, so one step settles all.
    """
    words = F.split("id", "_")
    kept = F.filter(F.transform(words, lambda w, i: F.when(~w.isin(*sorted(SAME_SERVICE)), i + 1)), lambda n: n.isNotNull())  # places of words that must stay
    least = F.greatest(F.lit(1), F.coalesce(F.array_max(kept), F.lit(0)))
    shorter = F.when(F.size(words) > least, F.transform(F.sequence(least, F.size(words) - 1), lambda n: F.array_join(F.slice(words, 1, n), "_")))
    longer = services.select("journey", F.col("id").alias("into"), F.col("place").alias("at"), F.explode(shorter).alias("id"))
    best = longer.groupBy("journey", "id").agg(F.min(F.struct((-F.length("into")).alias("n"), "at", "into")).alias("b")).select("journey", "id", "b.into")
    return services.select("journey", "id").join(best, ["journey", "id"], "left")


def headings(ids: DataFrame) -> DataFrame:
    """journey, id, under of ids(journey, id) of one word that two or more other ids of the journey have among two or more words that aren't filler."""
    words = F.filter(F.split("id", "_"), lambda w: ~w.isin(*sorted(SAME_SERVICE)))
    over = ids.select("journey", words.alias("w")).filter(F.size("w") > 1).select("journey", F.explode(F.array_distinct("w")).alias("id"))
    many = over.groupBy("journey", "id").agg(F.count("*").alias("under")).filter("under >= 2")
    return ids.filter(~F.contains("id", F.lit("_"))).select("journey", "id").distinct().join(many, ["journey", "id"])


def grouped_services(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(services, headings): found(journey, id, name, alias, page, place) by service, shorter names folded into longer ones and headings taken out.

    A service is named by its own first row; its aliases are the rows' and the names, in lower case, of those it absorbed.
    """
    ids = found.groupBy("journey", "id").agg(F.min("place").alias("place"), F.min_by("name", F.struct("place", "page")).alias("name"))
    into = absorbed(ids)
    stay = into.filter("into is null").select("journey", "id")
    over = headings(stay)
    told = found.select("journey", "id", "alias", "page").join(into, ["journey", "id"]).select("journey", F.coalesce("into", "id").alias("id"), "alias", "page")
    lower = ids.join(into.filter("into is not null"), ["journey", "id"]).select("journey", F.col("into").alias("id"), F.lower("name").alias("alias"), F.lit(None).alias("page"))
    rows = told.unionByName(lower).groupBy("journey", "id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.count_distinct("page").alias("pages"))
    services = rows.join(over.select("journey", "id"), ["journey", "id"], "left_anti").join(ids.select("journey", "id", "name"), ["journey", "id"])
    return services, over


def taken_ids(nodes: DataFrame) -> DataFrame:
    """id that nodes(id, type, name, official, aliases) hold, and those that a service's names and aliases would make."""
    phrases = F.explode(F.concat(F.array("name", "official"), F.coalesce("aliases", F.array().cast("array<string>"))))
    slugs = nodes.filter("type = 'SERVICE'").select(phrases.alias("p")).select(name_slug(F.col("p")).alias("s"))
    return nodes.select("id").union(slugs.filter("s is not null and s <> ''").select(F.concat(F.lit("service:"), "s"))).distinct()


def unprotected(services: DataFrame, nodes: DataFrame) -> DataFrame:
    """The services(id, ...) whose id no node holds, by itself or by a service's names."""
    held = taken_ids(nodes).withColumnRenamed("id", "node")
    return services.join(held, F.concat(F.lit("service:"), services["id"]) == held["node"], "left_anti")


class Unclassified(RuntimeError):
    """Too few phrases have a class for anything to be written."""


def classified(phrases: DataFrame, cache: DataFrame, version: int, ask: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """phrase, document (null if unanswered) of the distinct phrases(phrase), by cache(phrase, document, version) and, for the others, by ask(phrases) -> (phrase, document).

    Answers of the asked pass through `keep`, which stores them and gives them back, so a second run asks only for new phrases; answers
    to what wasn't asked are dropped. If half of all phrases or more stay without a class, Unclassified is raised and nothing is returned to be written.
    """
    own = phrases.select("phrase").distinct()
    known = cache.filter(F.col("version") == version).groupBy("phrase").agg(F.max("document").alias("document"))
    asked = own.join(known, "phrase", "left_anti")
    fresh = keep(ask(asked).join(asked, "phrase", "left_semi").groupBy("phrase").agg(F.max("document").alias("document")).filter("document is not null").withColumn("version", F.lit(version)))
    told = own.join(known.unionByName(fresh.select("phrase", "document")), "phrase", "left")
    total, open_ = told.agg(F.count("*"), F.count_if(F.col("document").isNull())).first()
    if total and open_ * 2 >= total:
        raise Unclassified(f"{open_} of {total} phrases have no class")
    return told


def _heads(terms: list[str]) -> tuple[str, str | None]:
    ascii_ = [t for t in terms if all(" " <= c <= "~" for c in t)]
    rest = [t for t in terms if t not in ascii_]
    return (ascii_ or [""])[0], (rest or [None])[0]


def service_scopes(services: DataFrame, dictionary: DataFrame, root: str) -> DataFrame:
    """service_id, scope of services(service_id, name, scope_id, urls): what it says unless that is the root, else the first url's whose host names one, else its name's; null without any."""
    host = F.regexp_extract("url", r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    each = services.select("service_id", F.posexplode("urls").alias("at", "url")).select("service_id", "at", F.lower(host).alias("text")).filter("text <> ''")
    by_host = each.join(longest_match(each, dictionary, whole_words=False), "text").groupBy("service_id").agg(F.min_by("code", "at").alias("by_host"))
    names = services.select("service_id", F.col("name").alias("text"))
    by_name = names.join(longest_match(names, dictionary, whole_words=True), "text").groupBy("service_id").agg(F.first("code").alias("by_name"))
    own = F.when(F.col("scope_id") != root, F.nullif("scope_id", F.lit("")))
    return services.select("service_id", own.alias("own")).join(by_host, "service_id", "left").join(by_name, "service_id", "left").select("service_id", F.coalesce("own", "by_host", "by_name").alias("scope"))


def queries_for(missing: DataFrame, scopes: DataFrame, near: DataFrame, vocabulary: dict[str, list[str]]) -> DataFrame:
    """service_id, dimension, place, query, scope of missing(service_id, name, dimension): up to five searches each, the most specific first.

    In order: name and head word within the scope; the same anywhere; name and the head of another script; the first
    near(service_id, near) and the short name; the short name alone. No two have the same words, in lower case, and scope. Dimensions without vocabulary are a ValueError.
    """
    unknown = missing.select("dimension").distinct().filter(~F.col("dimension").isin(*vocabulary)).first()
    if unknown:
        raise ValueError(f"{unknown.dimension} is no dimension to search for")
    spark = missing.sparkSession
    heads = spark.createDataFrame([(d, *_heads(t)) for d, t in vocabulary.items()], "dimension string, head string, other string")
    told = missing.withColumn("name", readable(F.col("name"))).filter("name <> ''").join(F.broadcast(heads), "dimension").join(scopes, "service_id", "left").join(near, "service_id", "left").withColumn("short", shorten(F.col("name")))

    def one(query: Column, scope: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.trim(F.regexp_replace(query, r"\s+", " ")).alias("query"), scope.alias("scope")))

    scope, none, sp = F.col("scope"), F.lit(None).cast("string"), F.lit(" ")
    made = F.array(
        one(F.concat("name", sp, "head"), scope, F.lit(True)),
        one(F.concat("name", sp, "head"), none, scope.isNotNull()),
        one(F.concat("name", sp, "other"), scope, F.col("other").isNotNull()),
        one(F.concat("near", sp, "short", sp, "head"), scope, F.col("near").isNotNull()),
        one(F.concat("short", sp, "head"), scope, F.lower("short") != F.lower("name")),
    )
    keyed = F.transform(F.filter(made, lambda q: q.isNotNull() & (q["query"] != "")), lambda q: F.struct(F.concat(F.lower(q["query"]), F.lit("|"), F.coalesce(q["scope"], F.lit(""))).alias("key"), q.alias("q")))
    first = told.withColumn("made", keyed).withColumn("made", F.filter("made", lambda x, i: F.array_position(F.transform("made", lambda y: y["key"]), x["key"]) == i + 1))
    each = first.select("service_id", "dimension", F.posexplode(F.slice("made", 1, MOST_QUERIES)).alias("at", "m"))
    return each.select("service_id", "dimension", (F.col("at") + 1).alias("place"), "m.q.query", "m.q.scope")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """service_id, near: the first, by place, office, department or document that edges(src, dst, place) attach, by its official or its plain name; names of hosts and of three characters or fewer don't count."""
    named = nodes.filter(F.col("type").isin("OFFICE", "DEPARTMENT", "DOCUMENT")).select(F.col("id").alias("dst"), readable(F.coalesce(F.nullif("official", F.lit("")), "name")).alias("near"))
    good = edges.join(named, "dst").filter((F.length("near") > 3) & ~F.col("near").rlike(r"\.(gov|nic|com|org|in)\b"))
    return good.groupBy(F.col("src").alias("service_id")).agg(F.min_by("near", F.struct("place", "near")).alias("near"))
