"""Ledgers: gates with ordered reasons, tallies, stages, back-off and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritstone.functions.text import norm

from .bundles import numbered

#: Fixed: hours that a failed address isn't asked again, by reason; 24 for others.
BACKOFF_HOURS = {"HTTP_404": 8760, "HTTP_410": 8760, "SOFT_404": 8760, "BLOCKED_BY_SITE": 24, "TIMEOUT": 24, "TLS_FAIL": 24, "DNS_FAIL": 168, "HTTP_ERROR": 24, "TOO_THIN": 720, "NOT_TEXT": 8760, "SCANNED_PDF": 8760, "EMPTY_RENDER": 720, "AUTH_REQUIRED": 8760, "CAPTCHA": 8760}
#: Fixed: kinds of facts, and reasons of rejections in the order in which a fact is asked for them.
KINDS = "ELIGIBILITY DOCUMENT_REQUIREMENT CONDITIONAL_REQUIREMENT ACCEPTED_ALTERNATIVES CHANNEL TIMELINE FEE OFFICE HELPLINE GRIEVANCE TRACKING APP ACTION DEPENDENCY EXTERNAL_DEPENDENCY BLOCKER".split()
REASONS = "INVALID_SCHEMA MISSING_SOURCE UNSUPPORTED_KIND EVIDENCE_NOT_VERBATIM NOT_ABOUT_THIS_SERVICE DUPLICATE".split()


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that holds; null if none does."""
    return reduce(lambda w, r: w.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))


def gated(facts: DataFrame, pages: DataFrame) -> DataFrame:
    """facts(fact_id, page_id, kind, subject, object, evidence, confidence) with reason (null: kept), note and clamped confidence.

    A fact is asked, in order, whether it says anything, its page(page_id, text) is there, its kind is one of
    KINDS, its quote of 12 characters or more stands in the page, and whether an earlier fact of
    the page with its kind, subject, object and quote was kept.
    """
    quote = norm(F.col("evidence"))
    asked = facts.withColumn("kind", F.upper(F.trim("kind"))).withColumn("quote", quote)
    # pages that are asked about are normalised once each, before they meet their facts
    bodies = pages.join(facts.select("page_id").distinct(), "page_id", "left_semi").select("page_id", norm(F.col("text")).alias("body"), F.lit(True).alias("there"))
    held = asked.join(bodies, "page_id", "left")
    rules = first_reason(
        ("INVALID_SCHEMA", F.col("evidence").isNull() & F.col("kind").isNull()), ("MISSING_SOURCE", F.col("there").isNull()), ("UNSUPPORTED_KIND", ~F.coalesce(F.col("kind").isin(KINDS), F.lit(False))),
        ("EVIDENCE_NOT_VERBATIM", ~F.coalesce((F.length("quote") >= 12) & F.contains("body", F.col("quote")), F.lit(False))),
    )
    told = held.withColumn("reason", rules).drop("body", "there")
    w = Window.partitionBy("page_id", "kind", "subject", "object", "quote", F.col("reason").isNull()).orderBy("fact_id")
    reason = F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "DUPLICATE").otherwise(F.col("reason"))
    note = F.when(reason == "EVIDENCE_NOT_VERBATIM", F.when(F.coalesce(F.length("quote"), F.lit(0)) < 12, "shorter than a quote").otherwise("not on the page"))
    return told.withColumn("note", note).withColumn("reason", reason).withColumn("confidence", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.5))))).drop("quote")


def tally(rejected: DataFrame, declared: list[str]) -> DataFrame:
    """reason, n, examples (the first five by fact_id) of rejected(reason, fact_id), and declared reasons that nothing was rejected for with 0."""
    w = Window.partitionBy("reason").orderBy("fact_id")
    few = rejected.withColumn("k", F.row_number().over(w)).filter("k <= 5").groupBy("reason").agg(F.sort_array(F.collect_list("fact_id")).alias("examples"))
    counts = rejected.groupBy("reason").agg(F.count("*").alias("n")).join(few, "reason")
    codes = rejected.sparkSession.createDataFrame([(r,) for r in declared], "reason string")
    return codes.join(counts, "reason", "full_outer").select("reason", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.array_join("examples", ","), F.lit("")).alias("examples"))


def negatives(failures: DataFrame) -> DataFrame:
    """url, reason, recorded_at, blocked_until: the last of failures(url, reason, recorded_at, seq) of each url, blocked for its reason's hours."""
    hours = reduce(lambda w, r: w.when(F.col("reason") == r[0], r[1]), list(BACKOFF_HOURS.items())[1:], F.when(F.col("reason") == "HTTP_404", BACKOFF_HOURS["HTTP_404"])).otherwise(24)
    last = failures.groupBy("url").agg(F.max_by(F.struct("reason", "recorded_at"), "seq").alias("x")).select("url", "x.reason", "x.recorded_at")
    return last.withColumn("blocked_until", F.col("recorded_at") + F.make_dt_interval(F.lit(0), hours))


def replaced(stored: DataFrame, rows: DataFrame, stages: list[str]) -> DataFrame:
    """stored with the rows of those stages replaced by rows."""
    return stored.filter(~F.col("stage").isin(stages)).unionByName(rows)


def discovered(links: DataFrame, most: int, least: int) -> DataFrame:
    """links(url, score) with rank and state: the best `most` of those scoring at least `least` are DISCOVERED, others SKIPPED_OVER_CAP or SKIPPED_LOW_SCORE.

    Urls are ranked in ranges of score and url, which are ordered apart.
    """
    eligible = links.filter(F.col("score") >= least)
    ranked = numbered(eligible, F.desc("score"), F.col("url")).withColumnRenamed("ord", "rank")
    state = F.when(F.col("rank") <= most, "DISCOVERED").otherwise("SKIPPED_OVER_CAP")
    low = links.filter(F.col("score") < least).select("url", "score", F.lit(None).cast("bigint").alias("rank"), F.lit("SKIPPED_LOW_SCORE").alias("state"))
    return ranked.select("url", "score", "rank", state.alias("state")).union(low)


def merged_sources(cited: DataFrame, files: DataFrame) -> DataFrame:
    """url, journeys (sorted), title, verified, status of cited(url, journey, ord, title, verified, failed) with files(url, content_hash).

    Titles are the first that isn't null by ord; flags hold if any row's does. A source is CACHED
    with a file, FETCH_FAILED if a fetch failed, NO_CACHE_FILE otherwise.
    """
    one = cited.groupBy("url").agg(
        F.array_join(F.array_sort(F.collect_set("journey")), ",").alias("journeys"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("ord"))).alias("title"),
        F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"),
    )
    held = one.join(files.select("url", F.lit(True).alias("there")).distinct(), "url", "left")
    return held.select("url", "journeys", "title", "verified", first_reason(("CACHED", F.col("there").isNotNull()), ("FETCH_FAILED", F.col("failed")), ("NO_CACHE_FILE", F.lit(True))).alias("status"))


def clamped_balance(moves: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """moves(keys, amount) with spent, the running sum that never falls below 0: the sum less its least value so far, if that is under 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("_sum", F.sum("amount").over(w)).withColumn("spent", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def gapless(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, n, gapless: whether the distinct numbers of a key are exactly 1 to n."""
    return rows.groupBy(*keys).agg(F.count_distinct(number).alias("n"), ((F.min(number) == 1) & (F.max(number) == F.count_distinct(number))).alias("gapless"))


def dealt(cases: DataFrame, stratum: str, key: str, most: int) -> DataFrame:
    """`most` of the cases, the first of each stratum by SHA-1 of the key, then the second of each, and so on: position tells the order."""
    held = cases.withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(F.sha1(F.col(key).cast("string")))))
    few = held.orderBy("turn", stratum).limit(most)
    return few.withColumn("position", F.row_number().over(Window.orderBy("turn", stratum)))  # at most `most` rows
