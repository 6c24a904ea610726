"""Cases looked up in pages: which addresses are read, which claims hold, what a case comes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritstone.functions import sites as S
from gritstone.sources.tables import kept

#: Fixed: addresses of a wave, waves, readable pages that are enough; permissions and triggers that a report lists.
WAVE, WAVES, ENOUGH, LISTED, TRIGGERS = 8, 2, 6, 12, 4


def candidates(found: DataFrame) -> DataFrame:
    """case_id, url, place of found(case_id, url, at): official addresses of no other state that state rules, each once, by rank of source, then as they were found."""
    good = found.filter(S.official(F.col("url")) & ~S.wrong_state(F.col("url")) & S.states_a_rule(F.col("url")))
    once = good.groupBy("case_id", "url").agg(F.min("at").alias("at"))
    w = Window.partitionBy("case_id").orderBy(S.source_rank(F.col("url")), "at", "url")
    return once.withColumn("place", F.row_number().over(w)).select("case_id", "url", "place")


def read(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """case_id, url, place, readable of the addresses in listed(case_id, url, place) that a case tries: its first wave, and the second only if the first gave fewer than ENOUGH pages(url, text) with a text."""
    texts = pages.filter("text is not null and text <> ''").select("url").distinct().withColumn("readable", F.lit(True))
    few = listed.filter(F.col("place") <= WAVE * WAVES).join(texts, "url", "left").withColumn("readable", F.coalesce("readable", F.lit(False)))
    first = F.count_if((F.col("place") <= WAVE) & F.col("readable")).over(Window.partitionBy("case_id"))  # at most WAVE * WAVES rows a case
    return few.withColumn("_first", first).filter((F.col("place") <= WAVE) | (F.col("_first") < ENOUGH)).drop("_first")


def standing(claims: DataFrame) -> DataFrame:
    """claims(source_url, evidence, ...) whose quote is a sentence and whose source is official and of no other state."""
    return claims.filter(S.is_sentence(F.col("evidence")) & S.official(F.col("source_url")) & ~S.wrong_state(F.col("source_url")))


def _trigger(c: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), F.lit(""))


def judged(cases: DataFrame, claims: DataFrame) -> DataFrame:
    """case_id, status, claims, conflicts, permissions of cases(case_id) by claims(case_id, permission_id, permission, host, trigger, exemption, at).

    A permission is CONFLICTING for a case if two hosts or more tell it with more than one trigger. A case without claims is UNVERIFIED, with one it is VERIFIED if
    any claim has a trigger or an exemption, else EXTRACTED_PENDING_REVIEW. `conflicts` counts permissions, `permissions` are the first twelve names in order of `at`.
    """
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    told_by = claims.groupBy("case_id", F.coalesce("permission_id", F.lower("permission")).alias("key"), "permission", "host", _trigger("trigger").alias("said"))
    rows = kept(told_by.agg(F.count("*").alias("n"), F.bool_or(some("trigger") | some("exemption")).alias("conditional"), F.min("at").alias("at")))  # claims are read once
    each = rows.groupBy("case_id", "key").agg(F.count_distinct("host").alias("hosts"), F.count_distinct("said").alias("triggers"))
    clash = each.withColumn("bad", (F.col("hosts") >= 2) & (F.col("triggers") > 1)).groupBy("case_id").agg(F.count_if("bad").alias("conflicts"))
    told = rows.groupBy("case_id").agg(F.sum("n").alias("claims"), F.bool_or("conditional").alias("conditional"))
    first = rows.groupBy("case_id", "permission").agg(F.min("at").alias("at")).withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("at", "permission"))).filter(F.col("k") <= LISTED)
    names = first.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "permission"))), lambda x: x["permission"]).alias("permissions"))
    held = cases.select("case_id").distinct().join(told, "case_id", "left").join(clash, "case_id", "left").join(names, "case_id", "left")
    status = F.when(F.col("claims").isNull(), "UNVERIFIED").when(F.col("conflicts") > 0, "CONFLICTING").when(F.col("conditional"), "VERIFIED").otherwise("EXTRACTED_PENDING_REVIEW")
    return held.select("case_id", status.alias("status"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("permissions", F.array().cast("array<string>")).alias("permissions"))


def reported(records: DataFrame) -> DataFrame:
    """One row of counts: cases, those of each status, and claims."""
    n = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return records.agg(F.count("*").alias("cases"), n("VERIFIED", "verified"), n("CONFLICTING", "conflicting"), n("EXTRACTED_PENDING_REVIEW", "pending_review"), n("UNVERIFIED", "unverified"), F.coalesce(F.sum("claims"), F.lit(0)).alias("claims"))
