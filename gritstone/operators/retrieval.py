"""Retrieval of passages for questions about services: union of queries, topicality, reranking, passes and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gritstone.functions.text import tokens

#: Fixed: passages that a question keeps, those that a reranker keeps, and the least relevance of these.
SHORTLIST, KEEP, RELEVANT = 30, 8, 2


def anchors(name: Column, vocabulary: list[str]) -> Column:
    """Words of a name that the question's own vocabulary doesn't bring along."""
    return F.array_except(tokens(name), F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>"))


def topicality(heading: Column, url: Column, host: Column, phrases: Column, own_urls: Column, own_hosts: Column) -> Column:
    """3 for the service's own url, 2 if a whole phrase stands in the heading, 1 if one stands in the url or the host is the service's own, else 0. Phrases are arrays of words."""
    return topicality_of(tokens(heading), tokens(url), url, host, phrases, own_urls, own_hosts)


def topicality_of(heading: Column, address: Column, url: Column, host: Column, phrases: Column, own_urls: Column, own_hosts: Column) -> Column:
    """The same by the words of the heading and of the url, for pages that meet many services and are split into words once."""
    whole = lambda words: F.exists(phrases, lambda p: (F.size(p) > 0) & F.forall(p, lambda t: F.array_contains(words, t)))
    return F.when(F.array_contains(own_urls, url), 3).when(whole(heading), 2).when(whole(address) | F.array_contains(own_hosts, host), 1).otherwise(0)


def retrieved(asked: DataFrame, hits: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """question_id, chunk_id, score, query, whole, rank, status of hits(question_id, query, chunk_id, score, whole, topical).

    A chunk found by several queries counts with its best, not their sum. Chunks go by whole
    phrases, topicality, score and id; the first `most` stay. A question of asked(question_id) that nothing was
    found for keeps a row, NO_EVIDENCE_FOUND.
    """
    best = hits.groupBy("question_id", "chunk_id").agg(F.max("score").alias("score"), F.min_by("query", F.struct(-F.col("score"), F.col("query"))).alias("query"), F.max("whole").alias("whole"), F.max("topical").alias("topical"))
    w = Window.partitionBy("question_id").orderBy(F.desc("whole"), F.desc("topical"), F.desc(F.round("score", 6)), "chunk_id")
    few = best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return asked.select("question_id").distinct().join(few, "question_id", "left").withColumn("status", F.when(F.col("chunk_id").isNull(), "NO_EVIDENCE_FOUND").otherwise("FOUND"))


def reranked(shortlists: DataFrame, replies: DataFrame, most: int = KEEP) -> DataFrame:
    """question_id, chunk_id, relevance, place, ranked_by of shortlists(question_id, chunk_id, rank, topical, score) after replies(question_id, reply).

    A reply is JSON, an array of {id, relevance} with ids the ranks from 1: those out of range and
    further mentions don't count, relevance is held to 0 to 3, from RELEVANT on a chunk is kept, the best
    `most` by relevance, topicality, score and rank. Without a readable reply the first `most` stay in their order.
    """
    read = replies.select("question_id", F.from_json("reply", "array<struct<id:int,relevance:double>>", {"mode": "PERMISSIVE"}).alias("said")).filter("said is not null")
    named = read.select("question_id", F.posexplode("said").alias("at", "s")).select("question_id", "at", F.col("s.id").alias("rank"), F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.coalesce("s.relevance", F.lit(0.0)))).alias("relevance"))
    first = named.filter("rank is not null").groupBy("question_id", "rank").agg(F.min_by("relevance", "at").alias("relevance"))
    answered = read.select("question_id", F.lit(True).alias("answered")).distinct()
    held = shortlists.join(answered, "question_id", "left").join(first, ["question_id", "rank"], "left")
    kept = held.filter((F.col("answered") & (F.col("relevance") >= RELEVANT)) | F.col("answered").isNull())
    w = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("relevance"), F.when(F.col("answered"), -F.col("topical")), F.when(F.col("answered"), -F.col("score")), "rank")
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("question_id", "chunk_id", "relevance", "place", F.when(F.col("answered"), "MODEL").otherwise("RETRIEVAL").alias("ranked_by"))


def freshened(verdicts: DataFrame, shortlists: DataFrame) -> DataFrame:
    """shortlists with the relevance that verdicts(question_id, chunk_id, relevance) gave; everything else is today's."""
    return shortlists.drop("relevance").join(verdicts.select("question_id", "chunk_id", "relevance"), ["question_id", "chunk_id"], "left")


def next_pass(ledger: DataFrame, version: str, most: int = 2) -> DataFrame:
    """question_id, pass (null: done) by ledger(question_id, pass, retriever, status): the next one if all of this retriever's found nothing, up to `most`."""
    own = ledger.filter(F.col("retriever") == version).groupBy("question_id").agg(F.max("pass").alias("last"), F.bool_and(F.col("status") == "NO_EVIDENCE_FOUND").alias("empty"))
    told = ledger.select("question_id").distinct().join(own, "question_id", "left")
    return told.select("question_id", F.when(F.col("last").isNull(), 1).when(F.col("empty") & (F.col("last") < most), F.col("last") + 1).alias("pass"))


def ranks(shortlists: DataFrame, relevant: DataFrame) -> DataFrame:
    """question_id, first_relevant (0: never) of shortlists(question_id, chunk_id, rank) by relevant(question_id, chunk_id)."""
    hit = shortlists.join(relevant.select("question_id", "chunk_id").distinct(), ["question_id", "chunk_id"], "left_semi").groupBy("question_id").agg(F.min("rank").alias("r"))
    return relevant.select("question_id").distinct().join(hit, "question_id", "left").select("question_id", F.coalesce("r", F.lit(0)).alias("first_relevant"))


def measured(rows: DataFrame, by: str, rank: str = "first_relevant", cuts: tuple[int, ...] = (5, 10, 20, 30)) -> DataFrame:
    """by, cases, mrr and hit_k (whole per cents) of rows with a rank, 0 for never."""
    r = F.col(rank)
    return rows.groupBy(by).agg(F.count("*").alias("cases"), F.round(F.avg(F.when(r > 0, 1.0 / r).otherwise(0.0)), 6).alias("mrr"), *(F.round(100 * F.count_if(r.between(1, k)) / F.count("*")).cast("int").alias(f"hit_{k}") for k in cuts))


def agreement(kept: DataFrame, shortlists: DataFrame, top: int = KEEP) -> DataFrame:
    """question_id, agreed, rescued: how many kept chunks the first `top` of the shortlist have, and how many they don't."""
    first = shortlists.filter(F.col("rank") <= top).groupBy("question_id").agg(F.collect_set("chunk_id").alias("first"))
    own = kept.groupBy("question_id").agg(F.collect_set("chunk_id").alias("kept"))  # at most `top` each
    return own.join(first, "question_id").select("question_id", F.size(F.array_intersect("kept", "first")).alias("agreed"), F.size(F.array_except("kept", "first")).alias("rescued"))
