"""Passage search: postings, BM25, term coverage, copies and retrieval measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gritstone.functions.fields import NOT_EVIDENCE, intent_tokens
from gritstone.functions.text import norm, stem, tokens
from gritstone.sources.tables import BROADCAST_ROWS, cut, kept, light

K1, B = 1.2, 0.75
#: Terms or keys of a query side that may become literals of a plan.
LITERALS = 20_000
#: Scores of documents by queries that a task holds at once, and a score's distance from half a unit of the fifth place below which it isn't rounded here.
CELLS, UNSURE = 1 << 19, 1e-6


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, length of docs(doc_id, text)."""
    worded = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    exploded = worded.select("doc_id", F.size("words").alias("length"), F.explode("words").alias("term"))
    return exploded.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def few(df: DataFrame, column: str) -> list | None:
    """The distinct values of a column if they are at most LITERALS, to become part of a plan; else null."""
    told = [r[0] for r in df.select(column).distinct().limit(LITERALS + 1).collect()]
    return told if len(told) <= LITERALS else None


def _idf() -> Column:
    return F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def _sized(docs: DataFrame, terms: list | None, keep: Column | None) -> DataFrame:
    """doc_id, keep, length and the words of each document, if terms are given those among them; the texts are read once."""
    words = tokens(F.col("text"))
    own = F.filter(words, lambda w: w.isin(terms)) if terms is not None else words
    return docs.select("doc_id", (F.lit(True) if keep is None else keep).alias("keep"), F.size(words).alias("length"), own.alias("words"))


def _weighed(docs: DataFrame, asked: DataFrame, keep: Column | None) -> DataFrame:
    """doc_id, term, part: what each asked term adds to a kept document's score. Document frequencies, lengths and counts are those of all documents, which are read once."""
    terms = few(asked, "term")
    sized = cut(_sized(docs, terms, keep))
    total = sized.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    rows = sized.select("doc_id", "keep", "length", F.explode("words").alias("term"))
    rows = rows if terms is not None else rows.join(asked.select("term").distinct(), "term", "left_semi")
    found = rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("keep").alias("keep"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    part = _idf() * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))
    own = (lambda x: F.broadcast(x)) if terms is not None else (lambda x: x)  # at most LITERALS terms
    return found.filter("keep").join(own(df), "term").crossJoin(F.broadcast(total)).select("doc_id", "term", part.alias("part"))  # total is one row


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).distinct()


def bm25(docs: DataFrame, queries: DataFrame, keep: Column | None = None) -> DataFrame:
    """item_id, doc_id, score of every document that has a term of the query.

    Terms of a query count once. `keep` drops documents before scoring, while document
    frequencies, lengths and counts stay those of all documents.
    """
    asked = _asked(queries)
    return _weighed(docs, asked, keep).join(light(asked), "term").groupBy("item_id", "doc_id").agg(F.sum("part").alias("score"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, seeds: int = 4) -> DataFrame:
    """item_id, doc_id, score, rank: what ranked(bm25(...), k) gives, without scoring documents that can't be among the k best.

    Each term has a greatest part, over all documents. The `seeds` strongest terms of a query give k documents a
    score that the k-th best can't be below. Terms whose greatest parts together stay below that can't bring a document
    in by themselves, and common words are among them: only documents with one of the others become candidates, are dropped
    if what they have and all the weak terms together can't reach, and get their weak terms looked up one by one.

    A query side of up to LITERALS terms and BROADCAST_ROWS of its words travels to the documents instead: a document is
    scored where it lies, and only what a task's documents can't rule out is shuffled.
    """
    asked = cut(_asked(queries))
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS and docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long"):
        terms = few(asked, "term")
        if terms is not None:
            return ranked(_scored_in_place(docs, asked, terms, k, keep), k)
    weighed = cut(_weighed(docs, asked, keep))
    most = weighed.groupBy("term").agg(F.max("part").alias("most"))
    own = asked.join(light(cut(most)), "term")  # terms that no document has are gone
    by_query = Window.partitionBy("item_id").orderBy(F.desc("most"), "term")  # a query's terms
    own = cut(own.withColumn("n", F.row_number().over(by_query)).withColumn("from_here", F.sum("most").over(by_query.rowsBetween(0, Window.unboundedFollowing))))
    sums = lambda terms: weighed.join(light(terms), "term").groupBy("item_id", "doc_id").agg(F.sum("part").alias("score"))
    seeded = sums(own.filter(F.col("n") <= seeds).select("item_id", "term"))
    floor = seeded.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score")))).filter(F.col("r") == k).select("item_id", (F.col("score") - 1e-4).alias("floor"))
    told = own.join(light(cut(floor)), "item_id", "left").withColumn("strong", F.coalesce(F.col("from_here") >= F.col("floor"), F.lit(True)))
    told = cut(told.select("item_id", "term", "most", "floor", "strong"))
    strong, weak = told.filter("strong").select("item_id", "term"), told.filter("not strong")
    reach = told.groupBy("item_id").agg(F.first("floor").alias("floor"), F.coalesce(F.sum(F.when(~F.col("strong"), F.col("most"))), F.lit(0.0)).alias("rest"))
    near = cut(sums(strong).join(light(reach), "item_id").filter("floor is null or score + rest >= floor").select("item_id", "doc_id", "score"))
    looked = near.select("item_id", "doc_id").join(light(weak.select("item_id", "term")), "item_id").join(weighed, ["doc_id", "term"])
    added = looked.groupBy("item_id", "doc_id").agg(F.sum("part").alias("more"))
    return ranked(near.join(added, ["item_id", "doc_id"], "left").select("item_id", "doc_id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")), k)


def _scored_in_place(docs: DataFrame, asked: DataFrame, terms: list, k: int, keep: Column | None) -> DataFrame:
    """item_id, doc_id, score: of each task's documents, those that may be among the k best of a query."""
    sized = kept(_sized(docs, terms, keep))
    total = sized.agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))
    rows = sized.filter("size(words) > 0").repartition("doc_id").select("doc_id", "keep", "length", F.explode("words").alias("term"))
    found = rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"), F.first("keep").alias("keep"))
    own = kept(found.groupBy("doc_id").agg(F.first("keep").alias("keep"), F.first("length").alias("length"), F.collect_list("term").alias("terms"), F.collect_list(F.col("tf").cast("double")).alias("tf")))
    told = own.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total)).select("term", _idf().alias("idf"), "avg_length")
    by_term = told.join(F.broadcast(asked), "term").groupBy("term").agg(F.first("idf").alias("idf"), F.first("avg_length").alias("avg_length"), F.collect_list(F.struct("item_id")).alias("items")).collect()  # at most LITERALS terms and BROADCAST_ROWS items in all
    item_type, doc_type = (df.schema[c].dataType for df, c in ((asked, "item_id"), (docs, "doc_id")))
    return own.filter("keep").select("doc_id", "length", "terms", "tf").mapInArrow(_best(by_term, k, to_arrow_type(item_type)), f"item_id {item_type.simpleString()}, doc_id {doc_type.simpleString()}, score double")


def _rounded(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores to five places in units of the fifth, and which of them are so near to half a unit that Spark may round them another way."""
    x = score * 1e5 + 0.5
    key = np.floor(x)
    return key, np.minimum(x - key, key + 1 - x) < UNSURE


def _best(by_term: list, k: int, item_type: pa.DataType) -> Callable:
    names = list({i.item_id: None for r in by_term for i in r["items"]})
    number = {i: n for n, i in enumerate(names)}
    terms, idf, average = [r.term for r in by_term], np.array([r.idf for r in by_term]), by_term[0].avg_length if by_term else 1.0
    count = np.array([len(r["items"]) for r in by_term], np.int64)
    first, flat = np.cumsum(count) - count, np.array([number[i.item_id] for r in by_term for i in r["items"]], np.int64)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.full(len(names), -np.inf)  # the k-th best rounded score so far
        none = np.zeros(0, np.int64)
        item, doc, score = none, none, np.zeros(0)
        null, types, known, size = False, None, pa.array(terms, pa.string()), len(names)

        for batch in batches:
            types = batch.schema.field("doc_id").type
            ids, lists, tf = batch.column("doc_id"), batch.column("terms"), batch.column("tf").flatten().to_numpy()
            ids = ids.cast(pa.int64())
            ids, there = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            length, sizes = batch.column("length").to_numpy(), pc.list_value_length(lists).to_numpy()
            ends, term = np.cumsum(sizes), pc.index_in(lists.flatten(), value_set=known).to_numpy()
            rows = np.repeat(np.arange(len(sizes)), sizes)
            part = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[rows] / average))
            step = max(1, CELLS // max(1, size))
            for lo in range(0, len(sizes), step):
                hi = min(lo + step, len(sizes))
                at = slice(ends[lo] - sizes[lo], ends[hi - 1])
                n = count[term[at]]
                place = np.arange(n.sum()) + np.repeat(first[term[at]] - np.cumsum(n) + n, n)
                cell = np.repeat((rows[at] - lo) * size, n) + flat[place]
                sums = np.bincount(cell, np.repeat(part[at], n), (hi - lo) * size)
                key, unsure = _rounded(sums)
                new = np.flatnonzero((sums > 0) & (unsure | (key >= np.tile(floor, hi - lo))))
                own = there[lo + new // size]
                if not own.all():  # rows without a doc_id come first among equals, as they do in Spark
                    null = True
                item = np.concatenate([item, new % size])
                doc = np.concatenate([doc, np.where(own, ids[lo + new // size], np.iinfo(np.int64).min)])
                score = np.concatenate([score, sums[new]])
                if len(item) > CELLS // 4 + 4 * k * size:
                    item, doc, score = least(item, doc, score, floor)
        if len(item):
            item, doc, score = least(item, doc, score, floor)
            out = pa.array(doc, pa.int64(), mask=(doc == np.iinfo(np.int64).min) if null else None).cast(types)
            yield pa.RecordBatch.from_arrays([pa.array(names, item_type).take(pa.array(item)), out, pa.array(score)], ["item_id", "doc_id", "score"])

    def least(item: np.ndarray, doc: np.ndarray, score: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these, the k best of each query and what rounding leaves unsure; floor is raised to the k-th best."""
        key, unsure = _rounded(score)
        order = np.lexsort((doc, -key, item, unsure))
        sure = order[: len(order) - int(unsure.sum())]
        own = item[sure]
        start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
        rank = np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)]))
        floor[own[rank == k - 1]] = key[sure[rank == k - 1]]
        left = np.concatenate([sure[rank < k], np.flatnonzero(unsure)])
        return item[left], doc[left], score[left]

    return best


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best documents of each query; equal scores to five places go by doc_id."""
    w = Window.partitionBy("item_id").orderBy(F.desc(F.round("score", 5)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _neighbours(word: Column) -> Column:
    """A word of six letters or more and what is left of it without one of them: words an edit apart share one of these."""
    cut_one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))
    return F.when(F.length(word) >= 6, F.array_distinct(F.concat(F.array(word), cut_one))).otherwise(F.array().cast("array<string>"))


def matched(services: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """qid, id, confidence, rarity, rank of the k services(id, name, phrases) that asked(qid, text), a stated set, may mean.

    Of a question's words each counts 2 if it is a whole phrase of the service, else 1 if it is a
    word of it, else 1 for the first of its words that is one edit away; conjunctions count
    nothing, but the question is as long with them. A service is meant if the words count 0.3 of
    the question's length, if over half of one phrase was asked for, and if one hit at least is no
    word of a tenth of all services. Equals go by how rare their hits are, then by name.
    """
    phrases = services.select("id", F.posexplode("phrases").alias("at", "phrase")).select("id", "at", F.lower("phrase").alias("phrase")).filter("phrase <> ''")
    words = phrases.select("id", "at", "phrase", F.posexplode(intent_tokens(F.col("phrase"))).alias("pos", "word"))
    own = cut(words.groupBy("id", "word").agg(F.min(F.struct("at", "pos")).alias("ord")))
    stems = own.select("id", stem(F.col("word")).alias("stem")).groupBy("stem").agg(F.count_distinct("id").alias("df"))
    total = services.agg(F.greatest(F.lit(2.0), F.count("*") * 0.1).alias("ceiling"))
    counts = light(cut(stems.crossJoin(F.broadcast(total)).select("stem", "df", (F.col("df") > F.col("ceiling")).alias("common"))))  # total is one row
    query = asked.select("qid", F.posexplode(intent_tokens(F.col("text"))).alias("q", "token"))
    tokens_ = cut(query.filter(~F.col("token").isin(NOT_EVIDENCE)))
    exact = phrases.select("id", F.col("phrase").alias("token")).distinct().join(light(tokens_), "token").select("qid", "q", "id", F.lit(0).alias("how"), F.lit(None).cast(own.schema["ord"].dataType).alias("ord"), F.col("token").alias("word"))
    same = own.join(light(tokens_), own.word == F.col("token")).select("qid", "q", "id", F.lit(1).alias("how"), "ord", "word")
    keyed = own.select("word").distinct().select("word", F.explode(_neighbours(F.col("word"))).alias("key"))
    typed = tokens_.select("qid", "q", "token", F.explode(_neighbours(F.col("token"))).alias("key"))
    close = keyed.join(light(typed), "key").filter((F.levenshtein("word", "token") <= 1) & (F.col("word") != F.col("token"))).select("qid", "q", "word").distinct()
    near = own.join(light(close), "word").select("qid", "q", "id", F.lit(2).alias("how"), "ord", "word")
    hits = cut(exact.union(same).union(near).groupBy("qid", "q", "id").agg(F.min(F.struct("how", "ord", "word")).alias("hit")).select("qid", "q", "id", "hit.how", "hit.word"))
    size = query.groupBy("qid").agg(F.count("*").alias("n"))
    scores = hits.withColumn("stem", stem(F.col("word"))).join(counts, "stem", "left").groupBy("qid", "id").agg(
        F.sum(F.when(F.col("how") == 0, 2).otherwise(1)).alias("score"), F.bool_or(~F.coalesce("common", F.lit(False))).alias("telling"), F.round(F.sum(1.0 / F.coalesce("df", F.lit(1))), 6).alias("rarity")
    )
    reached = words.join(hits.select("qid", "id", "word").distinct(), ["id", "word"]).groupBy("qid", "id", "at").agg(F.count("*").alias("asked"))
    named = reached.join(words.groupBy("id", "at").agg(F.count("*").alias("words")), ["id", "at"]).groupBy("qid", "id").agg(F.max(F.col("asked") / F.col("words")).alias("named"))
    confidence = F.round(F.least(F.lit(1.0), F.col("score") / F.col("n")), 6)
    meant = scores.join(named, ["qid", "id"]).join(F.broadcast(size), "qid").withColumn("confidence", confidence).filter("telling and named > 0.5 and confidence >= 0.3")
    w = Window.partitionBy("qid").orderBy(F.desc("confidence"), F.desc("rarity"), "name")
    return meant.join(services.select("id", "name"), "id").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "id", "confidence", "rarity", "rank")


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id where the normalised text holds the normalised passage of 12 characters or more.

    Words inside a passage are whole words of the text too, so three of them make a key: a text
    is held against the passages whose keys it has. Up to BROADCAST_ROWS passages travel to the
    texts and are held against them while they are read; more are joined. Passages of under five words have no key and are held against
    each text, if there are any.
    """
    texts = docs.select("doc_id", norm(F.col("text")).alias("body"))
    asked = cut(passages.select("item_id", norm(F.col("text")).alias("passage")).filter("length(passage) >= 12"))
    parts = F.split("passage", " ")
    held = F.coalesce(F.contains("body", "passage"), F.lit(False))  # a bare test would have Spark normalise each text once more, to see that it isn't null
    keyed = asked.withColumn("key", F.when(F.size(parts) >= 5, F.xxhash64(*(F.get(parts, F.lit(k)) for k in (1, 2, 3)))))
    long, short = keyed.filter("key is not null"), keyed.filter("key is null").select("item_id", "passage")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 4, F.lit(1))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    worded = texts.withColumn("w", F.split("body", " "))
    if long.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hits = worded.select("doc_id", "body", F.explode(F.array_distinct(grams)).alias("key"))
        found = hits.join(F.broadcast(long), "key").filter(held).select("doc_id", "item_id")
    else:
        spread = worded.filter("size(w) >= 5").select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
        near = spread.join(long, "key").select("doc_id", "item_id", "passage")
        found = near.join(texts, "doc_id").filter(held).select("doc_id", "item_id")
    if short.isEmpty():
        return found.distinct()
    return found.union(texts.join(light(short), F.contains("body", "passage")).select("doc_id", "item_id")).distinct()
