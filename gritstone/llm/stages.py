"""The five stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return docs' own columns.

All stages judge a row by its own text, so that rows with one doc_id and different texts fare
each for itself. Null and empty texts have no quality and go in the first stage; where a stage is
given them all the same, they have no near copies, lose no words, leak nothing and have no ids.
An empty table stays empty, texts of any length are read whole, and columns beside doc_id and
text, whatever their names, pass through unchanged (but for n_chars, which is counted anew where
words are cut).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, decontaminate, near_dups, quality, substrings
from .store import light, saved


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores a half or more; the scorer learns from docs itself."""
    return quality.kept(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: one of the smallest doc_id. Repeats of a row, or of its shingles under one doc_id, are copies too. Rows with a null doc_id stay."""
    told = saved(near_dups.near_duplicates(docs, keyed=True).filter("doc_id is not null").select("doc_id", "text_key", "set_key", "kept", "n_shingles"), "verdicts")
    first = told.filter("kept and n_shingles > 0").groupBy("doc_id", "set_key").agg(F.min("text_key").alias("first"), F.count("*").alias("n")).filter("n > 1")  # several rows of a group's smallest doc_id
    copies = saved(first.select("doc_id", F.col("first").alias("text_key")), "first")
    gone = saved(told.filter("not kept").select("doc_id", "text_key").union(told.join(first, ["doc_id", "set_key"]).select("doc_id", "text_key")).distinct(), "dropped")
    names = [f"{c}_{uuid.uuid4().hex}" for c in ("id", "key")]
    keyed = docs.withColumn(names[0], F.col("doc_id").cast("bigint")).withColumn(names[1], F.md5(F.col("text").cast("string")))
    rest = keyed.join(light(gone.toDF(*names)), names, "left_anti").select(*docs.columns)
    one = keyed.join(light(copies.toDF(*names)), names, "left_semi").dropDuplicates(names).select(*docs.columns)
    return rest.union(one)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with the repeated passages cut out of their texts; a text may be left empty."""
    return substrings.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds nothing like a benchmark item. A text is judged once, whatever doc_ids it has, a null one too."""
    name = f"key_{uuid.uuid4().hex}"
    key = F.md5(F.col("text").cast("string"))
    found = decontaminate.leaks(docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = saved(found.select(F.col("doc_id").alias(name)).distinct(), "leaked")
    return docs.withColumn(name, key).join(light(gone), name, "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    import public_tokenizers as P

    return byte_bpe.encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
