"""Corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gritstone.llm import stages
from gritstone.llm.store import saved

#: (name, function); each function takes (spark, docs, sf_dir) and returns the next one's docs.
STAGES = [
    ("quality", stages.keep_quality),
    ("near_duplicates", stages.keep_one_of_each_group),
    ("substring_dedup", stages.cut_repeats),
    ("decontaminate", stages.drop_leaks),
    ("byte_bpe", stages.encode),
]

#: Learned scores and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
