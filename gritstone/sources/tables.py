"""Readers: Parquet tables of a directory, graph bundles as JSON, and append ledgers as JSON lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: One bundle per file: sources, nodes, edges, requirement groups, questions and edge templates. Conditions and nested metadata stay JSON.
_REFS = "sources:array<struct<sourceId:string,evidence:string,confidence:double,verificationStatus:string>>"
_EDGES = f"array<struct<id:string,from:string,to:string,type:string,condition:string,jurisdictionId:string,note:string,validFrom:string,validUntil:string,verificationStatus:string,{_REFS}>>"
BUNDLE = (
    "id string, sources array<struct<id:string,url:string,title:string,domain:string,sourceType:string,retrievedAt:string,contentHash:string,tlsVerified:boolean>>, "
    f"nodes array<struct<id:string,type:string,name:string,officialName:string,aliases:array<string>,description:string,jurisdictionId:string,metadata:map<string,string>,{_REFS},lastVerifiedAt:string>>, "
    f"edges {_EDGES}, edgeTemplates {_EDGES}, questions array<struct<field:string,label:string,inputType:string>>, "
    f"requirementGroups array<struct<id:string,ownerNodeId:string,mode:string,minimumRequired:int,condition:string,jurisdictionId:string,members:array<struct<nodeId:string,condition:string,note:string>>,{_REFS}>>"
)


def bundles(spark: SparkSession, path: str) -> DataFrame:
    """Every *.json of a directory but jurisdictions.json, with the file's stem as bundle."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return spark.read.schema(BUNDLE).option("multiLine", True).json(path, pathGlobFilter="*.json").withColumn("bundle", stem).filter("bundle <> 'jurisdictions'")


def ledger(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Latest row of each key of JSON lines; malformed lines are skipped."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return latest(rows, [key], [F.desc(order)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir or the context's checkpoint folder names it; in local mode without either, one of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
        held = sc._jsc.sc().getCheckpointDir()
    return (folder or held.get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, for tables that are read again and again by a few columns."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table, such as a query side, that may be broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


def light(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def upserted(stored: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """seed's rows, and stored rows whose key isn't among them."""
    return seed.unionByName(stored.join(seed.select(*keys).distinct(), keys, "left_anti"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key in the given total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
