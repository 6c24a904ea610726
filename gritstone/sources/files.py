"""Files: JSON lines, tab-separated registries, lists of urls, cached files; stored tables against what should be stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path that Spark can read, in whatever store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank and malformed lines are left out, a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_json_lines(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """url of the lines of a text file: comments after blank and # cut off, blank lines left out, the first of equals in order of line.

    A long file is read in splits; a line's place is its split's start in the file, then its place in the split.
    """
    lines = spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line")).alias("place"), "value")
    bare = lines.select("place", F.trim(F.regexp_replace("value", r"(^|\s)#.*$|\r$", "")).alias("url")).filter("url <> ''")
    return bare.groupBy("url").agg(F.min("place").alias("place")).orderBy("place").select("url")


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a tab-separated file; lines that begin with # are comments."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", "#").option("ignoreTrailingWhiteSpace", True).csv(path)


def cached_files(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, sha256 of every file under a folder, at any depth."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each *.json of a folder, with the file's stem as journey; a missing folder has none."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    if not exists(spark, path):
        return spark.createDataFrame([], f"{schema}, journey string")
    return spark.read.schema(schema).option("multiLine", True).json(path, pathGlobFilter="*.json").withColumn("journey", stem)


def checked_overwrite(rows: DataFrame, path: str, least_share: float = 0.8) -> int:
    """Put rows in the place of a JSON folder, unless they are fewer than that share of the rows that are there: then ValueError. Gives the number of rows.

    They are written beside it first and the folders change names afterwards, so a write that fails leaves what was there; rows may be read from the very folder.
    """
    spark = rows.sparkSession
    fresh, old = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    rows.write.mode("overwrite").json(fresh)
    count = lambda folder: spark.read.schema(rows.schema).json(folder).count() if exists(spark, folder) else 0
    n, before = count(fresh), count(path)
    where = spark._jvm.org.apache.hadoop.fs.Path
    store = where(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if n < least_share * before:
        store.delete(where(fresh), True)
        raise ValueError(f"{n} rows would replace {before}")
    store.delete(where(old), True)
    if exists(spark, path) and not store.rename(where(path), where(old)):
        raise OSError(f"{path} can't be moved away")
    if not store.rename(where(fresh), where(path)):
        store.rename(where(old), where(path))
        raise OSError(f"{fresh} can't be moved to {path}")
    store.delete(where(old), True)
    return n


def pruned(stored: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """stored without the rows whose keys the seed doesn't have."""
    return stored.join(seed.select(*keys).distinct(), keys, "left_semi")


def stable(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row: each row as JSON with its columns in order of name, and entries of maps in order of key, so that equal rows are equal texts."""
    ordered = [F.array_sort(F.map_entries(c)).alias(c) if rows.schema[c].dataType.typeName() == "map" else F.col(c) for c in sorted(rows.columns)]
    return rows.select(*keys, F.to_json(F.struct(*ordered), {"ignoreNullFields": "true"}).alias("row"))


def differences(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind (MISSING, EXTRA, CHANGED) of rows that differ, whatever their order and that of their columns; rows that are stored more or less often than wanted are CHANGED."""
    counted = lambda df, n: stable(df, keys).groupBy(*keys, "row").agg(F.count("*").alias(n))
    both = counted(stored, "has").join(counted(wanted, "wants"), [*keys, "row"], "full_outer").filter(~F.coalesce(F.col("has") == F.col("wants"), F.lit(False)))
    sides = both.groupBy(*keys).agg(F.max(F.col("has").isNotNull()).alias("here"), F.max(F.col("wants").isNotNull()).alias("there"))
    return sides.select(*keys, F.when(F.col("here") & F.col("there"), "CHANGED").when(F.col("here"), "EXTRA").otherwise("MISSING").alias("kind"))


def fingerprints(rows: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """key, line: a tab-separated line for each key, with the number of rows and, for each of the lists (name: column), its distinct values in order."""
    told = rows.groupBy(key).agg(F.count("*").alias("n"), *(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(name) for name, c in lists.items()))
    return told.select(key, F.concat_ws("\t", F.col(key).cast("string"), F.col("n").cast("string"), *lists).alias("line"))


def resolved_sources(refs: DataFrame, sources: DataFrame) -> DataFrame:
    """refs(subject, source_id, ...) with url and title of their sources(id, url, title), in the refs' order by ord; refs without a source are left out."""
    return refs.join(sources.select(F.col("id").alias("source_id"), "url", "title"), "source_id")


def live_edges(edges: DataFrame, *nodes: DataFrame) -> DataFrame:
    """edges(src, dst) with both ends among the ids of the nodes tables."""
    ids = reduce(DataFrame.union, (n.select("id") for n in nodes)).distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def harvested(links: DataFrame) -> DataFrame:
    """url, hosts, score, title of links(url, host, score, title, ord): one row a url, hosts gathered, the first title, the highest score."""
    return links.groupBy("url").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("host")).alias("hosts"), F.max("score").alias("score"), F.min_by("title", "ord").alias("title"))
