"""Whole tables of a database, read in parts whose bounds come from the keys themselves."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows aimed at in a part; a table gets as many parts as it has so many rows.
PART_ROWS = 100_000
#: Rows that a connection fetches at a time.
FETCH = 10_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Fixed: the tables of a graph and the keys that order them.
GRAPH_TABLES = {
    "journeys": "id", "sources": "id", "nodes": "id", "edges": "id", "requirement_groups": "id", "questions": "field", "escalation_templates": "id", "jurisdictions": "id",
}


def _literal(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _quoted(spark: SparkSession, url: str, name: str) -> str:
    """A column's name as the database at a url quotes it."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(name)


def whole_table(spark: SparkSession, url: str, table: str, key: str = "id", part_rows: int = PART_ROWS, properties: Mapping[str, str] | None = None) -> DataFrame:
    """Every row of a table, in parts of about part_rows rows by ranges of `key`; null keys are in the first part.

    Only the key column is read to find the bounds. A whole-number key is cut at equal steps between its least and
    greatest value by Spark's own partitioned scan if its values are dense; any other key, and a sparse one, is cut where Spark's range sampler
    parts the keys, so that parts are even. Ranges don't overlap, so each row is read once, and each part is a task of its own that can be run again. Filters
    and columns that a caller takes from the frame reach the database.
    """
    props = {"fetchsize": str(FETCH), **(properties or {})}
    keys = spark.read.jdbc(url, table, properties=props).select(F.col(key).alias("k"))
    n, least, most = keys.agg(F.count("*"), F.min("k"), F.max("k")).first()
    parts = -(-n // part_rows)
    if parts < 2 or least is None or least == most:
        return spark.read.jdbc(url, table, properties=props)
    column = next(f.name for f in spark.read.jdbc(url, table, properties=props).schema if f.name.lower() == key.lower())
    if keys.dtypes[0][1] in _WHOLE and most - least < 2 * n:
        return spark.read.jdbc(url, table, column=column, lowerBound=least, upperBound=most + 1, numPartitions=parts, properties=props)
    ranged = keys.filter("k is not null").repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id())
    starts = sorted({r.lo for r in ranged.groupBy("part").agg(F.min("k").alias("lo")).collect()})[1:]  # a value a part
    name = _quoted(spark, url, column)
    if not starts:
        return spark.read.jdbc(url, table, properties=props)
    ranges = [f"{name} < {_literal(starts[0])} OR {name} IS NULL"] + [f"{name} >= {_literal(a)} AND {name} < {_literal(b)}" for a, b in zip(starts, starts[1:], strict=False)] + [f"{name} >= {_literal(starts[-1])}"]
    if keys.dtypes[0][1] in _WHOLE:
        ranges = [r.replace("'", "") for r in ranges]
    return spark.read.jdbc(url, table, predicates=ranges, properties=props)


def graph_tables(spark: SparkSession, url: str, tables: Mapping[str, str] = GRAPH_TABLES, part_rows: int = PART_ROWS, properties: Mapping[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a graph by name, each as whole_table gives it: nothing but keys is read until they are used, and then all at once."""
    return {name: whole_table(spark, url, name, key, part_rows, properties) for name, key in tables.items()}
