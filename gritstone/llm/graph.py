"""Connected components of an undirected edge table, by repeated minimum labels and label shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .store import light, saved


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of edges(a, b) reaches. Empty edges give an empty table.

    A round takes each id's least neighbouring label, then the label of that label, so that
    chains halve; every round is one written table, and the loop ends when no label falls.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().toDF("id", "other"), "edges")
    labels = saved(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("component", "near").alias("low"), F.col("component").alias("was"))
        onward = labels.select(F.col("id").alias("low"), F.col("component").alias("next"))
        after = saved(lower.join(onward, "low", "left").select("id", F.least("low", "next").alias("component"), (F.least("low", "next") < F.col("was")).alias("fell")), "labels")
        labels = after.select("id", "component")
        if after.filter("fell").isEmpty():
            return labels


def extended(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups(id, component) after more links(a, b), a saved table: only the components that these join are gone through anew."""
    if links.isEmpty():
        return groups
    a, b = groups.toDF("a", "ca"), groups.toDF("b", "cb")
    joined = components(links.join(light(a), "a", "left").join(light(b), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    old = groups.join(light(joined.toDF("component", "further")), "component", "left").select("id", F.coalesce("further", "component").alias("component"))
    alone = joined.join(groups.select(F.col("id").alias("id")), "id", "left_anti")  # ids without a component until now
    return saved(old.union(alone.select("id", "component")), "groups")
