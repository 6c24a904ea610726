"""Scopes, traversal and order in graphs held as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gritstone.sources.tables import cut, latest, light


def closure(tree: DataFrame) -> DataFrame:
    """id, ancestor_id, distance of tree(id, parent_id), each id its own ancestor at 0; links to missing rows end a line, and a line that comes back to where it was ends there. Lines of any depth are followed, a level a round."""
    up = tree.filter("parent_id is not null").join(tree.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi").select(F.col("id").alias("ancestor_id"), "parent_id").distinct()
    level = found = cut(tree.select("id", F.col("id").alias("ancestor_id"), F.lit(0).alias("distance")).distinct())
    k = 0
    while not level.isEmpty():
        k += 1
        onward = level.join(up, "ancestor_id").select("id", F.col("parent_id").alias("ancestor_id"), F.lit(k).alias("distance")).distinct()
        level = cut(onward.join(found, ["id", "ancestor_id"], "left_anti").select("id", "ancestor_id", "distance"))
        found = found.union(level)
    return found


def parents_first(rows: DataFrame, key: str, parent: str, *order: str) -> DataFrame:
    """rows, the first of each key by `order`, with level: how many rows of the table stand above one, so that whoever writes level by level never writes a child before its parent. A parent that isn't there counts as none."""
    one = latest(rows, [key], [F.col(c) for c in order])
    depth = closure(one.select(F.col(key).alias("id"), F.col(parent).alias("parent_id"))).groupBy(F.col("id").alias(key)).agg(F.max("distance").alias("level"))
    return one.join(depth, key)


def resolved(asked: DataFrame, places: DataFrame) -> DataFrame:
    """request_id, scope, level of asked(request_id, names): how deep places(id, parent_id, name) knows the names, from the top.

    A place goes by its name, its id or the last part of its id, in lower case without blanks, underscores
    and hyphens; of several the least id counts. The first unknown or null name ends the walk; scope is null and level 0
    if the first is unknown.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]", "")
    called = F.explode(F.array_distinct(F.array(plain(F.col("name")), plain(F.col("id")), plain(F.element_at(F.split("id", "-"), -1)))))
    keys = places.select(F.coalesce("parent_id", F.lit("")).alias("above"), "id", called.alias("key")).groupBy("above", "key").agg(F.min("id").alias("id"))
    depth = asked.agg(F.max(F.size("names"))).first()[0] or 0
    told = asked.select("request_id", "names", F.lit("").alias("at"), F.lit(0).alias("level"))
    for k in range(depth):  # as many levels as a question has names
        next_ = keys.select(F.col("above").alias("at"), F.col("key").alias("asks"), F.col("id").alias("below"))
        here = F.when(F.col("level") == k, plain(F.get("names", F.lit(k))))
        told = told.withColumn("asks", here).join(next_, ["at", "asks"], "left").select("request_id", "names", F.coalesce("below", "at").alias("at"), (F.col("level") + F.col("below").isNotNull().cast("int")).alias("level"))
    return told.select("request_id", F.nullif("at", F.lit("")).alias("scope"), "level")


def named_goal(asked: DataFrame, services: DataFrame, rewrites: list[tuple[str, str]]) -> DataFrame:
    """request_id, id, priority of asked(request_id, name): the service meant, by its id, its id after a rewrite of the name's start, its name, or an alias, in that order; of equals the first by ord.

    Names are looked up once each, however many ask them, and each key leads to its first service only.
    """
    named = asked.select("name").distinct()
    text = F.trim(F.col("name"))
    low = F.lower(text)
    turned = [F.when(low.startswith(old), F.concat(F.lit(new), F.substring(low, len(old) + 1, 1 << 20))) for old, new in rewrites]
    tries = [(1, text), *((2, t) for t in turned), (3, F.concat(F.lit("name:"), low)), (4, F.concat(F.lit("alias:"), low))]
    wanted = named.select("name", F.explode(F.array(*(F.struct(F.lit(p).alias("priority"), c.alias("key")) for p, c in tries))).alias("t")).select("name", "t.priority", "t.key").filter("key is not null")
    keys = services.select("id", "ord", F.explode(F.concat(F.array(F.col("id"), F.concat(F.lit("name:"), F.lower(F.trim("name")))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.concat(F.lit("alias:"), F.lower(F.trim(a)))))).alias("key"))
    first = keys.filter("key is not null").groupBy("key").agg(F.min(F.struct("ord", "id")).alias("first"))  # an alias of many services leads to one of them
    best = wanted.join(first, "key").groupBy("name").agg(F.min(F.struct("priority", "first.ord", "first.id")).alias("best"))
    best = light(cut(best.select("name", "best.id", "best.priority")))
    return asked.select("request_id", "name").join(best, "name", "left").select("request_id", "id", "priority")


def reached(edges: DataFrame, starts: DataFrame, depth: int | None = None) -> DataFrame:
    """id, distance of what edges(src, dst) reach from starts(id) in at most depth steps (all, if null), at the least distance; cycles end where they began."""
    seen = frontier = cut(starts.select("id", F.lit(0).alias("distance")).distinct())
    k = 0
    while (depth is None or k < depth) and not frontier.isEmpty():
        k += 1
        onward = edges.join(frontier.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct()
        frontier = cut(onward.join(seen, "id", "left_anti").select("id", F.lit(k).alias("distance")))
        seen = seen.union(frontier)
    return seen


def cyclic(edges: DataFrame) -> DataFrame:
    """edges(src, dst) left when nodes that nothing leads to, or that lead nowhere, are taken away until none is left: empty without a cycle."""
    left = cut(edges.select("src", "dst").dropna().distinct())
    n = left.count()
    while n:
        rest = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = cut(rest.select("src", "dst"))
        before, n = n, left.count()
        if n == before:
            break
    return left
