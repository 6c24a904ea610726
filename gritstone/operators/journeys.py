"""Journeys of many requests at once over one graph of nodes, edges and requirement groups.

Tables: requests(request_id, goal, chain, facts) with chain the array of scopes from the nearest
up and facts a map of strings; nodes(id, type, scope); edges(id, src, dst, type, scope, program,
status, valid_until); groups(id, owner, mode, need, scope, program); members(group_id, node,
program); held(request_id, node). Programs are those of `programs`. A round of a traversal is a
few joins on node ids for all requests together, and its rows are cut from their lineage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gritstone.sources.tables import BROADCAST_ROWS, cut, kept, light

from .conditions import group_truth
from .programs import evaluated

#: Fixed edge types: what a goal depends on, what leads back to a producer, what is attached to a step.
DEPENDENCY = ("REQUIRES", "DEPENDS_ON", "NEXT", "BLOCKS")
PRODUCER = ("PRODUCES",)
#: Fixed node types that one can hold.
HOLDABLE = ("DOCUMENT", "DOCUMENT_GROUP", "OUTPUT", "SERVICE", "PAYMENT")
#: Pairs of a request and a condition that may be answered beforehand.
ANSWERS = 20_000


def applies(scope: Column, chain: Column) -> Column:
    """Whether something of that scope (null: everywhere) holds under the chain."""
    return scope.isNull() | F.array_contains(chain, scope)


def specificity(scope: Column, chain: Column) -> Column:
    """0 without a scope, -1 off the chain, otherwise the more the nearer."""
    at = F.array_position(chain, scope)
    return F.when(scope.isNull(), F.lit(0)).when(at == 0, F.lit(-1)).otherwise(F.size(chain) - (at - 1)).cast("int")


def _usable(edges: DataFrame, as_of: Column) -> DataFrame:
    """Edges that aren't rejected and haven't expired."""
    return edges.filter("status is null or status <> 'REJECTED'").filter(F.col("valid_until").isNull() | (F.col("valid_until") >= as_of))


def filtered(hits: DataFrame, as_of: Column) -> DataFrame:
    """hits(edge columns, chain, facts) that apply: in scope, not rejected, not expired and not false; with truth (null: unknown), pending and specificity."""
    told = _usable(hits.filter(applies(F.col("scope"), F.col("chain"))), as_of)
    told = told.withColumn("_told", evaluated(F.col("program"), F.col("facts"))).withColumn("specificity", specificity(F.col("scope"), F.col("chain")))
    return told.select(*hits.columns, "specificity", "_told.truth", "_told.pending").filter("truth is null or truth")


def _answering(requests: DataFrame, *tables: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function that gives rows(request_id, program, ...) truth and pending in place of the program.

    A condition of the tables is evaluated once for a request, however many rows have it: for all requests beforehand if
    these are at most ANSWERS pairs, else for the pairs that the rows have.
    """
    own = cut(reduce(DataFrame.union, (t.select("program") for t in tables)).filter("size(program) > 0").distinct())
    facts = requests.select("request_id", "facts")
    read = lambda pairs: pairs.select("request_id", "program", evaluated(F.col("program"), F.col("facts")).alias("_told"))
    few = own.count() * requests.count() <= ANSWERS
    told = F.broadcast(cut(read(facts.crossJoin(F.broadcast(own))))) if few else None

    def answered(rows: DataFrame) -> DataFrame:
        answers = told
        if answers is None:
            answers = read(rows.filter("size(program) > 0").select("request_id", "program").distinct().join(facts, "request_id"))
        plain = F.coalesce(F.size("program"), F.lit(0)) <= 0  # no condition is true
        both = rows.join(answers, ["request_id", "program"], "left").withColumn("truth", F.when(plain, True).otherwise(F.col("_told.truth")))
        return both.withColumn("pending", F.coalesce("_told.pending", F.array().cast("array<string>"))).drop("program", "_told")

    return answered


def _those(many: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows(request_id, node) that the many have; a small side is sent to the large one, which isn't shuffled."""
    return many.select("request_id", "node").join(light(rows), ["request_id", "node"], "left_semi").distinct()


def _groups(groups: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, members) as `groups_of` reads them in every round."""
    own = groups.select(F.col("id").alias("group_id"), F.col("owner").alias("node"), "mode", "need", "scope", "program")
    return cut(own), cut(members.select("group_id", F.col("node").alias("member"), "program"))


def _members_of(rows: DataFrame, chains: DataFrame, groups: DataFrame, members: DataFrame, answered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups of the nodes of rows(request_id, node) under chains(request_id, chain), a row a member: request_id, owner, group_id, mode, need, asks, member (null: none), truth, pending."""
    own = answered(rows.join(groups, "node").join(chains, "request_id"))
    own = own.withColumn("asks", applies(F.col("scope"), F.col("chain")) & F.coalesce("truth", F.lit(True))).select("request_id", F.col("node").alias("owner"), "group_id", "mode", "need", "asks")
    return answered(own.join(members, "group_id", "left"))


def _met(each: DataFrame, held: DataFrame) -> DataFrame:
    """request_id, owner, group_id, truth of the groups of each, as `_members_of` gives it. A group that doesn't ask is true; members whose condition is false don't count, those whose condition is unknown may."""
    has = _those(held, each.select("request_id", F.col("member").alias("node"))).withColumnRenamed("node", "member").withColumn("has", F.lit(True))
    counts = F.when(F.col("member").isNull(), False).otherwise(F.col("truth"))
    counted = each.join(has, ["request_id", "member"], "left").withColumn("counts", counts).groupBy("request_id", "owner", "group_id", "mode", "need", "asks").agg(
        F.count_if("counts").alias("n"), F.count_if(F.col("counts") & F.col("has")).alias("have"), F.count_if(F.col("counts").isNull()).alias("open")
    )
    met = group_truth(F.col("mode"), F.col("need"), F.col("n"), F.col("have"), F.col("open"))
    return counted.select("request_id", "owner", "group_id", F.when(~F.col("asks"), F.lit(True)).otherwise(met).alias("truth"))


def groups_of(rows: DataFrame, chains: DataFrame, groups: DataFrame, members: DataFrame, held: DataFrame, answered: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """request_id, owner, group_id, truth of the groups of the nodes of rows(request_id, node) under chains(request_id, chain).

    A group out of scope or whose condition is false asks for nothing and is true.
    """
    return _met(cut(_members_of(light(rows), chains, groups, members, answered)), held)


def held_closure(requests: DataFrame, held: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """held(request_id, node) and the owners of groups that it satisfies, again and again until nothing is added.

    Only groups with a member that was just added are looked at in a round. What a round adds is kept
    by itself, and put together with what came before once it isn't much smaller.
    """
    asked, (own, inside) = cut(requests.select("request_id", "chain", "facts")), _groups(groups, members)
    answered = _answering(asked, own, inside)
    owners = cut(inside.select("group_id", F.col("member").alias("node")).join(own.select("group_id", F.col("node").alias("owner")), "group_id").select("node", "owner").distinct())
    fresh = cut(held.select("request_id", "node").join(asked.select("request_id"), "request_id", "left_semi").distinct())
    others = held.select("request_id", "node").join(asked.select("request_id"), "request_id", "left_anti").distinct()  # of nobody who asks
    chains = light(asked.select("request_id", "chain"))
    parts = [(fresh, fresh.count())]
    while True:
        seen = reduce(DataFrame.union, (p for p, _ in parts))
        touched = cut(light(fresh).join(owners, "node").select("request_id", F.col("owner").alias("node")).distinct())
        touched = cut(touched.join(_those(seen, touched), ["request_id", "node"], "left_anti"))
        met = groups_of(touched, chains, own, inside, seen, answered)
        fresh = cut(met.filter("truth").select("request_id", F.col("owner").alias("node")).distinct())
        added = fresh.count()
        if not added:
            return seen.union(others)
        parts.append((fresh, added))
        while len(parts) > 1 and parts[-2][1] <= 2 * parts[-1][1]:
            (b, n), (a, m) = parts.pop(), parts.pop()
            parts.append((cut(a.union(b)), m + n))


class _Parts:
    """Rows that rounds find, in few parts; more than FEW are put together, but for a first one that is larger than the rest."""

    FEW = 8

    def __init__(self, *keys: str) -> None:
        self.keys = list(keys)
        self.parts: list[tuple[DataFrame, int]] = []

    def add(self, rows: DataFrame, n: int) -> None:
        self.parts.append((rows, n))
        if len(self.parts) > self.FEW:
            at = 1 if self.parts[0][1] > sum(m for _, m in self.parts[1:]) else 0
            own, many = self.parts[at:], sum(m for _, m in self.parts[at:])
            self.parts[at:] = [(cut(reduce(DataFrame.union, (p for p, _ in own)).coalesce(1 + many // BROADCAST_ROWS)), many)]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, (p for p, _ in self.parts))

    def lack(self, rows: DataFrame) -> DataFrame:
        """Those of rows whose keys aren't among the parts."""
        return rows.join(_hinted(self.rows().select(*self.keys), sum(n for _, n in self.parts)), self.keys, "left_anti")


def _hinted(rows: DataFrame, n: int) -> DataFrame:
    """rows, n of them, with a broadcast hint if they are few."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


@dataclass(frozen=True)
class _Graph:
    """What every round reads: requests, usable edges and ids of nodes as Parquet, groups with their members, and answers to conditions."""

    asked: DataFrame
    chains: DataFrame
    live: DataFrame
    ids: DataFrame
    own: DataFrame
    inside: DataFrame
    answered: Callable[[DataFrame], DataFrame]


def _graph(requests: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame, members: DataFrame, as_of: Column) -> _Graph:
    asked, (own, inside) = cut(requests.select("request_id", "goal", "chain", "facts")), _groups(groups, members)
    live = kept(_usable(edges.filter(F.col("type").isin(*DEPENDENCY, *PRODUCER)), as_of).select("id", "src", "dst", "type", "scope", "program"))
    ids = kept(nodes.select(F.col("id").alias("node"), (F.col("type").isin(*HOLDABLE) & (F.col("type") != "SERVICE")).alias("producible")))
    return _Graph(asked, light(asked.select("request_id", "chain")), live, ids, own, inside, _answering(asked, own, inside, live))


def _walked(start: DataFrame, onward: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of start and what they lead to by onward(frontier), with the same columns, once each, and their depth; a round is one table that is cut."""
    keys = start.columns
    seen, depth = _Parts(*keys), 0
    frontier = cut(start.distinct().withColumn("depth", F.lit(0)))
    while n := frontier.count():
        seen.add(frontier, n)
        depth += 1
        frontier = cut(seen.lack(onward(_hinted(frontier.select(*keys), n)).distinct()).withColumn("depth", F.lit(depth)))
    return seen.rows() if seen.parts else frontier


def _moves(g: _Graph) -> tuple[DataFrame, DataFrame]:
    """src, next, scope, program of usable edges, and of ways back to producers and to all members of groups."""
    ahead = g.live.filter(F.col("type").isin(*DEPENDENCY)).select("src", F.col("dst").alias("next"), "scope", "program")
    back = g.live.filter(F.col("type").isin(*PRODUCER)).select(F.col("dst").alias("src"), F.col("src").alias("next"), "scope", "program")
    inner = g.inside.join(g.own.select("group_id", "node"), "group_id").select(F.col("node").alias("src"), F.col("member").alias("next"), F.lit(None).cast("string").alias("scope"), F.when(F.lit(False), F.col("program")).alias("program"))
    return ahead, back.union(inner)


def _near(g: _Graph) -> _Graph:
    """The graph with the edges that any request may come by, conditions and scopes aside. Rounds are over hashes of ids; should two be alike, an edge too many is kept."""
    pairs = kept(reduce(DataFrame.union, _moves(g)).select(F.xxhash64("src").alias("at"), F.xxhash64("next").alias("next")))
    found = _walked(g.asked.select(F.xxhash64("goal").alias("at")), lambda frontier: pairs.join(frontier, "at").select(F.col("next").alias("at")))
    known = _hinted(found.select("at"), found.count())
    own = g.live.withColumn("at", F.xxhash64(F.when(F.col("type").isin(*PRODUCER), F.col("dst")).otherwise(F.col("src"))))
    return replace(g, live=kept(own.join(known, "at", "left_semi").drop("at")))


def _may_reach(g: _Graph, keep_unknown: bool) -> tuple[DataFrame, int]:
    """(request_id, node) that a journey may come by whatever is held, and how many: by usable edges, back to producers and to all members of groups, so what is held of these tells each group's truth."""
    ahead, rest = _moves(g)
    moves = ahead.union(cut(rest))

    def onward(frontier: DataFrame) -> DataFrame:
        hits = moves.join(frontier.withColumnRenamed("node", "src"), "src").join(g.chains, "request_id").filter(applies(F.col("scope"), F.col("chain")))
        return g.answered(hits).filter("truth is null or truth" if keep_unknown else "truth").select("request_id", F.col("next").alias("node"))

    may = _walked(g.asked.select("request_id", F.col("goal").alias("node")), onward).select("request_id", "node")
    return may, may.count()


def _closed(held: DataFrame, each: DataFrame) -> DataFrame:
    """held(request_id, node), once each, and the owners of groups that it satisfies, again and again; each are the groups' members as `_members_of` gives them."""
    seen, fresh = _Parts("request_id", "node"), held
    while n := fresh.count():
        seen.add(fresh, n)
        touched = each.join(_hinted(fresh.withColumnRenamed("node", "member"), n), ["request_id", "member"], "left_semi").select("request_id", "owner").distinct()
        met = _met(each.join(touched, ["request_id", "owner"], "left_semi"), seen.rows())
        fresh = cut(seen.lack(met.filter("truth").select("request_id", F.col("owner").alias("node")).distinct()))
    return seen.rows() if seen.parts else fresh


def expand(requests: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame, members: DataFrame, held: DataFrame, as_of: Column, keep_unknown: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that the goals need: request_id, node, depth; request_id, id, src, dst, type, truth, pending.

    What is held, or owns a satisfied group, isn't gone beyond. Members of groups that aren't
    satisfied follow on edges of their own, rg:group:member. What can be held and isn't a service
    is traced back to what produces it. Edges that are unknown are told, and followed only with
    keep_unknown. Nodes are visited once, at their least depth, so cycles end.

    Rounds first find the edges that any request may come by, and then what each may come by whatever is held. Held things, groups and edges are then looked up
    once, for all of that, and rounds over these few rows tell what is come by and how far off it is.
    """
    return _expanded(_graph(requests, nodes, edges, groups, members, as_of), held, keep_unknown, False)[:2]


def journeys(requests: DataFrame, nodes: DataFrame, edges: DataFrame, groups: DataFrame, members: DataFrame, held: DataFrame, as_of: Column, keep_unknown: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, held) as `expand` gives them after `held_closure`, which is made only of what a journey may come by; held are the nodes told that are held."""
    return _expanded(_graph(requests, nodes, edges, groups, members, as_of), held, keep_unknown, True)


def _expanded(g: _Graph, held: DataFrame, keep_unknown: bool, close: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    columns = ["request_id", "id", "src", "dst", "type", "truth", "pending"]
    g = _near(g)
    may, many = _may_reach(g, keep_unknown)
    few = _hinted(may, many)
    has = cut(held.select("request_id", "node").join(few, ["request_id", "node"], "left_semi").distinct())
    each = cut(_members_of(few, g.chains, g.own, g.inside, g.answered))
    if close:
        has = cut(_closed(has, each))
    met = cut(_met(each, has))
    there = cut(g.ids.join(few, "node").groupBy("request_id", "node").agg(F.bool_or("producible").alias("producible")))  # what isn't in the graph is dropped
    base = there.join(has, ["request_id", "node"], "left_anti").join(met.filter("truth").select("request_id", F.col("owner").alias("node")).distinct(), ["request_id", "node"], "left_anti")
    base = cut(base.join(g.chains, "request_id"))
    at = _hinted(base, many)

    def used(hits: DataFrame) -> DataFrame:
        return g.answered(hits.filter(applies(F.col("scope"), F.col("chain")))).filter("truth is null or truth")

    ahead = used(g.live.filter(F.col("type").isin(*DEPENDENCY)).join(at.withColumnRenamed("node", "src"), "src")).select(*columns, F.col("src").alias("node"), F.col("dst").alias("next"))
    back = used(g.live.filter(F.col("type").isin(*PRODUCER)).join(at.filter("producible").withColumnRenamed("node", "dst"), "dst")).filter("truth" if not keep_unknown else "true").select(*columns, F.col("dst").alias("node"), F.col("src").alias("next"))
    unmet = each.filter("member is not null and (truth is null or truth)").join(met.filter("truth is null or not truth").select("request_id", "owner", "group_id"), ["request_id", "owner", "group_id"], "left_semi")
    unmet = unmet.join(base.select("request_id", F.col("node").alias("owner")), ["request_id", "owner"], "left_semi")
    inner = unmet.select("request_id", F.concat_ws(":", F.lit("rg"), "group_id", "member").alias("id"), F.col("owner").alias("src"), F.col("member").alias("dst"), F.lit("REQUIRES").alias("type"), "truth", "pending", F.col("owner").alias("node"), F.col("member").alias("next"))
    hops = cut(ahead.union(back).union(inner))
    steps = hops.filter("true" if keep_unknown else "truth").select("request_id", "node", F.col("next").alias("to")).distinct()
    steps = cut(steps.join(there.select("request_id", F.col("node").alias("to")), ["request_id", "to"], "left_semi"))

    start = g.asked.select("request_id", F.col("goal").alias("node")).join(there, ["request_id", "node"], "left_semi").select("request_id", "node")
    reached = _walked(start, lambda frontier: steps.join(frontier, ["request_id", "node"]).select("request_id", F.col("to").alias("node")))
    come = reached.select("request_id", "node")
    told = hops.join(come, ["request_id", "node"], "left_semi").select(*columns).dropDuplicates(["request_id", "id", "src", "dst"])
    return reached, told, has.join(come, ["request_id", "node"], "left_semi")


def order_pairs(edges: DataFrame) -> DataFrame:
    """request_id, before, after of edges(request_id, src, dst, type): a dependency comes before what needs it, other typed edges run forward, attachments don't order."""
    turned = F.col("type").isin("REQUIRES", "DEPENDS_ON")
    pairs = edges.filter(F.col("type").isin("REQUIRES", "DEPENDS_ON", "PRODUCES", "NEXT", "BLOCKS"))
    return pairs.select("request_id", F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("before"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("after")).distinct()


def layered(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_id, node, ord, layer of items(request_id, node, ord) under pairs(request_id, before, after).

    A node's layer is one above the highest of those before it, 0 without any; a node in a cycle,
    or after one, has a null layer. Pairs count once, those with a node that isn't among the items
    not at all. A round settles a layer of every request.
    """
    ids = items.select("request_id", "node")
    left = pairs.select("request_id", "before", "after").distinct()
    for end in ("before", "after"):
        left = left.join(ids.withColumnRenamed("node", end), ["request_id", end], "left_semi")
    left = cut(left.select("request_id", "before", "after"))
    open_, told, layer = cut(ids), [], 0
    while True:
        ready = cut(open_.join(left.select("request_id", F.col("after").alias("node")), ["request_id", "node"], "left_anti").select("request_id", "node"))
        if ready.isEmpty():
            break
        told.append(ready.withColumn("layer", F.lit(layer)))
        open_ = cut(open_.join(ready, ["request_id", "node"], "left_anti").select("request_id", "node"))
        left = cut(left.join(ready.withColumnRenamed("node", "before"), ["request_id", "before"], "left_anti").select("request_id", "before", "after"))
        layer += 1
    settled = reduce(DataFrame.union, told, ids.withColumn("layer", F.lit(None).cast("int")).filter("false"))
    return items.select("request_id", "node", "ord").join(settled, ["request_id", "node"], "left")


def attached(reached: DataFrame, requests: DataFrame, nodes: DataFrame, edges: DataFrame, types: list[str], ancestors: DataFrame, as_of: Column) -> DataFrame:
    """request_id, id, src, dst, type of the edges of those types one hop off reached(request_id, node).

    An office counts only if its own scope is on the chain, or the chain's nearest scope is among
    the office's ancestors(id, ancestor_id).
    """
    base = reached.select("request_id", F.col("node").alias("src")).join(requests.select("request_id", "chain", "facts"), "request_id")
    hits = filtered(base.join(edges.filter(F.col("type").isin(*types)), "src"), as_of).filter("truth").select("request_id", "id", "src", "dst", "type", "chain")
    target = nodes.select(F.col("id").alias("dst"), F.col("type").alias("kind"), F.col("scope").alias("at"))
    below = ancestors.select(F.col("id").alias("at"), F.col("ancestor_id").alias("near")).distinct()
    told = hits.join(target, "dst").withColumn("near", F.get("chain", F.lit(0))).join(below.withColumn("under", F.lit(True)), ["at", "near"], "left")
    return told.filter((F.col("kind") != "OFFICE") | applies(F.col("at"), F.col("chain")) | F.coalesce("under", F.lit(False))).select("request_id", "id", "src", "dst", "type")
