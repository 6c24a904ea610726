"""Orders and places of the nodes of small graphs, one for each request: a stable topological order, and columns and rows for drawing.

A request's graph is what one reader sees, so it is one row, its nodes and edges arrays that Spark has collected; a task goes through
its rows batch by batch, and many requests share one call into Python.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed: distance of columns and rows, and turns of the rows.
COLUMN, ROW, SWEEPS = 260, 70, 4
#: Requests whose rows leave a task at once.
GRAPHS = 1000


def _kahn(nodes: list[str], pairs: set[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """(order, unordered): of the nodes that nothing holds back, the one that comes first in `nodes` goes next; those that a cycle holds back are appended as they came."""
    place = {n: i for i, n in enumerate(nodes)}
    after, before = defaultdict(list), dict.fromkeys(nodes, 0)
    for a, b in pairs:
        if a in place and b in place:
            after[a].append(b)
            before[b] += 1
    ready = [place[n] for n in nodes if not before[n]]
    heapq.heapify(ready)
    order: list[str] = []
    while ready:
        n = nodes[heapq.heappop(ready)]
        order.append(n)
        for b in after[n]:
            before[b] -= 1
            if not before[b]:
                heapq.heappush(ready, place[b])
    stuck = [n for n in nodes if before[n]]
    return order + stuck, stuck


def _graphs(nodes: DataFrame, links: DataFrame, fields: list[str], told: Callable[[list[str], list[dict]], Iterator[tuple]], columns: str) -> DataFrame:
    """What `told` yields for each request: rows of `columns`, by its nodes in the caller's order, each once, and its links as dicts of `fields`."""
    id_type = dict(nodes.dtypes)["request_id"]
    first = nodes.groupBy("request_id", "node").agg(F.min(F.struct(F.col("place").isNull().alias("none"), "place")).alias("at"))
    listed = first.groupBy("request_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "node"))), lambda x: x["node"]).alias("nodes"))
    tied = links.groupBy(F.col("request_id").alias("of")).agg(F.collect_list(F.struct(*fields)).alias("links"))
    whole = listed.join(tied, F.col("request_id").eqNullSafe(F.col("of")), "left").select("request_id", "nodes", F.coalesce("links", F.array().cast(tied.schema["links"].dataType)).alias("links"))
    schema = f"request_id {id_type}, {columns}"
    arrow = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GRAPHS):
                part = batch.slice(at, GRAPHS)
                rows = [(key, *row) for key, ns, ls in zip(*(c.to_pylist() for c in part.columns)) for row in told(ns, ls)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return whole.mapInArrow(run, schema)


def topological(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """request_id, node, ord, unordered of nodes(request_id, node, place), so that `before` comes before `after` in pairs(request_id, before, after).

    Ties go by place, then by name. Repeated pairs count once, pairs with a node that isn't there not at all, a pair of a node with itself holds it
    back for good. Nodes in a cycle, and those behind one, come last, by place, and are `unordered`. An empty table gives an empty table.
    """

    def told(listed: list[str], links: list[dict]) -> Iterator[tuple]:
        order, stuck = _kahn(listed, {(p["before"], p["after"]) for p in links})
        held = set(stuck)
        return ((n, k, n in held) for k, n in enumerate(order, 1))

    return _graphs(nodes, pairs.select("request_id", "before", "after").distinct(), ["before", "after"], told, "node string, ord int, unordered boolean")


def _columns(nodes: list[str], out: dict[str, list[str]]) -> dict[str, int]:
    """The length of the longest path to each node from one that nothing points at; nodes in or behind a cycle are one past all others."""
    into = dict.fromkeys(nodes, 0)
    for n in nodes:
        for b in out[n]:
            into[b] += 1
    column = {n: 0 for n in nodes if not into[n]}
    queue = list(column)
    for n in queue:
        for b in out[n]:
            column[b] = max(column.get(b, 0), column[n] + 1)
            into[b] -= 1
            if not into[b]:
                queue.append(b)
    done = set(queue)
    last = max((c for n, c in column.items()), default=0) + 1
    return {n: column[n] if n in done else last for n in nodes}


def _rows(columns: dict[str, int], out: dict[str, list[str]], into: dict[str, list[str]]) -> dict[str, int]:
    """Each node's row in its column: ordered by the mean row of its neighbours on one side, then the other, in turns."""
    held: dict[int, list[str]] = defaultdict(list)
    for n, c in columns.items():
        held[c].append(n)
    row = {n: i for nodes in held.values() for i, n in enumerate(nodes)}
    for turn in range(SWEEPS):
        near = out if turn % 2 else into
        for c in sorted(held, reverse=bool(turn % 2)):
            mean = {n: sum(row[m] for m in near[n]) / len(near[n]) if near[n] else row[n] for n in held[c]}
            held[c].sort(key=lambda n: (mean[n], n))
            row |= {n: i for i, n in enumerate(held[c])}
    return row


def laid_out(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """request_id, node, col, row, x, y of nodes(request_id, node, place) with edges(request_id, src, dst), starting at roots(request_id, root).

    Edges back to the root, loops and edges of nodes that aren't there don't count; parallel edges weigh as often as they come. Columns are by the longest path, so an edge leads to the right;
    rows are turned four times so that edges cross less, and each column is centred against the fullest.
    """

    def told(listed: list[str], links: list[dict]) -> Iterator[tuple]:
        there = set(listed)
        out: dict[str, list[str]] = {n: [] for n in listed}
        into: dict[str, list[str]] = {n: [] for n in listed}
        for a, b, root in sorted((e["src"], e["dst"], e["root"]) for e in links if e["src"] in there and e["dst"] in there):
            if a != b and b != root:
                out[a].append(b)
                into[b].append(a)
        col = _columns(listed, out)
        row = _rows(col, out, into)
        size = Counter(col.values())
        tallest = max(size.values())
        return ((n, col[n], row[n], float(col[n] * COLUMN), (row[n] + (tallest - size[col[n]]) / 2) * ROW) for n in listed)

    links = edges.join(roots, "request_id", "left").select("request_id", "src", "dst", F.coalesce("root", F.lit("")).alias("root"))
    return _graphs(nodes, links, ["src", "dst", "root"], told, "node string, col int, row int, x double, y double")
