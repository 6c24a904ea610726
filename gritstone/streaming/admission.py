"""Leases and queues of pools with a cap, as state of a stream or as a replay of a log.

Requests come as (pool, ts in milliseconds, seq, caller, action): join, beat, claim or leave. A
pool admits up to `cap` callers; each holds a lease that ends `ttl` after its last beat. Others
wait in order of arrival. Whenever there is room, the first in the queue is promoted and has
`claim` to come for its place; then it is let go. State is one pool's leases and queue, whose
sizes are bounded by the cap and by those who wait.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

OUT = "pool string, seq bigint, caller string, verdict string, position int, wait_ms bigint"


class Pool:
    """State of one pool. Verdicts: ADMITTED, QUEUED, PROMOTED, LIVE, CLAIMED, GONE, LEFT, EXPIRED."""

    def __init__(self, cap: int, ttl: int, claim: int, typical: int, held: str | None = None) -> None:
        self.cap, self.ttl, self.claim, self.typical = cap, ttl, claim, typical
        self.leases, self.promised, self.queue = json.loads(held) if held else ({}, {}, [])

    def dump(self) -> str:
        return json.dumps([self.leases, self.promised, self.queue])

    def sweep(self, now: int) -> None:
        """End what has run out, and promote while there is room."""
        self.leases = {c: t for c, t in self.leases.items() if t > now}
        self.promised = {c: t for c, t in self.promised.items() if t > now}
        while self.queue and len(self.leases) + len(self.promised) < self.cap:
            self.promised[self.queue.pop(0)] = now + self.claim

    def act(self, now: int, caller: str, action: str) -> tuple[str, int | None, int | None]:
        self.sweep(now)
        if action == "leave":
            there = caller in self.leases or caller in self.promised or caller in self.queue
            self.leases.pop(caller, None)
            self.promised.pop(caller, None)
            self.queue = [c for c in self.queue if c != caller]
            self.sweep(now)
            return ("LEFT" if there else "GONE"), None, None
        if action == "beat":
            if caller not in self.leases:
                return "EXPIRED", None, None
            self.leases[caller] = now + self.ttl
            return "LIVE", None, None
        if action == "claim":
            if caller not in self.promised:
                return "GONE", None, None
            del self.promised[caller]
            self.leases[caller] = now + self.ttl
            return "CLAIMED", None, None
        if caller in self.leases:
            return "LIVE", None, None
        if caller in self.promised:
            return "PROMOTED", None, None
        if caller not in self.queue:
            if len(self.leases) + len(self.promised) < self.cap:
                self.leases[caller] = now + self.ttl
                return "ADMITTED", None, None
            self.queue.append(caller)
        place = self.queue.index(caller) + 1
        return "QUEUED", place, math.ceil(place / self.cap) * self.typical


def _told(pool: Pool, name: str, rows: pd.DataFrame) -> pd.DataFrame:
    out = [(name, int(r.seq), r.caller, *pool.act(int(r.ts), r.caller, r.action)) for r in rows.sort_values(["ts", "seq"]).itertuples()]
    told = pd.DataFrame(out, columns=["pool", "seq", "caller", "verdict", "position", "wait_ms"])
    return told.astype({"position": "Int32", "wait_ms": "Int64"})


def replayed(log: DataFrame, cap: int = 10, ttl: int = 45_000, claim: int = 30_000, typical: int = 180_000) -> DataFrame:
    """Verdicts on a whole log of pool requests, each pool in order of time. A pool's order is its own, so pools run side by side, and a pool's log of one day or the like should be one pool."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _told(Pool(cap, ttl, claim, typical), key[0], rows)

    return log.groupBy("pool").applyInPandas(run, OUT)


def admitted(stream: DataFrame, cap: int = 10, ttl: int = 45_000, claim: int = 30_000, typical: int = 180_000) -> DataFrame:
    """The same verdicts as requests stream in; a pool's state lasts from batch to batch, and a lost executor finds it in the stream's checkpoint."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        pool = Pool(cap, ttl, claim, typical, state.get[0] if state.exists else None)
        rows = pd.concat(list(parts))  # a batch's requests of one pool
        yield _told(pool, key[0], rows)
        state.update((pool.dump(),))

    return stream.groupBy("pool").applyInPandasWithState(run, OUT, "held string", "append", "NoTimeout")


def settled(calls: DataFrame, least_ms: int = 8_000) -> DataFrame:
    """calls(ms, charged) with charged given back for calls that were shorter than least_ms."""
    return calls.withColumn("charged", F.when(F.col("ms") < least_ms, 0).otherwise(F.col("charged")))
