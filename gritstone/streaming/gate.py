"""The whole way of a call to a line: cooldown, rate, guest budget, lease or queue, as a processor with named states and timers.

Requests come as (pool, at, seq, action, session, subject, guest, ticket, token, ms), at a timestamp. The actions
and what is told of them:

- admit: COOLDOWN, RATE_LIMITED, GUEST_QUOTA, BUSY, CLAIM_INVALID (with a ticket) or ADMITTED, in this order of checks. A guest's budget is
  reserved whole before a line is taken and given back if none is had.
- beat: LIVE, which lengthens the lease, or EXPIRED. release: RELEASED or GONE.
- join: WAITING with a place in the queue and a guess of the wait. poll: WAITING, PROMOTED for the head when a line is free, or GONE. leave: LEFT or GONE.
- high: NOTED, or COOLED when it is one too many within the trailing window. settle: REFUNDED for a call under `least_ms`, else KEPT.
- without a request: EXPIRED, when a lease runs out.

A pool has few lines, one count for all, so its requests are one key, in order of time, then of number; what has both alike goes by its names. Its state is maps in the state store, a
row each for a lease, ticket or subject. A batch reads a pool's leases and tickets once and a subject's row when it is first asked for, keeps them
while its requests go by, and writes back what has changed; a place in the queue is looked up in a sorted list, and ends come from heaps, so a request takes no longer in a long queue. Of a batch's
requests a pool holds numbers, with names as codes. Timers end leases that nobody asks about
and clear what is past; requests don't depend on when they fire, because each looks at its own time first.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from collections import namedtuple
from collections.abc import Iterator, MutableMapping
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REQUEST = "pool string, at timestamp, seq bigint, action string, session string, subject string, guest boolean, ticket string, token string, ms bigint"
TOLD = "pool string, seq bigint, at_ms bigint, session string, action string, verdict string, place int, wait_ms bigint, active int"


@dataclass(frozen=True)
class Policy:
    """Fixed values of the service, in milliseconds; a caller may set others."""

    lines: int = 10
    lease_ms: int = 105_000
    beat_ms: int = 45_000
    ticket_ms: int = 60_000
    claim_ms: int = 30_000
    typical_ms: int = 240_000
    rate: int = 6
    rate_ms: int = 60_000
    call_ms: int = 60_000
    budget_ms: int = 60_000
    budget_window_ms: int = 86_400_000
    highs: int = 3
    high_ms: int = 3_600_000
    cool_ms: int = 3_600_000
    least_ms: int = 8_000


class Gate:
    """The rules, over maps from keys to tuples. leases: session -> (until,); tickets: ticket -> (seq, since, until, claim_until, token); cool, rates, spent: subject -> (until,), (window, n), (window, ms); highs: subject -> (times,)."""

    STATES = {
        "leases": ("session string", "until bigint"),
        "tickets": ("ticket string", "seq bigint, since bigint, until bigint, claim_until bigint, token string"),
        "cool": ("subject string", "until bigint"),
        "rates": ("subject string", "window bigint, n int"),
        "spent": ("subject string", "window bigint, ms bigint"),
        "highs": ("subject string", "times array<bigint>"),
    }

    def __init__(self, policy: Policy, maps: dict[str, MutableMapping]) -> None:
        self.p = policy
        self.leases, self.tickets, self.cool, self.rates, self.spent, self.highs = (maps[n] for n in self.STATES)
        self.until = {s: v[0] for s, v in self.leases.items()}  # as many as there are lines
        held = list(self.tickets.items())
        self.queue = sorted((v[1], v[0]) for _, v in held if v[3] is None)
        self.claims = {t: v[3] for t, v in held if v[3] is not None}  # as many as there are lines, and those that end at this moment
        self.ends = [(self._end(v), t) for t, v in held]  # a ticket's later ends are added; one that isn't its own any more says nothing
        heapq.heapify(self.ends)

    @staticmethod
    def _end(v: tuple) -> int:
        return v[2] if v[3] is None else min(v[2], v[3])

    def _lease(self, session: str, until: int | None) -> None:
        if until is None:
            del self.leases[session], self.until[session]
        else:
            self.leases[session] = (until,)
            self.until[session] = until

    def _hold(self, ticket: str, v: tuple | None) -> None:
        """Writes a ticket, or drops it, with its place in the queue, its claim and its end."""
        had = self.tickets.get(ticket)
        if had is not None and had[3] is None:
            del self.queue[bisect_left(self.queue, (had[1], had[0]))]
        self.claims.pop(ticket, None)
        if v is None:
            if had is not None:
                del self.tickets[ticket]
            return
        self.tickets[ticket] = v
        if v[3] is None:
            insort(self.queue, (v[1], v[0]))
        else:
            self.claims[ticket] = v[3]
        heapq.heappush(self.ends, (self._end(v), ticket))

    def swept(self, now: int) -> list[tuple[str, int]]:
        """Ends leases and tickets that have run out; (session, until) of the leases."""
        ended = [(s, until) for s, until in self.until.items() if until < now]
        for s, _ in ended:
            self._lease(s, None)
        while self.ends and self.ends[0][0] < now:
            end, ticket = heapq.heappop(self.ends)
            held = self.tickets.get(ticket)
            if held is not None and self._end(held) == end:
                self._hold(ticket, None)
        return sorted(ended, key=lambda e: (e[1], e[0]))

    def past(self, now: int) -> None:
        """Clears subjects whose windows are over."""
        for held, over in ((self.cool, lambda v: v[0] <= now), (self.rates, lambda v: (v[0] + 1) * self.p.rate_ms <= now), (self.spent, lambda v: (v[0] + 1) * self.p.budget_window_ms <= now), (self.highs, lambda v: max(v[0]) <= now - self.p.high_ms)):
            for k in [k for k, v in held.items() if over(v)]:
                del held[k]

    def next_end(self) -> int | None:
        ends = [v[0] for _, v in self.leases.items()] + [min(v[2], v[3] or v[2]) for _, v in self.tickets.items()]
        return min(ends, default=None)

    def _spend(self, subject: str, now: int, ms: int) -> int:
        window = now // self.p.budget_window_ms
        had = self.spent.get(subject)
        total = max(0, (had[1] if had and had[0] == window else 0) + ms)
        self.spent[subject] = (window, total)
        return total

    def _taken(self, now: int) -> int:
        return len(self.until) + sum(1 for claim in self.claims.values() if claim > now)

    def _place(self, ticket: str) -> int:
        mine = self.tickets[ticket]
        return 1 + bisect_left(self.queue, (mine[1], mine[0]))

    def act(self, now: int, r: Any) -> tuple[str, int | None, int | None]:
        """(verdict, place, wait) of a request, after swept(now)."""
        return getattr(self, f"_{r.action}")(now, r)

    def _admit(self, now: int, r: Any) -> tuple[str, None, None]:
        held = self.cool.get(r.subject)
        if held and held[0] > now:
            return "COOLDOWN", None, None
        window = now // self.p.rate_ms
        had = self.rates.get(r.subject)
        n = (had[1] if had and had[0] == window else 0) + 1
        self.rates[r.subject] = (window, n)
        if n > self.p.rate:
            return "RATE_LIMITED", None, None
        if r.guest and self._spend(r.subject, now, self.p.call_ms) > self.p.budget_ms:
            self._spend(r.subject, now, -self.p.call_ms)
            return "GUEST_QUOTA", None, None
        verdict = self._line(now, r)
        if verdict != "ADMITTED" and r.guest:
            self._spend(r.subject, now, -self.p.call_ms)
        return verdict, None, None

    def _line(self, now: int, r: Any) -> str:
        if r.ticket is not None:
            held = self.tickets.get(r.ticket)
            if not held or held[3] is None or held[3] <= now or held[4] is None or held[4] != r.token:
                return "CLAIM_INVALID"
            if len(self.until) >= self.p.lines:
                return "BUSY"
            self._hold(r.ticket, None)
        elif self._taken(now) >= self.p.lines:
            return "BUSY"
        self._lease(r.session, now + self.p.lease_ms)
        return "ADMITTED"

    def _beat(self, now: int, r: Any) -> tuple[str, None, None]:
        held = self.until.get(r.session)
        if held is None or held <= now:
            return "EXPIRED", None, None
        self._lease(r.session, now + self.p.beat_ms)
        return "LIVE", None, None

    def _release(self, now: int, r: Any) -> tuple[str, None, None]:
        there = r.session in self.until
        if there:
            self._lease(r.session, None)
        return ("RELEASED" if there else "GONE"), None, None

    def _join(self, now: int, r: Any) -> tuple[str, int, int]:
        if self.tickets.get(r.ticket) is None:
            self._hold(r.ticket, (r.seq, now, now + self.p.ticket_ms, None, None))
        return self._waiting(r.ticket)

    def _waiting(self, ticket: str) -> tuple[str, int, int]:
        place = self._place(ticket)
        return "WAITING", place, math.ceil(place / self.p.lines) * self.p.typical_ms

    def _poll(self, now: int, r: Any) -> tuple[str, int | None, int | None]:
        held = self.tickets.get(r.ticket)
        if not held:
            return "GONE", None, None
        if held[3] is not None:
            return "PROMOTED", 0, None
        seq, since = held[:2]
        self._hold(r.ticket, (seq, since, now + self.p.ticket_ms, None, None))
        if self._taken(now) < self.p.lines and self._place(r.ticket) == 1:
            self._hold(r.ticket, (seq, since, now + self.p.ticket_ms, now + self.p.claim_ms, r.token))
            return "PROMOTED", 0, now - since
        return self._waiting(r.ticket)

    def _leave(self, now: int, r: Any) -> tuple[str, None, None]:
        there = self.tickets.get(r.ticket) is not None
        if there:
            self._hold(r.ticket, None)
        return ("LEFT" if there else "GONE"), None, None

    def _high(self, now: int, r: Any) -> tuple[str, None, None]:
        times = [t for t in (self.highs.get(r.subject) or ([],))[0] if t > now - self.p.high_ms] + [now]
        self.highs[r.subject] = (times,)
        if len(times) < self.p.highs:
            return "NOTED", None, None
        self.cool[r.subject] = (now + self.p.cool_ms,)
        return "COOLED", None, None

    def _settle(self, now: int, r: Any) -> tuple[str, None, None]:
        if not r.guest or r.ms >= self.p.least_ms:
            return "KEPT", None, None
        self._spend(r.subject, now, -self.p.call_ms)
        return "REFUNDED", None, None


class _Held(MutableMapping):
    """A map state of one key as a mapping."""

    def __init__(self, state) -> None:  # noqa: ANN001
        self.state = state

    def __getitem__(self, key: str) -> tuple:
        if not self.state.containsKey((key,)):
            raise KeyError(key)
        return tuple(self.state.getValue((key,)))

    def __setitem__(self, key: str, value: tuple) -> None:
        self.state.updateValue((key,), value)

    def __delitem__(self, key: str) -> None:
        self.state.removeKey((key,))

    def __iter__(self) -> Iterator[str]:
        return iter([k[0] for k in self.state.keys()])

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())

    def items(self) -> list[tuple[str, tuple]]:
        return [(k[0], tuple(v)) for k, v in self.state.iterator()]


class _Kept(MutableMapping):
    """A map state of one key as a mapping that is read and written once in a batch: rows when first asked for, or all with `whole`; what has changed goes back with flush()."""

    def __init__(self, state, whole: bool) -> None:  # noqa: ANN001
        self.held = _Held(state)
        self.new = not state.exists()
        self.rows: dict[str, tuple | None] = dict(self.held.items()) if whole and not self.new else {}
        self.whole, self.changed = whole or self.new, set()

    def __getitem__(self, key: str) -> tuple:
        v = self.get(key)
        if v is None:
            raise KeyError(key)
        return v

    def get(self, key: str, default: tuple | None = None) -> tuple | None:
        if key not in self.rows and not self.whole:
            self.rows[key] = self.held.get(key)
        v = self.rows.get(key)
        return default if v is None else v

    def __setitem__(self, key: str, value: tuple) -> None:
        self.rows[key] = value
        self.changed.add(key)

    def __delitem__(self, key: str) -> None:
        self.rows[key] = None
        self.changed.add(key)

    def items(self) -> list[tuple[str, tuple]]:
        own = {} if self.whole else dict(self.held.items())
        return [(k, v) for k, v in (own | self.rows).items() if v is not None]

    def __iter__(self) -> Iterator[str]:
        return iter([k for k, _ in self.items()])

    def __len__(self) -> int:
        return len(self.items())

    def flush(self) -> None:
        for key in self.changed:
            v = self.rows[key]
            if v is not None:
                self.held[key] = v
            elif not self.new and key in self.held:
                del self.held[key]


_Request = namedtuple("_Request", "seq at_ms ms guest action session subject ticket token")
_NAMES, _SLICE = ("action", "session", "subject", "ticket", "token"), 50_000


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[list[_Request]]:
    """A batch's requests of one pool in order of time, in slices. All that is held of them are numbers: names are codes, each name once."""
    codes: dict[str, dict] = {c: {None: 0} for c in _NAMES}
    held: list[tuple] = []
    for part in parts:
        own = []
        for c in _NAMES:
            known = codes[c]
            at, names = pd.factorize(part[c])  # -1 for null
            told = np.array([known.setdefault(n, len(known)) for n in names] + [0], "int32")
            own.append(told[at])
        ms = part["ms"]
        numbers = (part["seq"].to_numpy("int64"), part["at_ms"].to_numpy("int64"), ms.fillna(0).to_numpy("int64"), ms.isna().to_numpy(), part["guest"].fillna(False).to_numpy("bool"))
        held.append((*numbers, *own))
    seq, at_ms, ms, no_ms, guest, *own = (np.concatenate(c) for c in zip(*held))
    names = [list(codes[c]) for c in _NAMES]
    ranks = [np.argsort(sorted(range(len(n)), key=lambda i: n[i] or ""))[c] for n, c in zip(names, own)]
    order = np.lexsort((*ranks, seq, at_ms))
    for k in range(0, len(order), _SLICE):
        at = order[k : k + _SLICE]
        lists = [[n[i] for i in c[at].tolist()] for n, c in zip(names, own)]
        yield [_Request(s, t, None if no else m, *rest) for s, t, m, no, *rest in zip(seq[at].tolist(), at_ms[at].tolist(), ms[at].tolist(), no_ms[at].tolist(), guest[at].tolist(), *lists)]


def _ms(at: datetime) -> int:
    return int(round((at if at.tzinfo else at.astimezone(timezone.utc)).timestamp() * 1000))


class _Processor(StatefulProcessor):
    def __init__(self, policy: Policy) -> None:
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = {n: handle.getMapState(n, k, v) for n, (k, v) in Gate.STATES.items()}

    def _opened(self) -> tuple[Gate, list[_Kept]]:
        """The rules over what is held of the present pool."""
        maps = {n: _Kept(state, n in ("leases", "tickets")) for n, state in self.states.items()}
        return Gate(self.policy, maps), list(maps.values())

    @staticmethod
    def _ended(gate: Gate, pool: str, now: int) -> list[tuple]:
        return [(pool, None, until, session, None, "EXPIRED", None, None, None) for session, until in gate.swept(now)]

    def _wake(self, gate: Gate, now: int) -> None:
        """One timer for the next end there is."""
        end = gate.next_end()
        if end is not None and end + 1 not in {t for t in self.handle.listTimers()}:
            self.handle.registerTimer(max(end, now) + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (gate, kept), now = self._opened(), 0
        for requests in _in_order(rows):
            out = []
            for r in requests:
                now = r.at_ms
                out += self._ended(gate, key[0], now)
                out.append((key[0], r.seq, now, r.session, r.action, *gate.act(now, r), len(gate.until)))
            yield frame(out)
        for state in kept:
            state.flush()
        self._wake(gate, now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = int(expiredTimerInfo.getExpiryTimeInMs())
        gate, kept = self._opened()
        out = self._ended(gate, key[0], now)
        gate.past(now)
        for state in kept:
            state.flush()
        self._wake(gate, now)
        yield frame(out)

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    columns = ("pool", "seq", "at_ms", "session", "action", "verdict", "place", "wait_ms", "active")
    types = {"seq": "Int64", "at_ms": "Int64", "place": "Int32", "wait_ms": "Int64", "active": "Int32"}
    return pd.DataFrame({c: pd.array(v, types.get(c, "object")) for c, v in zip(columns, zip(*rows) if rows else [()] * len(columns))})  # numbers beside nulls never go through doubles


def gated(requests: DataFrame, policy: Policy = Policy(), lateness: str = "1 minute") -> DataFrame:
    """The verdicts on a stream of requests, as TOLD. Needs RocksDB as state store."""
    own = requests.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", lateness)
    return own.groupBy("pool").transformWithStateInPandas(_Processor(policy), TOLD, "append", "EventTime")


def replayed(rows: list[Row], policy: Policy = Policy()) -> list[tuple]:
    """The verdicts on a short log of requests with at_ms, held in memory: what the stream is tested against."""
    gates: dict[str, Gate] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r.at_ms, r.seq, *((r[c] or "") for c in reversed(_NAMES)))):
        gate = gates.setdefault(r.pool, Gate(policy, {n: {} for n in Gate.STATES}))
        out += [(r.pool, None, until, session, None, "EXPIRED", None, None, None) for session, until in gate.swept(r.at_ms)]
        out.append((r.pool, r.seq, r.at_ms, r.session, r.action, *gate.act(r.at_ms, r), len(gate.leases)))
    return out
