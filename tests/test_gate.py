from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Row

from gritstone.plans import catalogue
from gritstone.streaming.gate import REQUEST, Gate, Policy, _in_order, frame, gated, replayed
from gritstone.streaming.runs import run_to_end

FIELDS = ("pool", "at_ms", "seq", "action", "session", "subject", "guest", "ticket", "token", "ms")


class Log:
    def __init__(self, policy):
        self.gate, self.seq = Gate(policy, {n: {} for n in Gate.STATES}), 0

    def __call__(self, now, action, session="s", subject="u", guest=False, ticket=None, token=None, ms=0):
        self.seq += 1
        self.gate.swept(now)
        return self.gate.act(now, Row(*FIELDS)("p", now, self.seq, action, session, subject, guest, ticket, token, ms))


def test_lines_queue_promotion_and_claims():
    do = Log(Policy(lines=2, lease_ms=1000, beat_ms=500, ticket_ms=300, claim_ms=200, typical_ms=10, rate=99))
    assert do(0, "admit", "a")[0] == do(1, "admit", "b")[0] == "ADMITTED" and do(2, "admit", "c")[0] == "BUSY"
    assert do(3, "join", ticket="t1") == ("WAITING", 1, 10) and do(4, "join", ticket="t2") == ("WAITING", 2, 10) and do(4, "join", ticket="t3") == ("WAITING", 3, 20)
    assert do(5, "poll", ticket="t1", token="x")[0] == "WAITING"
    assert do(6, "release", "a")[0] == "RELEASED" and do(6, "release", "a")[0] == "GONE"
    assert do(7, "poll", ticket="t2", token="y")[:2] == ("WAITING", 2)  # not the head
    assert do(8, "poll", ticket="t1", token="x") == ("PROMOTED", 0, 5)
    assert do(9, "admit", "walk-in")[0] == "BUSY"  # the free line is spoken for
    assert do(10, "admit", "c", ticket="t1", token="forged")[0] == "CLAIM_INVALID"
    assert do(11, "admit", "c", ticket="t1", token="x")[0] == "ADMITTED" and do(12, "poll", ticket="t1")[0] == "GONE"
    assert do(13, "leave", ticket="t2")[0] == "LEFT" and do(14, "poll", ticket="t3", token="z")[:2] == ("WAITING", 1)
    assert do(400, "poll", ticket="t3")[0] == "GONE"  # stopped polling
    assert do(900, "beat", "b")[0] == "LIVE" and do(1012, "beat", "c")[0] == "EXPIRED" and do(1401, "beat", "b")[0] == "EXPIRED"


def test_unclaimed_promotion_ends():
    do = Log(Policy(lines=1, ticket_ms=500, claim_ms=100, lease_ms=50))
    assert do(0, "join", ticket="t")[0] == "WAITING" and do(1, "poll", ticket="t", token="x")[0] == "PROMOTED"
    assert do(50, "admit", "w")[0] == "BUSY" and do(102, "admit", "w")[0] == "ADMITTED" and do(103, "poll", ticket="t")[0] == "GONE"


def test_order_of_checks_and_refunds():
    do = Log(Policy(lines=1, rate=3, rate_ms=1000, highs=2, high_ms=100, cool_ms=300, call_ms=60, budget_ms=60, budget_window_ms=10_000, least_ms=8))
    assert do(0, "admit", "a", "g", True)[0] == "ADMITTED" and do(1, "admit", "b", "g", True)[0] == "GUEST_QUOTA"
    assert do(2, "settle", "a", "g", True, ms=7)[0] == "REFUNDED" and do(3, "admit", "b", "g", True)[0] == "BUSY"  # refunded, and again given back
    assert do(4, "admit", "b", "g", True)[0] == "RATE_LIMITED"
    do(5, "release", "a")
    assert do(1001, "admit", "b", "g", True)[0] == "ADMITTED" and do(1002, "settle", "b", "g", True, ms=8)[0] == "KEPT"
    assert do(1100, "high", subject="g")[0] == "NOTED" and do(1201, "high", subject="g")[0] == "NOTED" and do(1250, "high", subject="g")[0] == "COOLED"
    assert do(1549, "admit", "c", "g")[0] == "COOLDOWN" and do(1550, "admit", "c", "g")[0] != "COOLDOWN"
    do.gate.past(30_000)
    assert not (do.gate.cool or do.gate.rates or do.gate.spent or do.gate.highs)


@pytest.mark.parametrize("seed", [1])
def test_stream_tells_what_a_replay_tells(spark, tmp_path, seed):
    rnd = random.Random(seed)
    policy = Policy(lines=2, lease_ms=3000, beat_ms=2000, ticket_ms=9000, claim_ms=5000, rate=2, rate_ms=9000, highs=2, high_ms=6000, cool_ms=4000, call_ms=60, budget_ms=120, budget_window_ms=20_000)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for k in range(240):
        who = rnd.randrange(6)
        action = rnd.choice(["admit"] * 4 + ["beat", "release", "join", "join", "poll", "poll", "leave", "high", "settle"])
        ticket = f"t{who}" if action in ("join", "poll", "leave") or (action == "admit" and rnd.random() < 0.4) else None
        ms = 250 * k + rnd.randrange(200)
        rows.append(Row(*FIELDS)(f"p{rnd.randrange(2)}", int(start.timestamp() * 1000) + ms, k, action, f"s{who}", f"u{who}", who % 2 == 0, ticket, "x", rnd.choice([5, 9000])))
    want = replayed(rows, policy)
    for part in range(3):
        one = [(r.pool, start + timedelta(milliseconds=r.at_ms - int(start.timestamp() * 1000)), r.seq, r.action, r.session, r.subject, r.guest, r.ticket, r.token, r.ms) for r in rows[part * 80 : part * 80 + 80]]
        spark.createDataFrame(one, REQUEST).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        got = run_to_end(gated(spark.readStream.schema(REQUEST).parquet(str(tmp_path / "in")), policy, "1 second"), own=str(tmp_path / "own"), rocks=True)
    told = [tuple(r) for r in got.collect()]
    asked = lambda x: sorted((t for t in x if t[1] is not None), key=lambda t: t[1])
    assert asked(told) == asked(want)
    ended = lambda x: {t[:4] for t in x if t[1] is None}  # noqa: E731  timers may tell of ends after the last request
    assert ended(want) <= ended(told) and len(told) == len(set(told))
    assert {t[5] for t in want} >= {"ADMITTED", "BUSY", "COOLDOWN", "RATE_LIMITED", "GUEST_QUOTA", "CLAIM_INVALID", "WAITING", "PROMOTED", "GONE", "LEFT", "LIVE", "EXPIRED", "NOTED", "COOLED", "RELEASED", "REFUNDED", "KEPT"}


class Counted(dict):
    """A map that counts how often it is read whole."""

    read = 0

    def items(self):
        self.read += 1
        return super().items()


def test_long_queue_is_not_read_for_each_place():
    rnd, maps = random.Random(5), {n: Counted() for n in Gate.STATES}
    gate = Gate(Policy(lines=2, lease_ms=900, ticket_ms=4000, claim_ms=70, rate=1 << 30), maps)
    for k in range(3000):
        action, who = rnd.choice(["join", "join", "poll", "leave", "admit", "release"]), rnd.randrange(400)
        gate.swept(5 * k)
        verdict, place, _ = gate.act(5 * k, Row(*FIELDS)("p", 5 * k, k, action, f"s{who}", "u", False, None if action == "release" else f"t{who}", "x", 0))
        live = {t: v for t, v in dict.items(maps["tickets"]) if v[2] >= 5 * k and (v[3] is None or v[3] >= 5 * k)}
        assert live == dict(dict.items(maps["tickets"]))
        if verdict == "WAITING":
            mine = live[f"t{who}"]
            assert place == 1 + sum(v[3] is None and (v[1], v[0]) < (mine[1], mine[0]) for v in live.values())
    assert gate.queue == sorted((v[1], v[0]) for v in live.values() if v[3] is None) and len(gate.queue) > 100
    assert sum(m.read for m in maps.values()) == 2  # once each for leases and tickets, when the rules were opened


def test_numbers_beside_nulls_stay_exact():
    n = (1 << 53) + 1
    told = frame([("p", None, 5, "s", None, "EXPIRED", None, None, None), ("p", n, 6, "s", "admit", "ADMITTED", None, n, 1)])
    assert told["seq"].tolist()[1] == n and told["wait_ms"].tolist()[1] == n and frame([]).shape == (0, 9)


def test_equal_times_and_numbers_go_by_names():
    rows = [("p", 0, 7, a, s, "u", False, None, None, None) for a, s in (("release", "b"), ("admit", "c"), ("admit", "b"), ("admit", "a"))]
    part = lambda rows: pd.DataFrame(rows, columns=["pool", "at_ms", "seq", "action", "session", "subject", "guest", "ticket", "token", "ms"])
    want = [("a", "admit"), ("b", "admit"), ("b", "release"), ("c", "admit")]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        assert [(r.session, r.action) for x in _in_order(iter([part(order)])) for r in x] == want
    made = replayed([Row(*FIELDS)(*r) for r in rows])
    assert [(t[3], t[4]) for t in made if t[1] is not None] == want


def test_leases_of_large_numbers_in_a_zone_with_a_missing_hour(spark, tmp_path):
    con = duckdb.connect()
    hour = "CASE WHEN i % 4 = 0 THEN 1 WHEN i % 4 = 1 THEN 3 ELSE 2 END"  # 2 o'clock isn't on New York's clocks that night
    con.execute(f"COPY (SELECT 9007199254740993 + 7 * i AS event_id, TIMESTAMP '2024-03-10 00:00:00' + to_minutes(60 * ({hour}) + i % 59) AS ts, i % 23 AS user_id, 'view' AS event_type, 1.5 AS value, '' AS props FROM range(400) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [tuple(r) for r in catalogue.queries()["q_leases"](spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert sorted(got) == sorted(con.execute(catalogue.oracle_sql()["q_leases"]).fetchall())
