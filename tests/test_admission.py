from __future__ import annotations

import random

from gritstone.streaming.admission import Pool, admitted, replayed, settled

SCHEMA = "pool string, ts bigint, seq bigint, caller string, action string"


def test_cap_queue_promotion_and_claims():
    p = Pool(2, 100, 50, 10)
    assert p.act(0, "a", "join")[0] == p.act(1, "b", "join")[0] == "ADMITTED"
    assert p.act(2, "c", "join") == ("QUEUED", 1, 10) and p.act(3, "d", "join") == ("QUEUED", 2, 10) and p.act(3, "e", "join") == ("QUEUED", 3, 20)
    assert p.act(4, "c", "join")[1] == 1  # asking again keeps the place
    assert p.act(5, "a", "leave")[0] == "LEFT" and p.act(5, "a", "leave")[0] == "GONE"
    assert p.act(6, "x", "join")[0] == "QUEUED"  # a walk-in can't take a promised place
    assert p.act(7, "x", "claim")[0] == "GONE" and p.act(8, "c", "join")[0] == "PROMOTED" and p.act(9, "c", "claim")[0] == "CLAIMED"
    assert p.act(60, "b", "beat")[0] == "LIVE" and p.act(120, "c", "beat")[0] == "EXPIRED"  # c's lease ran out, so d was promoted
    assert p.act(121, "d", "join")[0] == "PROMOTED" and p.act(175, "d", "claim")[0] == "GONE"


def requests(n=200):
    rnd = random.Random(3)
    return [(f"p{rnd.randrange(3)}", 100 * k + rnd.randrange(50), k, f"c{rnd.randrange(12)}", rnd.choice(["join", "join", "join", "beat", "claim", "leave"])) for k in range(n)]


def test_stream_tells_what_a_replay_tells(spark, tmp_path):
    rows = requests()
    want = sorted(map(tuple, replayed(spark.createDataFrame(rows, SCHEMA), 3, 2_000, 900, 500).collect()))
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], SCHEMA).coalesce(1).write.json(str(tmp_path / "in"), mode="append")
        run = admitted(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), 3, 2_000, 900, 500).writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out"))
        run.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("pool", "seq", "caller", "verdict", "position", "wait_ms").collect()))
    assert [x[:4] for x in got] == [x[:4] for x in want] and {x[3] for x in want} >= {"ADMITTED", "QUEUED", "LEFT", "GONE", "LIVE"}


def test_short_calls_cost_nothing(spark):
    rows = spark.createDataFrame([(7_999, 5), (8_000, 5)], "ms int, charged int")
    assert [r.charged for r in settled(rows).orderBy("ms").collect()] == [0, 5]
