from __future__ import annotations

import datetime

from gritstone.llm.url_lists import entries_of, evaluate


def test_entries_of_many_labels(spark):
    day = datetime.date(2024, 3, 1)
    listed = ["b.c.d.e.f.g.example", "k." * 120 + "example"]
    urls = ["http://a.b.c.d.e.f.g.example/x", "http://b.c.d.e.f.g.example/", "http://c.d.e.f.g.example/", "https://z.y." + listed[1]]
    entries = spark.createDataFrame([(d, "spam", day, True) for d in listed], "domain string, category string, effective date, active boolean")
    got = evaluate(spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "capture_id int, url string, fetched_at date"), entries).collect()
    assert {r.capture_id: r.matches for r in got} == {0: [f"{listed[0]}:spam"], 1: [f"{listed[0]}:spam"], 2: [], 3: [f"{listed[1]}:spam"]}


def test_drawn_entries_have_parents_of_any_length(spark):
    pages = spark.createDataFrame([(k, f"http://a.b.c.d.e.f.g{k}.example/") for k in range(30)], "page_id long, url string")
    assert {7, 8} <= {r.domain.count(".") + 1 for r in entries_of(pages).collect()}


def test_against_a_plain_reading(spark):
    import random
    import re

    rnd = random.Random(4)
    d0 = datetime.date(2024, 1, 1)
    names = ["example.com", "a.example.com", "b.a.example.com", "other.org", "org", "10.0.0.1", "0.1", "[2001:db8::1]", "x.y.z.other.org"]
    entries = [(rnd.choice(names + ["EXAMPLE.com"]), rnd.choice(["spam", "adult", None]), d0 + datetime.timedelta(rnd.randrange(30)), rnd.random() < 0.6) for _ in range(60)] + [(None, "spam", d0, True), ("other.org", "spam", None, True), ("other.org", "spam", d0, None)]
    urls = [f"http://{n}/p" for n in names] + ["https://user:pw@A.Example.com:8080/x?y#z", "http://[2001:DB8::1]:80/", "//other.org", "mailto:x@other.org", "", None, "http:///nohost", "http://other.org./", "http://" + "s." * 60 + "other.org/" + "p" * 5000]
    captures = [(k, rnd.choice(urls), d0 + datetime.timedelta(rnd.randrange(35)) if rnd.random() < 0.95 else None) for k in range(300)] + [(1, urls[0], d0)] * 2

    def host(url):
        m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]]+)", url or "")
        return (m.group(1).lower().rstrip(".") or None) if m else None

    def covers(domain, h):
        return h == domain or (h.endswith("." + domain) and "." in domain and not re.fullmatch(r"\[.*\]|[0-9.]+", h))

    def active(domain, category, day):
        days = {}
        for d, c, e, a in entries:
            if None not in (d, e, a) and (d.lower(), c) == (domain, category) and e <= day:
                days[e] = days.get(e, False) or a
        return bool(days) and days[max(days)]

    kinds = {(d.lower(), c) for d, c, _, _ in entries if d}
    got = evaluate(spark.createDataFrame([(k, u, d, "x") for k, u, d in captures], "capture_id int, url string, fetched_at date, domain string"), spark.createDataFrame(entries, "domain string, category string, effective date, active boolean")).collect()
    assert len(got) == len(captures)
    told = sorted(((r.capture_id, r.url or "", str(r.fetched_at), tuple(r.matches)) for r in got))
    assert told == sorted((k, u or "", str(day), tuple(sorted({":".join(filter(None, (d, c))) for d, c in kinds if host(u) and day and covers(d, host(u)) and active(d, c, day)}))) for k, u, day in captures)


def test_without_captures_or_entries(spark):
    captures = "capture_id int, url string, fetched_at date"
    entries = "domain string, category string, effective date, active boolean"
    assert evaluate(spark.createDataFrame([], captures), spark.createDataFrame([], entries)).collect() == []
    assert [r.blocked for r in evaluate(spark.createDataFrame([(1, "http://x.org", datetime.date(2024, 1, 1))], captures), spark.createDataFrame([], entries)).collect()] == [False]


def test_same_as_its_sql(spark, sf):
    import duckdb

    from gritstone.llm.url_lists import ORACLE_SQL, op10_temporal_url_lists

    duckdb.sql(f"create or replace view pages as select * from '{sf}/pages.parquet'")
    want = duckdb.sql(ORACLE_SQL)
    df = op10_temporal_url_lists(spark, sf)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(repr, want.fetchall()))
