from __future__ import annotations

from gritstone.functions import names as N
from gritstone.operators.offices import offices

FACTS = "fact_id bigint, url string, object string, detail map<string,string>"


def test_offices_of_many_facts(spark):
    far = "House 9, Some Far Away Street"
    facts = [
        (1, "https://a.example/1", None, {"phone": "079 23456789"}),  # named by the page's title only
        (2, "https://a.example/2", "jan_seva_kendra", {"address": f"{far}  1", "hours": "10 to 5", "email": " Desk@A.example "}),
        *((10 + k, f"https://a.example/{k % 9}", "jan_seva_kendra", {"address": f"{far} {k}", "phone": f"079 2345678{k % 10}"}) for k in range(9)),
        (30, "https://collectorkheda.example", None, {"name": "Lake Board", "phone": "1234567890"}), (31, "https://a.example/1", None, {"name": "Lake Board", "address": f"{far}, Anand"}),
        (40, "https://a.example/2", None, {"name": "Dr. Vale", "phone": "1234567890"}), (41, "https://a.example/2", "jan_seva_kendra", {"address": "short", "phone": "N/A"}), (42, "https://a.example/2", None, None),
    ]
    pages = spark.createDataFrame([("https://a.example/1", "Forms | Jan Seva Kendra")], "url string, title string")
    dictionary = spark.createDataFrame([(p, c, i) for i, (p, c) in enumerate(N.district_patterns())], "pattern string, code string, place int")
    found, refused = offices(spark.createDataFrame(facts, FACTS), pages, dictionary)
    got = {(r.name, r.scope): r for r in found.collect()}
    assert set(got) == {("Jan seva kendra", "IN-GJ"), ("Lake Board", "IN-GJ-KHEDA"), ("Lake Board", "IN-GJ-ANAND")}
    kendra = got["Jan seva kendra", "IN-GJ"]
    assert kendra.status == "EXTRACTED" and kendra.facts == 11 and kendra.address == [f"{far} 1", f"{far} 0", f"{far} 2", f"{far} 3"] and kendra.conflicting and kendra.hours == ["10 to 5"] and kendra.email == ["desk@a.example"]
    assert len(kendra.phone) == 6 and kendra.phone[0] == "079 23456789" and len(kendra.url) == 6 and kendra.type == "Jan Seva Kendra"
    assert not got["Lake Board", "IN-GJ-KHEDA"].conflicting and got["Lake Board", "IN-GJ-KHEDA"].address is None
    assert sorted(map(tuple, refused.collect())) == [(40, "UNNAMED"), (41, "UNREACHABLE"), (42, "UNREACHABLE")]
    none, also = offices(spark.createDataFrame([], FACTS), pages, dictionary)
    assert none.collect() == also.collect() == []
