from __future__ import annotations

import random
import re
from collections import Counter

from gritstone.llm.decontaminate import RADIUS, leaks

DOCS, ITEMS = "item_id int, doc_id bigint, text string, hash string", "item_id bigint, text string, doc_id int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def grams(w, size):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(docs, items, least=0.75):
    """Every item-sized window of every document."""
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            want = words(item)
            if d is None or i is None or not want or not w:
                continue
            size = min(5, len(want))
            b, n = grams(want, size), min(len(w), len(want))
            best = max(((sum((a & b).values()) / max(1, sum((a | b).values())), -p) for p in range(len(w) - n + 1) for a in [grams(w[p : p + n], size)]), default=(0, 0))
            if best[0] >= least:
                out[d, i] = (round(best[0], 9), -best[1])
    return out


def found(spark, docs, items):
    got = leaks(spark.createDataFrame([(1, d, t, "x") for d, t in docs], DOCS).repartition(3), spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS))
    return {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in got.collect()}


def test_same_as_brute_force(spark):
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(120)] + ["Éa", "B"]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate([3, 5, 9, 30, 45, 60, 80])] + [(90, ["x", "y"] * 20)]
    docs = [(500, None), (501, ""), (502, "one"), (None, " ".join(items[3][1]))]
    for d in range(60):
        _, item = rnd.choice(items)
        part = list(item)
        for _ in range(rnd.choice([0, 0, 1, 2, 3])):
            k = rnd.randrange(len(part))
            part[k : k + 1] = rnd.choice([[], ["new"], ["new", "er"]])
        docs.append((d, rnd.choice([" ", "\n", "\t "]).join(say(rnd.choice([0, 3, 90])) + part + say(rnd.choice([0, 50]))).title()))
    items = [(k, " ".join(w)) for k, w in items] + [(200, None), (201, " "), (None, "a b c d e")]
    want, got = brute(docs, items), found(spark, docs, items)
    # a window is found where a shared shingle lines up; an equally good or slightly better shifted one may stand beside it
    assert got.keys() == want.keys() and len(want) > 20
    assert all(got[k][0] <= want[k][0] for k in got) and sum(got[k] == want[k] for k in got) >= 0.8 * len(got)


def test_best_window_between_alignments(spark):
    item = [f"i{k}" for k in range(100)]
    filler = lambda c, n: [f"{c}{k}" for k in range(n)]
    grown = filler("a", 30) + item[4:50] + filler("b", 8) + item[50:96] + filler("c", 30)
    docs = [(1, " ".join(grown)), (2, " ".join(item[:90])), (3, " ".join(item[:40] + filler("d", 400) + item[40:])), (4, " ".join(grown + grown))]
    items = [(1, " ".join(item)), (2, " ".join(item[4:50] + filler("b", 8) + item[50:60]))]
    want = brute(docs, items)
    assert want[1, 1] == (round(84 / 108, 9), 30) and want.keys() == {(1, 1), (1, 2), (2, 1), (4, 1), (4, 2)}
    assert found(spark, docs, items) == want


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()}
    plain = lambda t: " " + " ".join(words(t)) + " "
    held = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if plain(i.text) in plain(d.text)}
    assert held and held <= got


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, 1, "a b c d e f", "x")], DOCS), spark.createDataFrame([], DOCS)
    item, no_item = spark.createDataFrame([(1, "a b c d e f", 1)], ITEMS), spark.createDataFrame([], ITEMS)
    assert leaks(none, item).collect() == leaks(some, no_item).collect() == []
    assert len(leaks(some.union(some), item).collect()) == 1
    assert RADIUS == 39
