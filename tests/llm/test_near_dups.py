from __future__ import annotations

import random
import re

from gritstone.llm.near_dups import near_duplicates

SCHEMA = "extra string, doc_id bigint, text string, component_id int"


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i), i == root(i)) for i, s in sets}


def documents():
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "x y", "Zz"]
    rows = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two"), (9005, "ONE  two\n"), (9006, "one two three")]
    for family in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 120]))]
        for copy in range(rnd.choice([1, 4, 12])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((family * 100 + copy, " ".join(words)))
    rnd.shuffle(rows)
    return rows


def test_same_as_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([("x", i, t, 1) for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_given_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_chain_reaches_smallest(spark):
    words = [f"v{k}" for k in range(200)]
    rows = [(50 - k, " ".join(words[4 * k : 4 * k + 60])) for k in range(20)]
    df = spark.createDataFrame([("x", i, t, 1) for i, t in rows], SCHEMA)
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {i: v[1] for i, v in brute(rows).items()} == {i: 31 for i, _ in rows}


def test_empty_null_and_repeated_rows(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [("x", None, "a b c d e f", 1), ("x", 3, "a b c d e f", 1), ("x", 3, "a b c d e f", 1), ("x", 2, "A b c d e f", None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(2, 2, True), (3, 2, False), (3, 2, False), (None, None, True)]
