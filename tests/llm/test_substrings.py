from __future__ import annotations

import hashlib
import random
import re

from gritstone.llm.substrings import repeat_report, without_repeats

SCHEMA = "text_key int, doc_id bigint, text string, owner string"


def brute(rows, span=50):
    first, words_of = {}, []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        words_of.append((i, words))
        for p in range(len(words) - span + 1):
            w = tuple(words[p : p + span])
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, words in words_of:
        gone = [False] * len(words)
        for p in range(len(words) - span + 1):
            if first[tuple(words[p : p + span])] < i:
                gone[p : p + span] = [True] * span
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def report(spark, rows):
    df = spark.createDataFrame([(1, i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeat_report(df).collect()}


def test_same_as_brute_force(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    say = lambda n: [rnd.choice(words) for _ in range(n)]
    passages = [say(n) for n in (49, 50, 51, 75, 140)] + [["a"] * 90, ["a", "b"] * 60, ["a", "b", "c"] * 40, ["a"] * 30 + say(30) + ["a"] * 30]
    rows = [(500, None), (501, ""), (502, "x"), (503, " ".join(passages[1])), (7, " \n".join(passages[1]))]
    for i in range(60):
        parts = []
        for _ in range(rnd.choice([1, 2, 4])):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 20)
            parts += say(rnd.randrange(0, 40)) + (p[a : a + rnd.choice([30, 55, 200])])
        rows.append((i * 3 + 100, rnd.choice([" ", "\n", "  "]).join(parts)))
    assert report(spark, rows) == brute(rows)


def test_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows)
    assert sum(v[1] for v in want.values()) > 0
    assert report(spark, rows) == want


def test_texts(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, 1, passage + " tail  one", "x"), (1, 2, "head\n" + passage + " end", "x"), (1, None, passage, "x"), (1, 3, passage + " tail  one", "x"), (1, 3, passage + " tail  one", "x")]
    out = without_repeats(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["text_key", "doc_id", "text", "owner"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, rows[0][2]), (2, "head end"), (None, passage), (3, ""), (3, "")], key=str)


def test_empty_table(spark):
    assert repeat_report(spark.createDataFrame([], SCHEMA)).collect() == []
