from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gritstone.functions import blocks as B, claims as C


def told(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").select("i", f(F.col("s")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_offices_of_sentences(spark):
    cases = {
        "The Lake Board office is located at Pier House B Wing": "Lake Board office",
        "Papers may be submitted at the Jan Seva Kendra Rivertown, ground floor": "Jan Seva Kendra Rivertown",
        "Submit to the office of the Water Collector at Block No. 3": "office of the Water Collector",
        "Head office of the Hill Corporation is situated in town": "Hill Corporation",
        "The Hill Council's address is 4 Lane": "Hill Council",
        "The contact information for the GRID site is at www": None,
        "It is at rest": None,
        "": None,
    }
    assert told(spark, C.office_of, [*cases, None]) == [*cases.values(), None]


def test_authorities_and_refusals(spark):
    passive = {
        "The seal will be issued by the Lake Labour Institute": ("ISSUED_BY", "Lake Labour Institute", False),
        "Forms are verified by the Mamlatdar within 3 days": ("VERIFIED_BY", "Mamlatdar", False),
        "Directorate of Markets and Roads is named; it is approved by the Directorate of Markets and Roads": ("VERIFIED_BY", "Directorate of Markets and Roads", False),
        "issued at a desk": (None, None, False),
        "It is issued by any one of the officers": (None, None, True),
        "It is attested by the Talati / Mamlatdar": (None, None, True),
        "It must be obtained from a prescribed officer": (None, None, True),
        "It is approved by Shri Vale Secretary": (None, None, True),
        "It is granted by the river": (None, None, True),
        "Lake Board issues the permit": (None, None, False),
    }

    def both(active):
        return lambda s: F.struct(C.authority_of(s, F.lit(active)).alias("a"), C.authority_refused(s, F.lit(active)).alias("r"))

    got = [(x.a and x.a.type, x.a and x.a.authority, x.r) for x in told(spark, both(False), [*passive, None])]
    assert got == [*passive.values(), (None, None, False)]
    active = {
        "Lake Board issues the permit": ("ISSUED_BY", "Lake Board", False),
        "The authority that grants or renews a licence issues the arms licence": (None, None, True),
        "The Registrar verifies every deed": ("VERIFIED_BY", "Registrar", False),
    }
    assert [(x.a and x.a.type, x.a and x.a.authority, x.r) for x in told(spark, both(True), [*active])] == [*active.values()]


def test_outputs(spark):
    cases = {
        "The applicant receives a 'Sanction Letter' and can claim help quarterly": ("Sanction Letter", False),
        "A dealer licence will be issued online": ("dealer licence", False),
        "On approval, a water passbook is generated": ("water passbook", False),
        "The applicant receives a confirmation": (None, True),
        "The applicant gets either the card or the letter": (None, True),
        "Assistance will be provided to the applicant": (None, True),
        "Nothing is said here": (None, False),
    }
    got = told(spark, lambda s: F.struct(C.output_of(s).alias("o"), C.output_refused(s).alias("r")), [*cases])
    assert [(x.o, x.r) for x in got] == [*cases.values()]


def test_office_names_stages_and_page_kinds(spark):
    rows = [({"name": "Dr. A Vale"}, "lake_office", "x"), ({"name": "Lake House"}, "form", "x"), ({}, "office_address", "The Lake Board is located at Pier"), ({}, None, "nothing")]
    got = spark.createDataFrame(rows, "d map<string,string>, o string, c string").select(C.office_name(F.col("d"), F.col("o"), F.col("c"), ["form"]).alias("n")).collect()
    assert [r.n for r in got] == ["lake_office", "Lake House", "Lake Board", None]
    rows = [("OUTPUT", "Visit us"), (None, "Visit the desk to track it"), (None, "Check the status"), ("ACTIONS", "Upload it"), (None, None)]
    got = spark.createDataFrame(rows, "d string, c string").select(C.stage_of(F.col("d"), F.col("c")).alias("s")).collect()
    assert [r.s for r in got] == ["AFTER_SUBMISSION", "IN_PERSON", "TRACK", "PREPARE", "APPLY"]
    assert told(spark, C.is_micro, [" Click 'go'", "Fill it", None]) == [True, False, False]
    rows = [("http://h/x.PDF", None, []), ("http://h", None, []), ("http://h/p", "FAQ", []), ("http://h/p", "x", ["OFFICE"] * 7 + ["APP"] * 3), ("http://h/p", "x", ["OFFICE"] * 6 + ["APP"] * 4), ("http://h/p", "x", [])]
    got = spark.createDataFrame(rows, "u string, t string, k array<string>").select(C.source_type(F.col("u"), F.col("t"), F.col("k")).alias("x")).collect()
    assert [r.x for r in got] == ["PDF", "PORTAL_HOME", "FAQ", "OFFICE_DIRECTORY", "SERVICE_PAGE", "SERVICE_PAGE"]


def test_requirement_blocks(spark):
    page = "\n".join(["Bring any one of the following:", " • Card A", "(b) Bill B", "", "Card C", "At least two of the following", "One", "next page", "all of the following", "x1", "x2", "Any two of the following", "y1", "y2", *[f"z{k}" for k in range(20)]])
    (got,) = told(spark, B.requirement_blocks, [page])
    assert [(b.line_no, b.mode, b.minimum, b.members) for b in got] == [
        (0, "ANY_OF", 1, ["Card A", "Bill B"]),
        (8, "ALL_OF", 0, ["x1", "x2"]),
        (11, "AT_LEAST_N", 2, ["y1", "y2", *[f"z{k}" for k in range(13)]]),
    ]
    assert got[0].evidence == "Bring any one of the following:\n • Card A\n(b) Bill B" and all(b.evidence in page for b in got)
    long = ["one of the following", "a" * 121, "b", "c"]
    assert told(spark, B.requirement_blocks, ["\n".join(long), "", None, "one of the following\nonly", "x" * 161 + " one of the following\na\nb"]) == [[]] * 5


def steps_by_hand(numbered):
    """Runs of (line, number) that begin with 1, by trying each."""
    runs = []
    for k, (at, n) in enumerate(numbered):
        if n == 1:
            run = [k]
            for j in range(k + 1, len(numbered)):
                if numbered[j][1] != len(run) + 1 or numbered[j][0] >= at + 200:
                    break
                run.append(j)
            runs.append(run)
    return runs


def test_page_steps(spark):
    rnd = random.Random(3)
    pages, wanted = [], []
    for _ in range(40):
        lines, numbered = [], []
        for _ in range(rnd.randrange(30)):
            n = rnd.choice([None, 1, 1, 2, 3, 4, len(numbered) and numbered[-1][1] + 1 or 1])
            if n:
                numbered.append((len(lines), n))
            lines.append(f"{n}. Submit the form now" if n else rnd.choice(["", "Some text", "1.2 Outline"]))
        pages.append("\n".join(lines))
        good = [r for r in steps_by_hand(numbered) if len(r) >= 3]
        wanted.append(len(good[0]) if good else 0)
    assert [len(x) for x in told(spark, B.page_steps, pages)] == wanted
    asks = "1. What is it for?\n2. Submit the form\n3. Pay the fee now"
    rules = "1. Roads are wide\n2. Submit the form\n3. Pay the fee now"
    assert [len(x) for x in told(spark, B.page_steps, [asks, rules, "Procedure\n" + rules, "Procedure\n" + "\n" * 9 + rules, None])] == [0, 0, 3, 0, 0]
    (x,) = told(spark, B.page_steps, ["Step 1: Fill the form;\nStage 2 - Pay the fee\nnote\n**Step 3. Collect the card"])
    assert [(s.n, s.explicit, s.label, s.evidence) for s in x] == [(1, True, "Fill the form;", "Step 1: Fill the form;"), (2, True, "Pay the fee", "Stage 2 - Pay the fee"), (3, True, "Collect the card", "**Step 3. Collect the card")]


@pytest.mark.parametrize(
    ("evidence", "steps"),
    [
        (["1) Pay fee", "2) Visit desk", "3) Collect card"], 3),
        (["1) Pay fee", "2) Visit desk", "4) Collect card"], 0),
        (["1) Pay fee", "Step 2: Visit desk", "3) Collect card"], 0),
        (["1) Pay fee", "2) What next", "3) Collect card"], 0),
        (["1) Roads", "2) Bridges", "3) Collect card"], 0),
        (["2) Visit desk", "1) Pay fee", "2) Visit again", "3) Collect card"], 3),
        (["1) Pay fee", "2) Visit desk"], 0),
    ],
)
def test_ordered_steps(spark, evidence, steps):
    facts = spark.createDataFrame([(1, k, "ACTION", "c", e) for k, e in enumerate(evidence)] + [(1, 99, "FEE", "c", "9) Pay")], "page_id int, fact_id int, kind string, claim string, evidence string")
    got = sorted(B.ordered_steps(facts).collect(), key=lambda r: r.n)
    assert len(got) == steps and [r.n for r in got] == list(range(1, steps + 1))
