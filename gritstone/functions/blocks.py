"""Blocks of lines in a page: lists under a grouping header, and numbered procedures.

A page is an array of lines. What a block is depends on the lines after its header, so one pass of
`aggregate` over the lines carries the open block as its state; nothing leaves the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .claims import let, stripped

# Headers of grouped lists with what they mean, lines that are never members, and limits.
HEADS = (
    (r"(?i)\b(any\s+one\s+of\s+the\s+following|any\s+of\s+the\s+following|one\s+of\s+the\s+following|either\s+of\s+the\s+following)\b", "ANY_OF", 1),
    (r"નીચેના\s*પૈકી\s*(?:કોઈ|કોઇ)?\s*એક|પૈકી\s*(?:કોઈ|કોઇ)\s*એક", "ANY_OF", 1),
    (r"(?i)\bany\s+two\s+of\s+the\s+following\b", "AT_LEAST_N", 2),
    (r"(?i)\bat\s+least\s+two\s+of\s+the\s+following\b", "AT_LEAST_N", 2),
    (r"(?i)\b(all\s+of\s+the\s+following|following\s+documents?\s+(?:are\s+)?(?:is\s+)?(?:required|to\s+be\s+submitted|should\s+be\s+submitted|must\s+be\s+submitted|are\s+needed))\b", "ALL_OF", 0),
    (r"જરૂરી\s*દસ્તાવેજો?\s*નીચે\s*મુજબ|નીચે\s*મુજબના\s*દસ્તાવેજો", "ALL_OF", 0),
)
NO_MEMBER = r"(?i)^(ans\s*:|answer\s*:|note\s*:|home|back|next|click here|read more|know more|online services|contact us|sitemap|disclaimer|[^A-Za-z0-9_]*$)"
LONGEST_HEAD, LONGEST_MEMBER, MOST_MEMBERS, LEAST_MEMBERS = 160, 120, 15, 2
#: Fixed: numbers of steps, questions and instructions.
_NAMED_STEP = r"(?i)^\s*(?:\*\*)?(?:step|stage|પગલું|તબક્કો)\s*[-:.]?\s*(\d{1,2})\b[).:\-\s]*"
_BARE_STEP = r"^\s*(?:\*\*)?\(?(\d{1,2})\)?\s*[).:\-]\s*(?![\d.])(?=\S)"
_QUESTION = r"(?i)\?|^(what|which|how|why|when|where|who|can|will|does|do|is|are|should|may|if)\b|^\d{1,2}[-/][A-Za-z0-9]{2,4}[-/]\d{2,4}\b"
PROCESS = r"(?i)\b(how\s+to\s+apply|application\s+process|procedure|process\s+flow|step[\s-]*by[\s-]*step|steps?\s+(to|for)\b|following\s+steps|below\s+steps|apply\s+online|registration\s+process|process\s+of\b)|પ્રક્રિયા"
INSTRUCTION = (
    r"(?i)\b(appl(y|ies)|submit|upload|fill|click|select|visit|login|log\s*in|register|registration|pay|download|print|attach|enter|choose|go\s+to|open|receive|collect|obtain|verify|scan|send|check|create|"
    r"generate|complete|sign|book|search|contact|bring|carry|provide|enclose|affix|deposit)\b|કરો|કરવી|જાઓ"
)
LEAST_STEPS, MOSTLY, LOOK_BACK, FARTHEST, SHORTEST_STEP, LONGEST_STEP = 3, 0.6, 8, 200, 8, 240


def _head(line: Column) -> Column:
    return reduce(lambda w, h: w.when(line.rlike(h[0]), F.struct(F.lit(h[1]).alias("mode"), F.lit(h[2]).alias("minimum"))), HEADS[1:], F.when(line.rlike(HEADS[0][0]), F.struct(F.lit(HEADS[0][1]).alias("mode"), F.lit(HEADS[0][2]).alias("minimum"))))


def _member(line: Column) -> Column:
    """A line without its bullet and number."""
    return stripped(F.regexp_replace(F.regexp_replace(line, r"^[\s•\-*·–—o]+", ""), r"(?i)^\(?[a-z0-9]{1,3}[).]\s*", ""))


def requirement_blocks(text: Column) -> Column:
    """array<struct(line_no, head, mode, minimum, members, evidence)> of a page's grouped lists, in page order.

    A header is a line of up to 160 characters with a grouping phrase. The lines below it are members until
    one is blank, longer than 120, around the list rather than in it or a header itself, at most 15; under two
    members there is no block. `evidence` is the slice of the page from header to last member, as printed.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    block = "struct<at:int,open:boolean,mode:string,minimum:int,members:array<string>>"

    def turn(blocks: Column, line: Column) -> Column:
        def follow(b: Column) -> Column:
            fits = b["open"] & line["listed"] & (F.size(b["members"]) < MOST_MEMBERS)
            return F.struct(b["at"].alias("at"), fits.alias("open"), b["mode"].alias("mode"), b["minimum"].alias("minimum"), F.when(fits, F.concat(b["members"], F.array(line["member"]))).otherwise(b["members"]).alias("members"))

        held = F.filter(F.transform(blocks, follow), lambda b: b["open"] | (F.size(b["members"]) >= LEAST_MEMBERS))
        begun = F.array(F.struct(line["at"].alias("at"), F.lit(True).alias("open"), line["head"]["mode"].alias("mode"), line["head"]["minimum"].alias("minimum"), F.array().cast("array<string>").alias("members")))
        return F.when(line["head"].isNotNull(), F.concat(held, begun)).otherwise(held)

    def listed(member: Column) -> Column:
        return (member != "") & (F.length(member) <= LONGEST_MEMBER) & ~member.rlike(NO_MEMBER) & _head(member).isNull()

    seen = F.transform(lines, lambda s, i: F.struct(i.alias("at"), F.when(F.length(s) <= LONGEST_HEAD, _head(s)).alias("head"), _member(s).alias("member"), listed(_member(s)).alias("listed")))
    found = F.filter(F.aggregate(seen, F.array().cast(f"array<{block}>"), turn), lambda b: F.size(b["members"]) >= LEAST_MEMBERS)
    slice_ = lambda b: F.slice(lines, b["at"] + 1, F.size(b["members"]) + 1)
    return F.transform(found, lambda b: F.struct(b["at"].alias("line_no"), stripped(F.get(lines, b["at"])).alias("head"), b["mode"].alias("mode"), b["minimum"].alias("minimum"), b["members"].alias("members"), stripped(F.array_join(slice_(b), "\n")).alias("evidence")))


def step_marker(text: Column) -> Column:
    """struct(n, explicit, rest) of a line that numbers itself as a step; null for others."""
    named, bare = r"(?i)^(?:step|stage|પગલું|તબક્કો)\s*[-:.]?\s*(\d{1,2})\b", r"^\(?(\d{1,2})\)?\s*[).:\-]\s*(?=\S)"

    def marked(line: Column) -> Column:
        mark = lambda p, explicit, rest: F.struct(F.regexp_extract(line, p, 1).cast("int").alias("n"), F.lit(explicit).alias("explicit"), rest.alias("rest"))
        after = F.regexp_replace(F.regexp_replace(line, named, ""), r"^[\s:.\-)]+", "")
        return F.when(line.rlike(named), mark(named, True, after)).when(line.rlike(bare), mark(bare, False, F.regexp_replace(line, bare, "")))

    return let(F.get(F.split(F.regexp_replace(text, r"^\s+", ""), "\n"), F.lit(0)), marked)


def is_question(text: Column) -> Column:
    """A question, or a dated row of a register."""
    return stripped(text).rlike(_QUESTION)


def step_label(text: Column) -> Column:
    return F.left(F.regexp_replace(stripped(F.regexp_replace(text, r"\s+", " ")), r"[.;:,]\s*$", ""), F.lit(90))


def page_steps(text: Column) -> Column:
    """array<struct(n, explicit, label, evidence)> of the first numbered procedure of a page; empty where it states none.

    A run begins at a line numbered 1 and takes the next numbers in turn, over lines without a number, up to 200 lines on; another
    number ends it. Of the runs with three steps or more, each step of 8 to 240 characters and none a question, the first
    one counts that reads as instructions: all of its steps, or three fifths of them under a heading (in the eight lines above)
    that speaks of a procedure.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    number = lambda s: F.coalesce(F.nullif(F.regexp_extract(s, _NAMED_STEP, 1), F.lit("")), F.nullif(F.regexp_extract(s, _BARE_STEP, 1), F.lit(""))).cast("int")
    body = lambda s: stripped(F.regexp_replace(F.regexp_replace(s, _NAMED_STEP, ""), _BARE_STEP, ""))
    marked = F.filter(F.transform(lines, lambda s, i: F.struct(i.alias("at"), F.when(stripped(s) != "", number(s)).alias("n"), s.alias("raw"))), lambda m: m["n"].isNotNull())
    step = lambda m: F.struct(m["n"].alias("n"), m["raw"].rlike(_NAMED_STEP).alias("explicit"), body(m["raw"]).alias("label"), stripped(m["raw"]).alias("evidence"))
    one = "struct<n:int,explicit:boolean,label:string,evidence:string>"
    run = f"struct<at:int,open:boolean,steps:array<{one}>>"

    # marked lines only: each extends every open run that it continues, ends those that it breaks, and may begin one
    def turn(runs: Column, m: Column) -> Column:
        def follow(r: Column) -> Column:
            near = m["at"] < r["at"] + FARTHEST
            fits = r["open"] & near & (m["n"] == F.size(r["steps"]) + 1)
            return F.struct(r["at"].alias("at"), fits.alias("open"), F.when(fits, F.concat(r["steps"], F.array(step(m)))).otherwise(r["steps"]).alias("steps"))

        held = F.filter(F.transform(runs, follow), lambda r: r["open"] | (F.size(r["steps"]) >= LEAST_STEPS))  # short runs that end can't count
        begun = F.array(F.struct(m["at"].alias("at"), F.lit(True).alias("open"), F.array(step(m)).alias("steps")))
        return F.when(m["n"] == 1, F.concat(held, begun)).otherwise(held)

    runs = F.aggregate(marked, F.array().cast(f"array<{run}>"), turn)

    def counts(r: Column) -> Column:
        labels = F.transform(r["steps"], lambda s: s["label"])
        share = F.size(F.filter(labels, lambda s: s.rlike(INSTRUCTION))) / F.size(labels)
        above = F.array_join(F.slice(lines, F.greatest(F.lit(1), r["at"] - LOOK_BACK + 1), F.least(F.lit(LOOK_BACK), r["at"])), " ")
        fair = F.forall(labels, lambda s: F.length(s).between(SHORTEST_STEP, LONGEST_STEP) & ~is_question(s))
        return (F.size(labels) >= LEAST_STEPS) & fair & F.when(above.rlike(PROCESS), share >= MOSTLY).otherwise(share == 1)

    return F.coalesce(F.get(F.filter(runs, counts), F.lit(0))["steps"], F.array().cast(f"array<{one}>"))


def ordered_steps(facts: DataFrame) -> DataFrame:
    """page_id, n, fact_id, label of the procedures that facts(page_id, fact_id, kind, claim, evidence) number themselves.

    A page's ACTION facts whose evidence begins with a step's number count if there are three or more, none is a question,
    their numbers are 1 to N without a gap, all are marked in one way, and three fifths of the first of each number (by
    fact_id) read as instructions. Evidence is read once; a number has two digits at most, so what is left of a page of any length after the partial aggregates is a hundred rows.
    """
    marked = facts.filter("kind = 'ACTION'").select("page_id", "fact_id", "claim", F.inline(F.array(F.struct(step_marker(F.col("evidence")).alias("m"))))).filter("m is not null")
    told = marked.select("page_id", "fact_id", "m.n", "m.explicit", stripped(F.coalesce(F.nullif(F.col("m.rest"), F.lit("")), F.col("claim"))).alias("label"))
    one = told.groupBy("page_id", "n").agg(F.count("*").alias("k"), F.bool_or(F.col("label").rlike(_QUESTION)).alias("asks"), F.bool_and("explicit").alias("all_named"), F.bool_or("explicit").alias("some_named"), F.min(F.struct("fact_id", "label")).alias("f"))
    page = Window.partitionBy("page_id")
    whole = {
        "k": F.sum("k"), "asks": F.bool_or("asks"), "all_named": F.bool_and("all_named"), "some_named": F.bool_or("some_named"), "steps": F.count("*"), "lo": F.min("n"), "hi": F.max("n"),
        "share": F.avg(F.col("f.label").rlike(INSTRUCTION).cast("int")),
    }
    run = one.select("page_id", "n", "f.fact_id", "f.label", *(v.over(page).alias(f"_{name}") for name, v in whole.items()))
    good = f"_k >= {LEAST_STEPS} and not _asks and _steps >= {LEAST_STEPS} and _lo = 1 and _hi = _steps and (_all_named or not _some_named) and _share >= {MOSTLY}"
    return run.filter(good).select("page_id", "n", "fact_id", "label")
