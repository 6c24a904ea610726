"""Pages cut into passages at their own structure; every passage is an exact slice of its page."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate, pairwise

from pyspark.sql import DataFrame, functions as F

#: Characters that a passage should not outgrow, and under which it isn't cut.
MOST, LEAST = 1500, 200
#: Fixed patterns of lines: headings in markup or bold, numbered steps, questions, rows of tables; and what no prose has.
HEADING = re.compile(r"#{1,6}\s+\S")
BOLD = re.compile(r"\*\*[^*]{2,90}\*\*:?$")
STEP = re.compile(r"\s*(?:step\s*[-:.]?\s*\d{1,2}\b|\d{1,2}\s*[).]\s+\S|\(\s*[ivx]{1,4}\s*\))", re.I)
QUESTION = re.compile(r"\s*(?:q\s*[-.:)]|\d{1,2}\s*\.\s*)?[^?\n]{10,140}\?\s*$", re.I)
ROW = re.compile(r"\s*\|.*\|\s*$")
JUNK = re.compile(r"\S{200}")
SCHEMA = "array<struct<start:int,end:int,heading:string>>"


#: Short lines that name what follows: a few words and a colon, or several words with a capital first and no end of a sentence.
TITLES = (
    re.compile(r"(?=.{4,90}\Z)(?:\S+\s+){0,11}\S*:\Z", re.S),
    re.compile(r"(?=.{1,90}\Z)[A-Z\u0A80-\u0AFF]\S*(?:\s+\S+){1,11}(?<![.!?,;])\Z", re.S),
)
MARKUP = re.compile(r"^(?:#{1,6}\s+)?(?:\*\*)?|:?(?:\*\*)?:?$")
NEVER = float("inf")


def opens(line: str, after: str) -> bool:
    """Whether a passage may begin at a line because of what the line is: marked, numbered, a question, or a title over a longer line."""
    bare = line.strip()
    return any(p.match(line) for p in (HEADING, BOLD, STEP, QUESTION)) or (len(after.strip()) > len(bare) and any(p.match(bare) for p in (*TITLES, BOLD)) and len(bare) <= 90)


def edges(page: str, most: int, least: int) -> tuple[list[tuple[int, float]], list[int], list[str]]:
    """Where a page can be cut, as (place, characters that the open passage must have), in order; and the places and texts of its headings.

    A table has no edge but its first line. A heading needs `least`, a blank line three fifths of `most`, any other line `most`; inside a line
    longer than that there is an edge every `most` characters that needs nothing.
    """
    lines = page.split("\n")
    starts = [0, *accumulate(len(line) + 1 for line in lines[:-1])]
    rows = [bool(ROW.match(line)) for line in lines]
    found: list[tuple[int, float]] = []
    places, texts = [], []
    for at, line, row, row_before, after in zip(starts, lines, rows, [False, *rows], [*lines[1:], ""], strict=False):
        if row and row_before:
            need = NEVER
        elif opens(line, after):
            found.append((at, least))
            places.append(at)
            texts.append(MARKUP.sub("", line).strip()[:120])
            continue
        else:
            need = most if line.strip() else 0.6 * most
        found.append((at, need))
        found += [(mark, 0) for mark in range(at + most, at + len(line), most)]
    return found, places, texts


def passages(page: str | None, most: int = MOST, least: int = LEAST) -> list[tuple[int, int, str | None]]:
    """(start, end, heading) of a page's passages; those with a token of 200 characters or more are left out.

    A passage's heading is the last one at or before its first letter. One that is too short joins the one before it,
    unless the two would be half as much again as a passage may be.
    """
    if not page or not page.strip():
        return []
    found, places, texts = edges(page, most, least)
    cuts = [0]
    for at, need in found:
        if at - cuts[-1] >= need and at > cuts[-1]:
            cuts.append(at)
    whole = [(a, b) for a, b in pairwise([*cuts, len(page)]) if page[a:b].strip()]
    kept: list[tuple[int, int]] = []  # the last first
    for a, b in reversed(whole):
        short = kept and len(page[kept[-1][0] : kept[-1][1]].strip()) < least and kept[-1][1] - kept[-1][0] + b - a <= 1.5 * most
        kept.append((a, kept.pop()[1] if short else b))

    def heading(start: int) -> str | None:
        first = start + len(page[start:]) - len(page[start:].lstrip())
        k = bisect_right(places, first)
        return texts[k - 1] if k else None

    return [(a, b, heading(a)) for a, b in reversed(kept) if not JUNK.search(page, a, b)]


def chunked(pages: DataFrame) -> DataFrame:
    """page_id, chunk_no, start, end, heading, text of pages(page_id, text): start and end count characters from 0, so text is text[start:end]."""

    @F.udf(SCHEMA, useArrow=False)  # rows go to Python by the hundred: a batch of Arrow holds ten thousand texts, however long
    def cut(text: str | None) -> list[tuple[int, int, str | None]]:
        return passages(text)

    held = pages.select("page_id", "text", F.posexplode(cut("text")).alias("chunk_no", "c"))
    return held.select("page_id", "chunk_no", "c.start", "c.end", "c.heading", F.substring("text", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("text"))


def at_share(lengths: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """n, most and, for each share q, the value at place floor(n * q) of the ascending values, by counts of equal values."""
    from pyspark.sql import Window

    counts = lengths.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("n"), F.max("v").alias("most"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.orderBy("v")))  # a row a length, not a row a passage
    rows = upto.crossJoin(F.broadcast(total))  # total is one row
    place = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col("v")))
    return rows.agg(F.max("n").alias("n"), F.max("most").alias("most"), *(place(q).alias(f"p{int(100 * q)}") for q in shares))
