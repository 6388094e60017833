"""Chapters of documents: title checks, tables of contents, page ranges and the split of a text by its headings."""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as T

#: Fixed patterns: titles of first-level chapters, titles that are none, marks of chapters and sections.
NUMBER = "零〇一二三四五六七八九十百千"
LEGAL = rf"^(第\s*[{NUMBER}\d]+\s*[章节篇部])|^(第\s*[{NUMBER}\d]+\s*[课讲])|^([零〇一二三四五六七八九十]+[、，,]\s*)|^(Chapter\s+\d+)|^(Part\s+\d+)|^(Section\s+\d+)|^(\d+[.、]\s+\w)"
NOISE = r"^[\d\s.\-+()\[\]f(t,z)图 Table Figure 表]+$|图\s*\d+|表\s*\d+|Fig|Table|^\d+\.\d+\.\d+|^[(（][\d一二三四五六七八九十]+[)）]"
MARK = rf"第[{NUMBER}\d]+[章童篇]|Chapter\s+\d+"
SECTION_MARK = MARK + r"|\d+\.\d+(?:\.\d+)?\s+\S"


def plausible(titles: DataFrame) -> DataFrame:
    """(doc, passed) of ``titles(doc, title)``: two or more, none blank or noise, and four of five as chapters are named."""
    t = T.strip(F.col("title"))
    noise = (t == "") | t.rlike("(?U)" + NOISE)
    legal = t.rlike("(?U)" + LEGAL).cast("int")
    return titles.groupBy("doc").agg(((F.count("*") >= 2) & ~F.bool_or(F.coalesce(noise, F.lit(True))) & (F.coalesce(F.avg(legal), F.lit(0.0)) >= 0.8)).alias("passed"))


def valid_only(chapters: DataFrame, review: DataFrame) -> DataFrame:
    """``chapters(doc, pos, ...)`` without those that the review ``(doc, pos, valid)`` refuses; what it does not name stays."""
    refused = review.where("not valid").select("doc", "pos").distinct()
    return chapters.join(refused, ["doc", "pos"], "left_anti")


def plain_title(title: Column) -> Column:
    return F.translate(title, "：: ", "")


def imported(chapters: DataFrame, known: DataFrame) -> DataFrame:
    """``chapters(title, ...)`` with ``imported``: whether a known title is the same but for colons and spaces."""
    have = known.select(plain_title(F.col("title")).alias("plain")).distinct().withColumn("imported", F.lit(True))
    return chapters.withColumn("plain", plain_title(F.col("title"))).join(have, "plain", "left").withColumn("imported", F.coalesce("imported", F.lit(False))).drop("plain")


def label_parts(label: Column) -> Column:
    """File and title of ``[file] title``; nulls where the label has another form."""
    part = lambda i: F.nullif(F.regexp_extract(label, r"^\[(.+?)\]\s+(.+)", i), F.lit(""))
    return F.struct(part(1).alias("file"), part(2).alias("title"))


def contents_lines(tables: DataFrame) -> DataFrame:
    """(doc, title, page) of the lines ``title | page`` of ``tables(doc, contents)``, and ``body_start`` where a line BODY_START names it."""
    body = F.try_to_number(F.nullif(F.regexp_extract("contents", r"BODY_START:\s*(\d+)", 1), F.lit("")), F.lit("999999")).cast("int")
    lines = tables.select("doc", body.alias("body_start"), F.posexplode(F.split("contents", "\n")).alias("at", "line"))
    row = r"^\s*(.+?)\s*\|\s*(\d+)\s*$"
    return lines.where(F.col("line").rlike(row)).select("doc", "at", "body_start", F.regexp_extract("line", row, 1).alias("title"), F.regexp_extract("line", row, 2).cast("int").alias("page"))


def page_ranges(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """Start and end page of each chapter: up to the page before the next one, the last up to ``totals(doc, pages)``.

    Printed pages are shifted by ``body_start`` less the first printed page.
    """
    w = Window.partitionBy("doc").orderBy("page", "at")
    first = F.min("page").over(Window.partitionBy("doc"))
    shift = F.coalesce(F.col("body_start") - first, F.lit(0))
    rows = lines.withColumn("shift", shift).withColumn("start", F.col("page") + F.col("shift")).withColumn("next", F.lead("page").over(w) + F.col("shift") - 1)
    return rows.join(totals, "doc").select("doc", "title", "start", F.greatest("start", F.coalesce("next", "pages")).alias("end"))


def outline(entries: DataFrame, limit: int) -> DataFrame:
    """Entries ``(doc, at, level, title, page)`` of level 1 up to page ``limit``, each title once; of a document without any, of all levels."""
    within = entries.where(F.col("page") <= limit)
    top = within.where("level = 1").select("doc").distinct()
    kept = within.where("level = 1").unionByName(within.join(top, "doc", "left_anti"))
    return kept.groupBy("doc", "title").agg(F.min_by(F.struct("at", "level", "page"), "at").alias("x")).select("doc", "title", "x.at", "x.level", "x.page")


GAP = r"[\s：:]+"
#: A letter of a script that parts its words by spaces.
LETTER = r"[^\W\d_一-鿿]"


class Marks:
    """Places of the chapter marks of one text, found once; asked how many lie around a place."""

    def __init__(self, text: str):
        self.at = [m.start() for m in re.finditer(MARK, text)]

    def crowded(self, place: int, reach: int = 200, most: int = 2) -> bool:
        """Whether more than ``most`` marks begin within ``reach`` characters, as in a table of contents."""
        return bisect_left(self.at, place + reach) - bisect_left(self.at, place - reach) > most


def forms(title: str, marker: str) -> tuple[list[str], list[str]]:
    """Patterns by which a heading may stand in a text, best first: marker and title as they are, with any gaps between their
    words, the number alone (a number ends where its digits do); and those of them that count inside a table of contents too.

    No form begins inside a word and no title ends inside one; a marker can, as it is cut from the opening of its chapter.
    """

    def closed(form: str, whole: bool = True) -> str:
        head = f"(?<!{LETTER})" if re.match(LETTER, form) else ""
        tail = r"(?!\d)" if form[-1].isdigit() else f"(?!{LETTER})" if whole and re.match(LETTER, form[-1]) else ""
        return head + form + tail

    both = [(marker, marker == title), (title, True)]
    exact = [closed(re.escape(x), whole) for x, whole in both if x]
    words = [([w for w in re.split(GAP, x) if w], whole) for x, whole in both]
    loose = [closed(GAP.join(map(re.escape, w)), whole) for w, whole in words if len(" ".join(w)) >= 6]
    number = re.match(rf"第[{NUMBER}\d]+(?=[章童篇])|Chapter\s+\d+", title)
    alone = [] if not number else [number[0] + "章"] if number[0][0] == "第" else [closed(re.escape(number[0]))]
    return exact + loose + alone, loose


def places(text: str, headings: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """(place, number of the heading) of all headings that the text has.

    Every heading takes the first place, outside of tables of contents, of the best form that has one; where there is none, as
    among very short chapters, the first place of a form with six characters or more. Forms are matched against the text
    itself, so a place does not depend on the white space before it.
    """
    marks, got = Marks(text), []
    for i, heading in enumerate(headings):
        best, anywhere = forms(*heading)
        free = (m.start() for form in best for m in re.finditer(form, text) if not marks.crowded(m.start()))
        rest = (m.start() for form in anywhere for m in re.finditer(form, text))
        at = next(free, next(rest, None))
        if at is not None:
            got.append((at, i))
    return got


def after_contents(text: str, run: int = 4, within: int = 300, least: int = 200) -> str:
    """The text without a table of contents at its head: marks of which every ``run`` begin within so many characters.

    The first mark that comes again begins the body; without one the body begins on the line after the last mark of the
    table. A body under ``least`` characters is none, and a text without a table stays as it is.
    """
    table = []
    for m in re.finditer(SECTION_MARK, text):
        if len(table) >= run - 1 and m.start() - table[1 - run].start() > within:
            break
        table.append(m)
    if len(table) < run or table[run - 1].start() > within:
        return text
    names = [re.sub(r"\s+", " ", m[0]) for m in table]
    again = next((m.start() for i, m in enumerate(table) if names[i] in names[:i]), None)
    line = text.find("\n", table[-1].end())
    body = text[again if again is not None else line if line >= 0 else len(text) :].strip()
    return body if len(body) >= least else text


def pieces(text: str | None, headings: list[tuple[str, str]], least: int = 20) -> list[tuple[int, int, str]]:
    """(position, number of the heading, text) of each chapter in the order of the text; a null text has none.

    Of headings at one place the first counts; chapters under ``least`` characters go. Headings with a title that are nowhere
    come last, with position -1 and no text.
    """
    text = text or ""
    headings = [((t or "").strip(), (m or "").strip()) for t, m in headings]
    found = places(text, headings)
    first = dict(reversed(found))
    ends = [*sorted(first), len(text)]
    cut = [(a, first[a], text[a:b].strip()) for a, b in zip(ends, ends[1:])]
    cut = [c for c in cut if len(c[2]) >= least]
    if cut:
        cut[0] = (*cut[0][:2], after_contents(cut[0][2]))
    missing = sorted({i for i, h in enumerate(headings) if h[0]} - {i for _, i in found})
    return cut + [(-1, i, "") for i in missing]


def _pieces(text: pd.Series, titles: pd.Series, markers: pd.Series) -> pd.Series:
    rows = zip(text, titles, markers, strict=True)
    return pd.Series([[{"position": p, "heading": h, "text": x} for p, h, x in pieces(t, [] if a is None else list(zip(a, b, strict=True)))] for t, a, b in rows], dtype=object)


def split(docs: DataFrame) -> DataFrame:
    """One row per chapter of ``docs(doc_id, text, headings)``: doc_id, place, position, title, marker, text.

    ``headings`` is an array of (title, marker). Titles are normalised; a blank one is named by its place. Nothing is shuffled,
    and rows of one doc_id need not be told apart; null headings are none, other columns are not carried.
    """
    h = F.col("headings")
    run = F.pandas_udf(_pieces, "array<struct<position: int, heading: int, text: string>>")
    cut = docs.select("doc_id", "headings", F.posexplode(run("text", h["title"], h["marker"])).alias("place", "x"))
    heading = F.get("headings", F.col("x.heading"))
    trimmed = cut.select("doc_id", "place", "x.position", T.strip(F.coalesce(heading["title"], F.lit(""))).alias("raw"), T.strip(F.coalesce(heading["marker"], F.lit(""))).alias("marker"), "x.text")
    title = T.normal_title(F.col("raw"))
    return trimmed.select("doc_id", "place", "position", F.when(title == "", F.concat(F.lit("章节"), F.col("place") + 1)).otherwise(title).alias("title"), "marker", "text")
