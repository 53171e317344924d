"""Greedy page layout of sections, and the indexes between pages and titles.

Layout is sequential within a section, since a word moved to the next page decides where that page begins, and
independent across sections: one Arrow-batched function gives each section's page bounds, without a shuffle. It works line
by line on running widths (sixteenths of a full-width character), not character by character.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import one_newline

FONT, LINE_HEIGHT, SPACING = 18.0, 40.0, 0.4
LEAST_SIDE = 30
HALF, FULL = 9, 16
WORD_PART = np.zeros(128, bool)
WORD_PART[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-.,!?;:'\"()[]{}"]] = True


def metrics(height: int, width: int) -> tuple[int, int, int]:
    """(characters a line, lines, characters a page); zeros below the least side."""
    if height < LEAST_SIDE or width < LEAST_SIDE:
        return 0, 0, 0
    per_line, lines = int(width // (FONT + SPACING)), int(height // LINE_HEIGHT)
    return per_line, lines, per_line * lines


def layout_metrics(height: Column, width: Column) -> Column:
    """The same as a struct of columns."""
    ok = (height >= LEAST_SIDE) & (width >= LEAST_SIDE)
    per_line = F.when(ok, F.floor(width / (FONT + SPACING))).otherwise(0).cast("int")
    lines = F.when(ok, F.floor(height / LINE_HEIGHT)).otherwise(0).cast("int")
    return F.struct(per_line.alias("chars_per_line"), lines.alias("total_line"), (per_line * lines).alias("page_total_char"))


def page_bounds(text: str, height: int, width: int) -> list[tuple[int, int]]:
    """[start, end) of each page of a section whose newlines are collapsed."""
    per_line, lines, per_page = metrics(height, width)
    total = len(text)
    if not total or not per_page:
        return []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    part = WORD_PART[np.minimum(codes, 127)] & (codes < 127)
    wide = codes > 0xFFFF
    width_of = np.where(part, HALF, np.where(wide, 2 * FULL, FULL))
    widths = np.concatenate([[0], np.cumsum(width_of)])
    units = np.concatenate([[0], np.cumsum(1 + wide)])
    parts = np.flatnonzero(part)
    room = per_line * FULL
    pages, at = [], 0
    newline = text.find("\n")
    while at < total:
        begin, line = at, 0
        while line < lines and at < total:
            full = int(np.searchsorted(widths, widths[at] + room))
            if 0 <= newline < at:
                newline = text.find("\n", at)
            if 0 <= newline < full or newline == full and lines > 1:
                at, line = newline + 1, line + 1
            else:
                at, line = min(full, total), line + 1
        if at < total and part[at]:
            word = text.rfind(" ", 0, at) + 1
            first = int(np.searchsorted(parts, word))
            word = min(int(parts[first]), at)
            end = max(text.find(" ", at), at)
            if units[end] - units[word] > per_page - (units[at] - units[begin]) and word > begin:
                at = word
                newline = text.find("\n", at)
        pages.append((begin, at))
    return pages


def bounds(section: Column, height: int, width: int) -> Column:
    @F.pandas_udf("array<struct<start:int,end:int>>")
    def laid(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e} for s, e in page_bounds(t or "", height, width)] for t in texts], dtype=object)

    return laid(section)


def pages(titles: DataFrame, height: int, width: int) -> DataFrame:
    """(id, page_no, title_id, page_in_title, start, end, text) of all sections; start and end are the section's own."""
    text = titles.select("id", "title_id", one_newline(F.col("section")).alias("section"))
    each = text.withColumn("b", bounds(F.col("section"), height, width)).select("id", "title_id", "section", F.posexplode_outer("b").alias("page_in_title", "b"))
    each = each.filter("page_in_title IS NOT NULL")  # the inner form would lay out again to test for empty lists
    cut = each.select("id", "title_id", "page_in_title", "b.start", "b.end", F.substring("section", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")).alias("text"))
    return numbered(cut)


def numbered(cut: DataFrame) -> DataFrame:
    """With the book-wide page_no, from 0."""
    return cut.withColumn("page_no", F.row_number().over(Window.partitionBy("id").orderBy("title_id", "page_in_title")) - 1)


def total_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("id").agg(F.count(F.lit(1)).alias("total_pages"))


def first_pages(pages: DataFrame) -> DataFrame:
    """(id, title_id, first_page, first_page_compat); the latter is 1 for a title of several pages that owns page 0."""
    first = pages.groupBy("id", "title_id").agg(F.min("page_no").alias("first_page"), F.count(F.lit(1)).alias("n"))
    compat = F.when((F.col("first_page") == 0) & (F.col("n") > 1), 1).otherwise(F.col("first_page"))
    return first.select("id", "title_id", "first_page", compat.alias("first_page_compat"))


def page_titles(pages: DataFrame, titles: DataFrame) -> DataFrame:
    return pages.join(titles.select("id", "title_id", "title"), ["id", "title_id"])


def contents(titles: DataFrame, pages: DataFrame) -> DataFrame:
    """Each title with its first page, null if it has none."""
    return titles.select("id", "title_id", "title").join(first_pages(pages), ["id", "title_id"], "left")


def linked_starts(pages: DataFrame) -> DataFrame:
    """``pages`` with each start set to the end of the page before in its section, the first to 0."""
    return pages.withColumn("start", F.lag("end", 1, 0).over(Window.partitionBy("id", "title_id").orderBy("page_in_title")))


def tree(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """One row a book: total_pages, page_text and page_title_id by page, titles by title_id, and first_page_of, title_id to first page."""
    by_page = pages.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("page_no", "title_id", "text"))).alias("p"))
    by_title = titles.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("title_id", "title"))).alias("t"))
    first = first_pages(pages).groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("title_id", "first_page_compat")))).alias("first_page_of"))
    found = by_title.join(by_page, "id", "left").join(first, "id", "left")
    return found.select("id", F.coalesce(F.size("p"), F.lit(0)).alias("total_pages"), F.col("p.text").alias("page_text"), F.col("p.title_id").alias("page_title_id"), F.col("t.title").alias("titles"), "first_page_of")


def spread(pages: DataFrame, page_no: int, desktop: bool = True) -> DataFrame:
    """The one or two pages in view."""
    return pages.filter(F.col("page_no").between(page_no, page_no + int(desktop)))


def step(page_no: Column, total: Column, desktop: bool = True) -> Column:
    """(back, forward): where the page buttons lead; forward may reach one blank page behind the last."""
    n = 2 if desktop else 1
    return F.struct(F.greatest(page_no - n, F.lit(0)).alias("back"), F.least(page_no + n, total).alias("forward"))
