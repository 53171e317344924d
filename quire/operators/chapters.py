"""Chapters by marker tags, and the heading detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CLOSE, OPEN, one_newline, quoted, trim, without_first_markers

NUMBERED = r"(?:第 [一二三四五六七八九十百千万]+章|(?:Chapter|CHAPTER)[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+[0-9]+|第[0-9]+ 章)[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*[^\n\r\x{2028}\x{2029}]+"
ROMAN = r"(?:[\t-\r ]|^)(I{1,3}|I?V|VI{1,3}|IX|XI{0,3}|XI?V|XVI{1,3}|XIX|XX)(?:[\t-\r ]|$)"


def _marked(start: str, end: str) -> str:
    return f"(?s){quoted(start)}(.*?){quoted(end)}"


def _running(lengths: Column) -> Column:
    """Sums of the array's first 1, 2, ... values."""
    zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
    return F.aggregate(lengths, zero, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["all"], acc["sum"] + x).alias("all")))["all"]


def _found(texts: DataFrame, start: str, end: str) -> DataFrame:
    """``texts`` with newlines collapsed and ``marks``, the chapters (title, start, end)."""
    rx = F.lit(_marked(start, end))
    base = texts.withColumn("text", one_newline(F.col("text")))
    base = base.withColumn("_marks", F.regexp_extract_all("text", rx, F.lit(0))).withColumn("_titles", F.regexp_extract_all("text", rx, F.lit(1)))
    base = base.withColumn("_gaps", F.transform(F.slice(F.split("text", _marked(start, end), -1), F.lit(1), F.size("_marks")), F.length))
    sums = _running(F.zip_with("_gaps", F.transform("_marks", F.length), lambda g, m: g + m))
    base = base.withColumn("_starts", F.zip_with(sums, "_marks", lambda s, m: s - F.length(m)))
    size = F.length("text")
    marks = F.transform(F.col("_titles"), lambda t, i: F.struct(trim(t).alias("title"), F.get("_starts", i).alias("start"), F.coalesce(F.get("_starts", i + 1), size).alias("end")))
    return base.withColumn("marks", marks).drop("_marks", "_titles", "_gaps", "_starts")


def _each(df: DataFrame, array: Column, pos: str, value: str, *keep: str) -> DataFrame:
    """The array's elements as rows. The outer form with a filter behind it: for the inner one the planner repeats the array's whole expression in a test for empty arrays."""
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def chapters(texts: DataFrame, start: str = OPEN, end: str = CLOSE) -> DataFrame:
    """(id, chapter_no, title, start, end) of each marked chapter; start is that of its opening tag."""
    return _each(_found(texts, start, end), F.col("marks"), "chapter_no", "m", "id").select("id", "chapter_no", "m.title", "m.start", "m.end")


def sections(texts: DataFrame, preface: str = "Preface", start: str = OPEN, end: str = CLOSE) -> DataFrame:
    """(id, title_id, title, section): a preface and the chapters, or the whole text under the book's title."""
    found = _found(texts, start, end)
    first = F.struct(F.lit(preface).alias("title"), F.lit(0).alias("start"), F.get("marks", F.lit(0))["start"].alias("end"))
    whole = F.struct(F.col("title"), F.lit(0).alias("start"), F.length("text").alias("end"))
    spans = F.when(F.size("marks") > 0, F.concat(F.array(first), "marks")).otherwise(F.array(whole))
    each = _each(found, spans, "title_id", "s", "id", "text")
    body = F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    return each.select("id", "title_id", "s.title", without_first_markers(body, start, end).alias("section"))


def _starts(pattern: str, found: Column) -> Column:
    """Offsets of the pattern's matches ``found``: the gaps before them are what a split at the pattern leaves."""
    gaps = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(found))
    sums = _running(F.zip_with(F.transform(gaps, F.length), F.transform(found, F.length), lambda g, m: g + m))
    return F.zip_with(sums, found, lambda s, m: s - F.length(m))


def _headings(texts: DataFrame, pattern: str, group: int) -> DataFrame:
    base = texts.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    base = base.withColumn("_starts", _starts(pattern, F.col("_found"))).withColumn("_size", F.length("text"))
    titles = F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    each = F.transform(titles, lambda t, i: F.struct(t.alias("heading"), F.get("_starts", i).alias("start"), F.coalesce(F.get("_starts", i + 1), F.col("_size")).alias("end")))
    return _each(base, each, "n", "h", "id").select("id", "n", "h.heading", "h.start", "h.end")


def numbered_headings(texts: DataFrame) -> DataFrame:
    """(id, n, heading, start) of Chinese-numbered and Chapter headings."""
    return _headings(texts, NUMBERED, 0).drop("end")


def roman_headings(texts: DataFrame) -> DataFrame:
    """(id, n, heading, start, end) of Roman numerals that stand alone; start is that of the white space before, end the next one's start or the text's end."""
    return _headings(texts, ROMAN, 1)
