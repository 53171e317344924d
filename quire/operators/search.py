"""Search over the library and inside books. Keywords are literals, never patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, sentences_with, without_markers


def usable(keyword: str | None) -> str | None:
    """The trimmed keyword, or none if nothing is left of it: then there is no search."""
    found = (keyword or "").strip("﻿ \t\n\r\f\v 　").strip()
    return found or None


def none(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def by_field(books: DataFrame, field: str, keyword: str) -> DataFrame:
    """Books whose title or author holds the keyword in any case, by key."""
    kw = usable(keyword)
    found = books.filter(F.contains(F.lower(field), F.lower(F.lit(kw)))) if kw else none(books)
    return found.orderBy("id")


def plain(text: Column) -> Column:
    """What content search looks at: no markers, lower case."""
    return F.lower(without_markers(text))


def by_content(texts: DataFrame, keyword: str) -> DataFrame:
    """Books (with ``text``) that hold the keyword in any case, and ``matched_text``, the sentences with it; a null text never matches."""
    kw = usable(keyword)
    base = texts.withColumn("_plain", plain(F.col("text")))
    found = base.filter(F.contains("_plain", F.lit((kw or "").lower()))) if kw else none(base)
    found = found.withColumn("matched_text", sentences_with(F.col("_plain"), (kw or "").lower())).drop("_plain")
    # an exchange of its own below the sort: the sort's sampling pass would find the sentences a second time
    return found.repartition("id").orderBy("id")


def counts(texts: DataFrame, keyword: str) -> DataFrame:
    """Hits by title, author and content in one scan."""
    kw = (usable(keyword) or "").lower()
    hit = lambda c: F.count(F.when(F.contains(c, F.lit(kw)) & F.lit(bool(kw)), 1))
    return texts.agg(hit(F.lower("title")).alias("title_hits"), hit(F.lower("author")).alias("author_hits"), hit(plain(F.col("text"))).alias("content_hits"))


def highlighted(text: Column, keyword: str) -> Column:
    """Array of (part, hit): the text split at the keyword (in its own case), the keyword between the parts."""
    parts = F.split(text, quoted(keyword), -1)
    made = F.transform(parts, lambda p, i: F.when(i == 0, F.array(F.struct(p.alias("part"), F.lit(False).alias("hit")))).otherwise(F.array(F.struct(F.lit(keyword).alias("part"), F.lit(True).alias("hit")), F.struct(p.alias("part"), F.lit(False).alias("hit")))))
    return F.flatten(made)


def in_book(pages: DataFrame, titles: DataFrame, keyword: str) -> DataFrame:
    """(id, title, first_page, hits) for each chapter title, not title_id; a hit is (page_no, seq, pre, value, next).

    The keyword counts in its own case; text behind its second occurrence in a sentence is left out.
    """
    kw = usable(keyword)
    found = pages.filter(F.contains("text", F.lit(kw))) if kw else none(pages)
    each = found.select("id", "title_id", "page_no", F.posexplode_outer(sentences_with(F.col("text"), kw or "")).alias("seq", "s")).filter("seq IS NOT NULL")
    hit = F.struct("page_no", "seq", F.split_part("s", F.lit(kw), F.lit(1)).alias("pre"), F.lit(kw).alias("value"), F.split_part("s", F.lit(kw), F.lit(2)).alias("next"))
    named = each.join(titles.select("id", "title_id", "title"), ["id", "title_id"])
    return named.groupBy("id", "title").agg(F.min("page_no").alias("first_page"), F.array_sort(F.collect_list(hit)).alias("hits"))
