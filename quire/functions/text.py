"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "<caption-title>", "</caption-title>"
SENTENCE = "[^。！？.!?\n]+[。！？.!?\n]*"
ROMAN = {"CM": 900, "CD": 400, "XC": 90, "XL": 40, "IX": 9, "IV": 4, "M": 1000, "D": 500, "C": 100, "L": 50, "X": 10, "V": 5, "I": 1}


def quoted(literal: str) -> str:
    """A regular expression that matches just ``literal``."""
    return "".join("\\" + c if not c.isalnum() and ord(c) < 128 and c != "\n" else c for c in literal)


def one_newline(text: Column) -> Column:
    """Each run of CR, LF or CRLF as one LF."""
    return F.regexp_replace(text, r"[\r\n]+", "\n")


def trim(value: Column) -> Column:
    """Without Unicode white space and byte-order marks at both ends; null as an empty string."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"(?U)^[\s﻿]+|[\s﻿]+$", ""), F.lit(""))


def without_markers(text: Column, start: str = OPEN, end: str = CLOSE) -> Column:
    """Without the opening tags, then without the closing ones; a regular expression of just a literal skips along the text."""
    return F.regexp_replace(F.regexp_replace(text, quoted(start), ""), quoted(end), "")


def without_first(text: Column, literal: str) -> Column:
    return F.concat_ws("", F.split(text, quoted(literal), 2))


def without_first_markers(text: Column, start: str = OPEN, end: str = CLOSE) -> Column:
    """Without the first opening and the first closing tag only."""
    return without_first(without_first(text, start), end)


def sentences_with(text: Column, keyword: str) -> Column:
    """Sentences (terminators kept) that hold the keyword; empty if it only spans a boundary."""
    return F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: F.contains(s, F.lit(keyword)))


def language(tag: Column) -> Column:
    """Interface language of a language tag: traditional or simplified Chinese, or English."""
    part = F.split(F.lower(tag), "-")
    traditional = F.coalesce(F.get(part, F.lit(1)).isin("tw", "hk", "mo"), F.lit(False))
    return F.when(F.get(part, F.lit(0)) == "zh", F.when(traditional, "zh-HK").otherwise("zh-CN")).otherwise("en")


def interpolate(template: Column, params: list) -> Column:
    """``{{n}}`` becomes params[n]; a placeholder without a parameter, or with an empty one, stays. One pass: what a value holds isn't replaced again."""
    text = F.coalesce(template, F.lit(""))
    names = F.regexp_extract_all(text, F.lit(r"\{\{(\w+)\}\}"), F.lit(1))
    gaps = F.split(text, r"\{\{\w+\}\}", -1)
    given = {str(n): str(v) for n, v in enumerate(params) if v is not None and v not in (0, "")}
    value = F.create_map(*[F.lit(x) for kv in given.items() for x in kv]) if given else F.lit(None).cast("map<string,string>")
    number = lambda name: F.when(name.rlike("^[0-9]+$"), F.regexp_replace(name, "^0+(?=.)", ""))
    made = F.transform(names, lambda name: F.coalesce(value[number(name)], F.concat(F.lit("{{"), name, F.lit("}}"))))
    return F.concat(F.element_at(gaps, 1), F.array_join(F.zip_with(made, F.slice(gaps, F.lit(2), F.size(made)), lambda m, g: F.concat(m, g)), ""))


#: Interface strings but for the seed books' (see the manifest): key to English, simplified and traditional Chinese.
STRINGS = {
    "search": ("Search", "搜索", "搜尋"),
    "ebook": ("E-book", "电子书", "電子書"),
    "search_result_1": ("The book with", "全文中提到", "全文中提到"),
    "search_result_2": ("is mentioned in the full text", "的书", "的書"),
    "search_result_3": (" · ", " · ", " · "),
    "no_result": ("No results", "无结果", "無結果"),
    "my_bookcase": ("My bookcase", "我的书架", "我的書架"),
    "home": ("Home", "首页", "首頁"),
    "previous_page": ("Previous page", "上一页", "上一頁"),
    "next_page": ("Next page", "下一页", "下一頁"),
    "preface": ("Preface", "前言", "前言"),
}
STRINGS_LOCALES = ("en", "zh-CN", "zh-HK")


def translated(key: Column, tag: Column, strings: dict[str, tuple[str, str, str]] = STRINGS) -> Column:
    """The string of a key in the interface language of a language tag; empty for a key that isn't there."""
    if not strings:
        return F.lit("")
    of = F.create_map(*[x for k, v in strings.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    place = F.array_position(F.array(*map(F.lit, STRINGS_LOCALES)), language(tag)).cast("int")
    return F.coalesce(F.get(of[key], place - 1), F.lit(""))


def roman_to_int(roman: Column) -> Column:
    """Sum of the numerals, pairs first, not validated; null stands for not a number."""
    tokens = F.regexp_extract_all(roman, F.lit("CM|CD|XC|XL|IX|IV|[MDCLXVI]"), F.lit(0))
    values = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    total = F.aggregate(tokens, F.lit(0), lambda acc, t: acc + values[t])
    return F.when(roman.rlike("^[MDCLXVI]*$"), total)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_word_part(char: Column) -> Column:
    """ASCII word character or one of the half-width punctuation marks that stick to words."""
    return char.rlike(r"""^[A-Za-z0-9_\-.,!?;:'"()\[\]{}]$""")
