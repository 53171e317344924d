import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.operators import paginate as P

HAN, WORD = "汉", "字"
CASES = [
    (HAN * 100, 100, 200, [0, 20, 40, 60, 80]),
    ("a\nb\nc\nd", 100, 200, [0, 4]),
    (HAN * 10 + "\n" + HAN * 10, 100, 200, [0]),
    ("第1回" + HAN * 30 + "2" + WORD * 60, 100, 200, [0, 21, 42, 62, 82]),
    ("x" * 400, 100, 200, list(range(0, 400, 36))),
    ("hello", 40, 30, [0, 2, 4]),
    ("any", 29, 200, []),
    ("any", 100, 29, []),
    ("any", 35, 200, []),
    ("", 100, 200, []),
]


@pytest.mark.parametrize("text,height,width,starts", CASES)
def test_fixture(text, height, width, starts):
    pages = P.page_bounds(text, height, width)
    assert [s for s, _ in pages] == starts
    if pages:
        assert pages[-1][1] == len(text)


def test_latin_fixture():
    pages = P.page_bounds("alpha beta gamma delta " * 20, 100, 200)
    assert len(pages) == 15 and pages[:5] == [(0, 34), (34, 63), (63, 97), (97, 126), (126, 155)] and pages[-1] == (431, 460)


def test_mixed_text_ends():
    assert P.page_bounds(WORD * 10 + "a" + WORD * 40 + "b c" * 5, 40, 200)[-1][1] == 66


def slow(text, height, width):
    """The layout rules character by character."""
    per_line, lines, room = P.metrics(height, width)
    part = lambda c: ord(c) < 127 and bool(P.WORD_PART[ord(c)])
    size = lambda c: 2 if ord(c) > 0xFFFF else 1
    pages, at = [], 0
    while at < len(text) and room:
        begin, line, fill, left = at, 0, 0.0, room
        while line < lines and fill < room and at < len(text):
            c = text[at]
            if c == "\n":
                line, fill = line + 1, 0
            elif fill >= per_line:
                line, fill = line + 1, 0
                continue
            else:
                fill += 0.5625 if part(c) else size(c)
            at += 1
            left -= size(c)
        if at < len(text) and part(text[at]):
            lo, k = at, at
            while k > 0 and text[k - 1] != " ":
                k -= 1
                if part(text[k]):
                    lo = k
            hi = text.find(" ", at)
            hi = at if hi < 0 else hi
            if sum(map(size, text[lo:hi])) > left and lo > begin:
                at = lo
        pages.append((begin, at))
    return pages


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .,字\n😀-1", max_size=300), st.integers(20, 200), st.integers(20, 300))
def test_layout_is_total_contiguous_and_follows_the_rules(text, height, width):
    pages = P.page_bounds(text, height, width)
    assert pages == slow(text, height, width)
    if pages:
        assert pages[0][0] == 0 and pages[-1][1] == len(text)
        assert all(a[1] == b[0] for a, b in zip(pages, pages[1:])) and all(s < e for s, e in pages)


def test_pages_cover_their_sections(spark):
    rng = random.Random(5)
    rows = [(str(k), t, "t", "".join(rng.choice("ab 字\n") for _ in range(rng.randint(0, 400)))) for k in range(20) for t in range(3)]
    titles = spark.createDataFrame(rows, "id string, title_id int, title string, section string")
    pages = P.pages(titles, 100, 200).toPandas().sort_values(["id", "page_no"])
    joined = pages.groupby(["id", "title_id"]).text.apply("".join).to_dict()
    import re

    for i, t, _, s in rows:
        assert joined.get((i, t), "") == re.sub("\n+", "\n", s)
    for _, own in pages.groupby("id"):
        assert own.page_no.tolist() == list(range(len(own)))


def test_first_pages(spark):
    def of(counts):
        rows = [("b", t, k) for t, n in enumerate(counts) for k in range(n)]
        pages = P.numbered(spark.createDataFrame(rows, "id string, title_id int, page_in_title int"))
        return {r.title_id: (r.first_page, r.first_page_compat) for r in P.first_pages(pages).collect()}

    assert of([2, 1]) == {0: (0, 1), 1: (2, 2)}
    assert of([1, 2]) == {0: (0, 0), 1: (1, 1)}
    assert of([0, 2]) == {1: (0, 1)}


def test_step(spark):
    row = spark.range(1).select(P.step(F.lit(1), F.lit(9)).alias("a"), P.step(F.lit(8), F.lit(9)).alias("b"), P.step(F.lit(0), F.lit(9), False).alias("c")).first()
    assert tuple(row.a) == (0, 3) and tuple(row.b) == (6, 9) and tuple(row.c) == (0, 1)
