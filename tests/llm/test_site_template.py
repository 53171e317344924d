from collections import Counter, defaultdict

from helpers import DATA
from pyspark.sql import functions as F

from quire.llm import site_template as s


def text(page, removed=frozenset()):
    return s.text_of(s.parse(page)[0], removed)[0]


def test_markup():
    assert text('<a href="x>y">t</a><br/>z<p>a<p>b') == "t\nz\na\nb"
    assert text("<ul><li>a<li>b</ul>c") == "a\nb\nc"
    assert text("<script>var t='</p>';<p></script><style>p{}</style><!-- no -->yes &amp; no") == "yes & no"
    assert text("<head><title>T</title><meta x></head><body>b") == "T\nb"
    assert text("</div>a</p><b>b") == "ab" and text("1 < 2 <") == "1 < 2 <" and text("<p") == "<p"
    assert text("<div>" * 3000 + "x") == "x"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text("<a " + '"' * 4001 + " <b>x</b>").endswith("x")
    for bad in ("<", "<!--", "<script>", "<a b='", "<a b='\"" * 500, "\x00<b>\x00</b>"):
        text(bad)


def test_head_left_open():
    assert text("<html><head><title>T</title><body><p>all content") == "T\nall content"
    assert text("<html><head><title>T</title><meta x><p>all<p>content") == "T\nall\ncontent"
    assert text("<head><title>T</title>all content") == "T\nall content" and text("<head><title>T<body>all") == "T\nall"
    assert text("<head><title>T</title><link x><style>p{}</style>\n</head>\n<body>b") == "T\nb"


def test_equal_subtrees_have_equal_hashes():
    h = lambda page: Counter(n.hash for n in s.parse(page)[1])
    assert h("<div class='a'>x  y</div>") == h("<div  class='a'>x y</div>")
    assert h("<div>a</div>") != h("<div>b</div>") and h("<i>a</i>") != h("<b>a</b>") and h("<b>a<i>b</i></b>") != h("<b>ab<i></i></b>")


def test_recurring_inline_elements_stay(spark):
    page = "<nav>menu</nav><hr><p>first {0}<br>second <b>Note</b> see <a>here</a></p>a{0}<nav>menu</nav>b<table><tr><td>0</td><td></td><td>x{0}</td></tr></table>"
    df = spark.createDataFrame([(k, "http://h.example/", page.format(k)) for k in range(8)], "page_id long, url string, html string")
    found = {r.page_id: (r.text, r.n_removed) for r in s.extract(df).select("row.page_id", "text", "n_removed").collect()}
    assert found == {k: (f"first {k}\nsecond Note see here\na{k}\nb\n0\nx{k}", 4) for k in range(8)}


def brute(pages, min_pages, min_share):
    """Page by page on the driver."""
    hosts, seen = Counter(), defaultdict(Counter)
    host = lambda url: url.split("//", 1)[1].split("/")[0].split("?")[0].split("#")[0].lower()
    for _, url, html in pages:
        hosts[host(url)] += 1
        seen[host(url)].update({n.hash for n in s.parse(html)[1]})
    out = {}
    for key, url, html in pages:
        h = host(url)
        out[key] = s.text_of(s.parse(html)[0], {x for x, n in seen[h].items() if n >= min_pages and n >= min_share * hosts[h]})
    return out


def test_against_brute_force(spark, monkeypatch):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    want = brute(pages, s.MIN_PAGES, s.MIN_SHARE)
    assert {r.page_id: (r.text, r.n_removed) for r in s.query(spark, DATA).collect()} == want
    monkeypatch.setattr(s, "BROADCAST_ROWS", -1)  # the joined way
    assert {r.page_id: (r.text, r.n_removed) for r in s.query(spark, DATA).collect()} == want
    assert any(n for _, n in want.values())


def test_edges(spark):
    frame = "<nav>menu</nav><p>own {}</p>"
    rows = [(k, "HTTP://User@Host.example:80/a", frame.format(k), "r", "h") for k in range(6)]
    rows += [(10, None, frame.format(1), None, None), (11, "no host", frame.format(1), None, None), (12, "http://host.example/", None, None, None), (13, "http://host.example/", "", None, None), (None, "http://host.example/", "<p>" + "x " * 500_000, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, row string, host string")
    found = {r.page_id: (r.host, r.text, r.n_removed) for r in s.extract(df).select("row.page_id", "host", "text", "n_removed").collect()}
    assert found[0] == ("host.example", "own 0", 1) and found[10] == (None, "menu\nown 1", 0) and found[11][2] == 0
    assert found[12][1:] == (None, 0) and found[13][1:] == (None, 0) and len(found[None][1]) == 999_999
    assert s.extract(df).columns == ["row", "host", "text", "n_removed"] and s.extract(df).select("row.*").columns == ["page_id", "url", "row", "host"]
    assert s.extract(df.limit(0)).count() == 0


def test_parsing_is_linear():
    import time

    for page in ("<h1>" * 100_000, "<span>" * 100_000 + "</b>" * 100_000, "<a " * 100_000, "<div>" * 200_000 + "x", "<p>" * 100_000, "<!-- " * 100_000, "<a '" * 50_000 + ">"):
        began = time.process_time()
        text(page)
        assert time.process_time() - began < 6, page[:9]


def test_what_no_bracket_closes():
    assert text("<p>a</p>b <!-- c") == "a\nb" and text("<p>a<!-- b > c") == "a" and text("<p>a<script> b > c") == "a" and text("a<!-- b --> c") == "a c" and text("x <y") == "x <y"


def test_copies_of_a_page_keep_their_text(spark):
    rows = [(k, "http://h.example/", "<div>only page</div>") for k in range(5)] + [(9, "http://h.example/2", "<div>other</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("a b.c", F.lit(1)).withColumn("d`e", F.lit(2))
    found = s.extract(df).select("row.*", "text", "n_removed").collect()
    assert {(r.page_id, r.text, r.n_removed, r["a b.c"], r["d`e"]) for r in found} == {(k, "only page", 0, 1, 2) for k in range(5)} | {(9, "other", 0, 1, 2)}


def test_against_another_parser(spark):
    """Well-formed pages: subtrees compared as strings, by the standard library's parser."""
    import random
    import xml.etree.ElementTree as ET

    rng = random.Random(3)

    def element(depth):
        inside = [rng.choice(["alpha", "beta", "gamma ", ""]) + (element(depth - 1) if depth and rng.random() < 0.7 else "") for _ in range(rng.randint(1, 3))]
        return (tag := rng.choice(["div", "section", "b", "nav"])) and f"<{tag}>{''.join(inside)}</{tag}>"

    common = [element(2) for _ in range(6)]
    pages = [(k, f"http://h{k % 2}.example/", "<html><body>" + "".join(rng.choice([rng.choice(common), element(2), f"own{k}"]) for _ in range(8)) + "</body></html>") for k in range(60)]
    blocks = {"div", "section", "nav", "html", "body"}
    seen, total = defaultdict(Counter), Counter(u for _, u, _ in pages)
    for _, url, html in pages:
        seen[url].update({ET.tostring(x) for x in ET.fromstring(html).iter() if x.tag in blocks - {"html"} and "".join(x.itertext()).strip() for x.tail in [None]})

    def lines(x, url):
        if x.tag in blocks - {"html"} and "".join(x.itertext()).strip():
            tail, x.tail = x.tail, None
            gone = seen[url][ET.tostring(x)] >= max(s.MIN_PAGES, s.MIN_SHARE * total[url])
            x.tail = tail
            if gone:
                return "\n"
        inner = (x.text or "") + "".join(lines(y, url) + (y.tail or "") for y in x)
        return f"\n{inner}\n" if x.tag in blocks else inner

    want = {k: "\n".join(y for x in lines(ET.fromstring(html), url).split("\n") if (y := " ".join(x.split()))) for k, url, html in pages}
    found = {r.page_id: r.text for r in s.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).select("row.page_id", "text").collect()}
    assert found == want and any(text(html) != want[k] for k, _, html in pages)
