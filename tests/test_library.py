import pyarrow as pa
import pytest
from helpers import oracle, rows
from pyspark.sql import functions as F

from quire.functions import charset, text
from quire.operators import chapters, search, store
from quire.plans.queries import ORACLES, QUERIES
from quire.plans.schema import BOOKS
from quire.sources import ingest

S, E = text.OPEN, text.CLOSE


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_scalars(spark):
    assert one(spark, "　﻿ a\t\xa0b \r\n", text.trim) == "a\t\xa0b" and one(spark, None, text.trim) == ""
    assert one(spark, "a\r\n\r\nb\rc\n\n\nd", text.one_newline) == "a\nb\nc\nd"
    assert [one(spark, x, text.language) for x in ("zh-TW", "zh-hk", "zh", "zh-Hant-TW", "en-US", "fr")] == ["zh-HK", "zh-HK", "zh-CN", "zh-CN", "en", "en"]
    assert [one(spark, x, text.roman_to_int) for x in ("XIV", "MCMXCIV", "IIX", "", "ix")] == [14, 1994, 10, 0, None]
    assert one(spark, "a{{0}}b", lambda c: text.interpolate(c, ["x"])) == "axb"
    assert one(spark, "a{{0}}b{{name}}", lambda c: text.interpolate(c, [0])) == "a{{0}}b{{name}}"
    assert one(spark, S + S + "a" + E + E, text.without_first_markers) == S + "a" + E
    assert one(spark, "a/b/c.txt", text.last_segment) == "c.txt"


def test_strings(spark):
    assert one(spark, "{{0}} {{1}}", lambda c: text.interpolate(c, ["{{1}}", "x"])) == "{{1}} x"
    assert one(spark, "{{01}}{{ 0}}{{0}}", lambda c: text.interpolate(c, ["a$1", "b"])) == "b{{ 0}}a$1" and one(spark, None, lambda c: text.interpolate(c, ["a"])) == ""
    for tag, want in (("zh-hk", "首頁"), ("zh", "首页"), ("fr", "Home")):
        assert one(spark, "home", lambda c: text.translated(c, F.lit(tag))) == want  # noqa: B023
    assert one(spark, "no-key", lambda c: text.translated(c, F.lit("en"))) == "" and one(spark, None, lambda c: text.translated(c, F.lit("en"))) == ""


def test_batches_with_a_key_twice(spark):
    base, batch = spark.createDataFrame([("a", 0, 0)], "id string, `v.w` int, n int"), spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 3, 1), ("b", 4, 2)], "id string, `v.w` int, n int")
    assert {tuple(r) for r in store.upsert(base, batch, "n").collect()} == {("a", 2, 2), ("b", 4, 2)}
    assert {tuple(r) for r in store.insert_if_absent(base, batch, "n").collect()} == {("a", 0, 0), ("b", 3, 1)}
    assert {tuple(r) for r in store.clashes(base, batch).collect()} == {("a", True, 2), ("b", False, 2)}


def test_valid_utf8_stays_on_the_jvm(spark):
    rows = [(b"\xef\xbb\xbfh\xc3\xa9", "UTF-8 "), (b"", None), (None, "utf-8"), ("汉字汉字我们的".encode("gb18030"), "gbk"), (b"a\xffb", "utf-8"), (b"abc", "no-such-set"), (b"\xff\xfea\x00", "utf-16le")]
    df = spark.createDataFrame([(bytearray(c) if c is not None else None, e) for c, e in rows], "content binary, encoding string")
    assert [r[0] for r in df.select(charset.decode_text(F.col("content"), F.col("encoding"))).collect()] == ["hé", "", None, "汉字汉字我们的", "a\ufffdb", None, "a"]
    got = df.select(charset.detect_decode(F.col("content")).alias("d"), charset.detect_encoding(F.col("content")).alias("e")).select("d.*", "e").collect()
    assert [r.e for r in got] == ["utf-8", "utf-8", None, "gb18030", "windows-1252", "utf-8", "utf-16le"] and [r.text for r in got] == ["hé", "", None, "汉字汉字我们的", "aÿb", "abc", "a"]
    assert all(r.e == r.encoding for r in got)


def test_decoding():
    assert charset.decode_bytes(b"\xef\xbb\xbfabc", "utf-8") == "abc"
    assert charset.decode_bytes("汉字".encode("gb18030"), "gb2312") == "汉字"
    assert charset.decode_bytes("漢字".encode("big5"), "Big5") == "漢字"
    assert charset.decode_bytes(b"caf\xe9 \x93x\x94", "iso-8859-1") == "café “x”"
    assert charset.decode_bytes(b"a\xffb", "utf-8") == "a�b"
    assert charset.decode_bytes(b"a", "no-such-set") is None and charset.decode_bytes(None, "utf-8") is None


def test_detection():
    assert charset.detect_bytes("我们今天去公园看书，天气很好。".encode("gb18030")) == "gb18030"
    assert charset.detect_bytes("我們今天去公園看書，天氣很好。".encode("big5")) == "big5"
    assert charset.detect_bytes("Ça déjà été à l'hôtel près d'ici".encode("cp1252")) == "windows-1252"
    assert charset.detect_bytes("Ça".encode()) == "utf-8" and charset.detect_bytes(b"") == "utf-8"


def test_store(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    values = lambda df: {r.id: r.v for r in df.collect()}
    assert values(store.insert_if_absent(base, new)) == {"a": 1, "b": 2, "c": 3}
    assert values(store.upsert(base, new)) == {"a": 1, "b": 9, "c": 3}
    assert values(store.delete(base, spark.createDataFrame([("a",), ("zz",)], "id string"))) == {"b": 2}
    assert values(store.get(base, "nope")) == {}
    assert [r.id for r in store.key_range(base, "a", open_low=True).collect()] == ["b"]
    assert [r.id for r in store.key_range(base, descending=True).collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        store.insert(base, new)
    with pytest.raises(ValueError):
        store.insert(base, new.union(new).filter("id = 'c'"))
    assert values(store.insert(base, new.filter("id = 'c'"))) == {"a": 1, "b": 2, "c": 3}


def test_create_and_drop(spark, tmp_path):
    spark.sql(f"CREATE DATABASE quire_t LOCATION '{tmp_path}/db'")
    store.create(spark, "quire_t.books")
    store.create(spark, "quire_t.books")
    assert spark.table("quire_t.books").columns == BOOKS.fieldNames()
    store.drop(spark, "quire_t")
    assert not spark.catalog.databaseExists("quire_t")


def test_ingest_is_idempotent_and_first_wins(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes("héllo".encode())
    (tmp_path / "two.txt").write_bytes("héllo".encode())
    (tmp_path / "three.txt").write_bytes("汉字汉字我们的".encode("gb18030"))
    files = ingest.read_files(spark, str(tmp_path)).withColumn("ordinal", F.when(F.col("title") == "two.txt", 0).otherwise(1))
    empty = spark.createDataFrame([], BOOKS)
    once = ingest.add_books(empty, files)
    assert {(r.title, r.encoding) for r in once.collect()} == {("two.txt", "utf-8"), ("three.txt", "gb18030")}
    stored = spark.createDataFrame(once.collect(), BOOKS)
    assert ingest.add_books(stored, files.withColumn("title", F.lit("other"))).filter("title = 'other'").count() == 0
    assert {r.text for r in ingest.book_text(stored).collect()} == {"héllo", "汉字汉字我们的"}


def test_manifest(spark, tmp_path):
    assert ingest.seed_manifest(spark, "zh-HK").filter("title = '簡愛'").count() == 1
    (tmp_path / "walden.txt").write_text("woods")
    found = ingest.from_manifest(ingest.seed_manifest(spark), ingest.read_files(spark, str(tmp_path)))
    assert [r.title for r in ingest.add_books(spark.createDataFrame([], BOOKS), found).collect()] == ["Walden"]


def test_stream(spark, tmp_path):
    from quire.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text(f"text {k % 2}")
        watch(spark, str(tmp_path / "in"), str(tmp_path / "lib"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "lib")).count() == 2


def texts(spark, *rows):
    return spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "id string, title string, author string, text string")


def test_search(spark):
    books = texts(spark, ("Jane Eyre", "Brontë", "One rain. Two 100% rains!"), (None, None, None), ("50%", "x", f"a{S}b{E} Rain"))
    assert [r.id for r in search.by_field(books, "title", " JANE ").collect()] == ["0"]
    assert [r.id for r in search.by_field(books, "title", "%").collect()] == ["2"]
    assert search.by_field(books, "title", " 　").count() == 0 and search.by_content(books, "").count() == 0
    found = {r.id: r.matched_text for r in search.by_content(books, "RAIN").collect()}
    assert found == {"0": ["one rain.", " two 100% rains!"], "2": ["ab rain"]}
    assert {r.id: r.matched_text for r in search.by_content(books, "rain. two").collect()} == {"0": []}
    assert tuple(search.counts(books, "x").first()) == (0, 1, 0)
    parts = books.filter("id = 0").select(search.highlighted(F.col("title"), "Jane")).first()[0]
    assert [(p.part, p.hit) for p in parts] == [("", False), ("Jane", True), (" Eyre", False)]
    assert [(p.part, p.hit) for p in books.filter("id = 0").select(search.highlighted(F.col("title"), "JANE")).first()[0]] == [("Jane Eyre", False)]


def test_in_book(spark):
    pages = spark.createDataFrame([("b", 0, 0, "1x2x3. no"), ("b", 1, 1, "Xx"), ("b", 2, 2, "x.")], "id string, page_no int, title_id int, text string")
    titles = spark.createDataFrame([("b", 0, "A"), ("b", 1, "B"), ("b", 2, "A")], "id string, title_id int, title string")
    found = {r.title: (r.first_page, [(h.page_no, h.pre, h.next) for h in r.hits]) for r in search.in_book(pages, titles, "x").collect()}
    assert found == {"A": (0, [(0, "1", "2"), (2, "", ".")]), "B": (1, [(1, "X", "")])}


def test_sections(spark):
    made = {}
    books = texts(spark, ("T", "", "abc"), ("T", "", f"pre{S} A {E}xx{S}B{E}yy"), ("T", "", f"{S}A{E}x"), ("T", "", f"{S}A"), ("T", "", None))
    for r in chapters.sections(books).collect():
        made.setdefault(r.id, {})[r.title_id] = (r.title, r.section)
    assert made == {"0": {0: ("T", "abc")}, "1": {0: ("Preface", "pre"), 1: ("A", " A xx"), 2: ("B", "Byy")}, "2": {0: ("Preface", ""), 1: ("A", "Ax")}, "3": {0: ("T", "A")}, "4": {0: ("T", "")}} or made["4"] == {0: ("T", None)}
    assert [(r.start, r.end) for r in chapters.chapters(books.filter("id = 1")).collect()] == [(3, 39), (39, 73)]


def test_dispatch(spark):
    from quire.operators.dispatch import perform

    books = texts(spark, ("A", "x", "rain"), ("B", "y", "sun"))
    assert [r.id for r in perform("getAll", books).collect()] == ["0", "1"]
    assert [r.id for r in perform("search", books, keyword="RAIN", search_type="content").collect()] == ["0"]
    for bad in (lambda: perform("nope", books), lambda: perform("search", books, keyword="a", search_type="nope")):
        with pytest.raises(ValueError):
            bad()


def test_debounced_stream(spark, tmp_path):
    from quire.streaming.debounce import debounced

    rows = [(1, 0.0, "a"), (1, 0.3, "ab"), (1, 2.0, "abc"), (2, 0.1, "z"), (9, 60.0, "later")]
    df = spark.createDataFrame(rows, "user long, s double, v string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "user", "ts", "v", watermark="1 second")
    q = stream.writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.user, r.v) for r in spark.table("debounced").collect()) == [(1, "ab"), (1, "abc"), (2, "z")]


def test_transform_text_query_keeps_empty_and_marked_texts(spark, tmp_path):
    rows_ = [(1, "abc"), (2, ""), (3, None), (4, "\ufeffabc"), (5, "\ufeff"), (6, "\ufeff\ufeff汉")]
    spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows(QUERIES["transform_text"](spark, str(tmp_path)).toPandas()) == rows(oracle(ORACLES["transform_text"], tmp_path))


def test_python_decodes_a_batch_in_pieces():
    """A batch of 10,000 rows isn't taken into Python values as a whole."""
    held, values = [], [b"\xff\xfe" + f"{k}".encode("utf-16-le") * 50_000 for k in range(60)] + [None]

    def decoded(taken):
        taken = list(taken)
        held.append(sum(len(d or b"") for d, _ in taken))
        return [charset.decode_bytes(d, x) for d, x in taken]

    batch = (pa.array(values, pa.binary()), pa.array(["utf-16le"] * 61))
    found = list(charset._pieces(decoded, pa.string())(iter([batch, (batch[0].slice(0, 0), batch[1].slice(0, 0))])))
    assert found[0].to_pylist() == [f"{k}" * 50_000 for k in range(60)] + [None] and len(found[1]) == 0
    assert len(held) > 6 and max(held) <= charset.PIECE + max(len(v) for v in values[:-1])
