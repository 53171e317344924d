"""Ingest: bytes, character set, content key, insert if absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charset import decode_text, detect_encoding
from ..functions.text import last_segment
from ..operators.store import first_wins, insert_if_absent

#: The books a new library is seeded with: file, English, simplified and traditional title, author likewise, author's years.
SEED = [
    ("princekin/princekin.txt", ("The Prince", "小王子", "小王子"), ("Antoine de Saint-Exupéry", "安托万·德·圣埃克苏佩里", "安托萬·德·聖埃克蘇佩里"), "1900-1944"),
    ("camelXiangzi/camelXiangzi.txt", ("The Camel Xiangzi", "骆驼祥子", "骆驼祥子"), ("Shu Qingchun (Lao She)", "老舍（舒庆春）", "老舍（舒慶春）"), "1899-1966"),
    ("theThreeKingdoms/theThreeKingdoms.txt", ("The Three Kingdoms", "三国演义", "三國演義"), ("Luo Guanzhong", "罗贯中", "羅貫中"), "1330-1400"),
    ("theWealthOfNations/theWealthOfNations.txt", ("The Wealth of Nations", "国富论", "國富論"), ("Adam Smith", "亚当·斯密", "亞當·斯密"), "1723-1790"),
    ("TheHunchbackofNotre-Dame/TheHunchbackofNotre-Dame.txt", ("The Hunchback of Notre Dame", "巴黎圣母院", "巴黎聖母院"), ("Victor Hugo", "维克多·雨果", "維克多·雨果"), "1802-1885"),
    ("JaneEyre/JaneEyre.txt", ("Jane Eyre", "简爱", "簡愛"), ("Charlotte Brontë", "夏洛蒂·勃朗特", "夏洛蒂·勃朗特"), "1816-1855"),
    ("walden/walden.txt", ("Walden", "瓦尔登湖", "瓦爾登湖"), ("Henry David Thoreau", "亨利·戴维·梭罗", "亨利·戴維·梭羅"), "1817-1862"),
    ("snowWhite/snowWhite.txt", ("Snow White", "白雪公主", "白雪公主"), ("The Brothers Grimm", "格林兄弟", "格林兄弟"), "1789-1863"),
]
IMAGES = {"princekin/princekin.txt": "princekin/image.png"}
LOCALES = ("en", "zh-CN", "zh-HK")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, content) of the text files; the title is the file name with its extension."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", last_segment(F.col("path")).alias("title"), "content")


def seed_manifest(spark: SparkSession, locale: str = "en") -> DataFrame:
    """(ordinal, url, image, author, title, author_date) of the seed books."""
    k = LOCALES.index(locale)
    rows = [(n, url, IMAGES.get(url, ""), author[k], title[k], years) for n, (url, title, author, years) in enumerate(SEED)]
    return spark.createDataFrame(rows, "ordinal long, url string, image string, author string, title string, author_date string")


def from_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Contents of the manifest's books by file name."""
    return manifest.join(files.select(F.col("title").alias("file"), "content"), last_segment(F.col("url")) == F.col("file")).drop("file")


def key(content: Column) -> Column:
    return F.md5(content)


def prepared(added: DataFrame) -> DataFrame:
    """Rows of the books relation from (content, title, author?, image?, ordinal), keyed by content."""
    default = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c) if c in added.columns else F.lit("").alias(c)
    now = F.current_timestamp()
    return added.filter("content IS NOT NULL").select(key(F.col("content")).alias("id"), default("title"), default("author"), default("image"), "content", detect_encoding(F.col("content")).alias("encoding"), now.alias("create_time"), now.alias("modify_time"), "ordinal")


def add_books(books: DataFrame, added: DataFrame) -> DataFrame:
    """The library with new contents added; of equal contents the stored one stays, else the one with the lowest ordinal."""
    return insert_if_absent(books, first_wins(prepared(added)).drop("ordinal"))


def book_text(books: DataFrame) -> DataFrame:
    """``books`` with ``text``, decoded once by the stored encoding; null if that isn't known."""
    return books.withColumn("text", decode_text(F.col("content"), F.col("encoding"))).drop("content")
