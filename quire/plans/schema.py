"""Schemas of the engine's relations."""

from pyspark.sql import types as T

BOOKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("encoding", T.StringType()),
        T.StructField("create_time", T.TimestampType()),
        T.StructField("modify_time", T.TimestampType()),
    ]
)
BOOK_TEXT = "id string, text string"
CHAPTERS = "id string, chapter_no int, title string, start int, `end` int"
TITLES = "id string, title_id int, title string, section string"
PAGES = "id string, page_no int, title_id int, page_in_title int, start int, `end` int, text string"
