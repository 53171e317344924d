"""The keyed store: relations in, relations out; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.schema import BOOKS


def create(spark: SparkSession, name: str = "books") -> None:
    """The table, unless it is there."""
    if not spark.catalog.tableExists(name):
        spark.createDataFrame([], BOOKS).write.format("parquet").saveAsTable(name)


def drop(spark: SparkSession, database: str) -> None:
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")


def refresh(spark: SparkSession, name: str = "books") -> DataFrame:
    """The table as it is stored now."""
    spark.catalog.refreshTable(name)
    return spark.table(name)


def scan(books: DataFrame) -> DataFrame:
    return books.orderBy("id")


def get(books: DataFrame, key: str) -> DataFrame:
    """The row of a key, or none."""
    return books.filter(F.col("id") == key)


def key_range(books: DataFrame, low: str | None = None, high: str | None = None, open_low: bool = False, open_high: bool = False, descending: bool = False) -> DataFrame:
    key = F.col("id")
    if low is not None:
        books = books.filter(key > low if open_low else key >= low)
    if high is not None:
        books = books.filter(key < high if open_high else key <= high)
    return books.orderBy(key.desc() if descending else key.asc())


def first_wins(books: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row a key: that with the lowest ordinal."""
    return books.groupBy("id").agg(F.min_by(_rest(books), ordinal).alias("row")).select("id", "row.*")


def last_wins(books: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row a key: that with the highest ordinal."""
    return books.groupBy("id").agg(F.max_by(_rest(books), ordinal).alias("row")).select("id", "row.*")


def _rest(books: DataFrame) -> Column:
    """All columns but the key."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in books.columns if c != "id"])


def insert_if_absent(books: DataFrame, added: DataFrame, ordinal: str | None = None) -> DataFrame:
    """``books`` and the rows of ``added`` whose key it lacks; stored rows stay as they are. With ``ordinal`` the first of ``added`` that share a key stays, else they must not share any."""
    added = first_wins(added, ordinal) if ordinal else added
    return books.unionByName(added.join(books.select("id"), "id", "left_anti"))


def insert(books: DataFrame, added: DataFrame) -> DataFrame:
    """``books`` and ``added``; a key that is stored already, or twice in ``added``, is an error."""
    if found := clashes(books, added).head(1):
        raise ValueError(f"the key {found[0]['id']} exists")
    return books.unionByName(added)


def upsert(books: DataFrame, changed: DataFrame, ordinal: str | None = None) -> DataFrame:
    """Rows of ``changed`` replace those of their keys or are added. With ``ordinal`` the last of ``changed`` that share a key counts, else they must not share any."""
    changed = last_wins(changed, ordinal) if ordinal else changed
    return books.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def clashes(books: DataFrame, added: DataFrame) -> DataFrame:
    """(id, stored, times) of the keys that ``insert`` refuses: stored already, or more than once in ``added``."""
    times = added.groupBy("id").agg(F.count(F.lit(1)).alias("times"))
    found = times.join(books.select("id").distinct().withColumn("stored", F.lit(True)), "id", "left")
    return found.select("id", F.coalesce("stored", F.lit(False)).alias("stored"), "times").filter("stored OR times > 1")


def delete(books: DataFrame, keys: DataFrame) -> DataFrame:
    return books.join(keys.select("id"), "id", "left_anti")
