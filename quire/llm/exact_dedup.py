"""Exact deduplication with a heavy-hitter split.

Every text gets its SHA-256 digest. Misra-Gries summaries of the digests, one a partition, are added up to find the
frequent ones; their winners (smallest doc_id) are verified by an exact count and broadcast, and the copies that lose
to them are removed on the map side. What remains, the winners included, is settled by one shuffle on the digest, in
which no digest is hot any more.

With ``counters`` k, every digest that more than 2 n / (k + 1) rows and twice as many rows as there are partitions
share is found; a frequent digest that is missed costs time and changes no result. At most k digests are broadcast.
All this is done on digests and ids. The texts meet its result last: the rows that lose are broadcast if they are
``BROADCAST_ROWS`` at most, else the texts are shuffled once to them.

Defined results: equal texts keep one row, that with the smallest doc_id (nulls last), and among equal doc_ids
the one whose columns, as JSON, come first; empty texts are equal to each other; a null text is no
copy of anything and always stays; an empty table gives an empty table; other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

COUNTERS = 512
BROADCAST_ROWS = 300_000


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> dict[bytes, int]:
    """One summary of all the batches' digests: counts of at most ``counters`` of them, each too low by n / (counters + 1) at most."""
    held: dict[bytes, int] = {}
    for batch in batches:
        for pair in pc.value_counts(batch.column(0).drop_null()).to_pylist():
            held[pair["values"]] = held.get(pair["values"], 0) + pair["counts"]
        if len(held) > counters:
            counts = np.fromiter(held.values(), np.int64, len(held))
            cut = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
            held = {k: v - cut for k, v in held.items() if v > cut}
    return held


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates for frequent digests in the column ``digest``, ``counters`` at most."""

    def summarise(batches):
        held = {k: v for k, v in misra_gries(batches, counters).items() if v > 1}
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["digest", "low"])

    found = digests.select("digest").mapInArrow(summarise, "digest binary, low long")
    return found.groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(counters).select("digest")


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, winner, copies) of the frequent digests that are truly repeated: exact minimum and count over all rows."""
    candidates = F.broadcast(frequent(digests, counters))
    return digests.join(candidates, "digest").groupBy("digest").agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def split(docs: DataFrame, counters: int) -> DataFrame:
    """(id, digest) of the rows without the copies that lose to a heavy digest's winner, and ``heavy_copies`` of heavy digests."""
    narrow = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), digest(F.col("text")).alias("digest"))
    narrow = common.stored(narrow, "digests")
    heavy = common.stored(heavy_winners(narrow, counters), "heavy").withColumnRenamed("digest", "heavy_digest")
    joined = narrow.join(F.broadcast(heavy), F.col("digest") == F.col("heavy_digest"), "left")
    kept = joined.filter(F.col("heavy_digest").isNull() | F.col("winner").isNull() | (F.col("id") <= F.col("winner")))
    return kept.select("id", "digest", F.col("copies").alias("heavy_copies"))


def decided(docs: DataFrame, counters: int) -> tuple[DataFrame, DataFrame]:
    """(digest, id) of the rows that lose, and of the winners that several rows share."""
    narrow = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("id"), digest(F.col("text")).alias("digest"))
    narrow = common.stored(narrow, "digests")
    heavy = F.broadcast(common.stored(heavy_winners(narrow, counters), "heavy").select(F.col("digest").alias("of"), "winner"))
    at = F.col("digest") == F.col("of")
    rest = narrow.join(heavy, at, "left_anti")
    firsts = rest.groupBy(F.col("digest").alias("of")).agg(F.min("id").alias("winner"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    judged = narrow.join(heavy, at).unionByName(rest.join(firsts, at))
    judged = common.stored(judged.groupBy("digest", "id", F.col("id").eqNullSafe(F.col("winner")).alias("wins")).agg(F.count(F.lit(1)).alias("n")), "judged")
    return judged.filter("NOT wins").select("digest", "id"), judged.filter("wins AND n > 1").select("digest", "id")


def dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` without its exact copies, columns unchanged."""
    lost, again = (x.toDF("of", "id") for x in decided(docs, counters))
    own = (F.col("digest") == F.col("of")) & F.col("row.doc_id").eqNullSafe(F.col("id"))
    side = lambda df: df if df.count() > BROADCAST_ROWS else F.broadcast(df)
    rows = docs.select(F.struct("*").alias("row"), digest(F.col("text")).alias("digest")).join(side(lost), own, "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    again = side(again)
    order = Window.partitionBy("digest").orderBy(F.to_json("row"))
    one = rows.join(again, own, "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1").select("row")
    return rows.join(again, own, "left_anti").select("row").unionByName(one).select("row.*")


def survivors(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """doc_id, digest (hex; null for a null text) and number of copies of every row that stays; texts aren't shuffled."""
    kept = split(docs, counters)
    settled = kept.groupBy("digest").agg(F.min("id").alias("doc_id"), F.coalesce(F.max("heavy_copies"), F.count(F.lit(1))).alias("copies"))
    textless = docs.filter("text IS NULL").select("doc_id", F.lit(None).cast("string").alias("digest"), F.lit(1).cast("long").alias("copies"))
    return settled.select("doc_id", F.lower(F.hex("digest")).alias("digest"), "copies").unionByName(textless)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(common.table(spark, sf_dir, "documents"))


SQL = """
SELECT min(doc_id) AS doc_id, sha256(text) AS digest, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, NULL, 1 FROM documents WHERE text IS NULL
"""
