"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i gets the point u(i) = (i + 1) * G mod 2**31 of a golden-ratio sequence in integers (G / 2**31 is the inverse
golden ratio, G is odd, so a period has every point once). The cumulative weights cut the range of u into one
interval a source; the slot belongs to the source whose interval holds its point, and its rank among that source's
slots names the block it takes. Every prefix of the schedule is as close to the weights as such a sequence allows.

Each source is shuffled by a seeded hash of doc_id and cut into blocks of ``block_tokens`` tokens; a document belongs
to the block in which its first token falls, so the blocks hold equal numbers of tokens but for the documents across
their edges, and a longer document uses up the slots of the blocks it covers. The schedule ends when every source has
been through all its blocks once; a source that is through earlier starts again (``epoch`` counts), so no document is
lost and smaller sources repeat.

Weights: ``weights`` (source to number; a source that isn't in it or has 0 is not scheduled), or the sources' numbers
of blocks to the power ``alpha``. Shuffles are narrow; ranks and running sums are taken in two levels, within hash
buckets or slot chunks and over them, so that no task holds a whole source.

Defined results: a weight above 0 whose share is too small for one of the 2**31 points is an error; a null source is a source of its own; empty and null texts have 0 tokens and go with their
neighbours' block; rows that repeat a doc_id of one source are one document and stay together; null doc_ids too; an
empty table gives an empty schedule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK_TOKENS = 2048
ALPHA = 0.7
SEED = "mix-1"
GOLDEN, PERIOD_BITS = 1327217885, 31
BROADCAST_SIZE = 1_000_000
_CELL_BITS, _CHUNK_BITS = 21, 16
WORD = r"[^ \t\n\x0B\f\r]+"


def tokens(text) -> F.Column:
    """Number of runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def blocks(docs: DataFrame, block_tokens: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(key, doc_id, n_tokens, block) of each document, and (key, n_blocks) of each source."""
    each = docs.select(source_key(F.col("source")).alias("key"), F.col("doc_id"), tokens(F.col("text")).alias("t"))
    each = each.groupBy("key", "doc_id").agg(F.sum("t").alias("n_tokens"))
    each = each.withColumn("h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))).withColumn("bucket", F.substring("h", 1, 3))
    each = common.stored(each, "mix-docs")
    by = Window.partitionBy("key")
    sums = each.groupBy("key", "bucket").agg(F.sum("n_tokens").alias("s"))
    sums = sums.withColumn("offset", F.sum("s").over(by.orderBy("bucket")) - F.col("s")).withColumn("total", F.sum("s").over(by))
    sources = sums.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.max("total") / block_tokens)).alias("n_blocks"))
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id")
    placed = each.join(sums, ["key", "bucket"]).withColumn("before", F.col("offset") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    last = F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)) - 1
    placed = placed.select("key", "doc_id", "n_tokens", F.least(F.floor(F.col("before") / block_tokens), last).alias("block"))
    return placed, sources


def intervals(sources: DataFrame, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """(key, n_blocks, w, low, high): the share and the half-open interval of u of each source with a weight."""
    if weights is None:
        weighted = sources.withColumn("raw", F.pow("n_blocks", F.lit(alpha)))
    else:
        given = sources.sparkSession.createDataFrame([("=" + k, float(v)) for k, v in weights.items()] or [("", 0.0)], "key string, raw double")
        weighted = sources.join(given, "key").filter("raw > 0")
    order = Window.orderBy("key")  # one row a source
    weighted = weighted.withColumn("up", F.sum("raw").over(order)).withColumn("all", F.sum("raw").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    whole = F.lit(1 << PERIOD_BITS)
    last = F.lead("key").over(order).isNull()
    weighted = weighted.withColumn("high", F.when(last, whole).otherwise(F.floor(F.col("up") / F.col("all") * whole)))
    return weighted.select("key", "n_blocks", (F.col("raw") / F.col("all")).alias("w"), F.coalesce(F.lag("high").over(order), F.lit(0)).alias("low"), "high")


def slots(spans: DataFrame, n: int) -> DataFrame:
    """(slot, key, rank, n_blocks) of the first ``n`` slots."""
    spark = spans.sparkSession
    u = F.pmod((F.pmod(F.col("id"), F.lit(1 << PERIOD_BITS)) + 1) * F.lit(GOLDEN), F.lit(1 << PERIOD_BITS))
    points = spark.range(n).select(F.col("id").alias("slot"), u.alias("u")).withColumn("cell", F.shiftright("u", _CELL_BITS))
    cells = spans.filter("high > low").withColumn("cell", F.explode(F.sequence(F.shiftright("low", _CELL_BITS), F.shiftright(F.col("high") - 1, _CELL_BITS))))
    owned = points.join(cells, "cell").filter("u >= low AND u < high").select("slot", "key", "n_blocks", F.shiftright("slot", _CHUNK_BITS).alias("chunk"))
    counts = owned.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.select("key", "chunk", (F.sum("c").over(Window.partitionBy("key").orderBy("chunk")) - F.col("c")).alias("offset"))
    ranked = owned.join(counts, ["key", "chunk"]).withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1)
    return ranked.select("slot", "key", "rank", "n_blocks")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS, seed: str = SEED) -> DataFrame:
    """(slot, key, block, epoch, doc_id, n_tokens): one row each time a document comes."""
    placed, sources = blocks(docs, block_tokens, seed)
    spans = common.stored(intervals(sources, weights, alpha), "mix-spans")
    lost = [r["key"] for r in spans.filter("high <= low").select("key").orderBy("key").take(5)]
    if lost:
        raise ValueError(f"the shares of {lost} are below 2**-{PERIOD_BITS}")
    needed = spans.agg(F.count(F.lit(1)).alias("sources"), F.max(F.ceil(F.col("n_blocks") / F.col("w"))).alias("n")).first()
    n = (needed["n"] or 0) + 64
    while True:  # every source holds points, so each period of 2**31 slots brings it on
        planned = common.stored(slots(spans, n if needed["sources"] else 0), "mix-slots")
        full = planned.filter("rank = n_blocks - 1").agg(F.count(F.lit(1)).alias("sources"), F.max("slot").alias("last")).first()
        if full["sources"] == needed["sources"]:
            break
        n += n // 2
    taken = planned.filter(F.col("slot") <= (full["last"] if full["last"] is not None else -1))
    taken = taken.select("slot", "key", (F.col("rank") % F.col("n_blocks")).alias("block"), F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"))
    return placed.join(taken, ["key", "block"]).select("slot", "key", "block", "epoch", "doc_id", "n_tokens")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs``' rows in the order of the schedule, a row as often as it comes; columns unchanged. Texts are shuffled once, into their order, where the plan's rows can be broadcast, else to the plan too."""
    plan = schedule(docs, weights, alpha, block_tokens).groupBy("key", "doc_id").agg(F.collect_list("slot").alias("slots"))
    plan = common.stored(plan, "mix-plan")
    size = plan.agg((F.count(F.lit(1)) + F.sum(F.size("slots"))).alias("n")).first()["n"] or 0
    side = plan if size > BROADCAST_SIZE else F.broadcast(plan)
    rows = common.packed(docs).select("row", source_key(F.col("row.source")).alias("own_key"), F.col("row.doc_id").alias("own_id"))
    rows = rows.join(side, (F.col("own_key") == F.col("key")) & F.col("own_id").eqNullSafe(F.col("doc_id"))).select("row", F.explode("slots").alias("slot"))
    return rows.repartitionByRange("slot").sortWithinPartitions("slot").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = schedule(common.table(spark, sf_dir, "documents"))
    return plan.select("slot", F.when(F.col("key") != "null", F.expr("substring(key, 2)")).alias("source"), "block", "epoch", "doc_id", "n_tokens")


SQL = r"""
WITH each AS (SELECT coalesce('=' || source, 'null') AS key, doc_id, sum(coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0))::BIGINT AS n_tokens,
                     md5('mix-1:' || doc_id) AS h FROM documents GROUP BY 1, 2, 4),
placed AS (SELECT *, (sum(n_tokens) OVER (PARTITION BY key ORDER BY h, doc_id) - n_tokens)::BIGINT AS before,
                  greatest(1, ceil(sum(n_tokens) OVER (PARTITION BY key) / 2048))::BIGINT AS n_blocks FROM each),
sources AS (SELECT key, max(n_blocks) AS n_blocks, pow(max(n_blocks), 0.7) AS raw FROM placed GROUP BY key),
ups AS (SELECT *, sum(raw) OVER (ORDER BY key) AS up, sum(raw) OVER () AS whole, lead(key) OVER (ORDER BY key) IS NULL AS last FROM sources),
highs AS (SELECT *, CASE WHEN last THEN 2147483648 ELSE floor(up / whole * 2147483648)::BIGINT END AS high FROM ups),
spans AS (SELECT *, coalesce(lag(high) OVER (ORDER BY key), 0) AS low FROM highs),
points AS (SELECT i AS slot, ((i % 2147483648 + 1) * 1327217885) % 2147483648 AS u
           FROM (SELECT unnest(range((SELECT max(ceil(n_blocks / (raw / whole)))::BIGINT + 64 FROM spans))) AS i)),
ranked AS (SELECT slot, key, n_blocks, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM points JOIN spans ON u >= low AND u < high),
taken AS (SELECT slot, key, rank % n_blocks AS block, rank // n_blocks AS epoch FROM ranked
          WHERE slot <= (SELECT max(slot) FROM ranked WHERE rank = n_blocks - 1))
SELECT slot, CASE WHEN key <> 'null' THEN substr(key, 2) END AS source, block, epoch, doc_id, n_tokens
FROM taken JOIN (SELECT key, doc_id, n_tokens, least(before // 2048, n_blocks - 1) AS block FROM placed) USING (key, block)
"""
