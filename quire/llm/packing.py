"""Best-fit packing of documents into bins of ``capacity`` tokens, after Martello-Toth dominance reduction.

Documents longer than a bin are cut into full bins and a rest. All that a packing depends on is how many pieces there
are of each size, at most ``capacity`` numbers, however large the corpus: the plan is made from these counts on the
driver, in runs of equal bins, and each piece then finds its place in it by the rank it has within its size. Ranks are
taken within hash buckets of a size, with the buckets' offsets added.

Reduction (Martello and Toth, sets of at most three): for the largest piece j and the largest piece l that fits beside it,
{j} is fixed if nothing fits; {j, l} if it fills the bin, if no two pieces fit beside j, or if no three fit and l is as
large as any two that fit; {j, l, m} if no three fit and no two pieces above m fit beside j. Such a set dominates
every other one that holds j, so some optimal packing has it. It repeats on what remains until nothing can be
fixed; best-fit decreasing packs the rest.

Defined results: each row is a document of its own, repeated ones too; a text without a word and a null text have one
row with 0 tokens and no bin; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .mixing import tokens

CAPACITY = 2048
BUCKETS = 64


class Plan:
    """Runs of placements: pieces of ``size`` with rank low <= r < high go, ``each`` to a bin, into bins from ``first`` on, at ``start``."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.bins = 0
        self.fixed = 0
        self.reduce()
        self.best_fit()

    def put(self, size: int, n: int, each: int, first: int, start: int) -> None:
        self.rows.append((size, self.rank[size], self.rank[size] + n, each, first, start))
        self.rank[size] += n
        self.left[size] -= n

    def fix(self, *sizes: int) -> None:
        """Fix as many bins with just these pieces as there are pieces for."""
        times = min(self.left[s] // sizes.count(s) for s in sizes)
        start = 0
        for s in dict.fromkeys(sizes):
            each = sizes.count(s)
            self.put(s, times * each, each, self.bins, start)
            start += s * each
        self.bins += times
        self.fixed += times

    def dominating(self, j: int, order: list[int]) -> tuple[int, ...] | None:
        """The fixed set for a piece of size j, if there is one; ``order``: all sizes left, ascending."""
        room = self.capacity - j

        def left(s: int, *used: int) -> int:
            return self.left[s] - (s == j) - used.count(s)

        def largest(most: int, *used: int) -> int:
            for k in range(bisect_right(order, most) - 1, -1, -1):
                if left(order[k], *used) > 0:
                    return order[k]
            return 0

        smallest: list[int] = []
        for s in order:
            smallest += [s] * min(3 - len(smallest), left(s))
            if len(smallest) == 3:
                break
        if not smallest or smallest[0] > room:
            return (j,)
        best = largest(room)
        if best == room or len(smallest) < 2 or sum(smallest[:2]) > room:
            return (j, best)
        if len(smallest) == 3 and sum(smallest) <= room:
            return None
        pair, a, b = 0, 0, len(order) - 1
        while a <= b:  # the largest sum of two that fit
            total = order[a] + order[b]
            if total > room or left(order[b]) < 1:
                b -= 1
            elif left(order[a], *([order[b]] if a == b else [])) < 1:
                a += 1
            else:
                pair = max(pair, total)
                a += 1
        if best >= pair:
            return (j, best)
        third = largest(room - best, best)
        if third:
            above: list[int] = []
            for s in order[bisect_right(order, third) :]:
                above += [s] * min(2 - len(above), left(s))
                if len(above) == 2:
                    break
            if len(above) < 2 or sum(above) > room:
                return (j, best, third)
        return None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            order = sorted(self.left)
            for j in reversed(order[:]):
                while self.left.get(j, 0) > 0 and (found := self.dominating(j, order)):
                    self.fix(*found)
                    changed = True
                    for s in set(found):
                        if not self.left[s]:
                            del self.left[s]
                            order.pop(bisect_left(order, s))

    def best_fit(self) -> None:
        free: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in free:
                    free[room] = []
                    insort(order, room)
                free[room].append((first, n))

        for size in sorted(self.left, reverse=True):
            while n := self.left[size]:
                k = bisect_left(order, size)
                if k < len(order):
                    room = order[k]
                    first, held = free[room].pop()
                    if not free[room]:
                        del free[room]
                        order.pop(k)
                else:
                    room, first, held = self.capacity, self.bins, -(-n // (self.capacity // size))
                    self.bins += held
                each = room // size
                full = min(held, n // each)
                start = self.capacity - room
                if full:
                    self.put(size, full * each, each, first, start)
                    add(room - each * size, first, full)
                rest = self.left[size]
                if full < held and rest and rest < each:
                    self.put(size, rest, rest, first + full, start)
                    add(room - rest * size, first + full, 1)
                    full += 1
                add(room, first + full, held - full)


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, n_tokens): every piece of every document."""
    counted = docs.select("doc_id", tokens(F.col("text")).alias("t"))
    last = F.greatest(F.lit(0), F.ceil(F.col("t") / capacity) - 1)
    cut = counted.select("doc_id", "t", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(capacity), F.col("t") - F.col("piece") * capacity).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n_tokens, bin, start) of every piece; start is where it begins in its bin."""
    spark = docs.sparkSession
    each = common.stored(pieces(docs, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)).cast("int")), "pieces")
    filled = each.filter("n_tokens > 0")
    counts = common.stored(filled.groupBy("n_tokens", "bucket").agg(F.count(F.lit(1)).alias("c")), "sizes")  # capacity x BUCKETS rows at most
    plan = Plan({r["n_tokens"]: r["c"] for r in counts.groupBy("n_tokens").agg(F.sum("c").alias("c")).collect()}, capacity)
    rows = spark.createDataFrame(plan.rows or [(0, 0, 0, 1, 0, 0)], "size int, low long, high long, each int, first long, at int")
    offsets = counts.select("n_tokens", "bucket", (F.sum("c").over(Window.partitionBy("n_tokens").orderBy("bucket")) - F.col("c")).alias("offset"))
    ranked = filled.join(offsets, ["n_tokens", "bucket"]).withColumn("r", F.col("offset") + F.row_number().over(Window.partitionBy("n_tokens", "bucket").orderBy("doc_id", "piece")) - 1)
    placed = ranked.join(F.broadcast(rows), (F.col("n_tokens") == F.col("size")) & (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high")))
    nth = F.col("r") - F.col("low")
    placed = placed.select("doc_id", "piece", "n_tokens", (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("bin"), (F.col("at") + nth % F.col("each") * F.col("size")).cast("int").alias("start"))
    empty = each.filter("n_tokens = 0").select("doc_id", "piece", "n_tokens", F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("start"))
    return placed.unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
