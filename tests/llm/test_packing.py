import random
from collections import Counter, defaultdict
from functools import cache

from helpers import DATA
from pyspark.sql import functions as F

from quire.llm import packing


def bins_of(plan, items):
    bins, used = defaultdict(list), Counter()
    for size, low, high, each, first, at in plan.rows:
        assert used[size] == low
        for r in range(low, high):
            used[size] += 1
            bins[first + (r - low) // each].append((at + (r - low) % each * size, size))
    assert used == Counter(items) and sorted(bins) == list(range(plan.bins))
    for b in bins.values():
        b.sort()
        assert b[0][0] == 0 and all(x + s == y for (x, s), (y, _) in zip(b, b[1:])) and sum(b[-1]) <= plan.capacity
    return bins


def best_fit_decreasing(items, capacity):
    rooms = []
    for x in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def optimum(items, capacity):
    items = tuple(sorted(items, reverse=True))

    @cache
    def fits(k, rooms):
        if k == len(items):
            return True
        return any(fits(k + 1, tuple(sorted(rooms[:i] + (r - items[k],) + rooms[i + 1 :]))) for i, r in enumerate(rooms) if r >= items[k] and r not in rooms[:i])

    n = -(-sum(items) // capacity)
    while not fits(0, (capacity,) * n):
        n += 1
    return n


def test_plans_hold_every_piece_once_and_never_overflow():
    rng = random.Random(1)
    for trial in range(600):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) if trial % 3 else rng.randint(capacity // 5, capacity) for _ in range(rng.randint(1, 40))]
        bins_of(packing.Plan(Counter(items), capacity), items)


class Unreduced(packing.Plan):
    def reduce(self):
        pass


def test_without_reduction_it_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(300):
        items = [rng.randint(1, 30) for _ in range(rng.randint(1, 60))]
        plan = Unreduced(Counter(items), 30)
        bins_of(plan, items)
        assert plan.bins == best_fit_decreasing(items, 30)


class Reduced(packing.Plan):
    def best_fit(self):
        pass


def test_reduction_keeps_an_optimal_packing():
    rng = random.Random(3)
    fixed = 0
    for _ in range(250):
        capacity = rng.choice([10, 12, 15])
        items = [rng.randint(2, capacity) for _ in range(rng.randint(1, 10))]
        plan = Reduced(Counter(items), capacity)
        rest = [s for s, n in plan.left.items() for _ in range(n)]
        fixed += plan.bins
        assert plan.bins + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)
    assert fixed > 300


def test_full_table(spark):
    found = packing.query(spark, DATA).toPandas()
    words = {r.doc_id: r.n for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).alias("n")).collect()}
    assert found.groupby("doc_id").n_tokens.sum().to_dict() == words
    placed = found[found.bin.notna()].sort_values(["bin", "start"])
    for _, b in placed.groupby("bin"):
        assert b.start.tolist() == [0, *b.n_tokens.cumsum().tolist()[:-1]] and b.n_tokens.sum() <= packing.CAPACITY
    assert placed.bin.nunique() == placed.bin.max() + 1 <= 1.02 * -(-placed.n_tokens.sum() // packing.CAPACITY)


def test_edges(spark, nasty):
    found = packing.pack(nasty, 100).toPandas()
    assert (found.n_tokens == 0).sum() == 5 and found[found.n_tokens == 0].bin.isna().all()
    assert found.n_tokens.sum() == 15 * 4 + 120_000 * 2 + 1 + 2 + 15 + 14
    assert found[found.bin.notna()].groupby("bin").n_tokens.sum().max() <= 100
    assert packing.pack(nasty.limit(0)).count() == 0
