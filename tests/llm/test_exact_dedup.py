import pyarrow as pa
from collections import Counter

import numpy as np

from quire.llm import exact_dedup as e


def test_misra_gries_bound():
    rng = np.random.default_rng(0)
    stream = [b"%d" % (x if rng.random() < 0.5 else rng.integers(10**6)) for x in rng.zipf(1.5, 20_000) % 50]
    batches = [pa.RecordBatch.from_arrays([pa.array(stream[i : i + 700], pa.binary())], names=["d"]) for i in range(0, len(stream), 700)]
    held, truth = e.misra_gries(iter(batches), 40), Counter(stream)
    assert len(held) <= 40
    for k, n in truth.items():
        assert n - len(stream) / 41 <= held.get(k, 0) <= n


def test_heavy_split_changes_nothing(spark):
    rows = [(k, f"t{k % 7 if k % 2 else k}", None) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    want = {}
    for k, t, _ in rows:
        want.setdefault(t, []).append(k)
    for counters in (1, 3, 512):
        assert {r.doc_id: r.copies for r in e.survivors(docs, counters).collect()} == {v[0]: len(v) for v in want.values()}
        assert {r.doc_id for r in e.dedup(docs, counters).collect()} == {v[0] for v in want.values()}


def test_edges(spark, nasty, same):
    same(e.dedup(nasty), [1, 3, 4, 6, 7, 9, 10, 11, 12, None])
    found = {(r.doc_id, r.copies) for r in e.survivors(nasty).collect()}
    assert {(1, 4), (7, 2), (4, 2), (3, 1), (None, 1)} <= found and len(found) == 10
    same(e.dedup(nasty.limit(0)), [])
    assert e.survivors(nasty.limit(0)).count() == 0


def test_ties_do_not_depend_on_the_order_of_rows(spark, monkeypatch):
    rows = [(1, "a", "y"), (1, "a", "x"), (1, "a", "z"), (2, "a", "b"), (2, "c", "n"), (2, "c", None), (None, "d", "k"), (None, "d", "j")]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, `a b.c` string")
        for bound in (e.BROADCAST_ROWS, -1):
            monkeypatch.setattr(e, "BROADCAST_ROWS", bound)
            assert {tuple(r) for r in e.dedup(docs).collect()} == {(1, "a", "x"), (2, "c", "n"), (None, "d", "j")}
