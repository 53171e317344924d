import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from quire.llm import mixing


def test_every_document_comes_and_shares_follow_the_weights(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = mixing.schedule(docs, block_tokens=256).toPandas()
    assert set(plan.doc_id) == set(range(docs.count()))
    assert plan.groupby("epoch").doc_id.nunique()[0] == docs.count()
    assert not plan.duplicated(["doc_id", "key", "slot"]).any() and not plan.duplicated(["doc_id", "key", "epoch"]).any()
    spans = mixing.intervals(mixing.blocks(docs, 256, mixing.SEED)[1], None, mixing.ALPHA).toPandas()
    slots = mixing.slots(mixing.intervals(mixing.blocks(docs, 256, mixing.SEED)[1], None, mixing.ALPHA), 5000).toPandas()
    assert sorted(slots.slot) == list(range(5000))
    for n in (50, 500, 5000):  # low discrepancy in every prefix
        got = slots[slots.slot < n].key.value_counts()
        for r in spans.itertuples():
            assert abs(got.get(r.key, 0) - n * r.w) < 2 + np.log2(n)
    for _, own in slots.groupby("key"):
        assert sorted(own["rank"]) == list(range(len(own))) and own.sort_values("slot")["rank"].is_monotonic_increasing


def test_blocks_are_equal_but_for_their_last_documents(spark):
    docs = spark.createDataFrame([(k, "w " * (1 + k % 7), "s") for k in range(500)], "doc_id long, text string, source string")
    placed = mixing.blocks(docs, 50, "x")[0].groupBy("block").agg(F.sum("n_tokens").alias("n")).toPandas().sort_values("block")
    assert (abs(placed.n.iloc[:-1] - 50) <= 6).all()


def test_given_weights(spark):
    docs = spark.createDataFrame([(k, "w " * 64, "abc"[k % 3]) for k in range(300)], "doc_id long, text string, source string")
    plan = mixing.schedule(docs, {"a": 3, "b": 1, "c": 0}, block_tokens=64).toPandas()
    share = plan.key.value_counts(normalize=True)
    assert set(share.index) == {"=a", "=b"} and abs(share["=a"] - 0.75) < 0.02 and plan[plan.key == "=b"].doc_id.nunique() == 100


def test_edges(spark, nasty, same):
    kept = mixing.mixed(nasty, alpha=1.0, block_tokens=64)
    assert kept.columns == nasty.columns
    key = lambda df: {(r.doc_id, r.text, r.source) for r in df.collect()}
    assert key(kept) == key(nasty)
    once = kept.groupBy("doc_id", "text", "source").count().filter("doc_id = 1").first()
    assert once["count"] % 2 == 0
    assert mixing.mixed(nasty.limit(0)).count() == 0 and mixing.mixed(nasty.limit(0)).columns == nasty.columns


def test_weights_below_the_resolution_are_an_error(spark):
    docs = spark.createDataFrame([(k, "w " * 64, "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="=a"):
        mixing.schedule(docs, {"a": 1e-12, "b": 1})


def test_both_ways_to_the_plan_give_the_same_rows(spark, nasty, monkeypatch):
    key = lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    one = key(mixing.mixed(nasty, block_tokens=64))
    monkeypatch.setattr(mixing, "BROADCAST_SIZE", -1)
    assert sorted(key(mixing.mixed(nasty, block_tokens=64)), key=repr) == sorted(one, key=repr)
