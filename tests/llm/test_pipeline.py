import corpus_pipeline
from helpers import SMALL
from pyspark.sql import functions as F

from quire.llm import jaccard_join, mixing


def brute_near(docs):
    """ids to keep: the smallest of each component of pairs with Jaccard 0.4 or more."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    sets = {}
    for i, t in docs:
        w = word.findall(t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            s = len(sets[a] & sets[b])
            if s and s / (len(sets[a]) + len(sets[b]) - s) >= jaccard_join.THRESHOLD:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in ids if find(i) == i}


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == columns
    ids = lambda name: {r.doc_id for r in out[name].select("doc_id").collect()}
    assert ids("language_id") == set(range(200))
    first = {}
    for r in out["language_id"].orderBy("doc_id").collect():
        first.setdefault(r.text, r.doc_id)
    assert ids("exact_dedup") == set(first.values())
    assert ids("near_dedup") == brute_near([(r.doc_id, r.text) for r in out["exact_dedup"].collect()])
    assert ids("mixing") == ids("near_dedup")
    plan = mixing.schedule(out["near_dedup"]).groupBy("doc_id").count()
    assert {tuple(r) for r in plan.collect()} == {tuple(r) for r in out["mixing"].groupBy("doc_id").count().collect()}
    words = {r.doc_id: r.n for r in out["mixing"].groupBy("doc_id").agg(F.sum(mixing.tokens(F.col("text"))).alias("n")).collect()}
    assert {r.doc_id: r.n for r in out["packing"].groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == words
    run = corpus_pipeline.run(spark, SMALL)
    total = lambda df: df.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    assert {tuple(r) for r in total(run).collect()} == {tuple(r) for r in total(out["packing"]).collect()}


def test_stages_take_empty_tables_and_extra_columns(spark, nasty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (nasty, nasty.limit(0)):
            found = stage(spark, docs, SMALL)
            assert name == "packing" or found.columns == nasty.columns
            found.count()
