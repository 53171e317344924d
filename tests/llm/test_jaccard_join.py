import numpy as np
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm import jaccard_join as j


def sets_with_tree(rng, n):
    base = [rng.integers(0, 1 << 53, rng.integers(3, 60)) for _ in range(5)]
    sets = []
    for _ in range(n):
        b = base[rng.integers(5)]
        sets.append(set(b[rng.random(len(b)) < 0.8].tolist()) | set(rng.integers(0, 1 << 53, rng.integers(1, 5)).tolist()))
    sets.sort(key=len)
    bits = np.zeros((n, 8 * j.WORDS), np.uint8)
    for r, x in enumerate(sets):
        for h in x:
            b = int(common.mix(np.array([h], np.uint64))[0] & np.uint64(64 * j.WORDS - 1))
            bits[r, b >> 3] |= 1 << (b & 7)
    return sets, j.Tree(np.array([len(x) for x in sets]), bits.view(np.uint64))


def test_trees_lose_no_pair():
    rng = np.random.default_rng(3)
    for _ in range(15):
        s, x = sets_with_tree(rng, int(rng.integers(1, 400)))
        t, y = sets_with_tree(rng, int(rng.integers(1, 400)))
        similar = lambda a, b: len(a & b) / len(a | b) >= 0.5
        own = {pq for p, q in j.tree_pairs(x, x, 0.5, True) for pq in zip(p.tolist(), q.tolist())}
        assert {(a, b) for a in range(len(s)) for b in range(a + 1, len(s)) if similar(s[a], s[b])} <= own
        both = {pq for p, q in j.tree_pairs(x, y, 0.5, False) for pq in zip(p.tolist(), q.tolist())}
        assert {(a, b) for a in range(len(s)) for b in range(len(t)) if similar(s[a], t[b])} <= both


def variants(spark, n=300):
    words = " ".join(f"w{k}" for k in range(40))
    return spark.createDataFrame([(k, f"{words} x{k}", "q") for k in range(n)], "doc_id long, text string, gram string")


def test_every_path_gives_the_same_pairs(spark):
    docs = variants(spark)
    every = 300 * 299 // 2
    assert j.join(docs).count() == every
    nodes = j.sketches(docs, 5, 20).select("sid", "size", "grams", "bits", "sketch", "doc_id")
    nodes = common.stored(nodes, "t")
    found = common.stored(j.candidates(nodes, 0.4, block=50), "t")
    assert found.count() == every
    assert j.verified(docs, nodes, found, 5, 0.4, cell=1000).count() == every


def test_passages_that_many_documents_share(spark):
    """400 documents a passage, of J 0.43 by the passage alone; nearly all of its n-grams are hot."""
    rng = np.random.default_rng(5)
    own = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, n))
    rows = []
    for passage in range(4):
        shared = own(124)  # 120 n-grams; 4 more cross its end
        rows += [(1000 * passage + k, f"{shared} {own(80)}") for k in range(400)]
    pairs = j.join(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.passage: r.n for r in pairs.groupBy(F.floor(F.col("doc_id_a") / 1000).alias("passage")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert [found.get(p, 0) for p in range(4)] == [400 * 399 // 2] * 4


def brute_pairs(texts, threshold=0.4):
    import re

    word, sets = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {}
    for k, t in texts:
        w = word.findall(t.lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    inverted, shared = {}, {}
    for k, x in sets.items():
        for g in x:
            inverted.setdefault(g, []).append(k)
    for ids in inverted.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                shared[min(a, b), max(a, b)] = shared.get((min(a, b), max(a, b)), 0) + 1
    return {(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= threshold}


def test_recall_where_all_hold_one_hot_ngram(spark):
    """Every text holds one line that more than 200 share; similarities spread around the threshold, sizes from 10 to 3,000 words."""
    rng = np.random.default_rng(12)
    words = lambda n: [f"u{x}" for x in rng.integers(0, 1 << 40, n)]
    line, rows = words(8), []
    for _ in range(60):
        base = words(int(rng.choice([10, 60, 300, 3000])))
        for _ in range(8):
            cut = int(len(base) * rng.uniform(0.3, 1))
            rows.append((len(rows), " ".join(base[:cut] + words(int(len(base) * rng.uniform(0, 0.5))) + line)))
    found = {(r.doc_id_a, r.doc_id_b) for r in j.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_pairs(rows)
    assert len(want) > 400 and found <= want and len(found) >= 0.999 * len(want)


def test_a_hot_ngram_is_split_over_tasks(spark):
    """No task gets all the nodes that meet at one n-gram, and no pair is lost."""
    docs = variants(spark, 600)
    nodes = common.stored(j.sketches(docs, 5, 20), "t")
    plan = j.candidates(nodes, 0.4, block=100)
    assert plan.count() == 600 * 599 // 2 and "Window" not in plan._jdf.queryExecution().executedPlan().toString()


def test_stars():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    edges = rng.integers(0, 300, (260, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"]) for x in np.array_split(edges, 7)]
    found = {int(a): int(b) for batch in j.stars(iter(batches)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    want = brute_components([(int(a), int(b)) for a, b in edges if a != b])
    assert found == {x: r for x, r in want.items() if x != r}


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(6)
    base, sets = rng.integers(1, 1 << 53, 300), []
    for k in range(150):
        some = base[: (40, 120, 300)[k % 3]]
        sets.append(np.unique(np.concatenate([some[rng.random(len(some)) < 0.75], rng.integers(1, 1 << 53, 9)])))
    size = np.array([len(x) for x in sets])
    sketch = j.bin_sketch(common.mix(np.concatenate(sets).astype(np.uint64)), np.repeat(np.arange(150), size), 150)
    p, q = np.triu_indices(150, 1)
    shared = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(p, q)])
    want = {(a, b) for a, b, x in zip(p.tolist(), q.tolist(), shared / (size[p] + size[q] - shared)) if x >= 0.4}
    found = set(zip(*(x.tolist() for x in j.sketch_pairs(sketch, p, q, 0.4))))
    assert want and len(want - found) <= 0.002 * len(want)
    far = rng.integers(1, 1 << 53, (2, 400)).astype(np.uint64)
    sketch = j.bin_sketch(common.mix(far.ravel()), np.repeat([0, 1], 400), 2)
    assert not len(j.sketch_pairs(sketch, np.array([0]), np.array([1]), 0.4)[0])


def test_beyond_the_broadcast_bound(spark, nasty, same, monkeypatch):
    monkeypatch.setattr(j, "BROADCAST_ROWS", -1)
    same(j.drop_near(nasty), [1, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12, None, None])
    docs = variants(spark, 60)
    assert j.join(docs).count() == 60 * 59 // 2 and j.drop_near(docs).count() == 1


def test_stored_tables_can_be_released(spark):
    path = common.stored(spark.range(3), "t").inputFiles()[0]
    import os

    assert os.path.exists(path.removeprefix("file://"))
    common.release(spark)
    assert not os.path.exists(path.removeprefix("file://"))


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2)) if a != b] + [(k, k + 1) for k in range(200, 260)]
    found = {r.node: r.root for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: r for x, r in brute_components(edges).items() if x != r}
    assert found == want
    monkeypatch.setattr(j, "LOCAL_EDGES", 10)
    assert {r.node: r.root for r in j.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_edges(spark, nasty, same):
    pairs = {(r.doc_id_a, r.doc_id_b, r.jaccard) for r in j.join(nasty).collect()}
    assert pairs == {(1, 2, 1.0), (7, 8, 1.0)}
    same(j.drop_near(nasty), [1, 1, 3, 4, 5, 6, 7, 9, 10, 11, 12, None, None])
    assert j.join(nasty.limit(0)).count() == 0 and j.drop_near(nasty.limit(0)).count() == 0


def brute_classes(ids, pairs):
    pairs = {(a, b) for a, b in pairs}
    root = brute_components(pairs)
    links = dict.fromkeys(ids, 0)
    for p in pairs:
        for x in p:
            links[x] += 1
    return {(x, root.get(x, x), links[x]) for x in ids}


def test_query_returns_a_row_per_document(spark, tmp_path):
    """Copies and near copies: pairs grow with the square of a group, rows of the query don't."""
    rng = np.random.default_rng(4)
    words = lambda n: " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, n))
    base, other = words(60), words(40)
    rows = [(k, base) for k in range(100, 130)] + [(k, f"{base} {words(1)}") for k in range(130, 140)] + [(k, other) for k in (7, 3, 9)] + [(k, words(30)) for k in range(5)[::2]] + [(50, ""), (51, None), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = j.query(spark, str(tmp_path))
    assert found.columns == ["doc_id", "class_id", "links"]
    got = [tuple(r) for r in found.collect()]
    ids = {k for k, _ in rows if k is not None}
    assert len(got) == len(ids) and j.join(docs).count() == 40 * 39 // 2 + 3
    assert set(got) == brute_classes(ids, brute_pairs([(k, t or "") for k, t in rows if k is not None]))
    assert (135, 100, 39) in got and (9, 3, 2) in got and (50, 50, 0) in got


def test_classes_of_documents_with_several_texts(spark, nasty):
    rng = np.random.default_rng(14)
    texts = [" ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 30)) for _ in range(5)]
    near = lambda k: f"{texts[k]} more"
    rows = [(1, texts[0]), (2, near(0)), (2, texts[1]), (3, near(1)), (4, near(1)), (5, near(0)), (5, near(1)), (5, near(1)), (6, texts[2]), (6, near(2)), (7, texts[3]), (8, texts[4]), (8, ""), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = {(r.doc_id_a, r.doc_id_b) for r in j.join(docs).collect()}
    assert {tuple(r) for r in j.classes(docs).collect()} == brute_classes({k for k, _ in rows}, pairs) and (1, 5) in pairs and (4, 5) in pairs
    odd = {(r.doc_id, r.class_id, r.links) for r in j.classes(nasty).collect()}
    assert odd == {(1, 1, 1), (2, 1, 1), (7, 7, 1), (8, 7, 1)} | {(k, k, 0) for k in (3, 4, 5, 6, 9, 10, 11, 12)}
    assert j.classes(nasty.limit(0)).count() == 0


def test_stored_rows_grow_as_the_nodes_do(spark, monkeypatch):
    """600 near copies make 179,700 pairs; no stored table has rows for them, in the query or the pipeline's stage."""
    docs, most, stored = variants(spark, 600), [], common.stored

    def counting(df, name):
        made = stored(df, name)
        most.append((made.count(), name))
        return made

    monkeypatch.setattr(common, "stored", counting)
    assert {(r.class_id, r.links) for r in j.classes(docs).collect()} == {(0, 599)} and j.drop_near(docs).count() == 1
    assert max(most)[0] <= 600 * j.ROUTE, max(most)


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(1)
    for n, m, often in ((1, 0, 4), (2, 1, 4), (50, 20, 32), (200, 0, 4), (200, 90, 4)):
        monkeypatch.setattr(j, "OFTEN", often)
        sets = [np.unique(rng.integers(0, 30_000 if k % 3 else 300, rng.integers(1, 300))) for k in range(n)]
        found = j.overlaps(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), m)
        assert all(found[a, b - m] == len(np.intersect1d(sets[a], sets[b])) for a in range(m or n) for b in range(m or a + 1, n))


def test_counts_over_blocks(spark):
    docs = variants(spark)
    _, nodes, ties = j.node_ties(docs)
    weights = nodes.select(F.col("sid").alias("node"), F.when(F.col("doc_id") == 7, -3).otherwise(1).alias("weight"))
    rows = j.counted(docs, nodes, ties, 5, 0.4, weights, cell=1000).collect()
    odd = nodes.filter("doc_id = 7").first().sid
    links = {}
    for r in rows:
        if r.kind == 0:
            links[r.a] = links.get(r.a, 0) + r.n
    assert len(links) == 300 and all(n == (299 if a == odd else 300) for a, n in links.items())
    assert len({r.b for r in rows if r.kind == 2}) == 299 and {r.a for r in rows if r.kind == 2} == {odd}
    assert len(brute_components({(r.a, r.b) for r in rows if r.kind == 1})) == 300
