import numpy as np
from helpers import DATA, SMALL
from pyspark.sql import functions as F

from quire.llm import language_id as lid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA.replace("sf0.01", "sf0.1") + "/documents.parquet")
    model = lid.train(docs.filter("doc_id % 2 = 0"), sample=150)
    found = lid.identify(docs.filter("doc_id % 2 = 1"), model).select(F.col("row.lang").alias("lang"), "language", "accepted", "family").toPandas()
    assert (found.lang == found.language).mean() > 0.99 and found.accepted.mean() > 0.999
    assert (found.language.map(lid.FAMILIES) == found.family).all()


def test_a_language_left_out_of_the_sample_is_rejected(spark):
    docs = spark.read.parquet(DATA.replace("sf0.01", "sf0.1") + "/documents.parquet")
    rows = lid.labelled_sample(docs, 150)
    for out in sorted({r["lang"] for r in rows}):
        model = lid.Model([r for r in rows if r["lang"] != out])
        found = lid.identify(docs.filter(F.col("lang") == out).limit(400), model).select("accepted").toPandas()
        assert found.accepted.mean() < 0.05, out


def test_scores_equal_explicit_feature_vectors(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lid.train(docs, sample=30)
    texts = [r.text.lower() for r in docs.limit(40).collect()]
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    _, margin, _, _ = model.predict(np.concatenate(raw), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    import pyarrow as pa

    for k, (codes, counts) in enumerate(lid.histograms(pa.array(texts))):
        x = np.zeros(lid.CODES)
        x[codes] = counts / counts.sum()
        scores = [abs(float(w[:-1] @ x + w[-1])) for w in model.weights]
        assert min(abs(margin[k] - v) for v in scores) < 1e-4


def test_other_languages_and_edges(spark, nasty):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lid.train(docs, sample=60)
    odd = spark.createDataFrame([(1, "Привет как дела сегодня хорошая погода"), (2, "你好，世界。今天天气很好"), (3, "123 456 !!!"), (4, None), (5, ""), (6, "The and of the thing is for you.")], "doc_id long, text string")
    assert {r.doc_id: r.accepted for r in lid.identify(odd, model).select("row.doc_id", "accepted").collect()} == {1: False, 2: False, 3: False, 4: False, 5: False, 6: True}
    kept = lid.accepted(nasty, model)
    assert kept.columns == nasty.columns and kept.filter("text IS NULL OR trim(text) = ''").count() == 0
    assert lid.identify(nasty, model).count() == nasty.count()
    assert lid.accepted(nasty).columns == nasty.columns  # trained on its own labels
    assert lid.accepted(nasty.limit(0)).count() == 0
    assert lid.accepted(nasty.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    one = lid.identify(nasty.filter("lang = 'en' OR lang IS NULL")).filter("language IS NOT NULL").select("language").distinct().collect()
    assert [r.language for r in one] == ["en"]


def brute_judge(model, text):
    """Language, family and acceptance of one text, character pair by character pair."""
    raw = text.lower().encode()
    c = [b - 96 if 97 <= b <= 122 else 27 + (b - 128) % 37 if b >= 128 else 0 for b in raw]
    two = [c[i] * 64 + c[i + 1] for i in range(len(c) - 1) if c[i] or c[i + 1]]
    three = [(c[i] * 64 + c[i + 1]) * 64 + c[i + 2] for i in range(len(c) - 2) if c[i + 1]]
    codes = two + [4096 + (x * 0x9E3779B1 % 2**32 >> 16) % 12288 for x in three]
    mean = lambda table: sum(float(table[x]) for x in codes) / max(1, len(codes))
    margin = {p: mean(w) + float(w[-1]) for p, w in zip(model.pairs, model.weights)}

    def winner(group, members):
        votes = dict.fromkeys(members, 0.0)
        for (g, a, b), m in margin.items():
            if g == group:
                votes[a] += (m > 0) + 1e-6 * np.tanh(m)
                votes[b] += (m < 0) - 1e-6 * np.tanh(m)
        return max(members, key=lambda v: votes[v])

    family = winner("family", model.families)
    language = winner(family, [v for v in model.languages if model.of[v] == family])
    k = model.languages.index(language)
    solid = sum(b not in b" \t\n\r\x0b\x0c" for b in raw)
    known = sum(bool(model.known[k][x]) for x in two) / max(1, len(two))
    middle, spread = model.usual[k]
    fits = mean(model.log[k]) >= middle - lid.SLACK - 3 * spread / max(1, len(codes)) ** 0.5
    letters = sum(x > 0 for x in c)
    return (language, family, letters / solid >= 0.2 and known >= 0.6 and fits) if letters else (None, None, False)


def test_query_against_brute_force(spark):
    """Votes, family step and rejection of all rows, by the exported weights."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = [(-1, "Zażółć gęślą jaźń nad Wisłą i Odrą", None, None), (-2, "1 2 3 4 a", None, None), (-3, "", None, None), (-4, "qzx vvkq jjxz wqk", None, None)]
    model = lid.train(docs)
    found = {r.doc_id: (r.language, r.family, r.accepted) for r in lid.identify(docs.unionByName(spark.createDataFrame(odd, docs.schema)), model).select("row.doc_id", "language", "family", "accepted").collect()}
    want = {r.doc_id: brute_judge(model, r.text or "") for r in docs.collect()} | {k: brute_judge(model, t) for k, t, _, _ in odd}
    assert found == want and {v[2] for v in want.values()} == {True, False}
    assert {(r.doc_id, r.language, r.family) for r in lid.query(spark, SMALL).collect()} == {(k, *v[:2]) for k, v in want.items() if v[2] and k >= 0}


def test_long_texts_take_little_memory_and_windows_change_nothing(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(1)
    words = ["der", "die", "und", "nicht", "straße", "the", "of", "with"]
    rows = [{"lang": v, "codes": c, "counts": n} for v in ("de", "en") for _ in range(25) for c, n in lid.histograms(__import__("pyarrow").array([" ".join(rng.choice(words[:5] if v == "de" else words[5:], 80))]))]
    model = lid.Model(rows)
    texts = [" ".join(rng.choice(words, k)).encode() for k in (1, 2, 300, 0, 9000)]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    one = model.judge(raw, at)
    split = lid.common.windows
    monkeypatch.setattr(lid.common, "windows", lambda offsets: split(offsets, 7))
    assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(one, model.judge(raw, at)))
    monkeypatch.undo()
    long = np.tile(np.frombuffer(b"der die und nicht the of ", np.uint8), (32 << 20) // 25)
    tracemalloc.start()
    model.judge(long, np.array([0, len(long)]))
    assert tracemalloc.get_traced_memory()[1] < 60 << 20


def test_all_labelled_rows_are_fitted_on(spark):
    """Counts and limits against brute force over all rows, with far fewer rows a block; no row's share in the machines is lost, and the layout changes nothing."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    model, again = lid.train(docs, sample=10), lid.train(docs.orderBy("n_chars").repartition(5), sample=10)
    assert np.array_equal(model.weights, again.weights) and model.usual == again.usual
    texts = docs.select("lang", "text", F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(lid.FOLDS)).alias("fold")).collect()
    by = {v: [] for v in model.languages}
    for lang, text, fold in texts:
        c = [b - 96 if 97 <= b <= 122 else 27 + (b - 128) % 37 if b >= 128 else 0 for b in text.lower().encode()]
        two = [c[i] * 64 + c[i + 1] for i in range(len(c) - 1) if c[i] or c[i + 1]]
        three = [4096 + (((c[i] * 64 + c[i + 1]) * 64 + c[i + 2]) * 0x9E3779B1 % 2**32 >> 16) % 12288 for i in range(len(c) - 2) if c[i + 1]]
        by[lang].append((fold, np.bincount(two + three, minlength=lid.CODES)))

    def log(counts):
        x = sum(counts, np.zeros(lid.CODES)) + 0.5
        return np.log(np.append(x[:4096] / x[:4096].sum(), x[4096:] / x[4096:].sum()))

    for k, lang in enumerate(model.languages):
        own = [(f, n) for f, n in by[lang] if n.sum()]
        total = sum(n for _, n in own)
        assert np.allclose(model.log[k], log([n for _, n in own])) and np.array_equal(model.known[k], total[:4096] * 1e6 >= total[:4096].sum())
        if len(own) < lid.HELD_OUT:
            assert model.usual[k] == (-np.inf, 0)
            continue
        rest = [log([n for g, n in own if g != f]) for f in range(lid.FOLDS)]
        mean, size = np.array([n @ rest[f] / n.sum() for f, n in own]), np.array([n.sum() for _, n in own])
        assert abs(model.usual[k][0] - np.median(mean)) < 1e-3
        assert abs(model.usual[k][1] / (1.4826 * np.median(np.abs(mean - np.median(mean)) * size**0.5)) - 1) < 0.02
    labelled = docs.select("lang", "text", F.xxhash64("lang", "text").alias("h"), F.lit(0).alias("fold"))
    sums = lid.fitted_on(labelled, model.languages, 40, 2, lid.FAMILIES)
    assert sums["w0"][-1] == len(texts)


def test_a_language_mostly_outside_the_first_rows_is_learnt(spark):
    """Repeated rows and rare spellings: what only rows beyond a block hold is known."""
    words = ["qua", "zyx", "vök"]
    rows = [(k, "the cat and the dog of the house " * 3 if k % 40 else f"{words[k // 40 % 3]} the cat", "en") for k in range(400)] + [(1000 + k, "der hund und die katze im haus nicht " * 3, "de") for k in range(400)]
    model = lid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=10)
    english = model.known[model.languages.index("en")]
    code = lambda a, b: (ord(a) - 96) * 64 + ord(b) - 96
    assert english[code("z", "y")] and english[code("q", "u")] and not english[code("h", "u")]
