import itertools

import numpy as np
from helpers import DATA, SMALL
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm import line_crf as c


def test_marginals_and_likelihood_by_enumeration():
    rng = np.random.default_rng(0)
    model = c.Crf()
    model.start, model.step = rng.normal(size=2), rng.normal(size=(2, 2))
    at, score = np.array([0, 3, 3, 4, 9]), rng.normal(size=9) * 2
    good, joint, log_z = model.marginals(score, at, True)
    total, moves = 0.0, np.zeros((2, 2))
    for a, b in zip(at[:-1], at[1:]):
        if a == b:
            continue
        z, weight, own = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = np.exp(model.start[y[0]] + sum(score[a + i] * v for i, v in enumerate(y)) + sum(model.step[u, v] for u, v in zip(y, y[1:])))
            z, weight = z + p, weight + p * np.array(y)
            for u, v in zip(y, y[1:]):
                own[u, v] += p
        assert np.allclose(weight / z, good[a:b])
        total, moves = total + np.log(z), moves + own / z
    assert np.isclose(total, log_z) and np.allclose(moves, joint)


def test_held_out_accuracy(spark):
    folder = DATA.replace("sf0.01", "sf0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = c.train(docs, labels.filter("doc_id % 2 = 0"), sample=250)
    rest = labels.filter("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("truth"))
    found = c.score(docs, model).select("row.doc_id", "quality").join(rest, "doc_id").toPandas()
    kept = found.quality >= c.KEEP
    assert kept[found.truth == 1].mean() > 0.98 and kept[found.truth == 0].mean() < 0.06


def test_features_follow_the_lines():
    raw = np.frombuffer(b"\n\nAb c.\n  \nx|y\nx|y\nlast", np.uint8)
    f, length, at = c.line_features(raw, np.array([0, 19, 19, len(raw)]), common.RunHasher())
    assert length.tolist() == [5, 3, 3, 4] and at.tolist() == [0, 3, 3, 4] and f.shape == (4, c.WIDTH)
    assert f[1, c.OWN - 3] == f[2, c.OWN - 3] == 1 and f[0, c.OWN - 3] == 0  # repeated lines
    assert np.array_equal(f[0, 2 * c.OWN : 3 * c.OWN], f[1, : c.OWN]) and not f[0, c.OWN : 2 * c.OWN].any() and not f[3, c.OWN : 3 * c.OWN].any()


def test_edges(spark, nasty, labels):
    model = c.train(nasty, labels)
    found = {}
    for r in c.score(nasty, model).select("row.doc_id", "quality", "n_lines").collect():
        found.setdefault(r.doc_id, []).append((r.quality, r.n_lines))
    assert [found[k] for k in (3, 4, 5, 6)] == [[(0.0, 0)]] * 4 and len(found[1]) == 2 and found[1][0] == found[1][1]
    kept = c.keep(nasty, labels)
    assert kept.columns == nasty.columns
    assert c.keep(nasty.limit(0), labels).count() == 0
    bare = c.score(nasty, c.train(nasty, labels.limit(0))).filter("n_lines > 0").select("quality").distinct().collect()
    assert [r.quality for r in bare] == [0.5]
    many = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(30_000)))], "doc_id long, text string")
    assert c.score(many, model).first().n_lines == 30_000


def brute_features(lines):
    """Own features of each line of one text, character by character."""
    found = []
    for k, line in enumerate(lines):
        n, words = len(line), max(1, len(line.translate(bytes.maketrans(b"\t\r\x0b\x0c", b"    ")).split(b" ")) - sum(x == b"" for x in line.translate(bytes.maketrans(b"\t\r\x0b\x0c", b"    ")).split(b" ")))
        share = lambda chars: sum(b in chars for b in line) / n  # noqa: B023, E731
        row = [share(x) for x in (b"#$%&*~^<>{}\\@=", b"|\t", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b",;:", b".", bytes(range(0xC0, 256)))]
        row += [np.log1p(n), np.log1p(words), min(n / words, 40), line[-1] in b".!?\"':;)", 97 <= line[0] <= 122, lines.count(line) > 1, k > 0 and lines[k - 1] == line, n < 20]
        found.append(row)
    return np.array(found, float).reshape(len(lines), -1)


def brute_quality(model, text):
    lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    if not lines:
        return 0.0, 0, 0
    own = brute_features(lines)
    zero = np.zeros((1, own.shape[1]))
    edge = np.eye(len(lines))
    f = np.concatenate([own, np.concatenate([zero, own[:-1]]), np.concatenate([own[1:], zero]), edge[0][:, None], edge[-1][:, None], np.ones((len(lines), 1))], axis=1)
    s = ((f - model.mean) / model.deviation) @ model.w
    a, b = [np.array([model.start[0], model.start[1] + s[0]])], [np.zeros(2)]
    for x in s[1:]:
        a.append(np.array([np.logaddexp(a[-1][0] + model.step[0, y], a[-1][1] + model.step[1, y]) + y * x for y in (0, 1)]))
    for x in s[:0:-1]:
        b.insert(0, np.array([np.logaddexp(model.step[y, 0] + b[0][0], model.step[y, 1] + x + b[0][1]) for y in (0, 1)]))
    p = np.array([1 / (1 + np.exp((u + v)[0] - (u + v)[1])) for u, v in zip(a, b)])
    n = np.array([len(x) for x in lines])
    return (p * n).sum() / n.sum(), len(lines), int((p >= 0.5).sum())


def test_query_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = c.train(docs.select("doc_id", "text"), labels)
    want = {r.doc_id: brute_quality(model, r.text) for r in docs.collect()}
    found = {r.doc_id: (r.quality, r.n_lines, r.n_good) for r in c.query(spark, SMALL).collect()}
    assert set(found) == {k for k, v in want.items() if v[0] >= c.KEEP} and 0 < len(found) < len(want)
    assert all(abs(v[0] - want[k][0]) < 1e-5 and v[1:] == want[k][1:] for k, v in found.items())


def test_fit_climbs_to_where_the_gradient_vanishes():
    rng = np.random.default_rng(4)
    n = np.concatenate([[0], np.cumsum(rng.integers(1, 7, 60))])
    truth = rng.integers(0, 2, n[-1])
    f = rng.normal(size=(n[-1], c.WIDTH)).astype(np.float32) + truth[:, None] * 0.5
    f[:, -1] = 1
    model = c.Crf().fit(f, truth, n, rounds=3000, rate=0.01)
    x = ((f - model.mean) / model.deviation).astype(float)

    def objective(p):
        m = c.Crf()
        m.start, m.step = p[c.WIDTH : c.WIDTH + 2], p[c.WIDTH + 2 :].reshape(2, 2)
        score, k = x @ p[: c.WIDTH], np.setdiff1d(np.arange(n[-1]), n[:-1])
        path = (score * truth).sum() + m.start[truth[n[:-1]]].sum() + m.step[truth[k - 1], truth[k]].sum()
        return path - m.marginals(score, n, True)[2] - (p @ p) / 2

    p = np.concatenate([model.w, model.start, model.step.ravel()])
    step = 1e-4 * np.eye(len(p))
    assert max(abs(objective(p + e) - objective(p - e)) / 2e-4 for e in step) < 0.05


def test_long_texts_take_little_memory_and_windows_change_nothing(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(2)
    text = "\n".join(" ".join(rng.choice(["one", "Two.", "3|", "#", "größer", ""], rng.integers(0, 9))) for _ in range(400)).encode()
    raw, at = np.frombuffer(text, np.uint8), np.array([0, 100, 100, 2000, len(text)])
    one = c.line_features(raw, at, common.RunHasher())
    split = common.windows
    monkeypatch.setattr(common, "windows", lambda offsets: split(offsets, 11))
    monkeypatch.setattr(common, "WINDOW", 11)
    assert all(np.array_equal(a, b) for a, b in zip(one, c.line_features(raw, at, common.RunHasher())))
    monkeypatch.undo()
    line = b"A line of some eighty characters, more or less, as running text has them, say.\n"
    long = np.frombuffer(line * ((32 << 20) // len(line)), np.uint8)
    tracemalloc.start()
    lines = c.Lines(long, np.array([0, len(long)]), common.RunHasher())
    c.Crf().scores(lines)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_documents_of_many_lines_are_learnt_from_by_their_first():
    raw = np.frombuffer(b"a\n \nb\n\nc\nd", np.uint8)
    assert [c.first_lines(raw, k).tobytes() for k in (1, 2, 3, 4, 9)] == [b"a", b"a\n \nb", b"a\n \nb\n\nc", raw.tobytes(), raw.tobytes()]
