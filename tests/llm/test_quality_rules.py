import numpy as np
from helpers import SMALL

from quire.llm import quality_rules as q


def test_estimates_recover_what_made_the_votes():
    rng = np.random.default_rng(4)
    n, rules = 40_000, 8
    truth = rng.random(n) < 0.85
    on_good, on_bad = rng.uniform(0.9, 0.99, rules), rng.uniform(0.3, 0.9, rules)
    right = np.where(truth[:, None], rng.random((n, rules)) < on_good, rng.random((n, rules)) < on_bad)
    vote = np.where(right == truth[:, None], "1", "0")
    vote = np.where(rng.random((n, rules)) < 0.2, "-", vote)
    patterns = ["".join(v) for v in vote]
    names, counts = np.unique(patterns, return_counts=True)
    share, good, bad, posterior = q.estimate(dict(zip(names.tolist(), counts.tolist())))
    assert abs(share - 0.85) < 0.02 and abs(good - on_good).max() < 0.02 and abs(bad - on_bad).max() < 0.05
    assert np.mean((np.array([posterior[p] for p in patterns]) >= 0.5) == truth) > 0.97


def brute(texts):
    """Votes and expectation-maximisation row by row in plain Python: quality of each text."""
    import regex

    def votes(t):
        words = [w for w in regex.split(r"[ \t\n\x0b\f\r]+", t) if w]
        lines = [x for x in t.split("\n") if x.strip(" ")]
        n, enough = len(words), len(words) >= 20
        if not n:
            return None
        symbols, capitals = (len(regex.findall(p, t)) / max(len(t), 1) for p in (r"[#$%&*|!<>{}~^\\]", r"\p{Lu}"))
        repeated, ended = 1 - len(set(lines)) / max(len(lines), 1), sum(bool(regex.search(r"[.!?:;\"'…。！？)]$", x.rstrip(" "))) for x in lines) / max(len(lines), 1)
        distinct, stops, length = len(set(words)) / n, sum(w.lower() in q.STOP_WORDS for w in words) / n, len(t) / n
        three = len(lines) >= 3
        pairs = [
            (symbols > 0.04, symbols < 0.01),
            (enough and capitals > 0.3, capitals < 0.12),
            (three and repeated > 0.3, three and repeated < 0.1),
            (enough and distinct < 0.2, enough and n < 2000 and distinct > 0.4),
            (enough and not 3 <= length <= 14, enough and 4 <= length <= 10),
            (enough and stops < 0.03, enough and stops > 0.08),
            (three and ended < 0.4, ended > 0.8),
            (n < 2, enough),
        ]
        return [0 if bad else 1 if good else None for bad, good in pairs]

    rows = [votes(t) for t in texts]
    some = [r for r in rows if r]
    good, bad, share = [0.95] * 8, [0.4] * 8, 0.8
    for _ in range(500):
        posterior = []
        for r in some:
            a, b = share, 1 - share
            for k, v in enumerate(r):
                if v is not None:
                    a *= good[k] if v else 1 - good[k]
                    b *= 1 - bad[k] if v else bad[k]
            posterior.append(a / (a + b))
        for k in range(8):
            cast = [(p, r[k]) for p, r in zip(posterior, some) if r[k] is not None]
            good[k] = min(max((sum(p * v for p, v in cast) + 19) / (sum(p for p, _ in cast) + 20), 0.5), 0.999)
            bad[k] = (sum((1 - p) * (1 - v) for p, v in cast) + 8) / (sum(1 - p for p, _ in cast) + 20)
            bad[k] = min(max(bad[k], 1 - good[k] + 0.001, 0.001), 0.999)
        new = min(max(sum(posterior) / len(posterior), 0.01), 0.99)
        moved, share = abs(new - share), new
        if moved < 1e-12:
            break
    found = iter(posterior)
    return [next(found) if r else 0.0 for r in rows]


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    found = {r.doc_id: r.quality for r in q.score(docs).collect()}
    assert found.keys() == want.keys() and max(abs(found[k] - want[k]) for k in want) < 1e-4
    assert {r.doc_id for r in q.query(spark, SMALL).collect()} == {k for k, v in want.items() if v >= q.KEEP}


def test_labelled_documents(spark):
    found = q.query(spark, SMALL.replace("sf0.001", "sf0.1"))
    kept = found.select("doc_id").join(spark.read.parquet(SMALL.replace("sf0.001", "sf0.1") + "/labels.parquet"), "doc_id").groupBy("quality").count().collect()
    kept = {r.quality: r["count"] for r in kept}
    assert kept[1] > 0.99 * 3409 and kept[0] < 0.3 * 571


def test_edges(spark, nasty):
    scored = {}
    for r in q.score(nasty).collect():
        scored.setdefault(r.doc_id, []).append(r.quality)
    assert [scored[k] for k in (3, 4, 5, 6)] == [[0.0]] * 4 and len(scored[1]) == 2 and len(scored[None]) == 2
    kept = q.keep(nasty)
    assert kept.columns == nasty.columns and kept.filter("doc_id = 1").count() == 2 and kept.filter("text IS NULL OR trim(text) = ''").count() == 0
    assert q.keep(nasty.limit(0)).count() == 0 and q.score(nasty.limit(0)).count() == 0
    assert q.estimate({})[3] == {}
