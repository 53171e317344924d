"""Weakly supervised quality rules: each rule votes good or bad or abstains, expectation-maximisation weighs the votes.

The rules are built-in SQL expressions. A document's votes form a pattern of one character a rule (1 good, 0 bad,
- abstains), and all that estimation needs is how often each pattern occurs: the counts cover every document, and there are at most
3 ** rules patterns however large the corpus. Expectation-maximisation on the driver estimates each rule's accuracies
(the probabilities that its vote is right when it votes, on good and on bad documents: most rules know one defect, so
they are right on nearly all good documents and on few bad ones) and the share of good documents; the posterior
probability of good under independent errors replaces all-must-pass filtering.

A vote for bad is kept likelier on bad documents than on good ones, which also tells the two classes apart.

Defined results: a text without a word, an empty and a null text have quality 0 and are not kept; if all rules abstain
the quality is the estimated share; repeated rows count and are scored each; an empty table gives an empty table;
other columns pass through unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEEP = 0.5
STOP_WORDS = (
    "the of and to in is that it for was on with as be by this are from or an a not "
    "le la les de des du et un une que qui dans pour est pas sur au "
    "der die das und ist von den mit sich ein eine nicht für dem zu "
    "el los las y en se por con para del es su al una"
).split()


def features(text: Column) -> Column:
    """Counts that the rules share, as one struct."""
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.struct(words.alias("words"), lines.alias("lines"), F.length(text).alias("chars"), F.regexp_count(text, F.lit(r"[#$%&*|!<>{}~^\\]")).alias("symbols"), F.regexp_count(text, F.lit(r"\p{Lu}")).alias("capitals"))


def votes() -> dict[str, tuple[Column, Column]]:
    """Rule name to (bad, good) over the columns of ``measured``."""
    c = F.col
    share = lambda a, b: c(a) / F.greatest(c(b), F.lit(1))
    enough = c("n_words") >= 20
    ended, repeated, distinct = share("n_ended", "n_lines"), 1 - share("n_distinct_lines", "n_lines"), share("n_distinct", "n_words")
    symbols, capitals, stops, length = share("symbols", "chars"), share("capitals", "chars"), share("n_stop", "n_words"), share("chars", "n_words")
    return {
        "symbols": (symbols > 0.04, symbols < 0.01),
        "capitals": (enough & (capitals > 0.3), capitals < 0.12),
        "repeated_lines": ((c("n_lines") >= 3) & (repeated > 0.3), (c("n_lines") >= 3) & (repeated < 0.1)),
        "repeated_words": (enough & (distinct < 0.2), enough & (c("n_words") < 2000) & (distinct > 0.4)),
        "word_length": (enough & ((length < 3) | (length > 14)), enough & length.between(4, 10)),
        "stop_words": (enough & (stops < 0.03), enough & (stops > 0.08)),
        "line_ends": ((c("n_lines") >= 3) & (ended < 0.4), ended > 0.8),
        "size": (c("n_words") < 2, enough),
    }


def measured(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with the counts of the text; the text's own columns are left out."""
    base = rows.withColumn("_f", features(F.coalesce(text, F.lit(""))))
    word = F.col("_f.words")
    made = {
        "n_words": F.size(word),
        "n_distinct": F.size(F.array_distinct(word)),
        "n_stop": F.size(F.filter(word, lambda w: F.lower(w).isin(STOP_WORDS))),
        "n_lines": F.size("_f.lines"),
        "n_distinct_lines": F.size(F.array_distinct("_f.lines")),
        "n_ended": F.size(F.filter("_f.lines", lambda x: F.rtrim(x).rlike(r"[.!?:;\"'…。！？)]$"))),
        "chars": F.col("_f.chars"),
        "symbols": F.col("_f.symbols"),
        "capitals": F.col("_f.capitals"),
    }
    return base.select("*", *[v.alias(k) for k, v in made.items()]).drop("_f")


def pattern() -> Column:
    each = [F.when(bad, "0").when(good, "1").otherwise("-") for bad, good in votes().values()]
    return F.when(F.col("n_words") == 0, "none").otherwise(F.concat(*each))


def estimate(counts: dict[str, int], rounds: int = 500, tolerance: float = 1e-9) -> tuple[float, np.ndarray, np.ndarray, dict[str, float]]:
    """(share of good documents, accuracy of each rule on good ones, on bad ones, posterior of each pattern) from the counts of the patterns."""
    patterns = sorted(p for p in counts if p != "none")
    posterior = {p: 0.0 for p in counts if p == "none"}
    rules = len(patterns[0]) if patterns else 0
    on_good, on_bad, share = np.full(rules, 0.95), np.full(rules, 0.4), 0.8
    if not patterns:
        return share, on_good, on_bad, posterior
    n = np.array([counts[p] for p in patterns], float)
    good = np.array([[ch == "1" for ch in p] for p in patterns], float)
    bad = np.array([[ch == "0" for ch in p] for p in patterns], float)
    for _ in range(rounds):
        log_good = np.log(share) + good @ np.log(on_good) + bad @ np.log1p(-on_good)
        log_bad = np.log1p(-share) + good @ np.log1p(-on_bad) + bad @ np.log(on_bad)
        q = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        is_good, is_bad = n * q, n * (1 - q)
        new_good = np.clip((is_good @ good + 19) / (is_good @ (good + bad) + 20), 0.5, 0.999)
        new_bad = (is_bad @ bad + 8) / (is_bad @ (good + bad) + 20)
        new_bad = np.clip(np.maximum(new_bad, 1 - new_good + 0.001), 0.001, 0.999)
        new_share = float(np.clip(n @ q / n.sum(), 0.01, 0.99))
        moved = max(np.abs(new_good - on_good).max(), np.abs(new_bad - on_bad).max(), abs(new_share - share))
        on_good, on_bad, share = new_good, new_bad, new_share
        if moved < tolerance:
            break
    return share, on_good, on_bad, posterior | dict(zip(patterns, q.tolist()))


def posteriors(patterns: DataFrame) -> DataFrame:
    """(of, quality) of each pattern that occurs."""
    counts = {r["pattern"]: r["n"] for r in patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3 ** rules + 1 at most
    *_, quality = estimate(counts)
    return F.broadcast(patterns.sparkSession.createDataFrame(sorted(quality.items()) or [("none", 0.0)], "of string, quality double"))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, quality) of every row."""
    each = common.stored(measured(docs.select("doc_id", "text"), F.col("text")).select("doc_id", pattern().alias("pattern")), "votes")
    return each.join(posteriors(each), F.col("pattern") == F.col("of")).select("doc_id", "pattern", "quality")


def keep(docs: DataFrame, least: float = KEEP) -> DataFrame:
    """``docs`` whose quality is ``least`` or more, columns unchanged."""
    each = measured(common.packed(docs), F.col("row.text")).select("row", pattern().alias("pattern"))
    return each.join(posteriors(each.select("pattern")), F.col("pattern") == F.col("of")).filter(F.col("quality") >= least).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents")).filter(F.col("quality") >= KEEP)
