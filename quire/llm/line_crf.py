"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's score is linear in its own features and its neighbours' (length, shares of symbols, capitals, digits and bars,
word lengths, repetition, how it ends); the chain adds a start and a transition score. Scaled forward-backward gives
each line's marginal probability of good, and their mean weighted by length is the document's quality. Lines are
separated by line feeds; lines of white space only aren't lines.

Training maximises the penalised conditional likelihood of a bounded sample: 2 * ``sample`` labelled documents in the
labels' proportions (``LEAST`` of a label at least, so that the marginals keep the true prior), those with the smallest
hashes, the first ``train_lines`` lines of each; every line has its document's label (distant supervision). Features are computed on the
executors. Scoring covers all lines of all documents.

Defined results: null and empty texts and those without a line have quality 0 and are not kept; without labelled
documents of both kinds each line has 0.5, which is kept; repeated rows are scored each; an empty table gives an empty table;
other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SAMPLE = 600
TRAIN_LINES = 64
LEAST = 100
KEEP = 0.5
STEP = 1 << 14


def _among(chars: bytes) -> np.ndarray:
    return np.array([b in chars for b in range(256)])


CLASSES = [
    _among(b"#$%&*~^<>{}\\@="),
    _among(b"|\t"),
    _among(b"!?"),
    _among(bytes(range(65, 91))),
    _among(bytes(range(48, 58))),
    _among(b" "),
    _among(b",;:"),
    _among(b"."),
    np.arange(256) >= 0xC0,
]
SPACE = _among(b" \t\r\x0b\x0c")
BREAK = SPACE | _among(b"\n")
END = _among(b".!?\"':;)")
OWN = len(CLASSES) + 8
WIDTH = 3 * OWN + 3


class Lines:
    """The lines of some rows: starts and ends, the rows' offsets ``at`` into them, and what their features are made of."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, hasher: common.RunHasher) -> None:
        feeds = np.concatenate([np.flatnonzero(raw[s : s + common.WINDOW] == 10) + s for s in range(0, len(raw), common.WINDOW)] or [np.zeros(0, np.int64)])
        cuts = np.unique(np.concatenate([offsets, feeds, feeds + 1]))
        sums = np.zeros((len(CLASSES) + 2, len(cuts) - 1), np.int32)
        for s, e, rows, begin in common.windows(cuts):
            own = raw[s:e]
            solid = ~SPACE[own]
            before = np.concatenate([[s == 0 or bool(BREAK[raw[s - 1]])], BREAK[own[:-1]]])
            before[begin[cuts[rows] >= s]] = True
            for k, mask in enumerate([*(c[own] for c in CLASSES), solid & before, solid]):
                sums[k, rows] += np.add.reduceat(mask, begin, dtype=np.int32)
        held = np.flatnonzero((sums[-1] > 0) & (raw[cuts[:-1]] != 10)) if len(raw) else np.zeros(0, np.int64)
        self.starts, self.ends, self.sums = cuts[held], cuts[held + 1], sums[:, held]
        self.length = self.ends - self.starts
        self.at = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))
        hashed = hasher(raw, self.starts, self.ends)
        _, code, count = np.unique(common.mix(hashed ^ common.mix(self.row.astype(np.uint64))), return_inverse=True, return_counts=True)
        self.repeated = count[code] > 1
        self.same = np.zeros(len(held), bool)
        self.same[1:] = (hashed[1:] == hashed[:-1]) & (self.row[1:] == self.row[:-1])
        self.first, self.last = np.zeros(len(held), bool), np.zeros(len(held), bool)
        full = np.diff(self.at) > 0
        self.first[self.at[:-1][full]], self.last[self.at[1:][full] - 1] = True, True
        self.ending, self.low = END[raw[self.ends - 1]], (raw[self.starts] >= 97) & (raw[self.starts] <= 122)

    def own(self, a: int, b: int) -> np.ndarray:
        """Own features of the lines ``a`` to ``b``."""
        length, words = self.length[a:b], np.maximum(self.sums[-2, a:b], 1)
        found = [x[a:b] / length for x in self.sums[: len(CLASSES)]]
        found += [np.log1p(length), np.log1p(words), np.minimum(length / words, 40), self.ending[a:b], self.low[a:b], self.repeated[a:b], self.same[a:b], length < 20]
        return np.stack(found, axis=1).astype(np.float32)


def line_features(raw: np.ndarray, offsets: np.ndarray, hasher: common.RunHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, lines' lengths in bytes, and the rows' offsets into the lines."""
    lines = Lines(raw, offsets, hasher)
    own, zero = lines.own(0, len(lines.starts)), np.zeros((1, OWN), np.float32)
    left, right = np.concatenate([zero, own])[:-1], np.concatenate([own, zero])[1:]
    left[lines.first], right[lines.last] = 0, 0
    return np.concatenate([own, left, right, np.stack([lines.first, lines.last, np.ones(len(own))], axis=1).astype(np.float32)], axis=1), lines.length, lines.at


class Crf:
    """Weights of the line scores (good against bad), start score and transition scores in logarithms."""

    def __init__(self) -> None:
        self.mean, self.deviation = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.w = np.zeros(WIDTH)
        self.start, self.step = np.zeros(2), np.zeros((2, 2))

    def scores(self, lines: Lines) -> np.ndarray:
        """Each line's score: its own part and what its neighbours give, features being made for ``STEP`` lines at a time."""
        w = self.w / self.deviation
        parts = w[: 3 * OWN].reshape(3, OWN).T
        n = len(lines.starts)
        given = np.concatenate([lines.own(a, min(a + STEP, n)).astype(np.float64) @ parts for a in range(0, n, STEP)] or [np.zeros((0, 3))])
        score = given[:, 0] + w[-3] * lines.first + w[-2] * lines.last + (w[-1] - self.mean @ w)
        score[1:] += np.where(lines.first[1:], 0, given[:-1, 1])
        score[:-1] += np.where(lines.last[:-1], 0, given[1:, 2])
        return score

    def marginals(self, score: np.ndarray, at: np.ndarray, pairs: bool = False):
        """P(good) of each line; with ``pairs`` also the expected transitions, the first lines' marginals and the log-likelihood's normaliser."""
        rows = np.argsort(-np.diff(at), kind="stable")
        length = np.diff(at)[rows]
        begin = at[:-1][rows]
        longest = int(length[0]) if len(length) else 0
        emit = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30).astype(np.float64))], axis=1)  # bad, good
        forward = np.zeros((len(score), 2))
        scale = np.ones(len(score))
        move = np.exp(self.step)
        active = np.searchsorted(-length, -np.arange(longest), "left")  # rows with more than t lines
        for t in range(longest):
            now = begin[: active[t]] + t
            f = emit[now] * (np.exp(self.start) if t == 0 else forward[now - 1] @ move)
            scale[now] = f.sum(1)
            forward[now] = f / scale[now, None]
        backward = np.ones((len(score), 2))
        for t in range(longest - 2, -1, -1):
            now = begin[: active[t + 1]] + t
            backward[now] = (emit[now + 1] * backward[now + 1]) @ move.T / scale[now + 1, None]
        both = forward * backward
        good = both[:, 1] / both.sum(1)
        if not pairs:
            return good
        inner = np.ones(len(score), bool)
        inner[at[:-1][np.diff(at) > 0]] = False
        k = np.flatnonzero(inner)
        joint = forward[k - 1][:, :, None] * move * (emit[k] * backward[k] / scale[k, None])[:, None, :]
        return good, joint.sum(0), np.log(scale).sum()

    def fit(self, features: np.ndarray, truth: np.ndarray, at: np.ndarray, rounds: int = 250, penalty: float = 1.0, rate: float = 0.05) -> Crf:
        """Adam over the whole sample."""
        self.mean, self.deviation = features.mean(0), features.std(0) + 1e-3
        self.mean[-1], self.deviation[-1] = 0, 1
        x = (features - self.mean) / self.deviation
        first = at[:-1][np.diff(at) > 0]
        inner = np.ones(len(truth), bool)
        inner[first] = False
        k = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (truth[k - 1], truth[k]), 1)
        begun = np.bincount(truth[first], minlength=2)
        size = WIDTH + 6
        p, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        for r in range(1, rounds + 1):
            self.w, self.start, self.step = p[:WIDTH], p[WIDTH : WIDTH + 2], p[WIDTH + 2 :].reshape(2, 2)
            good, joint, _ = self.marginals(x @ self.w.astype(np.float32), at, True)
            g = np.concatenate([x.T @ (truth - good), begun - np.array([(1 - good[first]).sum(), good[first].sum()]), (seen - joint).ravel()])
            g = (g - penalty * p) / len(truth)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        self.w, self.start, self.step = p[:WIDTH], p[WIDTH : WIDTH + 2], p[WIDTH + 2 :].reshape(2, 2)
        return self


def first_lines(raw: np.ndarray, most: int) -> np.ndarray:
    """The bytes up to the line feed after ``most`` lines, white space aside."""
    feeds = np.flatnonzero(raw == 10)
    if len(feeds) < most:
        return raw
    solid = np.concatenate([[0], np.cumsum(~BREAK[raw])])
    full = np.flatnonzero(np.diff(solid[np.concatenate([[0], feeds])]) > 0)
    return raw[: feeds[full[most - 1]]] if len(full) >= most else raw


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_lines: int = TRAIN_LINES) -> Crf:
    h = F.xxhash64(F.lit("crf"), F.col("doc_id"))
    known = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select(F.col("doc_id").alias("of"), F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    wanted = {k: max(LEAST, round(2 * sample * n / sum(counts.values()))) for k, n in counts.items()}
    each = [known.filter(F.col("quality") == k).orderBy(F.xxhash64(F.lit("crf"), F.col("of")), "of").limit(wanted.get(k, 0)) for k in (0, 1)]
    chosen = common.stored(each[0].unionByName(each[1]), "crf-sample")
    text = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("quality", "text", h.alias("h"))
    one = Window.partitionBy("quality", "h").orderBy("text")  # of repeated rows one is enough
    text = text.withColumn("place", F.row_number().over(one)).filter("place = 1").drop("place")

    def run(batches):
        hasher = common.RunHasher()
        for batch in batches:
            for i, j, raw, offsets in common.pieces(common.column(batch, "text")):
                heads = [first_lines(raw[s:e], train_lines) for s, e in zip(offsets[:-1], offsets[1:])]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in heads])])
                f, _, at = line_features(np.concatenate(heads), offsets, hasher)
                values = pa.ListArray.from_arrays(pa.array(at * WIDTH, pa.int32()), pa.array(f.ravel(), pa.float32()))
                made = pa.RecordBatch.from_arrays([common.column(batch, c).slice(i, j - i) for c in ("quality", "h")] + [values], names=["quality", "h", "f"])
                yield made.filter(pa.array(np.diff(at) > 0))

    rows = text.mapInArrow(run, "quality int, h long, f array<float>").collect()  # 2 * sample * train_lines * WIDTH numbers at most
    rows.sort(key=lambda r: (r["h"], r["quality"], len(r["f"]), r["f"]))
    if len({r["quality"] for r in rows}) < 2:
        return Crf()
    f = [np.array(r["f"], np.float32).reshape(-1, WIDTH) for r in rows]
    truth = np.concatenate([np.full(len(x), r["quality"]) for x, r in zip(f, rows)])
    return Crf().fit(np.concatenate(f), truth, np.concatenate([[0], np.cumsum([len(x) for x in f])]))


SCHEMA = "quality double, n_lines long, n_good long"


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """(row, quality, n_lines, n_good) of each row; ``row`` holds the caller's columns. Only the text goes to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model, hasher = shared.value, common.RunHasher()
        with common.tidy():
            for texts in batches:
                found = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for _, _, raw, offsets in common.pieces(texts):
                    lines = Lines(raw, offsets, hasher)
                    p = model.marginals(model.scores(lines), lines.at)
                    weight = common.row_sums(lines.length.astype(np.float64), lines.at)
                    found.append((common.row_sums(p * lines.length, lines.at) / np.maximum(weight, 1), np.diff(lines.at), common.row_sums(p >= 0.5, lines.at)))
                yield pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names)

    judge = F.arrow_udf(run, T.StructType.fromDDL(SCHEMA)).asNondeterministic()  # so that the planner calls it once
    return common.packed(docs).withColumn("found", judge(F.col("row.text"))).select("row", "found.*")


def keep(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """``docs`` whose quality is ``least`` or more, columns unchanged."""
    return score(docs, train(docs, labels)).filter(F.col("quality") >= least).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, common.table(spark, sf_dir, "labels"))).filter(F.col("quality") >= KEEP)
    return scored.select(F.col("row.doc_id").alias("doc_id"), "quality", "n_lines", "n_good")
