"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

Features are the shares of letter bigrams (4096 codes) and hashed trigrams (12288) over the whole lower-cased text,
taken from its UTF-8 bytes; everything that isn't a letter counts as one space. A linear model then needs no feature
vector at scoring time: a document's score is the mean weight of its n-grams, summed in integers over windows of
``common.WINDOW`` bytes, so that memory doesn't follow the longest document's length but for its text. The family is decided by one-versus-one
machines too (families are few); ties of votes go to the larger sum of margins.

Everything is fitted on all rows that have a text and a label (the column ``lang``). The rows are spread by their hashes
over blocks of ``sample`` rows a label on average, as frequent there as in the table; each block trains its machines, and a
machine's weights are the mean over the blocks, by their rows. Equal texts of a label share a block as far as it reaches.
What blocks give is summed in integers on the executors, so neither the table's layout nor its size reaches the driver.

A document is rejected (accepted = false) if it has no letters, if fewer than ``min_letters`` of its characters other
than white space are letters, as a share, or if the language is another one: fewer than ``min_known`` of its bigrams, as
a share, are known there, that is come once in ``RARE`` bigrams of the labelled texts of the predicted language at least, or its
n-grams are too rare there. For the latter, the mean log frequency of its n-grams must reach that of the labelled documents
of the language, each held out (their median; frequencies are those of the other ``FOLDS`` - 1 folds, and equal texts share
a fold), less ``slack`` nats and three standard errors for its length. A label of fewer than ``HELD_OUT`` documents has no
such limit. Medians are exact but for the steps of 1/4096 nats and 0.1 % in which their values are counted.

Defined results: null and empty texts have no language and are rejected; rows without a label are classified as any
other; if no row has a label, nothing can be identified and all are rejected; with one label only, that is the only
prediction; repeated rows get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance"}
SAMPLE = 300
MIN_LETTERS = 0.2
MIN_KNOWN = 0.6
SLACK = 2.0
FOLDS, HELD_OUT = 5, 20
RARE = 1_000_000
#: Vectors that a task holds before it passes them on.
HELD_SUMS = 256
BIGRAMS, TRIGRAMS = 1 << 12, 3 << 12
CODES = BIGRAMS + TRIGRAMS
#: Letters are 1 to 26, bytes beyond ASCII 27 to 63, all else 0.
CODE = np.array([b - 96 if 97 <= b <= 122 else 27 + (b - 0x80) % 37 if b >= 0x80 else 0 for b in range(256)], np.uint8)
#: ASCII white space counts neither as letters nor against them.
BLANK = np.array([b in b" \t\n\r\x0b\x0c" for b in range(256)])


#: Code of each three letters in 18 bits, 0 where the first two or the middle one are none.
_THREE = np.arange(1 << 18, dtype=np.uint64)
TRIGRAM = np.where((_THREE >> np.uint64(6) > 0) & (_THREE >> np.uint64(6) & np.uint64(63) > 0), BIGRAMS + ((_THREE * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) >> np.uint64(16)) % np.uint64(TRIGRAMS), 0).astype(np.uint16)
#: Fixed-point scales; a window's sum of log frequencies stays below bit ``_KNOWN``.
_FINE, _LOG, _KNOWN = 24, 20, 44


def grams(raw: np.ndarray, offsets: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigram code and trigram code at each byte of the window, 0 where there is none; letters at each byte."""
    n = end - start
    c = np.zeros(n + 2, np.uint16)
    own = CODE[raw[start : end + 2]]
    c[: len(own)] = own
    two = c[:-2] << 6 | c[1:-1]
    ends = offsets[np.searchsorted(offsets, start, "right") : np.searchsorted(offsets, end + 2, "right")] - start
    last = ends[ends <= n] - 1  # none crosses the end of its document
    two[last] = 0
    three = TRIGRAM[two.astype(np.uint32) << 6 | c[2:]]
    before = ends[(ends > 1) & (ends <= n + 1)] - 2
    three[before] = 0
    return two, three, c[:-2] > 0


def histograms(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of each text."""
    for i, j, raw, offsets in common.pieces(texts, lower=True):
        for k in range(j - i):
            own, at = raw[offsets[k] : offsets[k + 1]], np.array([0, offsets[k + 1] - offsets[k]])
            counts = np.zeros(CODES, np.int64)
            for s, e, _, _ in common.windows(at):
                two, three, _ = grams(own, at, s, e)
                counts += np.bincount(two, minlength=CODES) + np.bincount(three, minlength=CODES)
            counts[0] = 0
            codes = np.flatnonzero(counts)
            yield codes, counts[codes]


def labelled_sample(docs: DataFrame, sample: int) -> list:
    """(lang, codes, counts) of ``sample`` rows of each label at most, for trials; ``train`` takes all rows."""
    h = F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("lang"))
    labelled = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    rows = labelled.select("lang", h.alias("h"), "doc_id")  # no pass but the last reads texts
    by = Window.partitionBy("lang")
    # the smallest hashes: the share needed, with a margin, then the exact number
    shares = labelled.groupBy("lang").agg((F.lit(2.0 * sample + 64) / F.count(F.lit(1))).alias("share"))
    cut = shares.select(F.col("lang").alias("cut_lang"), (F.least(F.lit(1.0), "share") * (2.0**64) - 2.0**63).alias("cut"))
    few = rows.join(cut, F.col("lang") == F.col("cut_lang")).filter(F.col("h") <= F.col("cut")).select("lang", "h", "doc_id").distinct().withColumn("place", F.row_number().over(by.orderBy("h", "doc_id"))).filter(F.col("place") <= sample)
    few = common.stored(few.select(F.col("lang").alias("of"), F.col("h").alias("key")).distinct(), "language-sample")

    def count(batches):
        for batch in batches:
            found = list(histograms(common.column(batch, "text")))
            if not found:
                continue
            yield pa.RecordBatch.from_arrays([common.column(batch, "lang"), *(pa.array([x.astype(np.int32).tobytes() for x in column], pa.binary()) for column in zip(*found))], names=["lang", "codes", "counts"])

    texts = labelled.filter("text IS NOT NULL").select("lang", "text", h.alias("h")).join(F.broadcast(few), (F.col("lang") == F.col("of")) & (F.col("h") == F.col("key")), "left_semi")
    one = Window.partitionBy("lang", "h").orderBy("text")  # of repeated rows one is enough
    texts = texts.withColumn("place", F.row_number().over(one)).filter("place = 1")
    rows = texts.select("lang", "text").mapInArrow(count, "lang string, codes binary, counts binary").collect()
    return [{"lang": r["lang"]} | {c: np.frombuffer(r[c], np.int32) for c in ("codes", "counts")} for r in rows]


def svm(codes: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, rounds: int = 60, c: float = 10.0) -> np.ndarray:
    """Weights, the bias last, of a linear support vector machine with L1 loss, by dual coordinate descent in a fixed order; rows are sparse."""
    norm = np.array([v @ v for v in values]) + 1
    alpha, w, bias = np.zeros(len(y)), np.zeros(CODES), 0.0
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            at, v = codes[i], values[i]
            new = min(max(alpha[i] + (1 - y[i] * (float(w[at] @ v) + bias)) / norm[i], 0.0), c)
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * v
                bias += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def contests(languages: list[str], families: dict[str, str]) -> list[tuple[str, str, str]]:
    """(family or "family", a, b) of each machine."""
    of = {v: families.get(v, v) for v in languages}
    groups = [("family", sorted(set(of.values())))] + [(f, [v for v in languages if of[v] == f]) for f in sorted(set(of.values()))]
    return [(name, a, b) for name, members in groups for a, b in combinations(members, 2)]


def machines(lang: np.ndarray, codes: list[np.ndarray], counts: list[np.ndarray], pairs: list[tuple[str, str, str]], families: dict[str, str]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(index of the machine, rows, weights and bias for shares) of each machine for both of whose sides there are rows."""
    values = [n / max(1, n.sum(dtype=np.int64)) for n in counts]
    square = np.bincount(np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0), *(v * v for v in values)]), CODES) / max(1, len(codes))
    scale = 1 / np.maximum(np.sqrt(square), 1e-4) / np.sqrt(CODES)
    values = [v * scale[at] for at, v in zip(codes, values)]
    family = np.array([families.get(v, v) for v in lang], object)
    for k, (name, a, b) in enumerate(pairs):
        truth = family if name == "family" else lang
        own = np.flatnonzero((truth == a) | (truth == b))
        y = np.where(truth[own] == a, 1.0, -1.0)
        if len(own) and y.min() < y.max():
            w = svm([codes[i] for i in own], [values[i] for i in own], y)
            w[:-1] *= scale
            yield k, len(own), w


def frequencies(counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Log frequencies of the bigrams and of the trigrams, add-half smoothed; ``counts`` are of ``codes``."""
    x = np.full(CODES, 0.5)
    x[codes] += counts
    return np.log(np.concatenate([x[:BIGRAMS] / x[:BIGRAMS].sum(), x[BIGRAMS:] / x[BIGRAMS:].sum()]))


def held_out(counts: np.ndarray, codes: np.ndarray) -> tuple[float, float]:
    """Median of the documents' mean log frequencies under the rest of them, and its spread for one n-gram."""
    counts = counts[counts.sum(1) > 0]
    if len(counts) < HELD_OUT:
        return -np.inf, 0.0
    mean, n, total = np.zeros(len(counts)), counts.sum(1, dtype=np.float64), counts.sum(0, dtype=np.float64)
    fold = np.arange(len(counts)) % FOLDS
    for k in range(FOLDS):
        own = counts[fold == k]
        mean[fold == k] = own @ frequencies(total - own.sum(0, dtype=np.float64), codes)[codes] / n[fold == k]
    middle = np.median(mean)
    return float(middle), float(1.4826 * np.median(np.abs(mean - middle) * np.sqrt(n)))


def known_bigrams(counts: np.ndarray) -> np.ndarray:
    """Which bigrams come once in ``RARE`` at least."""
    two = counts[:BIGRAMS]
    return two * RARE >= np.maximum(two.sum(), 1)


class Model:
    """Pairwise machines between families and, within each, between its languages; ``known`` marks each language's bigrams, ``log`` and ``usual`` hold its log frequencies and what held-out documents reach.

    ``fitted`` has the languages, and ``weights``, ``known``, ``log`` and ``usual``; without it they come from ``rows``."""

    def __init__(self, rows: list, families: dict[str, str] = FAMILIES, fitted: tuple | None = None) -> None:
        self.languages = fitted[0] if fitted else sorted({r["lang"] for r in rows})
        self.of = {lang: families.get(lang, lang) for lang in self.languages}
        self.families = sorted(set(self.of.values()))
        self.pairs: list[tuple[str, str, str]] = contests(self.languages, families)
        if fitted:
            _, self.weights, self.known, self.log, self.usual = fitted
            return
        self.weights = np.zeros((len(self.pairs), CODES + 1), np.float32)
        self.known = np.zeros((len(self.languages), BIGRAMS), bool)
        self.usual, self.log = [], []
        every = np.arange(CODES)
        for k, name in enumerate(self.languages):
            own = [r for r in rows if r["lang"] == name]
            x = np.zeros((len(own), CODES), np.float32)
            for i, r in enumerate(own):
                x[i, r["codes"]] = r["counts"]
            total = x.sum(0, dtype=np.float64)
            self.known[k] = known_bigrams(total)
            # rows come sorted; the folds must not follow that order
            self.usual.append(held_out(x[np.random.default_rng(5).permutation(len(own))], every))
            self.log.append(frequencies(total, every))
        lang = np.array([r["lang"] for r in rows], object)
        for k, _, w in machines(lang, [r["codes"] for r in rows], [r["counts"] for r in rows], self.pairs, families):
            self.weights[k] = w

    def choose(self, name: str, members: list[str], margins: np.ndarray) -> np.ndarray:
        """Index into ``members`` of the winner for every row."""
        votes = np.zeros((len(margins), len(members)))
        for k, (group, a, b) in enumerate(self.pairs):
            if group == name:
                m = margins[:, k]
                for member, sign in ((a, m), (b, -m)):
                    votes[:, members.index(member)] += (sign > 0) + 1e-6 * np.tanh(sign)
        return votes.argmax(1)

    def predict(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per row: language index (-1: none), the smaller of the family's and the language's margin, share of letters, share of known bigrams."""
        return self.judge(raw, offsets)[:4]

    def tables(self) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        """Weights of each machine and their scales, and each language's log frequencies and known bigrams, in integers, so that sums don't depend on where windows end."""
        most = np.maximum(np.abs(self.weights[:, :-1]).max(1, initial=0), 1e-30)
        weights = np.rint(self.weights[:, :-1] / most[:, None] * (1 << _FINE)).astype(np.int32)
        logs = [np.rint(-v * (1 << _LOG)).astype(np.int64) for v in self.log]
        for v, known in zip(logs, self.known):
            v[:BIGRAMS] += known.astype(np.int64) << _KNOWN
        for v in [*weights, *logs]:
            v[0] = 0  # no n-gram
        return list(weights), most / (1 << _FINE), logs

    def judge(self, raw: np.ndarray, offsets: np.ndarray, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``predict`` gives, and how far the mean log frequency of the n-grams is above the language's limit."""
        if not hasattr(self, "held"):
            self.held = self.tables()
        weights, scale, logs = self.held
        rows, languages = len(offsets) - 1, len(self.languages)
        sums = np.zeros((len(weights), rows), np.int64)
        log, seen = np.zeros((languages, rows), np.int64), np.zeros((languages, rows), np.int64)
        twos, n, letters, solid = np.zeros((4, rows), np.int64)
        for s, e, own, at in common.windows(offsets):
            two, three, letter = grams(raw, offsets, s, e)
            add = lambda x: np.add.reduceat(x, at, dtype=np.int64)  # noqa: B023, E731
            has = two > 0
            twos[own] += add(has)
            n[own] += add(has.astype(np.uint8) + (three > 0))
            letters[own] += add(letter)
            solid[own] += add(~BLANK[raw[s:e]])
            for k, w in enumerate(weights):
                sums[k, own] += add(w[two] + w[three])
            for k, v in enumerate(logs):
                both = add(v[two] + v[three])
                seen[k, own] += both >> _KNOWN
                log[k, own] += both & (1 << _KNOWN) - 1
        whole = np.maximum(n, 1)
        margins = (sums * scale[:, None] / whole + self.weights[:, -1:]).T
        lang = np.full(rows, -1)
        if self.languages:
            family = self.choose("family", self.families, margins)
            for f, name in enumerate(self.families):
                members = [v for v in self.languages if self.of[v] == name]
                best = self.choose(name, members, margins)
                lang = np.where(family == f, np.array([self.languages.index(v) for v in members])[best], lang)
        lang = np.where(letters > 0, lang, -1)
        margin = np.full(rows, np.inf)
        for k, (group, a, b) in enumerate(self.pairs):
            own = [v for v in self.languages if group == "family" and self.of[v] in (a, b)] or [a, b]
            mine = np.isin(lang, [self.languages.index(v) for v in own])
            margin = np.where(mine, np.minimum(margin, np.abs(margins[:, k])), margin)
        known, excess = np.zeros(rows), np.full(rows, np.nan)
        for k, (middle, spread) in enumerate(self.usual):
            mean = -log[k] / (1 << _LOG) / whole
            known = np.where(lang == k, seen[k] / np.maximum(twos, 1), known)
            excess = np.where(lang == k, mean - middle + slack + 3 * spread / np.sqrt(whole), excess)
        return lang, margin, letters / np.maximum(solid, 1), known, excess


def compact(x: np.ndarray) -> bytes:
    """Integers in a byte each, if they allow it, else in four."""
    return x.astype(np.uint8 if x.max(initial=0) < 256 else np.int32).tobytes()


def expanded(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8 if len(raw) == n else np.int32)


def summed(rows: DataFrame) -> DataFrame:
    """(name, sums): the sums of the vectors of each name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, raw in zip(common.column(batch, "name").to_pylist(), common.column(batch, "sums")):
                own = np.frombuffer(raw.as_buffer(), np.int64)
                sums[name] = sums[name] + own if name in sums else own.copy()
        for name, own in sums.items():
            yield vectors({name: own})

    return rows.repartition("name").mapInArrow(run, "name string, sums binary")


def vectors(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["name", "sums"])


def fitted_on(labelled: DataFrame, languages: list[str], block: int, parts: int, families: dict[str, str]) -> dict[str, np.ndarray]:
    """Sums over all rows, by name: w<machine>, weights, bias and rows, each but the last times the rows; c<language>,<fold>, counts of the codes."""
    pairs, index = contests(languages, families), {v: k for k, v in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with common.tidy():
            for batch in batches:
                made = [(len(c), np.diff(c, prepend=0).astype(np.uint16).tobytes(), compact(n)) for c, n in histograms(common.column(batch, "text"))]
                columns = [pa.array(v, t) for v, t in zip(zip(*made), (pa.int32(), pa.binary(), pa.binary()))] if made else [pa.array([], t) for t in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in ("lang", "h", "fold")), *columns], names=["lang", "h", "fold", "n", "codes", "counts"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: list[tuple[str, np.ndarray, np.ndarray]] = []

        def solve(own: list) -> None:
            for k, n, w in machines(np.array([r[0] for r in own], object), [r[1] for r in own], [r[2] for r in own], pairs, families):
                total = sums.setdefault(f"w{k}", np.zeros(CODES + 2, np.int64))
                total += np.append(np.rint(w * (1 << _LOG)).astype(np.int64), 1) * n

        with common.tidy():
            for batch in batches:
                for lang, fold, n, codes, counts in zip(*(common.column(batch, c).to_pylist() for c in ("lang", "fold", "n", "codes", "counts"))):
                    codes, counts = np.cumsum(np.frombuffer(codes, np.uint16), dtype=np.int32), expanded(counts, n)
                    sums.setdefault(f"c{index[lang]},{fold}", np.zeros(CODES, np.int64))[codes] += counts
                    rows.append((lang, codes, counts))
                    if len(rows) >= block + block // 2 + 1:  # what stays is half a block at least
                        solve(rows[:block])
                        rows = rows[block:]
                    if len(sums) > HELD_SUMS:
                        yield vectors(sums)
                        sums.clear()
            solve(rows)
            for name in list(sums):
                yield vectors({name: sums.pop(name)})

    rows = labelled.mapInArrow(count, "lang string, h long, fold int, n int, codes binary, counts binary")
    rows = rows.repartition(parts, "h").sortWithinPartitions("h", "lang")
    return {r["name"]: np.frombuffer(r["sums"], np.int64) for r in summed(rows.mapInArrow(fit, "name string, sums binary")).collect()}


def held_out_limits(labelled: DataFrame, languages: list[str], counts: np.ndarray) -> list[tuple[float, float]]:
    """For each language what ``held_out`` gives, over all rows; ``counts`` are by language and fold."""
    rest, every, index = counts.sum(1, keepdims=True) - counts, np.arange(CODES), {v: k for k, v in enumerate(languages)}
    tables = np.stack([np.rint(-frequencies(x, every) * (1 << _LOG)).astype(np.int32) for x in rest.reshape(-1, CODES)])
    tables[:, 0] = 0  # no n-gram
    shared = labelled.sparkSession.sparkContext.broadcast(tables.ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with common.tidy():
            for batch in batches:
                slots = np.array([index[v] for v in common.column(batch, "lang").to_pylist()], np.int64) * FOLDS + common.column(batch, "fold").to_numpy()
                for i, j, raw, offsets in common.pieces(common.column(batch, "text"), lower=True):
                    total, n = np.zeros((2, j - i), np.int64)
                    for s, e, own, at in common.windows(offsets):
                        two, three, _ = grams(raw, offsets, s, e)
                        base = np.repeat(slots[i:j][own] * CODES, np.diff(np.append(at, e - s)))
                        total[own] += np.add.reduceat(shared.value[base + two].astype(np.int64) + shared.value[base + three], at)
                        n[own] += np.add.reduceat((two > 0).astype(np.int64) + (three > 0), at)
                    has = n > 0
                    yield pa.RecordBatch.from_arrays([common.column(batch, "lang").slice(i, j - i).filter(pa.array(has)), pa.array(-total[has] / n[has] / (1 << _LOG)), pa.array(n[has])], names=["lang", "mean", "n"])

    means = common.stored(labelled.mapInArrow(run, "lang string, mean double, n long"), "means")
    # few distinct values, so that an exact median holds little
    middle = means.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.median(F.round(F.col("mean") * 4096) / 4096).alias("middle")).collect()
    found = {r["lang"]: r["middle"] for r in middle if r["rows"] >= HELD_OUT}
    if not found:
        return [(-np.inf, 0.0)] * len(languages)
    middles = labelled.sparkSession.createDataFrame(list(found.items()), "lang string, middle double")
    far = F.greatest(F.abs(F.col("mean") - F.col("middle")) * F.sqrt("n"), F.lit(1e-9))
    spread = means.join(F.broadcast(middles), "lang").groupBy("lang").agg(F.median(F.exp(F.round(F.log(far) * 1000) / 1000)).alias("spread")).collect()
    spread = {r["lang"]: 1.4826 * r["spread"] for r in spread}
    return [(found[v], spread[v]) if v in found else (-np.inf, 0.0) for v in languages]


def train(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> Model:
    """A model of all labelled rows, from blocks of ``sample`` rows a label on average."""
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("lang", "text").alias("h"), F.pmod(F.xxhash64(F.lit("fold"), "text"), F.lit(FOLDS)).cast("int").alias("fold"))
    rows = {r["lang"]: r["count"] for r in docs.filter("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().collect()}
    languages = sorted(rows)
    if not languages:
        return Model([], families)
    block = sample * len(languages)
    sums = fitted_on(labelled, languages, block, max(1, sum(rows.values()) // (4 * block)), families)
    weights = np.zeros((len(contests(languages, families)), CODES + 1), np.float32)
    for k in range(len(weights)):
        if f"w{k}" in sums:
            own = sums[f"w{k}"]
            weights[k] = own[:-1] / own[-1] / (1 << _LOG)
    counts = np.stack([[sums.get(f"c{k},{f}", np.zeros(CODES, np.int64)) for f in range(FOLDS)] for k in range(len(languages))])
    total = counts.sum(1)
    log = [frequencies(x, np.arange(CODES)) for x in total]
    return Model([], families, (languages, weights, np.stack([known_bigrams(x) for x in total]), log, held_out_limits(labelled, languages, counts)))


SCHEMA = "language string, family string, margin double, letters double, known double, excess double, accepted boolean"


def verdict(model: Model, spark: SparkSession, min_letters: float = MIN_LETTERS, min_known: float = MIN_KNOWN, slack: float = SLACK) -> Callable[[Column], Column]:
    """A function of a text, a struct of ``SCHEMA``; only the text goes to Python and only the struct comes back."""
    shared = spark.sparkContext.broadcast(model)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        with common.tidy():
            for texts in batches:
                parts = [model.judge(raw, offsets, slack) for _, _, raw, offsets in common.pieces(texts, lower=True)] or [(np.zeros(0),) * 5]
                lang, margin, letters, known, excess = (np.concatenate(p) for p in zip(*parts))
                language = [model.languages[v] if v >= 0 else None for v in lang.astype(int)]
                accepted = (lang >= 0) & (letters >= min_letters) & (known >= min_known) & (excess >= 0)
                made = [pa.array(language, pa.string()), pa.array([model.of.get(v) for v in language], pa.string()), pa.array(np.where(np.isfinite(margin), margin, np.nan)), pa.array(letters), pa.array(known), pa.array(excess), pa.array(accepted)]
                yield pa.StructArray.from_arrays(made, names)

    # not deterministic for the planner: it must not be called once in a filter and once more in a projection
    return F.arrow_udf(run, T.StructType.fromDDL(SCHEMA)).asNondeterministic()


def identify(docs: DataFrame, model: Model | None = None, min_letters: float = MIN_LETTERS, min_known: float = MIN_KNOWN, slack: float = SLACK) -> DataFrame:
    """(row, language, family, margin, letters, known, excess, accepted) of each row; ``row`` holds the caller's columns."""
    judge = verdict(model or train(docs), docs.sparkSession, min_letters, min_known, slack)
    return common.packed(docs).withColumn("found", judge(F.col("row.text"))).select("row", "found.*")


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the rejected documents, columns unchanged."""
    return identify(docs, model).filter("accepted").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).filter("accepted").select(F.col("row.doc_id").alias("doc_id"), "language", "family", "margin", "known")
