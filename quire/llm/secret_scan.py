"""Secret scan: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

A candidate is a run of at least ``MIN_LENGTH`` letters, digits, ``_ - + /`` (ASCII). First-order models, one for each
alphabet of random strings and one of ordinary identifiers, are trained from labelled samples with add-half smoothing;
the score is the best random model's log-likelihood less the ordinary model's, and a candidate scores as a secret if
it reaches ``threshold`` nats in all and ``per_character`` nats a character, and has at least ``DISTINCT`` different
characters (rulers and padding are no secrets). A run that doesn't score as a whole may hold secrets among ordinary words, as
paths and URLs do: its segment of the largest sum under one random model, widened to the ``/ - _ +`` around it, is
judged alike, with ``INSIDE`` nats more for the choice of its place, and so is what remains on either side.

The labelled samples are bounded by ``SAMPLE``. Random strings, ``SAMPLE`` / 10 of each alphabet, come from a seeded generator.
Ordinary ones are ``SAMPLE`` words of the corpus at most (letters only, hence no keys; those with the smallest hashes of the
``WORD_DOCS`` documents with the smallest hashes), as many identifiers and paths made of them, and ``SAMPLE`` / 4 numbers,
which are no secrets however long.

Positions are byte offsets in the UTF-8 text, end exclusive; what is found is reported with all but 4 characters masked.

Defined results: null, empty and short texts have no findings; a string that occurs twice is reported twice; repeated rows are
scanned each; without any word to learn from, the ordinary model knows numbers only; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LENGTH = 20
SAMPLE = 4000
WORD_DOCS = 200
THRESHOLD = 10.0
PER_CHARACTER = 0.25
INSIDE = 5.0
DISTINCT = 6
CHARACTERS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-+/"
SIZE = len(CHARACTERS) + 1
#: Index of each byte, 0 for what ends a run.
CODE = np.zeros(256, np.int64)
CODE[list(CHARACTERS.encode())] = np.arange(1, SIZE)
ALPHABETS = {"hex": CHARACTERS[:16], "upper_hex": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": CHARACTERS[:36], "base62": CHARACTERS[:62], "base64": CHARACTERS[:62] + "+/", "base64_url": CHARACTERS[:62] + "_-"}


def random_samples(n: int = SAMPLE, seed: int = 11) -> list[tuple[str, str]]:
    """(kind, string) of seeded random strings."""
    rng = np.random.default_rng(seed)
    return [(kind, "".join(rng.choice(list(letters), rng.integers(MIN_LENGTH, 65)))) for kind, letters in ALPHABETS.items() for _ in range(n // 10)]


def ordinary_samples(words: list[str], n: int = SAMPLE, seed: int = 12) -> list[tuple[str, str]]:
    """("ordinary", string) of words, identifiers and paths made of them, and numbers."""
    rng = np.random.default_rng(seed)
    made = list(words[:n])
    for k in range(n if words else 0):
        some = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 6))]
        number = [str(rng.integers(0, 3000))] if rng.random() < 0.3 else []
        joined = (("_", "-", "/", "", "")[k % 5]).join([w.capitalize() if k % 5 == 4 else w for w in some] + number)
        made.append(joined.upper() if rng.random() < 0.1 else joined)
    for _ in range(n // 4):
        made.append("".join(map(str, rng.integers(0, 10, rng.integers(4, 33)))))
    return [("ordinary", x) for x in made]


def corpus_words(docs: DataFrame, n: int = SAMPLE, word_docs: int = WORD_DOCS) -> list[str]:
    """``n`` distinct ASCII words at most, those with the smallest hashes, of the ``word_docs`` documents with the smallest."""
    some = docs.filter("text IS NOT NULL").select("text", F.xxhash64(F.lit("secret"), F.col("doc_id")).alias("h")).orderBy("h", "text").limit(word_docs).select("text")
    word = some.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9])[a-z]{2,30}(?![a-z0-9])"), F.lit(0)))).alias("w")).distinct()
    return [r["w"] for r in word.orderBy(F.xxhash64("w"), "w").limit(n).collect()]


class Model:
    """ratio[k, previous, next]: log-likelihood of random kind k less that of ordinary strings."""

    def __init__(self, samples: list[tuple[str, str]]) -> None:
        self.kinds = sorted({k for k, _ in samples} - {"ordinary"})
        logs = {}
        for kind in [*self.kinds, "ordinary"]:
            counts = np.full((SIZE, SIZE), 0.5 if kind == "ordinary" else 0.02)
            for k, s in samples:
                if k == kind and s:
                    c = CODE[np.frombuffer(s.encode(), np.uint8)]
                    np.add.at(counts, (np.append(0, c[:-1]), c), 1)
            logs[kind] = np.log(counts / counts.sum(1, keepdims=True))
        self.ratio = np.stack([logs[k] - logs["ordinary"] for k in self.kinds])

    def scan(self, raw: np.ndarray, offsets: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, score and best kind of each candidate."""
        code = CODE[raw]
        starts, ends = common.runs(code > 0, offsets)
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        lengths = ends - starts
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], lengths) + np.repeat(starts, lengths)
        now = code[at]
        before = np.where(at == np.repeat(starts, lengths), 0, code[np.maximum(at, 1) - 1])
        scores = np.stack([common.row_sums(r[before, now], bounds) for r in self.ratio]) if len(starts) else np.zeros((len(self.kinds), 0))
        best = scores.argmax(0) if len(starts) else np.zeros(0, np.int64)
        return starts, ends, scores[best, np.arange(len(starts))], best


def inside(model: Model, raw: np.ndarray, start: int, end: int, threshold: float, per_character: float) -> list[tuple[int, int, float, int]]:
    """(start, end, score, kind) of the secrets among the ordinary words of one run."""
    code = CODE[raw[start:end]]
    ratio = model.ratio[:, np.append(0, code[:-1]), code]
    total = np.concatenate([np.zeros((len(ratio), 1)), np.cumsum(ratio, axis=1)], axis=1)
    cuts = np.flatnonzero(code >= CODE[ord("_")])
    found, todo = [], [(0, end - start)]
    while todo:
        low, high = todo.pop()
        if high - low < MIN_LENGTH:
            continue
        own = total[:, low : high + 1]
        gain = own - np.minimum.accumulate(own, axis=1)
        kind, e = np.unravel_index(gain.argmax(), gain.shape)
        s = low + int(own[kind, : e + 1].argmin())
        e = low + int(e)
        if gain[kind, e - low] < threshold:
            continue
        a, b = np.searchsorted(cuts, s), np.searchsorted(cuts, e)
        a = max(low, int(cuts[a - 1]) + 1 if a else 0)
        b = min(high, int(cuts[b]) if b < len(cuts) else end - start)
        score = float(total[kind, b] - total[kind, a])
        if b - a >= MIN_LENGTH and score >= threshold and score >= per_character * (b - a) and len(np.unique(code[a:b])) >= DISTINCT:
            found.append((start + a, start + b, score, int(kind)))
        a, b = min(a, s), max(b, e)
        todo += [(low, a), (b, high)]
    return found


def train(docs: DataFrame, sample: int = SAMPLE, word_docs: int = WORD_DOCS) -> Model:
    return Model(random_samples(sample) + ordinary_samples(corpus_words(docs, sample, word_docs), sample))


SCHEMA = "doc_id long, byte_start long, byte_end long, kind string, score double, masked string"


def scan(docs: DataFrame, model: Model | None = None, threshold: float = THRESHOLD, per_character: float = PER_CHARACTER) -> DataFrame:
    """One row a finding: doc_id, byte_start, byte_end, kind, score, masked."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        model = shared.value
        for batch in batches:
            ids = common.column(batch, "doc_id")
            for i, _, raw, offsets in common.pieces(common.column(batch, "text")):
                starts, ends, score, kind = model.scan(raw, offsets)
                ok = (score >= threshold) & (score >= per_character * (ends - starts))
                ok[ok] = [len(np.unique(raw[s:e])) >= DISTINCT for s, e in zip(starts[ok], ends[ok])]
                parts = [x for s, e in zip(starts[~ok].tolist(), ends[~ok].tolist()) if e - s > MIN_LENGTH for x in inside(model, raw, s, e, threshold + INSIDE, per_character)]
                starts, ends, score, kind = starts[ok], ends[ok], score[ok], kind[ok]
                if parts:
                    starts, ends, score, kind = (np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip((starts, ends, score, kind), zip(*parts)))
                    order = np.argsort(starts)
                    starts, ends, score, kind = starts[order], ends[order], score[order], kind[order]
                if len(starts):
                    row = np.searchsorted(offsets, starts, "right") - 1
                    masked = [raw[s : s + 4].tobytes().decode() + "*" * int(e - s - 4) for s, e in zip(starts, ends)]
                    made = [ids.take(pa.array(row + i)), pa.array(starts - offsets[row]), pa.array(ends - offsets[row]), pa.array([model.kinds[k] for k in kind]), pa.array(score), pa.array(masked)]
                    yield pa.RecordBatch.from_arrays(made, names=names)

    likely = F.col("text").rlike("[A-Za-z0-9_+/-]{%d}" % MIN_LENGTH)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(likely).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
