"""Near-duplicate self join by Jaccard similarity of word n-grams, searched with signature trees.

1. Each text becomes the set of its distinct word ``n``-grams (lower case, runs of letters and digits; a text of fewer
   words is one n-gram of all of them), as 53-bit hashes. Texts with equal sets are one *node* from here on.
2. Every node is routed to its ``route`` smallest n-gram hashes, however many others hold them. Two sets of similarity J
   share no routing n-gram with probability (1 - J) ** route at most.
3. The nodes that meet at an n-gram form a signature tree: sorted by size, 32 to a leaf, 8 children to an inner node,
   each with the OR of its members' token bitmaps and its range of sizes (32 nodes or fewer are a tree of one leaf, whose
   members are compared by their own bitmaps and sizes). A traversal of the tree against itself drops every pair of tree
   nodes whose largest possible overlap can't reach the threshold. Where more than ``block`` nodes meet, they are split
   into as many trees as that takes, and every two of them are a task of their own.
4. Pairs of members must also agree in the sketches: the least hash of each of ``BINS`` bins, one byte each. Of the bins
   that either set fills, as a share no less may agree than the threshold less 4.5 standard deviations.
5. What stays isn't listed but ties nodes to components, so that a group of n near copies gives n ties and not n² / 2
   pairs: a task returns its pairs contracted to stars, and where many meet, a few of them are compared with all first;
   members of the largest component that this makes aren't compared with each other any more.
6. All pairs of a component are verified with the exact sets, read again from the texts, by products of their incidence
   matrices. Each set goes once to the task of its component; components of more than ``cell`` n-grams or ``CELL_NODES``
   nodes are cut into blocks, and every two blocks are a task of their own. A task returns the pairs, or only what the
   query needs of them: each node's number of partners, and stars of the nodes that pairs connect.
7. The query returns a row for each document: its class, the smallest doc_id of the documents that pairs connect it with,
   and its number of links, which is that of the documents it makes a pair with. Rows grow as the documents do; ``join``
   gives the pairs themselves. Copies are counted, not expanded.

The search is approximate in steps 2 and 4 only; with the defaults a pair at the threshold is missed in 1 case in 20,000
(step 2: 0.6 ** 20, step 4: about 1 in 100,000) whatever the number of documents that share its n-grams, a closer pair
far less often. There is no cap on partners or candidates, and no rule that depends on how many documents there are.

Defined results: a text without a word, an empty or a null text has no partner; repeated rows of one doc_id are one
document and make no pair with themselves; rows with a null doc_id make no pair and are never removed; an empty table
has no pairs; a doc_id with several texts is a member of each of their groups, which makes them one class, and a partner
of both counts as one link; a document without a partner is its own class with 0 links; doc_ids are integers or strings
of them, and rows without one are in no class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 5
THRESHOLD = 0.4
ROUTE = 20
BINS = 128
WORDS = 8
BLOCK = 2048
CELL = 2_000_000
CELL_NODES = 2048
#: N-grams that more sets of a cell hold are counted by products of matrices, ``SLAB`` at a time; the rest set by set.
OFTEN, SLAB = 32, 1024
#: Of the nodes that meet where more than ``MANY`` do, so many are compared with all first.
MANY, LEADERS = 128, 16
LEAF, FAN = 32, 8
BROADCAST_ROWS = 300_000
LOCAL_EDGES = 2_000_000
_HASH_BITS = 53
IS_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, n: int, hasher: common.RunHasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every row, ascending within the row, and the rows' offsets into them."""
    starts, ends = common.runs(IS_WORD[raw], offsets)
    words = hasher(raw, starts, ends)
    rows = len(offsets) - 1
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    grams = np.where(count > 0, np.maximum(count - n + 1, 1), 0)
    row = np.repeat(np.arange(rows), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + first[row]
    end = first[row + 1]
    value = np.zeros(len(row), np.uint64)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    with np.errstate(over="ignore"):
        for k in range(n):
            value = (value * np.uint64(0xD6E8FEB86659FD93)) ^ np.where(at + k < end, padded[at + k], np.uint64(0))
            value = value ^ (value >> np.uint64(29))
        value = common.mix(value) >> np.uint64(64 - _HASH_BITS)
    keys = np.sort((row.astype(np.uint64) << np.uint64(_HASH_BITS)) | value)
    keys = keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]
    at = np.searchsorted(keys, np.arange(rows + 1).astype(np.uint64) << np.uint64(_HASH_BITS))
    return keys & np.uint64((1 << _HASH_BITS) - 1), at


def set_ids(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each whole set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(grams + np.uint64(0x51ED270B)))])
        return common.mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64)))


def bin_sketch(mixed: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row and bin a byte of the least hash that falls into it, 0 for an empty bin."""
    least = np.full(rows * BINS, np.uint64(2**64 - 1))
    np.minimum.at(least, row * BINS + (mixed >> np.uint64(9) & np.uint64(BINS - 1)).astype(np.int64), mixed >> np.uint64(16))
    return np.where(least == np.uint64(2**64 - 1), 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8).reshape(rows, BINS)


def rows_of(matrix: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(matrix))])


def sketches(docs: DataFrame, n: int, route: int) -> DataFrame:
    """(doc_id, sid, size, grams, bits, sketch) of each row that has a word; sid is a hash of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = common.RunHasher()
        with common.tidy():
            for batch in batches:
                ids = common.column(batch, "doc_id")
                for i, j, raw, offsets in common.pieces(common.column(batch, "text"), lower=True, most=common.CHUNK // 2):
                    # a chunk has 1024 rows at most, so row and hash fit in 64 bits
                    grams, at = shingle_sets(raw, offsets, n, hasher)
                    size, sid, mixed = np.diff(at), set_ids(grams, at), common.mix(grams)
                    row = np.repeat(np.arange(j - i), size)
                    bits = np.zeros((j - i, 8 * WORDS), np.uint8)
                    bit = (mixed & np.uint64(64 * WORDS - 1)).astype(np.int64)
                    np.bitwise_or.at(bits, (row, bit >> 3), np.left_shift(1, bit & 7).astype(np.uint8))
                    few = np.minimum(size, route)
                    pick = np.arange(few.sum()) - np.repeat(np.cumsum(few) - few, few) + np.repeat(at[:-1], few)
                    routing = lists(grams[pick], np.concatenate([[0], np.cumsum(few)]))
                    made = [ids.slice(i, j - i), pa.array(sid), pa.array(size, pa.int32()), routing, rows_of(bits), rows_of(bin_sketch(mixed, row, j - i))]
                    yield pa.RecordBatch.from_arrays(made, names=["doc_id", "sid", "size", "grams", "bits", "sketch"]).filter(pa.array(size > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").mapInArrow(run, "doc_id long, sid long, size int, grams array<long>, bits binary, sketch binary")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int32)


class Tree:
    """Levels from the leaves up; each has sizes' range, OR of bitmaps, and the most n-grams a member has beyond its set bits."""

    def __init__(self, size: np.ndarray, bits: np.ndarray) -> None:
        self.size, self.bits, self.set = size, bits, popcount(bits)
        self.levels = [self._level(np.arange(0, len(size), LEAF), size, size, bits, size - self.set)]
        while len(self.levels[-1][0]) > 1:
            low, high, ored, over = self.levels[-1]
            self.levels.append(self._level(np.arange(0, len(low), FAN), low, high, ored, over))

    @staticmethod
    def _level(at, low, high, bits, over):
        return np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.bitwise_or.reduceat(bits, at, axis=0), np.maximum.reduceat(over, at)


def children(pairs_a: np.ndarray, pairs_b: np.ndarray, fan: int, na: int, nb: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
    a = (pairs_a[:, None] * fan + np.arange(fan)).repeat(fan, axis=1).ravel()
    b = np.tile(pairs_b[:, None] * fan + np.arange(fan), (1, fan)).ravel()
    ok = (a < na) & (b < nb)
    if own:
        ok &= a <= b
    return a[ok], b[ok]


def tree_pairs(x: Tree, y: Tree, threshold: float, own: bool, step: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of members whose largest possible overlap reaches the threshold; ``own``: x is y, and each pair comes once."""
    share = threshold / (1 + threshold) - 1e-12
    depth = max(len(x.levels), len(y.levels))

    def level(t: Tree, k: int):
        return t.levels[min(k, len(t.levels) - 1)]

    def possible(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        (la, ha, oa, va), (lb, hb, ob, vb) = level(x, k), level(y, k)
        ok = (ha[a] >= threshold * lb[b]) & (hb[b] >= threshold * la[a])
        a, b, at = a[ok], b[ok], np.flatnonzero(ok)
        most = np.minimum(np.minimum(ha[a], hb[b]), popcount(oa[a] & ob[b]) + np.minimum(va[a], vb[b]))
        return at[most >= share * (la[a] + lb[b])]

    stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, a, b = stack.pop()
        if len(a) > step:
            stack += [(k, a[i : i + step], b[i : i + step]) for i in range(0, len(a), step)]
            continue
        ok = possible(k, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if k:
            fa = FAN if k <= len(x.levels) - 1 else 1
            fb = FAN if k <= len(y.levels) - 1 else 1
            if fa == fb:
                a, b = children(a, b, fa, len(level(x, k - 1)[0]), len(level(y, k - 1)[0]), own)
            else:  # the lower tree waits at its root
                wide, narrow, most = (a, b, len(level(x, k - 1)[0])) if fa > fb else (b, a, len(level(y, k - 1)[0]))
                wide = (wide[:, None] * FAN + np.arange(FAN)).ravel()
                narrow = narrow.repeat(FAN)
                wide, narrow = wide[wide < most], narrow[wide < most]
                a, b = (wide, narrow) if fa > fb else (narrow, wide)
            stack.append((k - 1, a, b))
            continue
        for i in range(0, len(a), 256):
            p, q = children(a[i : i + 256], b[i : i + 256], LEAF, len(x.size), len(y.size), own)
            if own:
                p, q = p[p < q], q[p < q]
            yield member_pairs(x, y, p, q, threshold)


def member_pairs(x, y, p, q, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs those that sizes and bitmaps allow: a bit that only one bitmap has stands for one unshared n-gram at least."""
    sx, sy = x.size[p], y.size[q]
    ok = (sx >= threshold * sy) & (sy >= threshold * sx)
    p, q, sx, sy = p[ok], q[ok], sx[ok], sy[ok]
    both = popcount(x.bits[p] & y.bits[q])
    most = np.minimum(sx - x.set[p] + both, sy - y.set[q] + both)
    ok = most >= (threshold / (1 + threshold) - 1e-12) * (sx + sy)
    return p[ok], q[ok]


class Flat:
    """Members without a tree, for many groups of at most one leaf each."""

    def __init__(self, size: np.ndarray, bits: np.ndarray) -> None:
        self.size, self.bits, self.set = size, bits, popcount(bits)


def sketch_pairs(sketch: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, step: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Of the index pairs those of whose filled bins enough agree; a bin agrees with the probability of the similarity, or a little more."""
    kept = []
    for i in range(0, len(p), step):
        a, b = p[i : i + step], q[i : i + step]
        x, y = sketch[a], sketch[b]
        filled = np.count_nonzero(x | y, axis=1)
        agree = np.count_nonzero((x == y) & (x > 0), axis=1)
        ok = agree >= filled * threshold - 4.5 * np.sqrt(filled * threshold * (1 - threshold))
        kept.append((a[ok], b[ok]))
    return tuple(np.concatenate(x) for x in zip(*kept)) if kept else (p, q)


def contract(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of the component of each of ``n`` indices under the edges (x, y)."""
    root = np.arange(n)
    while True:
        u, v = root[x], root[y]
        apart = u != v
        if not apart.any():
            return root
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(root, further := root[root]):
            root = further


def tied_pairs(x: Flat, sketch: np.ndarray, s: int, e: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that tie the rows ``s`` to ``e`` to the components that all their candidate pairs make, or none if that spares too little."""
    lead = np.unique(np.linspace(s, e - 1, LEADERS).astype(np.int64))
    p, q = np.repeat(lead, e - s), np.tile(np.arange(s, e), len(lead))
    p, q = sketch_pairs(sketch, *member_pairs(x, x, p[p != q], q[p != q], threshold), threshold)
    root = contract(p - s, q - s, e - s)
    inside = root == np.bincount(root).argmax()
    if 2 * np.count_nonzero(inside) < e - s:
        return
    yield p, q
    inner, outer = s + np.flatnonzero(inside), s + np.flatnonzero(~inside)
    if len(outer):
        inner, outer = inner[np.argsort(x.size[inner], kind="stable")], outer[np.argsort(x.size[outer], kind="stable")]
        tree = Tree(x.size[outer], x.bits[outer])
        yield from ((outer[a], outer[b]) for a, b in tree_pairs(tree, tree, threshold, True))
        yield from ((outer[a], inner[b]) for a, b in tree_pairs(tree, Tree(x.size[inner], x.bits[inner]), threshold, False))


def group_pairs(batches: Iterator[pa.RecordBatch], threshold: float, tied: bool = False) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of each group, or with ``tied`` such of them as connect what all connect; rows (gram, i, j, side, sid, size, bits, sketch) come sorted by group, side and size."""

    def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype)

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        get = {c: rows.column(c).combine_chunks().to_numpy() for c in ("gram", "i", "j", "side", "sid", "size")}
        bits, sketch = matrix(rows.column("bits"), np.uint64).reshape(-1, WORDS), matrix(rows.column("sketch"), np.uint8).reshape(-1, BINS)
        new = np.concatenate([[True], (get["gram"][1:] != get["gram"][:-1]) | (get["i"][1:] != get["i"][:-1]) | (get["j"][1:] != get["j"][:-1])])
        at = np.append(np.flatnonzero(new), len(new))
        length, size, sid = np.diff(at), get["size"].astype(np.int64), get["sid"]
        own = get["i"][at[:-1]] == get["j"][at[:-1]]

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            flat = Flat(size, bits)
            for k in np.unique(length[own & (length <= LEAF)]):  # all one-leaf trees of k members at once
                low, high = np.triu_indices(k, 1)
                begin = at[:-1][own & (length == k)]
                per = max(1, (1 << 18) // max(1, len(low)))
                for s in range(0, len(begin), per):
                    yield member_pairs(flat, flat, (begin[s : s + per, None] + low).ravel(), (begin[s : s + per, None] + high).ravel(), threshold)
            for g in np.flatnonzero(~own | (length > LEAF)):
                s, e = at[g], at[g + 1]
                if tied and e - s > MANY:
                    ties = tied_pairs(flat, sketch, s, e, threshold)
                    if (some := next(ties, None)) is not None:
                        yield some
                        yield from ties
                        continue
                m = s if own[g] else s + int(np.searchsorted(get["side"][s:e], 1))
                if own[g]:
                    tree = Tree(size[s:e], bits[s:e])
                    pairs = tree_pairs(tree, tree, threshold, True)
                elif s < m < e:
                    pairs = tree_pairs(Tree(size[s:m], bits[s:m]), Tree(size[m:e], bits[m:e]), threshold, False)
                else:
                    continue
                for p, q in pairs:
                    yield s + p, m + q

        for p, q in found():
            p, q = sketch_pairs(sketch, p, q, threshold)
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[p], sid[q])), pa.array(np.maximum(sid[p], sid[q]))], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    with common.tidy():
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [common.column(batch, c).to_numpy() for c in ("gram", "i", "j")]
            last = np.ones(batch.num_rows, bool)
            for k in key:
                last &= k == k[-1]
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            if cut or kept and any(common.column(kept[0], c)[0].as_py() != common.column(batch, c)[0].as_py() for c in ("gram", "i", "j")):
                yield from solve(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
                kept = []
            kept.append(batch.slice(cut))
        if kept:
            yield from solve(pa.Table.from_batches(kept))


def routed(nodes: DataFrame, route: int) -> DataFrame:
    """(gram, sid, n) rows under which nodes meet; n is the number of nodes that meet there."""
    each = nodes.select("sid", F.explode(F.slice("grams", 1, route)).alias("gram"))
    # counted with partial sums and joined back, not in a window: a hot n-gram's rows may be split over tasks
    counts = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return common.stored(each.join(counts, "gram"), "met")


def candidates(nodes: DataFrame, threshold: float, route: int = ROUTE, block: int = BLOCK, tied: bool = False) -> DataFrame:
    """Distinct (a, b), a < b, of nodes that meet and whose signatures allow the threshold; with ``tied`` only edges (a, b) that connect what these connect, few for each node and task."""
    rows = routed(nodes, route).join(nodes.select("sid", "size", "bits", "sketch"), "sid")
    # blocks by hash: a hot n-gram's rows never come together in one task but as two blocks
    of = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64(F.lit("block"), "sid"), of).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    rows = rows.select("gram", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "size", "bits", "sketch")
    rows = rows.repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j", "side", "size", "sid")
    if tied:
        return rows.mapInArrow(lambda batches: stars(group_pairs(batches, threshold, True)), "a long, b long")
    return rows.mapInArrow(lambda batches: group_pairs(batches, threshold), "a long, b long").distinct()


def placed_sets(docs: DataFrame, n: int) -> DataFrame:
    """(cells, sid, weight, grams) of each row (asked, weight, cells, text) whose whole set is the one asked for."""

    def run(batches):
        hasher = common.RunHasher()
        with common.tidy():
            for batch in batches:
                for i, j, raw, offsets in common.pieces(common.column(batch, "text"), lower=True):
                    grams, at = shingle_sets(raw, offsets, n, hasher)
                    cells, asked, weight = (common.column(batch, c).slice(i, j - i) for c in ("cells", "asked", "weight"))
                    made = pa.RecordBatch.from_arrays([cells, asked, weight, lists(grams, at)], names=["cells", "sid", "weight", "grams"])
                    yield made.filter(pa.array(set_ids(grams, at) == asked.to_numpy()))

    return docs.select("asked", "weight", "cells", "text").mapInArrow(run, "cells array<struct<root:long,i:int,j:int,side:int>>, sid long, weight long, grams array<long>")


def overlaps(grams: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Numbers of common n-grams of the first ``m`` sets with the others, or, if ``m`` is 0, of each set with those after it (entries elsewhere mean nothing)."""
    n, low = len(at) - 1, m
    high = m or n
    row = np.repeat(np.arange(n), np.diff(at))
    _, code, count = np.unique(grams, return_inverse=True, return_counts=True)
    shared = np.zeros((high, n - low), np.float32 if np.diff(at).max() < 1 << 24 else np.float64)
    often = count > (1 if n * np.count_nonzero(count > 1) <= 1 << 22 else OFTEN)
    place = np.where(often, np.cumsum(often) - 1, -1)[code]
    own = place >= 0
    order = np.argsort(place[own], kind="stable")
    held, place = row[own][order], place[own][order]
    for s in range(0, np.count_nonzero(often), SLAB):
        i, j = np.searchsorted(place, [s, s + SLAB])
        has = np.zeros((n, min(SLAB, np.count_nonzero(often) - s)), shared.dtype)
        has[held[i:j], place[i:j] - s] = 1
        shared += has[:high] @ has[low:].T
    rare = ~often[code] & (count[code] > 1)
    held = row[rare][np.argsort(code[rare], kind="stable")]
    length = count[~often & (count > 1)]
    begin = np.cumsum(length) - length
    for k in np.unique(length):
        first, last = np.triu_indices(k, 1)
        each = begin[length == k]
        step = max(1, (1 << 20) // len(first))
        for s in range(0, len(each), step):
            p, q = held[(each[s : s + step, None] + first).ravel()], held[(each[s : s + step, None] + last).ravel()]
            if m:
                cross = (p < m) & (q >= m)
                p, q = p[cross], q[cross] - m
            np.add.at(shared.reshape(-1), p * (n - low) + q, 1)
    return shared


def solve_cell(sid: np.ndarray, weight: np.ndarray, side: np.ndarray, grams: np.ndarray, at: np.ndarray, threshold: float, listed: bool) -> Iterator[pa.RecordBatch]:
    """The pairs of a cell's sets, or what is left of them; rows come by side, and two sides make pairs with each other only."""
    n, m = len(sid), int(np.count_nonzero(side != side[-1]))
    size, shared = np.diff(at).astype(np.float64), overlaps(grams, at, m)
    odd, docs = weight < 0, np.where(weight < 0, -1 - weight, weight).astype(np.float64)
    links, root = np.zeros(n), np.arange(n)
    for s in range(0, len(shared), 256):
        some = shared[s : s + 256].astype(np.float64)
        e = s + len(some)
        jaccard = some / (size[s:e, None] + size[m:] - some)
        near = jaccard >= threshold
        if not m:
            near &= np.arange(n) > np.arange(s, e)[:, None]
        p, q = np.nonzero(near)
        if not len(p):
            continue
        a, b = sid[s + p], sid[m + q]
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(jaccard[p, q])], names=["a", "b", "jaccard"])
            continue
        links[s:e] += near @ docs[m:]
        links[m:] += docs[s:e] @ near
        root = contract(np.concatenate([np.arange(n), s + p]), np.concatenate([root, m + q]), n)
        for x, y, known in ((a, b, odd[s + p]), (b, a, odd[m + q])):
            if known.any():
                yield facts(2, x[known], y[known])
    if not listed:
        yield facts(0, sid[links > 0], None, links[links > 0])
        yield facts(1, sid[root != np.arange(n)], sid[root[root != np.arange(n)]])


def facts(kind: int, a: np.ndarray, b: np.ndarray | None, n: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), none if b is None else pa.array(b), none if n is None else pa.array(np.rint(n).astype(np.int64))], names=["kind", "a", "b", "n"])


def solve_cells(batches: Iterator[pa.RecordBatch], threshold: float, listed: bool) -> Iterator[pa.RecordBatch]:
    """What ``solve_cell`` gives of each cell; its rows (root, i, j, side, sid, weight, grams) come together, by side."""
    names = ("sid", "weight", "side")
    cell, kept, sets = None, [], []

    def solve() -> Iterator[pa.RecordBatch]:
        if not kept:
            return
        sid, weight, side = (np.concatenate(x) for x in zip(*kept))
        if cell[1] != cell[2] and side[0] == side[-1]:
            return
        grams, length = (np.concatenate(x) for x in zip(*sets))
        new = np.concatenate([[True], (sid[1:] != sid[:-1]) | (side[1:] != side[:-1])])  # repeated rows bring a set again
        grams, length = grams[np.repeat(new, length)], length[new]
        yield from solve_cell(sid[new], weight[new], side[new], grams, np.append(0, np.cumsum(length)), threshold, listed)

    with common.tidy():
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([common.column(batch, c).to_numpy().astype(np.int64) for c in ("root", "i", "j")])
            columns, grams = [common.column(batch, c).to_numpy() for c in names], common.column(batch, "grams")
            values, at = grams.values.to_numpy(), grams.offsets.to_numpy()
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(0)])), batch.num_rows)
            for s, e in zip(cuts[:-1], cuts[1:]):
                if cell != (now := tuple(keys[:, s].tolist())):
                    yield from solve()
                    cell, kept, sets = now, [], []
                kept.append([x[s:e].copy() for x in columns])
                sets.append((values[at[s] : at[e]].copy(), np.diff(at[s : e + 1])))
        yield from solve()


def solved(docs: DataFrame, nodes: DataFrame, ties: DataFrame, n: int, threshold: float, cell: int, weights: DataFrame | None, listed: bool) -> DataFrame:
    members = components(ties).select("node", "root")
    members = members.unionByName(members.select(F.col("root").alias("node"), "root")).distinct()
    members = common.stored(members.join(nodes.select(F.col("sid").alias("node"), "size", "doc_id"), "node"), "members")
    blocks = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / cell), F.ceil(F.count(F.lit(1)) / CELL_NODES)).cast("int").alias("blocks"))
    # blocks by hash, so that no task holds a whole component
    own = F.pmod(F.xxhash64(F.lit("cell"), "node"), F.col("blocks")).cast("int")
    members = members.join(blocks, "root").withColumn("own", own)
    place = lambda k: F.struct("root", F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("side"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), place).alias("cells")
    members = members.join(weights, "node", "left") if weights is not None else members.withColumn("weight", F.lit(0))
    asked = members.select(F.col("node").alias("asked"), F.col("doc_id").alias("asked_id"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"), cells)
    asked = common.stored(asked, "asked")
    total = asked.agg(F.sum(F.size("cells"))).first()[0] or 0  # bounds the bytes too
    side = asked if total > BROADCAST_ROWS else F.broadcast(asked)
    texts = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, F.col("doc_id").eqNullSafe(F.col("asked_id")))
    rows = placed_sets(texts, n).select(F.explode("cells").alias("cell"), "sid", "weight", "grams").select("cell.*", "sid", "weight", "grams")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "side", "sid")
    return rows.mapInArrow(lambda batches: solve_cells(batches, threshold, listed), "a long, b long, jaccard double" if listed else "kind int, a long, b long, n long")


def verified(docs: DataFrame, nodes: DataFrame, ties: DataFrame, n: int, threshold: float, cell: int = CELL) -> DataFrame:
    """All pairs at or above the threshold of nodes that ``ties`` connects, with their exact similarity (a, b, jaccard)."""
    return solved(docs, nodes, ties, n, threshold, cell, None, True)


def counted(docs: DataFrame, nodes: DataFrame, ties: DataFrame, n: int, threshold: float, weights: DataFrame | None = None, cell: int = CELL) -> DataFrame:
    """What the pairs of ``verified`` come to, in rows (kind, a, b, n) of which there are few for each node and cell.

    0: node a has n partners, each counted with its weight, in one cell. 1: edges (a, b) that connect what the pairs connect.
    2: the pairs (a, b) of a node with a negative weight, which counts as its complement -1 - weight. ``weights`` has
    (node, weight), 0 if it is missing.
    """
    return solved(docs, nodes, ties, n, threshold, cell, weights, False)


def node_ties(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, route: int = ROUTE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, sid) of all documents that have a word; the distinct sets; the ties between these."""
    sketch = common.stored(sketches(docs, n, route), "sketches")
    nodes = sketch.groupBy("sid").agg(F.min("size").alias("size"), F.first("grams").alias("grams"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
    nodes = common.stored(nodes, "nodes")
    return sketch.select("doc_id", "sid"), nodes, common.stored(candidates(nodes, threshold, route, tied=True), "ties")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, route: int = ROUTE) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard), doc_id_a < doc_id_b: all pairs of documents at or above the threshold that the search finds."""
    members, nodes, ties = node_ties(docs, n, threshold, route)
    pairs = common.stored(verified(docs, nodes, ties, n, threshold), "verified")
    members = members.filter("doc_id IS NOT NULL").distinct()
    left = members.select(F.col("sid").alias("a"), F.col("doc_id").alias("p"))
    right = members.select(F.col("sid").alias("b"), F.col("doc_id").alias("q"))
    apart = pairs.join(left, "a").join(right, "b").filter("p <> q").select(F.least("p", "q").alias("doc_id_a"), F.greatest("p", "q").alias("doc_id_b"), "jaccard")
    equal = left.join(right, F.col("a") == F.col("b")).filter("p < q").select(F.col("p").alias("doc_id_a"), F.col("q").alias("doc_id_b"), F.lit(1.0).alias("jaccard"))
    return apart.unionByName(equal)


def stars(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from each node of the batches' edges to the smallest of its component there, itself left out."""
    nodes, label = np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def tie() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate(x) for x in zip((nodes, label), *held))
        names, code = np.unique(np.concatenate([a, b]), return_inverse=True)
        # names are sorted, so the smallest index is the smallest node
        return names, names[contract(code[: len(a)], code[len(a) :], len(names))]

    with common.tidy():
        for batch in batches:
            held.append(tuple(common.column(batch, c).to_numpy() for c in ("a", "b")))
            if sum(len(a) for a, _ in held) > most:
                nodes, label = tie()
                held.clear()
        nodes, label = tie()
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != label]), pa.array(label[nodes != label])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of (a, b); root is the smallest of its component.

    Every task first contracts the edges it reads to stars. If ``LOCAL_EDGES`` stay at most, one task does so once more, else
    large and small stars are contracted until nothing moves.
    """
    ddl = "a long, b long"
    edges = common.stored(edges.select("a", "b").filter("a <> b").mapInArrow(stars, ddl).distinct(), "edges")
    if edges.count() <= LOCAL_EDGES:
        return common.stored(edges.coalesce(1).mapInArrow(stars, ddl), "roots").toDF("node", "root")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: larger neighbours are tied to the smallest one
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = common.stored(large, "large")
        # small star: a node's smaller neighbours and itself are tied to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        small = common.stored(small, "small")
        before = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        same = small.count() == before.count() and small.exceptAll(before).isEmpty()
        edges = small
        if same:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def drop_near(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, the smallest doc_id, of each group that the join connects, directly or through others."""
    members, nodes, ties = node_ties(docs, n, threshold)
    found = common.stored(counted(docs, nodes, ties, n, threshold), "verified")
    # groups are found among distinct sets; documents follow theirs
    roots = components(found.filter("kind = 1"))
    members = members.filter("doc_id IS NOT NULL").join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", F.coalesce("root", "sid").alias("group"))
    first = members.groupBy("group").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    # a doc_id may have several texts
    lost = common.stored(members.join(first, "group").filter("doc_id > first").select(F.col("doc_id").alias("lost")).distinct(), "lost")
    side = lost if lost.count() > BROADCAST_ROWS else F.broadcast(lost)
    return common.packed(docs).join(side, F.col("row.doc_id").cast("long") == F.col("lost"), "left_anti").select("row.*")


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, route: int = ROUTE) -> DataFrame:
    """(doc_id, class_id, links) of each doc_id: the smallest doc_id of those that ``join`` connects it with, directly or through others, and the number of its partners there."""
    members, nodes, ties = node_ties(docs, n, threshold, route)
    texts = common.stored(members.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.collect_set("sid").alias("sids")), "texts")
    # documents of one text are counted; those of several, which may be partners by more than one, are listed
    one = texts.filter(F.size("sids") == 1).select("doc_id", F.get("sids", F.lit(0)).alias("sid"))
    many = common.stored(texts.filter(F.size("sids") > 1).select("doc_id", F.explode("sids").alias("sid"), F.array_min("sids").alias("low")), "many")
    each = one.select("sid", F.lit(1).alias("one"), F.lit(0).alias("odd")).unionByName(many.select("sid", F.lit(0).alias("one"), F.lit(1).alias("odd")))
    own = common.stored(each.groupBy("sid").agg(F.sum("one").alias("n"), F.max("odd").alias("odd")), "weights")
    weight = F.when(F.col("odd") == 1, -1 - F.col("n")).otherwise(F.col("n"))
    found = common.stored(counted(docs, nodes, ties, n, threshold, own.select(F.col("sid").alias("node"), weight.alias("weight"))), "verified")
    roots = components(found.filter("kind = 1").select("a", "b").unionByName(many.select(F.col("low").alias("a"), F.col("sid").alias("b"))))
    grouped = texts.select("doc_id", F.array_min("sids").alias("low")).join(roots, F.col("low") == F.col("node"), "left").select("doc_id", F.coalesce("root", "low").alias("group"))
    first = grouped.groupBy("group").agg(F.min("doc_id").alias("class_id"))
    near = common.stored(found.filter("kind = 2").select("a", "b").unionByName(many.select(F.col("sid").alias("a"), F.col("sid").alias("b"))).distinct(), "near")
    reach = common.stored(many.select("doc_id", F.col("sid").alias("a")).join(near, "a").select("doc_id", "b").distinct(), "reach")
    # a text's partners: those of one text, itself among them, and those of several
    listed = reach.groupBy(F.col("b").alias("sid")).agg(F.count(F.lit(1)).alias("m"))
    partners = found.filter("kind = 0").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("p"))
    of = own.select("sid", "n").join(partners, "sid", "left").join(listed, "sid", "left").select("sid", (F.col("n") + F.coalesce("p", F.lit(0)) + F.coalesce("m", F.lit(0)) - 1).alias("links"))
    counts = reach.join(own.select(F.col("sid").alias("b"), "n"), "b").groupBy("doc_id").agg(F.sum("n").alias("n"))
    others = reach.join(many.select(F.col("sid").alias("b"), F.col("doc_id").alias("other")), "b").select("doc_id", "other").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("m"))
    links = one.join(of, "sid").select("doc_id", "links").unionByName(counts.join(others, "doc_id").select("doc_id", (F.col("n") + F.col("m") - 1).alias("links")))
    found = grouped.join(first, "group").join(links, "doc_id").select("doc_id", "class_id", "links")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                              WHEN len(w) >= 1 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT p, q FROM shared JOIN sizes x ON x.doc_id = p JOIN sizes y ON y.doc_id = q WHERE s / (x.n + y.n - s) >= 0.4),
linked AS (SELECT p, q FROM pairs UNION ALL SELECT q, p FROM pairs),
reach AS (SELECT p, q FROM linked UNION SELECT reach.p, linked.q FROM reach JOIN linked ON linked.p = reach.q),
classes AS (SELECT p, min(q) AS first FROM reach GROUP BY p),
links AS (SELECT p, count(*) AS n FROM linked GROUP BY p)
SELECT d.doc_id, least(d.doc_id, coalesce(first, d.doc_id)) AS class_id, coalesce(n, 0) AS links
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d LEFT JOIN classes c ON c.p = d.doc_id LEFT JOIN links l ON l.p = d.doc_id
"""
