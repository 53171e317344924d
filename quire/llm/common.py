"""Shared pieces: tables in the shared folder, and vectorised text scanning over Arrow buffers.

The scanners work on the UTF-8 bytes of whole Arrow batches, cut into chunks of about ``CHUNK`` bytes at document
boundaries, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 20
WINDOW = 1 << 16
_MASK_SPLIT = np.uint64(31)
_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("quire.shared.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        folder = "file://" + made
        spark.conf.set("quire.shared.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """The number of tables stored so far, for ``release``."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables stored so far but the first ``since`` and the last ``keep``, once every result that was made from them has been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    end = max(since, len(_WRITTEN) - keep)
    for name in _WRITTEN[since:end]:
        path = hadoop.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since:end]


@contextlib.contextmanager
def tidy() -> Iterator[None]:
    """Gives a Python worker's free memory back at the end of its task; workers are reused, and what they keep counts against the executor."""
    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a scan of fewer partitions than there are cores is spread over them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df if name not in ("documents", "pages") or df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffer(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its values; nulls count as empty."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``rows`` rows and about ``most`` bytes; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), i + rows, n)
        yield i, j
        i = j


def pieces(texts: pa.Array, lower: bool = False, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of each chunk; texts are lowered a chunk at a time."""
    raw, offsets = text_buffer(texts)
    for i, j in chunks(offsets, most):
        if lower:
            yield i, j, *text_buffer(texts.slice(i, j - i), lower)
        else:
            yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def windows(offsets: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, rows, their starts in the window) of windows of ``most`` bytes over all rows' bytes; a long row is in many."""
    for s in range(0, int(offsets[-1]), most):
        e = min(s + most, int(offsets[-1]))
        first, last = np.searchsorted(offsets, s, "right") - 1, np.searchsorted(offsets, e, "left")
        rows = np.arange(first, last)[offsets[first + 1 : last + 1] > offsets[first:last]]
        yield s, e, rows, np.maximum(offsets[rows], s) - s


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> _MASK_SPLIT)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run ends where its document ends."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = offsets[1:-1]
    before = np.empty_like(mask)
    before[0], before[1:] = False, mask[:-1]
    before[edge[edge < len(mask)]] = False
    after = np.empty_like(mask)
    after[-1], after[:-1] = False, mask[1:]
    after[edge[edge > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row's range, zero for empty rows."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=None if values.dtype.kind == "f" else np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


class RunHasher:
    """64-bit hashes of byte runs, by sums of one polynomial over windows."""

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.full(WINDOW, self.BASE, np.uint64))
            self.inverses = np.cumprod(np.full(WINDOW, pow(self.BASE, -1, 1 << 64), np.uint64))

    def __call__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        cuts = np.stack([starts, ends], axis=1).ravel()
        cuts = np.concatenate([cuts[:1] * 0, cuts, [len(raw)]])  # gaps and runs take turns
        sums = np.zeros(len(cuts) - 1, np.uint64)
        with np.errstate(over="ignore"):
            for s, e, rows, at in windows(cuts):
                part = np.add.reduceat((raw[s:e] + np.uint64(1)) * self.powers[: e - s], at, dtype=np.uint64) * self.inverses[at]
                if cuts[rows[0]] < s:  # goes on from the window before
                    part[0] *= np.uint64(pow(self.BASE, s - int(cuts[rows[0]]), 1 << 64))
                sums[rows] += part
            return mix(sums[1::2] + (ends - starts).astype(np.uint64))


def packed(df: DataFrame) -> DataFrame:
    """All columns in one struct ``row``, so that an operator's own columns can't clash with the caller's."""
    return df.select(F.struct("*").alias("row"))


def row_and(rows: DataFrame, ddl: str, keep: tuple[str, ...] = ("row",)) -> T.StructType:
    """The schema of the kept columns of ``rows`` and the new ones."""
    return T.StructType([rows.schema[c] for c in keep] + T.StructType.fromDDL(ddl).fields)
