"""Character sets: detection and lenient decoding, as Arrow-batched functions."""

from __future__ import annotations

import codecs
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Web labels to codecs that read at least what the label promises.
CODECS = {
    "utf-8": "utf-8", "utf8": "utf-8", "utf-16": "utf-16", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "gb2312": "gb18030", "gbk": "gb18030", "gb18030": "gb18030",
    "big5": "big5hkscs", "euc-jp": "euc_jp", "shift_jis": "cp932", "euc-kr": "cp949", "ascii": "cp1252", "us-ascii": "cp1252", "iso-8859-1": "cp1252", "latin1": "cp1252",
    "windows-1252": "cp1252", "windows-1251": "cp1251", "windows-1250": "cp1250", "iso-8859-2": "iso8859_2", "koi8-r": "koi8_r",
}
BOMS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")]
EAST_ASIAN = ["gb18030", "big5"]
#: Bytes that Python takes out of a batch at a time.
PIECE = 1 << 20


def detect_bytes(data: bytes) -> str:
    """Byte-order mark, then strict UTF-8, then the East Asian set with the most common characters, then windows-1252."""
    for mark, label in BOMS:
        if data.startswith(mark):
            return label
    try:
        data.decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError:
        pass
    best, top = "windows-1252", 0.5
    for label in EAST_ASIAN:
        try:
            text = data.decode(CODECS[label])
        except UnicodeDecodeError:
            continue
        wide = {c: n for c, n in Counter(text).items() if ord(c) > 0x7F}
        # level-one characters of both sets sort below these lead bytes; real prose uses hardly any others
        share = sum(n for c, n in wide.items() if _is_common(c, label)) / max(1, sum(wide.values()))
        if share > top:
            best, top = label, share
    return best


def _is_common(char: str, label: str) -> bool:
    try:
        lead = char.encode(CODECS[label])[0]
    except UnicodeEncodeError:
        return False
    return 0xB0 <= lead <= 0xD7 or lead in (0xA1, 0xA3) if label == "gb18030" else 0xA1 <= lead <= 0xC6


def decode_bytes(data: bytes | None, label: str | None) -> str | None:
    """Bad bytes become U+FFFD, a byte-order mark is dropped; null for a label that isn't known."""
    codec = CODECS.get((label or "utf-8").strip().lower())
    if data is None or codec is None:
        return None
    return bytes(data).decode(codec, "replace").removeprefix("﻿")


def _pieces(f: Callable[[Iterator[tuple]], list], kind: pa.DataType) -> Callable[..., Iterator[pa.Array]]:
    """An Arrow function that calls ``f`` with the values of so many rows as have about ``PIECE`` bytes, so that Python holds few values at a time besides the batch."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            columns, made, start, held = batch if isinstance(batch, tuple) else (batch,), [], 0, 0
            size = pc.fill_null(pc.binary_length(columns[0]), 0).to_numpy(zero_copy_only=False)
            for k in range(len(size)):
                held += int(size[k])
                if held >= PIECE or k + 1 == len(size):
                    made.append(pa.array(f(zip(*(c.slice(start, k + 1 - start).to_pylist() for c in columns))), kind))
                    start, held = k + 1, 0
            done = pa.concat_arrays(made) if made else pa.array([], kind)
            del made, batch, columns
            yield done
            del done
            pa.default_memory_pool().release_unused()

    return run


_FOUND = pa.struct([("encoding", pa.string()), ("text", pa.string())])


def _detected(rows: Iterator[tuple]) -> list:
    found = ((d, None if d is None else detect_bytes(d)) for (d,) in rows)
    return [None if x is None else {"encoding": x, "text": decode_bytes(d, x)} for d, x in found]


@F.arrow_udf(StringType())
def _decode(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    return _pieces(lambda rows: [decode_bytes(d, x) for d, x in rows], pa.string())(batches)


@F.arrow_udf(StringType())
def _detect(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _pieces(lambda rows: [None if d is None else detect_bytes(d) for (d,) in rows], pa.string())(batches)


@F.arrow_udf(StructType([StructField("encoding", StringType()), StructField("text", StringType())]))
def _detect_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _pieces(_detected, _FOUND)(batches)


def _valid(content: Column) -> Column:
    return F.is_valid_utf8(content.cast("string"))


def _plain(content: Column) -> Column:
    """Valid UTF-8 as text, without its byte-order mark."""
    text = content.cast("string")
    return F.when(F.startswith(text, F.lit("﻿")), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def decode_text(content: Column, encoding: Column) -> Column:
    """Valid UTF-8 that is said to be so stays on the JVM; Python gets the rest only."""
    easy = F.lower(F.trim(F.coalesce(encoding, F.lit("utf-8")))).isin("utf-8", "utf8") & _valid(content)
    return F.when(easy, _plain(content)).otherwise(_decode(F.when(~easy, content), encoding))


def _marked(content: Column) -> Column:
    """The label of the byte-order mark, null without one."""
    return F.coalesce(*(F.when(F.startswith(content, F.lit(mark)), F.lit(label)) for mark, label in BOMS))


def detect_encoding(content: Column) -> Column:
    """Byte-order marks and valid UTF-8 are told on the JVM; Python gets the rest only."""
    told = F.when(_valid(content), F.lit("utf-8")).otherwise(_marked(content))
    return F.coalesce(told, _detect(F.when(told.isNull(), content)))


def detect_decode(content: Column) -> Column:
    """Struct of encoding and text; what isn't valid UTF-8 goes to Python once for both."""
    other = _detect_decode(F.when(~_valid(content), content))
    return F.when(_valid(content), F.struct(F.lit("utf-8").alias("encoding"), _plain(content).alias("text"))).otherwise(other)


def transform_text(content: Column) -> Column:
    """Detected and decoded in one go; null for no text."""
    return F.nullif(detect_decode(content)["text"], F.lit(""))
