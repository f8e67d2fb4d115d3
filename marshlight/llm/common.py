"""Helpers shared by the training-data operators: table access, shared scratch space, byte-level text splitting."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marshlight.session import scratch_dir, stored

#: Word separators of the text operators: the bytes 0x20 and 0x09-0x0D.
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
__all__ = ["doc_columns", "free_name", "map_arrow", "mix64", "padded", "parallelism", "same_spans", "scratch_dir", "span_hashes", "stored", "table", "text_chunks", "words"]

UPPER_ASCII, LOWER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The first k bytes of a little-endian word, for k from 0 to 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans over this many bytes are hashed and compared one by one.
_LONG = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch that goes to a Python worker, where the session doesn't say otherwise.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes, so that a worker's memory doesn't depend on how long texts are.

    The bound is a setting of the session: it is lowered once, and left alone where it is set already.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_SETTING, None) in (None, "64MB"):
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(step, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_chunks(column: pa.Array, most_bytes: int = 512 << 10) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``most_bytes`` bytes (a longer text stands alone).

    Yields (first row, row after the last, bytes, offsets of the rows in them); null counts as empty.
    """
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + most_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.zeros(8, np.uint8)])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number; its last eight bytes are padding."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _steps(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
    """(offset, spans that reach beyond it, mask of their bytes in the eight from there on), for spans that aren't long."""
    most = int(lengths[lengths <= _LONG].max(initial=0))
    for offset in range(0, most, 8):
        some = slice(None) if not offset and most == lengths.max() else np.flatnonzero((lengths > offset) & (lengths <= _LONG))
        yield offset, some, _FIRST[np.minimum(lengths[some] - offset, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span [start, end), eight bytes of all spans a step."""
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    if not len(starts):
        return out
    eights = _eights(padded(data))
    for offset, some, mask in _steps(lengths):
        out[some] = mix64(out[some] * np.uint64(0x9E3779B97F4A7C15) + (eights[starts[some] + offset] & mask))
    for k in np.flatnonzero(lengths > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of ``a`` are those of the span of ``b`` of the same length; both arrays are padded."""
    out = np.ones(len(lengths), bool)
    if not len(lengths):
        return out
    x, y = _eights(a), _eights(b)
    for offset, some, mask in _steps(lengths):
        out[some] &= (x[at_a[some] + offset] ^ y[at_b[some] + offset]) & mask == 0
    for k in np.flatnonzero(lengths > _LONG):
        out[k] = np.array_equal(a[at_a[k] : at_a[k] + lengths[k]], b[at_b[k] : at_b[k] + lengths[k]])
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: (bytes, starts, ends, number of the text), A-Z lower-cased on request."""
    data = _LOWER[data] if lower else data
    inside = ~_IS_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] |= inside[cuts]
    ends[cuts] |= inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends)
    return data, s, e, np.searchsorted(offsets, s, side="right") - 1


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def doc_columns(df: DataFrame) -> DataFrame:
    """doc_id and text alone, so that a scan reads two columns and other columns of any name do no harm."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
