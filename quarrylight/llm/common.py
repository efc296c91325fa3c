"""Shared helpers: the cluster's shared folder, and whole Arrow batches of text as numpy arrays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.sources import shared

#: White space of every contract: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words as a Java and DuckDB regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the numpy kernels hold at once (one document at least).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, set as the session's checkpoint folder if it has none."""
    found = shared.shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: no lineage is left, and any executor can read it."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not use (case-insensitively)."""
    used, name = {c.lower() for c in df.columns}, stem
    while name.lower() in used:
        name = f"_{name}"
    return name


def set_aside(df: DataFrame, *names: str) -> DataFrame:
    """df whose columns of these names (in any case) get leading underscores, so that new columns can take the names."""
    for c in df.columns:
        if c.lower() in names:
            df = df.withColumnRenamed(c, free_name(df, f"_{c}"))
    return df


def quoted(name: str) -> str:
    """A column name as an identifier, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a materialised table of at most ``rows`` rows; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def doc_order(doc: str = "doc_id"):
    """md5-based seeded order that DuckDB can repeat: 60 bits of md5(doc_id as text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


# ---------------------------------------------------------------- Arrow


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashes and words

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any spans of a byte buffer in constant time each, by prefix sums of a polynomial."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _STEP)


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words of documents that lie one behind the other in buf."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = False, inside[1:]
    return start, np.flatnonzero(inside & (~after | edge[1:])) + 1


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of a flag or number array by the ranges of offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def with_columns(batch: pa.RecordBatch, more: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])


def schema_with(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(k, v) for k, v in kinds.items())])
