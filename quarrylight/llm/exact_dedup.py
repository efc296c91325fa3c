"""Exact deduplication by counting quotient filters.

Each partition of fingerprints becomes a counting quotient filter, cut into blocks of the quotient space.
Blocks merge without loss, as their remainders are sorted. Only fingerprints that are counted more than
once are routed to a comparison of the bytes themselves.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import free_name, materialise, small_side, string_buffers

#: Fingerprints that a merged block aims at.
BLOCK_ROWS = 1 << 15
#: Repeated fingerprints that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
_WHITE = b" \t\n\r\x0b\x0c"


class CountingQuotientFilter:
    """Sorted remainders in runs by quotient, with a bit for each occupied quotient and for each run's end, and counters.

    Fingerprints have 64 bits: the first ``q`` are the quotient, the others the remainder. Slots are filled in the
    order of quotients, so the filter is exact for its fingerprints and merges by one pass over sorted slots.
    """

    def __init__(self, q: int, occupied: np.ndarray, run_end: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.occupied, self.run_end, self.remainders, self.counts = q, occupied, run_end, remainders, counts

    @classmethod
    def of(cls, prints: np.ndarray, q: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        order = np.argsort(prints, kind="stable")
        prints = prints[order]
        counts = np.ones(len(prints), np.int64) if counts is None else counts[order]
        first = np.ones(len(prints), bool)
        first[1:] = prints[1:] != prints[:-1]
        at = np.flatnonzero(first)
        distinct, sums = prints[at], np.add.reduceat(counts, at) if len(at) else counts[:0]
        quotient = (distinct >> np.uint64(64 - q)).astype(np.int64)
        occupied = np.zeros(1 << q, bool)
        occupied[quotient] = True
        end = np.ones(len(distinct), bool)
        end[:-1] = quotient[1:] != quotient[:-1]
        return cls(q, np.packbits(occupied), np.packbits(end), distinct & np.uint64((1 << (64 - q)) - 1), sums)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints in ascending order, and their counts."""
        n = len(self.remainders)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q)).astype(np.uint64)
        end = np.unpackbits(self.run_end, count=n).astype(np.int64)
        run = np.cumsum(end) - end
        return (quotients[run] << np.uint64(64 - self.q)) | self.remainders, self.counts

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        parts = [x.items() for x in (self, *others)]
        return self.of(np.concatenate([p for p, _ in parts]), self.q, np.concatenate([c for _, c in parts]))

    def blocks(self, bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
        """Filters of the fingerprints by their first ``bits`` bits; each has the quotient bits that are left."""
        prints, counts = self.items()
        block = (prints >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(prints), np.int64)
        for b in np.unique(block):
            lo, hi = np.searchsorted(block, [b, b + 1])
            yield int(b), CountingQuotientFilter.of(prints[lo:hi] << np.uint64(bits), max(1, int(hi - lo).bit_length()), counts[lo:hi])

    def to_bytes(self) -> bytes:
        return b"".join([np.array([self.q, len(self.remainders)], np.int64).tobytes(), self.occupied.tobytes(), self.run_end.tobytes(), self.remainders.tobytes(), self.counts.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
        a = 16 + ((1 << q) + 7) // 8
        b = a + (n + 7) // 8
        return cls(q, np.frombuffer(raw, np.uint8, a - 16, 16), np.frombuffer(raw, np.uint8, b - a, a), np.frombuffer(raw, np.uint64, n, b), np.frombuffer(raw, np.int64, n, b + 8 * n))


def _normalised(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    buf, offs = string_buffers(batch.column(batch.schema.get_field_index(name)))
    view = memoryview(buf)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        yield bytes(view[a:b]).translate(None, _WHITE)


def digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """The table with text_sha256 and fp (the digest's first 8 bytes, signed) of the normalised text in place of the text."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(x).digest() for x in _normalised(batch, text)]
            fp = np.frombuffer(b"".join(x[:8] for x in sha), ">i8").astype(np.int64)
            i = batch.schema.get_field_index(text)
            kept = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if k != i]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array([x.hex() for x in sha], pa.string()), pa.array(fp)], [*(n for n, _ in kept), "text_sha256", "fp"])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(digest, T.StructType([*fields, T.StructField("text_sha256", T.StringType()), T.StructField("fp", T.LongType())]))


def repeated_fingerprints(prints: DataFrame, rows: int, fp: str = "fp") -> DataFrame:
    """Fingerprints that the merged filters count more than once: (fp, n). rows: about how many there are in all."""
    bits = max(0, math.ceil(math.log2(max(1, rows / BLOCK_ROWS))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, kept = [], 0, None
        for batch in batches:
            parts.append(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64))
            held += len(parts[-1])
            if held >= 1 << 20:  # bounded memory: what has come so far becomes one filter
                new = CountingQuotientFilter.of(np.concatenate(parts), 16)
                kept, parts, held = new if kept is None else kept.merge(new), [], 0
        if parts:
            new = CountingQuotientFilter.of(np.concatenate(parts), 16)
            kept = new if kept is None else kept.merge(new)
        if kept is not None:
            made = [(b, f.to_bytes()) for b, f in kept.blocks(bits)]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in made], pa.int64()), pa.array([f for _, f in made], pa.binary())], ["block", "filter"])

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        block = int(frame["block"].iloc[0])
        found = [CountingQuotientFilter.from_bytes(x) for x in frame["filter"]]
        all_items = [f.items() for f in found]
        q = max(1, sum(len(p) for p, _ in all_items).bit_length())
        whole = CountingQuotientFilter.of(np.concatenate([p for p, _ in all_items]), min(q, 20), np.concatenate([c for _, c in all_items]))
        prints, counts = whole.items()
        twice = counts > 1
        back = (prints[twice] >> np.uint64(bits)) | (np.uint64(block) << np.uint64(64 - bits)) if bits else prints[twice]
        return pd.DataFrame({"fp": back.view(np.int64), "n": counts[twice]})

    return prints.select(fp).mapInArrow(build, "block long, filter binary").groupBy("block").applyInPandas(merged, "fp long, n long")


def groups(docs: DataFrame, slim: DataFrame, rows: int, text: str = "text") -> DataFrame:
    """(text_sha256, keep_id, group_size) of every text that occurs more than once, compared byte by byte.

    docs has doc_id and the text; slim is its digests() table. Whole texts travel only if their fingerprint repeats,
    and equal ones are combined before they travel.
    """
    twice = materialise(repeated_fingerprints(slim, rows), "repeated-fp").select("fp")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norm = list(_normalised(batch, text))
            fp = np.frombuffer(b"".join(hashlib.sha256(x).digest()[:8] for x in norm), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(norm, pa.binary()), pa.array(fp)], ["doc_id", "raw", "n_chars", "norm", "fp"])

    raw = docs.select(F.col("doc_id"), _raw(text), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), F.col(text).alias(text))
    kind = docs.schema["doc_id"].dataType
    texts = raw.mapInArrow(normalise, T.StructType([T.StructField("doc_id", kind), T.StructField("raw", T.LongType()), T.StructField("n_chars", T.LongType()), T.StructField("norm", T.BinaryType()), T.StructField("fp", T.LongType())]))
    routed = texts.join(small_side(twice, BROADCAST_ROWS), "fp", "left_semi")
    equal = routed.groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("raw").alias("r"))).alias("best"))
    return equal.filter("group_size > 1").select(F.sha2("norm", 256).alias("text_sha256"), F.col("best.d").alias("keep_id"), F.col("best.r").alias("keep_raw"), "group_size")


def _raw(text: str):
    """Tells rows with the same doc_id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("raw")


def exact_dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, raw.

    Texts are equal when they are identical after white space (space, tab to carriage return) is deleted; null counts
    as empty, and all empty texts are equal. Of equal texts the row with the most code points stays, then the smallest
    doc_id (null last). Rows with the same doc_id and the same text share their verdict (drop_copies keeps one of
    them); raw tells rows with the same doc_id and other texts apart. Other columns of the input are not read; an
    empty table gives an empty table.
    """
    plain = docs.select(F.col("doc_id"), F.col(text).alias("text"))
    slim = materialise(digests(plain.select("doc_id", _raw("text"), "text")), "digests")
    found = groups(plain, slim, slim.count())
    out = slim.join(found, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw")))).alias("kept"), "text_sha256", "raw",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one of each text, with all their columns in their order."""
    verdict = materialise(exact_dedup(docs), "exact-verdict")
    a, b = free_name(docs, "_gone_id"), free_name(docs, "_gone_raw")
    gone = materialise(verdict.filter("NOT kept").select(F.col("doc_id").alias(a), F.col("raw").alias(b)).distinct(), "exact-gone")
    stay = docs.join(small_side(gone, BROADCAST_ROWS), docs["doc_id"].eqNullSafe(gone[a]) & (_raw("text") == gone[b]), "left_anti")
    same = verdict.filter("kept AND group_size > 1").groupBy("doc_id", "raw").count().filter("count > 1")
    return stay.dropDuplicates(["doc_id", "text"]) if same.limit(1).count() else stay


def op7_counting_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("raw")


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AS kept,
       text_sha256
FROM t
WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""
