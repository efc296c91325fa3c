"""Byte-level BPE encoding and decoding.

A segment tree over the byte positions of a piece stores the least pair rank, the leftmost first. A merge takes the
root, joins that pair and updates the leaves of the live neighbours, each in logarithmic time. Short pieces are merged
side by side in one array of trees; long ones in a tree of their own.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import schema_with, set_aside, slices, string_buffers

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers; beyond that it forgets all and goes on. Results do not depend on it.
REMEMBERED = 200_000
#: Bytes of text that are split at once, and ids that are decoded at once.
SPLIT_BYTES, DECODED_IDS = 1 << 19, 1 << 16
#: Pieces of up to this many bytes are merged side by side.
SIDE_BY_SIDE = 128
_NONE = np.int64(1) << np.int64(62)

#: The public pattern written for the standard library's engine, which is faster. It splits alike wherever all
#: characters are of the kinds in _PLAIN; other texts go through the public pattern itself.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]")
_FAST_FOR = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def split(text: str, pattern: str, compiled: regex.Pattern) -> list[str]:
    if pattern == _FAST_FOR and not _OTHER.search(text):
        return _FAST.findall(text)
    return compiled.findall(text)


class Ranks:
    """The vocabulary: ranks of byte strings, ranks of pairs, and the bytes of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for whole, rank in self.ranks.items():
            for cut in range(1, len(whole)):
                left, right = self.ranks.get(whole[:cut]), self.ranks.get(whole[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        by_id = sorted((r, b) for b, r in self.ranks.items())
        lengths = np.zeros(self.size, np.int64)
        lengths[[r for r, _ in by_id]] = [len(b) for _, b in by_id]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.lengths, self.bytes = lengths, np.frombuffer(b"".join(b for _, b in by_id), np.uint8)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; _NONE where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of lists of ids that lie one behind the other."""
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = np.empty(ends[-1], np.uint8)
        for a in range(0, len(ids), DECODED_IDS):  # places of bytes take eight times the bytes
            b = min(a + DECODED_IDS, len(ids))
            out[ends[a] : ends[b]] = self.bytes[ranges(self.starts[ids[a:b]], n[a:b], ends[a : b + 1] - ends[a])]
        return out, ends[offsets]


def ranges(start: np.ndarray, length: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then start[1] and so on; ends: running sums of length from 0."""
    return np.repeat(start - ends[:-1], length) + np.arange(ends[-1])


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    return Ranks(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def merge_alone(piece: bytes, ranks: Ranks) -> list[int]:
    """Ids of one piece, by a segment tree of its own."""
    n, get, v = len(piece), ranks.pairs.get, ranks.size
    tok = [int(x) for x in ranks.byte[np.frombuffer(piece, np.uint8)]]
    width = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    tree = [none] * (2 * width)
    for i in range(n - 1):
        if (r := get(tok[i] * v + tok[i + 1])) is not None:
            tree[width + i] = r * width + i
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, key: int) -> None:
        k = width + i
        tree[k] = key
        while k > 1:
            k >>= 1
            best = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best

    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    while tree[1] < none:
        r, i = divmod(tree[1], width)
        j = after[i]
        k, p = after[j], before[i]
        tok[i], live[j], after[i] = r, False, k
        put(j, none)
        right = get(r * v + tok[k]) if k < n else None
        put(i, none if right is None else right * width + i)
        if k < n:
            before[k] = i
        if p >= 0:
            left = get(tok[p] * v + r)
            put(p, none if left is None else left * width + p)
    return [t for t, x in zip(tok, live, strict=True) if x]


def merge_many(pieces: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """(ids one behind the other, how many of each piece) of pieces of two to SIDE_BY_SIDE bytes, by an array of segment trees."""
    lens = np.array([len(p) for p in pieces])
    m, width = len(pieces), 1 << max(1, int(lens.max() - 1).bit_length())
    bits = np.int64(width.bit_length() - 1)
    inside = np.arange(width) < lens[:, None]
    tok = np.zeros((m, width), np.int64)
    tok[inside] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    leaf = np.full((m, width), _NONE)
    pair_in = inside[:, 1:]
    found = ranks.pair(tok[:, :-1][pair_in], tok[:, 1:][pair_in])
    at = np.broadcast_to(np.arange(width - 1), pair_in.shape)[pair_in]
    leaf[:, :-1][pair_in] = np.where(found < _NONE, (found << bits) | at, _NONE)
    tree = np.empty((m, 2 * width), np.int64)
    tree[:, width:] = leaf
    k = width
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    tree[:, 0] = _NONE
    after = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()
    before = np.broadcast_to(np.arange(-1, width - 1), (m, width)).copy()
    live, tree1, tok1 = inside.copy().ravel(), tree.ravel(), tok.ravel()
    after1, before1 = after.ravel(), before.ravel()
    row = np.arange(m)
    while True:
        root = tree1[row * (2 * width) + 1]
        row = row[root < _NONE]
        if not len(row):
            break
        root = root[root < _NONE]
        base, tbase = row * width, row * (2 * width) + width
        i, r = root & (width - 1), root >> bits
        j = after1[base + i]
        k, p = after1[base + j], before1[base + i]
        tok1[base + i], live[base + j], after1[base + i] = r, False, k
        more = k < lens[row]
        before1[(base + k)[more]] = i[more]
        right = np.full(len(row), _NONE)
        right[more] = ranks.pair(r[more], tok1[(base + k)[more]])
        tree1[tbase + j] = _NONE
        tree1[tbase + i] = np.where(right < _NONE, (right << bits) | i, _NONE)
        has = p >= 0
        left = ranks.pair(tok1[(base + p)[has]], r[has])
        tree1[(tbase + p)[has]] = np.where(left < _NONE, (left << bits) | p[has], _NONE)
        for leaf_at in (i, j, np.where(has, p, i)):
            node = leaf_at + width
            up = tbase - width
            for _ in range(int(bits)):
                node >>= 1
                tree1[up + node] = np.minimum(tree1[up + 2 * node], tree1[up + 2 * node + 1])
    return tok1[live], live.reshape(m, width).sum(1)


class Encoder:
    """Encodes lists of pieces, remembering those it has seen."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.ends = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]

    def learn(self, new: list[str]) -> None:
        groups: dict[int, list[tuple[str, bytes]]] = {}
        names, ids, counts = [], [], []
        for piece in new:
            raw = piece.encode()
            known = self.ranks.ranks.get(raw)
            if known is None and len(raw) <= SIDE_BY_SIDE:
                groups.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
                continue
            one = merge_alone(raw, self.ranks) if known is None else [known]
            names.append(piece)
            ids.append(np.array(one, np.int64))
            counts.append(np.array([len(one)], np.int64))
        for members in groups.values():
            for a in range(0, len(members), 4096):
                part = members[a : a + 4096]
                found, n = merge_many([raw for _, raw in part], self.ranks)
                names += [piece for piece, _ in part]
                ids.append(found)
                counts.append(n)
        first, done = len(self.index), int(self.ends[-1][-1])
        self.index.update(zip(names, range(first, first + len(names)), strict=True))
        self.ids += ids
        self.ends.append(done + np.cumsum(np.concatenate(counts)))

    def encode(self, pieces: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one behind the other, offsets) of lists of pieces."""
        unseen = set().union(*pieces) - self.index.keys() if pieces else set()
        if unseen and len(self.index) + len(unseen) > REMEMBERED:
            self.forget()
            unseen = set().union(*pieces)
        if unseen:
            self.learn(list(unseen))
            self.ids, self.ends = [np.concatenate(self.ids)], [np.concatenate(self.ends)]
        ids, ends = self.ids[0], self.ends[0]
        get = self.index.__getitem__
        flat = np.concatenate([np.fromiter(map(get, p), np.int64, len(p)) for p in pieces]) if pieces else np.zeros(0, np.int64)
        start = ends[flat]
        length = ends[flat + 1] - start
        stops = np.concatenate([[0], np.cumsum(length)])
        offsets = stops[np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)]
        return ids[ranges(start, length, stops)], offsets


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """docs with the ids of every whole text, each match of the pattern merged by itself, without special tokens.

    decoded: a column for the bytes of those ids, or None. Null texts count as empty: no ids, no bytes. Characters
    that no alternative of the pattern matches are not encoded (the public pattern leaves none out). Other columns and
    repeated rows pass through, columns of the new names under a leading underscore; an empty table gives an empty table.
    """
    import public_tokenizers

    docs = set_aside(docs, ids, *([decoded] if decoded else []))
    path, pattern = vocabulary or vocabulary_path(), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, compiled = load(path), regex.compile(pattern)
        encoder = Encoder(ranks)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offs = string_buffers(column)
            for a, b in slices(offs):
                found, stops = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
                for c, d in slices(offs[a : b + 1], SPLIT_BYTES):
                    part, off = encoder.encode([split(x or "", pattern, compiled) for x in column.slice(a + c, d - c).to_pylist()])
                    found.append(part)
                    stops.append(stops[-1][-1] + off[1:])
                flat, off = np.concatenate(found), np.concatenate(stops)
                more = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.astype(np.int32)))]
                if decoded:
                    data, ends = ranks.decode(flat, off)
                    more.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)]))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *more], [*batch.schema.names, ids, *([decoded] if decoded else [])])

    kinds = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.BinaryType()} if decoded else {})
    return docs.mapInArrow(run, schema_with(docs.schema, **kinds))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, from the operator's real outputs."""
    out = encode(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
