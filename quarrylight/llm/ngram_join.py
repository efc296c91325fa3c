"""N-gram Jaccard join by chosen paths.

A document is its set of five-word shingles. Every repetition grows a tree over each set: a node's children are the
shingles that a hash seeded by the node picks, each with probability 1 / (similarity * set size), so similar sets walk
the same paths, and sets that meet at a leaf form a bucket. First a few edges tie what looks alike by sketches in each
bucket, which gives candidate components. Buckets within one component are done; in the others all sets of different
components are held against each other by sketches (very large buckets are split again on further sampled shingles), and
components grow. Candidate components are then joined exactly, on whole sets, in blocks; only these exact links make
classes. Repetitions go on until the chance that a pair at the threshold meets nowhere is below 1 - RECALL.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.bpe import ranges
from quarrylight.llm.common import Spans, free_name, materialise, mix, slices, small_side, string_buffers, word_spans
from quarrylight.llm.components import components
from quarrylight.llm.exact_dedup import _raw

WORDS = 5
#: Similarity 0.8 as a ratio of whole numbers.
SIMILARITY = (4, 5)
DEPTH = 3
RECALL = 0.9998
SEED = 7
#: Sets of a slice in which a large bucket is dealt for its first edges; sets outside a bucket's main component that are
#: held against a slice of twice as many; beyond SPLIT_OTHERS of them the bucket is split again first, SPLIT_TRIES times
#: on SPLIT_SAMPLES sampled shingles, up to SPLIT_LEVELS times.
SLICE_SETS, CHUNK_SETS, SPLIT_OTHERS = 1024, 1024, 16_384
SPLIT_SAMPLES, SPLIT_TRIES, SPLIT_LEVELS = 3, 10, 3
#: Cells of a sketch; sketches of sets at the threshold are so many standard deviations off at most.
SKETCH, DEVIATIONS = 128, 4
#: Rows that a task takes together; pairs of sketches compared at once.
PACK_ROWS, PAIRS_AT_ONCE = 16_384, 8192
#: Sets, and shingles, of a block of the exact join; classes that a task takes together.
BLOCK_SETS, BLOCK_SHINGLES, PACK_SETS = 2048, 1 << 20, 1024
BROADCAST_ROWS = 1_000_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def repetitions(depth: int = DEPTH, recall: float = RECALL) -> int:
    """How often to repeat: a pair at the threshold shares one child per node on average, or more."""
    die = 0.0
    for _ in range(depth):
        die = math.exp(die - 1)
    return math.ceil(math.log(1 - recall) / math.log(die))


def shingle_sets(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes one document behind the other, offsets). Fewer than five words are one shingle."""
    n = len(offs) - 1
    start, end = word_spans(buf, offs)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    first = np.searchsorted(start, offs)
    count = np.diff(first)
    word = Spans(buf).hashes(start, end)
    grams = np.maximum(count - WORDS + 1, (count > 0).astype(np.int64))
    stops = np.concatenate([[0], np.cumsum(grams)])
    at = ranges(first[:-1], grams, stops)
    last = np.repeat(first[1:], grams)
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        total += np.where(at + k < last, word[np.minimum(at + k, len(word) - 1)], np.uint64(1)) * _ODD[k]
    total = mix(total)
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
        if b - a > 1:
            total[a:b].sort()
    keep = np.ones(len(total), bool)
    keep[1:] = total[1:] != total[:-1]
    keep[stops[:-1][grams > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return total[keep], kept[stops]


def fingerprints(sets: np.ndarray, ptr: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for an empty one."""
    full = np.flatnonzero(np.diff(ptr))
    one, two = np.zeros(len(ptr) - 1, np.uint64), np.zeros(len(ptr) - 1, np.uint64)
    if len(full):
        mixed = mix(sets + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
        one[full] = mix(np.add.reduceat(mixed, ptr[:-1][full]))
        two[full] = mix(np.bitwise_xor.reduceat(mixed * _ODD[1], ptr[:-1][full]) ^ np.add.reduceat(mixed ^ (mixed >> np.uint64(7)), ptr[:-1][full]))
    return one, two


def sketches(sets: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The least hash in each of SKETCH ranges, 16 bits of it; 0 where there is none."""
    n = len(ptr) - 1
    out = np.zeros((n, SKETCH), np.uint16)
    if len(sets):
        cell = np.repeat(np.arange(n), np.diff(ptr)) * SKETCH + (sets >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        out.ravel()[cell[first]] = np.maximum(mix(sets[first]) & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
    return out


def chosen_paths(sets: np.ndarray, ptr: np.ndarray, reps: int, depth: int = DEPTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(leaf keys one set behind the other, offsets)."""
    size = np.diff(ptr)
    n = len(size)
    share = SIMILARITY[0] / SIMILARITY[1]
    limit = np.minimum(2.0**64 / (share * np.maximum(size, 1)), 2.0**64 - 2048).astype(np.uint64)
    owners, keys = [], []
    everyone = np.flatnonzero(size)
    for rep in range(reps):
        doc = everyone
        key = np.full(len(doc), int(mix(np.array([seed * 1_000_003 + rep], np.uint64))[0]), np.uint64)
        for level in range(depth):
            if not len(doc):
                break
            stops = np.concatenate([[0], np.cumsum(size[doc])])
            tok = sets if level == 0 else sets[ranges(ptr[doc], size[doc], stops)]
            picked = np.flatnonzero(tok * np.repeat(key | np.uint64(1), size[doc]) < np.repeat(limit[doc], size[doc]))
            node = np.searchsorted(stops, picked, "right") - 1
            key = mix(key[node] * _ODD[2] + tok[picked])
            doc = doc[node]
        owners.append(doc)
        keys.append(key)
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return key[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])


def summaries(docs: DataFrame, text: str, reps: int, seed: int) -> DataFrame:
    """(doc_id, raw, n shingles, f1, f2, leaf keys, sketch) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_buffers(batch.column(2))
            for a, b in slices(offs):
                sets, ptr = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                f1, f2 = fingerprints(sets, ptr, seed)
                keys, ends = chosen_paths(sets, ptr, reps)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in batch.columns[:2]), pa.array(np.diff(ptr)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64))), pa.array([x.tobytes() for x in sketches(sets, ptr)], pa.binary())],
                    ["doc_id", "raw", "n", "f1", "f2", "keys", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("raw", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()), T.StructField("f2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return docs.select("doc_id", _raw(text), F.col(text)).mapInArrow(run, schema)


# ---------------------------------------------------------------- sets that meet


def similar(cells: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far pairs of sketches are above the least that sets at the threshold show, DEVIATIONS below it; negative is below."""
    share = SIMILARITY[0] / SIMILARITY[1]
    out = np.zeros(len(i))
    for k in range(0, len(i), PAIRS_AT_ONCE):
        a, b = cells[i[k : k + PAIRS_AT_ONCE]], cells[j[k : k + PAIRS_AT_ONCE]]
        same = ((a == b) & (a > 0)).sum(1)
        either = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
        out[k : k + PAIRS_AT_ONCE] = same / either - (share - DEVIATIONS * np.sqrt(share * (1 - share) / either))
    return out


def _members(table: pa.Table, *by: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(columns sorted by ``by``, sketches, starts of the groups that all but the last of ``by`` make)."""
    cols = {c: np.asarray(table[c].combine_chunks()) for c in table.column_names if c != "sketch"}
    order = np.lexsort([cols[c] for c in reversed(by)])
    raw, _ = string_buffers(table["sketch"])
    cells = np.frombuffer(raw.tobytes(), np.uint16).reshape(-1, SKETCH)[order]
    cols = {k: v[order] for k, v in cols.items()}
    new = np.ones(len(order), bool)
    for c in by[:-1]:
        new[1:] &= cols[c][1:] == cols[c][:-1]
    new[1:] = ~new[1:]
    return cols, cells, np.flatnonzero(new)


def leaders(members: DataFrame) -> DataFrame:
    """Slices of buckets (pack, key, slice, f1, sketch) to edges (a, b) of sets that may be similar.

    The least set of a slice leads all that look like it, the least of the others leads again, and so on.
    """

    def run(table: pa.Table) -> pa.Table:
        cols, cells, starts = _members(table, "key", "slice", "f1")
        name = cols["f1"]
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(name))))
        left, found = np.arange(len(name)), []
        while len(left):
            first = np.ones(len(left), bool)
            first[1:] = group[left[1:]] != group[left[:-1]]
            lead = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
            hit = ~first & (name[lead] != name[left])
            hit[hit] = similar(cells, lead[hit], left[hit]) >= 0
            found.append((name[lead[hit]], name[left[hit]]))
            left = left[~first & ~hit]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        return pa.table({"a": a, "b": b})

    return members.groupBy("pack").applyInArrow(run, "a long, b long")


def _bits(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bit of each cell of sketches, and which cells are filled, as 64-bit words."""
    return tuple(np.packbits(x, axis=1).view(np.uint64) for x in ((cells & 1).astype(bool), cells > 0))


def _look_alike(cells: np.ndarray, bits: np.ndarray, full: np.ndarray, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of i and j of different roots that may be similar: by one bit of each cell first, then by the cells."""
    share = SIMILARITY[0] / SIMILARITY[1]
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 18) // max(1, len(j)))
    for k in range(0, len(i), step):
        rows = i[k : k + step]
        agree, both, either = (np.zeros((len(rows), len(j)), np.float32) for _ in range(3))
        for w in range(bits.shape[1]):
            fr, fc = full[rows, w][:, None], full[j, w][None, :]
            shared = fr & fc
            both += np.bitwise_count(shared)
            either += np.bitwise_count(fr | fc)
            agree += np.bitwise_count(~(bits[rows, w][:, None] ^ bits[j, w][None, :]) & shared)
        # cells that differ agree in the bit half of the time
        near = 2 * agree - both >= share * either - DEVIATIONS * np.sqrt((1 - share * share) * either)
        near &= root[rows][:, None] != root[j][None, :]
        a, b = np.nonzero(near)
        a, b = rows[a], j[b]
        good = similar(cells, a, b) >= 0
        one.append(a[good])
        two.append(b[good])
    return np.concatenate(one), np.concatenate(two)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least member of each member's component, from links (a, b) of members 0 to n - 1."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while (label != label[label]).any():
        label = label[label]
    return label


def across(members: DataFrame) -> DataFrame:
    """(pack, key, chunk, slice, f1, root, side, sketch) to edges (a, b) that tie all pairs of different roots that may be similar.

    Rows of side 0 are the chunk of a bucket's sets outside its main component, those of side 1 the slice of all its sets.
    """

    def run(table: pa.Table) -> pa.Table:
        cols, cells, starts = _members(table, "key", "chunk", "slice", "side", "f1")
        starts = np.flatnonzero(np.concatenate([[True], np.any([cols[c][1:] != cols[c][:-1] for c in ("key", "chunk", "slice")], axis=0)])) if len(cells) else starts
        bits, full = _bits(cells)
        one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(cells)).tolist(), strict=True):
            mid = a + int(np.searchsorted(cols["side"][a:b], 1))
            i, j = _look_alike(cells, bits, full, np.arange(a, mid), np.arange(mid, b), cols["root"])
            if len(i):
                names, node = np.unique(cols["f1"][a:b], return_inverse=True)
                label = _forest(node[i - a], node[j - a], len(names))
                off = np.flatnonzero(label != np.arange(len(names)))
                one.append(names[label[off]])
                two.append(names[off])
        return pa.table({"a": np.concatenate(one), "b": np.concatenate(two)})

    return members.groupBy("pack").applyInArrow(run, "a long, b long")


def split_again(members: DataFrame) -> DataFrame:
    """(key, f1, root, sketch) of large buckets to (key, f1, root): what agrees in SPLIT_SAMPLES sampled shingles, SPLIT_TRIES times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.asarray(batch.column(0)).view(np.uint64)
            raw, _ = string_buffers(batch.column(3))
            cells = np.frombuffer(raw.tobytes(), np.uint16).reshape(len(key), SKETCH)
            found = []
            for t in range(SPLIT_TRIES):
                new = mix(key * _ODD[3] + np.uint64(t + 1))
                pick = new.copy()
                for s in range(SPLIT_SAMPLES):
                    pick = mix(pick + np.uint64(s + 1))
                    new = mix(new * _ODD[4] + cells[np.arange(len(key)), (pick % np.uint64(SKETCH)).astype(np.int64)])
                found.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *(pa.array(np.tile(np.asarray(batch.column(c)), SPLIT_TRIES)) for c in (1, 2))], ["key", "f1", "root"])

    return members.select("key", "f1", "root", "sketch").mapInArrow(run, "key long, f1 long, root long")


def _packed(rows: DataFrame, by: list[str], total: int) -> DataFrame:
    return rows.withColumn("pack", F.pmod(F.xxhash64(*by), F.lit(max(1, total // PACK_ROWS))))


def shared_leaves(classes: DataFrame) -> DataFrame:
    """(key, f1, in_bucket, least) of the leaves where two sets or more meet; least is the first set of the bucket."""
    rows = classes.select("f1", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("in_bucket"), F.min("f1").alias("least")).filter("in_bucket > 1")
    return materialise(rows.join(small_side(materialise(sizes, "leaves"), BROADCAST_ROWS), "key"), "met")


def first_edges(met: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) that tie the sets of every bucket that look alike; a large bucket is dealt into slices that share its first set."""
    slices = F.ceil(F.col("in_bucket") / SLICE_SETS).cast("int")
    mine = F.when(F.col("f1") == F.col("least"), F.sequence(F.lit(0), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("f1"), slices).cast("int")))
    dealt = met.join(classes.select("f1", "sketch"), "f1").select("key", "f1", "sketch", F.explode(mine).alias("slice"))
    return leaders(_packed(dealt, ["key", "slice"], met.count())).distinct()


def rooted(nodes: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """nodes with the root of their f1 so far, which is itself where it has no edge."""
    return materialise(nodes.join(small_side(roots.withColumnRenamed("node", "f1"), BROADCAST_ROWS), "f1", "left").withColumn("root", F.coalesce("root", "f1")), name)


def other_edges(met: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (a, b) that tie all sets that meet, are not in one component yet, and may be similar.

    Buckets inside one component have nothing to add and are left out. The sets outside a bucket's main component are held
    against all its sets, in chunks and slices; where they are very many, the bucket is split again first.
    """
    rows, found = rooted(met.select("key", "f1"), roots, "met-roots"), None
    for level in range(SPLIT_LEVELS + 1):
        parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.sum("n").alias("total"), F.max(F.struct("n", "root")).alias("main")).filter("roots > 1")
        mixed = materialise(mixed.select("key", "total", F.col("main.root").alias("main"), (F.col("total") - F.col("main.n")).alias("others")), "mixed")
        large = F.col("others") > SPLIT_OTHERS
        deeper = level < SPLIT_LEVELS and bool(mixed.filter(large).limit(1).count())
        whole = rows.join(small_side(mixed, BROADCAST_ROWS), "key").join(classes.select("f1", "sketch"), "f1")
        near = whole.filter(~large) if deeper else whole
        chunks, slices = F.ceil(F.col("others") / CHUNK_SETS).cast("int"), F.ceil(F.col("total") / (2 * CHUNK_SETS)).cast("int")
        at = lambda n, seed: F.pmod(F.xxhash64("f1", F.lit(seed)), n).cast("int")
        every = lambda n: F.sequence(F.lit(0), n - 1)
        place = lambda side, chunk, slice_: F.struct(F.lit(side).alias("side"), chunk.alias("chunk"), slice_.alias("slice"))
        as_member = F.transform(every(chunks), lambda c: place(1, c, at(slices, 2)))
        as_other = F.when(F.col("root") == F.col("main"), F.array().cast(T.ArrayType(T.StructType([T.StructField("side", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("slice", T.IntegerType())])))).otherwise(F.transform(every(slices), lambda x: place(0, at(chunks, 1), x)))
        dealt = near.select("key", "f1", "root", "sketch", F.explode(F.concat(as_member, as_other)).alias("p")).select("key", "f1", "root", "sketch", "p.*")
        total = mixed.agg(F.sum("total")).first()[0] or 0
        pairs = across(_packed(dealt, ["key", "chunk", "slice"], total))
        found = pairs if found is None else found.union(pairs)
        if not deeper:
            return materialise(found.distinct(), "other-edges")
        again = split_again(whole.filter(large)).distinct()
        rows = materialise(again, "met-again")
    raise AssertionError("the last level is never split")


def exact_links(members: DataFrame) -> DataFrame:
    """(part, i, j, side, f1, copies, sh) to rows (a, b, edge, links): the links of a, or an edge (a, b) of those that span them.

    part, i, j name a candidate group and a pair of its blocks; side is the block a set stands for.
    """
    p, q = SIMILARITY

    def one(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
        names, copies = frame["f1"].to_numpy(np.int64), frame["copies"].to_numpy(np.int64)
        arrays = list(frame["sh"])
        size = np.array([len(x) for x in arrays], np.int64)
        _, col, seen = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(arrays)), size)
        shared = seen[col] > 1
        new = np.cumsum(seen > 1) - 1
        row, col = row[shared], new[col[shared]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        left = (frame["side"] == i).to_numpy()
        right = (frame["side"] == j).to_numpy()
        la, ra = np.flatnonzero(left), np.flatnonzero(right)
        inter = np.zeros((len(la), len(ra)), np.float32)
        width, columns = 1024, int((seen > 1).sum())
        for c in range(0, columns, width):
            lo, hi = np.searchsorted(col, [c, c + width])
            x = np.zeros((len(arrays), min(width, columns - c)), np.float32)
            x[row[lo:hi], col[lo:hi] - c] = 1
            inter += x[la] @ x[ra].T
        inter = np.rint(inter).astype(np.int64)
        links = (p + q) * inter >= p * (size[la][:, None] + size[ra][None, :])
        links &= names[la][:, None] != names[ra][None, :]
        zero = np.zeros(len(la), np.int64)
        out = [(names[la], zero, zero > 0, links @ copies[ra])]
        if i != j:
            zero = np.zeros(len(ra), np.int64)
            out.append((names[ra], zero, zero > 0, links.T @ copies[la]))
        x, y = np.nonzero(links)
        root = _forest(la[x], ra[y], len(arrays))
        off = np.flatnonzero(root != np.arange(len(root)))
        return [*out, (names[off], names[root[off]], np.ones(len(off), bool), np.zeros(len(off), np.int64))]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = [x for _, group in frame.groupby("part", sort=False) for x in one(group)]
        a, b, edge, n = (np.concatenate(x) for x in zip(*found, strict=True))
        return pd.DataFrame({"a": a, "b": b, "edge": edge, "links": n})

    return members.groupBy("pack", "i", "j").applyInPandas(run, "a long, b long, edge boolean, links long")


def whole_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, text: str, seed: int) -> DataFrame:
    """(f1, sh) of the wanted (f1) classes: the sorted shingles of the document that stands for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = string_buffers(batch.column(1))
            for a, b in slices(offs):
                sets, ptr = shingle_sets(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                f1, _ = fingerprints(sets, ptr, seed)
                lists = pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(sets.view(np.int64)))
                right = pa.array(f1.view(np.int64) == np.asarray(batch.column(0).slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["f1", "sh"]).filter(right)

    ids = small_side(materialise(classes.join(wanted, "f1", "left_semi").select(F.col("rep").alias("_rep"), "f1"), "wanted"), BROADCAST_ROWS)
    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_rep"])).select("f1", F.col(text))
    return texts.mapInArrow(run, "f1 long, sh array<long>").dropDuplicates(["f1"])


def near_duplicates(docs: DataFrame, text: str = "text", recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, raw and kept.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.8 or more; links are
    tested on whole sets, and n_links counts the documents linked with this one. class_id is the least doc_id of the
    documents that links connect. Documents with equal sets are one class and are not compared with each other. Words
    are what white space parts; a document of one to four words is one shingle of all its words; one without words (null
    too) has no links and is a class of its own. Rows that repeat a doc_id count as documents; raw tells those with other
    texts apart. kept says which row stands for its class: the one with the least doc_id (null last), of several texts
    with it the one with the least raw; rows with the same doc_id and text share it. Other columns are not read; an empty
    table gives an empty table.
    """
    reps = repetitions(recall=recall)
    plain = docs.select("doc_id", F.col(text).alias("text"))
    seed = SEED
    while True:
        all_rows = materialise(summaries(plain, "text", reps, seed), "sets")
        best = F.min(F.struct(F.col("doc_id").isNull().alias("u"), F.col("doc_id").alias("d"), F.col("raw").alias("r"))).alias("best")
        classes = materialise(all_rows.filter("n > 0").groupBy("f1").agg(best, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.min("f2").alias("lo"), F.max("f2").alias("hi")).withColumn("rep", F.col("best.d")), "classes")
        if not classes.filter("lo <> hi").limit(1).count():
            break
        seed += 1  # two sets have one fingerprint: take other fingerprints
    met = shared_leaves(classes)
    roots = components(materialise(first_edges(met, classes), "edges"))
    others = other_edges(met, classes, roots)
    if others.limit(1).count():
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(others))
    sized = roots.withColumnRenamed("node", "f1").join(classes.select("f1", "copies", "n"), "f1")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    chosen = materialise(sized.drop("n").join(blocks, "root"), "chosen")
    packs = max(1, chosen.count() // PACK_SETS)
    sets = whole_sets(plain, classes, chosen.select("f1"), "text", seed)
    mine = F.pmod(F.xxhash64("f1", F.lit(1)), "blocks").cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.join(chosen, "f1").withColumn("side", mine).withColumn("x", other).select(
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")).alias("pack"), F.col("root").alias("part"),
        F.least("side", "x").alias("i"), F.greatest("side", "x").alias("j"), "side", "f1", "copies", "sh",
    )
    found = materialise(exact_links(dealt), "links")
    final = components(found.filter("edge").select("a", "b"))
    links = found.filter("NOT edge").groupBy("a").agg(F.sum("links").alias("links"))
    named = classes.select("f1", "best", "copies").join(final.withColumnRenamed("node", "f1"), "f1", "left").withColumn("root", F.coalesce("root", "f1"))
    least = named.groupBy("root").agg(F.min("best").alias("stays"))
    told = materialise(named.join(least, "root").join(links.withColumnRenamed("a", "f1"), "f1", "left").select("f1", "stays", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "told")
    out = all_rows.select("doc_id", "raw", "f1", (F.col("n") > 0).alias("_words")).join(told, "f1", "left")
    mine = F.col("doc_id").eqNullSafe(F.col("stays.d")) & (F.col("raw") == F.col("stays.r"))
    return out.select(
        "doc_id", F.when(F.col("_words"), F.col("stays.d")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("_words"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        "raw", F.when(F.col("_words"), mine).otherwise(F.lit(True)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of every class, with all columns; of rows that repeat it, one.

    Rows are told apart by doc_id and text, so ids may repeat or be null.
    """
    told = materialise(near_duplicates(docs), "near-verdict")
    a, b = free_name(docs, "_near_id"), free_name(docs, "_near_raw")
    named = [F.col("doc_id").alias(a), F.col("raw").alias(b)]

    def without(rows: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
        return rows.join(small_side(keys, BROADCAST_ROWS), rows["doc_id"].eqNullSafe(keys[a]) & (_raw("text") == keys[b]), how)

    stay = without(docs, materialise(told.filter("NOT kept").select(*named).distinct(), "near-gone"))
    again = materialise(told.filter("kept AND n_links > 0").groupBy("doc_id", "raw").count().filter("count > 1").select(*named), "near-again")
    if not again.limit(1).count():
        return stay
    return without(stay, again).union(without(stay, again, "left_semi").dropDuplicates(["doc_id", "text"]))


def op2_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("raw", "kept")
