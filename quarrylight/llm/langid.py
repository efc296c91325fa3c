"""Language identification by hierarchical discrimination.

Linear support vector machines on byte n-grams first tell language families apart, one family against the rest; within
the family, one machine for each pair of its languages votes. All machines are linear in the relative frequencies of
n-grams, so a text of any length is scored by one sum over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import materialise, schema_with, set_aside, slices, small_side, string_buffers

#: Families of languages by ISO 639 code. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "baltic": ("lt", "lv"),
    "celtic": ("br", "cy", "ga", "gd"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "sa", "ur"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "semitic": ("ar", "he", "mt"),
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
UNDETERMINED = "und"
#: Training rows of each language at most, chosen by a hash of doc_id; bytes of a piece that is learnt beside each.
SAMPLE_ROWS, PIECE_BYTES = 400, 80
#: Rows of languages, or of the sample, that are broadcast at most.
BROADCAST_ROWS = 100_000
#: n-grams kept as features: the most frequent in the sample.
FEATURES = 6000
_BIGRAMS, _TRIGRAMS = 1 << 16, 1 << 16
_NONE = _BIGRAMS + _TRIGRAMS
_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers one document behind the other, offsets): letters in lower case, all else as space, a space at both ends."""
    n, length = len(offs) - 1, np.diff(offs)
    start = offs[:-1] + np.arange(n)
    chars = np.full(len(buf) + n + 2, 32, np.uint8)
    chars[np.arange(len(buf)) + np.repeat(np.arange(1, n + 1), length)] = _FOLD[buf]
    wide = chars.astype(np.uint32)
    two = (wide[:-2] << np.uint32(8)) | wide[1:-1]
    three = (((two << np.uint32(8)) | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    three += np.uint32(_BIGRAMS)
    three[(start + length).astype(np.int64)] = _NONE  # would reach into the next document
    both = np.empty((len(two), 2), np.int32)
    both[:, 0], both[:, 1] = two, three
    ends = 2 * np.append(start, start[-1] + length[-1] + 1 if n else 0)
    return both.ravel()[: ends[-1]], ends


@dataclass
class Rows:
    """Sparse rows: the features of row i and their values are in ptr[i] to ptr[i + 1]; ``mean`` is taken off every row."""

    ptr: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    mean: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.ptr)[rows]
        at = np.concatenate([np.arange(self.ptr[i], self.ptr[i + 1]) for i in rows]) if len(rows) else np.zeros(0, np.int64)
        return Rows(np.concatenate([[0], np.cumsum(size)]), self.feature[at], self.value[at], self.mean)


def train_svm(x: Rows, y: np.ndarray, cost: float = 0.05, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss, by dual coordinate descent.

    The mean is taken off by bookkeeping: the weights are u - s * mean, so a step touches a row's own features only.
    """
    n, mean = len(y), x.mean
    parts = [(x.feature[a:b], x.value[a:b]) for a, b in zip(x.ptr[:-1].tolist(), x.ptr[1:].tolist(), strict=True)]
    on_mean = np.array([v @ mean[f] for f, v in parts])
    mm = float(mean @ mean)
    own = np.array([float(v @ v) for _, v in parts]) - 2 * on_mean + mm + 1
    alpha, u, s, um, bias = np.zeros(n), np.zeros(len(mean)), 0.0, 0.0, 0.0
    order = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(n).tolist():
            f, v = parts[i]
            g = y[i] * (u[f] @ v - s * on_mean[i] - um + s * mm + bias) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / (own[i] + 0.5 / cost), 0.0)
            if new != alpha[i]:
                d = (new - alpha[i]) * y[i]
                u[f] += d * v
                um, s, bias = um + d * on_mean[i], s + d, bias + d
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return np.append(u - s * mean, bias)


@dataclass
class Model:
    """weights: one row for each n-gram, one column for each machine; families: the languages of each."""

    weights: np.ndarray
    bias: np.ndarray
    families: list[list[str]]
    pairs: dict[tuple[str, str], int] = field(default_factory=dict)

    @property
    def languages(self) -> list[str]:
        return [x for f in self.families for x in f]

    def predict(self, buf: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray]:
        """(language, score from 0 to 1) of every document."""
        ids, ends = grams(buf, offs)
        n = len(offs) - 1
        sums = np.empty((n, len(self.bias)))
        for k in range(len(self.bias)):
            sums[:, k] = np.add.reduceat(self.weights[:, k][ids], ends[:-1], dtype=np.float64) if n else 0
        margin = sums / np.maximum(np.diff(ends), 1)[:, None] + self.bias
        f = len(self.families)
        first = margin[:, : f if f > 2 else f - 1]
        scores = np.hstack([first, -first]) if f == 2 else first if f > 2 else np.zeros((n, 1))
        family = scores.argmax(1)
        sure = 1 / (1 + np.exp(-2 * np.clip(scores[np.arange(n), family], -30, 30))) if f > 1 else np.ones(n)
        langs = np.array(self.languages, object)
        at = np.cumsum([0] + [len(x) for x in self.families])
        out, score = np.empty(n, object), sure.copy()
        for k, members in enumerate(self.families):
            mine = np.flatnonzero(family == k)
            votes, strength = np.zeros((len(mine), len(members))), np.zeros((len(mine), len(members)))
            for i, j in combinations(range(len(members)), 2):
                m = np.clip(margin[mine, self.pairs[members[i], members[j]]], -30, 30)
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                strength[:, i] += m
                strength[:, j] -= m
            best = (votes + 0.5 * np.tanh(strength)).argmax(1)  # strength only decides between equal votes
            out[mine] = langs[at[k] + best]
            if len(members) > 1:
                score[mine] *= 1 / (1 + np.exp(-2 * strength[np.arange(len(mine)), best] / (len(members) - 1)))
        return list(out), score


def fit(counts: list[tuple[str, np.ndarray, np.ndarray]]) -> Model | None:
    """A model from (language, n-gram numbers, their counts) of sample texts; None if there are none."""
    langs = sorted({x[0] for x in counts})
    if not langs:
        return None
    total = np.zeros(_NONE + 1)
    for _, ids, n in counts:
        total[ids] += n / n.sum()
    total[_NONE] = 0
    top = np.sort(np.argsort(-total, kind="stable")[: min(FEATURES, int((total > 0).sum()))])
    column = np.full(_NONE + 1, -1)
    column[top] = np.arange(len(top))
    known = [column[ids] >= 0 for _, ids, _ in counts]
    feature = np.concatenate([column[ids[k]] for k, (_, ids, _) in zip(known, counts, strict=True)])
    value = np.concatenate([n[k] / n.sum() for k, (_, _, n) in zip(known, counts, strict=True)])
    ptr = np.concatenate([[0], np.cumsum([int(k.sum()) for k in known])])
    mean = np.bincount(feature, value, minlength=len(top)) / len(counts)
    spread = np.sqrt(mean) + 1e-9
    # rows are scaled to a mean square norm of one about their mean
    value = value / spread[feature]
    centre = mean / spread
    scale = np.sqrt(max(float(value @ value) / len(counts) - float(centre @ centre), 0.0)) or 1.0
    x = Rows(ptr, feature, value / scale, centre / scale)
    y = np.array([c[0] for c in counts])
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(FAMILY.get(lang.lower().split("-")[0], lang), []).append(lang)
    families = [groups[k] for k in sorted(groups)]
    machines, pairs = [], {}
    if len(families) > 1:
        for members in families if len(families) > 2 else families[:1]:
            machines.append(train_svm(x, np.where(np.isin(y, members), 1.0, -1.0)))
    for members in families:
        for a, b in combinations(members, 2):
            rows = np.flatnonzero(np.isin(y, (a, b)))
            pairs[a, b] = len(machines)
            machines.append(train_svm(x.take(rows), np.where(y[rows] == a, 1.0, -1.0)))
    weights, bias = np.zeros((_NONE + 1, max(1, len(machines))), np.float32), np.zeros(max(1, len(machines)))
    for k, w in enumerate(machines):
        per = w[:-1] / spread / scale
        weights[top, k] = per
        bias[k] = w[-1] - per @ mean
    return Model(np.asfortranarray(weights), bias, families, pairs)


def held_out(doc: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``rows`` texts of each language that are not held out, and a short piece of each.

    The driver holds the n-gram counts of these texts, at most FEATURES numbers each. Rows that repeat a doc_id are told
    apart by language and text; of equal rows one may be learnt as often as it occurs, within the bound.
    """
    usable = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang")
    order = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30))
    sizes = small_side(materialise(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "lang-sizes"), BROADCAST_ROWS)
    near = usable.join(sizes, "lang").filter(order < F.lit(1 << 30) * 2.0 * rows / F.col("_n") + 1)
    picked = near.distinct().withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))).filter(F.col("_r") <= rows).select("doc_id", "lang")
    picked = materialise(picked, "lang-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, ids, counts = [], [], []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = np.frombuffer((raw or "").encode(), np.uint8)
                middle = max(0, len(whole) // 2 - PIECE_BYTES // 2)
                for part in (whole, whole[middle : middle + PIECE_BYTES]):
                    if len(part):
                        found, n = np.unique(grams(part, np.array([0, len(part)]))[0], return_counts=True)
                        lang.append(name)
                        ids.append(found.astype(np.int32))
                        counts.append(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["lang", "ids", "counts"])

    key = small_side(picked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")), BROADCAST_ROWS)
    plain = docs.select("doc_id", "lang", F.col(text).alias("text"))
    texts = plain.join(key, (plain["doc_id"] == key["_id"]) & (plain["lang"] == key["_lang"])).select("_lang", "doc_id", "text")
    first = Window.partitionBy("_lang").orderBy(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)), "doc_id", F.xxhash64("text"))
    texts = texts.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= rows).select("_lang", "text")
    got = texts.mapInArrow(count, "lang string, ids array<int>, counts array<int>").toPandas()
    got = sorted(zip(got["lang"], got["ids"], got["counts"], strict=True), key=lambda x: (x[0], len(x[1]), np.asarray(x[1]).tobytes(), np.asarray(x[2]).tobytes()))
    return fit([(a, np.asarray(b, np.int64), np.asarray(c, np.float64)) for a, b, c in got])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, from whole texts alone.

    Null texts and texts without a letter are `und` with score 0, as are all if there is no model. Other columns
    and repeated rows pass through, columns of the new names under a leading underscore; an empty table gives an empty table.
    """

    docs = set_aside(docs, "lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            buf, offs = string_buffers(column)
            lang, score = [], [np.zeros(0)]
            for a, b in slices(offs):
                part, off = buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                if model is None:
                    one, sure = [UNDETERMINED] * (b - a), np.zeros(b - a)
                else:
                    one, sure = model.predict(part, off)
                ascii_letter = np.concatenate([[0], np.cumsum((_FOLD[part] != 32) & (part < 0x80))])
                for k in np.flatnonzero(ascii_letter[off[1:]] == ascii_letter[off[:-1]]).tolist():
                    if not any(c.isalpha() for c in part[off[k] : off[k + 1]].tobytes().decode()):
                        one[k], sure[k] = UNDETERMINED, 0.0
                lang += one
                score.append(sure)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(np.concatenate(score))], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema_with(docs.schema, lang_pred=T.StringType(), score=T.DoubleType()))


def op1_hierarchical_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
