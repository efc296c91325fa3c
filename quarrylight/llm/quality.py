"""Quality rules with adaptive thresholds.

The words, symbols and repeats of every whole text are counted. Mergeable quantile sketches per language and source learn
how their documents are spread, and each sketch sets its own fence: between the usual documents and a minority that stands
clearly apart, or, where there is none, far out on the tail. No value of a measure is fixed beforehand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.llm.common import SPACE, Spans, free_name, materialise, mix, per_doc, schema_with, set_aside, slices, small_side, string_buffers, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Base rule: too few words, or too many of them in repeated three-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Measures: what is counted, in how much, and how many come in one event. A document's value is the share, in
#: thousandths, that is left after CHANCE standard deviations of a chance count are taken off.
MEASURES = {"symbols": ("n_symbols", "word_chars", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 3)}
CHANCE = 3
#: Cells of a sketch: values below FINE have a cell each, every doubling above has FINE cells (relative error 1 / FINE).
FINE = 16
#: Documents stand apart if the lower tenth of them is this many cells (two doublings) above 99% of the others.
APART = 32
#: The tail is left behind at the median of the values above zero plus so many times its distance from their 25th percentile.
SPREADS = 8
#: Sketches of fewer documents, or without a split and with fewer values above zero, are merged: those of a source's
#: languages into one per language, those into one.
LEAST_DOCS, LEAST_TAIL = 200, 100
BROADCAST_ROWS = 100_000
_ODD3 = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def text_counts(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for documents that lie one behind the other in buf."""
    n = len(offs) - 1
    spans, (start, end) = Spans(buf), word_spans(buf, offs)
    first = np.searchsorted(start, offs)  # words of document i: first[i] to first[i + 1]
    out = {"n_words": np.diff(first)}
    out["word_chars"] = per_doc(((buf & 0xC0) != 0x80) & ~SPACE[buf], offs)
    out["n_symbols"] = per_doc(_SYMBOL[buf], offs)
    # lines that hold a word
    newline = np.flatnonzero(buf == 10)
    line_start = np.union1d(offs[:-1], newline + 1)
    line_start = line_start[line_start < len(buf)]
    stop = np.append(line_start[1:], len(buf))
    stop = stop - (buf[np.maximum(stop - 1, 0)] == 10) if len(stop) else stop
    worded = np.searchsorted(start, stop) > np.searchsorted(start, line_start) if len(stop) else np.zeros(0, bool)
    line_start, stop = line_start[worded], stop[worded]
    doc = np.searchsorted(offs, line_start, "right") - 1
    out["n_lines"] = np.bincount(doc, minlength=n)
    key = np.sort(spans.hashes(line_start, stop) ^ mix(doc.astype(np.uint64)))
    again = np.zeros(n, np.int64)
    if len(key):
        dup_key = key[1:][key[1:] == key[:-1]]
        if len(dup_key):
            mine = spans.hashes(line_start, stop) ^ mix(doc.astype(np.uint64))
            hit = np.isin(mine, dup_key)
            hit_key, hit_doc = mine[hit], doc[hit]
            order = np.argsort(hit_key, kind="stable")
            same = hit_key[order][1:] == hit_key[order][:-1]
            again = np.bincount(hit_doc[order][1:][same], minlength=n)
    out["n_dup_lines"] = again
    # words in three-word windows that occur twice or more in their document
    covered = np.zeros(len(start), bool)
    if len(start) >= 3:
        word = spans.hashes(start, end)
        word_doc = np.repeat(np.arange(n), np.diff(first))
        inside = word_doc[2:] == word_doc[:-2]
        window = mix(word[:-2] * _ODD3[0] + word[1:-1] * _ODD3[1] + word[2:] * _ODD3[2] + word_doc[2:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[inside]
        at = np.flatnonzero(inside)
        ordered = np.sort(window)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            hit = at[_member(window, twice)]
            covered[hit] = covered[hit + 1] = covered[hit + 2] = True
    out["n_repeat_words"] = per_doc(covered, first)
    return out


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array; a 16-bit filter spares most of the search."""
    seen = np.zeros(1 << 16, bool)
    seen[(ordered >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> np.uint64(48)).astype(np.int64)])
    found = np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values[maybe]), len(ordered) - 1)
    found[maybe] = ordered[at] == values[maybe]
    return found


def annotate(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the columns of COUNTS; columns of these names get a leading underscore. Null texts have no words."""
    docs = set_aside(docs, *COUNTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text)
            buf, offs = string_buffers(batch.column(i))
            parts = [text_counts(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]) for a, b in slices(offs)]
            more = {k: pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for k in COUNTS}
            names = [n for n in batch.schema.names if keep_text or n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *more.values()], [*names, *more])

    base = docs.schema if keep_text else T.StructType([f for f in docs.schema.fields if f.name != text])
    return docs.mapInArrow(count, schema_with(base, **{k: T.LongType() for k in COUNTS}))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def measures() -> dict[str, Column]:
    """The cell of each measure's value."""

    def cell(count: str, of: str, unit: int) -> Column:
        value = f"coalesce(cast(floor(1000 * greatest(0D, {count} - {CHANCE} * sqrt({unit} * {count})) / nullif({of}, 0)) as bigint), 0L)"
        bits = f"cast(length(bin({value})) - {FINE.bit_length()} as int)"
        return F.expr(f"CASE WHEN {value} < {FINE} THEN {value} ELSE {FINE} * {bits} + shiftright({value}, {bits}) END")

    return {k: cell(*v) for k, v in MEASURES.items()}


def _fences(sketch: DataFrame, level: list[str]) -> DataFrame:
    """(level, measure, docs, fence, sure) of sketches (level, measure, cell, n); sure where this sketch is enough.

    The cells are split in two where the variance between the parts is greatest. The split is the fence if the upper part
    is the smaller one and stands apart; else the fence is the far end of the tail, which is null if all values are 0.
    """
    merged = sketch.groupBy(*level, "measure", "cell").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*level, "measure")  # at most some hundred cells
    upto = whole.orderBy("cell")
    rows = merged.withColumns({"c": F.sum("n").over(upto), "s": F.sum(F.col("n") * F.col("cell")).over(upto), "docs": F.sum("n").over(whole), "total": F.sum(F.col("n") * F.col("cell")).over(whole), "none": F.coalesce(F.sum(F.when(F.col("cell") == 0, F.col("n"))).over(whole), F.lit(0))})
    double = lambda c: F.col(c).cast("double")
    gap = double("total") * double("c") - double("docs") * double("s")
    score = F.when(F.col("c") < F.col("docs"), gap * gap / (double("c") * (double("docs") - double("c"))))
    best = F.max(F.struct(F.coalesce(score, F.lit(-1.0)).alias("score"), (-F.col("cell")).alias("cell"), F.col("c").alias("c"))).over(whole)
    rows = rows.withColumn("best", best).withColumns({"split": F.when(F.col("best.score") >= 0, -F.col("best.cell")), "below": F.col("best.c")})
    least = lambda when: F.min(F.when(when, F.col("cell")))
    found = rows.groupBy(*level, "measure").agg(
        F.max("docs").alias("docs"), F.max(F.col("docs") - F.col("none")).alias("tail"), F.max("split").alias("split"), F.max("below").alias("below"),
        least(100 * F.col("c") >= 99 * F.col("below")).alias("usual"), least((F.col("cell") > F.col("split")) & (10 * (F.col("c") - F.col("below")) >= F.col("docs") - F.col("below"))).alias("odd"),
        least((F.col("cell") > 0) & (2 * (F.col("c") - F.col("none")) >= F.col("docs") - F.col("none"))).alias("q50"), least((F.col("cell") > 0) & (4 * (F.col("c") - F.col("none")) >= F.col("docs") - F.col("none"))).alias("q25"),
    )
    apart = F.coalesce((F.col("odd") - F.col("usual") >= APART) & (2 * (F.col("docs") - F.col("below")) < F.col("docs")), F.lit(False))
    fence = F.when(apart, F.col("split")).otherwise(F.col("q50") + SPREADS * (F.col("q50") - F.col("q25")))
    return found.select(*level, "measure", "docs", fence.alias("fence"), ((F.col("docs") >= LEAST_DOCS) & (apart | (F.col("tail") >= LEAST_TAIL))).alias("sure"), apart.alias("apart"))


def thresholds(counted: DataFrame) -> DataFrame:
    """(lang, source, the highest usual cell of each measure) from sketches of the documents that pass the base rule.

    A sketch counts a measure's values in cells of bounded relative error; sketches merge by adding counters, in any order.
    """
    usable = counted.filter(~base_failed())
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), v.alias("cell")) for k, v in measures().items()]))
    sketch = usable.select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.measure", "p.cell").agg(F.count(F.lit(1)).alias("n"))
    sketch = materialise(sketch, "quality-sketch")

    def fences(level: list[str], tag: str) -> DataFrame:
        f = _fences(sketch, level)
        wide = f.groupBy(*level).agg(*[F.max(F.when((F.col("measure") == k) & F.col("sure"), F.struct(F.col("fence").alias("fence")))).alias(f"{tag}_{k}") for k in MEASURES]) if level else f.agg(*[F.max(F.when(F.col("measure") == k, F.struct(F.col("fence").alias("fence")))).alias(f"{tag}_{k}") for k in MEASURES])
        return wide.select(*[F.col(c).alias(f"{tag}_{c}") for c in level], *wide.columns[len(level) :])

    one, two, three = fences(["lang", "source"], "a"), fences(["lang"], "b"), fences([], "c")
    names = counted.select("lang", "source").distinct()
    out = names.join(one, names["lang"].eqNullSafe(one["a_lang"]) & names["source"].eqNullSafe(one["a_source"]), "left")
    out = out.join(two, out["lang"].eqNullSafe(two["b_lang"]), "left").join(F.broadcast(three), F.lit(True), "left")  # one row
    return out.select("lang", "source", *[F.coalesce(f"a_{k}", f"b_{k}", f"c_{k}")["fence"].alias(f"most_{k}") for k in MEASURES])


def judged(counted: DataFrame, limits: DataFrame) -> DataFrame:
    """counted with base_failed and kept. limits: the materialised thresholds."""
    limits = small_side(limits, BROADCAST_ROWS).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"most_{k}" for k in MEASURES])
    both = counted.join(limits, counted["lang"].eqNullSafe(limits["_lang"]) & counted["source"].eqNullSafe(limits["_source"]), "left")
    usual = F.lit(True)
    for k, v in measures().items():
        usual = usual & (v <= F.coalesce(F.col(f"most_{k}"), F.lit(1 << 60)))
    return both.select(*counted.columns, base_failed().alias("base_failed"), (~base_failed() & usual).alias("kept"))


def keep_usual(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with their columns as they were.

    Null and empty texts have no words and are rejected, as is every text under LEAST_WORDS words; null languages and
    sources are groups of their own; repeated rows are judged alike; an empty table gives an empty table.
    """
    plain = docs.select("lang", "source", F.col(text).alias("text"))
    counted = materialise(annotate(plain, keep_text=False), "quality-counts")
    limits = materialise(thresholds(counted), "quality-limits")
    whole, mine = free_name(docs, "_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("lang").alias("lang"), F.col("source").alias("source"), F.col(text).alias("text"), mine.alias(whole))
    return judged(annotate(rows), limits).filter("kept").select(f"{whole}.*")


def op10_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    counted = materialise(annotate(docs, keep_text=False), "quality-counts")
    out = judged(counted, materialise(thresholds(counted), "quality-limits"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_cell(count: str, of: str, unit: int) -> str:
    value = f"coalesce(floor(1000 * greatest(0::DOUBLE, {count} - {CHANCE} * sqrt({unit} * {count})) / nullif({of}, 0))::BIGINT, 0)"
    bits = f"(length(bin({value})) - {FINE.bit_length()})"
    return f"CASE WHEN {value} < {FINE} THEN {value} ELSE {FINE} * {bits} + ({value} >> {bits}) END"


def _sql_fence(level: str, tag: str) -> str:
    by = f"{level}," if level else ""
    return f"""{tag}_m AS (SELECT {by} measure, cell, count(*) AS n FROM v GROUP BY {by} measure, cell),
{tag}_u AS (
  SELECT *, sum(n) OVER (PARTITION BY {by} measure ORDER BY cell) AS c, sum(n * cell) OVER (PARTITION BY {by} measure ORDER BY cell) AS s, sum(n) OVER (PARTITION BY {by} measure) AS docs,
         sum(n * cell) OVER (PARTITION BY {by} measure) AS total, coalesce(sum(n) FILTER (cell = 0) OVER (PARTITION BY {by} measure), 0) AS none
  FROM {tag}_m),
{tag}_s AS (
  SELECT *, CASE WHEN c < docs THEN (total::DOUBLE * c::DOUBLE - docs::DOUBLE * s::DOUBLE) * (total::DOUBLE * c::DOUBLE - docs::DOUBLE * s::DOUBLE) / (c::DOUBLE * (docs::DOUBLE - c::DOUBLE)) END AS score FROM {tag}_u),
{tag}_b AS (
  SELECT *, first_value(CASE WHEN score IS NOT NULL THEN cell END) OVER w AS split, first_value(CASE WHEN score IS NOT NULL THEN c END) OVER w AS below
  FROM {tag}_s WINDOW w AS (PARTITION BY {by} measure ORDER BY score DESC NULLS LAST, cell)),
{tag}_q AS (
  SELECT {by} measure, max(docs) AS docs, max(docs - none) AS tail, max(split) AS split, max(below) AS below, min(cell) FILTER (100 * c >= 99 * below) AS usual,
         min(cell) FILTER (cell > split AND 10 * (c - below) >= docs - below) AS odd, min(cell) FILTER (cell > 0 AND 2 * (c - none) >= docs - none) AS q50,
         min(cell) FILTER (cell > 0 AND 4 * (c - none) >= docs - none) AS q25
  FROM {tag}_b GROUP BY {by} measure),
{tag} AS (
  SELECT {by} measure, CASE WHEN apart THEN split ELSE q50 + {SPREADS} * (q50 - q25) END AS fence, docs >= {LEAST_DOCS} AND (apart OR tail >= {LEAST_TAIL}) AS sure
  FROM (SELECT *, coalesce(odd - usual >= {APART} AND 2 * (docs - below) < docs, false) AS apart FROM {tag}_q))"""


_SQL_VALUES = f"unnest([{', '.join(repr(k) for k in MEASURES)}]) AS measure, unnest([{', '.join(MEASURES)}]) AS cell"


OP10_SQL = rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM pos),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n >= 2) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
m AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
         {", ".join(f"{_sql_cell(*x)} AS {k}" for k, x in MEASURES.items())}
  FROM c),
v AS (SELECT lang, source, {_SQL_VALUES} FROM m WHERE NOT base_failed),
{_sql_fence("lang, source", "a")},
{_sql_fence("lang", "b")},
{_sql_fence("", "c3")},
k AS (
  SELECT x.doc_id, bool_and(coalesce(x.cell <= CASE WHEN a.sure THEN a.fence WHEN b.sure THEN b.fence ELSE c3.fence END, true)) AS usual
  FROM (SELECT doc_id, lang, source, {_SQL_VALUES} FROM m) x
  LEFT JOIN a ON a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source AND a.measure = x.measure
  LEFT JOIN b ON b.lang IS NOT DISTINCT FROM x.lang AND b.measure = x.measure
  LEFT JOIN c3 ON c3.measure = x.measure
  GROUP BY x.doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(usual, true) AS kept
FROM m LEFT JOIN k ON m.doc_id = k.doc_id
"""
