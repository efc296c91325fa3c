"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight schedule over training time 0 to 1, linear between knots. Its integral, scaled to the
source's target, is the source's cumulative token demand. A document stands at a range of its source's tokens; the
inverse of the demand at that range gives the document's training position, and positions are sorted by range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import WORD, doc_order, free_name, materialise, small_side

#: Weights of the sources in code point order, repeating; the share of all sizes that the mix takes, in halves;
#: and how often a source is read at most.
WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3
MOST_PASSES = 2
#: Weight schedules of the sources in code point order, repeating: (time, weight) knots from time 0 to 1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (1.0, 1.0)), ((0.0, 1.0), (0.5, 1.0), (1.0, 3.0)))
#: Documents that a range of the order within a source aims at; one task sums one range.
RANGE_ROWS = 4096
BROADCAST_ROWS = 100_000
#: Documents whose places (some 50 bytes each) are broadcast at most.
BROADCAST_DOCS = 500_000


def words(text: str = "text") -> Column:
    """The number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, target): weighted shares of the mix; what is above twice a source's size is shared anew.

    With the sources in the order of the share at which they fill up (2 * size / weight), those before the first one
    that does not fill up are full, and the others share the rest by weight. All arithmetic is on whole numbers but
    the last division.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    s = by_source.withColumn("rank", rank).withColumn("w", weight).withColumn("full", MOST_PASSES * F.col("source_size"))
    order = Window.orderBy((F.col("full") / F.col("w")), "rank")
    before = F.col("sum_full") - F.col("full")
    s = s.withColumn("sum_full", F.sum("full").over(order)).withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    # does this source stay below full when those before it are full? SHARE/2 * total - before <= full / w * left_w
    fits = (SHARE_HALVES * F.col("total") - 2 * before) * F.col("w") <= 2 * F.col("full") * F.col("left_w")
    s = s.withColumn("fits", fits)
    part = F.max(F.when(F.col("fits"), F.struct(-F.col("sum_full") + F.col("full"), F.col("left_w")))).over(Window.partitionBy())
    s = s.withColumn("cut", part)
    rest = (SHARE_HALVES * F.col("total") + 2 * F.col("cut.col1")) * F.col("w")
    target = F.when(F.col("fits"), rest.cast("double") / (2 * F.col("cut.left_w")).cast("double")).otherwise(F.col("full").cast("double"))
    return s.select("source", "source_size", "rank", F.least(target, F.col("full").cast("double")).alias("target"))


def _integrated(knots: tuple) -> list[tuple[float, float, float, float, float]]:
    """Segments (demand before it, time, length, weight, slope) of the normalised cumulative demand."""
    area = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:], strict=False))
    out, done = [], 0.0
    for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
        out.append((done, a, b - a, u / area, (v - u) / (b - a) / area))
        done += (b - a) * (u + v) / 2 / area
    return out


def invert_demand(share: Column, rank: Column) -> Column:
    """The time at which a source of this rank has used this share (0 to 1) of its target."""
    found = F.lit(None).cast("double")
    for i, knots in enumerate(SCHEDULES):
        time = F.lit(0.0)
        for done, t0, _, w, slope in _integrated(knots):
            rest = share - F.lit(done)
            # w * x + slope / 2 * x**2 = rest, solved without loss where the slope is 0
            x = 2 * rest / (F.lit(w) + F.sqrt(F.greatest(F.lit(w * w) + 2 * F.lit(slope) * rest, F.lit(0.0))))
            time = F.when(rest >= 0, F.lit(t0) + x).otherwise(time)
        found = F.when(rank % len(SCHEDULES) == i, F.least(F.lit(1.0), time)).otherwise(found)
    return found


def curriculum(sizes: DataFrame) -> DataFrame:
    """Adds source_size, target, taken, position and position_again to a materialised table (doc_id, source, size, ...).

    taken counts the words of a document that the mix takes, repeats counted: its source is read in a seeded order
    from the start, up to twice, until the target (rounded) is reached. position is the training time (0 to 1) of the
    middle of the words taken in the first pass, position_again of those taken in the second; null if there are none.
    A null source is one more source, the last; empty texts have size 0 and are never taken.
    """
    n = sizes.count()
    bits = max(0, math.ceil(math.log2(max(1, n / RANGE_ROWS))))
    h = F.shiftright(F.col("_h"), 60 - bits) if bits else F.lit(0).cast("long")
    rows = sizes.withColumn("_h", doc_order()).withColumn("_range", h)
    targets = materialise(source_targets(sizes), "targets").withColumn("_reach", F.round("target").cast("long")).withColumnRenamed("source", "_source")
    within = Window.partitionBy("source", "_range").orderBy("_h", "doc_id", "size")
    starts = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    starts = starts.select(F.col("source").alias("_src"), F.col("_range").alias("_rng"), (F.sum("_sum").over(Window.partitionBy("source").orderBy("_range")) - F.col("_sum")).alias("_before"))
    local = rows.withColumn("_here", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = local.join(starts, local["source"].eqNullSafe(starts["_src"]) & (local["_range"] == starts["_rng"])).join(small_side(targets, BROADCAST_ROWS), local["source"].eqNullSafe(targets["_source"]))
    at, size, zero = F.col("_before") + F.col("_here"), F.col("size"), F.lit(0).cast("long")
    first = F.greatest(zero, F.least(size, F.col("_reach") - at))
    again = F.greatest(zero, F.least(size, F.col("_reach") - at - F.col("source_size")))
    middle = lambda start, part: F.when(part > 0, F.round(invert_demand((start + part / 2) / F.col("_reach"), F.col("rank")), 9))
    return placed.select(
        *sizes.columns, "source_size", "target", (first + again).alias("taken"),
        middle(at, first).alias("position"), middle(at + F.col("source_size"), again).alias("position_again"),
    )


def mix(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the mix takes, all columns, in training order; a document that is read twice comes twice.

    A document of which the last pass takes at least half is read whole in that pass, else not.
    """
    slim = materialise(docs.select("doc_id", "source", words(text).alias("size")), "mix-sizes")
    placed = materialise(curriculum(slim).filter("taken > 0"), "mix-placed")
    key, times, at = free_name(docs, "_mix_id"), free_name(docs, "_mix_times"), free_name(docs, "_mix_at")
    times_col = F.filter(F.array(F.when(2 * F.least(F.col("taken"), F.col("size")) >= F.col("size"), F.col("position")), F.when(2 * (F.col("taken") - F.col("size")) >= F.col("size"), F.col("position_again"))), lambda x: x.isNotNull())
    # as a broadcast, whole texts travel once, to their places in training order; beyond the bound they are shuffled twice
    chosen = materialise(placed.groupBy(F.col("doc_id").alias(key)).agg(F.max(times_col).alias(times)), "mix-chosen")
    chosen = small_side(chosen, BROADCAST_DOCS)
    joined = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[key])).withColumn(at, F.explode(times))
    return joined.repartitionByRange(at, "doc_id").sortWithinPartitions(at, "doc_id").select(*docs.columns)


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = materialise(docs.select("doc_id", "source", words().alias("size")), "mix-sizes")
    placed = materialise(curriculum(slim), "mix-placed")
    ordered = placed.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", "target", "taken", "position", "position_again")


def _sql_time(share: str) -> str:
    out = "CASE rank % 3"
    for i, knots in enumerate(SCHEDULES):
        arm = "0.0::DOUBLE"
        for done, t0, _, w, slope in _integrated(knots):
            rest = f"({share} - {done!r}::DOUBLE)"
            arm = f"CASE WHEN {rest} >= 0 THEN {t0!r}::DOUBLE + 2 * {rest} / ({w!r}::DOUBLE + sqrt(greatest({w * w!r}::DOUBLE + 2 * {slope!r}::DOUBLE * {rest}, 0.0::DOUBLE))) ELSE {arm} END"
        out += f" WHEN {i} THEN least(1.0::DOUBLE, {arm})"
    return out + " END"


OP8_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][rank % 3 + 1]::BIGINT AS w, (SELECT sum(source_size) FROM s)::BIGINT AS total FROM s),
-- share the mix out, fill what is above twice its size, and again, until none is above
r AS (
  SELECT 0 AS round, source, source_size, rank, w, total, false AS full_ FROM w
  UNION ALL
  SELECT round + 1, source, source_size, rank, w, total,
         full_ OR (3 * total - 2 * coalesce(sum(CASE WHEN full_ THEN 2 * source_size END) OVER (), 0)) * w
                  > 4 * source_size * sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ()
  FROM r WHERE round < (SELECT count(*) FROM s)),
t AS (
  SELECT source, source_size, rank,
         CASE WHEN full_ THEN (2 * source_size)::DOUBLE
              ELSE ((3 * total - 2 * coalesce(sum(CASE WHEN full_ THEN 2 * source_size END) OVER (), 0)) * w)::DOUBLE
                   / (2 * sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ())::DOUBLE END AS target
  FROM r WHERE round = (SELECT count(*) FROM s)),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, round(t.target)::BIGINT AS reach,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start_at
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, reach - start_at)) AS one, greatest(0, least(size, reach - start_at - source_size)) AS two FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN round({_sql_time("((start_at + one / 2) / reach)")}, 9) END AS position,
       CASE WHEN two > 0 THEN round({_sql_time("((start_at + source_size + two / 2) / reach)")}, 9) END AS position_again
FROM q
"""
