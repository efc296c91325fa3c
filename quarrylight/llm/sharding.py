"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the whole records over memory-sized buckets by seeded hashes; pass two permutes each bucket
by Fisher-Yates with seeded draws and writes it. The shard of a record depends on its key and the number
of shards alone (highest random weight), so one more shard takes rows only into itself. A record moves once:
what is gathered in memory is the order of a bucket, not its records, which are sorted and may spill.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise, quoted, shared_dir, small_side

SHARDS = 16
#: Rows and bytes that a bucket aims at. A bucket is permuted in one task.
BUCKET_ROWS = 1024
BUCKET_BYTES = 32 << 20
#: Bytes of records that a task of pass two aims at, where the session's number of shuffle partitions gives more.
TASK_BYTES = 64 << 20
#: Distinct rows that repeat over half a bucket: broadcast up to this many, joined by a shuffle beyond.
OFTEN_ROWS = 100_000
SEED = 20_231


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the greatest weight for the key; ties go to the smaller number. A null key is one more key."""
    weights = [F.struct(F.xxhash64(F.lit(seed), F.lit(s), key).alias("w"), F.lit(-s).alias("s")) for s in range(shards)]
    return (-F.greatest(*weights).getField("s")).cast("int") if shards > 1 else F.lit(0)


def fisher_yates(items: Column, seed: Column) -> Column:
    """The array in the order of an inside-out Fisher-Yates shuffle whose draws come from the seed.

    Step i draws j in 0..i; the item at j moves to the end, and item i takes its place.
    """

    def step(done: Column, item: Column) -> Column:
        i = F.size(done)
        j = F.pmod(F.xxhash64(seed, i), i + 1).cast("int")
        moved = F.concat(F.slice(done, F.lit(1), j), F.array(item), F.slice(done, j + 2, i), F.array(F.coalesce(F.get(done, j), F.lit(0))))
        return F.when(j == i, F.concat(done, F.array(item))).otherwise(moved)

    return F.aggregate(F.slice(items, 2, F.size(items)), F.slice(items, 1, 1), step)


def shuffle_shards(records: DataFrame, key: str, shards: int = SHARDS, size: Column | None = None, seed: int = SEED) -> DataFrame:
    """All records with shard, grown_shard and slot (0 to the shard's rows less 1), in the shuffled order.

    size: bytes of a record (1 if not given). Rows with the same key share a shard; rows that are the same in
    every column are interchangeable, and where one repeats very often its copies are dealt over all buckets
    of the shard. Nulls are hashed as any value; an empty table gives an empty table. Columns of the input
    called shard, slot or grown_shard are kept under a leading underscore. Each partition of the result is a run
    of buckets, so of each shard it holds one range of slots. One line per bucket (its first slot and its rows)
    is broadcast.
    """
    spark, own = records.sparkSession, {"shard", "slot", "grown_shard"}
    taken = {c.lower() for c in records.columns}
    names = {}
    for c in records.columns:
        if c.lower() in own:
            name = f"_{c}"
            while name.lower() in taken:
                name = f"_{name}"
            taken.add(name.lower())
            names[c] = name
        else:
            names[c] = c

    def hashable(c: str) -> Column:
        kind = records.schema[c].dataType.simpleString()
        return F.col(quoted(c)) if "map<" not in kind and "variant" not in kind else F.to_json(F.struct(F.col(quoted(c))))

    key_col = F.col(quoted(key))
    rows = records.select(
        shard_of(key_col, shards, seed).alias("shard"), shard_of(key_col, shards + 1, seed).alias("grown_shard"),
        F.xxhash64(F.lit(seed), *[hashable(c) for c in records.columns]).alias("_hash"), (F.lit(1) if size is None else size).alias("_weight"),
        F.struct(*[F.col(quoted(c)).alias(n) for c, n in names.items()]).alias("_row"),
    )
    keys = materialise(rows.select("shard", "_hash", "_weight"), "keys")
    total = keys.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_weight"), F.lit(0)).alias("b")).first()
    buckets = max(1, math.ceil(total["n"] / shards / BUCKET_ROWS), math.ceil(total["b"] / shards / BUCKET_BYTES))
    tasks = min(shards * buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total["b"] / TASK_BYTES)))
    #: a row that repeats over half a bucket: its copies are dealt by the task that read them as well
    often = keys.groupBy("shard", "_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > BUCKET_ROWS // 2).select("shard", "_hash", F.lit(1).alias("_often"))
    often = materialise(often, "often")
    salt = F.lit(None).cast("long")
    if often.limit(1).count():
        # written once: the buckets are counted and filled by the same numbers
        rows = keys = materialise(rows.withColumn("_task", F.monotonically_increasing_id()).join(small_side(often, OFTEN_ROWS), ["shard", "_hash"], "left"), "rows")
        salt = F.when(F.col("_often").isNotNull(), F.col("_task"))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "_hash", salt), F.lit(buckets)).cast("int")
    counts = keys.select("shard", bucket.alias("_bucket")).groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_count"))
    starts = counts.select("shard", "_bucket", "_count", (F.sum("_count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_count")).alias("_start"))
    # pass one: the buckets in order, dealt over the tasks in runs
    place = F.col("shard").cast("long") * buckets + F.col("_bucket")
    dealt = rows.select("shard", "grown_shard", "_hash", bucket.alias("_bucket"), "_row").withColumn("_part", F.floor(place * tasks / (shards * buckets)).cast("int"))
    # pass two: the record of rank r in its bucket goes where the shuffled order of the bucket has r
    within = Window.partitionBy("_part", "shard", "_bucket").orderBy("_hash")
    ranked = dealt.repartitionById(tasks, F.col("_part")).withColumn("_rank", (F.row_number().over(within) - 1).cast("int")).join(F.broadcast(starts), ["shard", "_bucket"])
    order = fisher_yates(F.sequence(F.lit(0), F.col("_count").cast("int") - 1), F.xxhash64(F.lit(seed + 2), "shard", "_bucket"))
    once = ranked.withColumn("_order", F.when(F.col("_rank") == 0, order))
    known = once.withColumn("_order", F.first("_order", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    slot = (F.col("_start") + F.array_position("_order", F.col("_rank")) - 1).cast("long")
    return known.select(*[F.col("_row")[n].alias(n) for n in names.values()], "shard", "grown_shard", slot.alias("slot"))


def write_shards(sharded: DataFrame, path: str, in_runs: bool = False) -> None:
    """Writes shard=N folders whose files hold ascending, disjoint ranges of slots.

    in_runs: the partitions are those of shuffle_shards, so the records need not move again.
    """
    runs = sharded if in_runs else sharded.repartitionByRange("shard", "slot")
    runs.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    sharded = shuffle_shards(docs, "doc_id", SHARDS, size)
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    write_shards(sharded, path, in_runs=True)
    out = spark.read.schema(sharded.schema).parquet(path)
    return out.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
