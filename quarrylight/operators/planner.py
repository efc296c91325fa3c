"""The refresh planner: what changed between the files and the saved catalog, and what each backend has to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files above this size count as absent.
MOST_BYTES = 5 * 1024 * 1024
BATCH = 200
OPS = ("compute", "delete", "addTag", "removeTag")
ADDS = ("compute", "addTag")


def latest(catalog: DataFrame) -> DataFrame:
    """(path, cache_key, last_updated, n_versions) of the newest saved version; of equally new ones the least hash."""
    return catalog.groupBy("path").agg(_newest()["cache_key"].alias("cache_key"), F.max("last_updated").alias("last_updated"), F.count(F.lit(1)).alias("n_versions"))


def _newest() -> Column:
    """Of a path's saved versions the newest, of equally new ones the least hash."""
    return F.min(F.struct(F.col("last_updated").isNull().alias("unknown"), (-F.col("last_updated")).alias("age"), F.col("cache_key").alias("cache_key")))


def diff(files: DataFrame, catalog: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """(path, cache_key, kind) with kind add, remove or touch.

    files: path, size, last_modified, cache_key. A saved path that has no file (or one that is too large) is removed in
    all versions. A newer file with another hash is added and all saved versions removed; with the same hash it is
    touched and other versions removed. Files that are not newer change nothing; unseen ones are added.
    """
    current = files.filter(F.col("size") <= MOST_BYTES)
    if paths is not None:
        current, catalog = current.filter(F.col("path").isin(paths)), catalog.filter(F.col("path").isin(paths))
    saved = catalog.groupBy("path").agg(F.collect_list("cache_key").alias("versions"), _newest()["cache_key"].alias("old"), F.max("last_updated").alias("saved_at"))
    both = saved.join(current.select("path", F.col("cache_key").alias("new"), "last_modified"), "path", "full_outer")
    item = lambda key, kind: F.struct(key.alias("cache_key"), F.lit(kind).alias("kind"))
    every = lambda kind, keep=None: F.transform(F.filter("versions", keep) if keep else F.col("versions"), lambda v: item(v, kind))
    newer = F.col("saved_at") < F.col("last_modified")
    plan = (
        F.when(F.col("versions").isNull(), F.array(item(F.col("new"), "add")))
        .when(F.col("last_modified").isNull(), every("remove"))
        .when(newer & (F.col("old") != F.col("new")), F.concat(F.array(item(F.col("new"), "add")), every("remove")))
        .when(newer, F.concat(F.array(item(F.col("new"), "touch")), every("remove", lambda v: v != F.col("new"))))
    )
    return both.select("path", F.explode(plan).alias("p")).select("path", "p.cache_key", "p.kind")


def ops(changes: DataFrame, global_cache: DataFrame, artifact: str) -> DataFrame:
    """(path, cache_key, op): added hashes that the artifact knows anywhere get a tag, others are computed; removed
    hashes known under more than one tag lose one, others are deleted. Touches have none."""
    known = global_cache.filter(F.col("artifact_id") == artifact).groupBy("cache_key").agg(F.count(F.lit(1)).alias("tags"))
    both = changes.filter("kind <> 'touch'").join(known, "cache_key", "left")
    op = F.when(F.col("kind") == "add", F.when(F.col("tags") > 0, "addTag").otherwise("compute")).otherwise(F.when(F.col("tags") > 1, "removeTag").otherwise("delete"))
    return both.select("path", "cache_key", op.alias("op"))


def add_or_remove(op: Column) -> Column:
    return F.when(op.isin(*ADDS), "add").otherwise("remove")


def catalog_after(catalog: DataFrame, changes: DataFrame, now: Column | int) -> DataFrame:
    """(path, cache_key, last_updated) once all changes are marked complete: removals, then additions and touches at ``now``."""
    now = F.lit(now).cast("long") if isinstance(now, int) else now
    gone = changes.filter("kind = 'remove'").select("path", "cache_key")
    stamped = changes.filter("kind <> 'remove'").select("path", "cache_key", now.alias("last_updated"))
    kept = catalog.select("path", "cache_key", "last_updated").join(gone, ["path", "cache_key"], "left_anti")
    return kept.join(stamped, ["path", "cache_key"], "left_anti").unionByName(stamped)


def cache_after(global_cache: DataFrame, planned: DataFrame, directory: str, branch: str, artifact: str) -> DataFrame:
    """The global cache after a plan of one tag: removals first, then additions."""
    tag = [F.lit(directory).alias("dir"), F.lit(branch).alias("branch"), F.lit(artifact).alias("artifact_id")]
    side = planned.withColumn("kind", add_or_remove(F.col("op")))
    keys = ["cache_key", "dir", "branch", "artifact_id"]
    gone = side.filter("kind = 'remove'").select("cache_key", *tag).distinct()
    new = side.filter("kind = 'add'").select("cache_key", *tag)
    return global_cache.select(*keys).join(gone, keys, "left_anti").unionByName(new).distinct()


def batches(planned: DataFrame, size: int = BATCH) -> DataFrame:
    """planned with batch: item number / size, counted within each operation in a fixed order.

    Items are dealt over 256 slots by the path's md5 and numbered slot by slot, so no operation is sorted in one task.
    """
    rows = planned.withColumn("_slot", F.substring(F.md5("path"), 1, 2))
    local = F.row_number().over(Window.partitionBy("op", "_slot").orderBy("path", "cache_key"))
    sizes = rows.groupBy("op", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("op").orderBy("_slot")) - F.col("_n")).drop("_n")
    return rows.withColumn("_i", local).join(starts, ["op", "_slot"]).select(*planned.columns, F.floor((F.col("_before") + F.col("_i") - 1) / size).alias("batch"))


def lease_is_stale(stamp: float, now: float, after: float = 10.0) -> bool:
    """Whether another writer may take over a lock last stamped at ``stamp`` (seconds)."""
    return now - stamp > after


def progress(done: list[tuple[float, int, int]]) -> float:
    """Weighted progress of backends given as (weight, items done, items in all)."""
    total = sum(w for w, _, n in done if n)
    return 1.0 if not total else sum(w * k / n for w, k, n in done if n) / total
