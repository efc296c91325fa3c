"""Changes of stored tables as new DataFrames: upserts, cascades, tags, removal of doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delete_files(symbols: DataFrame, chunks: DataFrame, chunk_tags: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files of gone (path, cache_key): chunks go first, then their tags, then symbols."""
    left = chunks.join(gone, ["path", "cache_key"], "left_anti")
    dropped = chunks.join(gone, ["path", "cache_key"], "left_semi").select(F.col("id").alias("chunk_id"))
    return symbols.join(gone, ["path", "cache_key"], "left_anti"), left, chunk_tags.join(dropped, "chunk_id", "left_anti").select(*chunk_tags.columns)


def remove_tag(chunk_tags: DataFrame, chunks: DataFrame, items: DataFrame, tag: str) -> DataFrame:
    """chunk_tags without the tag of the chunks of items (path, cache_key)."""
    hit = chunks.join(items, ["path", "cache_key"], "left_semi").select(F.col("id").alias("chunk_id"), F.lit(tag).alias("tag"))
    return chunk_tags.join(hit, ["tag", "chunk_id"], "left_anti").select(*chunk_tags.columns)


def add_tag(chunk_tags: DataFrame, chunks: DataFrame, items: DataFrame, tag: str) -> DataFrame:
    """chunk_tags with the tag on every chunk of the items' hashes, at whatever path they are; what is there stays once."""
    new = chunks.join(items.select("cache_key").distinct(), "cache_key", "left_semi").select(F.lit(tag).alias("tag"), F.col("id").alias("chunk_id"))
    return chunk_tags.select("tag", "chunk_id").unionByName(new).distinct()


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in: of rows with the same keys the new ones stay, of new ones the last by all columns."""
    order = [F.col(c).desc_nulls_last() for c in rows.columns if c not in keys] or [F.lit(1)]
    one = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
    return table.join(one.select(*keys), keys, "left_anti").select(*table.columns).unionByName(one, allowMissingColumns=True)


def keep_least(table: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    """Of rows with the same keys the one with the least id."""
    least = table.groupBy(*keys).agg(F.min(key).alias(key))
    return table.join(least, [*keys, key], "left_semi").select(*table.columns)


def doubles(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def keep_first(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def faults(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, fault) of symbols that may not be stored: a parent that is missing, or no chunk below a file."""
    parents = symbols.select(F.col("id").alias("parent_id"))
    lost = symbols.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left_anti").select("id", F.lit("no parent").alias("fault"))
    bare = symbols.filter("type <> 'file'").join(chunks.select(F.col("symbol_id").alias("id")), "id", "left_anti").select("id", F.lit("no chunk").alias("fault"))
    return lost.union(bare)


def checked_insert(symbols: DataFrame, chunks: DataFrame, new_symbols: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with the new rows; the new rows are checked before anything is written."""
    bad = faults(new_symbols, new_chunks).limit(1).collect()
    if bad:
        raise ValueError(f"symbol {bad[0]['id']}: {bad[0]['fault']}")
    return upsert(symbols, new_symbols, ["id"]), upsert(chunks, new_chunks, ["id"])


def replace_partition(df: DataFrame, path: str, *by: str) -> None:
    """Writes df over those partitions of a table that it has rows of; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
