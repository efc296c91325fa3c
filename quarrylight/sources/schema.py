"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def _of(text: str) -> StructType:
    kinds = {"string": StringType(), "int": IntegerType(), "long": LongType()}
    return StructType([StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))])


SYMBOLS = _of("id string, type string, name string, parent_id string, start_line int, end_line int, signature string, cache_key string, path string")
CHUNKS = _of(
    "id string, symbol_id string, cache_key string, path string, idx int, piece_index int, piece_count int, prev_chunk string, next_chunk string, signature string, start_line int, end_line int, content string"
)
CHUNK_TAGS = _of("tag string, chunk_id string")
CATALOG = _of("path string, cache_key string, last_updated long")
GLOBAL_CACHE = _of("cache_key string, dir string, branch string, artifact_id string")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the schema's columns: those it lacks are null, as after a change of the schema that only adds columns."""
    have = {c.lower() for c in df.columns}
    from pyspark.sql import functions as F

    return df.select(*[(F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
