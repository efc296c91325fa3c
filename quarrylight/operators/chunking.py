"""Documents cut into linked pieces under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import tokens
from quarrylight.functions.text import basename, strip

MOST_CHARS = 1_000_000
RESERVE = 5
CHUNK_TOKENS = 512


def should_chunk(path: Column, content: Column) -> Column:
    return (F.length(content) > 0) & (F.length(content) <= MOST_CHARS) & basename(path).contains(".")


def spans(content: Column, most: int, counter: tokens.Counter = tokens.count) -> Column:
    """array<struct<start, end, tokens, text>>: lines packed greedily below most - 5 tokens, a line break counting one.

    Line numbers are 0-based and inclusive. Lines of ``most`` tokens or more are left out but end a span, even an empty
    one; a text of white space has no span. Every line is split off and counted once.
    """
    lines = F.transform(F.split(content, "\n"), lambda x: F.struct(x.alias("line"), counter(x).cast("int").alias("cost")))
    empty = F.array().cast("array<struct<start:int,end:int,tokens:int,text:string>>")
    state = F.struct(empty.alias("out"), F.lit(0).alias("used"), F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("at"))

    def shut(a: Column) -> Column:
        return F.concat(a["out"], F.array(F.struct(a["start"].alias("start"), (a["at"] - 1).alias("end"), a["used"].alias("tokens"), a["text"].alias("text"))))

    def step(a: Column, x: Column) -> Column:
        full, short = a["used"] + x["cost"] > most - RESERVE, x["cost"] < most
        return F.struct(
            F.when(full, shut(a)).otherwise(a["out"]).alias("out"), (F.when(full, 0).otherwise(a["used"]) + F.when(short, x["cost"] + 1).otherwise(0)).alias("used"),
            F.concat(F.when(full, "").otherwise(a["text"]), F.when(short, F.concat(x["line"], F.lit("\n"))).otherwise("")).alias("text"),
            F.when(full, a["at"]).otherwise(a["start"]).alias("start"), (a["at"] + 1).alias("at"),
        )

    return F.when(strip(content) == "", empty).otherwise(F.aggregate(lines, state, step, shut))


def basic_chunks(files: DataFrame, most: int = CHUNK_TOKENS, counter: tokens.Counter = tokens.count) -> DataFrame:
    """files (path, content, ...) with idx, start_line, end_line and content of each chunk, in order."""
    others = [c for c in files.columns if c != "content"]
    cut = files.select(*others, F.posexplode(spans(F.col("content"), most, counter)).alias("idx", "_s"))
    return cut.select(*others, "idx", F.col("_s.start").alias("start_line"), F.col("_s.end").alias("end_line"), F.col("_s.text").alias("content"))


def document_chunks(files: DataFrame, most: int = CHUNK_TOKENS, key: str = "path", counter: tokens.Counter = tokens.count) -> DataFrame:
    """Chunks of the files that should be chunked; those over the budget are dropped, the others numbered anew."""
    fit = basic_chunks(files.filter(should_chunk(F.col("path"), F.col("content"))), most, counter).filter(counter(F.col("content")) <= most)
    return fit.withColumn("piece_index", (F.row_number().over(Window.partitionBy(key).orderBy("idx")) - 1).cast("int"))


def linked(pieces: DataFrame, key: str, index: str = "piece_index") -> DataFrame:
    """pieces (key, id, index) with piece_count, prev_chunk and next_chunk."""
    w = Window.partitionBy(key)
    order = w.orderBy(index)
    return pieces.select("*", F.count(F.lit(1)).over(w).cast("int").alias("piece_count"), F.lag("id").over(order).alias("prev_chunk"), F.lead("id").over(order).alias("next_chunk"))
