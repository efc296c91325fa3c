"""Source rebuilt from pieces: symbol trees, ordered joins of pieces, signatures, line and character limits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import LINE_END, split_lines

#: Types whose descendants are rebuilt with them.
PARENTS = ("file", "class")
#: Order of pieces that have no consistent links.
PIECE_ORDER = ("piece_index", "piece_count", "start_line", "end_line", "idx", "id")
MARKER = "...(truncated)..."
CHAR_LIMIT = 12_000


def descendants(symbols: DataFrame, roots: DataFrame, paths: list[str] | None = None, most: int = 64) -> DataFrame:
    """(root, id, parent_id, depth) of the roots (column id) and, below files and classes, of all their descendants.

    A child hangs on its parent; where a path scope leaves a parent out, its subtree is left out too. The recursion is
    one plan; trees deeper than ``most`` are an error, not cut.
    """
    scoped = symbols if paths is None else symbols.filter(F.col("path").isin(paths))
    start = symbols.join(roots.select("id").distinct(), "id", "left_semi").select("id", "type")
    return symbols.sparkSession.sql(
        f"""
        WITH RECURSIVE tree(root, id, parent_id, depth, grows) MAX RECURSION LEVEL {most} AS (
          SELECT id, id, CAST(NULL AS STRING), 0, type IN {PARENTS} FROM {{start}}
          UNION ALL
          SELECT t.root, s.id, s.parent_id, t.depth + 1, t.grows FROM tree t JOIN {{scoped}} s ON s.parent_id = t.id WHERE t.grows)
        SELECT root, id, parent_id, depth FROM tree
        """,
        start=start,
        scoped=scoped,
    )


def ordered_pieces(chunks: DataFrame) -> DataFrame:
    """Chunks with ord from 0 in each symbol.

    One piece without a predecessor leads: its links are followed, and pieces they do not reach come behind in piece
    order. Several heads, none, or a cycle put all pieces in piece order. Where the links agree with the piece indexes
    the order is a window; only the other symbols are walked.
    """
    w = Window.partitionBy("symbol_id")
    order = w.orderBy(*PIECE_ORDER)
    marked = chunks.withColumn("_n", F.row_number().over(order)).withColumn("_before", F.lag("id").over(order)).withColumn("_after", F.lead("id").over(order))
    plain = F.col("prev_chunk").eqNullSafe(F.col("_before")) & F.col("next_chunk").eqNullSafe(F.col("_after"))
    marked = marked.withColumn("_heads", F.sum(F.col("prev_chunk").isNull().cast("int")).over(w)).withColumn("_plain", F.min((plain | (F.col("_heads") != 1)).cast("int")).over(w))
    easy = marked.filter("_plain = 1").select(*chunks.columns, (F.col("_n") - 1).alias("ord"))
    hard = marked.filter("_plain = 0").select("symbol_id", "id", "prev_chunk", "next_chunk", F.col("_n").alias("n"))

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        after = dict(zip(frame["id"], frame["next_chunk"], strict=True))
        at = frame.loc[frame["prev_chunk"].isna(), "id"].iloc[0]
        seen: dict[str, None] = {}
        while at is not None and at in after:
            if at in seen:
                seen = {}
                break
            seen[at] = None
            at = after[at]
        ids = [*seen, *(i for i in frame["id"] if i not in seen)]
        return pd.DataFrame({"symbol_id": frame["symbol_id"].iloc[0], "id": ids, "ord": range(len(ids))})

    walked = hard.groupBy("symbol_id").applyInPandas(walk, "symbol_id string, id string, ord int")
    return easy.union(chunks.join(walked, ["symbol_id", "id"]).select(*chunks.columns, "ord"))


def bodies(chunks: DataFrame) -> DataFrame:
    """(symbol_id, code, signature, pieces): pieces joined in order; the signature is that of piece 0, else of the first."""
    rows = ordered_pieces(chunks)
    lead = F.struct((F.col("piece_index") != 0).alias("later"), "ord", "signature")
    return rows.groupBy("symbol_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "content"))).alias("_pieces"), F.min(lead)["signature"].alias("signature")
    ).select("symbol_id", F.array_join(F.transform("_pieces", lambda p: p["content"]), "").alias("code"), "signature", F.transform("_pieces", lambda p: p["content"]).alias("pieces"))


def n_lines(c: Column) -> Column:
    return F.size(split_lines(c))


def limit_pieces(pieces: Column, most: int) -> Column:
    """struct(code, omitted): whole pieces of at most so many lines, and a note of how many lines were left out; 0 is no limit.

    Every piece's lines are counted once.
    """
    whole = F.array_join(pieces, "")
    if most <= 0:
        return F.struct(whole.alias("code"), F.lit(0).alias("omitted"))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("lines"), F.lit("").alias("last"), F.lit(True).alias("open"))

    def step(a: Column, piece: Column) -> Column:
        # a piece goes on with the line before it if that has no end, or half of one
        goes_on = (a["last"] != "") & (piece != "") & (~a["last"].rlike(f"^(?:{LINE_END})$") | ((a["last"] == "\r") & piece.startswith("\n")))
        lines = a["lines"] + n_lines(piece) - goes_on.cast("int")
        fits = a["open"] & (lines <= most)
        return F.struct((a["kept"] + fits.cast("int")).alias("kept"), F.when(fits, lines).otherwise(a["lines"]).alias("lines"), F.when(fits & (piece != ""), F.right(piece, F.lit(1))).otherwise(a["last"]).alias("last"), fits.alias("open"))

    told = F.aggregate(pieces, start, step)
    kept = F.struct(F.array_join(F.slice(pieces, F.lit(1), told["kept"]), "").alias("text"), told["open"].alias("open"))
    omitted = F.greatest(n_lines(whole) - n_lines(kept["text"]), F.lit(0))
    note = F.concat(F.lit("# ... "), omitted.cast("string"), F.lit(' more lines omitted, use detail="signature" or read_file for the rest ...'))
    lead = F.when((kept["text"] == "") | kept["text"].endswith("\n"), kept["text"]).otherwise(F.concat(kept["text"], F.lit("\n")))
    return F.when(kept["open"] | (F.size(pieces) == 0), F.struct(whole.alias("code"), F.lit(0).alias("omitted"))).otherwise(F.struct(F.concat(lead, note).alias("code"), omitted.alias("omitted")))


def truncate_chars(code: Column, start_line: Column, limit: int = CHAR_LIMIT) -> Column:
    """struct(code, truncated, returned_end_line, total_lines): whole lines within the limit and a marker behind them."""
    if limit <= 0:
        raise ValueError("char_limit must be positive")
    total = n_lines(code)
    if limit <= len(MARKER):
        cut, end = F.lit(MARKER[:limit]), start_line - 1
    else:
        budget = limit - len(MARKER)
        start = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"))

        def step(a: Column, line: Column) -> Column:
            fits = a["open"] & (a["used"] + F.length(line) <= budget)
            return F.struct((a["used"] + F.when(fits, F.length(line)).otherwise(0)).alias("used"), fits.alias("open"))

        used = F.aggregate(split_lines(F.substring(code, 1, limit + 1)), start, step)["used"]
        prefix = F.substring(code, F.lit(1), F.when(used > 0, used).otherwise(budget))
        cut, end = F.concat(prefix, F.lit(MARKER)), start_line + F.greatest(n_lines(prefix) - 1, F.lit(0))
    short = F.length(code) <= limit
    return F.struct(F.when(short, code).otherwise(cut).alias("code"), (~short).alias("truncated"), F.when(~short, end).alias("returned_end_line"), F.when(~short, total).alias("total_lines"))


def line_range(code: Column, start_line: Column, end_line: Column, first: Column, last: Column) -> Column:
    """struct(error, start_line, end_line, code): the lines of a symbol that a range covers."""
    a, b = F.greatest(first, start_line), F.least(last, end_line)
    rows = F.slice(split_lines(code), F.greatest(a - start_line, F.lit(0)) + 1, F.greatest(b - a + 1, F.lit(0)))
    error = F.when((first < 1) | (last < first), "INVALID_RANGE").when(a > b, "RANGE_EMPTY")
    return F.struct(error.alias("error"), F.when(error.isNull(), a).alias("start_line"), F.when(error.isNull(), b).alias("end_line"), F.when(error.isNull(), F.array_join(rows, "")).alias("code"))


def signature_tree(symbols: DataFrame, signatures: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id, depth, signature) of the roots and one level of children below files and classes."""
    own = symbols.join(roots.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), "type")
    kids = symbols.alias("s").join(own.filter(F.col("type").isin(*PARENTS)).alias("r"), F.col("s.parent_id") == F.col("r.id")).select("r.root", "s.id", F.lit(1).alias("depth"))
    return own.drop("type").union(kids).join(signatures.select(F.col("symbol_id").alias("id"), "signature"), "id", "left").select("root", "id", "depth", "signature")


__all__ = ["LINE_END", "bodies", "descendants", "limit_pieces", "line_range", "ordered_pieces", "signature_tree", "truncate_chars"]
