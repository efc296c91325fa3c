"""Symbol lookup: scopes, tiers of matches, removal of doubles, selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.text import fold

#: Order of matches.
ORDER = ("path", "start_line", "end_line", "type", "name", "id")
#: Match kinds by tier; a tier counts only where the ones before it found nothing.
TIERS = {1: "exact", 2: "exact_case_insensitive", 3: "substring"}


def normal_scope(tags: Iterable | None) -> list[str]:
    """Tags as text, in order, each once. A tag is text, a mapping or an object with directory, branch and artifact_id."""
    out: dict[str, None] = {}
    for tag in tags or ():
        if not isinstance(tag, str):
            get = tag.get if isinstance(tag, dict) else lambda k, t=tag: getattr(t, k)
            tag = "::".join(str(get(k)) for k in ("directory", "branch", "artifact_id"))
        out[tag] = None
    return list(out)


def in_scope(symbols: DataFrame, chunks: DataFrame, chunk_tags: DataFrame, tags: list[str] | None = None, paths: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Symbols whose (cache_key, path) has a chunk with one of the tags; no tags given means no restriction, an empty list no rows."""
    out = symbols
    if paths is not None:
        out = out.filter(F.col("path").isin(paths)) if paths else out.filter(F.lit(False))
    if prefix is not None:
        out = out.filter(F.col("path").startswith(prefix))
    if tags is None:
        return out
    wanted = chunk_tags.filter(F.col("tag").isin(tags)) if tags else chunk_tags.filter(F.lit(False))
    return out.join(chunks.join(wanted, chunks["id"] == wanted["chunk_id"], "left_semi"), ["cache_key", "path"], "left_semi")


def tier(name: Column, query: Column) -> Column:
    return F.when(name == query, 1).when(fold(name) == fold(query), 2).when(fold(name).contains(fold(query)), 3)


def find_symbols(symbols: DataFrame, queries: DataFrame, pieces: DataFrame | None = None) -> DataFrame:
    """Matches of a set of queries (column query): query, match_kind, ord, the symbol's columns and pieces.

    For each query only the first tier with a match counts. Of matches with the same place and number of pieces the
    first stays. pieces: (id, pieces); without it doubles are told by place alone. An empty query matches nothing.
    """
    asked = queries.select("query").filter(F.length("query") > 0).distinct()  # a stated set of queries
    same_name = F.broadcast(asked.withColumn("_fold", fold(F.col("query"))))
    equal = symbols.join(same_name, fold(F.col("name")) == F.col("_fold")).drop("_fold")
    # only what no name equals is looked for inside of names
    open_ = F.broadcast(asked.join(F.broadcast(equal.select("query").distinct()), "query", "left_anti"))
    inside = symbols.join(open_, fold(F.col("name")).contains(fold(F.col("query"))))
    found = equal.unionByName(inside).withColumn("tier", tier(F.col("name"), F.col("query")))
    least = F.broadcast(found.groupBy("query").agg(F.min("tier").alias("_best")))  # a row for each query
    best = found.join(least, "query").filter("tier = _best").drop("_best")
    if pieces is not None:
        best = best.join(pieces.select("id", "pieces"), "id", "left").fillna(0, ["pieces"])
    else:
        best = best.withColumn("pieces", F.lit(0).cast("long"))
    order = [F.col(c) for c in ORDER]
    same = Window.partitionBy("query", "path", "start_line", "end_line", "pieces").orderBy(*order)
    first = best.withColumn("_n", F.row_number().over(same)).filter("_n = 1")
    kinds = F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])
    ranked = first.withColumn("ord", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.select("query", kinds[F.col("tier")].alias("match_kind"), "ord", *symbols.columns, "pieces")


def select(matches: DataFrame, queries: DataFrame, symbol_id: str | None = None) -> DataFrame:
    """(query, n_matches, selected_id): the one match, or the given id if it is among them."""
    per = matches.groupBy("query").agg(F.count(F.lit(1)).alias("n_matches"), F.min("id").alias("_only"), F.max((F.col("id") == F.lit(symbol_id)).cast("int")).alias("_has"))
    out = queries.select("query").distinct().join(per, "query", "left")
    chosen = F.when(F.col("n_matches") == 1, F.col("_only"))
    if symbol_id is not None:
        chosen = F.when(F.col("_has") == 1, F.lit(symbol_id)).when(F.col("n_matches") > 0, F.raise_error(F.lit(f"symbol id is not among the matches: {symbol_id}")).cast("string"))
    return out.select("query", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), chosen.alias("selected_id"))


def piece_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("pieces"))
