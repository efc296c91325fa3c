"""Column expressions over URIs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.text import last_parts


def scheme(uri: Column) -> Column:
    return F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def raw_path(uri: Column) -> Column:
    """The path between authority and query, percent escapes kept."""
    return F.regexp_extract(uri, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def clean_path(uri: Column) -> Column:
    """The path without one slash at either end."""
    return F.regexp_replace(F.regexp_replace(raw_path(uri), "^/", ""), "/$", "")


def decode_component(c: Column) -> Column:
    """Percent decoding that leaves plus signs as they are; escapes that are no escapes stay."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


#: What url_encode escapes though encodeURIComponent does not, and how it writes a space.
_RESTORED = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%2A": "*", "%7E": "~"}


def encode_component(c: Column) -> Column:
    out = F.url_encode(c)
    for escaped, plain in _RESTORED.items():
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return out


def encode_segment(path: Column) -> Column:
    """Each part of a path encoded; backslashes count as slashes, slashes at the ends are dropped."""
    clean = F.regexp_replace(F.translate(path, "\\", "/"), "^/+|/+$", "")
    return F.array_join(F.transform(F.split(clean, "/"), encode_component), "/")


def uri_basename(uri: Column) -> Column:
    return decode_component(F.substring_index(clean_path(uri), "/", -1))


def uri_extension(uri: Column) -> Column:
    name = uri_basename(uri)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def join_paths(uri: Column, *segments: Column) -> Column:
    base = F.when(uri.endswith("/"), uri).otherwise(F.concat(uri, F.lit("/")))
    return F.concat(base, F.concat_ws("/", *[encode_segment(s) for s in segments]))


def path_to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), F.array_join(F.transform(F.split(path, "/"), lambda p: F.replace(encode_component(p), F.lit("%3A"), F.lit(":"))), "/"))


def uri_to_path(uri: Column) -> Column:
    return F.when(scheme(uri) == "file", decode_component(raw_path(uri))).otherwise(F.raise_error(F.concat(F.lit("not a file:// uri: "), uri)))


def find_in_dirs(uri: Column, dirs: list[str]) -> Column:
    """struct(relative, found_in): the path below the first directory that holds the URI, else its base name."""
    parts = F.split(clean_path(uri), "/")
    found = F.struct(uri_basename(uri).alias("relative"), F.lit(None).cast("string").alias("found_in"))
    for d in reversed(dirs):
        want = F.split(clean_path(F.lit(d)), "/")
        holds = (scheme(uri) == scheme(F.lit(d))) & (F.size(parts) >= F.size(want)) & (F.slice(parts, F.lit(1), F.size(want)) == want)
        rest = F.array_join(F.transform(F.slice(parts, F.size(want) + 1, F.size(parts)), decode_component), "/")
        found = F.when(holds, F.struct(rest.alias("relative"), F.lit(d).alias("found_in"))).otherwise(found)
    return found


def description(uri: Column, dirs: list[str]) -> Column:
    found = find_in_dirs(uri, dirs)
    return F.struct(
        uri.alias("uri"), found["relative"].alias("relative_path_or_basename"), found["found_in"].alias("found_in_dir"),
        last_parts(found["relative"], 2).alias("last2_parts"), uri_basename(uri).alias("base_name"), uri_extension(uri).alias("extension"),
    )


def shortest_unique(df, uri: str, dirs: list[str]):
    """(uri, unique_path): the shortest end of the relative path that no other row has, else the whole relative path.

    Rows are told apart by their URI alone (an end of a URI that repeats is never unique), since the rows are read twice
    and come out of a shuffle in any order.
    """
    rows = df.select(F.col(uri).alias("uri")).withColumn("_rel", find_in_dirs(F.col("uri"), dirs)["relative"])
    parts = F.split("_rel", "/")
    ends = rows.select("uri", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/"))).alias("_n", "_end"))
    once = ends.groupBy("_end").agg(F.count(F.lit(1)).alias("_c"), F.min("uri").alias("uri"), F.min("_n").alias("_n")).filter("_c = 1")
    best = once.groupBy("uri").agg(F.min_by("_end", "_n").alias("_best"))
    return rows.join(best, "uri", "left").select("uri", F.coalesce("_best", "_rel").alias("unique_path"))
