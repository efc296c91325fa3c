"""Entry points: index a directory, look symbols up, rebuild them."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.operators import lookup, outline, planner, rebuild, store
from quarrylight.sources.files import branch, local_files
from quarrylight.sources.schema import CATALOG, CHUNK_TAGS, CHUNKS, GLOBAL_CACHE, SYMBOLS

ARTIFACT = "chunks"
CHUNK_TOKENS = 512
LIMITATIONS = ("rebuilt code of large symbols repeats headers and is not byte-identical to the source",)


@dataclass
class Progress:
    progress: float
    desc: str
    status: str  # loading, indexing, done, failed


def _home(root: str, where: str | None) -> str:
    import hashlib

    base = where or os.environ.get("QUARRYLIGHT_HOME") or os.path.join(os.path.expanduser("~"), ".quarrylight")
    return os.path.join(base, hashlib.sha256(f"{root}__{branch(root)}".encode()).hexdigest())


def _root(repo: str) -> str:
    root = os.path.abspath(repo)
    if not os.path.exists(root):
        raise FileNotFoundError(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    return root


class Index:
    """The stored tables of one directory and branch; every refresh writes a new version beside the old ones."""

    TABLES = {"symbols": SYMBOLS, "chunks": CHUNKS, "chunk_tags": CHUNK_TAGS, "catalog": CATALOG, "global_cache": GLOBAL_CACHE}

    def __init__(self, spark: SparkSession, repo: str, home: str | None = None):
        self.spark, self.root = spark, _root(repo)
        self.home, self.branch = _home(self.root, home), branch(self.root)
        self.tag = "::".join((f"file://{self.root}", self.branch, ARTIFACT))

    def version(self) -> int:
        done = [int(d[1:]) for d in (os.listdir(self.home) if os.path.isdir(self.home) else []) if d.startswith("v") and os.path.exists(os.path.join(self.home, d, "_DONE"))]
        return max(done, default=0)

    def table(self, name: str) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], self.TABLES[name])
        return self.spark.read.schema(self.TABLES[name]).parquet(os.path.join(self.home, f"v{v}", name))

    def refresh(self, most: int = CHUNK_TOKENS, paths: list[str] | None = None) -> Iterator[Progress]:
        """Plans against the catalog, cuts new and changed files, applies all changes, commits the new version."""
        yield Progress(0.0, "reading files", "loading")
        files = local_files(self.spark, self.root)
        catalog, cache = self.table("catalog"), self.table("global_cache")
        changes = planner.diff(files, catalog, paths)
        # one store: what another path has indexed is cut again here, so every path has its own symbols
        planned = planner.ops(changes, cache.limit(0), ARTIFACT).persist()
        total = planned.count()
        yield Progress(0.2, f"{total} changes", "indexing")
        new = files.join(planned.filter("op = 'compute'").select("path", "cache_key"), ["path", "cache_key"], "left_semi")
        next_ = os.path.join(self.home, f"v{self.version() + 1}")
        parsed = os.path.join(next_, "parsed")

        def written(df: DataFrame) -> DataFrame:
            df.write.mode("overwrite").parquet(parsed)
            return self.spark.read.schema(df.schema).parquet(parsed)

        symbols, pieces = outline.outline_files(new, most, written)
        keys = new.select("path", "cache_key")
        symbols, pieces = symbols.join(keys, "path"), pieces.join(keys, "path")
        gone = planned.filter("op <> 'compute'").select("path", "cache_key")
        kept = store.delete_files(self.table("symbols"), self.table("chunks"), self.table("chunk_tags"), gone)
        tags = pieces.select(F.lit(self.tag).alias("tag"), F.col("id").alias("chunk_id"))
        now = int(files.agg(F.coalesce(F.max("last_modified"), F.lit(0))).first()[0]) + 1
        tables = {
            "symbols": kept[0].unionByName(symbols), "chunks": kept[1].unionByName(pieces), "chunk_tags": kept[2].unionByName(tags).distinct(),
            "catalog": planner.catalog_after(catalog, changes, now),
            "global_cache": planner.cache_after(cache, planned, self.root, self.branch, ARTIFACT),
        }
        for i, (name, df) in enumerate(tables.items()):
            df.select([f.name for f in self.TABLES[name].fields]).write.mode("overwrite").parquet(os.path.join(next_, name))
            yield Progress(0.2 + 0.16 * (i + 1), f"wrote {name}", "indexing")
        open(os.path.join(next_, "_DONE"), "w").close()
        planned.unpersist()
        yield Progress(1.0, "up to date", "done")


def index_repo_iter(spark: SparkSession, repo: str, home: str | None = None, max_chunk_size: int = CHUNK_TOKENS) -> Iterator[Progress]:
    yield from Index(spark, repo, home).refresh(max_chunk_size)


def index_repo(spark: SparkSession, repo: str, home: str | None = None, max_chunk_size: int = CHUNK_TOKENS) -> Progress:
    last = Progress(0.0, "", "loading")
    for last in index_repo_iter(spark, repo, home, max_chunk_size):
        pass
    return last


class Lookup:
    """A session over one index (or over given tables): matches, selection, rebuilt code."""

    def __init__(self, symbols: DataFrame, chunks: DataFrame, chunk_tags: DataFrame, tags: list[str] | None = None):
        self.symbols, self.chunks, self.chunk_tags, self.tags = symbols, chunks, chunk_tags, tags

    def _check(self, detail: str, max_lines: int) -> None:
        if detail not in ("signature", "body"):
            raise ValueError('detail must be "signature" or "body"')
        if max_lines < 0:
            raise ValueError("max_lines must be non-negative")

    def matches(self, names: list[str], filter_paths: list[str] | None = None) -> DataFrame:
        scoped = lookup.in_scope(self.symbols, self.chunks, self.chunk_tags, self.tags, filter_paths or None)
        asked = scoped.sparkSession.createDataFrame([(n,) for n in names], "query string")
        return lookup.find_symbols(scoped, asked, lookup.piece_counts(self.chunks))

    def codes(self, ids: DataFrame, detail: str = "body", include_children: bool = True, max_lines: int = 0) -> DataFrame:
        """(root, id, parent_id, depth, name, type, path, start_line, end_line, code, signature) of symbols (column id) and what is below them."""
        self._check(detail, max_lines)
        tree = rebuild.descendants(self.symbols, ids) if include_children else self.symbols.join(ids, "id", "left_semi").select(F.col("id").alias("root"), "id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"))
        if detail == "signature":
            tree = tree.filter("depth <= 1")
        made = rebuild.bodies(self.chunks.join(tree.select(F.col("id").alias("symbol_id")).distinct(), "symbol_id", "left_semi"))
        pieces = F.col("pieces") if detail == "body" else F.filter(F.array("signature"), lambda x: x.isNotNull())
        made = made.withColumn("code", rebuild.limit_pieces(pieces, max_lines)["code"])
        rows = tree.join(self.symbols.select("id", "name", "type", "path", "start_line", "end_line"), "id").join(made.select(F.col("symbol_id").alias("id"), "code", "signature"), "id", "left")
        return rows.select("root", "id", "parent_id", "depth", "name", "type", "path", "start_line", "end_line", F.coalesce("code", F.lit("")).alias("code"), "signature")

    def lookup(self, name: str, symbol_id: str | None = None, filter_paths: list[str] | None = None, detail: str = "body", include_children: bool = True, max_lines: int = 0) -> dict:
        """query, matches in order, and the selected symbol as a tree: the only match, or the given one among several."""
        self._check(detail, max_lines)
        found = [r.asDict() for r in self.matches([name], filter_paths).orderBy("ord").collect()]
        ids = [m["id"] for m in found]
        if symbol_id is not None and ids and symbol_id not in ids:
            raise ValueError(f"symbol id is not among the matches: {symbol_id}")
        chosen = symbol_id if symbol_id is not None and ids else ids[0] if len(ids) == 1 else None
        selected = self.reconstruct(chosen, detail, include_children, max_lines) if chosen else None
        return {"query": name, "matches": found, "selected": selected, "limitations": list(LIMITATIONS) if selected else []}

    def reconstruct(self, symbol_id: str, detail: str = "body", include_children: bool = True, max_lines: int = 0) -> dict:
        self._check(detail, max_lines)
        return self._trees([symbol_id], detail, include_children, max_lines)[0]

    def _trees(self, ids: list[str], detail: str, include_children: bool, max_lines: int) -> list[dict]:
        frame = self.symbols.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        scoped = lookup.in_scope(self.symbols.join(F.broadcast(frame), "id", "left_semi"), self.chunks, self.chunk_tags, self.tags)
        rows = [r.asDict() for r in self.codes(scoped.select("id"), detail, include_children, max_lines).collect()]
        out = []
        for root in ids:
            mine = sorted((r for r in rows if r["root"] == root), key=lambda r: (r["path"], r["start_line"], r["end_line"], r["type"], r["name"], r["id"]))
            if not mine:
                raise KeyError(f"symbol not found: {root}")
            nodes = {r["id"]: {k: r[k] for k in ("id", "name", "type", "path", "start_line", "end_line", "code", "signature")} | {"children": []} for r in mine}
            for r in mine:
                if r["depth"] and r["parent_id"] in nodes:
                    nodes[r["parent_id"]]["children"].append(nodes[r["id"]])
            out.append(nodes[root])
        return out

    def resolve(self, name: str, symbol_id: str | None = None, filter_paths: list[str] | None = None, detail: str = "body", include_children: bool = True) -> dict:
        """The lookup and the code of the selected symbol, or of every match in order, all rebuilt in one plan."""
        found = self.lookup(name, symbol_id, filter_paths, detail, include_children)
        codes = [found["selected"]] if found["selected"] else self._trees([m["id"] for m in found["matches"]], detail, include_children, 0) if found["matches"] else []
        return found | {"codes": codes}


def open_lookup(spark: SparkSession, repo: str, home: str | None = None) -> Lookup:
    index = Index(spark, repo, home)
    return Lookup(index.table("symbols"), index.table("chunks"), index.table("chunk_tags"), [index.tag])


def lookup_symbol(spark: SparkSession, repo: str, name: str, home: str | None = None, **options) -> dict:
    return open_lookup(spark, repo, home).lookup(name, **options)


def reconstruct_symbol(spark: SparkSession, repo: str, symbol_id: str, home: str | None = None, **options) -> dict:
    return open_lookup(spark, repo, home).reconstruct(symbol_id, **options)


def resolve_lookup(spark: SparkSession, repo: str, name: str, home: str | None = None, **options) -> dict:
    return open_lookup(spark, repo, home).resolve(name, **options)


__all__ = ["Index", "Lookup", "Progress", "index_repo", "index_repo_iter", "lookup_symbol", "open_lookup", "reconstruct_symbol", "resolve_lookup"]
