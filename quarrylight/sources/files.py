"""File relations: a walk with ignore rules on the driver's file system, and Spark's own reader for file stores."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.text import content_hash
from quarrylight.sources.ignore import DEFAULTS, Context, ignored

KINDS = {"unknown": 0, "file": 1, "directory": 2, "link": 64}
LISTING_TTL = 30.0


@dataclass
class Walker:
    """Depth-first walk: newest directory first, links skipped, the rules of a directory handed on to those below."""

    include: str = "files"  # files, dirs or both
    relative: bool = False
    recursive: bool = True
    override_ignores: list[str] | None = None
    listings: dict[str, tuple[float, list[tuple[str, str]]]] = field(default_factory=dict)

    def list_dir(self, path: str) -> list[tuple[str, str]]:
        """(name, kind) of the entries; kept for LISTING_TTL seconds. A directory that cannot be read is empty."""
        held = self.listings.get(path)
        if held and time.monotonic() - held[0] < LISTING_TTL:
            return held[1]
        try:
            found = sorted((e.name, "link" if e.is_symlink() else "directory" if e.is_dir() else "file" if e.is_file() else "unknown") for e in os.scandir(path))
        except OSError:
            found = []
        self.listings[path] = (time.monotonic(), found)
        return found

    def invalidate(self) -> None:
        self.listings.clear()

    def _context(self, path: str, entries: list[tuple[str, str]]) -> Context:
        own = read_file(os.path.join(path, ".gitignore")) if (".gitignore", "file") in entries else None
        return Context(own, self.override_ignores)

    def walk(self, root: str) -> Iterator[str]:
        stack: list[tuple[str, str, list[tuple[str, Context]]]] = [(root, "", [])]
        while stack:
            path, rel, contexts = stack.pop()
            entries = self.list_dir(path)
            contexts = [*contexts, (rel, self._context(path, entries))]
            for name, kind in entries:
                below = f"{rel}/{name}" if rel else name
                tested = below + "/" if kind == "directory" else below
                if kind not in ("file", "directory") or any(c.ignores(tested[len(base) :]) for base, c in contexts):
                    continue
                full = below if self.relative else os.path.join(path, name)
                if kind == "directory":
                    if self.include in ("dirs", "both"):
                        yield full
                    if self.recursive:
                        stack.append((os.path.join(path, name), below, contexts))
                elif self.include in ("files", "both"):
                    yield full

    def walk_all(self, roots: list[str]) -> list[str]:
        return [p for root in roots for p in self.walk(root)]


def read_file(path: str) -> str:
    """The text of a file, broken bytes replaced and line ends as line feeds; empty if it cannot be read."""
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read()
    except OSError:
        return ""


def stats(paths: list[str]) -> dict[str, tuple[int, int]]:
    """path -> (size, modified in ms); files that are gone are left out."""
    out = {}
    for p in paths:
        try:
            s = os.stat(p)
        except OSError:
            continue
        out[p] = (s.st_size, int(s.st_mtime * 1000))
    return out


def _git(path: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() if done.returncode == 0 else None


def branch(path: str) -> str:
    """The branch of a working tree, HEAD if it is on none, NONE outside of one."""
    return _git(path, "rev-parse", "--abbrev-ref", "HEAD") or "NONE"


def repo_name(path: str) -> str | None:
    top = _git(path, "rev-parse", "--show-toplevel")
    return os.path.basename(top) if top else None


def current_tags(dirs: list[str]) -> list[tuple[str, str]]:
    """(directory, branch): the first directory's branch goes for all."""
    return [(d, branch(dirs[0])) for d in dirs] if dirs else []


def local_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """(path, size, last_modified, content, cache_key) of a walk on the driver's file system."""
    found = Walker(**options).walk_all([root])
    sizes = stats(found)
    rows = [(p, sizes[p][0], sizes[p][1], read_file(p)) for p in found if p in sizes]
    return spark.createDataFrame(rows, "path string, size long, last_modified long, content string").withColumn("cache_key", content_hash(F.col("content")))


def stored_files(spark: SparkSession, roots: list[str] | str, patterns: list[str] | None = None) -> DataFrame:
    """The same relation of a distributed file store; ignore rules are tested on the path below its root."""
    roots = [roots] if isinstance(roots, str) else roots
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n")
    below = F.col("path")
    for r in roots:
        below = F.when(F.contains(F.col("path"), F.lit(r.rstrip("/") + "/")), F.substring_index(F.col("path"), r.rstrip("/") + "/", -1)).otherwise(below)
    kept = raw.filter(~ignored(below, [*(patterns or []), *DEFAULTS]))
    return kept.select("path", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified"), text.alias("content"), content_hash(text).alias("cache_key"))
