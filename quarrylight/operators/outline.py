"""Symbols and pieces of source files: Python by its syntax tree, brace languages by a small lexer, others as plain text."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import tokens
from quarrylight.operators.chunking import basic_chunks

PYTHON = ("py", "pyi")
BRACES = ("js", "jsx", "mjs", "cjs", "ts", "tsx", "java", "go", "rs", "c", "h", "cc", "cpp", "cxx", "hpp", "cs", "php", "kt", "scala", "swift")
#: Extensions whose files are never outlined.
PLAIN = ("css", "html", "json", "md", "toml", "txt", "yaml", "yml", "rst", "xml", "sql")
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
SYMBOLS = "path string, id string, type string, name string, parent_id string, start_line int, end_line int, signature string"
PIECES = "path string, id string, symbol_id string, idx int, piece_index int, piece_count int, prev_chunk string, next_chunk string, start_line int, end_line int, signature string, content string"


def count(text: str) -> int:
    return len(_TOKEN.findall(text))


@dataclass
class Symbol:
    type: str
    name: str
    start: int  # lines from 1, inclusive
    end: int
    body: int  # first line of the body
    children: list[Symbol] = field(default_factory=list)
    id: str = ""


def python_symbols(source: str) -> list[Symbol]:
    """Classes and functions, nested ones below what holds them; the decorators of a definition are outside of it."""

    def visit(nodes: list[ast.AST]) -> list[Symbol]:
        out = []
        for node in nodes:
            below = [c for c in ast.iter_child_nodes(node)]
            if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "class" if isinstance(node, ast.ClassDef) else "method"
                out.append(Symbol(kind, node.name, node.lineno, node.end_lineno, node.body[0].lineno, visit(node.body)))
            else:
                out += visit(below)
        return out

    return visit(ast.parse(source).body)


_CLASS = re.compile(r"\b(?:class|struct|interface|trait|enum|impl|object|namespace|record)\s+([A-Za-z_$][\w$]*)")
_FUNCTION = re.compile(r"\b(?:function\*?|func|fn|fun|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_$][\w$]*)")
_ARROW = re.compile(r"([A-Za-z_$][\w$]*)\s*[:=]\s*(?:async\s*)?(?:\([^()]*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[^=]+)?=>\s*$")
_CALL = re.compile(r"([A-Za-z_$~][\w$]*)\s*\([^;{}]*\)\s*(?:const|override|noexcept|throws\s+[\w.,\s]+|->\s*[^{};]+|:\s*[^{};=]+)?\s*$")
_CONTROL = frozenset("if for while switch catch else do try return new sizeof with using lock synchronized match loop unsafe when".split())
_LEXEMES = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|[{};]", re.S)


def brace_symbols(source: str) -> list[Symbol]:
    """Definitions told by the text before their opening brace; strings and comments are skipped."""
    roots: list[Symbol] = []
    stack: list[Symbol | None] = []
    from_, line_at = 0, lambda i: source.count("\n", 0, i) + 1
    bare = list(source)
    for m in _LEXEMES.finditer(source):
        if m[0] not in "{};":
            for i in range(m.start(), m.end()):
                if bare[i] != "\n":
                    bare[i] = " "
            continue
        if m[0] == "{":
            head = "".join(bare[from_ : m.start()])
            made, text = None, head.strip()
            for kind, pattern in (("class", _CLASS), ("method", _FUNCTION), ("method", _ARROW), ("method", _CALL)):
                found = pattern.search(text)
                if found and found[1] not in _CONTROL and not (pattern is _CALL and re.match(r"(?:%s)\b" % "|".join(_CONTROL), text)):
                    lead = len(head) - len(head.lstrip())
                    made = Symbol(kind, found[1], line_at(from_ + lead), 0, line_at(m.start()) + 1)
                    holder = next((s for s in reversed(stack) if s), None)
                    (holder.children if holder else roots).append(made)
                    break
            stack.append(made)
        elif m[0] == "}" and stack:
            done = stack.pop()
            if done:
                done.end = line_at(m.start())
        from_ = m.end()
    last = source.count("\n") + 1
    for s in stack:
        if s:
            s.end = last
    return roots


def split_lines_to(lines: list[str], start: int, most: int, header: str = "") -> list[tuple[int, int, str]]:
    """(start, end, text) pieces of whole lines under the budget, each behind the header; a line over it is cut by characters."""
    out: list[tuple[int, int, str]] = []
    room, held, first = max(1, most - count(header)), "", start
    for i, line in enumerate(lines, start):
        if count(line) > room:
            if held:
                out.append((first, i - 1, header + held))
            while line:
                n = len(line)
                while n > 1 and count(line[:n]) > room:
                    n = n * room // count(line[:n]) or 1
                out.append((i, i, header + line[:n]))
                line = line[n:]
            held, first = "", i + 1
        elif held and count(held + line) > room:
            out.append((first, i - 1, header + held))
            held, first = line, i
        else:
            held += line
    if held:
        out.append((first, start + len(lines) - 1, header + held))
    return out


def outline(path: str, source: str, most: int) -> tuple[list[dict], list[dict] | None]:
    """(symbols, pieces) of a file.

    The file is a symbol itself. A class has one piece with its whole text if that fits, else pieces of an overview in
    which methods stand as their first line; a function one piece, else pieces that each repeat its header. Files of
    other kinds, and those that do not parse, have None for pieces: they are cut by the plain chunker.
    """
    key = lambda *x: hashlib.sha256("\x1f".join(map(str, (path, *x))).encode()).hexdigest()[:32]
    lines = source.splitlines(keepends=True)
    end = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    parser: Callable[[str], list[Symbol]] | None = python_symbols if end in PYTHON else brace_symbols if end in BRACES else None
    top = Symbol("file", path.rsplit("/", 1)[-1], 1, source.count("\n") + 1, 1)
    top.id = key("file")
    symbols = [{"path": path, "id": top.id, "type": "file", "name": top.name, "parent_id": None, "start_line": 1, "end_line": top.end, "signature": top.name}]
    pieces: list[dict] = []

    def put(symbol: Symbol, cut: list[tuple[int, int, str]], signature: str) -> None:
        ids = [key("piece", symbol.id, k) for k in range(len(cut))]
        for k, (a, b, text) in enumerate(cut):
            pieces.append({
                "path": path, "id": ids[k], "symbol_id": symbol.id, "idx": len(pieces), "piece_index": k, "piece_count": len(cut), "prev_chunk": ids[k - 1] if k else None,
                "next_chunk": ids[k + 1] if k + 1 < len(cut) else None, "start_line": a, "end_line": b, "signature": signature, "content": text,
            })

    def overview(s: Symbol) -> list[str]:
        out, hidden = [], {}
        for c in s.children:
            if c.type == "method":
                hidden.update({n: c for n in range(c.start, c.end + 1)})
        for n in range(s.start, s.end + 1):
            c = hidden.get(n)
            if c is None:
                out.append(lines[n - 1])
            elif n == c.start:
                head = lines[n - 1].rstrip()
                out.append(head + (" ...\n" if end in PYTHON else " ... }\n" if head.endswith("{") else " { ... }\n"))
        return out

    def visit(s: Symbol, parent: Symbol, at: int) -> None:
        s.id = key(s.type, s.name, s.start, s.end, at)
        signature = lines[s.start - 1].strip().rstrip("{").rstrip() if s.start <= len(lines) else s.name
        symbols.append({"path": path, "id": s.id, "type": s.type, "name": s.name or "anonymous", "parent_id": parent.id, "start_line": s.start, "end_line": s.end, "signature": signature})
        whole = lines[s.start - 1 : s.end]
        if count("".join(whole)) <= most:
            put(s, [(s.start, s.end, "".join(whole))], signature)
        elif s.type == "class":
            rows = overview(s)
            put(s, [(s.start, s.end, text) for _, _, text in split_lines_to(rows[1:], s.start, most, rows[0])] or [(s.start, s.end, rows[0])], signature)
        else:
            first = max(s.start + 1, s.body)
            put(s, split_lines_to(lines[first - 1 : s.end], first, most, "".join(lines[s.start - 1 : first - 1])), signature)
        for k, c in enumerate(s.children):
            visit(c, s, k)

    try:
        found = parser(source) if parser else None
    except (SyntaxError, ValueError, RecursionError):
        found = None
    if found is None:
        return symbols, None
    for k, s in enumerate(found):
        visit(s, top, k)
    return symbols, pieces


def outline_files(files: DataFrame, most: int = 512, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """(symbols, pieces) of files (path, content). Both come from one table of parsed files.

    store may write that table and read it back, so that files are parsed once; without it each of the two parses them.
    Files that have no outline are cut by the plain chunker.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, c in zip(frame["path"], frame["content"], strict=True):
                symbols, pieces = outline(p, c or "", most)
                rows.append((p, pieces is None, symbols, pieces or []))
            yield pd.DataFrame(rows, columns=["path", "plain", "symbols", "pieces"])

    struct = lambda columns: "array<struct<" + ",".join(":".join(c.split()) for c in columns.split(", ")) + ">>"
    parsed = store(files.select("path", "content").mapInPandas(each, f"path string, plain boolean, symbols {struct(SYMBOLS)}, pieces {struct(PIECES)}"))
    symbols = parsed.select(F.explode("symbols").alias("s")).select("s.*")
    pieces = parsed.select(F.explode("pieces").alias("p")).select("p.*")
    plain = basic_chunks(files.select("path", "content").join(parsed.filter("plain").select("path", F.col("symbols")[0].alias("file")), "path"), most).filter(tokens.count(F.col("content")) <= most)
    at = (F.row_number().over(Window.partitionBy("path").orderBy("idx")) - 1).cast("int")
    numbered = plain.withColumn("piece_index", at)
    made = {
        "id": F.substring(F.sha2(F.concat_ws("\x1f", "path", F.lit("piece"), "file.id", F.col("piece_index").cast("string")), 256), 1, 32), "symbol_id": F.col("file.id"), "idx": F.col("piece_index"), "piece_count": F.lit(1),
        "prev_chunk": F.lit(None).cast("string"), "next_chunk": F.lit(None).cast("string"), "signature": F.col("file.name"),
    }
    return symbols, pieces.unionByName(numbered.withColumns(made).select(pieces.columns))


def find_snippets(files: DataFrame) -> DataFrame:
    """(path, title, content, signature, start_line, end_line) of the definitions of source files, 0-based lines."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p, c in zip(frame["path"], frame["content"], strict=True):
                symbols, _ = outline(p, c or "", 1 << 30)
                lines = (c or "").splitlines(keepends=True)
                for s in symbols[1:]:
                    text = "".join(lines[s["start_line"] - 1 : s["end_line"]]).rstrip("\n")
                    if s["name"] and len(text) >= 10:
                        rows.append((p, s["name"], text, s["signature"], s["start_line"] - 1, s["end_line"] - 1))
            yield pd.DataFrame(rows, columns=["path", "title", "content", "signature", "start_line", "end_line"])

    return files.select("path", "content").mapInPandas(each, "path string, title string, content string, signature string, start_line int, end_line int")
