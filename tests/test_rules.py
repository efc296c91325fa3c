import pytest
from pyspark.sql import functions as F

from quarrylight.functions import text, tokens, uris
from quarrylight.operators import chat, chunking, outline, planner, rebuild, search, store, tools
from quarrylight.sources import files, ignore
from quarrylight.streaming import watch


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "code, start, limit, want",
    [
        ("line 1\nline 2\nline 3", 10, 3, ("...", True, 9, 3)),
        ("line 1\nline 2\nline 3\nline 4", 10, 25, ("line 1\n...(truncated)...", True, 10, 4)),
        ("short", 10, 25, ("short", False, None, None)),
    ],
)
def test_truncation(spark, code, start, limit, want):
    assert tuple(one(spark, rebuild.truncate_chars(F.lit(code), F.lit(start), limit))) == want


def test_truncation_needs_a_limit(spark):
    for limit in (0, -1):
        with pytest.raises(ValueError):
            rebuild.truncate_chars(F.lit("x"), F.lit(1), limit)


@pytest.mark.parametrize("a, b, want", [(11, 99, (None, 11, 13, "two\nthree\nfour\n")), (0, 1, ("INVALID_RANGE", None, None, None)), (3, 2, ("INVALID_RANGE", None, None, None)), (99, 100, ("RANGE_EMPTY", None, None, None))])
def test_line_ranges(spark, a, b, want):
    assert tuple(one(spark, rebuild.line_range(F.lit("one\ntwo\nthree\nfour\n"), F.lit(10), F.lit(13), F.lit(a), F.lit(b)))) == want


@pytest.mark.parametrize("s", ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h", "\n\n", "é\n日本"])
def test_lines_are_those_of_python(spark, s):
    assert one(spark, text.split_lines(F.lit(s))) == s.splitlines(keepends=True)


@pytest.mark.parametrize("name", ["Foo", "foo", "FOO", "É", "é", "fooBar"])
def test_only_ascii_is_folded(spark, name):
    assert one(spark, text.fold(F.lit(name))) == "".join(c.lower() if c.isascii() else c for c in name)


@pytest.mark.parametrize("s, n", [("abcé", 2), ("abcé", 1), ("日本語", 4), ("x", 9)])
def test_last_bytes(spark, s, n):
    assert one(spark, text.last_bytes(F.lit(s), n)) == s.encode()[-n:].decode(errors="ignore")


def test_uri_components(spark):
    from urllib.parse import quote, unquote

    for s in ("a b+c~d!*'()é/%", "x%2By", "plain"):
        assert one(spark, uris.encode_component(F.lit(s))) == quote(s, safe="!*'()")
        assert one(spark, uris.decode_component(F.lit(s.replace("/%", "")))) == unquote(s.replace("/%", ""))


def test_shortest_unique_paths_of_rows_that_come_in_any_order(spark):
    def dealt(frames):  # a new order each time the rows are read, as from a shuffle
        for f in frames:
            yield f.sample(frac=1)

    names = [f"file:///w/d{i % 7}/{i // 2}.txt" for i in range(301)] + ["file:///w/a/same.txt"] * 2
    df = spark.createDataFrame([(n,) for n in names], "url string").coalesce(1).mapInPandas(dealt, "url string")
    got = sorted((r.uri, r.unique_path) for r in uris.shortest_unique(df, "url", ["file:///w"]).collect())
    want = []
    for n in names:
        folder, base = n.removeprefix("file:///w/").split("/")
        want.append((n, base if sum(m.endswith(f"/{base}") for m in names) == 1 else f"{folder}/{base}"))
    assert got == sorted(want)


def test_line_pruning_keeps_the_last_line_that_fits(spark):
    assert one(spark, tokens.prune_lines(F.lit("a b c\nd e\nf"), 4, top=True)) == "d e\nf"
    assert one(spark, tokens.prune_lines(F.lit("a b c\nd e\nf"), 3, top=False)) == "a b c"
    assert one(spark, tokens.prune_lines(F.lit("a b c"), 1, top=True)) == ""
    assert one(spark, tokens.buffer(F.lit(128_000))) == 1000


FILES = "path string, size long, last_modified long, cache_key string"
SAVED = "path string, cache_key string, last_updated long"


def test_planner_cases(spark):
    now = [("new", 1, 10, "h1"), ("same", 1, 10, "h2"), ("touched", 1, 20, "h3"), ("changed", 1, 20, "h4"), ("two", 1, 20, "h5"), ("huge", 6 << 20, 20, "h6")]
    saved = [("same", "h2", 10), ("touched", "h3", 10), ("changed", "old", 10), ("two", "h5", 10), ("two", "h5-old", 5), ("gone", "g1", 1), ("gone", "g2", 2), ("huge", "h6", 1)]
    files_, catalog = spark.createDataFrame(now, FILES), spark.createDataFrame(saved, SAVED)
    got = {tuple(r) for r in planner.diff(files_, catalog).collect()}
    assert got == {("new", "h1", "add"), ("touched", "h3", "touch"), ("changed", "h4", "add"), ("changed", "old", "remove"), ("two", "h5", "touch"), ("two", "h5-old", "remove"), ("gone", "g1", "remove"), ("gone", "g2", "remove"), ("huge", "h6", "remove")}
    cache = spark.createDataFrame([("h1", "d", "b", "chunks"), ("old", "d", "b", "chunks"), ("old", "e", "b", "chunks"), ("g1", "d", "b", "chunks")], "cache_key string, dir string, branch string, artifact_id string")
    ops = {(r.path, r.cache_key): r.op for r in planner.ops(planner.diff(files_, catalog), cache, "chunks").collect()}
    assert ops[("new", "h1")] == "addTag" and ops[("changed", "h4")] == "compute" and ops[("changed", "old")] == "removeTag" and ops[("gone", "g1")] == "delete"
    after = planner.catalog_after(catalog, planner.diff(files_, catalog), 30)
    assert planner.diff(files_, after).count() == 0  # a second plan has nothing to do
    assert planner.lease_is_stale(0, 11) and not planner.lease_is_stale(0, 9)
    assert planner.progress([(1.0, 1, 2), (13.0, 0, 2)]) == pytest.approx(1 / 28)


def test_cascades_leave_no_orphan(spark):
    s = spark.createDataFrame([("s1", "file", None, "p", "k"), ("s2", "method", "s1", "p", "k"), ("s3", "file", None, "q", "k")], "id string, type string, parent_id string, path string, cache_key string")
    c = spark.createDataFrame([("c1", "s2", "p", "k"), ("c2", "s3", "q", "k")], "id string, symbol_id string, path string, cache_key string")
    t = spark.createDataFrame([("t", "c1"), ("t", "c2")], "tag string, chunk_id string")
    # only the path that is gone is deleted, though both hold the same content
    s2, c2, t2 = store.delete_files(s, c, t, spark.createDataFrame([("p", "k")], "path string, cache_key string"))
    assert [r.id for r in s2.collect()] == ["s3"] and [r.id for r in c2.collect()] == ["c2"] and [r.chunk_id for r in t2.collect()] == ["c2"]
    assert store.faults(s2, c2).count() == 0
    assert {tuple(r) for r in store.faults(s.filter("id <> 's1'"), c2).collect()} == {("s2", "no parent"), ("s2", "no chunk")}
    with pytest.raises(ValueError):
        store.checked_insert(s, c, s.filter("id = 's2'"), c)


@pytest.mark.parametrize("source", ["", "   ", "a", "a\n", "w " * 6 + "\n" + "x " * 5, "w " * 11 + "\nb\n" + "c " * 10 + "\nd", "\n\n\n"])
def test_plain_chunks_hold_all_lines_in_order(spark, source):
    most = 11
    got = [(r.start_line, r.end_line, r.content) for r in chunking.basic_chunks(spark.createDataFrame([("f.txt", source)], "path string, content string"), most).orderBy("idx").collect()]
    lines = source.split("\n")
    if not source.strip():
        assert got == []
        return
    # spans follow each other over all lines, hold their lines under the limit, and could not take one more
    assert [a for a, _, _ in got] == [0, *(b + 1 for _, b, _ in got[:-1])] and got[-1][1] == len(lines) - 1
    for k, (a, b, text) in enumerate(got):
        held = [x for x in lines[a : b + 1] if outline.count(x) < most]
        assert text == "".join(x + "\n" for x in held)
        used = sum(outline.count(x) + 1 for x in held)
        assert used <= most
        if k + 1 < len(got):
            assert used + outline.count(lines[b + 1]) > most - 5


def test_search_queries():
    assert search.phrases("The lic? of") == ["the", "lic"]
    with pytest.raises(ValueError):
        search.phrases("a-b")


def test_bm25_equals_sqlite(spark):
    import sqlite3

    rows = [(i, f"src/{n}.py", c) for i, (n, c) in enumerate([("alpha", "the quick brown fox"), ("beta", "aaaa aaa quick"), ("gamma", "nothing here"), ("delta", "quick quick quick fox"), ("quick", "other"), ("zeta", "lazy dogs run"), ("eta", "more text of no use"), ("theta", "fox den"), ("iota", "words"), ("kappa", "yet more words"), ("mu", "last one")])]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE fts USING fts5(path, content, tokenize = 'trigram')")
    db.executemany("INSERT INTO fts(rowid, path, content) VALUES (?, ?, ?)", rows)
    chunks = spark.createDataFrame(rows, "id long, path string, content string")
    for q in ("quick", "aaa", "quick fox"):
        want = dict(db.execute("SELECT rowid, bm25(fts, 20.0, 1.0) FROM fts WHERE fts MATCH ?", [" AND ".join(f'"{w}"' for w in q.split())]))
        got = {r.id: r.weighted for r in search.bm25(chunks, {"q": q}).collect()}
        assert got == pytest.approx(want, abs=1e-6), q
    assert search.bm25(chunks, {"q": "of"}).count() == 0


def test_chat_tail_and_pruning(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "one " * 50), (1, 2, "assistant", "two " * 50), (1, 3, "tool", "three"), (1, 4, "user", "four"), (1, 5, "assistant", "calls"), (1, 6, "tool", "out"), (1, 7, "tool", "out"), (1, 8, "user", " ")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    assert {r.turn for r in chat.tail(m.filter("turn < 8")).filter("in_tail").collect()} == {5, 6, 7}
    kept = {r.turn for r in chat.compile_history(m, None, 100).collect()}
    assert kept == {0, 1, 2, 3, 4, 5, 6, 7}
    out = chat.compile_history(m, 180, 100).collect()
    assert {r.turn for r in out} == {0, 4, 5, 6, 7} and all(r.did_prune for r in out)  # the tool message that leads goes too
    with pytest.raises(Exception, match="Not enough context"):
        chat.compile_history(m, 110, 100).collect()


@pytest.mark.parametrize(
    "patterns, path, want",
    [
        (["*.log"], "a/b.log", True), (["*.log", "!keep.log"], "a/keep.log", False), (["build/"], "x/build/y", True), (["build/"], "build", False), (["/a/*.txt"], "a/b.txt", True), (["/a/*.txt"], "c/a/b.txt", False),
        (["a/**/z"], "a/z", True), (["a/**/z"], "a/b/c/z", True), (["**/x"], "p/x", True), (["a?c"], "abc", True), (["[!a]b"], "cb", True), (["[!a]b"], "ab", False), (["\\!x"], "!x", True),
    ],
)
def test_ignore_rules(spark, patterns, path, want):
    import re

    result = False
    for expression, ignores in ignore.compile_rules(patterns):
        result = ignores if re.search(expression, path) else result
    assert result == want == one(spark, ignore.ignored(F.lit(path), patterns))


def test_walk_and_stored_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for p, c in {"src/a.py": "x = 1\r\n", "src/b.log": "l", "src/keep.py": "k", "node_modules/m.js": "m", ".gitignore": "keep.py\n# c\n", ".env": "S=1"}.items():
        (tmp_path / p).write_text(c, newline="")
    (tmp_path / "link.py").symlink_to(tmp_path / "src/a.py")
    assert files.Walker(relative=True).walk_all([str(tmp_path)]) == ["src/a.py"]
    assert files.Walker(relative=True, include="dirs").walk_all([str(tmp_path)]) == ["src"]
    assert [r.content for r in files.local_files(spark, str(tmp_path)).collect()] == ["x = 1\n"]
    got = {r.path.rsplit("/", 1)[-1]: r.content for r in files.stored_files(spark, str(tmp_path), ["keep.py", "link.py"]).collect()}
    assert got == {"a.py": "x = 1\n"}
    assert files.read_file("/nowhere") == "" and files.stats(["/nowhere"]) == {}


def test_index_and_refresh(spark, tmp_path):
    from quarrylight import api

    repo, home = tmp_path / "repo", str(tmp_path / "home")
    repo.mkdir()
    (repo / "m.py").write_text("class Shape:\n    def area(self):\n        return 1\n\n\ndef area_of(s):\n    return s.area()\n")
    (repo / "same.py").write_text("def twin():\n    return 2\n")
    (repo / "copy.py").write_text("def twin():\n    return 2\n")
    assert api.index_repo(spark, str(repo), home).status == "done"
    assert api.lookup_symbol(spark, str(repo), "area", home)["selected"]["code"] == "    def area(self):\n        return 1\n"
    assert len(api.lookup_symbol(spark, str(repo), "twin", home)["matches"]) == 2
    shape = api.lookup_symbol(spark, str(repo), "SHAPE", home)
    assert shape["matches"][0]["match_kind"] == "exact_case_insensitive" and [c["name"] for c in shape["selected"]["children"]] == ["area"]
    import os

    (repo / "m.py").write_text("def fresh():\n    return 3\n")
    os.utime(repo / "m.py", (4_000_000_000, 4_000_000_000))
    (repo / "copy.py").unlink()
    api.index_repo(spark, str(repo), home)
    assert api.lookup_symbol(spark, str(repo), "Shape", home)["matches"] == []
    assert len(api.lookup_symbol(spark, str(repo), "fresh", home)["matches"]) == 1
    assert len(api.lookup_symbol(spark, str(repo), "twin", home)["matches"]) == 1
    with pytest.raises(FileNotFoundError):
        api.index_repo(spark, str(repo / "none"), home)
    with pytest.raises(NotADirectoryError):
        api.index_repo(spark, str(repo / "m.py"), home)


def test_brace_outline():
    source = 'class A {\n  // } not this\n  run(x) { return "}"; }\n}\nfunction f(a) {\n  if (a) { g(); }\n}\nconst h = (x) => {\n  return x;\n};\n'
    found = [(s.type, s.name, s.start, s.end) for top in outline.brace_symbols(source) for s in (top, *top.children)]
    assert found == [("class", "A", 1, 4), ("method", "run", 3, 3), ("method", "f", 5, 7), ("method", "h", 8, 10)]


def test_large_functions_are_split_with_their_header():
    source = "def f(x):\n" + "".join(f"    a{i} = {i}\n" for i in range(60))
    symbols, pieces = outline.outline("m.py", source, 40)
    assert [s["name"] for s in symbols] == ["m.py", "f"] and len(pieces) > 1
    assert all(p["content"].startswith("def f(x):\n") and outline.count(p["content"]) <= 40 for p in pieces)
    assert [p["prev_chunk"] for p in pieces[1:]] == [p["id"] for p in pieces[:-1]]
    assert outline.outline("m.py", "def broken(:", 40)[1] is None


def test_files_without_an_outline_are_cut_by_the_plain_chunker(spark):
    rows = [("m.py", "def broken(:"), ("n.py", "def f():\n    return 1\n"), ("a.txt", "\n".join(f"line {i}" for i in range(40))), ("e.txt", "")]
    symbols, pieces = outline.outline_files(spark.createDataFrame(rows, "path string, content string"), 40)
    assert sorted((r.path, r.name) for r in symbols.collect()) == [("a.txt", "a.txt"), ("e.txt", "e.txt"), ("m.py", "m.py"), ("n.py", "f"), ("n.py", "n.py")]
    found = pieces.orderBy("path", "idx").collect()
    assert [p.content for p in found if p.path == "m.py"] == ["def broken(:\n"] and [p.content for p in found if p.path == "n.py"] == [rows[1][1]]
    text = [p for p in found if p.path == "a.txt"]
    assert "".join(p.content for p in text) == rows[2][1] + "\n" and [p.piece_index for p in text] == list(range(len(text))) and len({p.id for p in found}) == len(found)


def test_rendered_codes_are_bound_by_bytes():
    held = tools.Rendered(5)
    held.add("a", "/x", "é")
    held.add("b", "/y", "abc")
    assert held.code("a") == "é"
    held.add("c", "/z", "z")
    assert held.code("b") is None and held.code("a") == "é" and held.held_bytes == 3
    held.forget("file:///x")
    assert held.code("a") is None and held.held_bytes == 1
    held.add("d", "/d", "longer than all")
    assert held.held_bytes == 0 and held.code("c") is None


def test_cleaned_comments(spark):
    for doc, want in (("/** a\n * b\n */", " a\nb"), ("// x\n/// y", "x\ny"), ("# t\n;; u", "t\nu"), ("/* z */", " z"), ("/ one", "/ one"), ("\n//\n# a  \n\n", "a")):
        assert one(spark, text.clean_doc(F.lit(doc))) == want, doc


def test_errors_that_clear_the_index(spark):
    yes = ("x sqlite_full y", "SQLITE_ERROR: no such table", "Invalid argument error: Values length 12 is less than the length (34) multiplied by the value size 5")
    assert [one(spark, text.clears_index(F.lit(x))) for x in (*yes, "disk is slow")] == [True, True, True, False]


def test_moves_touch_two_paths(spark):
    rows = [(0, "moved", "a", "b"), (0, "created", "c", None), (0, "modified", "x/.git/d", None)]
    events = spark.createDataFrame(rows, "ts long, kind string, src string, dest string")
    assert sorted(r.path for r in watch.touched_paths(events).collect()) == ["a", "b", "c"]


def test_formatted_symbol(spark):
    got = one(spark, tools.format_symbol(F.lit("a/b.py"), F.lit(3), F.lit(4), F.lit("f"), F.lit("id1"), F.lit("code"), F.lit(True), F.lit(9)))
    assert got.startswith("a/b.py:3-4  symbol: f\nid: id1\n[truncated — showing lines 3-4 of 9; ") and got.endswith("\n```python\ncode\n```")


def test_lines_are_counted_over_pieces(spark):
    import random

    r, rows = random.Random(3), []
    for i in range(200):
        rows.append((i, ["".join(r.choice("ab\n\r\x0c") for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 7))]))
    frame = spark.createDataFrame(rows, "i int, pieces array<string>").withColumn("r", rebuild.limit_pieces(F.col("pieces"), 3))
    for row in frame.collect():
        kept = []
        for piece in row.pieces:
            if len("".join([*kept, piece]).splitlines()) > 3:
                break
            kept.append(piece)
        whole, text_ = "".join(row.pieces), "".join(kept)
        if len(kept) == len(row.pieces):
            assert row.r.code == whole and row.r.omitted == 0
        else:
            assert row.r.code.startswith(text_) and row.r.omitted == max(0, len(whole.splitlines()) - len(text_.splitlines()))
