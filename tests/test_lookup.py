import pytest

from quarrylight.api import Lookup
from quarrylight.operators import lookup, rebuild
from quarrylight.sources.schema import CHUNK_TAGS, CHUNKS, SYMBOLS

TAG = "file:///w::NONE::chunks"
ROWS = [("duplicate-alpha", "duplicate", "alpha/duplicate.py", 'def duplicate():\n    return "alpha"'), ("duplicate-beta", "duplicate", "beta/duplicate.py", 'def duplicate():\n    return "beta"')]
LONG = "def long_function(value):\n    first = value\n    second = first\n    third = second\n    return third"


@pytest.fixture(scope="module")
def session(spark):
    rows = [*ROWS, ("long-function", "long_function", "long_module.py", LONG)]
    symbols = [(i, "function", n, None, 1, c.count("\n") + 1, c.split("\n")[0], i, p) for i, n, p, c in rows]
    chunks = [(f"c-{i}", i, i, p, 0, 0, 1, None, None, c.split("\n")[0], 1, c.count("\n") + 1, c) for i, n, p, c in rows]
    tags = [(TAG, f"c-{i}") for i, *_ in rows]
    return Lookup(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(tags, CHUNK_TAGS), [TAG])


def test_unknown_name(session):
    assert session.lookup("does_not_exist") == {"query": "does_not_exist", "matches": [], "selected": None, "limitations": []}


def test_two_matches_in_path_order_select_none(session):
    found = session.lookup("duplicate")
    assert [m["path"] for m in found["matches"]] == ["alpha/duplicate.py", "beta/duplicate.py"] and found["selected"] is None
    assert found["matches"][0]["match_kind"] == "exact"


def test_path_filter_selects_the_one_left(session):
    assert session.lookup("duplicate", filter_paths=["alpha/duplicate.py"])["selected"]["id"] == "duplicate-alpha"


def test_signature_and_line_limit(session):
    found = session.lookup("long_function", detail="signature")["selected"]
    assert found["code"] == found["signature"] == "def long_function(value):"
    cut = session.lookup("long_function", max_lines=2)["selected"]["code"]
    assert "more lines omitted" in cut and "return third" not in cut


def test_explicit_id_and_resolve(session):
    found = session.lookup("duplicate", symbol_id="duplicate-beta")
    assert len(found["matches"]) == 2 and found["selected"]["id"] == "duplicate-beta"
    with pytest.raises(ValueError):
        session.lookup("duplicate", symbol_id="other")
    made = session.resolve("duplicate")
    assert [c["id"] for c in made["codes"]] == [m["id"] for m in made["matches"]]
    assert session.reconstruct("duplicate-alpha", detail="signature")["code"] == "def duplicate():"
    with pytest.raises(KeyError):
        session.reconstruct("nothing")
    with pytest.raises(ValueError):
        session.lookup("duplicate", detail="all")


def test_an_empty_scope_has_no_rows(session):
    assert lookup.in_scope(session.symbols, session.chunks, session.chunk_tags, []).count() == 0


def test_scope_forms():
    assert lookup.normal_scope(["a", {"directory": "d", "branch": "b", "artifact_id": "x"}, "a"]) == ["a", "d::b::x"]


PIECE = "symbol_id string, id string, piece_index int, piece_count int, start_line int, end_line int, idx int, prev_chunk string, next_chunk string, content string, signature string"


@pytest.mark.parametrize(
    "links, want",
    [
        ({"a": (None, "b"), "b": ("a", "c"), "c": ("b", None)}, "abc"),  # consistent
        ({"c": (None, "b"), "b": ("c", "a"), "a": ("b", None)}, "cba"),  # links against the indexes
        ({"a": (None, "b"), "b": (None, "c"), "c": ("b", None)}, "abc"),  # two heads
        ({"a": (None, "b"), "b": ("a", "a"), "c": ("b", None)}, "abc"),  # a cycle
        ({"b": (None, "c"), "c": ("b", "z"), "a": ("c", None)}, "bca"),  # a link that leads nowhere
    ],
)
def test_piece_order(spark, links, want):
    rows = [("s", i, k, 3, k, k, k, *links[i], i, f"sig {i}") for k, i in enumerate(sorted(links))]
    assert rebuild.bodies(spark.createDataFrame(rows, PIECE)).first().code == want
