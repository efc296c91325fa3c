import datetime

from pyspark.sql import functions as F

from quarrylight.operators.handlers import TOOLS, Handlers, rendered
from quarrylight.streaming import watch
from tests.test_lookup import session  # noqa: F401


def test_tools(session):  # noqa: F811
    tools = Handlers(session)
    assert set(TOOLS) == {"lookup_symbol", "get_symbol", "get_symbol_range"}
    found = tools.call("lookup_symbol", name=["duplicate", "long_function"])
    assert [m["symbol_id"] for m in found["duplicate"]] == ["duplicate-alpha", "duplicate-beta"] and len(found["long_function"]) == 1
    assert tools.call("lookup_symbol", name=["duplicate", "nope"])[0]["code"] == "SYMBOL_NOT_FOUND"
    assert tools.call("get_symbol", symbol_id="long-function")["end_line"] == 5
    assert tools.call("get_symbol", symbol_id=["long-function", "x"])[1]["code"] == "SYMBOL_NOT_FOUND"
    assert tools.call("get_symbol_range", symbol_id="long-function", start_line=2, end_line=3)["code"] == "    first = value\n    second = first\n"
    assert tools.call("get_symbol_range", symbol_id="long-function", start_line=3, end_line=2)["code"] == "INVALID_RANGE"
    assert tools.call("get_symbol_range", symbol_id="long-function", start_line=90, end_line=99)["code"] == "RANGE_EMPTY"
    assert Handlers(session, ready=lambda: False).get_symbol("a")["code"] == "INDEX_UNAVAILABLE"
    assert Handlers(session, pending=lambda p: True).get_symbol("long-function")["code"] == "PATH_PENDING"


def test_truncated_symbols(spark):
    s = {"id": "i", "name": "n", "path": "p", "start_line": 10, "end_line": 13, "code": "line 1\nline 2\nline 3\nline 4"}
    cut = lambda n: rendered(spark, [s], n)[0]
    assert cut(25)["code"] == "line 1\n...(truncated)..." and cut(25)["returned_end_line"] == 10 and cut(25)["total_lines"] == 4
    assert cut(3)["code"] == "..." and cut(3)["returned_end_line"] == 9 and "truncated" not in cut(100)


def test_batches_open_with_their_first_event(spark):
    at = lambda ms: datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)
    rows = [("s", at(0), "a"), ("s", at(200), "b"), ("s", at(249), "a"), ("s", at(250), "c"), ("s", at(460), "d"), ("s", at(501), "e"), ("t", at(5), "z")]
    got = watch.debounce(spark.createDataFrame(rows, "stream string, ts timestamp_ntz, path string"), 250)
    assert sorted((r.stream, tuple(r.paths)) for r in got.collect()) == [("s", ("a", "b")), ("s", ("c", "d")), ("s", ("e",)), ("t", ("z",))]


def test_a_failed_batch_is_given_again(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    spark.createDataFrame(rows, "path string, ts long, kind string").write.parquet(str(tmp_path / "in"))
    seen = []

    def apply(batch, batch_id):
        seen.append((batch_id, sorted((r.path, r.kind) for r in batch.collect())))
        if len(seen) == 1:
            raise RuntimeError("lost")

    stream = lambda: spark.readStream.schema("path string, ts long, kind string").parquet(str(tmp_path / "in"))
    try:
        watch.start_refresh(stream(), apply, str(tmp_path / "check"), once=True).awaitTermination()
    except Exception as x:
        assert "lost" in str(x)
    watch.start_refresh(stream(), apply, str(tmp_path / "check"), once=True).awaitTermination()
    assert seen == [(0, [("a", "y"), ("b", "z")])] * 2


def test_windows(spark):
    rows = [(datetime.datetime(2024, 1, 1, 0, m), "view") for m in (1, 9, 11)]
    got = watch.windowed_counts(spark.createDataFrame(rows, "ts timestamp, event_type string"))
    assert sorted(r.n for r in got.collect()) == [1, 2]
    assert got.select(F.min("start")).first()[0] == datetime.datetime(2024, 1, 1)
