import duckdb
import pytest

from loomspark.operators import cochange
from loomspark.plans import catalogue, oracles, search

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "documents", "events", "nation", "orders", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracles.oracles()))
def test_equals_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(oracles.oracles()[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(want.columns, want.fetchall())


def _docs(spark, bodies):
    rows = [(f"s{i}", 0, ["w"], "/ws", "current", "t", 1000 + i, b, b.split()) for i, b in enumerate(bodies)]
    return spark.createDataFrame(
        rows,
        "session_id string, seq int, scope_tokens array<string>, workspace_id string, surface string, event_type string, "
        "event_time_unix_ms long, body string, tokens array<string>",
    )


def test_depth_is_told_before_budget(spark):
    docs = _docs(spark, ["alpha"] * 3)
    got = search.truncation(docs, search.Request(("alpha", "none"), depth=2)).orderBy("ordinal").collect()
    assert [tuple(r) for r in got] == [(0, "source-depth", 2), (1, "exhausted", 0)]


def test_equal_texts_fuse_by_session(spark):
    words = ("a1", "b1", "c1", "d1", "e1")
    got = search.fused(_docs(spark, [" ".join(words)] * 2), search.Request(words)).orderBy("position").collect()
    assert [r["session_id"] for r in got] == ["s0", "s1"]
    assert got[0]["score"] == pytest.approx(5 / 61) and got[1]["score"] == pytest.approx(5 / 62)


def test_signs_match_nothing(spark):
    assert search.sources(_docs(spark, ["a * b"]), search.Request(("*",))).count() == 0


@pytest.mark.parametrize(
    "bad",
    [dict(literals=()), dict(literals=("a",) * 2), dict(literals=("x" * 501,)), dict(literals=("a",), depth=101), dict(literals=("a",), limit=0)],
)
def test_requests_have_bounds(bad):
    with pytest.raises(search.RequestError):
        search.Request(**bad)


@pytest.mark.parametrize("counts, passes", [((20, 10, 16, 6), True), ((20, 10, 21, 6), False), ((11, 11, 20, 6), False)])
def test_gates(spark, counts, passes):
    left, right, opportunities, shared = counts
    row = ("a/x", "b/y", left, right, shared, opportunities, 2, 2, 2)
    names = "a string, b string, left long, right long, shared long, opportunities long, band0 long, band1 long, band2 long"
    got = cochange.gated(spark.createDataFrame([row], names)).count()
    assert bool(got) == (passes and shared * 5 >= min(left, right) * 3)
