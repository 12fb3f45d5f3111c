import pytest
from pyspark.sql import functions as F

from loomspark.functions.snippets import clip, find, snippet
from loomspark.operators import cochange
from loomspark.plans import catalogue
from loomspark.sources import store as st
from loomspark.sources import views
from loomspark.sources.tables import conversation_documents
from loomspark.streaming.ingest import ingest, suffix

SF = "/root/testdata/sf0.001"


def _docs(spark, rows):
    full = [(s, q, 1000 + q, "message", "current", w, ["b", "a", "a"], body, f"f{body}", "r1") for s, q, w, body in rows]
    return spark.createDataFrame(full, st.DOCUMENT)


@pytest.fixture
def store(spark, tmp_path):
    return st.DocumentStore.create(spark, str(tmp_path / "s"))


def _all(store):
    return sorted((r.session_id, r.seq, r.body) for r in store.documents().collect())


def test_append_replay_and_pins(spark, store):
    first = _docs(spark, [("x", 0, "/w", "one"), ("x", 1, "/w", "two"), ("y", 0, "/w", "one")])
    got = store.apply_batch(first, "k1", "p1", 5)
    assert got == st.Receipt(1, 5, 3, 0)
    assert store.apply_batch(first, "k1", "p1", 5) == st.Receipt(1, 5, 3, 0, True)
    pinned = store.reader()
    more = _docs(spark, [("x", 1, "/w", "two"), ("x", 2, "/w", "three"), ("x", 2, "/w", "three")])
    assert store.apply_batch(more, "k2", "p2", 6) == st.Receipt(2, 6, 1, 2)
    assert store.count() == 4 and pinned.count() == 3 and len(_all(pinned)) == 3
    assert {r.session_id: r.next_seq for r in store.sessions().collect()} == {"x": 3, "y": 1}
    assert store.documents().first().scope_tokens == ["a", "b"]
    assert store.source_state(["y", "nobody"]).count() == 1
    with pytest.raises(st.StaleGeneration):
        store.require(7)


@pytest.mark.parametrize(
    "rows, watermark, error",
    [
        ([("x", 2, "/w", "late")], 9, st.SequenceGap),
        ([("z", 1, "/w", "late")], 9, st.SequenceGap),
        ([("x", 1, "/w", "a"), ("x", 3, "/w", "b")], 9, st.SequenceGap),
        ([("x", 0, "/w", "other")], 9, st.DocumentConflict),
        ([("x", 1, "/w", "a"), ("x", 1, "/w", "b")], 9, st.DocumentConflict),
        ([("x", 1, "/v", "a")], 9, st.WorkspaceConflict),
        ([("q", 0, "/v", "a"), ("q", 1, "/w", "a")], 9, st.WorkspaceConflict),
        ([(None, 0, "/v", "a")], 9, st.InvalidBatch),
        ([("x", 1, "/w", "a")], 5, st.NonMonotonicWatermark),
    ],
)
def test_refused_batches_change_nothing(spark, store, rows, watermark, error):
    store.apply_batch(_docs(spark, [("x", 0, "/w", "one")]), "k1", "p1", 5)
    with pytest.raises(error):
        store.apply_batch(_docs(spark, rows), "k2", "p2", watermark)
    with pytest.raises(st.IdempotencyConflict):
        store.apply_batch(_docs(spark, rows), "k1", "p2", 5)
    assert store.head() == (1, 5) and _all(store) == [("x", 0, "one")]


def test_identity_and_races(spark, store):
    with pytest.raises(st.InvalidSchema):
        st.DocumentStore.create(spark, store.log.root)
    with pytest.raises(st.InvalidSchema):
        st.DocumentStore(spark, store.log.root + "-none")
    store.apply_batch(_docs(spark, []), "k", "p", 1)
    with pytest.raises(st.ConcurrentCommit):
        store.log.commit({"generation": 1})
    assert store.head() == (1, 1) and store.count() == 0


def test_stream_resumes_and_equals_one_batch(spark, store, tmp_path):
    docs = conversation_documents(spark, SF).select(
        "session_id", "seq", "event_time_unix_ms", "event_type", "surface", "workspace_id", F.array("scope").alias("scope_tokens"), "body",
        F.sha2("body", 256).alias("fingerprint"), F.lit("r").alias("source_revision"),
    )
    source, place = str(tmp_path / "in"), str(tmp_path / "c")
    for part in ("seq < 2", "seq >= 2"):
        docs.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(st.DOCUMENT).parquet(source)
        ingest(stream, store, "live", place).awaitTermination()
    assert store.count() == docs.count() and store.documents().exceptAll(docs).count() == 0
    assert suffix(docs, store.sessions()).count() == 0


def test_view_partitions(spark, tmp_path):
    view = views.ViewStore(spark, str(tmp_path / "v"), "row_key string, session_id string, seq long", (("session_id", "seq"),))

    def rows(*r):
        return spark.createDataFrame(list(r), view.schema)

    def at(cursor, identity="src"):
        return views.Checkpoint(identity, f"r{cursor}", cursor, lag_ms=cursor)

    with pytest.raises(views.ViewUnavailable):
        view.require()
    view.replace_partition("p", rows(("a", "s", 0), ("b", "s", 1)), at(1))
    view.replace_partition("q", rows(("c", "t", 0)), at(1))
    view.set_state("ready")
    view.apply_delta("p", 1, rows(("b", "s", 2), ("d", "s", 3)), rows(("a", "s", 0)).select("row_key"), at(2))
    assert sorted(tuple(r) for r in view.rows().collect()) == [("b", "s", 2, "p"), ("c", "t", 0, "q"), ("d", "s", 3, "p")]
    before = view.status()
    with pytest.raises(views.CursorConflict):
        view.apply_delta("p", 1, rows(), rows(), at(3))
    with pytest.raises(views.CursorConflict):
        view.apply_delta("new", 1, rows(), rows(), at(3))
    with pytest.raises(views.PartitionConflict):
        view.apply_delta("q", 1, rows(("d", "u", 0)), rows(), at(2))
    with pytest.raises(views.PartitionConflict):
        view.replace_partition("r", rows(("e", "s", 2)), at(1))
    with pytest.raises(views.PartitionConflict):
        view.delete_partition("q", 1, "another")
    assert view.status() == before and before["state"] == "ready"
    view.require(2)
    with pytest.raises(views.StaleView):
        view.require(1)
    listed = spark.createDataFrame([("p", "src", "r2", 2), ("z", "src", "r1", 1)], "partition string, source_identity string, revision string, cursor long")
    assert dict(views.reconcile(view.checkpoints(), listed).collect()) == {"p": "skip", "q": "delete", "z": "replace"}
    view.delete_partition("q", 1, "src")
    assert {r.row_key for r in view.rows().collect()} == {"b", "d"}


@pytest.mark.parametrize("text, literal", [("x" * 300 + "Needle" + "y" * 900, "needle"), ("語" * 500 + "needle" + "語" * 500, "needle"), ("😀" * 400 + "needle", "needle"), ("needle" + "z" * 400, "needle")])
def test_snippets_hold_the_match_within_bounds(text, literal):
    got = snippet(text, *find(text, literal))
    assert literal in got.lower() and len(got.encode("utf-16-le")) <= 640 and len(got.encode()) <= 1280
    assert got.strip("…") in text and got.startswith("…") == (not text.startswith(got[:3])) and len(clip(text).encode("utf-16-le")) <= 512


def test_short_texts_stay():
    assert snippet("a needle", 2, 6) == "a needle" and clip("abc") == "abc" and find("abc", "d") is None


def test_selection_uses_no_path_twice(spark):
    names = "a string, b string, support long, left long, right long, shared long, opportunities long"
    rows = [("a/1", "b/1", 9, 10, 10, 9, 12), ("b/1", "c/1", 8, 10, 10, 8, 12), ("c/1", "d/1", 8, 10, 10, 8, 13)]
    df = spark.createDataFrame(rows, names)
    assert [(r.a, r.b) for r in cochange.selected(df)] == [("a/1", "b/1"), ("c/1", "d/1")]
    assert cochange.annotations([("a/1", True), ("c/1", True)], df) == [("a/1", "b/1")]
    assert cochange.annotations([("a/1", False), ("d/1", True)], df) == [("d/1", "c/1")]


def test_queries_without_oracle(spark):
    found = catalogue.queries()
    rows = found["snippets"](spark, SF).collect()
    assert rows and all(r.snippet for r in rows)
    assert found["selected_candidates"](spark, SF).count() <= cochange.SELECTED
