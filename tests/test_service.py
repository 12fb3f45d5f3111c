"""Views, the service, and sources that are caught up with."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from loomspark import service as sv
from loomspark.plans import search, views
from loomspark.sources import logs
from loomspark.sources import store as st
from loomspark.sources import views as vs
from loomspark.streaming import ingest as ing


def _docs(spark, rows, workspace="/w"):
    full = [(s, q, 1000 + q, "message", "current", workspace, ["wa"], body, f"f{body}", "r1") for s, q, body in rows]
    return spark.createDataFrame(full, st.DOCUMENT)


@pytest.fixture
def store(spark, tmp_path):
    return st.DocumentStore.create(spark, str(tmp_path / "s"))


@pytest.fixture
def registry(spark, tmp_path):
    return views.Registry(spark, str(tmp_path / "v"), [views.ExactRange(), views.Conversation()])


def _range_rows(spark, *rows):
    return spark.createDataFrame(list(rows), views.ExactRange.schema)


def test_of_two_writers_that_read_the_same_head_one_is_refused(spark, tmp_path):
    view = vs.ViewStore(spark, str(tmp_path / "v"), "row_key string, n long")
    view.replace_partition("p", spark.createDataFrame([("a", 1)], view.schema), vs.Checkpoint("s", "r1", 1))
    other = vs.ViewStore(spark, str(tmp_path / "v"), "row_key string, n long")
    rows = [spark.createDataFrame([(k, 2)], view.schema) for k in "bc"]
    none = view.rows().select("row_key").limit(0)
    write, refused = other._write, []

    def slow(head, *rest):  # between its check and its commit another writer commits
        view.apply_delta("p", 1, rows[0], none, vs.Checkpoint("s", "r2", 2))
        return write(head, *rest)

    other._write = slow
    with pytest.raises(st.ConcurrentCommit):
        other.apply_delta("p", 1, rows[1], none, vs.Checkpoint("s", "r2", 2))
    other._write = write
    with pytest.raises(vs.CursorConflict):
        other.apply_delta("p", 1, rows[1], none, vs.Checkpoint("s", "r2", 2))
    other.apply_delta("p", 2, rows[1], none, vs.Checkpoint("s", "r3", 3))
    assert {r.row_key for r in view.rows().collect()} == {"a", "b", "c"} and not refused


def test_compaction_keeps_answers_and_pins(spark, store):
    for i, body in enumerate(("alpha beta", "beta gamma beta", "alpha")):
        store.apply_batch(_docs(spark, [(f"s{i}", 0, body), (f"s{i}", 1, "delta beta")]), f"k{i}", "p", i + 1)
    request = search.Request(("beta", "delta beta", "alpha"))
    pinned, before = store.reader(), search.search_batch(store, request)
    assert store.compact() == 4 and len(store.parts()) == 1 and len(pinned.parts()) == 3
    after = search.search_batch(store, request)
    assert before["fused"] == after["fused"] and before["sources"] == after["sources"] and after["generation"] == 4
    store.apply_batch(_docs(spark, [("s0", 2, "beta")]), "k9", "p", 9)
    assert store.count() == 7 and store.documents().count() == 7 and pinned.documents().count() == 6
    assert search.search_batch(pinned, request)["fused"] == before["fused"]
    assert store.apply_batch(_docs(spark, []), "k0", "p", 1).batch_replayed


def test_stored_and_scanned_answers_are_equal(spark, store):
    rows = [(f"s{i:02d}", q, " ".join("the cat of the mat in a_b".split()[(i * 3 + q) % 5 :]) * (1 + q)) for i in range(30) for q in range(3)]
    store.apply_batch(_docs(spark, rows), "k", "p", 1)
    docs = store.documents().withColumn("tokens", search_tokens())
    filters = search.Filters(scopes=("wa",), time_from=1001, seq_bounds={"s01": 2})
    request = search.Request(("the", "of the", "a b", "none", "*"), 7, 5, filters)
    one, two = (search.find(c, request) for c in (store, docs))
    for a, b in ((one.hits, two.hits), (one.ranked, two.ranked)):
        assert [[r.asDict() for r in x] for x in a] == [[r.asDict() for r in x] for x in b]
    assert search.fuse(one) == search.fuse(two) and search.fuse(one)[0][5]
    with pytest.raises(st.StaleGeneration):
        search.find(store, search.Request(("the",), minimum_watermark=2))


def search_tokens():
    from loomspark.functions.text import tokens

    return tokens(F.col("body"))


def test_bounds_of_requests():
    for bad in (dict(workspaces=tuple(f"/{i}" for i in range(33))), dict(surfaces=("a", "a")), dict(event_types=("",)), dict(scopes=("a",) * 17), dict(seq_bounds={"a": -1})):
        with pytest.raises(search.RequestError):
            search.Filters(**bad)
    with pytest.raises(views.AuthorizationRequired):
        views.Authority(())
    with pytest.raises(views.InvalidQuery):
        views.Authority(("A b",))
    assert len(views.Authority.of(["/a", "/a", "/b"]).scope_tokens) == 2


def test_exact_range_is_authorised_ordered_and_fresh(spark, registry):
    store = registry.store("exact-range")
    rows = _range_rows(spark, ("b", "k", 5, "wa", "1"), ("a", "k", 5, "wa", "2"), ("c", "k", 1, "wb", "3"), ("d", "k", 2, "wa", "4"), ("e", "x", 2, "wa", "5"))
    params = {"exact_key": "k", "minimum": 1, "maximum": 5, "limit": 2}
    query = views.Query("exact-range", 1, "exact-range", params, views.Authority(("wa",)), 10)
    with pytest.raises(vs.ViewUnavailable):
        registry.query(query)
    store.replace_partition("p", rows, vs.Checkpoint("s", "r", 1, "f1", 7))
    store.set_state("ready")
    answer = registry.query(query)
    assert [(r.row_key, r.ordinal) for r in answer.rows.collect()] == [("d", 2), ("a", 5)]
    assert answer.snapshot["lag_ms"] == 7 and answer.snapshot["fence"] == "f1" and answer.build.startswith("sha256:")
    for change, error in (
        (dict(max_lag_ms=6), vs.StaleView), (dict(access="other"), views.UnsupportedAccess), (dict(view="other"), views.UnsupportedView),
        (dict(params=params | {"limit": 33}), views.InvalidQuery), (dict(params=params | {"more": 1}), views.InvalidQuery),
    ):
        with pytest.raises(error):
            registry.query(views.Query(**(query.__dict__ | change)))
    assert {m["id"] for m in registry.capabilities()} == {"exact-range", "conversation"}


def test_conversations_are_found_within_their_scope(spark, registry):
    docs = _docs(spark, [("x", 0, "red fox"), ("x", 1, "fox fox"), ("y", 0, "red")])
    rows = views.conversation_rows(docs, F.concat(F.lit("about "), "session_id"))
    view, store = views.Conversation(), registry.store("conversation")
    view.check_rows(rows)
    store.replace_partition("x", rows.filter("session_id = 'x'"), vs.Checkpoint("s", "r", 2))
    store.replace_partition("y", rows.filter("session_id = 'y'"), vs.Checkpoint("s", "r", 1))
    store.set_state("ready")
    query = views.Query("conversation", 1, "literal-session-search", {"literals": ["red", "fox"], "limit": 1}, views.Authority(("wa", "wb")), 0)
    got = [r.asDict(recursive=True) for r in registry.query(query).rows.collect()]
    assert [(r["session_id"], r["ordinals"], r["title"], r["updated"], r["truncated"]) for r in got] == [("x", [0, 1], "about x", 1001, True)]
    views.check_answer(got, 1, 2)
    with pytest.raises(views.InvalidQuery):
        views.check_answer(got, 1, 1)
    nobody = views.Query(**(query.__dict__ | {"authority": views.Authority(("wz",))}))
    assert registry.query(nobody).rows.count() == 0
    with pytest.raises(vs.InvalidBatch):
        view.check_rows(rows.withColumn("row_key", F.lit("k")))


def test_service_answers_and_refuses(spark, store, registry):
    told = []
    service = sv.Service(store, registry, observe=told.append)
    assert service.call("apply-batch", "1", documents=_docs(spark, [("x", 0, "red fox")]), key="k", payload="p", watermark=3).inserted == 1
    found = service.call("search-batch", "2", request=search.Request(("fox",)))
    assert found["watermark"] == 3 and [f["session_id"] for f in found["fused"]] == ["x"]
    assert service.call("source-state", "3", sessions=["x", "y"])["sessions"][0]["next_seq"] == 1
    assert service.call("health", "4")["watermark"] == "3" and service.call("cancel", "5", target="none") == "not-found"
    rows = _range_rows(spark, ("a", "k", 1, "wa", "v"))
    service.call("mutate-view", "6", view="exact-range", version=1, kind="replace", partition="p", rows=rows, checkpoint=vs.Checkpoint("s", "r", 1))
    service.call("set-view-lifecycle", "7", view="exact-range", version=1, state="ready")
    assert service.call("view-partition-state", "8", view="exact-range", version=1, partitions=["p"])[0]["cursor"] == 1
    query = views.Query("exact-range", 1, "exact-range", {"exact_key": "k", "minimum": 0, "maximum": 9, "limit": 1}, views.Authority(("wa",)), 0)
    assert service.call("execute", "9", query=query)["rows"] == [{"row_key": "a", "ordinal": 1, "value": "v"}]
    assert {m["status"]["state"] for m in service.call("describe-views", "10")} == {"ready", "building"}
    for arguments, code, retryable in (
        (dict(operation="nothing"), "invalid-request", False), (dict(operation="health", protocol="v0"), "unsupported-version", False),
        (dict(operation="health", deadline=time.time() - 1), "deadline-exceeded", True),
        (dict(operation="search-batch", request=search.Request(("fox",), minimum_watermark=9)), "stale-generation", True),
        (dict(operation="apply-batch", documents=_docs(spark, [("x", 5, "a")]), key="k2", payload="p", watermark=4), "sequence-gap", False),
    ):
        with pytest.raises(sv.ServiceError) as e:
            service.call(request_id="r", **arguments)
        assert (e.value.code, e.value.retryable) == (code, retryable)
    assert {"operation", "outcome", "micros"} == set(told[0]) and told[-1]["outcome"] == "sequence-gap"
    service.call("shutdown", "11")
    with pytest.raises(sv.ServiceError):
        service.call("health", "12")


def test_admission_cancellation_and_deadlines(spark, store, registry):
    service = sv.Service(store, registry, readers=1, queue=1)
    started, outcomes = threading.Event(), {}

    def slow(request):
        started.set()
        return spark.range(1 << 33).selectExpr("sum(sin(id))").first()[0]

    service._search_batch = slow

    def run(name, **more):
        try:
            outcomes[name] = service.call("search-batch", name, request=None, **more)
        except sv.ServiceError as e:
            outcomes[name] = e.code

    threads = [threading.Thread(target=run, args=(n,)) for n in ("a", "b")]
    threads[0].start()
    assert started.wait(30)
    threads[1].start()
    while len(service._calls) < 2:
        time.sleep(0.01)
    run("a")
    run("c")
    assert outcomes == {"a": "invalid-request", "c": "admission-rejected"}
    assert service.call("cancel", "x", target="b") == "queued"
    time.sleep(1)  # jobs of a take its tag
    assert service.call("cancel", "y", target="a") == "active"
    for t in threads:
        t.join(20)
    assert outcomes["a"] == outcomes["b"] == "cancelled"
    run("d", deadline=time.time() + 1.5)
    assert outcomes["d"] == "deadline-exceeded" and service.call("cancel", "z", target="a") == "not-found"


def test_shadow_and_supervision():
    told = []
    assert sv.shadowed(lambda: ["a"], lambda: ["a"], told.append) == ["a"]
    assert sv.shadowed(lambda: ["a"], lambda: ["b"], told.append) == ["a"]
    assert sv.shadowed(lambda: ["a"], lambda: 1 / 0, told.append) == ["a"]
    with pytest.raises(KeyError):
        sv.shadowed(lambda: {}["a"], lambda: ["a"], told.append)
    assert [t["outcome"] for t in told] == ["parity", "mismatch", "view-error", "oracle-error"]
    waits, left = [], [1, 1, 0]

    class Query:
        def awaitTermination(self):
            if left.pop(0):
                raise RuntimeError

    sv.supervised(Query, wait=waits.append)
    assert waits == [0.5, 1.0]


def test_a_source_is_caught_up_with(spark, store):
    told, full = {}, {"x": 2, "y": 1}

    def subscribe(listener):
        told["listener"] = listener
        return lambda: told.setdefault("stopped", True)

    def read(sessions):
        ids = [r.session_id for r in sessions.collect()]
        if len(ids) == 2 and "late" not in told:  # an event comes while sessions are read
            told["late"] = True
            found = _docs(spark, [(i, q, f"{i}{q}") for i in ids for q in range(full[i])])
            full["y"] = 3
            told["listener"]("session/event", "y")
            return found
        return _docs(spark, [(i, q, f"{i}{q}") for i in ids for q in range(full[i])])

    source = ing.Source(store, lambda: spark.createDataFrame([("x",), ("y",)], "session_id string"), read, subscribe, most=2)
    source.start()
    assert source.phase == "live" and source.committed == 5 and {r.session_id: r.next_seq for r in store.sessions().collect()} == {"x": 2, "y": 3}
    told["listener"]("session/disposed", "x")
    source.drain()
    assert store.count() == 5
    for i in ("x", "y", "z"):
        told["listener"]("session/event", i)
    assert source.phase == "error" and source.error == "queue-overflow" and told["stopped"]
    full["x"] = 1
    with pytest.raises(ing.CursorAhead):
        ing.append_new(read(spark.createDataFrame([("x",)], "session_id string")), store)
    with pytest.raises(ing.WorkspaceMismatch):
        ing.append_new(_docs(spark, [("x", q, "a") for q in range(3)], "/other"), store)


def test_chunks_are_closed_before_they_overflow(spark):
    docs = _docs(spark, [("x", q, "b" * (10 if q != 4 else 5000)) for q in range(9)] + [("y", 0, "b")])
    got = {(r.session_id, r.seq): r.chunk for r in ing.chunked(docs, 3, 2000).collect()}
    assert [got["x", q] for q in range(9)] == [0, 0, 0, 1, None, 1, 1, 2, 2] and got["y", 0] == 0
    sizes = [r[0] for r in docs.filter("seq < 3 AND session_id = 'x'").select(F.octet_length(F.to_json(F.struct(*st.DOCUMENT.names)))).collect()]
    two = {r.seq: r.chunk for r in ing.chunked(docs.filter("seq < 3 AND session_id = 'x'"), 256, 2 + 2 * (sizes[0] + 1)).collect()}
    assert two == {0: 0, 1: 0, 2: 1}


def test_logs_have_contracts(spark):
    def of(*texts):
        return spark.createDataFrame([("s", t) for t in texts], "session_id string, log string")

    event = '{"seq": "0", "type": "message", "surface": "current", "time": "2024-01-02T03:04:05Z", "text": "hi"}'
    got = logs.project(of(f'{{"session": {{"id": "s", "cwd": "/w"}}, "events": [{event}]}}')).first()
    assert (got.seq, got.event_time_unix_ms, got.body, got.workspace_id) == (0, 1704164645000, "hi", "/w") and got.fingerprint.startswith("sha256:")
    assert logs.project(of('{"session": {"id": "s", "cwd": "w"}, "events": []}', '{"records": []}')).count() == 0
    for bad in (f'{{"session": {{"id": "t", "cwd": "/w"}}, "events": [{event}]}}', f'{{"workspaceId": "w", "records": [{event.replace("0", "1", 1)}]}}'):
        with pytest.raises(logs.LogError):
            logs.project(of(bad)).collect()
    with pytest.raises(logs.LogError):
        logs.listing(of("", "").select("session_id"))
