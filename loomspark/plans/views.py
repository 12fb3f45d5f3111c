"""Compiled views: named rows in a ViewStore, each with fixed accesses that a request names; no SQL or expression comes from
a caller. A request's authority is applied before anything is ranked."""

from __future__ import annotations

import hashlib
import time
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import SCOPE_DOMAIN, manifest_digest, tokens
from loomspark.plans import search
from loomspark.sources.views import InvalidBatch, StaleView, ViewStore, ViewUnavailable, _error

InvalidQuery = _error("InvalidQuery", "invalid-query")
UnsupportedView = _error("UnsupportedView", "unsupported-view")
UnsupportedAccess = _error("UnsupportedAccess", "unsupported-access")
AuthorizationRequired = _error("AuthorizationRequired", "authorization-required")
#: Tokens of an authority, rows of an exact range, rows and bytes of a partition, views of a registry.
MAX_TOKENS, MAX_RANGE, MAX_ROWS, MAX_BYTES, MAX_VIEWS = 16, 32, 1024, 900 * 1024, 64


@dataclass(frozen=True)
class Authority:
    """The scope tokens whose rows a caller may see."""

    scope_tokens: tuple[str, ...]

    def __post_init__(self):
        if not self.scope_tokens:
            raise AuthorizationRequired("no scope token")
        wrong = any(not 1 <= len(t) <= 64 or not t.isascii() or not t.isalnum() or t.lower() != t for t in self.scope_tokens)
        if len(self.scope_tokens) > MAX_TOKENS or wrong:
            raise InvalidQuery("scope tokens")

    @classmethod
    def of(cls, workspaces: list[str]) -> Authority:
        """The tokens of workspaces, each once."""
        if any(not 1 <= len(w.encode()) <= 4096 or "\0" in w for w in workspaces):
            raise InvalidQuery("a workspace id")
        found = ["w" + hashlib.sha256(f"{SCOPE_DOMAIN}\0{w}".encode()).hexdigest()[:63] for w in workspaces]
        return cls(tuple(dict.fromkeys(found)))


class CompiledView(Protocol):
    """id, version, manifest, the schema of its rows with row_key, further unique columns, and its accesses by name."""

    id: str
    version: int
    schema: str
    unique: tuple[tuple[str, ...], ...]

    def manifest(self) -> dict: ...
    def check_rows(self, rows: DataFrame) -> None: ...
    def execute(self, rows: DataFrame, access: str, params: dict, authority: Authority) -> DataFrame: ...


def _manifest(view, accesses: list[dict]) -> dict:
    body = {
        "id": view.id, "version": view.version, "rowSchema": view.schema, "authorization": "scope-tokens/v1", "maximumPartitionRows": MAX_ROWS,
        "maximumPartitionBytes": MAX_BYTES, "accesses": accesses,
    }
    return body | {"digest": manifest_digest(body)}


def _only(params: dict, required: set, optional: set = frozenset()) -> None:
    if not required <= set(params) <= required | set(optional):
        raise InvalidQuery("parameters")


def _check(rows: DataFrame, key: str, texts: dict[str, tuple[int, int]]) -> None:
    """Refuses rows outside their bounds: bytes of texts, tokens, rows and bytes of a partition."""
    wrong = F.lit(False)
    for name, (least, most) in texts.items():
        wrong = wrong | F.col(name).isNull() | (F.instr(name, "\0") > 0) | ~F.octet_length(name).between(least, most)
    wrong = wrong | ~F.col("workspace_scope_token").rlike("^[a-z0-9]{1,64}$")
    n, size, bad = rows.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*")))), F.count_if(wrong)).first()
    if bad or n > MAX_ROWS or (size or 0) > MAX_BYTES:
        raise InvalidBatch(f"{key}: {n} rows of {size} bytes, {bad} out of bounds")


class ExactRange:
    """Rows of an exact key in a range of ordinals."""

    id, version, unique = "exact-range", 1, ()
    schema = "row_key string, exact_key string, ordinal long, workspace_scope_token string, value string"

    def manifest(self) -> dict:
        return _manifest(self, [{"name": "exact-range", "maximumResults": MAX_RANGE}])

    def check_rows(self, rows: DataFrame) -> None:
        _check(rows, self.id, {"row_key": (1, 256), "exact_key": (1, 256), "value": (0, 4096)})

    def execute(self, rows: DataFrame, access: str, params: dict, authority: Authority) -> DataFrame:
        """row_key, ordinal, value by ordinal and row_key."""
        if access != "exact-range":
            raise UnsupportedAccess(access)
        _only(params, {"exact_key", "minimum", "maximum", "limit"})
        key, low, high, limit = (params[k] for k in ("exact_key", "minimum", "maximum", "limit"))
        if not 1 <= len(key.encode()) <= 256 or "\0" in key or low > high or not 1 <= limit <= MAX_RANGE:
            raise InvalidQuery("exact-range")
        seen = rows.filter(F.col("workspace_scope_token").isin(*authority.scope_tokens) & (F.col("exact_key") == key) & F.col("ordinal").between(low, high))
        return seen.orderBy("ordinal", "row_key").limit(limit).select("row_key", "ordinal", "value")


class Conversation:
    """Turns of conversations; sessions are found by literals."""

    id, version, unique = "conversation", 1, (("session_id", "seq"),)
    schema = (
        "row_key string, session_id string, seq long, event_time_unix_ms long, event_type string, surface string, workspace_scope_token string, "
        "body string, fingerprint string, session_title string, session_updated_at_unix_ms long"
    )

    def manifest(self) -> dict:
        return _manifest(self, [{"name": "literal-session-search", "maximumResults": search.MAX_DEPTH}])

    def check_rows(self, rows: DataFrame) -> None:
        bounds = {"row_key": (1, 256), "session_id": (1, 128), "event_type": (1, 96), "surface": (1, 64), "body": (0, 1 << 20), "fingerprint": (1, 256)}
        _check(rows, self.id, bounds | {"session_title": (0, 4096)})
        if rows.filter(F.col("row_key") != conversation_key()).limit(1).count():
            raise InvalidBatch("a row key is not its session's and sequence number's")

    def execute(self, rows: DataFrame, access: str, params: dict, authority: Authority) -> DataFrame:
        """rank, session_id, score, ordinals, title, updated, evidence and truncated, which tells of sessions beyond the limit
        only, not of literals cut short."""
        if access != "literal-session-search":
            raise UnsupportedAccess(access)
        _only(params, {"literals", "limit"}, {"after_unix_ms", "before_unix_ms", "event_types", "surfaces"})
        if any(not x.strip() for x in params["literals"]):
            raise InvalidQuery("a blank literal")
        try:
            filters = search.Filters(
                scopes=authority.scope_tokens, event_types=tuple(params.get("event_types", ())), surfaces=tuple(params.get("surfaces", ())),
                time_from=params.get("after_unix_ms"), time_to=params.get("before_unix_ms"),
            )
            request = search.Request(tuple(params["literals"]), search.MAX_DEPTH, params["limit"], filters, most_bytes=search.MAX_VIEW_LITERAL_BYTES)
        except search.RequestError as e:
            raise InvalidQuery(str(e)) from e
        docs = rows.select(
            "session_id", "seq", "event_time_unix_ms", "event_type", "surface", F.array("workspace_scope_token").alias("scope_tokens"),
            "session_title", "session_updated_at_unix_ms", tokens(F.col("body")).alias("tokens"),
        )
        found = search.find(search.Scanned(docs), request)
        top = search.fused(docs, request, found)
        known = rows.filter(F.col("session_id").isin([r[0] for r in search.fuse(found)])).groupBy("session_id")
        known = known.agg(F.max_by("session_title", "seq").alias("title"), F.max("session_updated_at_unix_ms").alias("updated"))
        return top.join(F.broadcast(known), "session_id").select(  # as many as the limit
            F.col("position").alias("rank"), "session_id", "score", F.transform("parts", lambda p: p["ordinal"]).alias("ordinals"), "title", "updated",
            "evidence", F.col("fused_truncated").alias("truncated"),
        ).orderBy("rank")


def conversation_key():
    return F.concat_ws(":", F.lit("conversation-v1"), F.octet_length("session_id").cast("string"), F.col("session_id"), F.col("seq").cast("string"))


def conversation_rows(docs: DataFrame, title: Column | None = None) -> DataFrame:
    """Documents of a log as rows of the view; all rows of a session have the time of its last event."""
    last = F.max("event_time_unix_ms").over(Window.partitionBy("session_id"))
    rows = docs.withColumn("workspace_scope_token", F.get("scope_tokens", F.lit(0))).withColumn("session_updated_at_unix_ms", last)
    return rows.select(
        conversation_key().alias("row_key"), "session_id", "seq", "event_time_unix_ms", "event_type", "surface", "workspace_scope_token", "body",
        "fingerprint", (F.lit("") if title is None else title).alias("session_title"), "session_updated_at_unix_ms",
    )


@dataclass(frozen=True)
class Query:
    """A request: view and version, access, parameters, whose rows may be seen, and how far behind the view may be."""

    view: str
    version: int
    access: str
    params: dict
    authority: Authority
    max_lag_ms: int
    minimum_generation: int = 0


@dataclass
class Answer:
    """rows, the generation, fence and lag that they are of, the build, and timings without any content."""

    rows: DataFrame
    snapshot: dict
    build: str
    telemetry: dict = field(default_factory=dict)


class Registry:
    """Views by id and version, each with a store of its own under the root: a view that fails leaves the others alone."""

    def __init__(self, spark: SparkSession, root: str, views: list[CompiledView]):
        if not 1 <= len(views) <= MAX_VIEWS:
            raise ValueError("one to 64 views are allowed")
        self.views = {(v.id, v.version): v for v in views}
        if len(self.views) < len(views):
            raise ValueError("a view is there twice")
        self.spark, self.root, self._stores = spark, root, {}

    def capabilities(self) -> list[dict]:
        return [v.manifest() for v in self.views.values()]

    def view(self, name: str, version: int) -> CompiledView:
        found = self.views.get((name, version))
        if found is None:
            raise UnsupportedView(f"{name} {version}")
        return found

    def store(self, name: str, version: int = 1) -> ViewStore:
        """Named by the manifest's digest too, so that another build starts a store of its own."""
        view = self.view(name, version)
        build = view.manifest()["digest"][7:23]
        if (name, version) not in self._stores:
            self._stores[name, version] = ViewStore(self.spark, f"{self.root}/{name}-{version}-{build}", view.schema, view.unique)
        return self._stores[name, version]

    def query(self, q: Query) -> Answer:
        began = time.perf_counter()
        view = self.view(q.view, q.version)
        if q.access not in {a["name"] for a in view.manifest()["accesses"]}:
            raise UnsupportedAccess(q.access)
        if q.max_lag_ms < 0:
            raise InvalidQuery("max_lag_ms")
        store = self.store(q.view, q.version)
        status = store.status()
        if status["state"] != "ready":
            raise ViewUnavailable(status["state"])
        if status["lag_ms"] > q.max_lag_ms or status["generation"] < q.minimum_generation:
            raise StaleView(f"{status['lag_ms']} ms behind, generation {status['generation']}")
        rows = view.execute(store.rows().drop("_partition"), q.access, q.params, q.authority)
        took = {"operation": "execute", "outcome": "ok", "micros": int(1e6 * (time.perf_counter() - began))}
        return Answer(rows, status, view.manifest()["digest"], took)


def check_answer(answer: list[dict], limit: int, literals: int) -> None:
    """Refuses an answer of conversations that breaks its contract: ranks, ordinals, scores, limit."""
    if len(answer) > limit:
        raise InvalidQuery("more sessions than the limit")
    for i, r in enumerate(answer, 1):
        ordinals = list(r["ordinals"])
        right = r["rank"] == i and ordinals == sorted(set(ordinals)) and ordinals and 0 <= ordinals[0] and ordinals[-1] < literals
        if not right or not 0 < r["score"] < 1 or not 1 <= len(r["session_id"].encode()) <= 128:
            raise InvalidQuery(f"session {i}")
