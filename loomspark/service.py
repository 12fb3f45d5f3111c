"""The operations of the engine behind one envelope: admission, deadlines, cancellation, errors by code, health."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, TimeoutError

from pyspark.sql import SparkSession

from loomspark.plans import search
from loomspark.plans.views import Query, Registry
from loomspark.sources.store import DocumentStore, StoreError

VERSION = "loomspark/v1"
OPERATIONS = (
    "health", "source-state", "apply-batch", "cancel", "search-batch", "describe-views", "view-partition-state", "mutate-view",
    "set-view-lifecycle", "execute", "shutdown",
)
READERS, QUEUE, GRACE_S = 4, 16, 2.0
#: Codes of errors that the same call may not meet again.
RETRYABLE = {"deadline-exceeded", "cancelled", "admission-rejected", "storage-error"}


class ServiceError(Exception):
    """code is stable; retryable tells whether the same call can work later."""

    def __init__(self, code: str, text: str = "", retryable: bool | None = None):
        super().__init__(text or code)
        self.code, self.retryable = code, code in RETRYABLE if retryable is None else retryable


def as_error(e: BaseException) -> ServiceError:
    if isinstance(e, ServiceError):
        return e
    if isinstance(e, StoreError):
        return ServiceError(e.code, str(e), e.retryable)
    if isinstance(e, search.RequestError | ValueError | TypeError | KeyError):
        return ServiceError("invalid-request", str(e))
    return ServiceError("storage-error", type(e).__name__)


class _Call:
    """A request that was admitted: queued, active, or done. Its Spark jobs bear its tag."""

    def __init__(self, name: str, deadline: float):
        self.name, self.deadline, self.tag = name, deadline, f"loomspark-{uuid.uuid4().hex}"
        self.phase, self.reason, self.lock = "queued", None, threading.Lock()


class Service:
    """A store and a registry of views behind named operations. Reads run in READERS threads, QUEUE more may wait; writes run
    one at a time."""

    def __init__(self, store: DocumentStore, views: Registry, readers: int = READERS, queue: int = QUEUE, observe: Callable[[dict], None] | None = None):
        self.spark: SparkSession = store.spark
        self.store, self.views, self.limit, self.observe = store, views, readers + queue, observe or (lambda _: None)
        self._pool, self._writer, self._lock = ThreadPoolExecutor(readers), threading.Lock(), threading.Lock()
        self._calls: dict[str, _Call] = {}
        self._active = self._peak = 0
        self._closed = False

    def call(self, operation: str, request_id: str, deadline: float | None = None, protocol: str = VERSION, **arguments):
        """The operation's answer. `deadline` is a time of the clock, waiting included; a request at its deadline is too late."""
        began, outcome = time.perf_counter(), "aborted"
        try:
            if protocol != VERSION:
                raise ServiceError("unsupported-version", protocol)
            if operation not in OPERATIONS:
                raise ServiceError("invalid-request", operation)
            if self._closed:
                raise ServiceError("storage-error", "closed")
            deadline = time.time() + 3600 if deadline is None else deadline
            if time.time() >= deadline:
                raise ServiceError("deadline-exceeded")
            answer = getattr(self, "_" + operation.replace("-", "_"))
            found = self._read(answer, request_id, deadline, arguments) if operation in ("search-batch", "execute") else answer(**arguments)
            outcome = "ok"
            return found
        except Exception as e:
            error = as_error(e)
            outcome = error.code
            raise error from e
        finally:
            self.observe({"operation": operation, "outcome": outcome, "micros": int(1e6 * (time.perf_counter() - began))})

    def _read(self, run, request_id: str, deadline: float, arguments: dict):
        call = _Call(request_id, deadline)
        with self._lock:
            if request_id in self._calls:
                raise ServiceError("invalid-request", "the request id is in use")
            if len(self._calls) >= self.limit:
                raise ServiceError("admission-rejected")
            self._calls[request_id] = call
        future = self._pool.submit(self._active_read, call, run, arguments)
        try:
            return future.result(max(0.0, deadline - time.time()))
        except TimeoutError:
            self._stop(call, "deadline-exceeded")
            try:
                return future.result(GRACE_S)
            except TimeoutError:
                raise ServiceError("deadline-exceeded") from None

    def _active_read(self, call: _Call, run, arguments: dict):
        try:
            with call.lock:
                if call.reason:
                    raise ServiceError(call.reason)
                call.phase = "active"
            with self._lock:
                self._active += 1
                self._peak = max(self._peak, self._active)
            self.spark.sparkContext.addJobTag(call.tag)
            try:
                return run(**arguments)
            except Exception:
                if call.reason:
                    raise ServiceError(call.reason) from None
                raise
            finally:
                self.spark.sparkContext.removeJobTag(call.tag)
                with self._lock:
                    self._active -= 1
        finally:
            call.phase = "done"
            with self._lock:
                self._calls.pop(call.name, None)

    def _stop(self, call: _Call, reason: str) -> str:
        with call.lock:
            if call.phase == "done":
                return "already-terminal"
            call.reason = call.reason or reason
            phase = call.phase
        if phase == "active":
            threading.Thread(target=self._interrupt, args=(call,), daemon=True).start()
        return phase

    def _interrupt(self, call: _Call) -> None:
        """Cancels the call's jobs until it ends, for it may be between two of them."""
        while call.phase != "done":
            self.spark.sparkContext.cancelJobsWithTag(call.tag)
            time.sleep(0.2)

    def _cancel(self, target: str) -> str:
        """queued, active, already-terminal or not-found."""
        with self._lock:
            call = self._calls.get(target)
        return self._stop(call, "cancelled") if call else "not-found"

    def _health(self) -> dict:
        generation, watermark = self.store.head()
        return {
            "version": VERSION, "operations": list(OPERATIONS), "generation": str(generation), "watermark": str(watermark), "views": self.views.capabilities(),
            "readers": self._pool._max_workers, "capacity": self.limit, "active": self._active, "peak": self._peak, "serialized_writer": True,
        }

    def _source_state(self, sessions: list[str]) -> dict:
        generation, watermark = self.store.head()
        rows = self.store.source_state(sessions).collect()
        return {"generation": generation, "watermark": watermark, "sessions": [r.asDict() for r in rows]}

    def _apply_batch(self, documents, key: str, payload: str, watermark: int):
        with self._writer:
            return self.store.apply_batch(documents, key, payload, watermark)

    def _search_batch(self, request: search.Request) -> dict:
        return search.search_batch(self.store, request)

    def _describe_views(self) -> list[dict]:
        return [m | {"status": self.views.store(m["id"], m["version"]).status()} for m in self.views.capabilities()]

    def _view_partition_state(self, view: str, version: int, partitions: list[str]) -> list[dict]:
        return [r.asDict() for r in self.views.store(view, version).checkpoints(partitions).collect()]

    def _mutate_view(self, view: str, version: int, kind: str, partition: str, **rest) -> int:
        store, known = self.views.store(view, version), self.views.view(view, version)
        with self._writer:
            if kind == "replace":
                known.check_rows(rest["rows"])
                return store.replace_partition(partition, rest["rows"], rest["checkpoint"])
            if kind == "delta":
                known.check_rows(rest["upserts"])
                return store.apply_delta(partition, rest["expected"], rest["upserts"], rest["deletes"], rest["checkpoint"])
            if kind == "delete":
                return store.delete_partition(partition, rest["expected"], rest["identity"])
        raise ServiceError("invalid-request", kind)

    def _set_view_lifecycle(self, view: str, version: int, state: str) -> int:
        with self._writer:
            return self.views.store(view, version).set_state(state)

    def _execute(self, query: Query) -> dict:
        answer = self.views.query(query)
        rows = [r.asDict(recursive=True) for r in answer.rows.collect()]  # as many as the access allows
        return {"rows": rows, "snapshot": answer.snapshot, "build": answer.build, "telemetry": answer.telemetry}

    def _shutdown(self) -> str:
        self._closed = True
        for call in list(self._calls.values()):
            self._stop(call, "cancelled")
        self._pool.shutdown(wait=False)
        return "closed"


def shadowed(reference: Callable[[], list[str]], view: Callable[[], list[str]], observe: Callable[[dict], None]) -> list[str]:
    """The reference's answer, always; the view's runs beside it and is told of: parity, mismatch or error."""
    began = time.perf_counter()
    with ThreadPoolExecutor(2) as pool:
        one, other = pool.submit(reference), pool.submit(view)
        errors = [f.exception() for f in (one, other)]
    told = {"elapsed_ms": round(1e3 * (time.perf_counter() - began), 3), "view_status": as_error(errors[1]).code if errors[1] else "ok"}
    if errors[0]:
        observe(told | {"outcome": "oracle-error", "parity": False})
        raise errors[0]
    same = not errors[1] and one.result() == other.result()
    observe(told | {"outcome": "view-error" if errors[1] else "parity" if same else "mismatch", "parity": same})
    return one.result()


def supervised(start: Callable, attempts: int = 5, first_wait_s: float = 0.5, most_s: float = 30.0, wait: Callable[[float], None] = time.sleep):
    """Runs start() until its streaming query ends well; one that fails is started again after a wait that doubles."""
    delay = first_wait_s
    for attempt in range(1, attempts + 1):
        try:
            query = start()
            query.awaitTermination()
            return query
        except Exception:
            if attempt == attempts:
                raise
            wait(delay)
            delay = min(most_s, 2 * delay)
