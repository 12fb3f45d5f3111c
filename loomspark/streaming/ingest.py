"""Live ingest: what of a source's logs is new, in batches of bounded size, under keys that a restart gives again.

A source is caught up in phases: its notifications are queued from the start on, its sessions listed and read, then what was
queued is read again, and only then does it count as live. Nothing is lost between listing and live, and nothing is taken in
twice, for only what lies past a session's cursor is sent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.sources.logs import listing
from loomspark.sources.store import DOCUMENT, KEY, DocumentStore, StoreError, _error

#: Documents and bytes of a batch, sessions that a queue holds.
BATCH_DOCUMENTS, BATCH_BYTES, QUEUED = 256, 768 * 1024, 4096
TOPICS = ("session/created", "session/event", "session/disposed")

CursorAhead = _error("CursorAhead", "cursor-ahead")
WorkspaceMismatch = _error("WorkspaceMismatch", "workspace-mismatch")
QueueOverflow = _error("QueueOverflow", "queue-overflow")
EventTooLarge = _error("EventTooLarge", "event-too-large")


def suffix(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Documents at or past their session's cursor; the stored ones before it need not be sent again."""
    cursors = sessions.select("session_id", "next_seq")
    return docs.join(cursors, "session_id", "left").filter(F.col("seq") >= F.coalesce("next_seq", F.lit(0))).drop("next_seq")


def compared(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id and status of each session of whole logs: unchanged, new, cursor-ahead (the log is shorter than what is
    stored) or workspace-mismatch."""
    logs = docs.groupBy("session_id").agg(F.count("*").alias("n"), F.min("workspace_id").alias("workspace"))
    known = sessions.select("session_id", "next_seq", F.col("workspace_id").alias("had"))
    cursor = F.coalesce("next_seq", F.lit(0))
    status = F.when(cursor > F.col("n"), "cursor-ahead").when(F.col("had").isNotNull() & (F.col("had") != F.col("workspace")), "workspace-mismatch")
    return logs.join(known, "session_id", "left").select("session_id", status.when(cursor == F.col("n"), "unchanged").otherwise("new").alias("status"))


def new_documents(docs: DataFrame, sessions: DataFrame) -> DataFrame:
    """The suffix of whole logs; refused where a log contradicts what is stored."""
    wrong = compared(docs, sessions).filter("status IN ('cursor-ahead', 'workspace-mismatch')").first()
    if wrong:
        raise {"cursor-ahead": CursorAhead, "workspace-mismatch": WorkspaceMismatch}[wrong.status](wrong.session_id)
    return suffix(docs, sessions)


def chunked(docs: DataFrame, most: int = BATCH_DOCUMENTS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """session_id, seq, chunk: the batch of its session that each document goes into, in order; a batch is closed before it
    would hold more than `most` documents or `most_bytes`. One pass over each session with a running total; tasks hold a
    batch of rows at a time. A document that fits in no batch has a null chunk."""
    size = F.octet_length(F.to_json(F.struct(*DOCUMENT.names))) + 1
    rows = docs.select("session_id", "seq", size.cast("long").alias("bytes")).repartition("session_id").sortWithinPartitions("session_id", "seq")

    def run(batches):
        session, chunk, held, total = None, 0, 0, 2
        for batch in batches:
            out = []
            for s, n in zip(batch.column("session_id").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if s != session:
                    session, chunk, held, total = s, 0, 0, 2
                if n > most_bytes:
                    out.append(None)
                    continue
                if held >= most or total + n > most_bytes:
                    chunk, held, total = chunk + 1, 0, 2
                held, total = held + 1, total + n
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("seq"), pc.cast(pa.array(out), pa.int64())], ["session_id", "seq", "chunk"])

    return rows.mapInArrow(run, "session_id string, seq long, chunk long")


def payload(docs: DataFrame) -> str:
    """A fingerprint of the rows, whatever their order: their number and the sum of their hashes."""
    row = docs.agg(F.count("*"), F.sum(F.xxhash64(*DOCUMENT.names).cast("decimal(38,0)"))).first()
    return f"{row[0]}:{row[1] or 0}"


def batch_key(watermark: int, fingerprint: str, first: tuple, last: tuple) -> str:
    """The identity of a batch: the same documents under the same watermark have the same."""
    text = f"loomspark/batch/v1\0{watermark}\0{fingerprint}\0{first}\0{last}"
    return "batch-" + hashlib.sha256(text.encode()).hexdigest()


def append_new(docs: DataFrame, store: DocumentStore) -> int:
    """Appends what is new of whole logs, as one batch, and gives the number of documents. The store takes a batch of any size
    at once; `chunked` is for stores that don't."""
    rows = new_documents(docs, store.sessions()).persist()
    try:
        n, first, last = rows.agg(F.count("*"), F.min(F.struct(*KEY)), F.max(F.struct(*KEY))).first()
        if not n:
            return 0
        watermark, fingerprint = store.head()[1] + 1, payload(rows)
        store.apply_batch(rows, batch_key(watermark, fingerprint, tuple(first), tuple(last)), fingerprint, watermark)
        return n
    finally:
        rows.unpersist()


class LiveQueue:
    """The sessions that notifications name, each once, in order of arrival. A session that is disposed of stays stored."""

    def __init__(self, most: int = QUEUED):
        self.most, self.changed, self.disposed = most, {}, {}

    def put(self, topic: str, session_id: str) -> None:
        if topic not in TOPICS or not session_id:
            raise StoreError(f"notification {topic}")
        where = self.disposed if topic == "session/disposed" else self.changed
        if session_id not in where and len(where) >= self.most:
            raise QueueOverflow(f"more than {self.most} sessions")
        where[session_id] = None

    def take(self) -> list[str]:
        found = list(self.changed)
        self.changed.clear()
        return found


class Source:
    """Keeps a store up to date with a source: `list_sessions` gives session_id, `read` the documents of whole logs of some
    sessions, `subscribe` calls back with topic and session. phase tells how far it has come."""

    def __init__(
        self, store: DocumentStore, list_sessions: Callable[[], DataFrame], read: Callable[[DataFrame], DataFrame],
        subscribe: Callable[[Callable[[str, str], None]], Callable[[], None]], most: int = QUEUED,
    ):
        self.store, self.list_sessions, self.read, self.subscribe = store, list_sessions, read, subscribe
        self.queue, self.phase, self.error, self.committed = LiveQueue(most), "idle", None, 0
        self._unsubscribe: Callable[[], None] = lambda: None

    def _heard(self, topic: str, session_id: str) -> None:
        if self.phase == "error":
            return
        try:
            self.queue.put(topic, session_id)
        except StoreError as e:
            self._failed(e)

    def _failed(self, e: Exception) -> None:
        self.phase, self.error = "error", getattr(e, "code", "source-error")
        self._unsubscribe()

    def _sessions(self, ids: Iterable[str]) -> DataFrame:
        return self.store.spark.createDataFrame([(i,) for i in ids], "session_id string")

    def drain(self) -> None:
        """Reads again what was notified of, until nothing is queued."""
        while changed := self.queue.take():
            self.committed += append_new(self.read(self._sessions(changed)), self.store)

    def start(self) -> None:
        """Subscribes, then lists, reads and drains."""
        try:
            self._unsubscribe = self.subscribe(self._heard)
            self.phase = "listing"
            sessions = listing(self.list_sessions())
            self.phase = "scanning"
            self.committed += append_new(self.read(sessions), self.store)
            self.phase = "draining" if self.phase != "error" else "error"
            self.drain()
            if self.phase == "error":
                raise StoreError(self.error)
            self.phase = "live"
        except Exception as e:
            self._failed(e)
            raise


def ingest(stream: DataFrame, store: DocumentStore, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends what is new of each micro-batch of documents, under the key `name/epoch`; the watermark counts appends."""

    def append(batch: DataFrame, epoch: int) -> None:
        key = f"{name}/{epoch}"
        if store.receipt(key):
            return
        rows = suffix(batch.dropDuplicates(KEY + ["fingerprint"]), store.sessions()).persist()
        try:
            if not rows.isEmpty():
                store.apply_batch(rows, key, payload(rows), store.head()[1] + 1)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def bootstrap(spark: SparkSession, store: DocumentStore, source: str, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """A folder of documents, caught up with by one append, and then followed as a stream from where the listing was."""
    append_new(spark.read.schema(DOCUMENT).parquet(source), store)
    return ingest(spark.readStream.schema(DOCUMENT).parquet(source), store, name, checkpoint, **trigger)
