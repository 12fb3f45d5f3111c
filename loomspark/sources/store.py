"""An append-only store of documents: immutable Parquet parts and a log with one small file for each generation.

A generation exists once its log file does. Files of the log are made by the file system's create-if-absent, so that of
two writers of one generation one fails and nothing is half done. Paths go through Hadoop's file system, as data do.
Readers pin a generation; parts of later ones are not in their lists. Each part has its documents, its sessions' cursors
and its postings; the log's entries have the numbers of documents and tokens that ranking needs. Compaction writes one
part in place of all before it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources import postings

_LONGS, _LISTS = ("seq", "event_time_unix_ms"), ("scope_tokens",)
DOCUMENT = T.StructType([
    T.StructField(n, T.LongType() if n in _LONGS else T.ArrayType(T.StringType()) if n in _LISTS else T.StringType())
    for n in ("session_id", "seq", "event_time_unix_ms", "event_type", "surface", "workspace_id", "scope_tokens", "body", "fingerprint", "source_revision")
])
LOG = (
    "generation long, watermark long, key string, payload string, inserted long, replayed long, part string, tokens long, buckets int, "
    "base long"
)
KEY, MAX_IDS = ["session_id", "seq"], 32
#: New entries of a log beyond which a job reads them.
MANY = 200


class StoreError(Exception):
    """Base of the store's refusals: `code` is stable, `retryable` tells whether the same call can work later."""

    code, retryable = "store", False


def _error(name: str, code: str, retryable: bool = False) -> type[StoreError]:
    return type(name, (StoreError,), {"code": code, "retryable": retryable, "__module__": __name__})


InvalidSchema = _error("InvalidSchema", "invalid-schema")
InvalidBatch = _error("InvalidBatch", "invalid-batch")
NonMonotonicWatermark = _error("NonMonotonicWatermark", "non-monotonic-watermark")
IdempotencyConflict = _error("IdempotencyConflict", "idempotency-conflict")
SequenceGap = _error("SequenceGap", "sequence-gap")
WorkspaceConflict = _error("WorkspaceConflict", "workspace-conflict")
DocumentConflict = _error("DocumentConflict", "document-conflict")
StaleGeneration = _error("StaleGeneration", "stale-generation", True)
ConcurrentCommit = _error("ConcurrentCommit", "concurrent-commit", True)


class Files:
    """The few calls of Hadoop's file system that logs need."""

    _known: dict[tuple, tuple] = {}

    def __init__(self, spark: SparkSession, root: str):
        context = spark.sparkContext
        place = (context.applicationId, root.split("://")[0] if "://" in root else "")
        if place not in self._known:  # each look-up of a class asks the JVM several times
            hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
            fs = hadoop.Path(root).getFileSystem(conf)
            files = hadoop.FileContext.getFileContext(fs.getUri(), conf)
            self._known[place] = hadoop.Path, fs, files, context._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        self._path, self._fs, self._context, self._no_options = self._known[place]

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def create(self, path: str, text: str) -> bool:
        """Whether the file was made; one that exists is left as it is. A draft is renamed, which never overwrites."""
        draft = f"{path}.{uuid.uuid4().hex}.draft"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._context.rename(self._path(draft), self._path(path), self._no_options)
        except Py4JJavaError:
            self.delete(draft)
            if self.exists(path):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def states(self, path: str) -> list[str]:
        """A line for a file, or for each file of a folder."""
        found = self._fs.listStatus(self._path(path)) if self.exists(path) else []
        return [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in found]

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


def schema_fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(json.dumps([(f.name, f.dataType.simpleString()) for f in schema]).encode()).hexdigest()


@dataclass(frozen=True)
class Receipt:
    generation: int
    watermark: int
    inserted: int
    replayed: int
    batch_replayed: bool = False


class Log:
    """Numbered JSON files. The greatest number is the head."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.files = Files(spark, self.root)
        self._read: dict[int, dict] = {}

    def create(self, identity: str) -> None:
        if not self.files.create(f"{self.root}/identity.json", json.dumps({"identity": identity})):
            raise InvalidSchema(f"{self.root} has a store")

    def check(self, identity: str) -> None:
        if not self.files.exists(f"{self.root}/identity.json"):
            raise InvalidSchema(f"{self.root} has no store")
        if json.loads(self.files.read(f"{self.root}/identity.json")).get("identity") != identity:
            raise InvalidSchema("the store is of another schema")

    def load(self, upto: int | None = None) -> list[dict]:
        """The entries in order: a small record for each commit. Those read once are kept, for none ever changes."""
        wanted = sorted(int(n[:-5]) for n in self.files.names(f"{self.root}/log") if n.endswith(".json"))
        new = [g for g in wanted if g not in self._read]
        if len(new) > MANY:
            rows = self.spark.read.schema(self.schema).option("pathGlobFilter", "*.json").json(f"{self.root}/log").collect()
            self._read |= {r["generation"]: r.asDict() for r in rows}
        else:
            names = T._parse_datatype_string(self.schema).names
            self._read |= {g: dict.fromkeys(names) | json.loads(self.files.read(f"{self.root}/log/{g:020d}.json")) for g in new}
        return [self._read[g] for g in wanted if upto is None or g <= upto]

    def entries(self, upto: int | None = None) -> DataFrame:
        return self.spark.createDataFrame(self.load(upto), self.schema)

    def commit(self, entry: dict) -> None:
        if not self.files.create(f"{self.root}/log/{entry['generation']:020d}.json", json.dumps(entry)):
            raise ConcurrentCommit(f"generation {entry['generation']} was taken by another writer")


class DocumentStore:
    """Documents of sessions, contiguous by sequence number from 0, appended by idempotent batches."""

    def __init__(self, spark: SparkSession, root: str, generation: int | None = None):
        self.spark, self.log, self.pinned = spark, Log(spark, root, LOG), generation
        self.log.check(schema_fingerprint(DOCUMENT))

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> DocumentStore:
        Log(spark, root, LOG).create(schema_fingerprint(DOCUMENT))
        return cls(spark, root)

    def reader(self) -> DocumentStore:
        """This store at its present generation, whatever is appended later."""
        return DocumentStore(self.spark, self.log.root, self.head()[0])

    def head(self) -> tuple[int, int]:
        """generation and watermark; zeros for an empty store."""
        entries = self.log.load(self.pinned)
        return (entries[-1]["generation"], max(e["watermark"] for e in entries)) if entries else (0, 0)

    def parts(self) -> list[dict]:
        """The entries whose parts hold the documents: those since the last that holds all before it."""
        found: list[dict] = []
        for e in self.log.load(self.pinned):
            if e["part"]:
                found = [e] if e["base"] is not None else [*found, e]
        return found

    def _parts(self, kind: str, schema) -> DataFrame:
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.log.root}/{e['part']}/{kind}" for e in parts])

    def stats(self) -> tuple[int, int]:
        """Documents, and tokens of all their indexed columns; from the log."""
        entries = self.log.load(self.pinned)
        return sum(e["inserted"] for e in entries), sum(e["tokens"] or 0 for e in entries)

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms, from their buckets only."""
        wanted = [f"{self.log.root}/{e['part']}/postings/b={b}" for e in self.parts() for b in sorted({postings.bucket(t, e["buckets"]) for t in terms})]
        found = [w for w in wanted if self.log.files.exists(w)]
        if not found:
            return self.spark.createDataFrame([], postings.SCHEMA)
        return self.spark.read.schema(postings.SCHEMA).parquet(*found).filter(F.col("term").isin(terms))

    def documents(self) -> DataFrame:
        return self._parts("documents", DOCUMENT)

    def sessions(self) -> DataFrame:
        """session_id, workspace_id, next_seq: from the parts' small tables of sessions, not from documents."""
        deltas = self._parts("sessions", "session_id string, workspace_id string, next_seq long, revision string")
        return deltas.groupBy("session_id").agg(
            F.first("workspace_id").alias("workspace_id"), F.max("next_seq").alias("next_seq"), F.max_by("revision", "next_seq").alias("revision")
        )

    def source_state(self, ids: list[str]) -> DataFrame:
        """Cursors of at most MAX_IDS sessions; unknown ones drop out."""
        if len(ids) > MAX_IDS:
            raise InvalidBatch("too many sessions")
        return self.sessions().filter(F.col("session_id").isin(ids))

    def require(self, watermark: int) -> None:
        if self.head()[1] < watermark:
            raise StaleGeneration(f"the store is at watermark {self.head()[1]}, not yet at {watermark}")

    def count(self) -> int:
        return self.stats()[0]

    def receipt(self, key: str) -> dict | None:
        """The entry of a batch, if it was appended."""
        return next((e for e in self.log.load() if e["key"] == key), None)

    def compact(self) -> int:
        """Writes all parts as one, which readers of later generations use; pinned readers keep theirs. Gives the
        generation."""
        generation, watermark = self.head()
        part = f"parts/{uuid.uuid4().hex}"
        root = f"{self.log.root}/{part}"
        try:
            self.documents().repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq").write.parquet(f"{root}/documents")
            self.sessions().write.parquet(f"{root}/sessions")
            buckets = postings.write(self.spark.read.schema(DOCUMENT).parquet(f"{root}/documents"), f"{root}/postings", self.stats()[1])
            self.log.commit(dict(generation=generation + 1, watermark=watermark, inserted=0, replayed=0, part=part, buckets=buckets, base=generation))
        except BaseException:
            self.log.files.delete(root)
            raise
        return generation + 1

    def apply_batch(self, docs: DataFrame, key: str, payload: str, watermark: int) -> Receipt:
        """All of the batch or nothing. The same key with the same payload and watermark gives its first receipt again.

        Documents may repeat stored ones exactly; new ones follow their session's cursor without a gap. Equal rows
        within the batch count once as inserted. Null ids or sequence numbers are refused. An empty batch moves the
        watermark only.
        """
        if self.pinned is not None:
            raise InvalidBatch("a pinned reader can't write")
        if not key or not payload:
            raise InvalidBatch("a batch needs a key and a payload fingerprint")
        old = self.receipt(key)
        if old:
            if (old["payload"], old["watermark"]) != (payload, watermark):
                raise IdempotencyConflict(key)
            return Receipt(old["generation"], old["watermark"], old["inserted"], old["replayed"], True)
        generation, current = self.head()
        if watermark <= current:
            raise NonMonotonicWatermark(f"{watermark} after {current}")
        part = f"parts/{uuid.uuid4().hex}"
        try:
            inserted, replayed, rest = self._stage(docs, f"{self.log.root}/{part}")
            entry = dict(generation=generation + 1, watermark=watermark, key=key, payload=payload, inserted=inserted, replayed=replayed)
            self.log.commit(entry | rest | {"part": part if inserted else None})
        except BaseException:
            self.log.files.delete(f"{self.log.root}/{part}")
            raise
        return Receipt(generation + 1, watermark, inserted, replayed)

    def _stage(self, docs: DataFrame, part: str) -> tuple[int, int, dict]:
        canonical = F.array_sort(F.array_distinct("scope_tokens"))
        docs = docs.select(*[F.col(f.name).cast(f.dataType) for f in DOCUMENT]).withColumn("scope_tokens", canonical)
        docs.write.parquet(f"{part}/batch")
        batch = self.spark.read.schema(DOCUMENT).parquet(f"{part}/batch")
        state = self.sessions().select("session_id", F.col("workspace_id").alias("had"), "next_seq")
        rows = batch.groupBy(*DOCUMENT.names).agg(F.count("*").alias("times")).join(state, "session_id", "left")
        rows = rows.withColumn("next_seq", F.coalesce("next_seq", F.lit(0)))
        session = Window.partitionBy("session_id")
        new = F.col("seq") >= F.col("next_seq")
        rows = rows.select(
            "*", new.alias("new"), F.lag("seq").over(session.orderBy("seq")).alias("before"),
            F.coalesce("had", F.min("workspace_id").over(session)).alias("owner"),
        )
        bad = rows.agg(
            F.count_if(F.col("session_id").isNull() | F.col("seq").isNull() | (F.col("seq") < 0) | F.col("workspace_id").isNull()),
            F.min(F.when(F.col("workspace_id") != F.col("owner"), F.col("session_id"))),
            F.min(F.when(F.col("seq") == F.col("before"), F.col("session_id"))),
            F.min(F.when(F.col("new") & (F.col("seq") > F.greatest("next_seq", F.coalesce(F.col("before") + 1, F.lit(0)))), F.col("session_id"))),
            F.sum(F.col("new").cast("long")), F.sum("times"), F.count_if(~F.col("new")),
        ).first()
        for value, error in zip(bad[:4], (InvalidBatch, WorkspaceConflict, DocumentConflict, SequenceGap), strict=True):
            if value:
                raise error(str(value))
        if bad[6]:
            again = rows.filter(~F.col("new")).select(*DOCUMENT.names)
            same = [F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}")) for n in DOCUMENT.names]
            low, high = again.agg(F.min("session_id"), F.max("session_id")).first()
            stored = self.documents().filter(F.col("session_id").between(low, high)).alias("y")
            differs = again.alias("x").join(stored, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in KEY], "left").filter(~F.forall(F.array(*same), lambda b: b))
            wrong = differs.select("x.session_id").first()
            if wrong:
                raise DocumentConflict(wrong[0])
        fresh = rows.filter("new").select(*DOCUMENT.names, "owner")
        ordered = fresh.select(*DOCUMENT.names).repartitionByRange("session_id", "seq").sortWithinPartitions("session_id", "seq")
        ordered.write.parquet(f"{part}/documents")
        written = self.spark.read.schema(DOCUMENT).parquet(f"{part}/documents")
        n_tokens = postings.token_count(written)
        buckets = postings.write(written, f"{part}/postings", n_tokens)
        cursors = fresh.groupBy("session_id").agg(
            F.first("owner").alias("workspace_id"), (F.max("seq") + 1).alias("next_seq"), F.max_by("source_revision", "seq").alias("revision")
        )
        cursors.write.parquet(f"{part}/sessions")
        self.log.files.delete(f"{part}/batch")
        return bad[4] or 0, (bad[5] or 0) - (bad[4] or 0), {"tokens": n_tokens, "buckets": buckets}
