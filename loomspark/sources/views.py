"""A view's rows in partitions, each replaced, changed or removed as a whole by one log entry; checkpoints are the
entries themselves."""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources.store import InvalidBatch, Log, StoreError, _error, schema_fingerprint

ENTRY = "generation long, partition string, kind string, part string, source_identity string, revision string, cursor long, fence string, lag_ms long, state string"
MAX_PARTITIONS = 64
STATES = ("building", "ready", "failed")

CursorConflict = _error("CursorConflict", "cursor-conflict", True)
PartitionConflict = _error("PartitionConflict", "partition-conflict")
ViewUnavailable = _error("ViewUnavailable", "view-unavailable", True)
StaleView = _error("StaleView", "stale-view", True)


@dataclass(frozen=True)
class Checkpoint:
    source_identity: str
    revision: str
    cursor: int
    fence: str = ""
    lag_ms: int = 0


class ViewStore:
    """Rows of `schema`, which has row_key. `unique` lists further sets of columns that no two rows share."""

    def __init__(self, spark: SparkSession, root: str, schema: str, unique: tuple[tuple[str, ...], ...] = ()):
        self.spark, self.schema = spark, T._parse_datatype_string(schema)
        self.unique = (("row_key",), *unique)
        self.log = Log(spark, root, ENTRY)
        identity = schema_fingerprint(self.schema)
        if not self.log.files.exists(f"{self.log.root}/identity.json"):
            self.log.create(identity)
        self.log.check(identity)

    def _live(self) -> dict[str, dict]:
        """The last entry of each partition that is there."""
        last = {e["partition"]: e for e in self.log.load() if e["partition"] is not None}
        return {k: e for k, e in last.items() if e["kind"] != "delete"}

    def checkpoints(self, keys: list[str] | None = None) -> DataFrame:
        """The last entry of each live partition."""
        if keys is not None and len(keys) > MAX_PARTITIONS:
            raise InvalidBatch("too many partitions")
        names = ("partition", "part", "source_identity", "revision", "cursor", "fence", "lag_ms")
        rows = [tuple(e[n] for n in names) for k, e in self._live().items() if keys is None or k in keys]
        return self.spark.createDataFrame(rows, "partition string, part string, source_identity string, revision string, cursor long, fence string, lag_ms long")

    def rows(self) -> DataFrame:
        """All rows, with their partition."""
        parts = [e["part"] for e in self._live().values()]
        schema = T.StructType([*self.schema.fields, T.StructField("_partition", T.StringType())])
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.log.root}/{p}" for p in parts])

    def status(self) -> dict:
        """generation, state, the last fence and the greatest lag of a partition."""
        entries = self.log.load()
        states = [e["state"] for e in entries if e["state"]]
        fences = [e["fence"] for e in entries if e["fence"]]
        lag = max((e["lag_ms"] or 0 for e in self._live().values()), default=0)
        return {"generation": entries[-1]["generation"] if entries else 0, "state": states[-1] if states else "building", "fence": fences[-1] if fences else "", "lag_ms": lag}

    def require(self, max_lag_ms: int | None = None) -> None:
        now = self.status()
        if now["state"] != "ready":
            raise ViewUnavailable(now["state"])
        if max_lag_ms is not None and now["lag_ms"] > max_lag_ms:
            raise StaleView(f"{now['lag_ms']} ms behind")

    def _head(self) -> int:
        entries = self.log.load()
        return entries[-1]["generation"] if entries else 0

    def _commit(self, head: int, **entry) -> int:
        """The entry after generation `head`, which the caller has read before it looked at anything else: of two writers
        that read the same head one is refused, and must look again."""
        self.log.commit({"generation": head + 1, **entry})
        return head + 1

    def set_state(self, state: str) -> int:
        if state not in STATES:
            raise InvalidBatch(state)
        return self._commit(self._head(), state=state)

    def _write(self, head: int, partition: str, kind: str, rows: DataFrame, checkpoint: Checkpoint) -> int:
        part = f"parts/{uuid.uuid4().hex}"
        names = self.schema.names
        try:
            rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], F.lit(partition).alias("_partition")).write.parquet(f"{self.log.root}/{part}")
            written = self.spark.read.parquet(f"{self.log.root}/{part}")
            others = self.rows().filter(F.col("_partition") != partition)
            for columns in self.unique:
                some = written.select(*names).groupBy(*columns).count()
                if some.filter("count > 1").first() or written.join(others.select(*columns), list(columns), "left_semi").first():
                    raise PartitionConflict(f"rows share {', '.join(columns)}")
            return self._commit(head, partition=partition, kind=kind, part=part, **asdict(checkpoint))
        except BaseException:
            self.log.files.delete(f"{self.log.root}/{part}")
            raise

    def replace_partition(self, partition: str, rows: DataFrame, checkpoint: Checkpoint) -> int:
        return self._write(self._head(), partition, "replace", rows, checkpoint)

    def _expect(self, partition: str, identity: str, cursor: int) -> int:
        """The generation in which the partition's cursor and source are as expected."""
        head = self._head()
        row = self._live().get(partition)
        if row is None or row["cursor"] != cursor:
            raise CursorConflict(f"the cursor is {row['cursor'] if row else 0}")
        if row["source_identity"] != identity:
            raise PartitionConflict("another source's partition")
        return head

    def apply_delta(self, partition: str, expected: int, upserts: DataFrame, deletes: DataFrame, checkpoint: Checkpoint) -> int:
        """Removes the row keys of `deletes`, then puts `upserts` over what is left."""
        head = self._expect(partition, checkpoint.source_identity, expected)
        if checkpoint.cursor <= expected:
            raise CursorConflict(f"the cursor is {expected}")
        held = self.rows().filter(F.col("_partition") == partition)
        return self._write(head, partition, "delta", delta(held.select(*self.schema.names), upserts, deletes), checkpoint)

    def delete_partition(self, partition: str, expected: int, identity: str) -> int:
        return self._commit(self._expect(partition, identity, expected), partition=partition, kind="delete")


def delta(held: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows after deletes by row_key and then upserts."""
    gone = deletes.select("row_key").unionByName(upserts.select("row_key"))
    return held.join(gone, "row_key", "left_anti").unionByName(upserts.select(*held.columns))


def reconcile(checkpoints: DataFrame, listed: DataFrame) -> DataFrame:
    """partition, action: skip where identity, revision and cursor are equal, replace, or delete what is not listed."""
    same = ["partition", "source_identity", "revision", "cursor"]
    c, s = checkpoints.select(*same).alias("c"), listed.select(*same).alias("s")
    both = c.join(s, "partition", "full")
    equal = F.forall(F.array(*[F.col(f"c.{x}").eqNullSafe(F.col(f"s.{x}")) for x in same[1:]]), lambda x: x)
    absent = F.col("s.source_identity").isNull()
    return both.select("partition", F.when(absent, "delete").when(equal, "skip").otherwise("replace").alias("action"))


__all__ = ["Checkpoint", "CursorConflict", "PartitionConflict", "StaleView", "StoreError", "ViewStore", "ViewUnavailable", "delta", "reconcile"]
