"""What the operators share: column picking, shared-folder tables, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.sources.folders import shared_folder

#: Entries that a worker's word caches hold before they start anew.
CACHE_WORDS = 300_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns under new names. Others go, so that no name of theirs, in any case, can clash."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(old)}").alias(new) for new, old in columns.items()])


def pick_row(df: DataFrame, **columns: str) -> DataFrame:
    """As pick, with the whole row beside them as the struct `_row`, whose fields are `_0`, `_1` and so on."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    row = F.struct(*[F.col(c) for c in flat.columns]).alias("_row")
    return flat.select(*[F.col(f"_{df.columns.index(old)}").alias(new) for new, old in columns.items()], row)


def unrow(df: DataFrame, names: list[str], **replaced: str) -> DataFrame:
    """The rows that pick_row kept, under their names; `replaced` maps a name to the column that takes its place."""
    return df.select(
        *[F.col(replaced[n]).alias(n) if n in replaced else F.col(f"_row._{i}").alias(n) for i, n in enumerate(names)]
    )


def small_batches(spark: SparkSession) -> None:
    """Keeps what one Arrow batch holds small, for texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


class Workspace:
    """Tables in the shared folder, which cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tables = spark, []
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        path = f"{self.root}/{table}"
        self.tables.append(table)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        del df
        return self.spark.read.schema(self.spark.read.parquet(path).schema).parquet(path)

    def drop(self, *tables: str) -> None:
        """Deletes tables that nothing reads any more and lets go of shuffle files of finished jobs."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            path.getFileSystem(conf).delete(path, True)
        self.tables = [t for t in self.tables if t not in tables]
        release(self.spark)

    def keep(self, *tables: str) -> None:
        """Deletes all other tables."""
        self.drop(*[t for t in self.tables if t not in tables])


def release(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM finds their plans unreachable; ask it to look now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class WordHash(dict):
    """64-bit hashes of words, a bounded number of them kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORD_HASH = WordHash()


def trim() -> None:
    """Gives memory back to the system that this process no longer uses; the word cache starts anew."""
    WORD_HASH.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def trimmed(run):
    """The same function over batches, which trims at its end: workers wait for later tasks and stages beside the JVM."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * M1
    h = h ^ (h >> np.uint64(29))
    h = h * M2
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order; of the whole sequence when it is shorter, of nothing when empty."""
    n = len(words)
    k = min(k, n)
    if not n:
        return words
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = mix(h * M3 + words[i : n - k + 1 + i])
    return h
