"""Where tables are kept that executors share."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomspark.functions.text import ACCENTED, PLAIN
from loomspark.sources import postings
from loomspark.sources.store import DOCUMENT, ConcurrentCommit, DocumentStore, Files, InvalidSchema, schema_fingerprint

#: Changes when stores of tables are made otherwise than before.
FORMAT = 1


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one if all runs on this machine; on a cluster
    an error, for its executors would not see such a folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="loomspark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of a path's files: their names, sizes and times."""
    files = Files(spark, path)
    return hashlib.sha256("\n".join(sorted(files.states(path))).encode()).hexdigest()[:24]


def stored(spark: SparkSession, name: str, source: str, docs: Callable[[], DataFrame]) -> DocumentStore:
    """A store of what docs gives, which is made from the table at `source`: written at the first call, and anew when the table's
    files change."""
    shape = hashlib.sha256(f"{FORMAT} {postings.SCHEMA} {schema_fingerprint(DOCUMENT)} {ACCENTED} {PLAIN}".encode()).hexdigest()[:8]
    root = f"{shared_folder(spark)}/stores/{name}-{shape}-{state_of(spark, source)}"
    if not Files(spark, root).exists(f"{root}/identity.json"):
        try:
            DocumentStore.create(spark, root)
        except InvalidSchema:  # another process was first
            pass
    store = DocumentStore(spark, root)
    if not store.head()[0]:
        try:
            store.apply_batch(docs().select(*DOCUMENT.names), name, source, 1)
        except ConcurrentCommit:  # so it was here, with the same documents
            pass
    return store
