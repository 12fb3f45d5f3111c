"""Queries of stores, views, logs and scalar functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as X
from loomspark.functions.snippets import clips
from loomspark.plans import views
from loomspark.sources import logs
from loomspark.sources.folders import shared_folder, state_of
from loomspark.sources.store import DOCUMENT
from loomspark.sources.tables import conversation_documents, conversation_store, log_documents, table
from loomspark.sources.views import Checkpoint, reconcile
from loomspark.streaming import ingest

SCOPES = 3


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, scope = F.col("o_orderkey"), F.concat(F.lit("w"), (F.col("o_custkey") % SCOPES).cast("string"))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), key.cast("string")).alias("row_key"), F.col("o_orderstatus").alias("exact_key"), (key % 5000).alias("ordinal"),
        scope.alias("workspace_scope_token"), F.col("o_orderpriority").alias("value"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> views.Registry:
    """Orders by status as partitions of a view, written at the first call for the table's files."""
    source = f"{sf_dir}/orders.parquet"
    found = views.Registry(spark, f"{shared_folder(spark)}/views/orders-{state_of(spark, source)}", [views.ExactRange(), views.Conversation()])
    store = found.store("exact-range")
    if store.status()["state"] != "ready":
        for i, status in enumerate(("F", "O", "P")):
            store.replace_partition(status, _orders(spark, sf_dir).filter(F.col("exact_key") == status), Checkpoint("orders", f"r{i}", i, f"f{i}", 10 * i))
        store.set_state("ready")
    return found


def exact_range(spark, sf_dir):
    authority = views.Authority(("w0", "w2"))
    params = {"exact_key": "O", "minimum": 100, "maximum": 4000, "limit": 32}
    return _registry(spark, sf_dir).query(views.Query("exact-range", 1, "exact-range", params, authority, 60_000)).rows


def view_status(spark, sf_dir):
    now = _registry(spark, sf_dir).store("exact-range").status()
    return spark.createDataFrame([(now["state"], now["fence"], now["lag_ms"])], "state string, fence string, lag_ms long")


def view_checkpoints(spark, sf_dir):
    rows = _registry(spark, sf_dir).store("exact-range").checkpoints(["F", "P", "none"])
    return rows.select("partition", "source_identity", "revision", "cursor", "fence", "lag_ms")


def view_partition_rows(spark, sf_dir):
    rows = _registry(spark, sf_dir).store("exact-range").rows()
    return rows.groupBy(F.col("_partition").alias("partition")).agg(F.count("*").alias("n"), F.sum("ordinal").alias("ordinals"))


def view_reconcile(spark, sf_dir):
    """What is there against a listing in which P moved on, F is gone and X is new."""
    listed = spark.createDataFrame([("O", "orders", "r1", 1), ("P", "orders", "r3", 3), ("X", "orders", "r0", 0)], "partition string, source_identity string, revision string, cursor long")
    return reconcile(_registry(spark, sf_dir).store("exact-range").checkpoints(), listed)


def view_session_search(spark, sf_dir):
    """Literals over the view's rows, with the authority of two workspaces and the turns of users only."""
    docs = log_documents(conversation_documents(spark, sf_dir))
    rows = views.conversation_rows(docs)
    params = {"literals": ["the", "of the", "in"], "limit": 30, "event_types": ["user/message"], "after_unix_ms": 1_700_000_000_000}
    out = views.Conversation().execute(rows, "literal-session-search", params, views.Authority.of(["/ws/1", "/ws/2", "/ws/1"]))
    ordinals = F.array_join(F.transform("ordinals", lambda x: x.cast("string")), ",")
    return out.select("rank", "session_id", F.round("score", 9).alias("score"), ordinals.alias("ordinals"), "updated", "evidence.seq", "truncated")


def store_cursors(spark, sf_dir):
    return conversation_store(spark, sf_dir).sessions().select("session_id", "workspace_id", "next_seq")


def store_source_state(spark, sf_dir):
    return conversation_store(spark, sf_dir).source_state([f"conv-{i:08d}" for i in (1, 3, 5, 10**7)]).select("session_id", "next_seq", "workspace_id")


def store_documents(spark, sf_dir):
    docs = conversation_store(spark, sf_dir).documents()
    key = X.document_key(F.col("session_id"), F.col("seq"), F.sha2("body", 256))
    return docs.select("session_id", "seq", key.alias("key"), F.array_join("scope_tokens", " ").alias("scopes"))


def store_head(spark, sf_dir):
    store = conversation_store(spark, sf_dir)
    n, n_tokens = store.stats()
    return spark.createDataFrame([(*store.head(), n, n_tokens)], "generation long, watermark long, documents long, tokens long")


def store_postings(spark, sf_dir):
    rows = conversation_store(spark, sf_dir).postings(["the", "la"])
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"), F.sum("size").alias("sizes"))


def sync_status(spark, sf_dir):
    """Logs against the store's cursors; every fifth log lost its end, every seventh session moved to another workspace, every
    eleventh has a turn more."""
    docs = conversation_documents(spark, sf_dir).select("session_id", "seq", "workspace_id")
    i = F.substring("session_id", 6, 8).cast("long")
    docs = docs.filter((i % 5 != 0) | (F.col("seq") != 0)).withColumn("workspace_id", F.when(i % 7 == 0, "/moved").otherwise(F.col("workspace_id")))
    docs = docs.unionByName(docs.filter((i % 11 == 0) & (F.col("seq") == 1)).withColumn("seq", F.lit(1000).cast(docs.schema["seq"].dataType)))
    return ingest.compared(docs, conversation_store(spark, sf_dir).sessions())


def replay_delta(spark, sf_dir):
    """What is past the cursors when the store has two turns of each session."""
    docs = conversation_documents(spark, sf_dir)
    cursors = docs.groupBy("session_id").agg(F.least(F.count("*"), F.lit(2)).alias("next_seq"))
    return ingest.suffix(docs, cursors).select("session_id", "seq")


def batch_chunks(spark, sf_dir):
    docs = log_documents(conversation_documents(spark, sf_dir)).withColumn("seq", F.col("seq").cast("long")).select(*DOCUMENT.names)
    return ingest.chunked(docs, 3, 100_000)


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations in the production shape, odd ones in the generated one."""
    c = table(spark, sf_dir, "conversations")
    session = F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 8, "0"))
    i = F.col("turn").cast("string")
    event = F.struct(F.col("turn"), i.alias("seq"), F.concat("role", F.lit("/message")).alias("type"), F.lit("current").alias("surface"), (F.lit(1_700_000_000_000) + F.col("turn")).alias("time"))
    events = F.sort_array(F.collect_list(event))
    one = F.to_json(F.struct(F.struct(F.first("session_id").alias("id"), F.concat(F.lit("/ws/"), (F.first("conv_id") % 7).cast("string")).alias("cwd")).alias("session"), events.alias("events")))
    two = F.to_json(F.struct(F.concat(F.lit("g"), (F.first("conv_id") % 3).cast("string")).alias("workspaceId"), events.alias("records")))
    return c.withColumn("session_id", session).groupBy("session_id").agg(F.when(F.first("conv_id") % 2 == 0, one).otherwise(two).alias("log"))


def log_projection(spark, sf_dir):
    """Turns that are no system's have a semantic text."""
    docs = conversation_documents(spark, sf_dir)
    semantic = docs.filter("event_type <> 'system/message'").select("session_id", F.col("seq").cast("long").alias("seq"), F.col("body").alias("text"))
    out = logs.project(_logs(spark, sf_dir), semantic)
    return out.select("session_id", "seq", "event_time_unix_ms", "event_type", "surface", "workspace_id", F.sha2("body", 256).alias("body_sha256"))


def corpus_listing(spark, sf_dir):
    ids = conversation_documents(spark, sf_dir).select("session_id").distinct()
    return logs.listing(ids)


def coerced_times(spark, sf_dir):
    c = conversation_documents(spark, sf_dir)
    at, i = F.col("event_time_unix_ms"), F.substring("session_id", 6, 8).cast("long") % 4
    iso = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    first = F.when(i == 0, at.cast("string")).when(i == 1, iso).when(i == 2, F.lit("soon"))
    other = F.date_format(F.timestamp_millis(at), "yyyy-MM-dd")
    return c.select("session_id", "seq", X.event_time(first, other).alias("at"))


def parsed_numbers(spark, sf_dir):
    i = F.col("page_id").cast("string")
    forms = F.array(i, F.concat(F.lit("0"), i), F.concat(F.lit("-"), i), F.concat(i, F.lit("99999999999999999999")), F.lit(None).cast("string"), F.lit("0"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.posexplode(forms).alias("k", "form"))
    return pages.select("page_id", "k", X.unsigned(F.col("form")).alias("value"))


def text_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    return p.select(
        "page_id", X.json_string(F.concat(F.lit('q"'), "url", F.lit("\\"))).alias("quoted"), X.error_field(F.col("url"), "none").alias("field"),
        X.code_point_prefix(F.concat(F.lit("é😀"), "url"), 5).alias("prefix"), X.bounded(F.col("url"), 1, 40).alias("fits"),
        X.single_spaced(F.concat(F.lit("  a   "), "url", F.lit(" \n"))).alias("spaced"),
    )


def canonical_digests(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", X.canonical_digest("loomspark/test/v1", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).alias("digest"))


def prefix_clips(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", clips(F.col("text")).alias("clip"))


def queries():
    plain = (
        exact_range, view_status, view_checkpoints, view_partition_rows, view_reconcile, view_session_search, store_cursors, store_source_state,
        store_documents, store_head, store_postings, sync_status, replay_delta, batch_chunks, log_projection, corpus_listing, coerced_times,
        parsed_numbers, text_fields, canonical_digests, prefix_clips,
    )
    return {f.__name__: f for f in plain}
