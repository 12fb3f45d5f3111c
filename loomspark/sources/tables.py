"""Tables as the logs that the plans read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import canonical_digest, scope_token, tokens
from loomspark.sources.folders import stored
from loomspark.sources.store import DocumentStore


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One projected document for each turn: a session, its sequence number, and the metadata that filters read."""
    c = table(spark, sf_dir, "conversations")
    workspace = F.concat(F.lit("/ws/"), (F.col("conv_id") % 7).cast("string"))
    return c.select(
        F.concat(F.lit("conv-"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("session_id"),
        F.col("turn").alias("seq"),
        F.concat("role", F.lit("/message")).alias("event_type"),
        F.when(F.col("role") == "system", "log-only").otherwise("current").alias("surface"),
        workspace.alias("workspace_id"),
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("event_time_unix_ms"),
        F.coalesce("text", F.lit("")).alias("body"),
        scope_token(workspace).alias("scope"),
        F.array(scope_token(workspace)).alias("scope_tokens"),
    )


def log_documents(docs: DataFrame) -> DataFrame:
    """conversation_documents with what a store has beside: digests of content and source."""
    parts = [F.col(c) for c in ("session_id", "seq", "event_time_unix_ms", "event_type", "surface", "workspace_id", "body")]
    return docs.select(
        *parts, F.col("scope_tokens"), canonical_digest("loomspark/event/v1", *parts).alias("fingerprint"),
        canonical_digest("loomspark/revision/v1", *parts).alias("source_revision"),
    )


def conversation_store(spark: SparkSession, sf_dir: str) -> DocumentStore:
    return stored(spark, "conversations", f"{sf_dir}/conversations.parquet", lambda: log_documents(conversation_documents(spark, sf_dir)))


def source_store(spark: SparkSession, sf_dir: str) -> DocumentStore:
    """The documents of each source as a session, in the order of their ids, which are the event times; no scope tokens."""

    def docs() -> DataFrame:
        session = F.coalesce("source", F.lit("none"))
        seq = F.row_number().over(Window.partitionBy(session).orderBy("doc_id")) - 1
        return table(spark, sf_dir, "documents").select(
            session.alias("session_id"), seq.alias("seq"), F.col("doc_id").alias("event_time_unix_ms"), F.lit("document").alias("event_type"),
            F.lit("current").alias("surface"), F.lit("/documents").alias("workspace_id"), F.array().cast("array<string>").alias("scope_tokens"),
            F.coalesce("text", F.lit("")).alias("body"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.lit("r").alias("source_revision"),
        )

    return stored(spark, "documents", f"{sf_dir}/documents.parquet", docs)


def with_tokens(docs: DataFrame, body: str = "body") -> DataFrame:
    return docs.withColumn("tokens", tokens(F.col(body)))
