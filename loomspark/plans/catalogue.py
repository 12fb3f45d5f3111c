"""The registered queries over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import digest, row_key, token_list
from loomspark.operators import cochange
from loomspark.plans import evidence, records, search, verify
from loomspark.plans.search import Filters, Request
from loomspark.sources.tables import conversation_documents, conversation_store, source_store, table, with_tokens
from loomspark.sources.views import delta

LITERALS = ("the", "of the", "in", "la", "de")
REQUEST = Request(LITERALS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(conversation_documents(spark, sf_dir))


def _score(name="score"):
    return F.round(name, 12).alias("score")


def _sources(filters: Filters = Filters(), depth: int = 100):
    def query(spark, sf_dir):
        out = search.sources(conversation_store(spark, sf_dir), Request(LITERALS, depth, 20, filters))
        return out.select("ordinal", "rank", "session_id", "seq", _score())

    return query


def tokenize_stats(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(F.size("tokens")).alias("n_tokens"), F.max(F.size("tokens")).alias("longest")
    )


def corpus_stats(spark, sf_dir):
    return search.corpus_stats(conversation_store(spark, sf_dir)).select("n", F.round("avgdl", 9).alias("avgdl"))


def phrase_tf(spark, sf_dir):
    corpus = search.Scanned(_docs(spark, sf_dir))
    return search.phrase_frequencies(corpus, [token_list(x) for x in LITERALS])


def bm25_single(spark, sf_dir):
    out = search.raw_hits(conversation_store(spark, sf_dir), Request(LITERALS[1:2]))
    return out.select("place", "session_id", "seq", "tf", _score())


def truncation_report(spark, sf_dir):
    return search.truncation(conversation_store(spark, sf_dir), Request(LITERALS, 40))


def rrf_fused(spark, sf_dir):
    return search.fused(conversation_store(spark, sf_dir), REQUEST).select("position", "session_id", F.round("score", 9).alias("score"))


def rrf_contributions(spark, sf_dir):
    out = search.fused(conversation_store(spark, sf_dir), REQUEST).select("session_id", F.explode("parts").alias("x"))
    return out.select("session_id", "x.ordinal", "x.rank")


def view_conversation_search(spark, sf_dir):
    out = search.fused(conversation_store(spark, sf_dir), REQUEST)
    ordinals = F.array_join(F.transform("parts", lambda x: x["ordinal"].cast("string")), ",")
    return out.select("position", "session_id", ordinals.alias("ordinals"), "evidence.rank", "evidence.ordinal", "evidence.seq", "evidence.event_type")


def session_best_top101(spark, sf_dir):
    hits = search.scored(source_store(spark, sf_dir), ("the",))
    best = Window.partitionBy("session_id").orderBy(F.col("score").desc(), F.col("seq").desc())
    top = hits.withColumn("k", F.row_number().over(best)).filter("k = 1")
    top = top.orderBy(F.col("score").desc(), "session_id").limit(101)
    return top.select(F.col("session_id").alias("source"), F.col("event_time_unix_ms").alias("doc_id"), _score())


def session_cursors(spark, sf_dir):
    docs = conversation_documents(spark, sf_dir)
    return docs.groupBy("session_id").agg((F.max("seq") + 1).alias("next_seq"), F.max_by("event_type", "seq").alias("last_type"))


def session_last_update(spark, sf_dir):
    docs = conversation_documents(spark, sf_dir)
    last = F.max("event_time_unix_ms").over(Window.partitionBy("session_id"))
    return docs.select("session_id", "seq", last.alias("session_updated_at_unix_ms"))


def contiguity_check(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("seq")
    gap = F.col("seq") != F.coalesce(F.lag("seq").over(order) + 1, F.lit(0))
    docs = conversation_documents(spark, sf_dir).withColumn("gap", gap)
    return docs.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.col("gap").cast("int")).alias("gaps"))


def _retained(spark, sf_dir):
    return evidence.retained(spark, sf_dir).events


def retained_events(spark, sf_dir):
    return _retained(spark, sf_dir).select("p", F.array_join("paths", " ").alias("paths"))


def pair_support(spark, sf_dir):
    return cochange.pair_support(_retained(spark, sf_dir)).filter(F.col("support") >= cochange.MIN_SHARED)


def _stats(pair_relative):
    def query(spark, sf_dir):
        kept = _retained(spark, sf_dir)
        pairs = cochange.pair_support(kept).filter(F.col("support") >= cochange.MIN_SHARED)
        return cochange.pair_stats(kept, pairs, pair_relative)

    return query


def gated_candidates(spark, sf_dir):
    return cochange.gated(_stats(False)(spark, sf_dir))


def verified_candidates(spark, sf_dir):
    return verify.verified(conversation_store(spark, sf_dir), conversation_documents(spark, sf_dir), REQUEST)


def snippets(spark, sf_dir):
    return verify.with_snippets(conversation_store(spark, sf_dir), conversation_documents(spark, sf_dir), REQUEST)


def shadow_parity(spark, sf_dir):
    """The fused answer of depth 100 against that of depth 40."""
    docs = conversation_store(spark, sf_dir)
    return verify.parity(search.fused(docs, REQUEST), search.fused(docs, Request(LITERALS, 40)), ["session_id"])


def view_after_delta(spark, sf_dir):
    """Assistants' turns go, users' turns are put again with a mark."""
    docs = conversation_documents(spark, sf_dir)
    rows = docs.select(row_key(F.col("session_id"), F.col("seq")).alias("row_key"), "event_type", "body")
    upserts = rows.filter("event_type = 'user/message'").withColumn("body", F.concat(F.lit("again: "), "body"))
    out = delta(rows, upserts, rows.filter("event_type = 'assistant/message'"))
    return out.select("row_key", "event_type", F.sha2("body", 256).alias("body_sha256"))


def document_digests(spark, sf_dir):
    docs = conversation_documents(spark, sf_dir)
    key = row_key(F.col("session_id"), F.col("seq"))
    return docs.select(key.alias("row_key"), "scope", digest(F.col("session_id"), F.col("seq").cast("string"), F.col("body")).alias("fingerprint"))


def latency_percentiles(spark, sf_dir):
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    e = table(spark, sf_dir, "events")
    return e.agg(*[F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY value)").alias(n) for n, p in shares.items()], F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))


def checkpoint_skip(spark, sf_dir):
    """Sessions whose stored cursor differs from the log's: the stored ones lag in every third session."""
    now = session_cursors(spark, sf_dir).select("session_id", "next_seq")
    number = F.substring("session_id", 6, 8).cast("long")
    stored = now.select("session_id", F.when(number % 3 == 0, F.col("next_seq") - 1).otherwise(F.col("next_seq")).alias("next_seq"))
    return now.join(stored, ["session_id", "next_seq"], "left_anti")


FILTERS = {
    "filter_workspace_surface_type": Filters(workspaces=("/ws/1", "/ws/2", "/ws/3"), surfaces=("current",), event_types=("user/message", "assistant/message")),
    "filter_sessions_include_exclude": Filters(include=tuple(f"conv-{i:08d}" for i in range(60)), exclude=("conv-00000003", "conv-00000005")),
    "filter_time_range": Filters(time_from=1_700_000_600_000, time_to=1_700_003_000_000),
    "filter_seq_bounds": Filters(seq_bounds={"conv-00000001": 2, "conv-00000004": 1, "conv-00000009": 3}),
}


def scope_restricted(spark, sf_dir):
    import hashlib

    from loomspark.functions.text import SCOPE_DOMAIN

    scopes = tuple("w" + hashlib.sha256(f"{SCOPE_DOMAIN}\0/ws/{i}".encode()).hexdigest()[:63] for i in (0, 4))
    return _sources(Filters(scopes=scopes))(spark, sf_dir)


def queries():
    plain = (
        tokenize_stats, corpus_stats, phrase_tf, bm25_single, truncation_report, rrf_fused, rrf_contributions,
        scope_restricted, view_conversation_search, session_best_top101, session_cursors, session_last_update,
        contiguity_check, retained_events, pair_support, gated_candidates,
        verified_candidates, snippets, shadow_parity, view_after_delta, document_digests, latency_percentiles, checkpoint_skip,
    )
    found = {f.__name__: f for f in plain} | {"bm25_five_sources": _sources()}
    found |= {"pair_stats_repository_window": _stats(False), "pair_stats_pair_relative": _stats(True)}
    return found | {name: _sources(f) for name, f in FILTERS.items()} | evidence.queries() | records.queries()
