"""The inverted index of a store: where each term stands in each document, with what ranking and filters need beside it.

A part's postings are dealt to buckets by a checksum of the term, so that a search reads its terms' buckets only, and
sorted by term within, so that it reads few row groups of them. No search touches a body.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import tokens

META = "event_time_unix_ms long, event_type string, surface string, workspace_id string, scope_tokens array<string>"
SCHEMA = f"term string, session_id string, seq long, size int, positions array<int>, {META}"
#: Tokens that one bucket, and one file, of a part holds, about; and the most buckets that a part has.
BUCKET_TOKENS, FILE_TOKENS, MAX_BUCKETS = 1 << 24, 1 << 22, 1024


def bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def buckets_for(n_tokens: int) -> int:
    return min(MAX_BUCKETS, max(1, n_tokens // BUCKET_TOKENS))


def size(tokens_: Column, scope_tokens: Column) -> Column:
    """A document's length counts the tokens of its body and its scope tokens."""
    return F.size(tokens_) + F.coalesce(F.size(scope_tokens), F.lit(0))


def token_count(docs: DataFrame) -> int:
    return docs.agg(F.sum(size(tokens(F.col("body")), F.col("scope_tokens")))).first()[0] or 0


def build(docs: DataFrame) -> DataFrame:
    """A row for each term of each document. A document's tokens meet where the document is, before any shuffle."""
    meta = [c.split()[0] for c in META.split(", ")]
    read = docs.select("session_id", "seq", *meta, tokens(F.coalesce("body", F.lit(""))).alias("t"))
    rows = read.select("session_id", "seq", size(F.col("t"), F.col("scope_tokens")).alias("size"), *meta, F.posexplode("t").alias("pos", "term"))
    held = rows.groupBy("term", "session_id", "seq").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.first(F.struct("size", *meta)).alias("m"))
    return held.select("term", "session_id", "seq", "m.size", "positions", *[f"m.{c}" for c in meta])


def write(docs: DataFrame, path: str, n_tokens: int) -> int:
    """Writes the postings of docs, with n_tokens in all, and gives the number of buckets."""
    n = buckets_for(n_tokens)
    rows = build(docs).withColumn("b", F.crc32(F.encode("term", "UTF-8")) % n)
    order = ("b", "term", "session_id", "seq")  # ranges, for a common term can fill many files
    dealt = rows.repartitionByRange(max(1, -(-n_tokens // FILE_TOKENS)), *order).sortWithinPartitions(*order)
    dealt.write.partitionBy("b").parquet(path)
    return n
