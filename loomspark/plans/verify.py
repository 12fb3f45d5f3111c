"""Exact checks of fused search results against the authoritative documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.snippets import snippets
from loomspark.functions.text import single_spaced
from loomspark.plans import search

#: Documents that one request may have checked.
POINTERS = 256


def pointers(docs: search.Corpora, request: search.Request) -> DataFrame:
    """The hits behind the fused sessions, one row for each contribution; the first POINTERS by ordinal and rank are asked
    for. A contribution and its hit are the same session, ordinal and rank. The request's limit and number of literals bound
    the rows."""
    found = search.find(docs, request)
    position = {r[0]: r[4] for r in search.fuse(found)}
    rows = []
    for ordinal, hits in enumerate(found.ranked):
        for rank, r in enumerate(hits, 1):
            if r["session_id"] in position:
                asked = len(rows) < POINTERS
                rows.append((position[r["session_id"]], r["session_id"], ordinal, rank, r["seq"], r["event_type"], r["surface"], r["event_time_unix_ms"], asked))
    names = "position int, session_id string, ordinal int, rank int, seq long, event_type string, surface string, event_time_unix_ms long, asked boolean"
    return found.spark.createDataFrame(rows, names)


def quoted(literal: str) -> str:
    """A pattern that matches the literal, with single white space, without regard to case."""
    return "(?iu)\\Q" + " ".join(literal.split()).replace("\\E", "\\E\\\\E\\Q") + "\\E"


def checked(docs: search.Corpora, authority: DataFrame, request: search.Request) -> DataFrame:
    """pointers with `body` and `ok`: the document is there, of the type, surface and time that the index has, on an
    allowed surface, and has the literal. A pointer that was not asked for is not ok."""
    keys = ["session_id", "seq"]
    known = authority.select(*keys, F.col("event_type").alias("t"), F.col("surface").alias("s"), F.col("event_time_unix_ms").alias("at"), "body")
    asked = pointers(docs, request)
    found = known.join(F.broadcast(asked.select(*keys).distinct()), keys, "left_semi")  # a hundred rows a literal at most
    rows = asked.join(F.broadcast(found), keys, "left")
    literal = F.element_at(F.array(*[F.lit(x) for x in request.literals]), F.col("ordinal") + 1)
    surface = F.col("surface").isin(*request.filters.surfaces) if request.filters.surfaces else F.lit(True)
    body, has = single_spaced(F.col("body")), F.lit(False)
    for i, x in enumerate(request.literals):
        has = F.when(F.col("ordinal") == i, body.rlike(quoted(x))).otherwise(has)
    same = (F.col("t") == F.col("event_type")) & (F.col("s") == F.col("surface")) & (F.col("at") == F.col("event_time_unix_ms"))
    return rows.withColumn("literal", literal).withColumn("ok", F.coalesce(F.col("asked") & surface & same & has, F.lit(False)))


def verified(docs: search.Corpora, authority: DataFrame, request: search.Request) -> DataFrame:
    """position, session_id, evidence (different documents) of the sessions all of whose contributions hold."""
    rows = checked(docs, authority, request)
    out = rows.groupBy("position", "session_id").agg(F.bool_and("ok").alias("ok"), F.count_distinct("seq").alias("evidence"))
    return out.filter("ok").drop("ok")


def with_snippets(docs: search.Corpora, authority: DataFrame, request: search.Request) -> DataFrame:
    return checked(docs, authority, request).filter("ok").select("position", "session_id", "ordinal", "seq", snippets(F.col("body"), F.col("literal")).alias("snippet"))


def parity(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """position, equal: whether two ordered answers have the same row there."""
    x, y = left.select("position", *columns).alias("x"), right.select("position", *columns).alias("y")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in columns]
    return x.join(y, "position", "full").select("position", F.forall(F.array(*same), lambda b: b).alias("equal"))
