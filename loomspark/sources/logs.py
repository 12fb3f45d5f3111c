"""Session logs as documents: both shapes of a log, their listing, and what of them enters the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import bounded, canonical_digest, event_time, first_string, scope_token, unsigned

#: Sessions of a listing; bytes of ids, workspaces, types, surfaces and bodies.
MAX_SESSIONS = 100_000
BYTES = {"session_id": (1, 128), "workspace_id": (1, 4096), "event_type": (1, 96), "surface": (1, 64), "body": (0, 1 << 20)}

_EVENT = (
    "struct<seq:string,sequence:string,eventType:string,type:string,surface:string,text:string,eventTimeUnixMs:string,timeUnixMs:string,"
    "time:string,timestamp:string,event:struct<seq:string,sequence:string,eventType:string,type:string,surface:string,"
    "eventTimeUnixMs:string,timeUnixMs:string,timestamp:string>>"
)
#: A log is of the production shape if it has a session and events, else of the generated one.
LOG = (
    f"session struct<id:string,createdAt:string,cwd:string>, events array<{_EVENT}>, records array<{_EVENT}>, workspaceId string, "
    "workspace struct<id:string>, header struct<workspaceId:string>"
)


class LogError(ValueError):
    """A log or listing outside its contract."""


def listing(sessions: DataFrame, most: int = MAX_SESSIONS) -> DataFrame:
    """The session ids of a listing (session_id). Refused if there are too many, one is there twice, or one is out of
    bounds."""
    n, wrong, distinct = sessions.agg(F.count("*"), F.count_if(~bounded(F.col("session_id"), *BYTES["session_id"])), F.count_distinct("session_id")).first()
    if n > most or wrong or distinct < n:
        raise LogError(f"{n} sessions, {wrong} ids out of bounds, {n - wrong - distinct} there twice")
    return sessions.select("session_id")


def records(logs: DataFrame) -> DataFrame:
    """session_id, workspace_id, place, seq, event_time_unix_ms, event_type, surface, text and wrong of each event of the logs
    (session_id, log as JSON). A session without a usable workspace drops out."""
    parsed = logs.select("session_id", F.from_json("log", LOG, {"mode": "PERMISSIVE"}).alias("l"))
    production = F.col("l.session").isNotNull() & F.col("l.events").isNotNull()
    rooted = F.when(F.col("l.session.cwd").startswith("/") & (F.instr("l.session.cwd", "\0") == 0), F.col("l.session.cwd"))
    named = F.nullif(first_string(F.col("l.workspaceId"), F.col("l.workspace.id"), F.col("l.header.workspaceId")), F.lit(""))
    flat = parsed.select(
        "session_id", F.when(production, rooted).otherwise(named).alias("workspace_id"),
        (production & (F.col("l.session.id") != F.col("session_id"))).alias("foreign"),
        F.when(production, F.col("l.events")).otherwise(F.col("l.records")).alias("events"),
    ).filter("workspace_id IS NOT NULL")
    e = flat.select("session_id", "workspace_id", "foreign", F.posexplode("events").alias("place", "e"))
    times = [F.col(f"e.{c}") for c in ("eventTimeUnixMs", "timeUnixMs", "time", "event.eventTimeUnixMs", "event.timeUnixMs", "timestamp", "event.timestamp")]
    out = e.select(
        "session_id", "workspace_id", "place", "foreign",
        unsigned(F.coalesce("e.seq", "e.sequence", "e.event.seq", "e.event.sequence")).alias("seq"),
        event_time(*times).alias("event_time_unix_ms"),
        first_string(F.col("e.eventType"), F.col("e.event.eventType"), F.col("e.event.type"), F.col("e.type")).alias("event_type"),
        first_string(F.col("e.surface"), F.col("e.event.surface")).alias("surface"), F.col("e.text").alias("text"),
    )
    bad = F.col("foreign") | F.col("event_time_unix_ms").isNull() | ~F.col("seq").eqNullSafe(F.col("place").cast("long"))
    for c in ("session_id", "workspace_id", "event_type", "surface"):
        bad = bad | ~bounded(F.col(c), *BYTES[c])
    return out.withColumn("wrong", bad).drop("foreign")


def project(logs: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Documents of the logs: one for each event, with the text that `semantic` (session_id, seq, text) has for it, or an empty
    body. Refused if an event is out of its contract, or a semantic text is there twice or has no event."""
    events = records(logs)
    wrong = events.filter("wrong").select("session_id", "place").first()
    if wrong:
        raise LogError(f"event {wrong.place} of session {wrong.session_id}")
    if semantic is None:
        joined = events.withColumn("body", F.coalesce("text", F.lit("")))
    else:
        texts = semantic.select("session_id", "seq", F.col("text").alias("body"))
        keys = ["session_id", "seq"]
        twice = texts.groupBy(*keys).count().filter("count > 1").select(*keys)
        alone = texts.join(events.select("session_id").distinct(), "session_id", "left_semi").join(events.select(*keys), keys, "left_anti").select(*keys)
        if twice.unionByName(alone).first():
            raise LogError("semantic texts must name each event once")
        joined = events.join(texts, keys, "left").withColumn("body", F.coalesce("body", F.lit("")))
    if joined.filter(~bounded(F.col("body"), *BYTES["body"])).limit(1).count():
        raise LogError("a body is out of bounds")
    fields = [F.col(c) for c in ("session_id", "seq", "event_time_unix_ms", "event_type", "surface", "workspace_id", "body")]
    return joined.select(
        *fields[:6], F.array(scope_token(F.col("workspace_id"))).alias("scope_tokens"), "body",
        F.concat(F.lit("sha256:"), canonical_digest("loomspark/event/v1", *fields)).alias("fingerprint"),
        F.concat(F.lit("sha256:"), canonical_digest("loomspark/revision/v1", *fields)).alias("source_revision"),
    )
