"""Which revisions of a repository count as evidence: the newest that touch a current file worth counting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions.paths import REASONS, Exclusions, exclusion
from loomspark.operators import cochange

#: Revisions that are looked at, files that may be tracked, paths that a revision may touch, bytes of a path.
SCANNED, MAX_TRACKED, MAX_PATHS, MAX_PATH_BYTES = 400, 50_000, 100_000, 4096
OMITTED = ("empty", "no-current-regular-path", "excluded-only", "bulk", "older-after-retention")


class UnsafePath(ValueError):
    """A path that is empty, too long or has a NUL."""


@dataclass(frozen=True)
class Retained:
    """status is ok or abstained, with the reason. events has p and paths, newest first; audit has part, key and n."""

    status: str
    reason: str | None
    events: DataFrame | None
    audit: DataFrame | None


def classified(current: DataFrame, attributes: DataFrame | None = None, rules: Exclusions = Exclusions()) -> DataFrame:
    """path, reason (null: eligible) of the current paths; attributes has path, attribute, value."""
    paths = current.select("path").distinct()
    if attributes is None:
        return paths.select("path", exclusion(F.col("path"), None, rules).alias("reason"))
    maps = attributes.groupBy("path").agg(F.map_from_entries(F.collect_set(F.struct("attribute", "value"))).alias("attributes"))
    return paths.join(maps, "path", "left").select("path", exclusion(F.col("path"), F.col("attributes"), rules).alias("reason"))


def outcomes(known: DataFrame, revisions: DataFrame, bulk: int) -> DataFrame:
    """pos, n_paths, paths (the eligible ones, sorted), touches (a count for each reason and nonCurrent) and outcome of the
    newest SCANNED revisions (pos, paths)."""
    scanned = revisions.select("pos", F.array_distinct("paths").alias("all")).orderBy("pos").limit(SCANNED)
    touched = scanned.select("pos", F.explode_outer("all").alias("path")).join(known.withColumn("current", F.lit(True)), "path", "left")
    there, current = F.col("path").isNotNull(), F.col("current").isNotNull()
    eligible = current & F.col("reason").isNull()
    counts = [F.count_if(there & ~current).alias("nonCurrent"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]]
    found = touched.groupBy("pos").agg(
        F.count("path").alias("n_paths"), F.count_if(current).alias("n_current"),
        F.sort_array(F.collect_list(F.when(eligible, F.col("path")))).alias("paths"), F.struct(*counts).alias("touches"),
    )
    n = F.size("paths")
    reason = F.when(F.col("n_paths") == 0, "empty").when(F.col("n_current") == 0, "no-current-regular-path")
    found = found.withColumn("outcome", reason.when(n == 0, "excluded-only").when(n > bulk, "bulk").otherwise("retained"))
    before = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # over SCANNED rows at most
    kept = F.coalesce(F.count_if(F.col("outcome") == "retained").over(before), F.lit(0))
    return found.withColumn("outcome", F.when(kept >= cochange.RETAINED, "older-after-retention").otherwise(F.col("outcome"))).drop("n_current")


def retain_eligible(current: DataFrame, revisions: DataFrame, attributes: DataFrame | None = None, rules: Exclusions = Exclusions()) -> Retained:
    """The newest eligible events of the revisions, and what became of all others.

    To the driver go a few counts. Abstains, rather than answer in part, where more files are tracked than MAX_TRACKED or
    a revision that was looked at touches more than MAX_PATHS. Raises UnsafePath for a path outside its bounds.
    """
    spark = current.sparkSession
    known = classified(current, attributes, rules).persist()
    unsafe = (F.octet_length("path") > MAX_PATH_BYTES) | (F.col("path") == "") | (F.instr("path", "\0") > 0)
    total, eligible, wrong, *excluded = known.agg(
        F.count("*"), F.count_if(F.col("reason").isNull()), F.count_if(unsafe), *[F.count_if(F.col("reason") == r) for r in REASONS]
    ).first()
    if total > MAX_TRACKED:
        return Retained("abstained", "tracked-file-limit", None, None)
    if wrong:
        raise UnsafePath("a tracked path")
    bulk = cochange.bulk_limit(eligible)
    found = outcomes(known, revisions, bulk).persist()  # SCANNED rows at most
    looked = found.filter("outcome <> 'older-after-retention'")
    touched = ["nonCurrent", *REASONS]
    sums = looked.agg(
        F.max("n_paths"), F.sum("n_paths"), *[F.sum(f"touches.`{k}`") for k in touched]
    ).first()
    if (sums[0] or 0) > MAX_PATHS:
        return Retained("abstained", "diff-path-limit", None, None)
    of = {r["outcome"]: r["count"] for r in found.groupBy("outcome").count().collect()}
    scanned, kept = sum(of.values()), of.get("retained", 0)
    rows = [("summary", k, v) for k, v in (
        ("revisionsScanned", scanned), ("scanLimitReached", int(scanned == SCANNED)), ("retentionLimitReached", int(kept == cochange.RETAINED)),
        ("retainedEligibleDiffs", kept), ("changedPathsExamined", sums[1] or 0), ("bulkPathLimit", bulk), ("trackedRegularFiles", total), ("eligibleCurrentFiles", eligible),
    )]
    rows += [("excludedCurrentFiles", r, n) for r, n in zip(REASONS, excluded, strict=True)]
    rows += [("excludedPathTouches", k, n or 0) for k, n in zip(touched, sums[2:], strict=True)]
    rows += [("omittedDiffs", k, of.get(k, 0)) for k in OMITTED]
    events = found.filter("outcome = 'retained'").orderBy("pos").select("paths").collect()  # RETAINED rows of at most 100 paths
    known.unpersist()
    found.unpersist()
    audit = spark.createDataFrame(rows, "part string, key string, n long")
    return Retained("ok", None, spark.createDataFrame([(i, r.paths) for i, r in enumerate(events)], "p long, paths array<string>"), audit)


def analyze(current: DataFrame, revisions: DataFrame, attributes: DataFrame | None = None, rules: Exclusions = Exclusions()) -> dict:
    """What is retained, and the candidates of both selectors over it."""
    kept = retain_eligible(current, revisions, attributes, rules)
    if kept.status != "ok":
        return {"status": kept.status, "reason": kept.reason, "selectors": {}}
    selectors = {name: cochange.select_candidates(kept.events, mode) for name, mode in cochange.MODES.items()}
    return {"status": "ok", "history": {(r["part"], r["key"]): r["n"] for r in kept.audit.collect()}, "selectors": selectors}
