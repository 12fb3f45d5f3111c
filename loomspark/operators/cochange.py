"""Co-change evidence: which paths change together, from revision events in newest-first order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

#: Events kept, those of a pair that count in its own mode, and the gates as (numerator, denominator).
RETAINED, PAIR_EVENTS, MIN_OPPORTUNITIES, MIN_SHARED = 200, 24, 12, 6
ACCOMPANIMENT, OVERLAP = (3, 5), (3, 10)
#: Pairs that a selector gives, annotations, and by how many shared events the best must lead.
SELECTED, ANNOTATIONS, LEAD = 4, 2, 2


#: Pairs within events beyond which no answer is given.
MAX_OBSERVATIONS = 250_000
#: Selectors by whether a pair's opportunities are its own newest events or all that are retained.
MODES = {"pair-relative-v1": True, "repository-window-v1": False}


def bulk_limit(eligible: int) -> int:
    """Eligible paths beyond which a revision is a bulk change."""
    return min(100, max(20, eligible // 5))


def parent(path):
    return F.coalesce(F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def pair_support(retained: DataFrame) -> DataFrame:
    """a < b of different parents, and in how many events both are."""
    one = retained.select("p", F.explode("paths").alias("a"))
    other = retained.select("p", F.explode("paths").alias("b"))
    pairs = one.join(other, "p").filter((F.col("a") < F.col("b")) & (parent(F.col("a")) != parent(F.col("b"))))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("support"))


def pair_stats(retained: DataFrame, pairs: DataFrame, pair_relative: bool) -> DataFrame:
    """left, right, shared, opportunities (events with a or b) and how many shared ones each third of them has."""
    events = retained.select("p", F.explode("paths").alias("path"))
    touched = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("path")).join(events, "path")
    seen = touched.groupBy("a", "b", "p").agg(
        F.max((F.col("path") == F.col("a")).cast("int")).alias("l"), F.max((F.col("path") == F.col("b")).cast("int")).alias("r")
    )
    newest = Window.partitionBy("a", "b").orderBy("p")
    if pair_relative:
        seen = seen.withColumn("p", F.row_number().over(newest) - 1).filter(F.col("p") < PAIR_EVENTS)
        seen = seen.withColumn("n", F.count("*").over(Window.partitionBy("a", "b")))
    else:
        seen = seen.crossJoin(F.broadcast(retained.agg(F.count("*").alias("n"))))
    band = F.when(F.col("p") < F.floor(F.col("n") / 3), 0).when(F.col("p") < F.floor(2 * F.col("n") / 3), 1).otherwise(2)
    both = F.col("l") * F.col("r")
    return seen.groupBy("a", "b").agg(
        F.sum("l").alias("left"), F.sum("r").alias("right"), F.sum(both).alias("shared"), F.count("*").alias("opportunities"),
        *[F.sum(F.when(band == i, both).otherwise(0)).alias(f"band{i}") for i in range(3)],
    )


def gated(stats: DataFrame) -> DataFrame:
    """Pairs that pass all gates; fractions are compared in whole numbers."""
    u, c, low = F.col("opportunities"), F.col("shared"), F.least("left", "right")
    return stats.filter(
        (u >= MIN_OPPORTUNITIES) & (c >= MIN_SHARED) & (c * ACCOMPANIMENT[1] >= low * ACCOMPANIMENT[0])
        & (c * OVERLAP[1] >= u * OVERLAP[0]) & (F.col("band0") > 0) & (F.col("band1") > 0) & (F.col("band2") > 0)
    )


def _order() -> list:
    """Best first: support, overlap (shared of opportunities), accompaniment (shared of the rarer path's events), paths.
    Quotients of whole numbers as small as these are equal only if the fractions are."""
    overlap = F.col("shared") / F.col("opportunities")
    company = F.col("shared") / F.least("left", "right")
    return [F.col("support").desc(), overlap.desc(), company.desc(), F.col("a"), F.col("b")]


def ordered(candidates: DataFrame) -> list[Row]:
    """Gated pairs, best first, of a list that is small."""
    return candidates.orderBy(*_order()).collect()


def selected(candidates: DataFrame) -> list[Row]:
    """The first pairs in order, SELECTED at most, that use no path twice. Each step fetches the best pair without the
    paths used so far."""
    out, used = [], set()
    while len(out) < SELECTED:
        left = candidates.filter(~F.col("a").isin(*used) & ~F.col("b").isin(*used)) if used else candidates
        row = left.orderBy(*_order()).limit(1).collect()
        if not row:
            break
        out += row
        used |= {row[0].a, row[0].b}
    return out


def select_candidates(events: DataFrame, pair_relative: bool) -> dict:
    """status, reason, observations (pairs within events), qualified (gated pairs) and candidates, over retained events
    (p, paths). Abstains above MAX_OBSERVATIONS."""
    support = pair_support(events).persist()
    n = support.agg(F.sum("support")).first()[0] or 0
    if n > MAX_OBSERVATIONS:
        return {"status": "abstained", "reason": "pair-observation-limit", "observations": MAX_OBSERVATIONS + 1, "qualified": 0, "candidates": []}
    often = support.filter(F.col("support") >= MIN_SHARED)
    found = gated(pair_stats(events, often, pair_relative)).join(often, ["a", "b"]).persist()
    out = {"status": "ok", "reason": None, "observations": n, "qualified": found.count(), "candidates": selected(found)}
    found.unpersist()
    support.unpersist()
    return out


def annotations(routes: list[tuple[str, bool]], candidates: DataFrame) -> list[tuple[str, str]]:
    """(route, companion) for the first routes, ANNOTATIONS at most, that stand by themselves and whose best candidate
    leads the next by LEAD events or has none beside it. No path is used twice."""
    names = [r for r, _ in routes]
    best, out, used = ordered(candidates.filter(F.col("a").isin(*names) | F.col("b").isin(*names))), [], set()
    for route, justified in routes:
        if len(out) == ANNOTATIONS:
            break
        found = [(r.support, r.b if r.a == route else r.a) for r in best if route in (r.a, r.b)]
        if not justified or route in used or not found or (len(found) > 1 and found[0][0] - found[1][0] < LEAD):
            continue
        companion = found[0][1]
        if companion not in used:
            out.append((route, companion))
            used |= {route, companion}
    return out
