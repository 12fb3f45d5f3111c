"""Mixing sources to target weights by hash thresholds over histograms, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import Workspace, partitions, pick_row, unrow

#: Rows of the per-source table that may be broadcast; beyond that it is joined by shuffle, salted.
BROADCAST_SOURCES = 20_000
SALTS = 32
#: Hash bits that one histogram resolves, and all bits of the hash. The first histogram has 2**12 buckets a source.
STEP, BITS = 12, 60


@dataclass(frozen=True)
class MixSpec:
    weights: tuple[int, ...] = (5, 2, 1)  # repeated over the sources in code-point order, null last
    share: float = 1.5  # of all sizes
    most: int = 2  # times its source's size that a target may reach
    seed: str = ""


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, seed: str = "") -> Column:
    """60 bits of the MD5 of the id, which other engines compute alike. A null id counts as an empty one."""
    text = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ranked_sources(sizes: DataFrame, work: Workspace) -> DataFrame:
    """Adds rank, the place of each source in code-point order with null last: a range sort and one offset a range."""
    n = partitions(sizes.sparkSession)
    dealt = sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("p", F.spark_partition_id())
    dealt = work.save(dealt, "ranges")
    counts = dict(dealt.groupBy("p").count().collect())  # a number for each of n ranges
    before, offsets = 0, {}
    for p in sorted(counts):
        offsets[p], before = before, before + counts[p]
    order = Window.partitionBy("p").orderBy(F.col("source").asc_nulls_last())
    if not offsets:
        return dealt.withColumn("rank", F.lit(0).cast("long")).drop("p")
    base = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair])[F.col("p")]
    return dealt.withColumn("rank", base + F.row_number().over(order) - 1).drop("p")


def water_fill(ranked: DataFrame, spec: MixSpec) -> DataFrame:
    """Adds target: shares by weight; those above their cap stop there and the excess is dealt out anew by weight.

    Each pass is one aggregate of a few numbers; passes end when none is above its cap.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in spec.weights]), (F.col("rank") % len(spec.weights) + 1).cast("int"))
    rows = ranked.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * spec.most)
    total = spec.share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    left, weight, level = total, None, -1.0
    while True:
        free = F.col("cap") > F.lit(level) * F.col("w") if level >= 0 else F.lit(True)
        held, weight = rows.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("w")))).first()
        left = total - (held or 0.0)
        if not weight:
            return rows.withColumn("target", F.col("cap")).drop("w", "cap")
        new = left / weight
        if new <= level:
            break
        level = new
    share = F.lit(left) * F.col("w") / F.lit(weight)
    return rows.withColumn("target", F.when(free, F.least(share, F.col("cap"))).otherwise(F.col("cap"))).drop("w", "cap")


def _with_sources(rows: DataFrame, table: DataFrame, n_sources: int) -> DataFrame:
    """Joins the per-source table: broadcast below a checked number of rows, else by source and salt."""
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), rows.source.eqNullSafe(table.source), "left").drop(table.source)
    dealt = table.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    rows = rows.withColumn("salt", F.col("h") % SALTS)
    on = rows.source.eqNullSafe(dealt.source) & (rows.salt == dealt.salt)
    return rows.join(dealt, on, "left").drop(dealt.source, dealt.salt).drop("salt")


def mix_sources(
    docs: DataFrame, doc_id="doc_id", text="text", source="source", spec: MixSpec = MixSpec(), rows: bool = True
) -> DataFrame:
    """The columns doc_id, source, size, source_size, target, taken and copies, with `rows` beside those of docs as the
    struct `_row`, which costs a second scan.

    A source whose target is e times its size and a rest gives e copies of each document, and one more of those whose
    hash lies below a threshold. Histograms of size by source and leading hash bits find it: the bucket in which the
    budget ends is refined by the next bits, all others are settled. Then the document beyond the threshold that best
    fills what is left is added. Thresholds are nested: a larger budget takes a superset below its threshold.

    Sizes are word counts; a null text has size 0. Null sources are one source, ranked last. Null ids hash as empty.
    Rows with one id hash alike and go together. An empty table gives no rows, sources of size 0 take nothing. Reruns
    agree, for the hash depends on the id alone. Rows are aggregated before they are shuffled, so a hot source costs no
    more than others, and only the per-source table is joined.
    """
    work = Workspace(docs.sparkSession, "mixing")
    base = pick_row(docs, doc_id=doc_id, _text=text, source=source).withColumn("size", word_count(F.col("_text"))).drop("_text")
    slim = base.select("doc_id", "source", "size", doc_hash(F.col("doc_id"), spec.seed).alias("h"))
    slim = work.save(slim, "sizes")
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = work.save(water_fill(ranked_sources(work.save(sources, "sources"), work), spec), "targets")
    n_sources = sources.count()
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("epochs", copies)
    plan = plan.withColumn("left", F.floor("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, BITS // STEP + 1):
        plan = work.save(_refine(slim, plan, n_sources, level), f"level{level}")
        if not plan.filter("open").limit(1).count():
            break
    plan = work.save(_fill(slim, plan, n_sources), "filled")
    keyed = base.withColumn("h", doc_hash(F.col("doc_id"), spec.seed)) if rows else slim
    columns = ("source", "source_size", "target", "epochs", "threshold", "extra_h", "extra_size")
    out = _with_sources(keyed, plan.select(*columns), n_sources)
    one_more = (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("extra_h")) & (F.col("size") == F.col("extra_size")))
    out = out.withColumn("copies", F.col("epochs") + F.coalesce(one_more, F.lit(False)).cast("long"))
    return out.select(
        *(["_row"] if rows else []), "doc_id", "source", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies",
    )


def _refine(slim: DataFrame, plan: DataFrame, n_sources: int, level: int) -> DataFrame:
    """Reads only the bucket in which each source's budget ends, and settles all of its parts but one."""
    below = BITS - STEP * level
    if level == 1:
        rows = slim.withColumn("prefix", F.lit(0).cast("long"))
    else:
        held = plan.filter("open").select("source", F.col("prefix").alias("want"))
        rows = _with_sources(slim, held, n_sources).filter(F.shiftright("h", below + STEP) == F.col("want"))
    part = F.shiftright("h", below)
    sums = rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("s"), F.when(F.min("h") == F.max("h"), 1).otherwise(2).alias("n"))
    # 2**STEP rows a source at most, whatever the number of documents
    run = Window.partitionBy("source").orderBy("part")
    sums = sums.withColumn("upto", F.sum("s").over(run))
    left = plan.select(F.col("source").alias("_s"), F.col("left").alias("_l"))
    joined = sums.join(F.broadcast(left) if n_sources <= BROADCAST_SOURCES else left, F.col("source").eqNullSafe(F.col("_s")))
    over = joined.filter(F.col("upto") > F.col("_l")).groupBy("source").agg(
        F.min(F.struct("part", (F.col("upto") - F.col("s")).alias("settled"), "s", "n")).alias("b")
    )
    over = over.select(F.col("source").alias("_s"), "b")
    out = plan.join(over, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    was_open = F.lit(True) if level == 1 else F.col("open")
    hit = was_open & F.col("b").isNotNull()
    single = F.col("b.n") == 1
    threshold = F.when(hit, F.shiftleft(F.col("b.part"), below)).otherwise(F.lit(1 << BITS) if level == 1 else F.col("threshold"))
    out = out.withColumn("threshold", threshold.cast("long"))
    out = out.withColumn("left", F.when(hit, F.col("left") - F.col("b.settled")).otherwise(F.lit(0).cast("long") if level == 1 else F.col("left")))
    out = out.withColumn("prefix", F.when(hit, F.col("b.part")).otherwise(F.col("prefix")))
    return out.withColumn("open", hit & ~F.coalesce(single, F.lit(False)) & F.lit(below > 0)).drop("b")


def _fill(slim: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """Of the documents beyond the threshold, the one that leaves least over: the largest that fits, or one that
    exceeds what is left by less."""
    rows = _with_sources(slim, plan.select("source", "threshold", "left"), n_sources).filter(
        (F.col("h") >= F.col("threshold")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left"))
    )
    best = rows.groupBy("source").agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("gap"), "h", "size")).alias("e"))
    best = best.select(F.col("source").alias("_s"), F.col("e.h").alias("extra_h"), F.col("e.size").alias("extra_size"))
    return plan.join(best, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")


def mixed(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """docs after mixing: each row as often as the mix takes it, none to `most` times; the same columns."""
    out = mix_sources(docs, spec=spec).filter(F.col("copies") > 0)
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return unrow(out, docs.columns)
