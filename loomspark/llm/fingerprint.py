"""Threshold-scaled sketches of word shingles, with DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, whatever the size of the document,
so that sketches of documents of any sizes can be compared and merged. A sketch that has no hash at all carries a hash
of the whole set in their stead, which tells equal short texts from different ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import pick

RANGE = 1 << 32
#: Documents in a block of neighbouring ids, about, and blocks at most; sampled ids for each block, about; and blocks
#: that are looked up at a time.
BLOCK_DOCS, BLOCKS, SAMPLE, COARSE = 2000, 1 << 15, 64, 256


@dataclass(frozen=True)
class SketchSpec:
    """Words in a shingle, and the fraction of hashes that is kept, at most a half. An estimate from a union of n shingles
    has a standard deviation of about 0.5 / sqrt(n * fraction)."""

    k: int = 5
    fraction: float = 1 / 4

    @property
    def tau(self) -> int:
        return int(RANGE * self.fraction)


def add_sketch(df: DataFrame, text: str, name: str, spec: SketchSpec = SketchSpec()) -> DataFrame:
    """Adds `{name}_values` (sorted) and `{name}_rest` (the hash of the whole set where no value is kept, else null). Words
    stand between ASCII white space, in lower case; texts of fewer than k words have one shingle, texts without words
    none. Null counts as empty.

    Each step is a column of its own, for a lambda evaluates what it refers to for every element.
    """
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(f"{name}_h", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col(f"{name}_h")
    n = F.size(h)

    def shingle(x, i):
        return F.shiftrightunsigned(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, spec.k)]), 32)

    some = F.when(n >= spec.k, F.transform(F.slice(h, 1, F.greatest(n - (spec.k - 1), F.lit(0))), shingle))
    some = some.when(n > 0, F.array(F.shiftrightunsigned(F.xxhash64(h), 32))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(f"{name}_s", some)
    s = F.col(f"{name}_s")
    kept = F.filter(s, lambda v: v < spec.tau).cast("array<int>")
    df = df.withColumn(f"{name}_values", F.array_sort(F.array_distinct(kept)))
    rest = F.when(F.size(f"{name}_values") == 0, F.xxhash64(F.array_sort(F.array_distinct(s))))
    return df.withColumn(f"{name}_rest", rest).drop(f"{name}_h", f"{name}_s")


def as_text(name: str, spec: SketchSpec = SketchSpec()) -> Column:
    """The threshold and the values, or the rest, in hexadecimal digits."""
    values = F.transform(F.col(f"{name}_values"), lambda v: F.lpad(F.hex(v), 8, "0"))
    kept = F.coalesce(F.concat(F.lit(":"), F.hex(F.col(f"{name}_rest"))), F.array_join(values, ""))
    return F.lower(F.concat(F.lit(f"{spec.tau:x}:"), kept))


def likeness(a: str, b: str) -> Column:
    """The share of hashes in both sketches among those in either; of two without hashes 1 if the sets are the same,
    else 0."""
    x, y = F.col(f"{a}_values"), F.col(f"{b}_values")
    both = F.size(F.array_intersect(x, y))
    either = F.size(x) + F.size(y) - both
    return F.when(either == 0, F.col(f"{a}_rest").eqNullSafe(F.col(f"{b}_rest")).cast("double")).otherwise(both / either)


def containment(a: str, b: str) -> Column:
    """The share of a's hashes that are in b; null if a has none."""
    x, y = F.col(f"{a}_values"), F.col(f"{b}_values")
    return F.when(F.size(x) > 0, F.size(F.array_intersect(x, y)) / F.size(x))


def merged(a: str, b: str) -> Column:
    """The values of the sketch of both texts' shingles."""
    return F.array_sort(F.array_union(F.col(f"{a}_values"), F.col(f"{b}_values")))


def _longs(values: list[int]) -> Column:
    """A constant array, of one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _block(cuts: list[int], value: Column) -> Column:
    """How many of the sorted cuts are at most value: first every COARSE-th is looked at, then those after it."""
    coarse = F.size(F.filter(_longs(cuts[COARSE - 1 :: COARSE]), lambda c: c <= value))
    return coarse * COARSE + F.size(F.filter(F.slice(_longs(cuts), coarse * COARSE + 1, COARSE), lambda c: c <= value))


def with_next(df: DataFrame, order: str, tie: str, columns: list[str], most: int = BLOCKS, docs: int = BLOCK_DOCS) -> DataFrame:
    """Adds next_c for each column c: that of the next row in descending `order`, the first after the last.

    Blocks of neighbouring rows, about `docs` of them or an equal share of `most` blocks, are windows of their own. Their
    bounds are quantiles of a sample of the ids, which only makes blocks even. The first rows of each block are sent to
    the block before it too, so that one shuffle does. To the driver go a bound and a greatest value for each block.
    Null values of `order` aren't allowed. Equal ones go by `tie` and are in one block.
    """
    rows = df.select(order)
    n = rows.count()
    blocks = max(1, min(most, -(-n // docs)))
    cuts = []
    if blocks > 1:
        shares = [i / blocks for i in range(1, blocks)]
        part = min(1 << 30, -(-(SAMPLE * blocks << 30) // n))
        some = rows.filter(F.xxhash64(order).bitwiseAND(F.lit((1 << 30) - 1)) < part)
        cuts = sorted(set(some.agg(F.percentile_approx(order, shares, max(10_000, 4 * blocks))).first()[0] or []))
    block = _block(cuts, F.col(order))
    heads = sorted(rows.groupBy(block.alias("b")).agg(F.max(order).alias("m")).collect(), key=lambda r: r["b"])
    if not heads:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    top, above = [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for i, h in enumerate(heads):  # the highest block's first rows go to the lowest, those of others to the next higher
        top[h["b"]], above[h["b"]] = h["m"], heads[(i + 1) % len(heads)]["b"]
    greatest, guest = _longs([t if t is not None else 0 for t in top]), _longs(above)
    df = df.withColumn("_own", block)
    own = F.array(F.struct(F.col("_own").cast("long").alias("b"), F.lit(False).alias("g")))
    also = F.array(F.struct(F.get(guest, F.col("_own")).alias("b"), F.lit(True).alias("g")))
    places = F.when(F.get(greatest, F.col("_own")) == F.col(order), F.concat(own, also)).otherwise(own)
    dealt = df.withColumn("_place", F.explode(places)).select("*", F.col("_place.b").alias("_b"), F.col("_place.g").alias("_g"))
    window = Window.partitionBy("_b").orderBy("_g", F.col(order).desc(), F.col(tie).desc())
    return dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).filter("NOT _g").drop("_b", "_g", "_place", "_own")


def edit_fingerprints(docs: DataFrame, doc_id="doc_id", text="text", spec: SketchSpec = SketchSpec()) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and in_edited: the share of
    the text's sketch that the edited text's has, null if it has no hashes.

    The edited text has its last third of code points replaced by as many first ones of the next document, in
    descending order of ids. A null text is empty. A null id is the smallest; rows of one id are ordered by a hash of
    their texts, and rows that repeat follow each other. A single document is its own next. An empty table gives an
    empty result. Texts are taken whole.
    """
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")))
    rows = add_sketch(rows, "text", "own", spec).withColumn("_u", F.xxhash64("text"))
    rows = with_next(rows, "_d", "_u", ["text", "own_values", "own_rest"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = add_sketch(rows, "edited", "edit", spec)
    rows = rows.withColumnRenamed("next_own_values", "next_values").withColumnRenamed("next_own_rest", "next_rest")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_text("own", spec).alias("fingerprint"), as_text("edit", spec).alias("edited_fingerprint"),
        likeness("own", "edit").alias("near_edited"), likeness("own", "next").alias("near_next"), containment("own", "edit").alias("in_edited"),
    )
