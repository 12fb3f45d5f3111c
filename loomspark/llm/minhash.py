"""Near-duplicate documents: banded MinHash finds candidates, odd sketches of the same samples sift them, full shingle
sets confirm them."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_HASH, Workspace, mix, pick, pick_row, shingles, small_batches, trimmed, unrow


#: Best pairs that each member outside its bucket's largest component tries, by round; the last round tries all.
TRIES = (1, None)
#: The sketches of that last round: more samples in longer bitmaps, with a margin of five standard deviations again.
FINE = {"bands": 256, "rows": 4, "bits": 4096, "margin": 0.06}
#: Members of a bucket that one task compares.
TASK_MEMBERS = 20_000


@dataclass(frozen=True)
class NearDup:
    """Texts are linked where 100 * intersection >= percent * union of their sets of k-word shingles.

    A pair at the limit of 0.85 shares none of the 24 bands of 5 samples with probability 8e-7. Candidates whose odd
    sketch puts them `margin` below the limit are dropped: five standard deviations of the estimate.
    """

    k: int = 3
    percent: int = 85
    bands: int = 24
    rows: int = 5
    bits: int = 512
    margin: float = 0.17
    seed: int = 7

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        a, b = r.integers(0, 1 << 63, (2, self.samples), np.uint64)
        return a * np.uint64(2) + np.uint64(1), b


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles, A-Z lower-cased; with fewer words, of the whole sequence."""
    words = (text or "").encode().lower().split()
    return np.unique(shingles(WORD_HASH.of(words), k))


def samples(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = np.multiply.outer(a, hashes[i : i + 2048])
        part += b[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray, spec: NearDup) -> np.ndarray:
    """A 64-bit key for each document and band."""
    cube = values.reshape(len(values), spec.bands, spec.rows)
    key = np.broadcast_to(np.arange(1, spec.bands + 1, dtype=np.uint64), cube.shape[:2])
    for r in range(spec.rows):
        key = mix(key ^ mix(cube[:, :, r]))
    return key


def odd_sketches(values: np.ndarray, spec: NearDup) -> np.ndarray:
    """Bitmaps, as 64-bit words, in which each sample flips the bit that its place and value hash to."""
    n = len(values)
    place = mix(values + np.arange(spec.samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(spec.bits)
    flat = (place + (np.arange(n, dtype=np.uint64) * np.uint64(spec.bits))[:, None]).astype(np.int64)
    parity = (np.bincount(flat.reshape(-1), minlength=n * spec.bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, spec.bits), axis=1).view("<i8")


def odd_similarity(different: Column, spec: NearDup) -> Column:
    """Similarity from the number of bits in which two odd sketches differ."""
    inner = F.lit(1.0) - F.lit(2.0) * different / F.lit(spec.bits)
    return F.when(inner > 0, F.lit(1.0) + F.lit(spec.bits / (4.0 * spec.samples)) * F.log(inner)).otherwise(0.0)


def _different(a: str, b: str, spec: NearDup) -> Column:
    words = [F.bit_count(F.get(F.col(a), F.lit(i)).bitwiseXOR(F.get(F.col(b), F.lit(i)))) for i in range(spec.bits // 64)]
    out = words[0]
    for w in words[1:]:
        out = out + w
    return out


def _signatures(docs: DataFrame, spec: NearDup) -> DataFrame:
    """doc_id, n_shingles, sig (hash of the set; null if empty), bands, sketch."""
    names = ["doc_id", "n_shingles", "sig", "bands", "sketch"]

    def run(batches):
        a, b = spec.multipliers()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n = part.num_rows
                values, sizes, sigs = np.zeros((n, spec.samples), np.uint64), [], []
                for j, t in enumerate(part.column("text")):
                    s = shingle_set(t.as_py(), spec.k)
                    sizes.append(len(s))
                    sigs.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                    if len(s):
                        values[j] = samples(s, a, b)
                bands = band_keys(values, spec).astype(np.int64).reshape(-1)
                sketch = odd_sketches(values, spec).astype(np.int64).reshape(-1)
                lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (len(x) // n), pa.array(x)) for x in (bands, sketch)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.string()), *lists], names)

    return docs.mapInArrow(trimmed(run), "doc_id long, n_shingles long, sig string, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """id, set (sorted 64-bit hashes as bytes) of the documents with a wanted id."""

    def run(batches):
        for batch in batches:
            got = [shingle_set(t.as_py(), k).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.binary())], ["id", "set"])

    return docs.join(wanted, docs.doc_id == wanted.id, "left_semi").mapInArrow(trimmed(run), "id long, set binary")


def _fine_sketches(sets: DataFrame, spec: NearDup) -> DataFrame:
    """id, sketch by the samples of spec, from full sets."""

    def run(batches):
        a, b = spec.multipliers()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                values = [samples(np.frombuffer(x.as_buffer(), np.uint64), a, b) for x in part.column("set")]
                sketch = odd_sketches(np.stack(values), spec).astype(np.int64)
                offsets = np.arange(len(sketch) + 1, dtype=np.int32) * sketch.shape[1]
                lists = pa.ListArray.from_arrays(offsets, pa.array(sketch.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("id"), lists], ["id", "sketch"])

    return sets.mapInArrow(trimmed(run), "id long, sketch array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Each join is by one id; AQE splits that of a hot one."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([u, v]), kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(u) + len(v) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(trimmed(run), "a long, b long")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """id, component (its smallest id) of all ids in edges (a, b): least labels of neighbours, then of their labels,
    until nothing changes. All rounds are joins by id; labels never leave the executors."""
    both = work.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = work.save(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), f"{name}-labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        hooked = labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("component"), F.col("component").alias("was"))
        hooked = work.save(hooked, f"{name}-hooked{step}")
        up = hooked.select(F.col("id").alias("_id"), F.col("component").alias("up"))
        jumped = hooked.join(up, hooked.component == up._id).select("id", F.least("component", "up").alias("component"), "was")
        labels = work.save(jumped, f"{name}-labels{step}")
        if not labels.filter("component <> was").limit(1).count():
            return labels.select("id", "component")


def near_duplicates(docs: DataFrame, doc_id="doc_id", text="text", spec: NearDup = NearDup()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of docs.

    Texts with equal sets are one: a grouping by the hash of the set leaves its smallest id as its representative.
    Representatives meet in buckets of equal bands. Each is held against the smallest id of its buckets, the best of
    these by odd sketches is confirmed on full sets. What then is still in several components within a bucket is held
    against the bucket's other components, again sketches first, then full sets. So a group of copies costs a pair for
    each copy, and no link between different texts is lost but by the sampling of bands.

    A null or empty text has no shingles and is linked with nothing. A null id can't be linked: its component is null
    and it is kept. Rows with one id are one document, whatever their texts; repeated rows all get its component.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "minhash")
    docs = pick(docs, doc_id=doc_id, text=text)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    sigs = work.save(_signatures(docs, spec), "signatures")
    usable = sigs.filter("sig IS NOT NULL AND doc_id IS NOT NULL")
    first = usable.groupBy("sig").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("r"))
    reps = work.save(first.select("sig", F.col("r.doc_id").alias("id"), "r.bands", "r.sketch"), "representatives")
    buckets = reps.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("top")).filter("center < top")
    shared = work.save(shared.select("key", "center"), "buckets")
    members = work.save(buckets.join(shared, "key"), "members")
    wanted = members.select("id").distinct()
    sets = work.save(_sets(docs, wanted, spec.k), "sets")
    work.drop()

    sketches = reps.select("id", "sketch")
    limit = spec.percent / 100 - spec.margin
    fine = replace(spec, **FINE)
    pairs = members.filter("id > center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
    pairs = _sketched(pairs, sketches)
    pairs = pairs.withColumn("like", odd_similarity(_different("sketch_a", "sketch_b", spec), spec)).filter(F.col("like") >= limit)
    best = pairs.groupBy("a").agg(F.max(F.struct("like", (-F.col("b")).alias("b"))).alias("m")).select("a", (-F.col("m.b")).alias("b"))
    best = work.save(best, "best")
    edges = work.save(_confirm(best, sets, spec.percent), "links")
    labels = components(edges, work, "first")

    members = work.save(members.select("key", "id").join(sketches, "id"), "sketched")
    tried = best
    for step, most in enumerate(TRIES):
        labelled = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = work.save(labelled, f"labelled{step}")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
        open_rows = work.save(labelled.join(mixed.select("key"), "key"), f"open{step}")
        if not open_rows.limit(1).count():
            break
        if most:
            found = _across(open_rows, limit, most, spec)
        else:
            ids = open_rows.select("id").distinct()
            finer = work.save(_fine_sketches(sets.join(ids, "id", "left_semi"), fine).join(reps.select("id", "bands"), "id"), "fine")
            found = _across(open_rows.drop("sketch").join(finer, "id"), spec.percent / 100 - fine.margin, None, fine)
        more = work.save(found.join(tried, ["a", "b"], "left_anti"), f"more{step}")
        tried = tried.unionByName(more)
        new = work.save(_confirm(more, sets, spec.percent), f"links{step}")
        if not new.limit(1).count():
            continue
        edges = edges.unionByName(new)
        labels = components(edges, work, f"again{step}")
    ids = reps.select("sig", "id").join(labels, "id", "left")
    final = work.save(ids.select("sig", F.coalesce("component", "id").alias("c")), "components")
    out = sigs.select("doc_id", "n_shingles", "sig").join(final, "sig", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.least("doc_id", "c"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    work.keep("signatures", "components")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    left = pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
    return left.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sketch_b")), "b")


def _across(open_rows: DataFrame, limit: float, most: int | None, spec: NearDup) -> DataFrame:
    """Pairs (a, b), a > b, of different components within a bucket that sketches let pass.

    Members outside the bucket's largest component are held against all others, and each gives its `most` best pairs,
    or all. Large buckets are dealt to several tasks, to each of which those members go. Of all buckets that two members
    share, it is the one of the first band that gives the pair when all are asked for; open_rows then have their bands.
    """
    sizes = open_rows.groupBy("key", "component").count()
    main = F.max(F.struct("count", "component")).alias("m")
    largest = sizes.groupBy("key").agg(main, F.sum("count").alias("n"))
    largest = largest.select("key", F.col("m.component").alias("main"), F.ceil(F.col("n") / TASK_MEMBERS).cast("int").alias("tasks"))
    rows = open_rows.join(largest, "key").withColumn("few", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int")
    dealt = rows.withColumn("task", F.explode(F.when(F.col("few"), F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(own))))
    dealt = dealt.withColumn("own", own == F.col("task"))
    allowed = [d for d in range(spec.bits + 1) if _similarity(d, spec) >= limit][-1]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        ids, comps = table.column("id").to_numpy(), table.column("component").to_numpy()
        few, own_ = table.column("few").to_numpy(), table.column("own").to_numpy()
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
        other = np.flatnonzero(own_)
        if not most:
            bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            band = int(np.flatnonzero(bands[0] == table.column("key")[0].as_py())[0])
        found = []
        for i in np.flatnonzero(few):
            differ = np.bitwise_count(sketch[other] ^ sketch[i]).sum(axis=1, dtype=np.int64)
            fits = np.flatnonzero((differ <= allowed) & (comps[other] != comps[i]) & (~few[other] | (ids[other] < ids[i])))
            if most and len(fits) > most:
                fits = fits[np.argsort(differ[fits], kind="stable")[:most]]
            elif not most:  # pairs that meet in a bucket of an earlier band are given there
                fits = fits[~(bands[other[fits], :band] == bands[i, :band]).any(axis=1)]
            found.append(np.stack([np.maximum(ids[i], ids[other[fits]]), np.minimum(ids[i], ids[other[fits]])]))
        a, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": a, "b": b})

    columns = ("key", "task", "id", "component", "sketch", "few", "own") + (() if most else ("bands",))
    pairs = dealt.select(*columns).groupBy("key", "task").applyInArrow(run, "a long, b long")
    return pairs.distinct()


def _similarity(different: int, spec: NearDup) -> float:
    inner = 1 - 2 * different / spec.bits
    return 1 + spec.bits / (4 * spec.samples) * float(np.log(inner)) if inner > 0 else 0.0


def one_of_each(docs: DataFrame, spec: NearDup = NearDup()) -> DataFrame:
    """docs without the documents that are in the component of one with a smaller id; the same columns.

    Rows with a null id stay, those of texts without words too; of an id that several rows have all stay or all go. An empty
    table gives an empty result.
    """
    rows = pick_row(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("long"))
    gone = near_duplicates(rows.select("doc_id", "text"), spec=spec).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return unrow(rows.join(gone, rows["doc_id"] == gone["_gone"], "left_anti"), docs.columns)
