"""Prediction by partial matching over bytes: a trie of contexts, escapes by the number of symbols seen (method C) and
exclusion of symbols that longer contexts have."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import WORD_HASH, Workspace, mix, partitions, pick, small_batches

ORDER = 5
#: Contexts of so many bytes and longer ones are dealt out; grams of shorter ones, at most 2**24 of bytes, are broadcast.
DEALT = 3
#: Most words whose counts are broadcast; the rest is joined.
MAX_WORDS = 1 << 17
#: A group of documents is closed at the first batch end after about GROUP bytes.
GROUP, SEGMENT, FLUSH_WORDS, FLUSH_GRAMS = 8_000_000, 1_500_000, 200_000, 1_500_000
BYTE = np.uint64(8)


def held_out(doc_id: Column) -> Column:
    """Whether the id is kept from training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, the number made of its ORDER predecessors (0 before the start) and itself; and the
    end of each text."""
    pad = b"\0" * ORDER
    data = np.frombuffer(pad.join([b"", *texts]), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    key = np.zeros(len(data), np.uint64)
    for i in range(ORDER, -1, -1):
        key[i:] |= data[: len(data) - i] << np.uint64(8 * i)
    own = np.ones(len(data), bool)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    own[(starts[:, None] + np.arange(ORDER)).reshape(-1)] = False
    return key[own], np.cumsum(sizes)


def _segments(texts):
    """Lists of texts of about SEGMENT bytes; a longer text stands alone."""
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= SEGMENT:
            yield group
            group, size = [], 0
    if group:
        yield group


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[new], np.add.reduceat(counts, new)


def _lower(keys: np.ndarray, order: int) -> np.ndarray:
    """The grams of a lower order that grams end in."""
    return keys & np.uint64((1 << 8 * (order + 1)) - 1)


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each gram: one for all grams whose contexts end in the same DEALT bytes."""
    return (mix(_lower(keys, DEALT) >> BYTE) % np.uint64(parts)).astype(np.int32)


def _packed(values: np.ndarray) -> bytes:
    """The number of values, and their bytes by place, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(dtype).itemsize
    planes = pa.Codec("zstd").decompress(data[8:], n * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype).reshape(-1)


WORD, LOW, DOCS, DOC, ASKED = range(5)
FIRST = (
    "kind int, key long, n long, grp long, doc_id long, text string, held_out boolean, part int, keys binary, counts binary"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def first_pass(docs: DataFrame, parts: int) -> DataFrame:
    """By kind: counts of word hashes, of grams of order DEALT - 1 and of documents, all of the training documents; the
    documents, with their groups; and for each group and part the sorted grams of full order that occur in the group,
    with their counts in its training documents."""

    def rows(kind, m, **columns):
        columns["kind"] = np.full(m, kind, np.int32)
        fields = [c.split() for c in FIRST.split(", ")]
        arrays = [pa.nulls(m, _TYPES[t]) if c not in columns else columns[c] for c, t in fields]
        arrays = [x if isinstance(x, pa.Array) else pa.array(x, _TYPES[t]) for x, (_, t) in zip(arrays, fields, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c for c, _ in fields])

    def words(count):
        keys = WORD_HASH.of(list(count)).view(np.int64)
        return rows(WORD, len(keys), key=keys, n=np.fromiter(count.values(), np.int64, len(count)))

    def asked(grp, keys, counts):
        part = _dealt(keys, parts)
        order = np.argsort(part, kind="stable")
        some, at = np.unique(part[order], return_index=True)
        keys, counts = (np.split(x[order], at[1:]) for x in (keys.astype("<u8"), counts.astype("<u4")))
        keys = [_packed(np.diff(x, prepend=np.uint64(0))) for x in keys]
        counts = [_packed(x) for x in counts]
        return rows(ASKED, len(some), grp=np.full(len(some), grp), part=some, keys=keys, counts=counts)

    def merged(held):
        return _summed(*map(np.concatenate, zip(*held, strict=True)))

    def run(batches):
        grp = TaskContext.get().partitionId() << 24
        count, held, low, size, length, n = {}, [], [], 0, 0, 0

        def close():
            keys, counts = merged(held)
            learned = counts > 0
            low[:] = [merged([*low, (_lower(keys[learned], DEALT - 1), counts[learned])])] if learned.any() else low
            return asked(grp, keys, counts)

        for batch in batches:
            m = batch.num_rows
            yield rows(DOC, m, grp=np.full(m, grp), **{c: batch.column(c) for c in ("doc_id", "text", "held_out")})
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            out = batch.column("held_out").to_pylist()
            learned = [t for t, o in zip(texts, out, strict=True) if not o]
            n += len(learned)
            for t in learned:
                for w in t.lower().split():
                    count[w] = count.get(w, 0) + 1
                if len(count) >= FLUSH_WORDS:
                    yield words(count)
                    count = {}
            for some, counted in ((learned, 1), ([t for t, o in zip(texts, out, strict=True) if o], 0)):
                for group in _segments(some):
                    key, _ = grams(group)
                    if len(key):
                        keys, counts = np.unique(key, return_counts=True)
                        held.append((keys, counts * counted))
                        size += len(keys)
                    if size >= FLUSH_GRAMS:
                        held = [merged(held)]
                        size = 0
            length += sum(map(len, texts)) + 100 * m  # bounds the rows of a group, too
            if length >= GROUP:
                if held:
                    yield close()
                held, size, length, grp = [], 0, 0, grp + 1
        if count:
            yield words(count)
        if held:
            yield close()
        if low:
            yield rows(LOW, len(low[0][0]), key=low[0][0].view(np.int64), n=low[0][1])
        yield rows(DOCS, 1, n=[n])

    return docs.mapInArrow(run, FIRST)


def _least_count(df: DataFrame, most: int) -> int:
    """The smallest power of 2**(1/8) above which there are at most `most` rows; from a histogram of a few rows."""
    bins = df.groupBy(F.ceil(8 * F.log2("n")).cast("int").alias("b")).count().collect()
    total, least = 0, 1
    for r in sorted(bins, key=lambda r: -r["b"]):
        total += r["count"]
        if total > most:
            return int(2 ** (r["b"] / 8)) + 1
    return least


@dataclass
class Model:
    """By order: sorted grams, their counts, place of their context; sorted contexts with total, distinct symbols, and
    the same of the next shorter context without their own symbols."""

    orders: list[dict]

    @classmethod
    def of(cls, tables: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """tables: grams and counts of orders 0, 1 and so on, each gram's shorter ones among those of the order below."""
        orders = []
        for j, (keys, counts) in enumerate(tables):
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order].astype(np.float64)
            contexts, place = np.unique(keys >> BYTE, return_inverse=True)
            total = np.bincount(place, counts, len(contexts))
            distinct = np.bincount(place, minlength=len(contexts)).astype(np.float64)
            o = {"keys": keys, "counts": counts, "contexts": contexts, "total": total, "distinct": distinct}
            if j:
                low = orders[-1]
                mask = np.uint64((1 << 8 * j) - 1)
                short = low["counts"][np.searchsorted(low["keys"], keys & mask)] if len(keys) else counts
                at = np.searchsorted(low["contexts"], contexts & (mask >> BYTE))
                o["rest_total"] = low["total"][at] - np.bincount(place, short, len(contexts))
                o["rest_distinct"] = low["distinct"][at] - distinct
            orders.append(o)
        return cls(orders)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """The log probability of the last byte of each gram after its others."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))  # grams not yet found
        total = distinct = np.full(len(keys), np.nan)  # of the next context, if an escape led there
        for j in range(len(self.orders) - 1, -1, -1):
            o = self.orders[j]
            if not len(o["keys"]) or not len(left):
                continue
            key = keys[left] & np.uint64((1 << 8 * (j + 1)) - 1)
            at = np.minimum(np.searchsorted(o["contexts"], key >> BYTE), len(o["contexts"]) - 1)
            there = o["contexts"][at] == key >> BYTE
            free = np.isnan(total)
            t, q = np.where(free, o["total"][at], total), np.where(free, o["distinct"][at], distinct)
            g = np.minimum(np.searchsorted(o["keys"], key), len(o["keys"]) - 1)
            hit = there & (o["keys"][g] == key)
            out[left[hit]] += np.log10(o["counts"][g[hit]] / (t[hit] + q[hit]))
            miss = there & ~hit & (t + q > 0)
            out[left[miss]] += np.log10(q[miss] / (t[miss] + q[miss]))
            total, distinct = total.copy(), distinct.copy()
            if j:
                total[there], distinct[there] = o["rest_total"][at[there]], o["rest_distinct"][at[there]]
            else:
                distinct[there] = o["distinct"][at[there]]
            left, total, distinct = left[~hit], total[~hit], distinct[~hit]
        if len(left):
            seen = np.where(np.isnan(distinct), 0, distinct)
            out[left] -= np.log10(256 - seen)
        return out


def _low_tables(counts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams below order DEALT and their counts; lower orders are sums over the grams of the highest."""
    pdf = counts.groupBy("key").agg(F.sum("n").alias("n")).toPandas()
    keys, n = pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["n"].to_numpy(np.int64)
    return [_table(keys, n, j) for j in range(DEALT)]


def _table(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    return _summed(_lower(keys, order), counts) if len(keys) else (keys, counts)


def _answers(asked: DataFrame, low) -> DataFrame:
    """For each group and part the log probabilities of the grams asked for, in their order. A part has all grams of its
    contexts, so their counts are whole."""

    def run(table):
        keys = [np.cumsum(_unpacked(x, "<u8"), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = [_unpacked(x, "<u4") for x in table.column("counts").to_pylist()]
        some, n = _summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))
        learned = n > 0
        high = [_table(some[learned], n[learned], j) for j in range(DEALT, ORDER + 1)]
        logs = Model.of([*low.value, *high]).log10(some)
        logs = [_packed(logs[np.searchsorted(some, k)].astype("<f8")) for k in keys]
        columns = [table.column("grp"), table.column("part"), pa.chunked_array([pa.array(logs, pa.binary())])]
        return pa.Table.from_arrays(columns, ["grp", "part", "logs"])

    asked = asked.repartition(max(1, partitions(asked.sparkSession)), "part")
    return asked.groupBy("part").applyInArrow(run, "grp long, part int, logs binary")


SCORED = (
    "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>"
)


def score_documents(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is that of single words, smoothed; score the log10 probability of the text's bytes by partial matching.
    Both learn from the documents that are not held out. Words are counted by 64-bit hashes. The commonest words'
    counts are broadcast, up to MAX_WORDS; those of the others are joined. Grams of full order are dealt out by their
    contexts, and the groups of documents ask the parts for the log probabilities, so all counts are whole. Null texts are
    empty: an end token and no bytes. Null ids are as an empty id. Rows that repeat count as often as they are there.
    Without training documents every byte has probability 1/256. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Workspace(spark, "ppm")
    docs = pick(docs, doc_id=doc_id, text=text).withColumn("held_out", held_out(F.col("doc_id")))
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    parts = 2 * max(1, partitions(spark))
    first = work.save(first_pass(docs, parts), "first")
    words = first.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n"))
    words = work.save(words, "words")
    v, tokens = words.agg(F.count("key"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ends = first.filter(F.col("kind") == DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    v, n = v + (ends > 0), tokens + ends
    size = n + 0.1 * (v + 1)
    least = _least_count(words, MAX_WORDS)
    hot = words.filter(F.col("n") >= least).select("key", "n").toPandas().sort_values("key")
    hot_keys = hot["key"].to_numpy(np.int64)
    logs = np.log10((hot["n"].to_numpy(np.float64) + 0.1) / size)
    end_log = float(np.log10((ends + 0.1) / size))
    shared = spark.sparkContext.broadcast((hot_keys, logs))
    low = spark.sparkContext.broadcast(_low_tables(first.filter(F.col("kind") == LOW)))
    work.drop()
    answers = _answers(first.filter(F.col("kind") == ASKED).select("grp", "part", "keys", "counts"), low)

    def scores(texts, answer):
        """Of texts of a group: sums of the log probabilities of their grams."""
        held = []
        for group in _segments(texts):
            key, ends_ = grams(group)
            some, back = np.unique(key, return_inverse=True)
            held.append((some, back.astype(np.int32), ends_))
        if not held:
            return np.empty(0)
        keys = np.unique(np.concatenate([some for some, _, _ in held]))
        answer = sorted(zip(answer.column("part").to_pylist(), answer.column("logs").to_pylist(), strict=True))
        found = np.concatenate([np.empty(0), *[_unpacked(x, "<f8") for _, x in answer]])
        if len(found) != len(keys):
            raise ValueError(f"{len(keys)} grams in a group, {len(found)} scored")
        value = np.empty(len(keys))
        value[np.argsort(_dealt(keys, parts), kind="stable")] = found
        out = []
        for some, back, ends_ in held:
            sums = np.concatenate([[0.0], np.cumsum(value[np.searchsorted(keys, some)][back])])
            out.append(np.diff(sums[np.concatenate([[0], ends_])]))
        return np.concatenate(out)

    def run(group, table, answer):
        keys, log = shared.value
        table = table.combine_chunks()
        texts = [(t.as_py() or "").encode() for t in table.column("text")]
        score = scores(texts, answer)
        tokens_, known, base, rare = [], [], [], []
        for t in texts:
            h = WORD_HASH.of(t.lower().split()).view(np.int64)
            at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            tokens_.append(len(h) + 1)
            known.append(int(hit.sum()) + (ends > 0))
            base.append(float(log[at[hit]].sum()) + end_log)
            rare.append(h[~hit])
        m, row = len(texts), group[0].as_py() << 17
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rare])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rare) if m else np.empty(0, np.int64)))
        arrays = [pa.array(np.arange(row, row + m)), table.column("doc_id"), table.column("held_out"), pa.array(tokens_, pa.int64())]
        arrays += [pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), lists]
        return pa.Table.from_arrays(arrays, [c.split()[0] for c in SCORED.split(", ")])

    texts = first.filter(F.col("kind") == DOC).select("grp", "doc_id", "text", "held_out")
    texts, answers = (x.repartition(max(1, partitions(spark)), "grp").groupBy("grp") for x in (texts, answers))
    scored = work.save(texts.cogroup(answers).applyInArrow(run, SCORED), "scored")
    work.drop("first")
    rare = scored.select("rid", F.explode("rare").alias("key")).join(words.filter(F.col("n") < least), "key", "left")
    value = F.log10((F.coalesce("n", F.lit(0)) + F.lit(0.1)) / F.lit(float(size)))
    sums = rare.groupBy("rid").agg(F.sum(value).alias("more"), F.count("n").alias("found"))
    out = scored.drop("rare").join(sums, "rid", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )
