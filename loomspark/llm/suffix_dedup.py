"""Removal of bytes in long strings that occur earlier in the corpus, by sparse suffix arrays in logarithmic levels.

A window is a string of `length` bytes. Every window has an anchor, the k-gram within it whose hash is least, so equal
windows have equal anchors at equal places, and windows that start side by side mostly share theirs: a run. A run whose very
bytes stand in an earlier one is settled by their hash, as one string. First runs whose anchor has other bytes too go on,
with their bytes, to the task of their anchor. There they come in document order, batch by batch: each batch gets its suffix
array, the places where its windows start in the order of their letters; equal neighbours repeat each other, the others are
looked up in the levels of earlier batches, and those that none has become a level themselves: their letters, their suffix
array, and their sorted fingerprints, which spare most look-ups in it. A level and the next larger one are merged when they
are of about equal size, so that there are logarithmically many.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import M1, M2, Workspace, mix, partitions, pick, pick_row, small_batches, trimmed, unrow

#: Bytes of text, and windows, that a worker handles at a time.
SEGMENT, BATCH_WINDOWS = 3 << 20, 400_000
#: Windows whose letters are held at a time when levels are searched and merged.
BLOCK = 100_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


@dataclass(frozen=True)
class LongMatches:
    """hot_runs: an anchor with more runs is dealt out by window instead, so that no task holds more of one anchor."""

    length: int = 100
    k: int = 24
    hot_runs: int = 20_000


def fingerprints(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes, joined from those of powers of two."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, have = _BYTE[data], 1
    out, done = None, 0
    while True:
        if size & have:
            part = power[done : done + n]
            out = part.copy() if out is None else out * M2 + part
            done += have
        if done == size:
            return mix(out)
        power = power[:-have] * M1 + power[have:]
        power ^= power >> np.uint64(29)
        have *= 2


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, ends: np.ndarray, spec: LongMatches) -> tuple[np.ndarray, ...]:
    """Of texts side by side in `data`, ending at `ends`: anchor hash, text, first start (in data) and number of
    windows of each run."""
    empty = (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)
    if len(data) < spec.length:
        return empty
    grams = fingerprints(data, spec.k)
    place = np.arange(len(grams), dtype=np.uint64)
    low = least((grams & np.uint64(0xFFFFFFFFFF000000)) | place, spec.length - spec.k + 1)
    at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    size = np.maximum(0, ends - begins - spec.length + 1)
    total = int(size.sum())
    if not total:
        return empty
    text = np.repeat(np.arange(len(ends)), size)
    start = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begins, size)
    anchor = at[start]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([new, [total]]))
    return grams[anchor[new]], text[new], start[new], count


class Levels:
    """Sorted arrays of fingerprints, each less than half as long as the one before: for windows of anchors so common that
    they are dealt out by their fingerprints, without letters."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def seen(self, ordered: np.ndarray) -> np.ndarray:
        """Which of the sorted fingerprints are in a level: a merge scan of each."""
        found = np.zeros(len(ordered), bool)
        for level in self.levels:
            at = np.searchsorted(level, ordered)
            at[at == len(level)] = 0
            found |= level[at] == ordered
        return found

    def add(self, ordered: np.ndarray) -> None:
        if not len(ordered):
            return
        self.levels.append(ordered)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            both = np.concatenate([self.levels.pop(), self.levels.pop()])
            both.sort(kind="stable")
            self.levels.append(both)

    def repeats(self, values: np.ndarray) -> np.ndarray:
        """Takes the next batch in; marks what occurred before, in it or in a level."""
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, bool)
        heads = ordered[first]
        known = self.seen(heads)
        self.add(heads[~known])
        again = ~first
        again[np.flatnonzero(first)[known]] = True
        out = np.empty(len(values), bool)
        out[order] = again
        return out


def strings(text: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The strings of `length` bytes at some places."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, length)[at]).view(f"S{length}").ravel()


class SuffixArray:
    """Different windows of a text: `order` has their starts in the order of their letters, `keys` their fingerprints in the
    order of these."""

    def __init__(self, text: np.ndarray, order: np.ndarray, keys: np.ndarray, length: int):
        self.text, self.order, self.keys, self.length = text, order, keys, length

    def __len__(self) -> int:
        return len(self.order)

    def holds(self, wanted: np.ndarray) -> np.ndarray:
        """Which of the strings are windows of it, by bisection."""
        found = np.zeros(len(wanted), bool)
        for i in range(0, len(wanted), BLOCK):
            part = wanted[i : i + BLOCK]
            low, high = np.zeros(len(part), np.int64), np.full(len(part), len(self))
            while (low < high).any():
                middle = np.minimum((low + high) // 2, len(self) - 1)
                less = strings(self.text, self.order[middle], self.length) < part
                low, high = np.where(less & (low < high), middle + 1, low), np.where(less | (low >= high), high, middle)
            there = np.flatnonzero(low < len(self))
            found[i + there] = strings(self.text, self.order[low[there]], self.length) == part[there]
        return found

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both in one; no window is in both. Blocks of one and what of the other comes between their first letters are merged
        at a time."""
        text, mine, theirs = np.concatenate([self.text, other.text]), self.order, other.order + len(self.text)
        fences = strings(text, mine[BLOCK::BLOCK], self.length)
        cuts = [0, *[other._below(f) for f in fences], len(other)]
        out = []
        for i in range(len(cuts) - 1):
            places = np.concatenate([mine[i * BLOCK : (i + 1) * BLOCK], theirs[cuts[i] : cuts[i + 1]]])
            out.append(places[np.argsort(strings(text, places, self.length), kind="stable")])
        keys = np.concatenate([self.keys, other.keys])
        keys.sort(kind="stable")
        return SuffixArray(text, np.concatenate(out) if out else mine, keys, self.length)

    def _below(self, letters: bytes) -> int:
        low, high = 0, len(self)
        while low < high:
            middle = (low + high) // 2
            at = self.order[middle]
            if self.text[at : at + self.length].tobytes() < bytes(letters).ljust(self.length, b"\0"):
                low = middle + 1
            else:
                high = middle
        return low


class SuffixLevels:
    """Suffix arrays, each less than half as long as the one before."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def _known(self, heads: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found, by_key = np.zeros(len(heads), bool), np.argsort(keys)
        ordered = keys[by_key]
        for level in self.levels:
            at = np.searchsorted(level.keys, ordered)
            at[at == len(level)] = 0
            maybe = by_key[level.keys[at] == ordered]
            if len(maybe):
                found[maybe] |= level.holds(heads[maybe])
        return found

    def _add(self, text: np.ndarray, order: np.ndarray, keys: np.ndarray) -> None:
        """A level of the windows at `order`, with no more of the text than they cover."""
        if not len(order):
            return
        edges = np.bincount(order, minlength=len(text) + 1) - np.bincount(order + self.length, minlength=len(text) + 1)
        covered = np.cumsum(edges[:-1]) > 0
        place = np.cumsum(covered) - 1
        self.levels.append(SuffixArray(text[covered], place[order], np.sort(keys), self.length))
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            last = self.levels.pop()
            self.levels.append(self.levels.pop().merged(last))

    def repeats(self, text: np.ndarray, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Takes the next batch in, the windows at some places of a text in document order, with their fingerprints; marks what
        occurred before, in it or in a level."""
        if not len(at):
            return np.zeros(0, bool)
        letters = strings(text, at, self.length)
        order = np.argsort(letters, kind="stable")
        letters = letters[order]
        first = np.concatenate([[True], letters[1:] != letters[:-1]])
        heads = order[first]
        known = self._known(letters[first], keys[heads])
        new = heads[~known]
        self._add(text, at[new], keys[new])
        again = ~first
        again[np.flatnonzero(first)[known]] = True
        out = np.empty(len(at), bool)
        out[order] = again
        return out


def _segments(batch: pa.RecordBatch, overlap: int):
    """(d, u, bytes, offset) groups of about SEGMENT bytes; longer texts in parts that overlap by a window less one."""
    group, size = [], 0
    for d, u, t in zip(batch.column("d").to_pylist(), batch.column("u").to_pylist(), batch.column("text"), strict=True):
        raw = (t.as_py() or "").encode()
        for i in range(0, max(1, len(raw) - overlap), SEGMENT):
            part = raw[i : i + SEGMENT + overlap]
            group.append((d, u, part, i))
            size += len(part)
            if size >= SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


DEALT = "done boolean, key long, same long, d long, u long, start long, n long"
RUN = "hot boolean, key long, d long, u long, start long, n long"
RUN_KEPT = ["key", "d", "u", "start", "n"]
SPAN = "d long, u long, start long, stop long"


def _batch(spec: str, *columns) -> pa.RecordBatch:
    names, types = zip(*[c.split() for c in spec.split(", ")], strict=True)
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _runs(docs: DataFrame, spec: LongMatches) -> DataFrame:
    """Runs; `same` is a hash of all their bytes. Those whose very bytes stand in an earlier run of the same segment are done:
    they need not meet the others, so that a passage in many documents brings one row for each segment to its task."""

    def run(batches):
        for batch in batches:
            for group in _segments(batch, spec.length - 1):
                data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
                ends = np.cumsum([len(g[2]) for g in group])
                key, text, start, n = runs(data, ends, spec)
                if not len(key):
                    continue
                whole = fingerprints(data, spec.length)
                same = mix(mix(whole[start] * M1 + n.astype(np.uint64)) + whole[start + n - 1])
                same = mix(same + whole[start + n // 2])
                d, u = (np.array([g[i] for g in group], np.int64)[text] for i in (0, 1))
                begins = np.concatenate([[0], ends[:-1]]) - np.array([g[3] for g in group])
                start = start - begins[text]
                order = np.lexsort((start, u, d, same, key))
                key, same, d, u, start, n = (x[order] for x in (key, same, d, u, start, n))
                new = _new([key, same], None)
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                done = (d != d[head]) | (u != u[head]) | (start != start[head])
                yield _batch(DEALT, done, key.view(np.int64), same.view(np.int64), d, u, start, n)

    return docs.mapInArrow(trimmed(run), DEALT)


def _new(columns: list[np.ndarray], last: list | None) -> np.ndarray:
    """Where a row differs from the one before it; `last` is the one before the first."""
    differs = np.zeros(len(columns[0]), bool)
    for i, c in enumerate(columns):
        differs[1:] |= c[1:] != c[:-1]
        differs[0] |= last is None or c[0] != last[i]
    return differs


def _repeated(table: DataFrame, spec: LongMatches) -> DataFrame:
    """Of runs sorted by anchor, bytes and place: with a null `hot` those whose very bytes stand in an earlier run, for
    they are settled and that run stands for all; of the first runs those whose anchor has other bytes too, marked hot
    where it has too many. Holds the first runs of one anchor up to the limit. A row of docs that is there twice counts
    once."""

    def run(batches):
        held, hot_key, last = None, None, None

        def judge(t, end):
            """The rows to pass on, and those to hold for their anchor may go on."""
            nonlocal hot_key
            key = t.column("key").to_numpy()
            new = np.flatnonzero(_new([key], None))
            size = np.diff(np.concatenate([new, [len(key)]]))
            hot = size > spec.hot_runs
            if hot_key is not None and key[0] == hot_key:
                hot[0] = True
            cut = len(key) if end or hot[-1] else int(new[-1])
            if hot[-1]:
                hot_key = key[-1]
            keep = np.repeat((size > 1) | hot, size)[:cut]
            flags = np.repeat(hot, size)[:cut]
            out = t.slice(0, cut).set_column(0, "hot", pa.array(flags)).filter(pa.array(keep))
            return out, t.slice(cut)

        for batch in batches:
            done = batch.column("done")
            t = pa.Table.from_batches([batch.filter(done)])
            if len(t):
                yield from t.select(RUN_KEPT).add_column(0, "hot", pa.nulls(len(t), pa.bool_())).to_batches()
            batch = batch.filter(pa.compute.invert(done))
            if not batch.num_rows:
                continue
            key, same, d, u, start = columns = [batch.column(c).to_numpy() for c in ("key", "same", "d", "u", "start")]
            first = _new([key, same], last and last[:2])
            twin = ~_new(columns, last)
            last = [c[-1] for c in columns]
            none = pa.nulls(batch.num_rows, pa.bool_())
            t = pa.Table.from_arrays([none, *[batch.column(c) for c in ("key", "d", "u", "start", "n")]], [c.split()[0] for c in RUN.split(", ")])
            yield from t.filter(pa.array(~first & ~twin)).to_batches()
            t = t.filter(pa.array(first))
            if held is not None and len(held):
                t = pa.concat_tables([held, t])
            if len(t):
                out, held = judge(t, False)
                yield from out.combine_chunks().to_batches()
        if held is not None and len(held):
            out, _ = judge(held, True)
            yield from out.combine_chunks().to_batches()

    return table.mapInArrow(trimmed(run), RUN)


CONTEXT = "key long, d long, u long, start long, n long, bytes binary"


def _contexts(docs: DataFrame, found: DataFrame, spec: LongMatches) -> DataFrame:
    """The bytes of runs; of hot ones a row for each window, its fingerprint as key, where it is the first of its kind in
    its batch, and else a row with no key, for it is settled."""
    lists = found.groupBy("d", "u").agg(F.collect_list(F.struct("key", "start", "n", "hot")).alias("runs"))
    joined = docs.join(lists, ["d", "u"]).select("d", "u", "text", "runs")

    def run(batches):
        for batch in batches:
            keys, ds, us, starts, ns, texts = [], [], [], [], [], []
            windows = []
            for d, u, t, r in zip(*[batch.column(i) for i in range(4)], strict=True):
                raw, d, u = t.as_py().encode(), d.as_py(), u.as_py()
                r = r.values.to_pylist()
                hot = [x for x in r if x["hot"]]
                for x in r:
                    if not x["hot"]:
                        s = x["start"]
                        keys.append(x["key"]), ds.append(d), us.append(u), starts.append(s), ns.append(x["n"])
                        texts.append(raw[s : s + x["n"] - 1 + spec.length])
                for x in hot:
                    s = x["start"]
                    part = fingerprints(np.frombuffer(raw[s : s + x["n"] - 1 + spec.length], np.uint8), spec.length)
                    windows += [(d, u, s + i, h) for i, h in enumerate(part.view(np.int64).tolist())]
            if keys:
                yield _batch(CONTEXT, keys, ds, us, starts, ns, texts)
            if windows:
                windows = sorted(set(windows))  # a row of docs that is there twice counts once
                d, u, s, h = zip(*windows, strict=True)
                first, seen = [], set()
                for x in h:
                    first.append(x if x not in seen else None)
                    seen.add(x)
                yield _batch(CONTEXT, first, d, u, s, [1] * len(s), [None] * len(s))

    return joined.mapInArrow(trimmed(run), CONTEXT)


def _spans(d, u, start, windows, dup, length):
    """Maximal stretches of marked windows within each row, as spans of bytes; `windows` counts a row's windows."""
    row = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    i = np.flatnonzero(dup)
    if not len(i):
        return None
    new = np.concatenate([[True], (i[1:] != i[:-1] + 1) | (row[i[1:]] != row[i[:-1]])])
    a, b = i[new], i[np.concatenate([new[1:], [True]])]
    r = row[a]
    return _batch(SPAN, d[r], u[r], start[r] + at[a], start[r] + at[b] + length)


def _matches(rows: DataFrame, spec: LongMatches) -> DataFrame:
    """Spans of windows that occurred before, of contexts in document order."""

    def run(batches):
        levels, common, held, size, last = SuffixLevels(spec.length), Levels(), [], 0, None

        def flush():
            nonlocal held, size, last
            t = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            key, d, u, start, n = (t.column(c).to_numpy() for c in ("key", "d", "u", "start", "n"))
            place = np.stack([key, d, u, start])  # a row of docs that is there twice comes twice
            twin = np.concatenate([[last is not None and (place[:, 0] == last).all()], (place[:, 1:] == place[:, :-1]).all(axis=0)])
            last = place[:, -1]
            if twin.any():
                t = t.filter(pa.array(~twin))
                key, d, u, start, n = (x[~twin] for x in (key, d, u, start, n))
            if not len(key):
                return None
            texts = t.column("bytes")
            single = texts.is_null().to_numpy()
            lengths = np.where(single, 0, n + spec.length - 1)
            data = np.frombuffer(b"".join(x for x in texts.to_pylist() if x), np.uint8)
            begin = np.cumsum(lengths) - lengths
            row = np.repeat(np.arange(len(n)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            alone, again = single[row], np.zeros(len(row), bool)
            if alone.any():
                again[alone] = common.repeats(key.view(np.uint64)[row[alone]])
            if not alone.all():
                at = (begin[row] + within)[~alone]
                again[~alone] = levels.repeats(data, at, fingerprints(data, spec.length)[at])
            return _spans(d, u, start, n, again, spec.length)

        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                held.append(part)
                size += pa.compute.sum(part.column("n")).as_py() or 0
                if size >= BATCH_WINDOWS:
                    if out := flush():
                        yield out
        if held and (out := flush()):
            yield out

    return rows.mapInArrow(trimmed(run), SPAN)


def _keyed(docs: DataFrame, work: Workspace) -> DataFrame:
    """d: the id, null as the smallest; u: 0, but for ids with different texts a hash of the text, which tells their rows
    apart."""
    lowest = F.lit(-(2**63)).cast("long")
    docs = docs.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), lowest))
    hashes = docs.select("d", F.xxhash64("text").alias("h")).groupBy("d").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    shared = work.save(hashes.filter("low < high").select("d", F.lit(True).alias("shared")), "shared")
    if not shared.limit(1).count():
        return docs.withColumn("u", F.lit(0).cast("long"))
    return docs.join(shared, "d", "left").withColumn("u", F.when(F.col("shared"), F.xxhash64("text")).otherwise(0)).drop("shared")


def _dealt_by_anchor(found: DataFrame, tasks: int, spec: LongMatches) -> DataFrame:
    """Runs in the partition of their anchor, sorted by it, bytes and place; those that are done anywhere, last. On the way
    start and n are one number."""
    bits = spec.length.bit_length()
    place = F.shiftleft("start", bits).bitwiseOR(F.col("n")).alias("place")
    where = F.when(F.col("done"), F.xxhash64("d", "place")).otherwise(F.col("key"))
    dealt = found.select("done", "key", "same", "d", "u", place).repartition(tasks, where)
    dealt = dealt.sortWithinPartitions("done", "key", "same", "d", "u", "place")
    n = F.col("place").bitwiseAND(F.lit((1 << bits) - 1)).alias("n")
    return dealt.select("done", "key", "same", "d", "u", F.shiftright("place", bits).alias("start"), n)


def repeated_spans(docs: DataFrame, work: Workspace, spec: LongMatches = LongMatches()) -> DataFrame:
    """Spans (d, u, start, stop) of bytes to remove, overlapping, of docs with d, u and text."""
    n = partitions(docs.sparkSession)
    sparse = _dealt_by_anchor(_runs(docs.select("d", "u", "text"), spec), n, spec)
    found = work.save(_repeated(sparse, spec), "runs")
    work.drop()
    settled = found.filter("hot IS NULL").select("d", "u", "start", (F.col("start") + F.col("n") - 1 + spec.length).alias("stop"))
    texts = docs.select("d", "u", "text")
    rows = _contexts(texts, found.filter("NOT hot"), spec)
    if found.filter("hot").limit(1).count():
        # saved, for which of a batch's windows is the first depends on what the batch holds
        windows = work.save(_contexts(texts, found.filter("hot"), spec), "windows")
        again = windows.filter("key IS NULL").select("d", "u", "start", (F.col("start") + spec.length).alias("stop"))
        settled = settled.unionByName(again)
        rows = rows.unionByName(windows.filter("key IS NOT NULL"))
    first = rows.repartition(n, "key").sortWithinPartitions("d", "u", "start", "key")
    out = work.save(_matches(first, spec).unionByName(settled), "spans")
    work.drop("runs", "windows")
    return out


def _cut(raw: bytes, spans) -> tuple[bytes, int, int]:
    """What is left, the number of bytes removed and of maximal removed runs."""
    if not spans:
        return raw, 0, 0
    kept, at, removed, count = [], 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            count += 1
            if end >= 0:
                removed += end - begin
            kept.append(raw[at:a])
            begin, end = a, b
        elif b > end:
            end = b
        at = end
    kept.append(raw[at:])
    return b"".join(kept), removed + end - begin, count


def remove_repeats(docs: DataFrame, doc_id="doc_id", text="text", spec: LongMatches = LongMatches()) -> DataFrame:
    """The rows of docs as `_row`, n_bytes, n_removed, n_spans, kept_sha256 and kept (the text left, as valid UTF-8:
    what a cut leaves of a character goes).

    Removed is each byte covered by a string of `length` bytes that starts earlier too: in a document of smaller id, or
    earlier in the same one. A null text counts as empty and a null id as the smallest. Rows of one id and text are one
    document and get one result; rows of one id but different texts are ordered by a hash of the text. An empty table
    gives an empty result. Texts of any length are handled in segments.
    """
    small_batches(docs.sparkSession)
    work = Workspace(docs.sparkSession, "suffixes")
    source = _keyed(pick_row(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit(""))), work)
    spans = repeated_spans(source.select("d", "u", "text"), work, spec)
    lists = spans.groupBy("d", "u").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = source.select("_row", "d", "u", "text").join(lists, ["d", "u"], "left").select("_row", "text", "spans")
    row_type = joined.schema["_row"].dataType.simpleString()

    def run(batches):
        names = ["_row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for t, s in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = t.as_py().encode()
                pairs = zip(*[x.to_pylist() for x in s.values.flatten()], strict=True) if s.is_valid else ()
                left, removed, count = _cut(raw, list(pairs))
                out.append((len(raw), removed, count, hashlib.sha256(left).hexdigest(), left.decode(errors="ignore")))
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *arrays], names)

    return joined.mapInArrow(trimmed(run), f"_row {row_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")


def without_repeats(docs: DataFrame, spec: LongMatches = LongMatches()) -> DataFrame:
    """docs with repeated strings removed from their texts; documents of which nothing is left go; the same columns."""
    out = remove_repeats(docs, spec=spec).filter("n_removed = 0 OR length(trim(kept)) > 0")
    return unrow(out, docs.columns, text="kept")
