"""Token files: ids as blocks of a static range asymmetric numeral system with shared frequency tables.

A file set is a folder with the tables `blocks` and `shared`. `shared` has the frequency of each id and the number of
ids of each shard. Each row of `blocks` is a block, readable by itself: whole documents in ascending order, their ids
coded in LANES interleaved states. It begins with a state per lane and holds the 32-bit words that the states shed.
Checkpoints repeat the states and the place in the words at every CHECKPOINT steps, so that a long block can be read
in parts; the CRC-32 of the ids tells whether what was read is what was written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import Workspace, partitions, pick, small_batches, trimmed
from loomspark.llm.tokens import ids

LANES, SCALE = 1024, 20
#: A block is closed at the first document end after so many ids. Steps between checkpoints.
BLOCK, CHECKPOINT = 196_608, 64
#: Blocks of more checkpoint intervals are read in parts of so many.
INTERVALS = 4
LOW = np.uint64(1 << 31)
W32 = np.uint64(32)


class Table:
    """Frequencies made to sum to 2**SCALE; every id that occurs keeps one slot at least."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        total, slots = int(counts.sum()), 1 << SCALE
        if len(symbols) > slots:
            raise ValueError("more ids than slots")
        freq = np.maximum(1, (counts.astype(np.float64) * (slots / max(1, total))).astype(np.int64))
        order = np.argsort(-freq, kind="stable")
        over = int(freq.sum()) - slots
        while over and len(freq):  # the largest give or take what is over
            if over < 0:
                freq[order[0]] -= over
                break
            take = np.minimum(freq[order] - 1, -(-over // len(freq)) + freq[order] // 64)
            take = np.minimum(take, np.maximum(0, over - (np.cumsum(take) - take)))
            freq[order] -= take
            over -= int(take.sum())
        size = int(symbols.max()) + 1 if len(symbols) else 1
        self.freq = np.zeros(size, np.uint64)
        self.freq[symbols] = freq.astype(np.uint64)
        self.start = np.cumsum(self.freq) - self.freq
        self._slots = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            kind = np.uint16 if len(self.freq) <= 1 << 16 else np.uint32
            self._slots = np.repeat(np.arange(len(self.freq), dtype=kind), self.freq.astype(np.int64))
        return self._slots


def encode(symbols: np.ndarray, table: Table) -> tuple[bytes, bytes]:
    """Payload (states, then words) and checkpoints (for every CHECKPOINT steps: words read so far, states)."""
    n = len(symbols)
    steps = -(-n // LANES)
    padded = np.zeros(steps * LANES, np.int64)
    padded[:n] = symbols
    padded[n:] = symbols[0] if n else 0
    padded = padded.reshape(steps, LANES)
    freq, start = table.freq[padded], table.start[padded]
    most = freq << np.uint64(31 + 32 - SCALE)
    x = np.full(LANES, LOW, np.uint64)
    shed, marks = [], []
    scale = np.uint64(SCALE)
    for s in range(steps - 1, -1, -1):
        f = freq[s]
        full = x >= most[s]
        if full.any():
            shed.append(x[full].astype(np.uint32))
            x[full] >>= W32
        else:
            shed.append(np.empty(0, np.uint32))
        q = x // f
        x = (q << scale) + (x - q * f) + start[s]
        if s and s % CHECKPOINT == 0:
            marks.append((s, x.copy()))
    sizes = np.array([len(w) for w in shed][::-1], np.int64)
    read = np.concatenate([[0], np.cumsum(sizes)])
    words = np.concatenate(shed[::-1]) if shed else np.empty(0, np.uint32)
    checkpoints = b"".join(int(read[s]).to_bytes(8, "little") + states.astype("<u8").tobytes() for s, states in marks[::-1])
    return x.astype("<u8").tobytes() + words.astype("<u4").tobytes(), checkpoints


def decode(payload: bytes, n: int, table: Table, checkpoints: bytes = b"", first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of the checkpoint intervals `first` to `last` (all by default) of a block of n ids."""
    steps = -(-n // LANES)
    head = 8 * LANES
    words = np.frombuffer(payload, "<u4", offset=head).astype(np.uint64)
    if first:
        at = (first - 1) * (8 + head)
        place = int.from_bytes(checkpoints[at : at + 8], "little")
        x = np.frombuffer(checkpoints, "<u8", LANES, at + 8).astype(np.uint64)
    else:
        place, x = 0, np.frombuffer(payload, "<u8", LANES).astype(np.uint64)
    begin = first * CHECKPOINT
    end = steps if last is None else min(steps, (last + 1) * CHECKPOINT)
    out = np.empty((max(0, end - begin), LANES), np.uint32)
    slots, freq, start = table.slots, table.freq, table.start
    scale, mask = np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    for s in range(end - begin):
        slot = x & mask
        symbol = slots[slot]
        out[s] = symbol
        x = freq[symbol] * (x >> scale) + slot - start[symbol]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << W32) | words[place : place + len(empty)]
            place += len(empty)
    return out.reshape(-1)[: max(0, min(n, end * LANES) - begin * LANES)]


RAW = "shard int, first_id long, doc_ids array<long>, doc_lengths array<long>, n_ids long, ids binary"
BLOCKS = "shard int, first_id long, doc_ids array<long>, doc_lengths array<long>, n_ids long, ids_crc32 long, payload binary, checkpoints binary"


def _raw_blocks(docs: DataFrame, path: str, doc_id: str, text: str, end_id: int, words: bool) -> DataFrame:
    """Range-partitions by id and encodes in order; first_id counts ids within the shard, the partition's number.

    Ids are stored in two bytes where all of the vocabulary fit. A shard's last row is no block: n_ids is null, and
    doc_ids has the ids that occur in the shard, doc_lengths how often, so that counting them reads these columns only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")  # the hash splits an id that many rows have
    source = pick(docs, doc_id=doc_id, text=text).repartitionByRange(max(partitions(spark), 1), *order)
    source = source.sortWithinPartitions(*order)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        tokenizer, shard, first = ids(path, words), TaskContext.get().partitionId(), 0
        kind = "<u2" if tokenizer.size <= 1 << 16 and end_id < 1 << 16 else "<u4"
        names, lengths, held, size, total = [], [], [], 0, np.zeros(0, np.int64)

        def row(*values):
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.split()[0] for c in RAW.split(", ")])

        def block():
            nonlocal total
            data = np.frombuffer(b"".join(held), "<u4")
            part = np.bincount(data, minlength=len(total))
            part[: len(total)] += total
            total = part
            return row(shard, first, names, lengths, len(data), data.astype(kind).tobytes())

        for batch in batches:
            for d, data in zip(batch.column("doc_id").to_pylist(), tokenizer.encode_all(batch.column("text").to_pylist()), strict=True):
                data += end
                names.append(d), lengths.append(len(data) // 4), held.append(data)
                size += len(data)
                if size >= 4 * BLOCK:
                    yield block()
                    first += size // 4
                    names, lengths, held, size = [], [], [], 0
        if held:
            yield block()
        some = np.flatnonzero(total)
        if len(some):
            yield row(shard, first + size // 4, some, total[some], None, b"")

    return source.mapInArrow(trimmed(run), RAW)


def write_token_files(docs: DataFrame, path: str, doc_id="doc_id", text="text", end_id: int = 2, words=False) -> str:
    """Encodes all documents with the tokenizer at `path`, an end id after each, and gives the folder of the files.

    A null text is an empty one: its end id alone. Ids may be null or repeat; nulls come first, repeated ones stand
    side by side. An empty table gives empty files. Frequencies count all ids. What goes to the driver is a number for
    each id of the vocabulary and for each shard.
    """
    work = Workspace(docs.sparkSession, "tokens")
    raw = work.save(_raw_blocks(docs, path, doc_id, text, end_id, words), "raw")
    work.drop()

    occur = F.explode(F.arrays_zip(F.col("doc_ids").alias("id"), F.col("doc_lengths").alias("n"))).alias("x")
    counts = raw.filter("n_ids IS NULL").select(occur).groupBy("x.id").agg(F.sum("x.n").alias("n"))
    counts = work.save(counts.repartition(1).sortWithinPartitions("id"), "shared")
    shared = docs.sparkSession.sparkContext.broadcast(_read_table(counts))

    def run(batches):
        table = shared.value
        for batch in batches:
            coded = []
            for ids_, n in zip(batch.column("ids"), batch.column("n_ids").to_pylist(), strict=True):
                data = ids_.as_buffer()
                data = np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4").astype("<u4")
                coded.append((zlib.crc32(data), *encode(data, table)))
            crc, payload, marks = zip(*coded, strict=True) if coded else ((), (), ())
            arrays = [batch.column(c) for c in ("shard", "first_id", "doc_ids", "doc_lengths", "n_ids")]
            arrays += [pa.array(crc, pa.int64()), pa.array(payload, pa.binary()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCKS.split(", ")])

    work.save(raw.filter("n_ids IS NOT NULL").mapInArrow(trimmed(run), BLOCKS), "blocks")
    work.drop("raw")
    return work.root


def _read_table(counts: DataFrame) -> Table:
    pdf = counts.toPandas()
    return Table(pdf["id"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64))


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of CRC-32, lowest power in the highest bit; a is not 0."""
    out, bit = 0, 1 << 31
    while a:
        if a & bit:
            out ^= b
            a ^= bit
        bit >>= 1
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc32(parts) -> int:
    """The CRC-32 of byte strings put together, of pairs of each one's CRC-32 and size."""
    total = 0
    for crc, size in parts:
        shift, power = 1 << 31, 1 << 23  # x**0 and x**8
        while size:
            if size & 1:
                shift = _times(power, shift)
            power, size = _times(power, power), size >> 1
        total = _times(shift, total) ^ crc
    return total


PARTS = (
    "shard int, first_id long, ids_crc32 long, part int, n_ids long, payload binary, docs array<int>, doc_ids array<long>, "
    "doc_lengths array<long>"
)
FRAGMENTS = "shard int, first_id long, ids_crc32 long, part int, part_ids long, part_crc32 long, doc int, doc_id long, n long, crc32 long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], [c for c, _ in fields])


def _parts(blocks: DataFrame, intervals: int) -> DataFrame:
    """Blocks as parts of at most `intervals` checkpoint intervals, each with its states, its words and what documents
    have in it."""

    def run(batches):
        head, step = 8 * LANES, intervals * LANES * CHECKPOINT
        for batch in batches:
            for row in batch.to_pylist():
                payload, marks, n = row["payload"], row["checkpoints"], row["n_ids"]
                begins = list(range(0, n, step))
                places, states = [0], [payload[:head]]
                for i in range(1, len(begins)):
                    at = (i * intervals - 1) * (8 + head)
                    places.append(int.from_bytes(marks[at : at + 8], "little"))
                    states.append(marks[at + 8 : at + 8 + head])
                places.append((len(payload) - head) // 4)
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                for i, begin in enumerate(begins):
                    end = min(n, begin + step)
                    docs = np.flatnonzero((starts < end) & (ends > begin))
                    lengths = np.minimum(ends[docs], end) - np.maximum(starts[docs], begin)
                    words = payload[head + 4 * places[i] : head + 4 * places[i + 1]]
                    names = [row["doc_ids"][d] for d in docs]
                    yield _batch(
                        [(row["shard"], row["first_id"], row["ids_crc32"], i, end - begin, states[i] + words, docs.tolist(), names, lengths.tolist())], PARTS
                    )

    return blocks.mapInArrow(run, PARTS)


def _read_in_parts(blocks: DataFrame, shared, base: dict, intervals: int) -> DataFrame:
    """As read_token_files, of long blocks: their parts are decoded in tasks of their own, from their checkpoints."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = decode(row["payload"], row["n_ids"], shared.value).astype("<u4").tobytes()
                at, out = 0, []
                same = (row["shard"], row["first_id"], row["ids_crc32"], row["part"], row["n_ids"], zlib.crc32(data))
                for doc, d, n in zip(row["docs"], row["doc_ids"], row["doc_lengths"], strict=True):
                    out.append((*same, doc, d, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
                    at += n
                yield _batch(out, FRAGMENTS)

    def whole(table):
        rows = table.sort_by([("part", "ascending"), ("doc", "ascending")]).to_pylist()
        parts = {r["part"]: (r["part_crc32"], 4 * r["part_ids"]) for r in rows}
        shard, first = rows[0]["shard"], rows[0]["first_id"]
        if joined_crc32(parts.values()) != rows[0]["ids_crc32"]:
            raise ValueError(f"shard {shard}, id {first}: the checksum doesn't match")
        docs: dict[int, list] = {}
        for r in rows:
            docs.setdefault(r["doc"], []).append(r)
        at, out = base[shard] + first, []
        for _, found in sorted(docs.items()):
            n = sum(r["n"] for r in found)
            crc = joined_crc32([(r["crc32"], 4 * r["n"]) for r in found]) if len(found) > 1 else found[0]["crc32"]
            out.append((found[0]["doc_id"], at, n, crc))
            at += n
        return pa.Table.from_batches([_batch(out, READ)])

    parts = _parts(blocks, intervals).repartition(max(1, partitions(blocks.sparkSession)), "shard", "first_id", "part")
    return parts.mapInArrow(run, FRAGMENTS).groupBy("shard", "first_id").applyInArrow(whole, READ)


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(spark: SparkSession, folder: str, intervals: int = INTERVALS) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the blocks.

    Blocks of more than `intervals` checkpoint intervals are decoded in parts. A block whose ids don't match its checksum
    fails the job.
    """
    small_batches(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    shared = spark.sparkContext.broadcast(_read_table(spark.read.parquet(f"{folder}/shared")))
    sums = blocks.groupBy("shard").agg(F.sum("n_ids"), F.max("n_ids")).collect()  # two numbers for each shard
    totals, most = {r[0]: r[1] for r in sums}, intervals * LANES * CHECKPOINT
    base, before = {}, 0
    for shard in sorted(totals):
        base[shard], before = before, before + totals[shard]

    def run(batches):
        table = shared.value
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                symbols = decode(row["payload"], row["n_ids"], table)
                data = symbols.astype("<u4").tobytes()
                if zlib.crc32(data) != row["ids_crc32"]:
                    raise ValueError(f"shard {row['shard']}, id {row['first_id']}: the checksum doesn't match")
                at = 0
                for d, n in zip(row["doc_ids"], row["doc_lengths"], strict=True):
                    out.append((d, base[row["shard"]] + row["first_id"] + at, n, zlib.crc32(data[4 * at : 4 * (at + n)])))
                    at += n
            columns = list(zip(*out, strict=True)) or [()] * 4
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    if all(r[2] <= most for r in sums):
        return blocks.mapInArrow(trimmed(run), READ)
    short = blocks.filter(F.col("n_ids") <= most).mapInArrow(trimmed(run), READ)
    return short.unionByName(_read_in_parts(blocks.filter(F.col("n_ids") > most), shared, base, intervals))
