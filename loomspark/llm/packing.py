"""Best-fit packing, certified by lower bounds from dual-feasible functions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import Workspace, pick, small_batches, trimmed
from loomspark.llm.tokens import ids

CAPACITY = 4096
#: Pieces that one packing task holds, about; and how many partitions exchange their gaps at a time.
GROUP_PIECES, FAN_IN = 150_000, 16
#: Functions of the family that rounds.
ROUNDED = 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, path: str, doc_id="doc_id", text="text", end_id: int = 1, capacity: int = CAPACITY, words=True
) -> DataFrame:
    """Documents as ids and an end id, those longer than `capacity` cut into pieces of it.

    A null text is empty: a piece with the end id alone. Very long texts are encoded whole. Repeated rows, and rows of a
    null id, give their pieces each. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    source = pick(docs, doc_id=doc_id, text=text)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode = ids(path, words).encode_all
        for batch in batches:
            rows = []
            for d, data in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                data += end
                size = 4 * capacity
                for n, i in enumerate(range(0, len(data), size)):
                    piece = data[i : i + size]
                    rows.append((d, n, i // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return source.mapInArrow(trimmed(run), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The greatest bound of two families of dual-feasible functions.

    One counts lengths over capacity - k as whole bins, those under k as nothing, the others by their length; for every k
    up to half the capacity, with the middle ones one to a bin. The other rounds down to k-ths of a bin what is no whole
    number of (k + 1)-ths, for k up to ROUNDED.
    """
    if not len(lengths):
        return 0
    sizes, times = np.unique(lengths, return_counts=True)
    k = np.arange(1, ROUNDED + 1)[:, None]
    parts = (k + 1) * sizes
    worth = np.where(parts % capacity, parts // capacity * capacity, k * sizes)
    rounded = int((-(-(worth @ times) // (k[:, 0] * capacity))).max())
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number = np.concatenate([[0], np.cumsum(count)])  # number[i]: lengths below i
    total = np.concatenate([[0], np.cumsum(count * np.arange(capacity + 1))])
    k = np.arange(0, capacity // 2 + 1)
    half = capacity // 2 + 1
    big = number[-1] - number[capacity - k + 1]
    middle = number[capacity - k + 1] - number[half]
    middle_sum = total[capacity - k + 1] - total[half]
    small_sum = total[half] - total[k]
    rest = np.maximum(0, small_sum - (middle * capacity - middle_sum))
    return max(rounded, int((big + middle + -(-rest // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, and the number of bins. Each goes, longest first, to the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: a bin with r free places exists
    opened = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = free >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                free ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            if not rooms[left]:
                free |= 1 << left
            rooms[left].append(b)
    return bins, offsets, opened


def length_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """The lower bound of all sequences, from the histogram of lengths, which has `capacity` rows at most."""
    rows = pieces.groupBy("length").count().collect()
    full = sum(r["count"] for r in rows if r["length"] >= capacity)
    lengths = np.repeat([r["length"] for r in rows if r["length"] < capacity], [r["count"] for r in rows if r["length"] < capacity])
    return full + lower_bound(lengths.astype(np.int64), capacity)


def _emptiest(bins: np.ndarray, room: np.ndarray, quota: int, certified: bool) -> np.ndarray:
    """Marks the pieces of the emptiest bins with a gap, up to `quota` pieces. A certified partition can't do with fewer
    bins by itself: it opens the emptiest one only, which may fit into the gaps of others."""
    held = np.bincount(bins, minlength=len(room))
    order = np.argsort(-room, kind="stable")
    passed = (np.cumsum(held[order]) <= quota) & (room[order] > 0)
    if certified:
        passed[1:] = False
    out = np.zeros(len(room), bool)
    out[order[passed]] = True
    return out[bins]


def _repack(table: pa.Table, capacity: int, quota: int) -> pa.Table:
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    lengths = table.column("length").to_numpy()
    bins, offsets, opened = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(lengths, capacity)
    if opened > bound and "bin" in table.column_names:  # a repacking is kept if it needs fewer bins
        pairs = np.stack([table.column("was").to_numpy(), table.column("bin").to_numpy()])
        old, old_bins = np.unique(pairs, axis=1, return_inverse=True)
        if old.shape[1] <= opened:
            bins, offsets, opened = old_bins.reshape(-1), table.column("offset").to_numpy(), old.shape[1]
    room = capacity - np.bincount(bins, weights=lengths, minlength=opened).astype(np.int64)
    names = [c.split()[0] for c in PIECES.split(", ")]
    extra = {"part": table.column("part"), "bin": bins, "offset": offsets, "open": _emptiest(bins, room, quota, opened == bound)}
    extra |= {"group_bins": np.full(len(bins), opened), "group_bound": np.full(len(bins), bound)}
    return pa.table({n: table.column(n) for n in names} | extra)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id, offset, and group_bins and group_bound: how many sequences the partition needed in which the
    piece was last packed, and how many it needs at least; where they are equal, they are certified.

    Pieces of the full capacity are sequences by themselves. The others are dealt by hash into partitions of about
    `group_pieces`, each packed best fit decreasing and held against the lower bound of its lengths. Unless the whole
    meets its bound, FAN_IN partitions at a time exchange the pieces of their emptiest bins (certified ones those of one
    bin), which are packed anew, and so on until the bound is met or one group is left. A repacking that needs no fewer
    bins, and isn't certified, is dropped for the old one. Rows are dealt out by their place in the table too, so that
    repeated ids don't meet in one group: every group is of bounded size, and each round moves a FAN_IN-th of the pieces
    of the one before. An empty table gives an empty result; repeated rows are packed each by itself; ties go by id and
    piece.
    """
    work = Workspace(pieces.sparkSession, "packing")
    pieces = work.save(pieces, "pieces")
    bound = length_bound(pieces, capacity)
    short = pieces.filter(F.col("length") < capacity)
    n = short.count()
    groups = max(1, -(-n // group_pieces))
    quota = group_pieces // FAN_IN
    schema = f"{PIECES}, part long, bin long, offset long, open boolean, group_bins long, group_bound long"
    columns, extra = [c.split()[0] for c in PIECES.split(", ")], ("offset", "group_bins", "group_bound")

    def run(table: pa.Table) -> pa.Table:
        return _repack(table, capacity, quota)

    out = pieces.filter(F.col("length") >= capacity)
    out = out.select(*columns, (F.monotonically_increasing_id() + (1 << 62)).alias("sequence_id"), *[F.lit(x).cast("long").alias(c) for x, c in zip((0, 1, 1), extra, strict=True)])
    place = F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())  # pieces are saved: the same in every attempt
    dealt = short.withColumn("part", F.pmod(place, F.lit(groups)))
    packed = work.save(dealt.groupBy("part").applyInArrow(run, schema), "round0")
    used = pieces.count() - n + packed.filter("offset = 0").count()
    step = 0
    while True:
        last = groups == 1 or used == bound
        ids_ = F.lit(step << 57) + F.shiftleft("part", 24) + F.col("bin")
        settled = packed if last else packed.filter("NOT open")
        out = out.unionByName(settled.select(*columns, ids_.alias("sequence_id"), *extra))
        if last:
            return out
        step, groups = step + 1, -(-groups // FAN_IN)
        waiting = packed.filter("open").withColumn("was", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN))
        before = waiting.filter("offset = 0").count()
        packed = work.save(waiting.groupBy("part").applyInArrow(run, schema), f"round{step}")
        used += packed.filter("offset = 0").count() - before
