"""Best-fit packing by hierarchical residual packing (operator 10)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partition_id, stored
from .tokens import Encoder

CAPACITY = 2048
#: Bins with at most this many free places count as nearly full and are emitted at once: a thousandth of a bin at most is lost by it.
SLACK = 2
#: Groups that meet in one round.
FAN_IN = 8
#: Bins of a group that are ranked together; what a task sorts at once.
BLOCK = 1 << 16
#: Bits of a bin's id: its place in its group and its group; the rest is the round.
BIN_BITS, GROUP_BITS = 34, 24

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, filled long"
_PLAN = "group long, open boolean, filled long, first long, last long, bin long, per long, offset long"


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit over lengths in decreasing order: each item's bin and offset, each bin's filled length.

    ``free`` has a bit for every residual that some open bin has, so the fullest bin that still takes an item is its lowest set bit from the item's length on.
    """
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), []
    free, stacks = 0, [[] for _ in range(capacity + 1)]
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        if fits := free >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                free &= ~(1 << room)
        else:
            room, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += n
        if rest := room - n:
            stacks[rest].append(b)
            free |= 1 << rest
    return bins, offsets, filled


def best_fit_counts(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, ...]], list[tuple[int, ...]]]:
    """``best_fit`` of so many items of each length, whose equals are not told apart: the work grows with the lengths there are, not with the items.

    First: (length, first, last, bin, per, offset): of that length's items, numbered from 0, first to last (exclusive) go to bins from ``bin`` on, ``per`` items
    to each, the first of them at ``offset``. Second: (bin, n, filled): n bins from ``bin`` on that have room left.
    """
    placed, stacks, free, opened = [], [[] for _ in range(capacity + 1)], 0, 0
    for length, count in sorted(lengths.items(), reverse=True):
        rank = 0
        while rank < count:
            if fits := free >> length:
                room = length + (fits & -fits).bit_length() - 1
                low, n = stacks[room].pop()
                if not stacks[room]:
                    free &= ~(1 << room)
            else:
                room, low, n = capacity, opened, -(-(count - rank) // (capacity // length))
                opened += n
            most = room // length
            whole = min(n, (count - rank) // most)
            rest = min(count - rank - whole * most, most) if whole < n else 0
            for bins, per in ((whole, most), (int(rest > 0), rest), (n - whole - (rest > 0), 0)):
                if not bins:
                    continue
                if per:
                    placed.append((length, rank, rank + bins * per, low, per, capacity - room))
                    rank += bins * per
                if left := room - per * length:
                    stacks[left].append((low, bins))
                    free |= 1 << left
                low += bins
    return placed, [(low, n, capacity - room) for room, own in enumerate(stacks) for low, n in own]


def _bin_id(level: int, group: int) -> int:
    """Of a group's first bin."""
    return (level << (BIN_BITS + GROUP_BITS)) | (group << BIN_BITS)


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of every document's ids (``doc_id``, ``text``), each with its place in a bin of its own partition.

    A document's ids end with id 0; those beyond ``capacity`` are cut so that only the first piece is shorter.
    A null text counts as empty: one piece holding id 0 alone. Repeated rows are packed each on its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = Encoder().encode, []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + b"\0\0\0\0"
                total, at, k = len(ids) // 4, 0, 0
                n = total % capacity or capacity
                while at < total:
                    rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)])))
                    at, k, n = at + n, k + 1, capacity
        bins, offsets, filled = best_fit([r[3] for r in rows], capacity)
        part = partition_id()
        for at in range(0, len(rows), 50_000):
            some = list(zip(*rows[at : at + 50_000], strict=True))
            own = bins[at : at + 50_000]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(x, t) for x, t in zip(some, types, strict=True)]
            columns += [pa.array([part] * len(own), pa.int64()), pa.array([_bin_id(0, part) + b for b in own], pa.int64()), pa.array(offsets[at : at + 50_000], pa.int64()), pa.array([filled[b] for b in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "bin", "offset", "filled"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


def _merge(level: int, capacity: int):
    def run(key: tuple, items: pa.Table) -> pa.Table:
        group = key[0].as_py()
        placed, left = best_fit_counts(dict(zip(items.column("filled").to_pylist(), items.column("n").to_pylist(), strict=True)), capacity)
        base = _bin_id(level, group)
        rows = [(group, False, length, first, last, base + low, per, offset) for length, first, last, low, per, offset in placed]
        rows += [(group, True, filled, 0, n, base + low, 0, 0) for low, n, filled in left]
        kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 6]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], ["group", "open", "filled", "first", "last", "bin", "per", "offset"])

    return run


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN) -> DataFrame:
    """Packs what ``token_pieces`` gives into sequences of at most ``capacity`` tokens.

    Every partition has packed its own pieces. Bins that are not nearly full then go, as items, to rounds in which ``fan_in`` groups
    meet, until one group is left. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Items of one length are alike, so a round's task reads how many a group has of each length (``capacity`` rows at most) and
    says which ranks go where; items are ranked in blocks of bounded size and look their place up. Only lengths and bin ids move; no item is left out.
    """
    pieces = stored(pieces, "pieces")
    parts = pieces.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).head()[0]
    bins = pieces.where(F.col("offset") == 0).select("bin", "filled", F.col("part").alias("group"))
    placed, level, unit = None, 0, ["child", "block", "filled"]
    while parts > 1:
        level, parts = level + 1, -(-parts // fan_in)
        block = F.floor(F.col("bin").bitwiseAND(F.lit((1 << BIN_BITS) - 1)) / BLOCK)
        items = bins.where(F.col("filled") < capacity - slack)
        items = items.select("bin", "filled", F.col("group").alias("child"), F.floor(F.col("group") / fan_in).cast("long").alias("group"), block.alias("block"))
        counts = stored(items.groupBy("group", *unit).agg(F.count(F.lit(1)).alias("n")), f"counts{level}")
        earlier = Window.partitionBy("group", "filled").orderBy("child", "block").rowsBetween(Window.unboundedPreceding, -1)
        begins = counts.select(*unit, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        totals = counts.groupBy("group", "filled").agg(F.sum("n").alias("n"))
        plan = stored(totals.groupBy("group").applyInArrow(_merge(level, capacity), _PLAN), f"plan{level}")
        rank = F.col("before") + F.row_number().over(Window.partitionBy(*unit).orderBy("bin")) - 1
        ranked = items.join(begins, unit).select("group", "filled", "bin", rank.alias("rank"))
        spots = plan.where("NOT open").withColumnRenamed("bin", "low")
        own = F.col("rank") - F.col("first")
        moves = ranked.join(spots, ["group", "filled"]).where("rank >= first AND rank < last")
        moves = stored(moves.select("bin", (F.col("low") + F.floor(own / F.col("per"))).alias("root"), (F.col("offset") + own % F.col("per") * F.col("filled")).alias("shift")), f"moves{level}")
        if placed is None:
            placed = moves
        else:
            onward = moves.select(F.col("bin").alias("root"), F.col("root").alias("next"), F.col("shift").alias("more"))
            placed = placed.join(onward, "root", "left").select("bin", F.coalesce("next", "root").alias("root"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            placed = stored(placed, f"placed{level}")
        stretch = plan.where("open").select("group", "filled", "bin", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") - 1, F.lit(BLOCK).cast("long"))).alias("at"))
        bins = stretch.select("group", "filled", "bin", F.explode(F.sequence("at", F.least(F.col("at") + BLOCK, "last") - 1)).alias("at")).select((F.col("bin") + F.col("at")).alias("bin"), "filled", "group")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if placed is None:
        return pieces.select(*names, F.col("bin").alias("sequence_id"), "offset")
    return pieces.join(placed, "bin", "left").select(*names, F.coalesce("root", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
