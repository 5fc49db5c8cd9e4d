"""Training-order materialisation by a keyed Feistel permutation (operator 3)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partition_id, stored
from .tokens import END_OF_DOCUMENT, Encoder

LENGTH = 2048
KEY = 0x5EED
#: Sequences in a shard: 16 MB files of 4097-byte records.
SHARD = 4096
ROUNDS = 6
#: Parts whose first numbers (16 bytes each) are broadcast; more are joined by a shuffle.
MOST_PARTS = 1 << 20

_SEQUENCES = "part long, place long, doc_ids array<long>, tokens binary"
_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser by shifts and odd multipliers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel_slots(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1 fixed by ``key``: a balanced Feistel network on the smallest even number of bits that holds n, walked on until the value falls below n (at most four steps on average)."""
    half = np.uint64(max(1, -(-max(1, n - 1).bit_length() // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) & _MASK) for r in range(rounds)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & low
            for k in keys:
                left, right = right, left ^ (_mix(right + k) & low)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, length: int = LENGTH, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Fixed-length sequences of the partitions' token streams (16-bit ids, a separator after each document); the last of a partition is filled up with separators.

    ``doc_ids``: the documents that have tokens or a separator in the sequence, in order. A null text gives its separator alone.
    """
    size = 2 * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = Encoder().encode, partition_id(), 0
        end = np.array([separator], "<u2").tobytes()
        held, ends = bytearray(), []

        def cut(last: bool):
            nonlocal held, ends, place
            if last and len(held) % size:
                held += end * ((size - len(held) % size) // 2)
            whole, k, rows = len(held) // size * size, 0, []
            for a in range(0, whole, size):
                own = []
                while k < len(ends):
                    own.append(ends[k][1])
                    if ends[k][0] > a + size:  # runs on into the next sequence
                        break
                    k += 1
                rows.append((part, place, own, bytes(held[a : a + size])))
                place += 1
            held, ends = held[whole:], [(p - whole, d) for p, d in ends[k:]]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()), strict=True)], ["part", "place", "doc_ids", "tokens"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += np.frombuffer(encode(text), "<u4").astype("<u2").tobytes() + end
                ends.append((len(held), doc))
                if len(held) >= 256 * size:
                    yield cut(False)
        yield cut(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SEQUENCES)


def assign_slots(sequences: DataFrame, key: int = KEY) -> tuple[DataFrame, int]:
    """``sequences`` (part, place from 0 without gaps in each part, anything more) with ``slot``, a permutation of 0..n-1; and n.

    Sequences are numbered through by part and place: parts' counts are summed up in order (one small row per part),
    which gives each part its first number. The same rows, layout and key give the same order.
    """
    counts = sequences.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).head()

    @F.pandas_udf("long")
    def slot(index):
        return index.__class__(feistel_slots(index.to_numpy(), total, key))

    firsts = counts.select("part", "first")
    numbered = sequences.join(F.broadcast(firsts) if parts <= MOST_PARTS else firsts, "part")
    return numbered.withColumn("slot", slot(F.col("first") + F.col("place"))).drop("part", "place", "first"), total


def _squeezed(tokens):
    import zstandard

    return tokens.map(zstandard.ZstdCompressor(level=3).compress)


def _whole(tokens):
    import zstandard

    return tokens.map(zstandard.ZstdDecompressor().decompress)


def write_shards(sequences: DataFrame, total: int, path: str, shard: int = SHARD) -> None:
    """Writes ``sequences`` (slot, tokens of one length) as flat shard files: file k holds slots k*shard onwards, in order.

    Slots are dense, so a slot's shard is known without sampling: each range of slots goes straight to its own partition,
    its tokens compressed on the way. Each record is the sequence's bytes and one line feed, so slot s stands at byte (s mod shard) * stride of its file.
    """
    records = sequences.select((F.col("slot") / shard).cast("int").alias("shard"), "slot", F.pandas_udf(_squeezed, "binary")("tokens").alias("tokens"))
    records = records.repartitionById(max(1, -(-total // shard)), F.col("shard")).sortWithinPartitions("slot")
    records.select(F.pandas_udf(_whole, "binary")("tokens").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str, length: int = LENGTH, shard: int = SHARD, since: int = 0) -> DataFrame:
    """The sequences of slots ``since`` onwards: slot, shard, byte_offset, tokens. Shards before it aren't opened; within its shard, reading begins at its record."""
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").load(f"{path}/part-*")
    number = F.regexp_extract(F.col("path"), r"part-(\d+)-[^/]*$", 1).cast("long")
    files = files.withColumn("shard", number).where((F.col("shard") >= since // shard) & (F.col("length") > 0))
    first = F.when(F.col("shard") == since // shard, F.lit(since % shard)).otherwise(F.lit(0))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, skip, raw in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw, k, at = memoryview(raw.as_buffer()), number.as_py(), range(skip.as_py() * stride, len(raw.as_buffer()), stride)
                for some in (at[i : i + 512] for i in range(0, len(at), 512)):
                    yield pa.RecordBatch.from_arrays([pa.array([k * shard + a // stride for a in some], pa.int64()), pa.array([k] * len(some), pa.int64()), pa.array(list(some), pa.int64()), pa.array([bytes(raw[a : a + stride - 1]) for a in some], pa.binary())], ["slot", "shard", "byte_offset", "tokens"])

    return files.select("shard", first.cast("long").alias("skip"), "content").mapInArrow(records, "slot long, shard long, byte_offset long, tokens binary")


def training_order(docs: DataFrame, path: str, length: int = LENGTH, key: int = KEY, shard: int = SHARD) -> DataFrame:
    """Cuts ``docs`` (doc_id, text) into sequences, writes them in training order under ``path`` and returns what each slot holds: slot, doc_ids, ids_crc32 (as cut, before any shuffle)."""
    slotted, total = assign_slots(stored(token_sequences(docs, length), "sequences", level=6), key)
    write_shards(slotted.select("slot", "tokens"), total, path, shard)
    return slotted.select("slot", "doc_ids", F.crc32("tokens").alias("ids_crc32"))
