"""Token counts by separator scan over flat, unindexed token files (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import partition_id
from .tokens import END_OF_DOCUMENT, Encoder

#: Tokens in a block of a file; any number works, documents may begin, end or run on anywhere in it.
BLOCK = 1 << 16
#: Blocks whose prefix sums one task works out; a file of any length is scanned as a tree of two levels.
SPAN = 1 << 12

_BLOCKS = "file long, block long, tokens binary, doc_ids array<long>"
_SCANNED = "file long, block long, n long, separators array<int>"


def token_blocks(docs: DataFrame, block: int = BLOCK, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """The flat token stream of each partition of ``docs`` (doc_id, text): unsigned 16-bit ids, a separator after every document, cut into blocks of equal size.

    ``doc_ids`` names the documents whose separators a block holds; the scan doesn't read it. A null text gives its separator alone.
    A text that spells out the separator is encoded as ordinary text, so every separator ends a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, at = Encoder().encode_ordinary, partition_id(), 0
        end, held = np.array([separator], "<u2").tobytes(), bytearray()
        ends: list[tuple[int, int]] = []
        size = 2 * block

        def cut(last: bool):
            nonlocal at, held, ends
            whole = len(held) if last else len(held) // size * size
            rows, k = [], 0
            for a in range(0, whole, size):
                own = []
                while k < len(ends) and ends[k][0] < a + size:
                    own.append(ends[k][1])
                    k += 1
                rows.append((bytes(held[a : a + size]), own))
            ends = [(p - whole, d) for p, d in ends[k:]]
            held = held[whole:]
            out = pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.int64()), pa.array(range(at, at + len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["file", "block", "tokens", "doc_ids"])
            at += len(rows)
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += np.frombuffer(encode(text), "<u4").astype("<u2").tobytes()
                ends.append((len(held), doc))
                held += end
                if len(held) >= 16 * size:
                    yield cut(False)
        yield cut(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _BLOCKS)


def read_token_files(spark: SparkSession, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks of the flat binary token files under ``path``, each below the 2 GB that a binary column holds; ``file`` is the path's hash."""
    size = block * width
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    at = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size).cast("int")))
    return files.select(F.xxhash64("path").alias("file"), "path", "content", at.alias("block")).select("file", F.col("block").cast("long").alias("block"), F.expr(f"substring(content, block * {size} + 1, {size})").alias("tokens"), "path")


def separator_scan(blocks: DataFrame, separator: int = END_OF_DOCUMENT, width: int = 2, span: int = SPAN) -> DataFrame:
    """One row per document of each file: file, ordinal (from 0), start (its first token's place), n_tokens, complete.

    ``blocks`` has file, block (from 0, in order) and tokens (little-endian ids of ``width`` bytes). Each block is searched
    on its own; where its documents begin comes from an exclusive prefix scan over what the blocks before it hold: tokens,
    separators and the last separator's place. Adjacent separators give a document of 0 tokens; tokens after a file's last separator
    are a last document with ``complete`` false. A null or empty block holds nothing; a file without tokens gives no row.
    """
    kind = {1: "u1", 2: "<u2", 4: "<u4", 8: "<u8"}[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for block in batch.column(2):
                raw = block.as_buffer()
                ids = np.frombuffer(raw, kind) if raw is not None else np.zeros(0, kind)
                found.append(np.flatnonzero(ids == separator).astype("i4"))
                sizes.append(len(ids))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("i4")
            places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*found, np.zeros(0, "i4")]).astype("i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), places], ["file", "block", "n", "separators"])

    part = blocks.select(F.col("file").cast("long").alias("file"), F.col("block").cast("long").alias("block"), "tokens").mapInArrow(search, _SCANNED)
    part = part.withColumns({"span": F.floor(F.col("block") / span), "k": F.size("separators").cast("long")})
    inside = Window.partitionBy("file", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
    total = Window.partitionBy("file", "span")
    part = part.withColumns({"at": F.coalesce(F.sum("n").over(inside), zero), "seen": F.coalesce(F.sum("k").over(inside), zero)})
    part = part.withColumn("end", F.when(F.col("k") > 0, F.col("at") + F.element_at("separators", -1)))
    part = part.withColumn("before", F.max("end").over(inside))
    spans = part.groupBy("file", "span").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("end").alias("end"))
    across = Window.partitionBy("file").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"base": F.coalesce(F.sum("n").over(across), zero), "base_seen": F.coalesce(F.sum("k").over(across), zero)})
    spans = spans.withColumn("base_before", F.coalesce(F.max(F.col("base") + F.col("end")).over(across), none))
    whole = Window.partitionBy("file")
    spans = spans.withColumn("last", F.max("span").over(whole)).select("file", "span", "base", "base_seen", "base_before", "last")
    part = part.withColumn("last_block", F.max("block").over(total)).join(spans, ["file", "span"])
    start = F.coalesce(F.col("base") + F.col("before"), F.col("base_before")) + 1
    places = F.transform("separators", lambda x: F.col("base") + F.col("at") + x)
    tail_end = F.col("base") + F.col("at") + F.col("n")
    is_last = (F.col("span") == F.col("last")) & (F.col("block") == F.col("last_block"))
    part = part.select("file", (F.col("base_seen") + F.col("seen")).alias("seen"), start.alias("start"), places.alias("places"), F.when(is_last, tail_end).alias("tail"))
    part = part.withColumn("ends", F.concat("places", F.when(F.col("tail").isNotNull() & (F.col("tail") > F.coalesce(F.element_at(F.col("places"), F.when(F.size("places") > 0, -1)) + 1, F.col("start"))), F.array("tail")).otherwise(F.array().cast("array<long>"))))
    rows = part.select("file", "seen", "start", "places", F.posexplode("ends").alias("i", "stop"))
    first = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("places", F.col("i") - 1) + 1)
    return rows.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), first.alias("start"), (F.col("stop") - first).alias("n_tokens"), (F.col("i") < F.size("places")).alias("complete"))
