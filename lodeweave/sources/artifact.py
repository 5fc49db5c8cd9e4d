"""Sealed artifacts and work that resumes: what a table's parts hold is stated by digests, and batches that are done are never done again (SRC-21, SRC-22)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces of a row's digest that are summed up apart: eight of 32 bits.
LANES = 8


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's canonical JSON: keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _lanes(digest: Column) -> list[Column]:
    """The sums of a digest's pieces: the same for any order of rows, and another one if a row is changed, added or lost."""
    return [F.sum(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")) for i in range(LANES)]


def sealed(rows: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """SRC-21: the manifest of a table: part, n, digest. One aggregate that combines map-side, so a part's size doesn't matter."""
    sums = [s.alias(f"lane_{i}") for i, s in enumerate(_lanes(row_digest(columns)))]
    found = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"), *sums)
    text = F.concat_ws("/", F.col("n").cast("string"), *(F.col(f"lane_{i}").cast("string") for i in range(LANES)))
    return found.select(part, "n", F.sha2(text, 256).alias("digest"))


def verified(rows: DataFrame, manifest: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """SRC-21: part and verdict of what is there against a manifest: intact, changed (as many rows, others), count, missing or unknown."""
    now = sealed(rows, part, columns).select(F.col(part).alias("now_part"), F.col("n").alias("now_n"), F.col("digest").alias("now_digest"), F.lit(True).alias("there"))
    both = manifest.withColumn("stated", F.lit(True)).join(now, F.col(part).eqNullSafe(F.col("now_part")), "full_outer")
    verdict = F.when(F.col("there").isNull(), "missing").when(F.col("stated").isNull(), "unknown").when(F.col("n") != F.col("now_n"), "count").when(F.col("digest") != F.col("now_digest"), "changed").otherwise("intact")
    return both.select(F.when(F.col("stated"), F.col(part)).otherwise(F.col("now_part")).alias(part), verdict.alias("verdict"))


def done_batches(path: str, like: DataFrame) -> set[int]:
    """The batches under ``path`` that were written to their end, told by the mark that Spark's writer leaves last."""
    spark = like.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return set()
    names = [s.getPath().getName() for s in files.listStatus(root)]
    return {int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and files.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))}


def resumed(rows: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], batches: int, most: int | None = None) -> tuple[DataFrame, list[int]]:
    """SRC-22: ``work`` done on ``rows`` batch by batch (by a hash of ``key``), each stored under ``path`` as it is done, and which batches this call did, ``most`` at the most.

    A call goes on where earlier ones stopped: a batch that is there whole is left alone, one that was broken off is done anew. The table is what all calls have stored.
    """
    done, own = done_batches(path, rows), []
    number = F.pmod(F.xxhash64(key), F.lit(batches))
    for k in range(batches):
        if k in done:
            continue
        if most is not None and len(own) >= most:
            break
        work(rows.where(number == k)).write.mode("overwrite").parquet(f"{path}/batch={k}")
        own.append(k)
    return rows.sparkSession.read.parquet(path), own
