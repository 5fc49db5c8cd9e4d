"""Line, chunk and segment sources over tables of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines

SKIPPED = (".git", ".venv", "venv", "__pycache__", "node_modules")
PREFIX = "Python code:\n"


def scan_files(spark, root: str, pattern: str = "*.py") -> DataFrame:
    """SRC-01: path (under ``root``), content and length of every matching file, but for folders of tools and caches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    prefix = F.regexp_replace(F.lit(root.rstrip("/") + "/"), r"^file:/*", "/")
    plain = F.regexp_replace("path", r"^file:/*", "/")
    own = F.when(plain.startswith(prefix), F.substring(plain, F.length(prefix) + 1, F.length(plain))).otherwise(plain)
    files = files.select(own.alias("path"), "content", "length")
    return files.where(~F.exists(F.split("path", "/"), lambda part: part.isin(*SKIPPED)))


def numbered_lines(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line (from 1), content of every line; nothing is shuffled."""
    return texts.select(key, F.posexplode(lines(text)).alias("at", "content")).select(key, (F.col("at") + 1).alias("line"), "content")


def grep(texts: DataFrame, key: str, needle: str, limit: int, text: str = "text") -> DataFrame:
    """SRC-24: the first lines, by key and number, that hold a fixed string; texts without it are dropped before they are cut into lines."""
    found = numbered_lines(texts.where(F.col(text).contains(needle)), key, text).where(F.col("content").contains(needle))
    return found.orderBy(key, "line").limit(limit)


def grep_pattern(texts: DataFrame, path: str, key: list[str], pattern: str, glob: str, limit: int, case_sensitive: bool = True, text: str = "text") -> DataFrame:
    """SRC-24: the first ``limit`` lines, by key and number, in texts whose path a glob (* and ?) matches, that hold a pattern; ``truncated``: whether the limit was reached. Texts without it are dropped before they are cut into lines."""
    own = pattern if case_sensitive else f"(?i){pattern}"
    wanted = "^" + re.escape(glob).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    rows = texts.where(F.col(path).rlike(wanted) & F.col(text).rlike(own)).select(*key, F.posexplode(lines(text)).alias("at", "content"))
    found = rows.where(F.col("content").rlike(own)).select(*key, (F.col("at") + 1).alias("line"), "content").orderBy(*key, "line").limit(limit)
    return found.withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) >= limit)


def line_range(text: Column | str, first: int, last: int) -> Column:
    """SRC-25: lines first to last, joined again."""
    return F.array_join(F.slice(lines(text), first, last - first + 1), "\n")


def line_chunks(texts: DataFrame, key: str, most: int, text: str = "text") -> DataFrame:
    """SRC-14 for texts without inner structure: parts of at most ``most`` lines: key, part, start_line, end_line, content_hash. Each row is cut on its own."""
    own = lines(text)
    starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(most))).otherwise(F.array().cast("array<int>"))
    parts = texts.select(key, F.col(text).alias("body"), F.posexplode(starts).alias("part", "start_line"))
    body = F.slice(lines("body"), F.col("start_line"), F.lit(most))
    return parts.select(key, "part", "start_line", (F.col("start_line") + F.size(body) - 1).alias("end_line"), F.sha2(F.array_join(body, "\n"), 256).alias("content_hash"))


def cover_breaks(chunks: DataFrame, key: str) -> DataFrame:
    """FLT-12 and WIN-08: chunks that don't begin right after the one before."""
    before = F.lag("end_line").over(Window.partitionBy(key).orderBy("start_line", "part"))
    return chunks.withColumn("expected", F.coalesce(before, F.lit(0)) + 1).where("start_line <> expected").select(key, "part", "start_line", "expected")


def segments(texts: DataFrame, key: str, most: int = 1800, text: str = "text") -> DataFrame:
    """SRC-16 and WIN-06: windows of at most ``most`` characters with their prefix, cut after the last line feed inside if there is one: key, segment, segments (how many), start_offset, end_offset, text. An empty text gives one empty segment.

    One fold over a text's lines: lines are taken as long as they fit, a line that is longer than a window is cut where the window ends.
    """
    room = most - len(PREFIX)
    if room < 1:
        raise ValueError("most must leave room for the prefix")
    none = F.array().cast("array<int>")

    def take(state: Column, size: Column) -> Column:
        """A further line: what stands before it is cut off if both don't fit, and as much of it as fills whole windows."""
        end = F.least(state["at"] + size + 1, state["size"])
        cut = (end - state["start"] > room) & (state["at"] > state["start"])
        start = F.when(cut, state["at"]).otherwise(state["start"])
        filled = F.greatest(F.ceil((end - start) / room).cast("int") - 1, F.lit(0))
        cuts = F.concat(state["cuts"], F.when(cut, F.array(state["at"])).otherwise(none), F.when(filled > 0, F.transform(F.sequence(F.lit(1), F.greatest(filled, F.lit(1))), lambda i: start + i * room)).otherwise(none))
        return F.struct(end.alias("at"), (start + filled * room).alias("start"), state["size"].alias("size"), cuts.alias("cuts"))

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    zero = F.lit(0)
    first = F.struct(zero.alias("at"), zero.alias("start"), F.length("body").alias("size"), none.alias("cuts"))
    cuts = F.aggregate(F.transform(F.split("body", "\n"), lambda x: F.length(x)), first, take, lambda s: s["cuts"])
    rows = texts.select(key, body.alias("body")).withColumn("starts", F.concat(F.array(zero), cuts))
    rows = rows.select(key, "body", F.size("starts").alias("segments"), F.posexplode(F.arrays_zip(F.col("starts").alias("start_offset"), F.concat(cuts, F.array(F.length("body"))).alias("end_offset"))).alias("segment", "x"))
    window = F.substring(F.col("body"), F.col("x.start_offset") + 1, F.col("x.end_offset") - F.col("x.start_offset"))
    return rows.select(key, "segment", "segments", "x.start_offset", "x.end_offset", F.concat(F.lit(PREFIX), window).alias("text"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """SRC-26: what was added, removed or changed from one snapshot (key, digest) to another."""
    b, a = before.select(key, F.col(digest).alias("was")), after.select(key, F.col(digest).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("was") != F.col("is"), "changed")
    return b.join(a, key, "full_outer").withColumn("change", change).where("change IS NOT NULL").select(key, "change")
