"""Tables as versioned JSON lines, records with a header, and publication by one rename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.store import shared_path


def encoded(rows: DataFrame, version: int) -> DataFrame:
    """SRC-17 to SRC-19: each row as canonical JSON: keys in order, nulls kept, and ``schema_version``."""
    fields = sorted([*rows.columns, "schema_version"])
    whole = rows.withColumn("schema_version", F.lit(version))
    return whole.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def decoded(texts: DataFrame, schema: str, version: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``texts`` (value) that hold exactly the schema's keys and this version, and the texts that don't, with why: not_json, keys or version. One parse for both."""
    shape = F.from_json("value", f"struct<{schema}, schema_version: int>")
    names = sorted([*StructType.fromDDL(schema).names, "schema_version"])
    keys = F.array_sort(F.json_object_keys("value"))
    why = F.when(keys.isNull(), "not_json").when(keys != F.array(*(F.lit(n) for n in names)), "keys").when(~F.coalesce(shape["schema_version"] == version, F.lit(False)), "version")
    read = texts.withColumns({"row": shape, "why": why})
    return read.where("why IS NULL").select("row.*").drop("schema_version"), read.where("why IS NOT NULL").select("value", "why")


def published(rows: DataFrame, path: str) -> str:
    """SRC-23: writes ``rows`` beside ``path`` and renames the finished folder, so that readers see all of it or nothing; an existing snapshot is never touched. Returns the path."""
    spark: SparkSession = rows.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, staging = hadoop.Path(path), hadoop.Path(f"{path}.staging")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        raise FileExistsError(path)
    rows.write.mode("overwrite").parquet(str(staging.toString()))
    if not files.rename(staging, target):
        raise OSError(f"could not publish {path}")
    return path


def record_text(header: Column, body: Column) -> Column:
    """SRC-27: a record file's text: a JSON header between two lines of dashes, then the body."""
    return F.concat(F.lit("---\n"), header, F.lit("\n---\n"), body)


def parsed_records(texts: DataFrame, schema: str, most_bytes: int = 65536) -> DataFrame:
    """SRC-27: ``texts`` (value, anything more) with the header's fields, ``body`` and ``why`` it can't be used: too_large, no_header, bad_header or hash (the header's ``content_hash`` is not the body's)."""
    head, body = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    rows = texts.withColumns({"head": head, "body": body}).withColumn("row", F.from_json("head", f"struct<{schema}>"))
    why = F.when(F.octet_length("value") > most_bytes, "too_large").when(F.col("head") == "", "no_header").when(F.json_object_keys("head").isNull(), "bad_header").when(~F.coalesce(F.col("row.content_hash") == F.sha2("body", 256), F.lit(False)), "hash")
    return rows.withColumn("why", why).select(*texts.columns, "row.*", "body", "why").drop("value")


def written_and_read(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (value) written as text files in the shared folder and read again."""
    path = shared_path(rows.sparkSession, name)
    rows.write.text(path)
    return rows.sparkSession.read.text(path)
