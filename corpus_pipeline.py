"""The corpus pipeline: stages that each apply one operator to all that the stage before kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and decides for good: what it drops or masks,
the next one doesn't see. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.llm import decontamination, secrets, toxicity
from lodeweave.llm.near_duplicates import near_duplicates
from lodeweave.llm.packing import best_fit_pack, token_pieces
from lodeweave.llm.queries import held_out
from lodeweave.llm.shared import stored, table, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the toxicity model, learned from the labelled rows that aren't held out, predicts as toxic. A null text counts as empty; repeated rows go or stay together; without labels of both classes all rows stay."""
    labels = spark.read.parquet(table(sf_dir, "labels")).where(~held_out())
    return toxicity.keep_ordinary(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group that links of similarity 0.8 join; of rows that repeat a document, one.

    Rows without a doc_id are documents of their own and come last; of texts that share a doc_id, the one of smallest SHA-256 comes first.
    Where either occurs, rows are numbered in that order in a stored table, and the numbers decide.
    """
    texts = docs.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    if texts.where("doc_id IS NULL OR low <> high").limit(1).count():
        names, key = docs.columns, "near_duplicates_row"
        order = [F.col("doc_id").asc_nulls_last(), F.sha2("text", 256).asc_nulls_first()]
        rows = stored(docs.orderBy(*order).withColumn(key, F.monotonically_increasing_id()), "numbered")
        found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), percent=80)
        kept = found.where("doc_id = component_id").select(F.col("doc_id").alias(key))
        rows = rows.join(kept, key, "left_semi").select(*names)
        return rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(rows.where("doc_id IS NULL"))
    found = near_duplicates(docs, percent=80)
    repeated = found.groupBy("doc_id").count().where("count > 1").limit(1).count()
    docs = without(docs, found.where("doc_id <> component_id").select("doc_id"))
    return docs.dropDuplicates(["doc_id", "text"]) if repeated else docs


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null texts and items, and items without words, meet nothing; each row is judged alone; without items all rows stay."""
    return decontamination.without_items(docs, spark.read.parquet(table(sf_dir, "benchmark")))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks credentials that look live and belong to few owners; widely copied examples stay. All rows stay, also those without a doc_id or text; repeated rows are masked alike."""
    _, judged = secrets.secret_scan(docs.withColumn("repo", F.concat_ws("/", "source", "lang")), "repo", "source")
    masked = secrets.redact(docs, judged)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into training sequences. A null text counts as empty and takes one id; repeated rows are packed each; an empty table gives no sequence."""
    return best_fit_pack(token_pieces(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the tokeniser; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
