"""The numbered operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, merkle, personal, secrets, toxicity, warc
from .decontamination import contaminated
from .near_duplicates import near_duplicates
from .packing import best_fit_pack, token_pieces
from .repeats import remove_repeats
from .separators import separator_scan, token_blocks
from .shared import shared_path, stored, table
from .topk import exact_top_k, quantised
from .training_order import read_shards, training_order


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents' flat token stream, scans it for separators and names each count's document: doc_id, n_tokens, start, file, ordinal."""
    blocks = stored(token_blocks(spark.read.parquet(table(sf_dir, "documents"))), "token-stream")
    counts = separator_scan(blocks.select("file", "block", "tokens"))
    names = blocks.select("file", "block", F.size("doc_ids").alias("n"), "doc_ids")
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = names.withColumn("before", before).select("file", "before", F.posexplode("doc_ids").alias("i", "doc_id"))
    names = names.select("file", (F.col("before") + F.col("i")).alias("ordinal"), "doc_id")
    return counts.join(names, ["file", "ordinal"]).select("doc_id", "n_tokens", "start", "file", "ordinal")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its doc_id as text leaves 1 when divided by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's score; a null text counts as empty, repeated rows are scored each, an empty table gives none. Without labels of both classes every score is 0."""
    docs, labels = (spark.read.parquet(table(sf_dir, name)) for name in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(~held_out()))
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents' sequences as shards in training order and reads them back: slot, shard, byte_offset, doc_ids, ids_crc32, intact (the record read is the one that was cut)."""
    path = shared_path(spark, "shards")
    order = training_order(spark.read.parquet(table(sf_dir, "documents")), path)
    read = read_shards(spark, path).select("slot", "shard", "byte_offset", F.crc32("tokens").alias("read_crc32"))
    return order.join(read, "slot", "left").select("slot", "shard", "byte_offset", "doc_ids", "ids_crc32", (F.col("read_crc32") == F.col("ids_crc32")).alias("intact"))


def op4_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every row's words; a null text has none, of repeated rows the later ones lose what the first one has, an empty table gives none."""
    found = remove_repeats(spark.read.parquet(table(sf_dir, "documents")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_super_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's group of near copies; a row without a doc_id is kept where no row with one is in its group."""
    found = near_duplicates(spark.read.parquet(table(sf_dir, "documents")), percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op6_cgk_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and where."""
    return contaminated(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "benchmark")))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of every query; fewer candidates give fewer rows, equal scores go to the smaller vec_id. Rows that share a vec_id are one query (with the best five that any of its vectors has) and candidates each, so a vec_id can stand more than once."""
    vectors = quantised(spark.read.parquet(table(sf_dir, "embeddings")).select("vec_id", "embedding"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is the owner, its source and language together the repository. A null text counts as empty, repeated rows are searched each, an empty table gives none."""
    docs = spark.read.parquet(table(sf_dir, "documents")).withColumn("repo", F.concat_ws("/", "source", "lang"))
    spans, _ = secrets.secret_scan(docs, "repo", "source")
    return spans.withColumn("spans", secrets.spans_text("spans", secrets.KINDS))


def op9_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's personal data; a null text counts as empty, repeated rows are searched each, an empty table gives none."""
    found = personal.personal_data(spark.read.parquet(table(sf_dir, "documents")))
    return found.withColumn("spans", secrets.spans_text("spans", personal.KINDS))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place; a null text counts as empty, which is one piece of one id, repeated rows are packed each, an empty table gives none."""
    return best_fit_pack(token_pieces(spark.read.parquet(table(sf_dir, "documents"))))


def op11_subset_zeta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters of documents, their survivors and losses at each step of each order, for each source (null: the empty string); an empty table gives no rows."""
    return filter_audit.audit(spark.read.parquet(table(sf_dir, "documents")), spark.read.parquet(table(sf_dir, "labels")))


def op12_gzip_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as whole-file gzip archives, rewritten with a member for each record and an index, and read back. Null pages are empty payloads; repeated rows are records each."""
    return warc.write_and_read(spark.read.parquet(table(sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' leaves, trees and proofs, each proof folded over a leaf that is tampered with for every fifth id (its text lower-cased). Rows that share a doc_id are ordered by their leaves, which alone tell them apart."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(spark.read.parquet(table(sf_dir, "documents")), {"text": lower}, tampered)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_separator_scan": op1_separator_scan,
    "op2_toxicity": op2_toxicity,
    "op3_training_order": op3_training_order,
    "op4_fm_index": op4_fm_index,
    "op5_super_min_hash": op5_super_min_hash,
    "op6_cgk_lsh": op6_cgk_lsh,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_anchor_expansion": op9_anchor_expansion,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_subset_zeta": op11_subset_zeta,
    "op12_gzip_normaliser": op12_gzip_normaliser,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE_SQL: dict[str, str] = {
    "op11_subset_zeta": filter_audit.ORACLE_SQL,
    "op12_gzip_normaliser": warc.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
    "op7_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
