"""Round trips through stores: graphs, chunks, indexes, records and tasks written as text and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import lines
from ..operators.store import shared_path
from ..sources import json_store as J
from ..sources.text_source import line_chunks
from . import graph as star
from .memory import _DAG, tasks
from .registry import Tables, query
from .source import _CHUNKS, _LINES


@query("graph_json_roundtrip", f"{star.BOTH} SELECT type, count(*) AS n, count(DISTINCT source) AS sources, min(target) AS first_target FROM edges GROUP BY type")
def graph_json_roundtrip(t: Tables) -> DataFrame:
    """SRC-18: every edge through the graph's JSON."""
    rows, _ = J.decoded(J.written_and_read(J.encoded(star.edges(t), 4), "graph-json"), "source: string, target: string, type: string", 4)
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.min("target").alias("first_target"))


@query("index_json_roundtrip", f"SELECT doc_id AS path, CAST(len({_LINES}) AS INTEGER) AS n_lines, sha256(text) AS content_hash FROM documents")
def index_json_roundtrip(t: Tables) -> DataFrame:
    """SRC-17: an index of all documents through its JSON."""
    index = t.documents.select(F.col("doc_id").alias("path"), F.size(lines("text")).alias("n_lines"), F.sha2("text", 256).alias("content_hash"))
    return J.decoded(J.written_and_read(J.encoded(index, 2), "index-json"), "path: bigint, n_lines: int, content_hash: string", 2)[0]


@query("chunk_json_rejects", f"""{_CHUNKS} SELECT CASE part WHEN 0 THEN 'accepted' WHEN 1 THEN 'version' WHEN 2 THEN 'keys' ELSE 'not_json' END AS verdict, count(*) AS n FROM c GROUP BY 1""")
def chunk_json_rejects(t: Tables) -> DataFrame:
    """SRC-19: chunks through their JSON, of which all but a text's first are spoilt, each later one in another way; what the reader accepts and refuses."""
    chunks = line_chunks(t.documents.select("doc_id", "text"), "doc_id", 20)
    shape = "doc_id: bigint, part: int, start_line: int, end_line: int, content_hash: string"
    good, other = J.encoded(chunks.where("part = 0"), 1), J.encoded(chunks.where("part = 1"), 9)
    short, broken = J.encoded(chunks.where("part = 2").drop("content_hash"), 1), J.encoded(chunks.where("part > 2"), 1).select(F.expr("left(value, 5)").alias("value"))
    rows, refused = J.decoded(J.written_and_read(good.unionByName(other).unionByName(short).unionByName(broken), "chunk-json"), shape, 1)
    accepted = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("verdict"), "n")
    return accepted.unionByName(refused.groupBy(F.col("why").alias("verdict")).agg(F.count(F.lit(1)).alias("n")))


@query("snapshot_publish", "SELECT o_orderstatus AS status, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus")
def snapshot_publish(t: Tables) -> DataFrame:
    """SRC-23: a snapshot of all orders, published by one rename and read from where it then is."""
    path = J.published(t.orders.select("o_orderkey", "o_orderstatus"), shared_path(t.spark, "snapshot"))
    return t.spark.read.parquet(path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@query("memory_records_roundtrip", """SELECT doc_id, CASE WHEN octet_length(encode(concat('---', chr(10), '{"content_hash":"', sha256(CASE WHEN lang = 'es' THEN 'x' ELSE text END), '","lang":"', lang, '"}', chr(10), '---', chr(10), text))) > 2000 THEN 'too_large' WHEN lang = 'es' AND text <> 'x' THEN 'hash' END AS why, lang, md5(text) AS body_md5 FROM documents""")
def memory_records_roundtrip(t: Tables) -> DataFrame:
    """SRC-27: documents as record files of 2000 bytes at most; Spanish ones carry a wrong hash."""
    head = F.to_json(F.struct(F.sha2(F.when(F.col("lang") == "es", "x").otherwise(F.col("text")), 256).alias("content_hash"), "lang"))
    texts = t.documents.select("doc_id", J.record_text(head, F.col("text")).alias("value"))
    return J.parsed_records(texts, "content_hash: string, lang: string", 2000).select("doc_id", "why", "lang", F.md5("body").alias("body_md5"))


@query("task_json_roundtrip", f"WITH {_DAG} SELECT t.id, t.done, coalesce(array_to_string(list_sort(list(d.needs) FILTER (d.needs IS NOT NULL)), ','), '') AS needs FROM t LEFT JOIN d ON d.id = t.id GROUP BY t.id, t.done")
def task_json_roundtrip(t: Tables) -> DataFrame:
    """SRC-28: every task with what it needs, one JSON record each, written and read."""
    rows, needs = tasks(t)
    listed = rows.join(needs.groupBy("id").agg(F.array_sort(F.collect_list("needs")).alias("needs")), "id", "left").select("id", "done", F.coalesce("needs", F.array().cast("array<bigint>")).alias("needs"))
    read, _ = J.decoded(J.written_and_read(J.encoded(listed, 1), "task-json"), "id: bigint, done: boolean, needs: array<bigint>", 1)
    return read.select("id", "done", F.array_join(F.transform("needs", lambda x: x.cast("string")), ",").alias("needs"))
