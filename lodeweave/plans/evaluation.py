"""Evaluation queries: languages ask for documents, labels say which are relevant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluation as E
from .registry import Tables, query

_RANKED = "k AS (SELECT lang AS query, source AS path, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents QUALIFY rank <= 20)"
_GOLD = "g AS (SELECT DISTINCT lang AS query, source AS path FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND lang <> 'es')"


def ranking(t: Tables) -> DataFrame:
    """The 20 longest documents of each language, ranked."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id"))
    return t.documents.select(F.col("lang").alias("query"), F.col("source").alias("path"), "doc_id", rank.alias("rank")).where("rank <= 20")


def gold(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels.where("quality = 0"), "doc_id").where("lang <> 'es'")
    return rows.select(F.col("lang").alias("query"), F.col("source").alias("path")).distinct()


@query("eval_ranking", f"""WITH {_RANKED}, {_GOLD}, r AS (SELECT query, count(*) AS relevant FROM g GROUP BY query), f AS (SELECT query, path, min(rank) AS rank FROM k GROUP BY ALL),
    h AS (SELECT f.query, f.rank FROM f JOIN g USING (query, path)), q AS (SELECT DISTINCT query FROM k), e AS (SELECT q.query, r.relevant, k FROM q LEFT JOIN r ON r.query = q.query, (VALUES (1), (3), (6)) AS x(k)),
    a AS (SELECT e.query, e.k, any_value(e.relevant) AS relevant, count(h.rank) AS n, min(h.rank) AS best, sum(1 / log2(h.rank + 1)) AS dcg FROM e LEFT JOIN h ON h.query = e.query AND h.rank <= e.k GROUP BY e.query, e.k)
    SELECT query, k, CASE WHEN relevant IS NOT NULL THEN round(n / relevant, 6) END AS recall, CASE WHEN relevant IS NOT NULL THEN round(coalesce(1 / best, 0), 6) END AS reciprocal_rank,
        CASE WHEN relevant IS NOT NULL THEN round(coalesce(dcg / list_sum(list_transform(range(1, least(k, relevant) + 1), lambda i: 1 / log2(i + 1))), 0), 6) END AS ndcg FROM a""")
def eval_ranking(t: Tables) -> DataFrame:
    return E.ranking_metrics(ranking(t).select("query", "rank", "path"), gold(t), [1, 3, 6])


@query("eval_duplicate_rate", f"WITH {_RANKED} SELECT query, round(1 - count(DISTINCT path) / count(*), 6) AS duplicate_rate FROM k GROUP BY query")
def eval_duplicate_rate(t: Tables) -> DataFrame:
    return E.duplicate_rates(ranking(t))


@query("eval_grouping_sets", """SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, CAST(sum(quality) AS BIGINT) AS good, round(sum(quality) / nullif(count(*), 0), 6) AS share
    FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang), (source))""")
def eval_grouping_sets(t: Tables) -> DataFrame:
    """AGG-25: overall, by category and by partition in one pass."""
    rows = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id")
    out = rows.groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("good"))
    return out.select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", "good", F.round(F.col("good") / F.col("n"), 6).alias("share"))


@query("eval_binding_quality", """SELECT count(*) AS labelled, count(*) FILTER (quality = 1) AS expected, count(*) FILTER (toxic = 0) AS definite, count(*) FILTER (quality = 1 AND toxic = 0) AS correct,
    round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (toxic = 0), 0), 6) AS precision, round(count(*) FILTER (quality = 1 AND toxic = 0) / nullif(count(*) FILTER (quality = 1), 0), 6) AS recall FROM labels""")
def eval_binding_quality(t: Tables) -> DataFrame:
    """EVL-08 and AGG-22, with labels as verdicts."""
    rows = t.labels.agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("quality") == 1).alias("expected"), F.count_if(F.col("toxic") == 0).alias("definite"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("correct"))
    return rows.withColumns({"precision": F.round(F.col("correct") / F.nullif(F.col("definite"), F.lit(0)), 6), "recall": F.round(F.col("correct") / F.nullif(F.col("expected"), F.lit(0)), 6)})


@query("occurrence_numbers", "SELECT doc_id, CAST(row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS INTEGER) AS occurrence FROM documents")
def occurrence_numbers(t: Tables) -> DataFrame:
    return E.occurrence(t.documents.select("doc_id", F.md5("text").alias("digest")), ["digest"], ["doc_id"]).select("doc_id", "occurrence")


@query("jaccard_of_sources", """WITH s AS (SELECT source, list_sort(list(DISTINCT lang)) AS l FROM documents GROUP BY source)
    SELECT a.source AS a, b.source AS b, round(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))), 6) AS similarity FROM s a JOIN s b ON a.source < b.source AND a.source = 'src0'""")
def jaccard_of_sources(t: Tables) -> DataFrame:
    """SET-07: one source's languages against every other's."""
    from ..operators.memory import jaccard

    sets = t.documents.groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("l"))
    own = sets.where("source = 'src0'").head()
    others = sets.where("source > 'src0'").withColumn("x", F.lit(own["l"] if own else []).cast("array<string>"))
    return others.select(F.lit("src0").alias("a"), F.col("source").alias("b"), F.round(jaccard("x", "l"), 6).alias("similarity"))


@query("set_equality_violations", "(SELECT doc_id, 'document' AS side FROM documents EXCEPT ALL SELECT doc_id, 'document' FROM labels) UNION ALL (SELECT doc_id, 'label' FROM labels EXCEPT ALL SELECT doc_id, 'label' FROM documents)")
def set_equality_violations(t: Tables) -> DataFrame:
    """SET-04 and SET-05: what either side has more of."""
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    return a.exceptAll(b).select("doc_id", F.lit("document").alias("side")).unionByName(b.exceptAll(a).select("doc_id", F.lit("label").alias("side")))
