"""Spans of texts with nested structure: every line goes to the innermost element that owns it, stretches of one owner are cut where its own parts end (SRC-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stacked(lines: DataFrame, key: str) -> DataFrame:
    """``lines`` (key, line, step, owns, name) with what is open on each: ``depth``, ``inner`` (line that opens the innermost element), ``owner`` (line that opens the innermost element that owns lines; 0: none), ``owner_name``, ``inside`` (elements open within the owner).

    ``step`` is 1 where an element begins, -1 where one ends, else 0; the line that ends an element still belongs to it. An end that nothing has opened is a plain line, an
    element that nothing ends goes to the last line. The innermost element at a depth is the last one opened there, which is one running maximum for each depth: no stack is carried.
    """
    text = Window.partitionBy(key).orderBy("line")
    so_far, earlier = text.rowsBetween(Window.unboundedPreceding, 0), text.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("sum", F.sum("step").over(so_far))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(earlier), F.lit(0)))
    rows = rows.withColumn("low", low).withColumn("step", F.when(F.col("sum") < F.col("low"), 0).otherwise(F.col("step")))
    rows = rows.withColumn("after", F.sum("step").over(so_far))  # without the ends that nothing had opened
    rows = rows.withColumn("depth", F.when(F.col("step") == -1, F.col("after") + 1).otherwise(F.col("after")))

    def opened(depth: str, opens: Column, *what: str) -> Column:
        """The last row so far that opened this depth."""
        return F.max(F.when(opens, F.struct("line", *what))).over(Window.partitionBy(key, depth).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))

    begins = F.col("step") == 1
    rows = rows.withColumn("top", opened("depth", begins, "owns"))
    own_step = F.when(F.col("top.owns") & (F.col("depth") > 0), F.col("step")).otherwise(0)
    rows = rows.withColumn("own_step", own_step).withColumn("owners", F.sum("own_step").over(so_far))
    rows = rows.withColumn("owner_depth", F.when(F.col("own_step") == -1, F.col("owners") + 1).otherwise(F.col("owners")))
    rows = rows.withColumn("held", opened("owner_depth", F.col("own_step") == 1, "name", "depth"))
    owned = F.col("owner_depth") > 0
    return rows.select(
        key, "line", "step", "depth", F.when(F.col("depth") > 0, F.col("top.line")).otherwise(0).alias("inner"), F.when(owned, F.col("held.line")).otherwise(0).alias("owner"),
        F.when(owned, F.col("held.name")).alias("owner_name"), (F.col("depth") - F.when(owned, F.col("held.depth")).otherwise(0)).alias("inside"),
    )


def _cuts(ends: Column, start: Column, most: int) -> Column:
    """The lines at which a stretch from ``start`` is cut, of ``ends``, where it may be, the last of which is its own: each part takes as many ends as fit ``most`` lines, or one."""
    none = F.lit(None).cast("int")
    first = F.struct(start.cast("int").alias("start"), none.alias("last"), F.array().cast("array<int>").alias("cuts"))

    def cut(at: Column, state: Column, last: Column) -> Column:
        return F.struct((at + 1).cast("int").alias("start"), last.alias("last"), F.concat(state["cuts"], F.array(at)).alias("cuts"))

    def take(state: Column, end: Column) -> Column:
        fits = end - state["start"] + 1 <= most
        after = end - state["last"] <= most  # behind a cut at the last end that did fit
        both = F.struct((end + 1).cast("int").alias("start"), none.alias("last"), F.concat(state["cuts"], F.array(state["last"], end)).alias("cuts"))
        return (
            F.when(fits, F.struct(state["start"].alias("start"), end.alias("last"), state["cuts"].alias("cuts")))
            .when(state["last"].isNull(), cut(end, state, none))
            .when(after, cut(state["last"], state, end))
            .otherwise(both)
        )

    return F.aggregate(ends, first, take, lambda s: F.when(s["last"].isNull(), s["cuts"]).otherwise(F.concat(s["cuts"], F.array(s["last"]))))


def owned_spans(lines: DataFrame, key: str, most: int = 120) -> DataFrame:
    """SRC-14: key, owner (the line that opens it; 0: the text itself), owner_name, start_line, end_line, part and parts (of the owner), oversized.

    ``lines`` as for ``stacked``, numbered from 1 without gaps. Every line is in one span. A stretch of an owner's lines is cut only where one of its immediate parts
    ends: a plain line, or the end of an element that owns nothing; a part that is longer than ``most`` lines stays whole and is ``oversized``.
    """
    rows = stacked(lines, key)
    text = Window.partitionBy(key).orderBy("line")
    fresh = F.when(F.col("owner") == F.lag("owner").over(text), 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("stretch", F.sum("fresh").over(text.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ((F.col("step") == 0) & (F.col("inside") == 0)) | ((F.col("step") == -1) & (F.col("inside") == 1))
    stretches = rows.groupBy(key, "stretch", "owner", "owner_name").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.collect_list(F.when(ends, F.col("line"))).alias("ends"))
    may = F.array_sort(F.array_union("ends", F.array("last")))
    cuts = stretches.select(key, "owner", "owner_name", "first", F.explode(_cuts(F.transform(may, lambda x: x.cast("int")), F.col("first"), most)).alias("end_line"))
    own = Window.partitionBy(key, "owner").orderBy("end_line")
    cuts = cuts.withColumn("start_line", F.greatest("first", F.coalesce(F.lag("end_line").over(own), F.lit(0)) + 1))
    return cuts.select(
        key, F.col("owner").cast("int").alias("owner"), "owner_name", F.col("start_line").cast("int").alias("start_line"), "end_line", F.row_number().over(own).alias("part"),
        F.count(F.lit(1)).over(Window.partitionBy(key, "owner")).cast("int").alias("parts"), (F.col("end_line") - F.col("start_line") + 1 > most).alias("oversized"),
    )


#: Elements of a page that own their lines, and those that are a part of the one around them; others, which pages leave open, are plain lines.
OWNERS = ("html", "head", "body", "nav", "ul", "li", "article", "div", "footer", "section", "table")
PARTS = ("a", "title", "style", "script", "h1", "h2", "h3")


def page_lines(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Each tag and each text between tags as a line: key, line, content, name, step, owns."""
    pieces = F.filter(F.split(F.regexp_replace(html, "(<[^>]*>)", "\n$1\n"), "\n"), lambda x: x != "")
    rows = pages.select(key, F.posexplode(pieces).alias("at", "content"))
    name = F.regexp_extract("content", "^</?([a-z0-9]+)", 1)
    known = name.isin(*OWNERS, *PARTS)
    step = F.when(known & F.col("content").startswith("</"), -1).when(known, 1).otherwise(0)
    return rows.select(key, (F.col("at") + 1).alias("line"), "content", name.alias("name"), step.alias("step"), name.isin(*OWNERS).alias("owns"))
