"""How filters interact: survivors of every subset of filters by a subset-zeta transform, steps of every order as differences (operator 11)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: More filters than this would make too many orders to list.
MOST_FILTERS = 6


def five_filters(text: str = "text") -> dict[str, Column]:
    """The failure conditions A to D of a text (null: empty); E, repeated texts, needs the whole table and is ``repeats``'."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * upper > 2 * F.length(t),
        "D": t.rlike(r"[#$%&*|]"),
    }


def _mask(filters: Mapping[str, Column]) -> Column:
    """Bit i is set where the i-th filter's condition holds; a null condition doesn't hold."""
    return sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], part: str = "source", text: str = "text", marks: Sequence[str] = ("quality", "toxic")) -> DataFrame:
    """For each part and mask of failed filters: ``n``, and for each mark m ``n_<m>``, the rows whose label m is 1.

    The filters' bits come in order, then one for rows whose text also stands under a smaller doc_id, anywhere in the table. A null text is an
    empty one, a null part the empty string. Rows without a doc_id have no smaller doc_id and are none, and have no labels; repeated rows count each.
    Of a doc_id's repeated labels, one that is 1 counts.

    Texts don't move, and are read once (those without a doc_id a second time): a row of digest, id and bits stands for each. Equal texts are counted by (doc_id, part), then by part, before a
    text's own rows meet, so a text that a third of all rows hold brings a few rows for each part.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t, 256)).alias("digest"), _mask(filters).cast("byte").alias("mask"))
    names = [f"n_{m}" for m in marks]
    own = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.when(F.col(m) == 1, 1).otherwise(0)).alias(n) for m, n in zip(marks, names, strict=True)))
    named = facts.where("doc_id IS NOT NULL").join(own, "doc_id", "left").fillna(0, names)
    same = named.groupBy("doc_id", "digest", "part", "mask", *names).agg(F.count(F.lit(1)).alias("n"))
    # the least doc_id of each group, with its rows; a doc_id stands once in a group
    groups = same.groupBy("digest", "part", "mask", *names).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    groups = groups.withColumn("first", F.min("least.doc_id").over(Window.partitionBy("digest")))
    firsts = F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    bit = F.lit(1 << len(filters))
    both = F.array(F.struct(F.col("mask").cast("int").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - firsts).alias("n")))
    judged = groups.select("part", *names, F.explode(both).alias("x")).select("part", "x.mask", "x.n", *names)
    counts = judged.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(n)).alias(n) for n in names))
    zero = [F.lit(0).cast("long").alias(n) for n in names]
    nameless = facts.where("doc_id IS NULL").groupBy("part", F.col("mask").cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n")).select("part", "mask", "n", *zero)
    return counts.unionByName(nameless).groupBy("part", "mask").agg(*(F.sum(n).alias(n) for n in ("n", *names)))


def survivors(counts: DataFrame, n_filters: int, measures: Sequence[str]) -> DataFrame:
    """For each part and measure an array over all subsets of filters (by their bits): what no filter of the subset removes.

    Per-part mask counts become sums over all subsets of a mask by one in-place pass for each bit, n * 2^n additions instead of 3^n;
    what survives a set of filters are the masks within its complement.
    """
    size = 1 << n_filters
    by_mask = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*measures)))).alias("own"))  # at most 2^n entries

    every, bits = F.sequence(F.lit(0), F.lit(size - 1)), F.array(*(F.lit(1 << i) for i in range(n_filters)))

    def zeta(measure: str) -> Column:
        own = F.transform(every, lambda m: F.coalesce(F.element_at("own", m)[measure], F.lit(0).cast("long")))
        with_bit = lambda sums, bit: F.transform(every, lambda m: F.get(sums, m) + F.when(m.bitwiseAND(bit) != 0, F.get(sums, m.bitwiseXOR(bit))).otherwise(0))
        return F.reverse(F.aggregate(bits, own, with_bit))  # at a set of filters stands its complement's sum

    return by_mask.select("part", *(zeta(m).alias(m) for m in measures))


def order_steps(kept: DataFrame, letters: str, marks: Mapping[str, str]) -> DataFrame:
    """Each part's row for each order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, a column for each mark (its name to the measure it counts), shapley.

    ``kept`` has survivors by subset in column ``n`` and in those of the marks. A step's removals are the difference of two neighbouring subsets. A filter's
    removals over all orders are such differences too, each as often as orders place that subset before it.
    """
    k, full = len(letters), (1 << len(letters)) - 1
    if k > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters: all orders are listed")
    steps = []
    for order in permutations(range(k)):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(f"{''.join(letters[i] for i in order)} {step} {before} {f}")
            before |= 1 << f
    at = lambda measure, subset: F.get(F.col(measure), subset)
    others = [s for s in range(full + 1)]

    def over_orders(f: int) -> Column:
        parts = [(s, factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))) for s in others if not s >> f & 1]
        return sum((F.lit(w).cast("long") * (at("n", F.lit(s)) - at("n", F.lit(s | 1 << f))) for s, w in parts), F.lit(0).cast("long"))

    shapley = kept.withColumn("by_filter", F.array(*(over_orders(f) for f in range(k))))
    listed = shapley.withColumn("x", F.explode(F.split(F.lit("|".join(steps)), r"\|"))).withColumn("x", F.split("x", " "))
    before, f = F.col("x")[2].cast("int"), F.col("x")[3].cast("int")
    bit = F.expr("shiftleft(1, CAST(x[3] AS INT))")
    after = before.bitwiseOR(bit)
    removed = at("n", before) - at("n", after)
    fails = at("n", F.lit(0)) - at("n", bit)
    return listed.select(
        "part", F.col("x")[0].alias("filter_order"), F.col("x")[1].cast("int").alias("step"), at("n", after).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (at("n", F.lit(full) - bit) - at("n", F.lit(full))).alias("unique_fails"), *((at(m, before) - at(m, after)).alias(name) for name, m in marks.items()), F.get("by_filter", f).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, part: str = "source", repeats: str = "E") -> DataFrame:
    """All orders' steps for ``filters`` (letter to failure condition; the five of the query where left out) and the filter of repeated texts, named ``repeats``, which comes last.

    An empty table has no parts and gives no rows. Other columns of ``docs`` don't matter, whatever their names.
    """
    filters = five_filters() if filters is None else filters
    counts = mask_counts(docs, labels, filters, part)
    kept = survivors(counts, len(filters) + 1, ("n", "n_quality", "n_toxic"))
    return order_steps(kept, "".join(filters) + repeats, {"good_lost": "n_quality", "toxic_lost": "n_toxic"})


ORACLE_SQL = r"""
    WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
         w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
         l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
         d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                      {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
                       'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first, false)} AS f
               FROM w LEFT JOIN l USING (doc_id)),
         m AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, f),
         v AS (SELECT part, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS bad FROM m),
         x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
         o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
               WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
         s AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[:step - 1], '') AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
         r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
                      coalesce(sum(n) FILTER (NOT list_has_any(bad, list_append(earlier, own))), 0) AS kept, coalesce(sum(n) FILTER (list_contains(bad, own) AND NOT list_has_any(bad, earlier)), 0) AS removed,
                      coalesce(sum(n) FILTER (list_contains(bad, own) AND list_has_any(bad, earlier)), 0) AS redundant, coalesce(sum(n) FILTER (bad = [own]), 0) AS unique_fails,
                      coalesce(sum(good) FILTER (list_contains(bad, own) AND NOT list_has_any(bad, earlier)), 0) AS good_lost,
                      coalesce(sum(toxic) FILTER (list_contains(bad, own) AND NOT list_has_any(bad, earlier)), 0) AS toxic_lost
               FROM v, s GROUP BY part, filter_order, step, own)
    SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
           CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
    FROM r
"""
