"""Substring dedup by compressed FM-indexes, one per shard (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import stored
from .words import gram_hashes, mix, text_slices, word_hashes

WINDOW = 20
#: Words in the grams whose least hash in a window names the window's shard.
GRAM = 5
#: Segments that a shard's index holds on average, and that one gram may bring to a shard before its windows are aggregated one by one instead.
SHARD, HOT = 6000, 3000

_U = np.uint64
_SEGMENTS = "gram long, content long, doc_id long, start int, size int"


def _segments(texts: pa.Array, window: int, gram: int):
    """(text, first window, windows, least gram's hash, whether it stands in the run twice, content's hash) of each run of windows with the same least gram, as arrays."""
    words, at = word_hashes(texts)
    none = np.zeros(0, np.int64)
    empty = none, none, none, none.astype(_U), none.astype(bool), none.astype(_U)
    if len(words) < window:
        return empty
    grams = gram_hashes(words, gram, seed=7)
    least, width, span = grams, 1, window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    counts = np.diff(at)
    owner = np.repeat(np.arange(len(counts)), np.maximum(counts - window + 1, 0))
    first = np.concatenate([[0], np.cumsum(np.maximum(counts - window + 1, 0))])
    place = np.arange(len(owner)) - first[owner]
    value = least[at[owner] + place]
    if not len(owner):
        return empty
    edge = np.concatenate([[True], (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])])
    begin = np.flatnonzero(edge)
    runs = np.diff(np.append(begin, len(owner)))
    start = at[owner[begin]] + place[begin]
    length = runs + window - 1
    begun = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(begun, length)
    with np.errstate(over="ignore"):  # each word counts at its place, so no arrangement of words makes runs alike but by chance
        each = mix(words[np.repeat(start, length) + inside] + (inside + 1).astype(_U) * _U(0x5851F42D4C957F2D))
        content = mix(np.add.reduceat(each, begun) + length.astype(_U))
    covered = runs + span - 1
    offset = np.cumsum(covered) - covered
    own = np.arange(int(covered.sum())) + np.repeat(start - offset, covered)
    twice = np.add.reduceat(grams[own] == np.repeat(value[begin], covered), offset, dtype=np.int64) > 1
    return owner[begin], place[begin], runs, value[begin], twice, content


def segments(docs: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """Every document's windows in runs that share their least gram: equal windows have equal grams, so they meet by ``gram``; ``content`` is the hash of a run's words, ``size`` twice its number of windows, and one more if the gram stands in it twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            owner, place, runs, value, twice, content = _segments(batch.column(1), window, gram)
            ids = batch.column(0).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(content.view(np.int64)), ids, pa.array(place.astype("i4")), pa.array((2 * runs + twice).astype("i4"))], ["gram", "content", "doc_id", "start", "size"])

    return docs.mapInArrow(run, _SEGMENTS)


def _gram_counts(docs: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """gram, runs: how many runs of windows each gram leads in each slice of documents; a run that holds its gram twice counts as two, as windows may repeat within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, _, _, value, twice, _ = _segments(batch.column(1), window, gram)
            grams, place = np.unique(value, return_inverse=True)
            many = np.minimum(np.bincount(place, weights=1 + twice, minlength=len(grams)), 2)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(many.astype("i4"))], ["gram", "runs"])

    return docs.mapInArrow(run, "gram long, runs int")


def _runs_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text and the wanted runs (start, windows, shard) of each document that has any."""
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "windows", "shard")).alias("runs")).withColumnRenamed("doc_id", "of")
    return docs.join(per_doc, F.col("doc_id") == F.col("of")).select("doc_id", "text", "runs")


def _contents(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """The words of the wanted runs, each in its gram's shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, at = word_hashes(part.column(1))
            ids, out = part.column(0).to_pylist(), ([], [], [], [])
            for doc, base, runs in zip(ids, at.tolist(), part.column(2).to_pylist(), strict=False):
                for r in runs:
                    s = base + r["start"]
                    for column, x in zip(out, (r["shard"], doc, r["start"], words[s : s + r["windows"] + window - 1].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["shard", "doc_id", "start", "words"])

    return _runs_of(wanted, docs).mapInArrow(run, "shard long, doc_id long, start int, words binary")


def _hot_repeats(wanted: DataFrame, docs: DataFrame, window: int) -> DataFrame:
    """doc_id, low, high of the windows of hot grams' runs that start earlier too. Each distinct window, by a 128-bit key, is reduced to its earliest place before anything is joined, however often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words, at = word_hashes(part.column(1))
            keys = [gram_hashes(words, window, seed=s).view(np.int64) for s in (11, 13)]
            runs = part.column(2).to_pylist()
            owner = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            start = np.array([r["start"] for own in runs for r in own], np.int64)
            many = np.array([r["windows"] for own in runs for r in own], np.int64)
            begun = np.cumsum(many) - many
            place = np.repeat(start, many) + np.arange(int(many.sum())) - np.repeat(begun, many)
            owner = np.repeat(owner, many)
            spot = at[owner] + place
            ids = part.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[0][spot]), pa.array(keys[1][spot]), ids, pa.array(place.astype("i4"))], ["key", "check", "doc_id", "start"])

    hot = stored(_runs_of(wanted, docs).mapInArrow(run, "key long, check long, doc_id long, start int"), "hot-windows")
    first = hot.groupBy("key", "check").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    late = hot.join(first, ["key", "check"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    return late.select("doc_id", F.col("start").alias("low"), (F.col("start") + window).alias("high"))


def _search(window: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        contents = [np.frombuffer(x.as_buffer(), _U) for x in rows.column("words")]
        docs, starts = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy()
        lengths = np.array([len(c) for c in contents])
        _, ids = np.unique(np.concatenate(contents), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
        symbols = np.zeros(int((lengths + 1).sum()), np.int64)
        owner = np.repeat(np.arange(len(contents)), lengths)
        inside = np.arange(len(ids)) - (np.cumsum(lengths) - lengths)[owner]
        symbols[begin[owner] + inside] = ids + 1
        window_at = inside <= (lengths[owner] - window)
        owner, inside = owner[window_at], inside[window_at]
        places = begin[owner] + inside
        # windows in the order in which they start in the corpus; those of a repeated row have one turn
        doc, start = docs[owner], starts[owner] + inside
        order = np.lexsort((start, doc))
        turn = np.full(len(symbols), len(order), np.int64)
        turn[places[order]] = np.cumsum(np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)])[: len(order)])
        index = FMIndex(symbols, window)
        found, low, high = index.repeated(symbols, places, window)
        late = np.zeros(0, np.int64)
        if len(found):
            each, which = np.unique(low, return_index=True)
            turns = np.append(turn[index.suffixes], len(order))
            cuts = np.stack([each, high[which]], axis=1).reshape(-1)
            earliest = np.minimum.reduceat(turns, cuts)[::2]
            late = found[turn[places[found]] > earliest[np.searchsorted(each, low)]]
        first = starts[owner[late]] + inside[late]
        return pa.table({"doc_id": pa.array(docs[owner[late]], pa.int64()), "low": pa.array(first, pa.int32()), "high": pa.array(first + window, pa.int32())})

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """doc_id, low, high: words [low, high) of a document that windows cover which also start earlier; and ``docs`` as it is to be joined with them.

    Windows meet in shards named by their least gram. Grams that lead one run alone are done with at once. Runs that read alike are one entry, with the earliest place
    they have: every other place of theirs is a repeat. Entries whose gram leads another entry too, or that repeat within themselves, are indexed, and
    each of their windows is searched backward in its shard's FM-index: it is a repeat unless its own place is the earliest of all rows in its interval.
    A gram that leads more than ``HOT`` entries would fill a shard: its windows are aggregated one by one, each to its earliest place.
    """
    counts = _gram_counts(docs, window).groupBy("gram").agg(F.sum("runs").alias("runs"))
    shared = stored(counts.where("runs > 1").select("gram"), "grams")
    places = stored(segments(docs, window).join(shared, "gram"), "runs")
    entries = places.groupBy("gram", "content").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.first("size").alias("size"))
    entries = stored(entries.select("gram", "content", F.shiftright("size", 1).alias("windows"), (F.col("size") % 2 == 1).alias("twice"), F.col("first.doc_id").alias("first_doc"), F.col("first.start").alias("first_start")), "entries")
    leads = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("entries"), F.max("twice").alias("twice"))
    leads = stored(leads.where((F.col("entries") > 1) | F.col("twice")).select("gram", "entries"), "leads")
    total = leads.agg(F.sum("entries")).head()[0] or 0
    shards = max(64, int(total) // SHARD)
    wanted = entries.join(leads, "gram").select(F.col("first_doc").alias("doc_id"), F.col("first_start").alias("start"), "windows", F.pmod(F.xxhash64("gram"), F.lit(shards)).alias("shard"), (F.col("entries") > HOT).alias("hot"))
    later = places.join(entries.drop("twice"), ["gram", "content"]).where((F.col("doc_id") != F.col("first_doc")) | (F.col("start") != F.col("first_start")))
    later = later.select("doc_id", F.col("start").alias("low"), (F.col("start") + F.col("windows") + (window - 1)).alias("high"))
    wanted = stored(wanted, "wanted")
    searched = _contents(wanted.where("NOT hot"), docs, window).groupBy("shard").applyInArrow(_search(window), "doc_id long, low int, high int")
    return later.unionByName(searched).unionByName(_hot_repeats(wanted.where("hot"), docs, window)), docs


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that no window repeating an earlier one covers, joined by one space) of each row of ``docs`` (doc_id, text).

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none, and a text of fewer words than a window keeps them all. Rows that repeat a doc_id
    with the same text get the same result and do not count as repeats of each other; those with other texts each lose what any of them repeats.
    Rows without a doc_id are documents of their own and come last, by the SHA-256 of their texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if docs.where("doc_id IS NULL").limit(1).count():
        order = [F.col("doc_id").asc_nulls_last(), F.sha2("text", 256).asc_nulls_first()]
        rows = stored(docs.orderBy(*order).withColumn("row", F.monotonically_increasing_id()), "numbered")
        named = rows.where("doc_id IS NOT NULL")
        named = named.join(named.groupBy("doc_id").agg(F.min("row").alias("first")), "doc_id").select("doc_id", "text", F.col("first").alias("row"))
        rows = named.unionByName(rows.where("doc_id IS NULL"))
        found = remove_repeats(rows.select(F.col("row").alias("doc_id"), "text"), window).withColumnRenamed("doc_id", "row")
        return found.join(rows.select("row", "doc_id").distinct(), "row").select("doc_id", "n_words", "n_removed", "kept")
    spans, docs = repeated_spans(docs, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            total, removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = text.as_py().encode().split() if text.is_valid else []
                total.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s in spans:
                        gone[min(s["low"], len(words))] += 1
                        gone[min(s["high"], len(words))] -= 1
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    per_doc = spans.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("spans")).withColumnRenamed("doc_id", "of")
    joined = docs.join(per_doc, F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
