"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit distance (operator 6).

Windows of the texts and all windows of the items are embedded by random walks; those that agree in every coordinate of one of many samples meet,
and what then agrees in enough coordinates is compared by edit distance, which alone decides. Windows that many items share (a common preamble) only mark
the place: there, items are found by their own rarest words, one of which must stand in any stretch that is near enough.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import gram_hashes, mix, text_slices, word_hashes

#: An item is in a text if some stretch of it differs in at most (1 - SIMILARITY) of the item's words, by edit distance.
SIMILARITY = 0.8
#: Items of fewer words are looked for as they stand.
SHORT = 8
#: Least words of an item, words of its windows, words from one window of a text to the next, coordinates in a sample.
SHAPES = ((8, 6, 1, 4), (14, 9, 1, 5), (20, 12, 2, 5))
#: Walks of the embedding, samples of each, and the part of all coordinates that a window and an item's must agree in to be compared word by word.
WALKS, SAMPLES, AGREEING = 2, 12, 0.4
#: Item windows of one sample's key that are taken one by one; where more share a key, the items' rare words decide which of them are compared.
MOST_ALIKE = 16
#: Windows of a text, and pairs of places and items, that are held at once.
CHUNK = 1 << 14
#: Items that one pass over the documents looks for; their words (8 bytes each) are what is broadcast.
BLOCK, BLOCK_WORDS = 8192, 1 << 18

_U = np.uint64
_FOUND = "doc_id long, item_id long, distance int, low int, high int"


def embedded(words: np.ndarray, starts: np.ndarray, size: int, walk: int) -> np.ndarray:
    """CGK: from each start, 2 * size steps over the words; a step gives the word at the walk's place, and a random bit of step and word moves it on or not, so that it covers about ``size`` words. Walks over two texts fall into step again after an edit, so edit distance becomes Hamming distance. ``words`` goes on for 2 * size more places than any start."""
    with np.errstate(over="ignore"):
        coins = mix(words + _U((walk + 1) * 0x9E3779B97F4A7C15 % 2**64))
    at, out = starts.astype(np.int64), np.empty((2 * size, len(starts)), _U)
    for step in range(2 * size):
        np.take(words, at, out=out[step])
        at += ((coins[at] >> _U(step)) & _U(1)).astype(np.int64)
    return out


def sampled(steps: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """One key for the drawn coordinates of each column."""
    with np.errstate(over="ignore"):
        key = steps[draw[0]]
        for c in draw[1:]:
            key = key * _U(0x9FB21C651E98DF25) + steps[c]
        return mix(key)


def best_stretch(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, low, high) of the stretch of ``text`` nearest to ``item``."""

    def last_row(item: np.ndarray, text: np.ndarray, anywhere: bool) -> np.ndarray:
        column = np.arange(len(text) + 1)
        row = np.zeros(len(text) + 1, np.int64) if anywhere else column.copy()
        for symbol in item:
            step = np.minimum(row + 1, np.concatenate([[row[0] + 1], row[:-1] + (text != symbol)]))
            row = np.minimum.accumulate(step - column) + column
        return row

    ends = last_row(item, text, True)
    high = int(ends.argmin())
    back = last_row(item[::-1], text[:high][::-1], False)
    return int(ends[high]), high - int(np.flatnonzero(back == ends[high])[0]), high


@dataclass(frozen=True)
class Items:
    """A block of benchmark items as word hashes; items that read alike are one, with all their ids."""

    ids: list[list[int]]
    words: list[np.ndarray]
    similarity: float
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    def edits(self, i: int) -> int:
        n = len(self.words[i])
        return int(n * (1 - self.similarity) + 1e-9) if n >= SHORT else 0

    def prepared(self) -> tuple[list[_Windows], dict[int, tuple[np.ndarray, np.ndarray]], _Rare]:
        """The windows of each shape that has items, by length the short items' hashes, in order, with the items, and the longer items' rare words."""
        shapes = [*SHAPES, (1 << 62, 0, 0, 0)]
        lengths = np.array([len(w) for w in self.words])
        windows = []
        for (least, size, step, sample), (following, *_) in zip(shapes, shapes[1:], strict=False):
            own = np.flatnonzero((lengths >= least) & (lengths < following))
            if len(own):
                windows.append(_Windows.of([self.words[i] for i in own], own, size, step, sample))
        short = {}
        for n in np.unique(lengths[lengths < SHORT]).tolist():
            own = np.flatnonzero(lengths == n)
            grams = np.concatenate([gram_hashes(self.words[i], n, seed=3) for i in own])
            order = np.argsort(grams, kind="stable")
            short[n] = grams[order], own[order]
        return windows, short, _Rare.of(self)


_READY: tuple[str, tuple] = ("", ())


def _ready(items: Items) -> tuple:
    """``items.prepared()``, kept from one task of a worker to the next."""
    global _READY
    if _READY[0] != items.token:
        _READY = items.token, items.prepared()
    return _READY[1]


@dataclass(frozen=True)
class _Rare:
    """Of each item of n words that may differ in d, the d + 1 words that fewest items hold: at least one stands unedited wherever the item is."""

    keys: np.ndarray
    items: np.ndarray
    places: np.ndarray
    words: np.ndarray
    begin: np.ndarray
    sizes: np.ndarray
    edits: np.ndarray

    @classmethod
    def of(cls, items: Items) -> _Rare:
        sizes = np.array([len(w) for w in items.words])
        edits = np.array([items.edits(i) for i in range(len(sizes))])
        flat = np.concatenate([*items.words, np.zeros(0, _U)])
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        _, code, counts = np.unique(flat, return_inverse=True, return_counts=True)
        order = np.lexsort((flat, counts[code], owner))  # each item's words, rarest first
        rank = np.arange(len(flat)) - begin[owner]
        first = order[(rank <= edits[owner]) & (sizes[owner] >= SHORT)]
        first = first[np.argsort(flat[first], kind="stable")]
        return cls(flat[first], owner[first], first - begin[owner[first]], flat, begin, sizes, edits)

    def near(self, words: np.ndarray, at: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """(text, item, where it would begin) for each rare word of an item at a marked place, if the stretch about it holds enough of the item's words."""
        out = [np.zeros((0, 3), np.int64)]
        where = np.flatnonzero(marked)
        low, high = np.searchsorted(self.keys, words[where], "left"), np.searchsorted(self.keys, words[where], "right")
        where, low, many = where[high > low], low[high > low], (high - low)[high > low]
        if not len(where):
            return out[0]
        known, code = np.unique(words, return_inverse=True)
        n = len(words) + 1
        spots = np.sort(code * n + np.arange(len(words)))  # by word, then place
        ends = np.cumsum(many)
        k = 0
        while k < len(where):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + CHUNK, "right")))
            each, part = many[k:stop], slice(k, stop)
            row = np.repeat(low[part] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            place, item = np.repeat(where[part], each), self.items[row]
            text = np.searchsorted(at, place, "right") - 1
            found = np.unique(np.stack([text, item, place - self.places[row]], axis=1), axis=0)
            for a in range(0, len(found), CHUNK):
                some = found[a : a + CHUNK]
                out.append(some[self._enough(some, at, known, spots, n)])
            k = stop
        return np.concatenate(out)

    def _enough(self, found: np.ndarray, at: np.ndarray, known: np.ndarray, spots: np.ndarray, n: int) -> np.ndarray:
        """Whether all but ``edits`` of the item's words stand somewhere in the stretch where it could be."""
        text, item, begin = found.T
        size, d = self.sizes[item], self.edits[item]
        low, high = np.maximum(at[text], begin - d), np.minimum(at[text + 1], begin + size + 2 * d)
        pair = np.repeat(np.arange(len(found)), size)
        own = self.words[np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[item], size)]
        code = np.minimum(np.searchsorted(known, own), len(known) - 1)
        spot = np.searchsorted(spots, code * n + low[pair])
        there = (known[code] == own) & (spot < len(spots)) & (spots[np.minimum(spot, len(spots) - 1)] < code * n + high[pair])
        return np.bincount(pair[there], minlength=len(found)) >= size - d


@dataclass(frozen=True)
class _Windows:
    """All windows of some items, embedded, with each sample's keys in order: what a text's windows are looked up in."""

    size: int
    step: int
    items: np.ndarray
    places: np.ndarray
    steps: list[np.ndarray]
    tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, words: list[np.ndarray], items: np.ndarray, size: int, step: int, sample: int) -> _Windows:
        gap, draws = np.zeros(2 * size, _U), np.random.default_rng(6)
        counts = np.array([len(w) - size + 1 for w in words])
        begin = np.cumsum([0, *(len(w) + len(gap) for w in words)])[:-1]
        places = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        flat = np.concatenate([x for w in words for x in (w, gap)])
        steps = [embedded(flat, np.repeat(begin, counts) + places, size, walk) for walk in range(WALKS)]
        tables = []
        for walk in range(WALKS):
            for _ in range(SAMPLES):
                draw = np.sort(draws.choice(2 * size, sample, replace=False))
                inside = np.flatnonzero((steps[walk][draw] != 0).all(axis=0))  # a walk past its item's end gives 0, which is no word
                keys = sampled(steps[walk][:, inside], draw)
                order = np.argsort(keys, kind="stable")
                bits = np.zeros(1 << min(22, max(10, 4 + len(keys).bit_length())), bool)
                bits[(keys & _U(len(bits) - 1)).astype(np.int64)] = True
                tables.append((walk, draw, bits, keys[order], inside[order]))
        return cls(size, step, np.repeat(items, counts), places, steps, tables)

    def reach(self, rare: _Rare) -> int:
        """How far from one of its windows an item's words can stand."""
        return int((rare.sizes + 2 * rare.edits)[np.unique(self.items)].max())

    def near(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, where it would begin in ``words``) of every window of the text that collides with an item's in a sample and agrees with it in enough coordinates; and where windows stand that collide with those of many items."""
        padded, every = np.concatenate([words, np.zeros(2 * self.size, _U)]), np.arange(0, len(words), self.step)
        items, begins, common = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(every), CHUNK):
            starts = every[a : a + CHUNK]
            steps = [embedded(padded, starts, self.size, walk) for walk in range(WALKS)]
            pairs = [np.zeros(0, np.int64)]
            for walk, draw, bits, keys, windows in self.tables:
                key = sampled(steps[walk], draw)
                where = np.flatnonzero(bits[(key & _U(len(bits) - 1)).astype(np.int64)])
                low, high = np.searchsorted(keys, key[where], "left"), np.searchsorted(keys, key[where], "right")
                few = high - low <= MOST_ALIKE
                common.append(starts[where[~few]])
                where, low, many = where[few], low[few], (high - low)[few]
                each = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                pairs.append(np.repeat(where, many) * len(self.items) + windows[each])
            text, own = np.divmod(np.unique(np.concatenate(pairs)), len(self.items))
            for k in range(0, len(text), CHUNK):
                part = slice(k, k + CHUNK)
                same = sum((mine[:, text[part]] == theirs[:, own[part]]).sum(axis=0) for mine, theirs in zip(steps, self.steps, strict=True))
                keep = same >= AGREEING * WALKS * 2 * self.size
                items.append(self.items[own[part][keep]])
                begins.append(starts[text[part][keep]] - self.places[own[part][keep]])
        return np.concatenate(items), np.concatenate(begins), np.unique(np.concatenate(common))


def _candidates(words: np.ndarray, at: np.ndarray, windows: list[_Windows], rare: _Rare) -> np.ndarray:
    """Distinct (text, item, where the item would begin), in order."""
    out, marks = [np.zeros((0, 3), np.int64)], np.zeros(len(words) + 1, np.int64)
    for shape in windows:
        item, begin, common = shape.near(words)
        text = np.searchsorted(at, np.maximum(begin, 0) + shape.size // 2, "right") - 1
        out.append(np.stack([np.minimum(text, len(at) - 2), item, begin], axis=1))
        reach = shape.reach(rare)
        np.add.at(marks, np.maximum(common - reach, 0), 1)
        np.add.at(marks, np.minimum(common + reach, len(words)), -1)
    marked = np.cumsum(marks[:-1]) > 0
    if marked.any():
        out.append(rare.near(words, at, marked))
    return np.unique(np.concatenate(out), axis=0)


def _short_items(words: np.ndarray, at: np.ndarray, short: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, int, int, int, int]]:
    """The first place of each short item in each text."""
    for n, (keys, items) in short.items():
        grams = gram_hashes(words, n, seed=3)
        where = np.flatnonzero(np.isin(grams, keys))
        text = np.searchsorted(at, where, "right") - 1
        whole = where + n <= at[text + 1]
        seen = set()
        for t, p in zip(text[whole].tolist(), where[whole].tolist(), strict=True):
            for i in items[np.searchsorted(keys, grams[p], "left") : np.searchsorted(keys, grams[p], "right")].tolist():
                if (t, i) not in seen:
                    seen.add((t, i))
                    yield t, i, 0, p - int(at[t]), p - int(at[t]) + n


def find_items(texts: pa.Array, items: Items, prepared: tuple) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, low, high) of every text and item found in it, at its nearest stretch; words are lower-cased."""
    words, at = word_hashes(texts, lower=True)
    if not len(words):
        return []
    windows, short, rare = prepared
    hits = _candidates(words, at, windows, rare)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    k = 0
    while k < len(hits):
        text, item, low = hits[k].tolist()
        n, d, high = len(items.words[item]), items.edits(item), low
        while k < len(hits) and hits[k, 0] == text and hits[k, 1] == item and hits[k, 2] <= high + n:
            high = int(hits[k, 2])
            k += 1
        a, b = max(int(at[text]), low - d), min(int(at[text + 1]), high + n + 2 * d)
        distance, start, stop = best_stretch(items.words[item], words[a:b])
        if distance <= d:
            spot = distance, start + a - int(at[text]), stop + a - int(at[text])
            best[text, item] = min(best.get((text, item), spot), spot)
    return [(t, i, *spot) for (t, i), spot in best.items()] + list(_short_items(words, at, short))


def _blocks(benchmark: DataFrame, similarity: float) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, fetched one partition at a time."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    ids, kept, held, seen = [], [], 0, {}
    for row in rows.toLocalIterator():
        words = word_hashes(pa.array([row["text"]]), lower=True)[0]
        if not len(words):
            continue
        k = seen.setdefault(words.tobytes(), len(ids))
        if k < len(ids):
            ids[k].append(row["item_id"])
            continue
        ids.append([row["item_id"]])
        kept.append(words)
        held += len(words)
        if len(ids) >= BLOCK or held >= BLOCK_WORDS:
            yield Items(ids, kept, similarity)
            ids, kept, held, seen = [], [], 0, {}
    if ids:
        yield Items(ids, kept, similarity)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, distance, low, high: every document (doc_id, text) that holds an item (item_id, text), with its nearest stretch (words [low, high)). A-Z count as a-z.

    The benchmark is taken in blocks of bounded size, each of which one pass over the documents looks for; documents are not shuffled, and each row is judged alone.
    Items of fewer than ``SHORT`` words must stand there as they are. Null texts and items without words hold nothing and are not looked for. Repeated items
    and repeated rows are each reported; a null doc_id comes out as null.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pass_for(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prepared = _ready(items)
            for batch in text_slices(batches):
                found = ((t, own, *spot) for t, i, *spot in find_items(batch.column(1), items, prepared) for own in items.ids[i])
                t, i, d, a, b = list(zip(*found, strict=True)) or [[]] * 5
                ids = batch.column(0).take(pa.array(t, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(i, pa.int64()), *(pa.array(x, pa.int32()) for x in (d, a, b))], ["doc_id", "item_id", "distance", "low", "high"])

        return docs.mapInArrow(run, _FOUND)

    out = None
    for items in _blocks(benchmark, similarity):
        found = pass_for(items)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], _FOUND) if out is None else out


def without_items(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text holds no item of ``benchmark``."""
    at = docs.columns.index("text")

    def pass_for(docs: DataFrame, items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            prepared = _ready(items)
            for batch in text_slices(batches, at):
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in find_items(batch.column(at), items, prepared)]] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    for items in _blocks(benchmark, similarity):
        docs = pass_for(docs, items)
    return docs
