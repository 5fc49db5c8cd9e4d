"""Words of whole texts as 64-bit hashes, worked out over a batch's bytes at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser by shifts and odd multipliers."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: A value for each byte at each of 64 places of a word.
_VALUES = mix(np.arange(1, 64 * 256 + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(64, 256)


def text_slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``most`` bytes together, or one row."""
    for batch in batches:
        texts = batch.column(column)
        lengths = np.array(pc.fill_null(pc.binary_length(texts), 0), np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word ``[^\\x20\\x09-\\x0D]+`` of each text, and each text's first word's place (one more at the end). A null text has no words.

    A word's hash is the mixed sum of a pseudo-random value for each byte at its place, and of its length: no arrangement of bytes makes words alike but by chance.
    """
    if texts.offset:
        texts = pa.concat_arrays([texts])
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    if texts.null_count:
        lengths = np.where(np.array(texts.is_valid()), np.diff(offsets), 0)
        if (lengths != np.diff(offsets)).any():
            return word_hashes(pc.fill_null(texts, ""), lower)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    own = raw[inside]
    return _summed(_LOWER[own] if lower else own, stop - start), np.searchsorted(start, offsets)


def _summed(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The hashes of words whose bytes stand one after the other in ``data``."""
    if not len(lengths):
        return np.zeros(0, _U)
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(data)) - np.repeat(begin, lengths)
    with np.errstate(over="ignore"):
        value = _VALUES[place & 63, data]
        if int(lengths.max()) > 64:
            far = np.flatnonzero(place > 63)
            value[far] = mix(value[far] + (place[far] >> 6).astype(_U) * _STEP)
        return mix(np.add.reduceat(value, begin) + lengths.astype(_U) * _STEP)


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each n consecutive words, whichever texts they stand in."""
    if len(words) < n:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.full(len(words) - n + 1, _U(seed * 2 + 1))
        for i in range(n):
            out = out * _U(0x9FB21C651E98DF25) + words[i : len(words) - n + 1 + i]
        return mix(out)
