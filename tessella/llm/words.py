"""Words of whole texts, as numpy arrays over one Arrow batch.

A word is a longest run of characters other than U+0020 and U+0009..U+000D. Those six are
exactly what Arrow's ASCII whitespace splitter cuts at, so a batch of texts becomes one flat
array of words without a Python loop.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class WordBatch:
    """Words of a batch: ``words`` is flat, text ``i`` owns ``starts[i]:starts[i + 1]``."""

    words: pa.Array
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        """The index of the text that each word belongs to."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


def as_large(texts) -> pa.Array:
    """A plain large_string array; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.offset:  # a slice: kernels that return lists don't all heed where it starts
        texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def split_words(texts) -> WordBatch:
    """Splits every text of an Arrow array; a null or empty text has no words."""
    lists = pc.ascii_split_whitespace(as_large(texts))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    full = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty string
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return WordBatch(flat.filter(full), kept[offsets - offsets[0]])


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the UTF-8 bytes of a string array, the same in every process.

    A polynomial over 8-byte lanes, for all strings at once: strings are processed in as many
    rounds as the longest has lanes, and only those still unfinished take part in a round.
    """
    values = values.cast(pa.large_string())
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.zeros(high - low + 8, np.uint8)
    if high > low:
        data[:-8] = np.frombuffer(values.buffers()[2], np.uint8)[low:high]
    lanes = np.lib.stride_tricks.sliding_window_view(data, 8)
    starts, lengths = offsets[:-1] - low, np.diff(offsets)
    out = mix64(lengths.astype(np.uint64) + np.uint64(seed) * _ODD + np.uint64(1))
    open_ = np.flatnonzero(lengths > 0)
    at = 0
    while len(open_):
        lane = lanes[starts[open_] + at].copy().view("<u8").ravel()
        rest = np.minimum(lengths[open_] - at, 8).astype(np.uint64)
        lane &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - rest * np.uint64(8))
        out[open_] = mix64(out[open_] * _ODD ^ lane)
        at += 8
        open_ = open_[lengths[open_] > at]
    return out


def word_hashes(batch: WordBatch, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word; each distinct word of the batch is hashed once."""
    if not len(batch.words):
        return np.zeros(0, np.uint64)
    coded = batch.words.dictionary_encode()
    return string_hashes(coded.dictionary, seed)[coded.indices.to_numpy()]


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` consecutive entries (fewer by size - 1); order counts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix64(out * _ODD + hashes[k : k + n])
    return out
