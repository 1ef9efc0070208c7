"""Vectorised words and shingles of Arrow batches, used inside mapInArrow tasks.

Words are the runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.
They are held as 64-bit hashes: a polynomial over the bytes modulo 2^64, finished
by a bit mixer.  Texts are cut into slices of half a megabyte, so the arrays stay
small whatever a batch holds; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 19
#: Bytes over which one prefix sum of the word hash runs.
SPAN_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bit mixer of 64-bit words (xor-shift and multiply, one to one)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next slice."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SPAN_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= SPAN_BYTES + 1:
            _powers[base] = have
    return have


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0]:offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches by rows so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = text_bytes(batch.column(text))[1][1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a slice: ``hashes`` in order, ``first[d]`` the index of document d's first word."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.first) - 1

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.per_doc)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order; ``lower`` folds A-Z."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SPAN_BYTES, side="right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        power = _power(_BASE, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        span = _LOWER[data[lo:hi]] if lower else data[lo:hi]
        np.cumsum((span.astype(np.uint64) + np.uint64(1)) * power[:hi - lo], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _power(_UNBASE, hi - lo + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix64(out)


def words_of(column: pa.Array, hashed: bool = True) -> Words:
    """Words of a text column; without ``hashed`` only their places are found."""
    data, offsets = text_bytes(column)
    word = ~_BLANK[data]
    if len(data):
        before, after = np.empty_like(word), np.empty_like(word)
        before[0], before[1:] = True, ~word[:-1]
        after[-1], after[:-1] = True, ~word[1:]
        full = offsets[1:] > offsets[:-1]
        before[offsets[:-1][full]] = True
        after[offsets[1:][full] - 1] = True
        starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets),
                 hash_words(data, starts, ends) if hashed else np.zeros(0, np.uint64))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive values, whatever document they are in."""
    n = max(0, len(hashes) - width + 1)
    acc = np.full(n, width, np.uint64)
    for j in range(width):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j:j + n])
    return acc


def shingles(words: Words, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first) of each document's shingles in order, repeats included.

    A document with fewer words, but one at least, has its whole sequence as its only
    shingle if ``short``, else none.
    """
    n = words.per_doc
    every = rolled(words.hashes, width)
    count = np.maximum(0, n - width + 1)
    brief = np.flatnonzero((n > 0) & (n < width)) if short else np.zeros(0, np.int64)
    count[brief] = 1
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(first[-1], np.uint64)
    whole = np.ones(len(out), bool)
    whole[first[brief]] = False
    long = np.where(n >= width, n - width + 1, 0)
    at = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(long)[:-1]]), long) + np.arange(long.sum())
    out[whole] = every[at]
    for d in brief:
        own = words.hashes[words.first[d]:words.first[d + 1]]
        out[first[d]] = rolled(own, len(own))[0]
    return out, first


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    return v[new], np.concatenate([[0], np.cumsum(np.bincount(d[new], minlength=len(first) - 1))]).astype(np.int64)


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """One binary cell per document from its slice of a flat array."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [
        None, pa.py_buffer((first * raw.dtype.itemsize).astype(np.int64)), pa.py_buffer(raw.tobytes())])
