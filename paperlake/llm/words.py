"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D. Texts are read as
UTF-8, in which these separators are single bytes, so words of bytes are words of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

__all__ = ["Words", "buffers", "mix", "slices", "span_hashes", "words_of"]

_RANDOM = np.random.default_rng(20240229)
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_MARK = _SEPARATOR.copy()
_MARK[:0x80] |= ~np.array([chr(i).isalnum() for i in range(0x80)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOW, _STEP = 4096, 1 << 20


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWER = _powers(_BASE, _LOW)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is an empty text."""
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (at least one row), so that the arrays made from it stay small."""
    _, offsets = buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


@dataclass
class Words:
    """Words of a batch, in order. ``doc`` is the row of each; ``counts`` has the number of words of each row."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    hash: np.ndarray


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are not empty and their ends don't fall."""
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _STEP, "right")))
        s = start[i:j]
        length = end[i:j] - s
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
        value = _VALUE[data[within + np.repeat(s, length)]]
        with np.errstate(over="ignore"):
            if length.max() <= _LOW:
                value *= _POWER[within]
            else:
                far = _powers(_POWER[-1] * _BASE, int(length.max()) // _LOW + 1)
                value *= _POWER[within % _LOW] * far[within // _LOW]
        out[i:j] = np.add.reduceat(value, first)
        with np.errstate(over="ignore"):
            out[i:j] += length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def words_of(texts: pa.Array, lower: bool = False, bare: bool = False) -> Words:
    """Words of a batch of texts with a 64-bit hash each. ``lower`` folds A-Z alone; ``bare`` parts words at ASCII signs too."""
    data, offsets = buffers(texts)
    if lower:
        data = _LOWER[data]
    inside = ~(_MARK if bare else _SEPARATOR)[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    return Words(data, offsets, start, end, doc, counts, span_hashes(data, start, end))
