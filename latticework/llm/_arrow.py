"""Kernels over Arrow string columns, shared by the operators of this subpackage.

A word is a maximal run of ASCII letters, ASCII digits and characters outside
ASCII, after lower-casing. Everything works on whole byte buffers with numpy;
no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: SQL form of the separator between words, applied to lower-cased text.
SEPARATOR = r"[\x00-/:-`{-\x7f]+"

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BYTE = np.random.default_rng(20240229).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 20
    while size < n:
        size *= 2
    return _powers(size)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, lower case
    text_at: np.ndarray  # n texts + 1 byte offsets
    start: np.ndarray  # byte where each word starts
    end: np.ndarray
    at: np.ndarray  # n texts + 1 word offsets

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = _BYTE[self.data]
            total *= up[: len(total)]
            np.cumsum(total, out=total)
            before = np.where(self.start > 0, total[self.start - 1], np.uint64(0))
            return mix((total[self.end - 1] - before) * down[self.start])

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def strings(self, index: np.ndarray) -> list[str]:
        raw = self.data.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.start[index].tolist(), self.end[index].tolist())]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and n + 1 offsets."""
    large = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, np.uint8)
    return data, at - at[0]


def split_words(texts: pa.Array) -> Words:
    data, at = raw_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    inside = _IS_WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    firsts = at[:-1][at[:-1] < len(data)]
    before[firsts] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    lasts = at[1:] - 1
    after[lasts[lasts >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of the column, one row at least."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        bin_of = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(bin_of)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
