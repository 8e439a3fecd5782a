"""Vectorised word scanning over UTF-8 bytes, shared by the corpus operators.

Texts are handled whole.  Working arrays are built over blocks of about BLOCK bytes cut between
words, so that one very long text costs some tens of bytes a word, not hundreds a byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words in the sense of "anything but white space" and of "letters, digits, non-ASCII".
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            globals()[name] = np.cumprod(out, dtype=np.uint64)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of several texts: byte ranges in data, hashes, and the texts' word ranges (len(texts) + 1)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def scan_words(texts: list[bytes], word: np.ndarray) -> Words:
    """Lower-cases A-Z and finds the maximal runs of bytes for which word holds; a space must not be one."""
    data = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and word[data[stop - 1]]:
            gap = np.flatnonzero(~word[data[stop : stop + BLOCK]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(stop + BLOCK, len(data))
        part = data[at:stop]
        flag = np.zeros(len(part) + 2, np.int8)
        flag[1:-1] = word[part]
        edge = np.diff(flag)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        power, inverse = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(mix((total[e] - total[s]) * inverse[s]))
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return Words(
        data,
        start,
        np.concatenate(ends) if ends else start,
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        np.searchsorted(start, first),
    )


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n consecutive words of one text; of a shorter text, of all its words."""
    n = min(n, len(hashes))
    if not n:
        return hashes
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[k : len(hashes) - n + 1 + k])
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about limit bytes of that column; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def release() -> None:
    """Gives freed memory back: workers stay when their task is over, beside the heap of the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)
