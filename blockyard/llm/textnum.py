"""Words, lines and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

A word is a maximal run of bytes outside space and 0x09-0x0D, so UTF-8 needs no decoding. Hashes are a keyed
polynomial of the bytes with a finaliser; two different words share one with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slices(batches: Iterator[pa.RecordBatch], most: int = 1 << 23, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of text, and one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(lengths, dtype=np.int64), 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for the bytes of each segment [start, end); segments ascend, don't overlap and aren't empty."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _SLICE, "right")))
        lens = ends[at:to] - starts[at:to]
        first = np.concatenate(([0], np.cumsum(lens)))[:-1]
        inside = np.arange(lens.sum()) - np.repeat(first, lens)
        powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
        own = _KEYS[buf[inside + np.repeat(starts[at:to], lens)]] * powers[inside]
        out[at:to] = mix(np.add.reduceat(own, first) + lens.astype(np.uint64))
        at = to
    return out


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of every word of the rows that ``utf8`` gave."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~SPACE[buf]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    begins[cuts] = inside[cuts]
    stops[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    rows = np.searchsorted(offs, starts, "right") - 1
    return starts, ends, rows, segment_hash(LOWER[buf] if lower else buf, starts, ends)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of every run of ``size`` words within one row."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, m in enumerate(odd(size, seed)):
        total += hashes[k : k + n] * m
    at = np.flatnonzero(rows[:n] == rows[size - 1 : size - 1 + n])
    return at, mix(total[at])


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> list[np.ndarray]:
    """The sorted set of word shingles of each row; a row with fewer words than ``size`` has one shingle of all its words, a row without words has none."""
    at, keys = windows(hashes, rows, size, 5)
    cut = np.searchsorted(rows[at], np.arange(n_rows + 1))
    own = np.searchsorted(rows, np.arange(n_rows + 1))
    out = []
    for i in range(n_rows):
        if cut[i + 1] > cut[i]:
            out.append(np.unique(keys[cut[i] : cut[i + 1]]))
        elif n := int(own[i + 1] - own[i]):
            out.append(mix(np.array([(hashes[own[i] : own[i + 1]] * odd(n, 7)).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
