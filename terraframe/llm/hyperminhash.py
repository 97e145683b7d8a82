"""Shingle sets and their HyperMinHash registers, in numpy over many texts at once; helpers for use inside tasks.

Words and shingles stand as 64-bit hashes: sets of two texts are compared by these, so two different shingles would
count as one with a chance of 2**-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
#: Registers: one per bucket of the hash space, each the smallest hash of its bucket as a leading-zero count
#: (6 bits) and MANTISSA bits after the leading one.
REGISTERS, MANTISSA = 200, 10
#: Bands of consecutive registers; at similarity 0.75 a pair shares none of 40 bands of 5 once in 50,000.
BANDS, ROWS = 40, 5
#: A band key holds the number of its band in the lowest bits.
BAND_BITS = np.int64(63)
#: Fixed value of the HyperMinHash collision analysis: expected share of registers equal by chance, times 2**MANTISSA.
COLLISION = 0.169919487159739093975315012348630288992889
PROBES = 512
#: Bytes of text hashed at a time; a longer word is taken whole.
PIECE = 1 << 19
_rng = np.random.default_rng(20)
_STEP = _rng.integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PROBE = _rng.integers(0, REGISTERS, (REGISTERS, PROBES)).astype(np.int16)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_BASE = int(_rng.integers(1, 2**60)) * 8 + 5
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit integers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> list[np.ndarray]:
    """Powers 0 to n of the base and of its inverse modulo 2**64; kept up to PIECE."""
    if len(_powers[0]) > n:
        return _powers
    size = max(n, PIECE) + 1
    made = [np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, np.uint64(b))], dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    if size == PIECE + 1:
        _powers[:] = made
    return made


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of joined texts (bytes), and the first byte of each; no word crosses one of bounds.

    The hash of a word is a polynomial over its bytes, so differences of one running sum give all of them.
    """
    gap = _GAP[data]
    begins, ends = ~gap, ~gap
    begins[1:] &= gap[:-1]
    ends[:-1] &= gap[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    begins[inner] = ~gap[inner]
    ends[inner - 1] = ~gap[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = powers(len(data))
    running = np.empty(len(data) + 1, np.uint64)
    running[0] = 0
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64, out=running[1:])
    return mix((running[last] - running[first]) * down[first] + (last - first).astype(np.uint64)), first


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, joined, and the bounds of its rows; null rows are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2] if len(column) else None
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of the texts of a column, each sorted, end to end, and the bounds of the sets."""
    data, bounds = texts_of(column)
    # pieces end before a gap or at the end of a text, as soon as they hold PIECE bytes
    places = np.union1d(np.flatnonzero(_GAP[data]), bounds[1:])
    found, at, lo = [], [], 0
    while lo < len(data):
        hi = int(places[min(np.searchsorted(places, lo + PIECE), len(places) - 1)])
        h, first = word_hashes(data[lo:hi], bounds - lo)
        found.append(h)
        at.append(first + lo)
        lo = hi
    words = np.concatenate(found) if found else np.empty(0, np.uint64)
    starts = np.concatenate(at) if at else np.empty(0, np.int64)
    ends = np.searchsorted(starts, bounds)
    count = np.diff(ends)
    n = max(len(words) - SHINGLE + 1, 0)
    total = np.full(n, SHINGLE, np.uint64)
    for i in range(SHINGLE):
        total += mix(words[i : i + n] + np.uint64(i + 1)) * _STEP[i]
    total = mix(total)
    size = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    edges = np.r_[0, np.cumsum(size)]
    out = np.empty(edges[-1], np.uint64)
    for k in np.flatnonzero(count):
        a, own = ends[k], out[edges[k] : edges[k + 1]]
        if count[k] >= SHINGLE:
            own[:] = total[a : a + len(own)]
            own.sort()
        else:
            few = np.full(1, count[k], np.uint64)
            for i in range(count[k]):
                few += mix(words[a + i : a + i + 1] + np.uint64(i + 1)) * _STEP[i]
            own[:] = mix(few)
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[edges[:-1][size > 0]] = True
    return out[fresh], np.r_[0, np.cumsum(fresh)][edges]


def slices(column: pa.Array, rows: int = 500, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cuts a string column in runs of few rows and bytes; a longer text is a run of its own."""
    lengths = np.array([0 if x is None else x for x in pc.binary_length(column).to_pylist()])
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if i > lo and (i - lo >= rows or held + n > size):
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if len(lengths):
        yield lo, len(lengths)


def class_key(shingles: np.ndarray) -> int:
    """A 64-bit key of the set, equal for equal sets."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def registers(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The registers of sets, one row each; an empty bucket takes the register of the first filled one on its own probe list.

    The row of an empty set is 0.
    """
    rows = len(bounds) - 1
    out, filled = np.zeros(rows * REGISTERS, np.uint16), np.zeros(rows * REGISTERS, bool)
    if len(sets):
        place = np.repeat(np.arange(rows), np.diff(bounds)) * REGISTERS + ((sets >> np.uint64(40)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)
        value = mix(sets ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # sorted hashes: their buckets ascend
        least = np.minimum.reduceat(value, start)
        top = np.floor(np.log2(least.astype(np.float64))).astype(np.int64)
        top -= (np.uint64(1) << np.minimum(top, 63).astype(np.uint64)) > least  # the float may have rounded up
        zeros = 63 - top
        bits = (least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
        bits[zeros == 63] = 0
        out[place[start]] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | bits).astype(np.uint16)
        filled[place[start]] = True
    empty = np.flatnonzero(~filled & np.repeat(np.diff(bounds) > 0, REGISTERS))
    row, slot = empty - empty % REGISTERS, empty % REGISTERS
    for p in range(PROBES):
        if not len(empty):
            break
        probe = row + _PROBE[slot, p]
        hit = filled[probe]
        out[empty[hit]] = out[probe[hit]]
        empty, row, slot = empty[~hit], row[~hit], slot[~hit]
    for i, r in zip(empty, row):  # hardly any filled: the next one around the circle
        own = np.flatnonzero(filled[r : r + REGISTERS])
        out[i] = out[r + own[np.searchsorted(own, i - r) % len(own)]]
    return out.reshape(rows, REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band and row."""
    wide = regs[:, : BANDS * ROWS].astype(np.uint64).reshape(-1, BANDS, ROWS) + np.uint64(1)
    number = np.arange(BANDS, dtype=np.uint64)
    key = mix((wide * _BAND).sum(axis=2, dtype=np.uint64) + number)
    return (key & ~np.uint64(BAND_BITS) | number).view(np.int64)


def first_band(equal: np.ndarray) -> np.ndarray:
    """The first band in which rows of register comparisons agree throughout."""
    return equal[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)


def estimate(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less those expected to be equal by chance."""
    ratio = n_a / n_b
    chance = COLLISION / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def may_link(equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int = 75) -> np.ndarray:
    """Pairs that may reach the similarity: sizes allow it, and the estimate is within four deviations of it."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    aim = percent / 100
    slack = 4 * np.sqrt(aim * (1 - aim) / np.minimum(small, REGISTERS))
    return (100 * small >= percent * large) & (estimate(equal, n_a, n_b) >= aim - slack)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 75) -> bool:
    """Exactly: 100 x intersection >= percent x union, on full sets."""
    if len(a) * 100 < len(b) * percent or len(b) * 100 < len(a) * percent or not len(a):
        return False
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(many, few)
    both = int((many[np.minimum(at, len(many) - 1)] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
