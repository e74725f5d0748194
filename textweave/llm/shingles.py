"""Vectorised words, shingle sets and signatures of whole texts, straight from Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_P = 0x5851F42D4C957F2D  # odd, hence invertible modulo 2^64
_PINV = pow(_P, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, stream: int) -> np.ndarray:
    """``n`` fixed odd numbers."""
    return mixed(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(stream)) | U(1)


_BYTES = seeds(256, 101)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, at least a MB of them, kept for the next call."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_P, _PINV)):
            steps = np.full(max(n, 1 << 20), base, U)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def text_groups(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most_bytes`` (a larger text alone): first row, UTF-8 bytes, and the rows' bounds in them."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + most_bytes, "right")) - 1)
        yield row, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and each row's bounds in them."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    ink = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[bounds] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    stops = np.flatnonzero(ink & (~after | edge[1:])) + 1
    powers, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * powers[:n], out=sums[1:])
    return mixed((sums[stops] - sums[starts]) * inverse[starts]), np.searchsorted(starts, bounds)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``size``-word shingles; the whole sequence if it has fewer words, nothing if none."""
    words, at = word_hashes(data, bounds)
    factors = seeds(size, 202)
    many = len(words) - size + 1
    all_ = np.zeros(max(many, 0), U)
    for i in range(size):
        if many > 0:
            all_ += words[i : i + many] * factors[i]
    all_ = mixed(all_)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= size:
            yield np.unique(all_[a : b - size + 1])
        elif b > a:
            yield mixed((words[a:b] * seeds(int(b - a), 300 + int(b - a))).sum(dtype=U, keepdims=True))
        else:
            yield np.zeros(0, U)


def min_hashes(sets: list[np.ndarray], n: int, stream: int = 404) -> np.ndarray:
    """One row of ``n`` 16-bit codes of minima for each set; zeros for an empty one."""
    out = np.zeros((len(sets), n), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for k, factor in enumerate(seeds(n, stream)):
            z = flat * factor
            z ^= z >> U(32)
            out[full, k] = (mixed(np.minimum.reduceat(z, at)) & U(0xFFFF)).astype(np.uint16)
    return out


def bin_codes(one: np.ndarray, bins: int = 512) -> np.ndarray:
    """A byte for each of ``bins`` equal ranges of the hash space: 0 for an empty range, else a code of its least hash."""
    out = np.zeros(bins, np.uint8)
    if len(one):
        where = (one >> U(64 - bins.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        out[where[first]] = (mixed(one[first]) % U(255)).astype(np.uint8) + 1
    return out
