"""Portable shingle hashes of whole batches: the folds of ``text.token_hash`` and ``text.shingle_hash`` over arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from textweave.functions.text import SHINGLE, SHINGLE_BASIS, TOKEN_BASIS, TOKEN_PRIME_LOW

M64 = (1 << 64) - 1
PRIME = (1 << 40) + TOKEN_PRIME_LOW
#: Shingles that are hashed and handed on at once.
ROWS = 1 << 18
#: As few tokens as this are folded one by one.
FEW = 8


def _fold(token: bytes, h: int) -> int:
    for b in token:
        h = (h ^ b) * PRIME & M64
    return h


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """The hash of each token; distinct ones are folded together, a byte a step, the longest for the most steps."""
    coded = tokens.cast(pa.large_string()).dictionary_encode()
    distinct = coded.dictionary
    if not len(distinct):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(distinct.buffers()[1], np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
    data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    start, falling = ends[:-1][order], -size[order]
    h = np.full(len(order), TOKEN_BASIS, np.uint64)
    step = 0
    while (active := int(np.searchsorted(falling, -step, "left"))) > FEW:
        h[:active] = (h[:active] ^ data[start[:active] + step]) * np.uint64(PRIME)
        step += 1
    for i in range(active):
        h[i] = _fold(data[start[i] + step : start[i] - falling[i]].tobytes(), int(h[i]))
    out = np.empty(len(order), np.uint64)
    out[order] = h
    return out[coded.indices.to_numpy(zero_copy_only=False)]


def shingle_hashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The hash of the nine token hashes from each start on."""
    basis = np.uint64(SHINGLE_BASIS % (1 << 64))
    h = np.full(len(starts), basis, np.uint64)
    for j in range(SHINGLE):
        h ^= hashes[starts + j] + basis + (h << np.uint64(6)) + (h >> np.uint64(2))
    return h


def hashed_shingles(stride: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (segment, did, toks) to batches of (segment, h, did, pos)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, did, toks = (batch.column(i) for i in range(3))
            hashes = token_hashes(toks.flatten())
            n = toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            first = np.cumsum(n) - n
            each = np.minimum(np.where(n >= SHINGLE, (n - SHINGLE) // stride + 1, 0), most)
            ends = np.cumsum(each)
            for low in range(0, int(each.sum()), ROWS):
                k = np.arange(low, min(low + ROWS, int(ends[-1])))
                row = np.searchsorted(ends, k, "right")
                pos = (k - (ends - each)[row]) * stride
                h = shingle_hashes(hashes, first[row] + pos)
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([segment.take(taken), pa.array(h.view(np.int64)), did.take(taken), pa.array(pos.astype(np.int32))], ["segment", "h", "did", "pos"])

    return run
