"""Vectorised word and shingle hashes of whole texts.

Words are maximal runs of bytes other than ``[\\x20\\x09-\\x0D]`` of the UTF-8 text
with A-Z lower-cased. No word or text is cut: long batches are worked through in
pieces that end between words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 22
_rng = np.random.default_rng(0x5EED)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a permutation of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its offsets; null counts as empty."""
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and for each text the number of its first word.

    The second array has one entry more than there are texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    fresh[1:] = space[:-1]
    inner = offsets[:-1]
    fresh[inner[inner < n]] = True
    starts = np.flatnonzero(fresh & ~space)
    first = np.searchsorted(starts, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        stop = int(np.searchsorted(starts, starts[k] + PIECE, "right")) - 1
        stop = max(k + 1, stop)
        lo, hi = starts[k], starts[stop] if stop < len(starts) else n
        if stop == len(starts) - 1 and n - lo <= 2 * PIECE:
            stop, hi = len(starts), n
        own = starts[k:stop] - lo
        piece = data[lo:hi]
        value = _BYTE[_LOWER[piece]]
        value[space[lo:hi]] = 0
        lengths = np.diff(np.append(own, hi - lo))
        at = np.arange(hi - lo) - np.repeat(own, lengths)
        powers = _POWERS if (top := int(lengths.max())) <= len(_POWERS) else _powers(top)
        value *= powers[at]
        # the length of the word itself is not needed: every byte's value is odd or even
        # at random, and equal sums of different words have the chance of any 64-bit hash
        out[k:stop] = mix(np.add.reduceat(value, own))
        k = stop
    return out, first


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles of one text's word hashes.

    Fewer than ``n`` words make one shingle of the whole sequence; no word, none.
    """
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    count = len(hashes) - width + 1
    total = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : k + count] * _PLACE[k]
    return np.unique(mix(total))
