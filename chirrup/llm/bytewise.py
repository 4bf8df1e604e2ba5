"""Words, shingles and rolling hashes of many texts at once, by numpy over their UTF-8 bytes.

Texts arrive as Arrow string columns; their buffers are used where they lie. A *slice* is a run of
whole texts of about ``SLICE`` bytes; working memory is a small multiple of a slice, or of the
longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U64 = np.uint64
_rng = np.random.default_rng(20240607)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0 … n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE), base, U64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; null texts are empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Sums by which the hash of any range follows: see ``range_hash``."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in each range, equal for equal bytes wherever they stand."""
    return mixed((sums[end] - sums[start]) * powers(_BASE_INVERSE, len(sums))[start] + (end - start).astype(U64) * U64(_BASE))


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, letters A-Z lowered, and the index of the text it stands in."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    sums = prefix_sums(_BYTE[_LOWER[data]])
    return range_hash(sums, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5, weights: np.ndarray | None = None) -> list:
    """Per text its distinct shingles, hashed and sorted; a shorter text is one shingle, an empty one has none.

    With ``weights`` (by the leading bits of a word's hash) a pair: the shingles, and the sum of the
    weights of each one's words.
    """
    words, owner = word_hashes(data, offsets)
    n = len(words)
    counts = np.bincount(owner, minlength=len(offsets) - 1) if n else np.zeros(len(offsets) - 1, np.int64)
    begins = np.concatenate([[0], np.cumsum(counts)])
    wide = np.zeros(max(n - width + 1, 0), U64)
    for k in range(width if len(wide) else 0):
        wide += words[k : n - width + 1 + k] * _PLACE[k]
    wide = mixed(wide)
    heavy = None
    if weights is not None:
        own = weights[word_buckets(words, len(weights))]
        heavy = sum(own[k : n - width + 1 + k] for k in range(width)) if len(wide) else np.zeros(0, weights.dtype)
    out = []
    for i, c in enumerate(counts):
        a = begins[i]
        if c >= width:
            s = wide[a : a + c - width + 1]
        elif c:
            s = mixed(np.array([(words[a : a + c] * _PLACE[8 : 8 + c]).sum(dtype=U64) + U64(c)]))
        else:
            s = np.zeros(0, U64)
        if weights is None:
            out.append(np.unique(s))
        elif c >= width:
            s, first = np.unique(s, return_index=True)
            out.append((s, heavy[a + first]))
        else:
            out.append((s, np.zeros(len(s), weights.dtype)))
    return out


def word_buckets(words: np.ndarray, n: int) -> np.ndarray:
    """The leading bits of words' hashes; ``n`` is a power of two."""
    return (words >> U64(64 - (n - 1).bit_length())).astype(np.int64)
