"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, after A-Z became
a-z.  All of these are single-byte characters in UTF-8, so byte work and code
point work give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
LONG = 64  # bytes up to which words are hashed together


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text is an empty one."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes, or one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, and each text's first word (and their number at last).

    ``space`` says of each byte value whether it separates words.
    """
    low = LOWER[data]
    solid = ~space[low]
    before = np.empty(len(low) + 1, bool)
    before[0] = False
    before[1:] = solid
    edges = offsets[offsets < len(low)]
    before[edges] = False
    starts = np.flatnonzero(solid & ~before[:-1])
    before[1:] = solid
    after = before[1:].copy()
    after[:-1] = solid[1:]
    if len(after):
        after[-1] = False
    inner = offsets[(offsets > 0) & (offsets <= len(low))] - 1
    after[inner] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of ``data`` the eight bytes from there on, as a little-endian value; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 8,), "<u8", padded, strides=(1,))


def head(at: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first bytes of each piece, eight at most, from :func:`eights`."""
    return at[starts] & _MASK[np.minimum(sizes, 8)]


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes are taken in eight at a time, each time through :func:`mix64`.

    Words of over ``LONG`` bytes have their XXH64.
    """
    n, at = ends - starts, eights(low)
    h = mix64(n.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(1))
    now = np.flatnonzero(n <= LONG)
    for k in range(0, LONG, 8):
        now = now[n[now] > k]
        if not len(now):
            break
        h[now] = mix64((h[now] ^ head(at, starts[now] + k, n[now] - k)) * _U(0x9E3779B97F4A7C15) + _U(k + 1))
    long = np.flatnonzero(n > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(low))
        h[long] = [xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def hash_word(word: bytes) -> int:
    """The same hash for one word given as bytes."""
    low = LOWER[np.frombuffer(word, np.uint8)]
    return int(word_hashes(low, np.array([0]), np.array([len(low)]))[0])
