"""Vectorised word splitting and 64-bit hashing over the raw UTF-8 bytes of Arrow string columns.

A word class is a set of bytes. Bytes of 0x80 and more only occur in multi-byte characters, so a class that
holds all of them splits UTF-8 exactly as the same class of code points splits the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_MUL = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(U, copy=True)
    x += _MUL
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """True for each byte outside the given inclusive ranges."""
    keep = np.ones(256, bool)
    for lo, hi in excluded:
        keep[lo : hi + 1] = False
    return keep


#: [^\x20\x09-\x0D]+ : runs without ASCII white space
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, lower-case letters and everything outside ASCII
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z become a-z
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = np.cumprod(np.concatenate([np.ones(1, U), np.full(4095, 0x100000001B3, U)]))


def text_chunks(column: pa.Array, most_bytes: int = 512 << 10):
    """(first row, bytes, offsets) of slices of about most_bytes; a longer row makes a slice of its own.

    Nulls count as empty texts. Memory is bounded by most_bytes or the longest text.
    """
    column = column.cast(pa.large_string()) if column.null_count == 0 else column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most_bytes, "right")) - 1)
        yield at, raw[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, index of each row's first word plus the end)."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    low = LOWER[data]
    inside = words[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(first)
    firsts = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, U), firsts
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    lengths = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, lengths)
    longest = int(lengths.max())
    powers = _powers if longest <= len(_powers) else np.cumprod(np.concatenate([np.ones(1, U), np.full(longest, 0x100000001B3, U)]))
    value = (low[at].astype(U) + U(1)) * powers[place]
    return mix(np.add.reduceat(value, begin) ^ (lengths.astype(U) << U(48))), firsts


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position; positions whose words run over the end are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.zeros(n, U)
    factor = 2 * k + 1
    for j in range(k):
        total += mix(words[j : j + n] ^ U(j + 1)) * U(factor)
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
    return mix(total ^ U(k))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
