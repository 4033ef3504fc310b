"""Vectorised text kernels over the UTF-8 buffer of an Arrow string column.

Everything works on a chunk of whole texts at once: `data` holds their bytes end to end and `offs` the n + 1 offsets.
Words are runs of bytes outside [\x20\x09-\x0D]; they get 64-bit hashes eight bytes at a time, so the cost
follows the number of words and not the number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_KEEP = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 8)] + [0xFFFFFFFFFFFFFFFF], dtype=_U)
_STEP = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def chunks(texts: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `size` bytes; a longer text is a run by itself. Nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z folded; other bytes stay."""
    return data | ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def not_space(data: np.ndarray) -> np.ndarray:
    return (data - np.uint8(9) > 4) & (data != 32)


def letters(data: np.ndarray) -> np.ndarray:
    """Letters, digits and bytes beyond ASCII."""
    return (data - np.uint8(48) < 10) | ((data | np.uint8(32)) - np.uint8(97) < 26) | (data > 127)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of each maximal run of true; runs never cross texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offs[(offs > 0) & (offs < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(not_space(data), offs)


def plain_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words, but ASCII punctuation separates too."""
    return runs(letters(data), offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte run."""
    size = ends - starts
    out = mix(size.astype(_U) * _STEP + _U(seed))
    if not len(starts):
        return out
    wide = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(16, np.uint8)]).tobytes(), strides=(1,))
    at, todo = 0, np.arange(len(starts))
    while len(todo):
        left = size[todo] - at
        got = wide[starts[todo] + at] & _KEEP[np.minimum(left, 8)]
        out[todo] = mix(out[todo] ^ got)
        todo = todo[left > 8]
        at += 8
    return out


def runs_of(values: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k values in a row that have one owner, and the index of the first of them."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    keep = np.flatnonzero(owner[:n] == owner[k - 1 :])
    out = np.zeros(len(keep), _U)
    for j in range(k):
        out = mix(out * _STEP + values[keep + j])
    return out, keep


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, end to end, and their n + 1 offsets. data is already lower case.

    A text of fewer than k words has its whole sequence as its only shingle; a text without words has none.
    """
    n = len(offs) - 1
    starts, ends, owner = words(data, offs)
    h = hashes(data, starts, ends)
    got, at = runs_of(h, owner, k)
    whose = owner[at]
    count = np.bincount(owner, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.concatenate([[0], np.cumsum(count)])
        extra = np.zeros(len(short), _U)
        for j in range(k - 1):
            live = count[short] > j
            extra[live] = mix(extra[live] * _STEP + h[first[short[live]] + j])
        extra = mix(extra ^ count[short].astype(_U))
        got, whose = np.concatenate([got, extra]), np.concatenate([whose, short])
        order = np.argsort(whose, kind="stable")
        got, whose = got[order], whose[order]
    bounds = np.searchsorted(whose, np.arange(n + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            got[a:b].sort()
    fresh = np.ones(len(got), bool)
    fresh[1:] = (got[1:] != got[:-1]) | (whose[1:] != whose[:-1])
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return got[fresh], kept[bounds]
