"""Sorted number arrays in few bytes, and files of them in the shared folder.

Operators that count or group very many hashes reduce them within a task first and send one packed blob per task and bucket through
the shuffle, so that a hot key costs one entry per task and rows stay few.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs

_U = np.uint64
_pack, _unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _planes(a: np.ndarray) -> bytes:
    """The k-th bytes of all numbers together: those that are always 0 then cost nothing."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(len(a), 8).T).tobytes()


def _joined(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).reshape(-1).view("<u8")


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, of any non-negative numbers below 2**64, as they are."""
    n = len(columns[0])
    return n.to_bytes(8, "little") + _pack.compress(b"".join(map(_planes, columns))) if n else bytes(8)


def restored(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    if not n:
        return [np.zeros(0, _U)] * columns
    raw = _unpack.decompress(blob[8:], max_output_size=8 * n * columns)
    return [_joined(raw[8 * n * i : 8 * n * (i + 1)], n) for i in range(columns)]


def pack(keys: np.ndarray, *others: np.ndarray) -> bytes:
    """keys: sorted uint64; others: as long, of any non-negative numbers below 2**64."""
    step = keys.copy()
    step[1:] -= keys[:-1]
    return squeezed(step, *others)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    out = restored(blob, columns)
    out[0] = np.cumsum(out[0], dtype=_U)
    return out


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and each value summed by key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[at], *(np.add.reduceat(v[order], at) for v in values))


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, _U)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))).astype(_U)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the top half of a hash: rising with it."""
    return (((h >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rising indices) of each bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def rows(got: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["bucket", "blob"])


BLOB_ROWS = "bucket int, blob binary"


def put(uri: str, *arrays: np.ndarray) -> None:
    """Writes the arrays' bytes one after another; a file appears whole or not at all, and a repeated task replaces it by the same bytes."""
    where, path = fs.FileSystem.from_uri(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    where.create_dir(os.path.dirname(path), recursive=True)
    with where.open_output_stream(part) as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
    where.move(part, path)


#: Files that a worker keeps mapped at most.
HELD = 512
_held: OrderedDict[str, memoryview] = OrderedDict()


def mapped(uri: str) -> memoryview:
    """The file's bytes, memory-mapped; a worker keeps the HELD files that it used last. From a store that can't be mapped a file is fetched first,
    when it is needed, to a local one that has no name any more."""
    if uri in _held:
        _held.move_to_end(uri)
        return _held[uri]
    while len(_held) >= HELD:
        _held.popitem(last=False)
    where, path = fs.FileSystem.from_uri(uri)
    if isinstance(where, fs.LocalFileSystem):
        with open(path, "rb") as f:
            _held[uri] = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
    else:
        import shutil
        import tempfile

        with where.open_input_stream(path) as src, tempfile.TemporaryFile() as f:
            shutil.copyfileobj(src, f, 1 << 22)
            f.flush()
            _held[uri] = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
    return _held[uri]
