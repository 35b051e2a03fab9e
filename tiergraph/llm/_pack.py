"""Columns of numbers in one compressed binary value, for shuffles of many small rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

BLOBS = "key int, blob binary"
_SCHEMA = pa.schema([("key", pa.int32()), ("blob", pa.binary())])


def pack(*columns: np.ndarray) -> bytes:
    """All columns have the same length and 1, 2, 4 or 8 bytes an item."""
    head = np.array([len(columns), len(columns[0])], np.int64).tobytes() + b"".join(c.dtype.str.encode().ljust(4) for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    width, n = np.frombuffer(raw, np.int64, 2)
    at, out = 16 + 4 * int(width), []
    for i in range(int(width)):
        kind = np.dtype(raw[16 + 4 * i : 20 + 4 * i].decode().strip())
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += kind.itemsize * int(n)
    return out


def unpack_all(blobs) -> list[np.ndarray]:
    """The columns of several values, end to end."""
    parts = [unpack(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def dealt(keys: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns by key; rows of one key keep their order."""
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        rows = order[bounds[k] : bounds[k + 1]]
        yield int(k), [c[rows] for c in columns]


def batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], schema=_SCHEMA)
