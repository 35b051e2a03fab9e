"""A bitmap of hashes of fixed size, built on the executors and merged by range."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tiergraph.llm._pack import BLOBS, batch, dealt, pack, unpack_all


def _part(bits: int, shard_bits: int):
    low = 1 << (bits - shard_bits)

    def run(batches):
        for b in batches:
            spot = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            yield batch([(k, pack(np.diff(c, prepend=0).astype(np.uint32))) for k, (c,) in dealt(spot // low, 1 << shard_bits, spot % low)])

    return run


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        seen = np.zeros(width, bool)
        for blob in table.column("blob"):
            seen[np.cumsum(unpack_all([blob.as_py()])[0].astype(np.int64))] = True
        return pa.table({"key": table.column("key")[:1].cast(pa.int32()), "blob": [np.packbits(seen, bitorder="little").tobytes()]})

    return run


def bitmap(hashes: DataFrame, bits: int) -> bytes:
    """``hashes`` has one column of 64-bit hashes; bit h >> (64 - bits) is set for each."""
    shard_bits = min(6, bits - 10)
    merged = hashes.mapInArrow(_part(bits, shard_bits), BLOBS).groupBy("key").applyInArrow(_merge(1 << (bits - shard_bits)), BLOBS)
    out, step = np.zeros(1 << (bits - 3), np.uint8), 1 << (bits - shard_bits - 3)
    for key, blob in merged.collect():
        out[key * step : (key + 1) * step] = np.frombuffer(blob, np.uint8)
    return out.tobytes()


def holds(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(found).bit_length() + 2
    spot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    return (found[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
