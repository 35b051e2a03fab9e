"""Texts in blocks of a bounded size, which ask shards about what they hold.

A block is a part of one partition.  It sends each distinct hash it holds to the
shard of that hash once, however many of its texts hold it, and the shard answers the block.
So a hash that every text holds costs a row for each block, and neither side
grows with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tiergraph.llm._words import U

DEALT = "shard int, block long, data binary"
TEXTS = -1  # the shard of a block's own texts


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the hash."""
    return (hashes >> U(32)) * U(shards) >> U(32)


def frozen(rows: list[pa.RecordBatch]) -> bytes:
    texts = pa.Table.from_batches(rows).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(texts)
    return sink.getvalue().to_pybytes()


def thawed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def rows(shards: list[int], blocks: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blocks, pa.int64()), pa.array(data, pa.binary())], ["shard", "block", "data"])
