"""Words of many texts at once, in numpy.

Texts come as an Arrow string array; its byte buffer is used as it is, in
chunks of whole texts, so that memory follows the chunk and the longest text.
A word is a maximal run of bytes other than U+0020 and U+0009 to U+000D, which
in UTF-8 is the same as of characters.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = 0x9E3779B97F4A7C15 | 5  # multiplier of the polynomial; 5 modulo 8 has the longest period
_INV = pow(_ODD, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=U)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to the size of usual chunks."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Chunk:
    """Whole texts and their words: ``first`` is the row of the first text;
    word w is bytes starts[w]:ends[w]; text t has words at[t]:at[t + 1]."""

    def __init__(self, first: int, raw: np.ndarray, offsets: np.ndarray):
        self.first, self.raw, self.offsets = first, raw, offsets
        self.n = len(offsets) - 1
        word = ~IS_SPACE[raw]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = word[edge]
        last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        stops[last] = word[last]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(stops) + 1
        self.at = np.searchsorted(self.starts, offsets)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.at))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """64-bit hash of each word; with ``lower``, of its form with A-Z lowered."""
        n = len(self.raw)
        terms = (_BYTE[LOWER] if lower else _BYTE)[self.raw]
        terms *= powers(_ODD, n)
        sums = np.zeros(n + 1, U)
        np.cumsum(terms, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * powers(_INV, n)[self.starts])


def chunks(texts: pa.Array, limit: int = 1 << 20) -> Iterator[Chunk]:
    """The texts in chunks of about ``limit`` bytes, at least one text each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Chunk(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def windows(values: np.ndarray, at: np.ndarray, k: int, base: int = 0xD1342543DE82EF95) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` values inside one text, and the new ``at``.

    The hash of the run that starts at value i of text t is at i - k + 1 places
    fewer per earlier text; ``position`` of each follows from the counts."""
    counts = np.maximum(np.diff(at) - k + 1, 0)
    n = len(values)
    terms = values * powers(base, n) if n else values
    sums = np.zeros(n + 1, U)
    np.cumsum(terms, out=sums[1:])
    new = np.concatenate(([0], np.cumsum(counts)))
    start = np.arange(new[-1]) + np.repeat(at[:-1] - new[:-1], counts)
    inverse = powers(pow(base, -1, 1 << 64), n)
    return mix((sums[start + k] - sums[start]) * inverse[start]), new

