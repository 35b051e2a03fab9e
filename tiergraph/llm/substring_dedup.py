"""Removal of passages that occur earlier in the corpus.

A window is ``k`` consecutive words of one text.  A word goes if it is covered
by a window whose words also start earlier: at a smaller id, or earlier in the
same text.

1. Count-min prefilter.  The anchors of a window are its least ``k // 2``-word
   run by hash; equal windows have equal anchors at different places, so the
   number of places of its anchor bounds a window's count from above.  Every
   partition sketches the anchors it meets; the partial sketches are merged by
   range, and what is kept is a bit per counter: seen at least twice.
2. Only windows whose anchor has that bit in every sketch row go on.  They are
   grouped exactly by a 128-bit hash: first inside a block of one partition,
   where all but the first place are settled at once, then by shuffle, one row
   for each block and window.  The least place stays, all others are marked.
3. Marks meet their text by a hash of the id, and covered words are left out.

The sketch follows the size of the input up to ``max_bits`` counters a row; a
fuller sketch lets more windows through to step 2 and loses none.

Defined results: a null text has no words; texts shorter than a window lose
nothing; null ids come before all others; rows with equal ids are ordered by
start alone, so places that tie are both first; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._pack import BLOBS, batch, dealt, pack, unpack_all
from tiergraph.llm._words import U, chunks, mix, powers, windows

BLOCK = 1 << 20
ROWS = 2
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best() of each run of ``width`` values, for the runs that fit."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def _anchors(words: np.ndarray, at: np.ndarray, k: int):
    """For the windows of each text: (start of each, anchor of each), and the
    anchors with one entry for each place."""
    run = k // 2
    grams, g_at = windows(words, at, run)
    counts = np.maximum(np.diff(at) - k + 1, 0)
    new = np.concatenate(([0], np.cumsum(counts)))
    within = np.arange(new[-1]) - np.repeat(new[:-1], counts)
    first = within + np.repeat(g_at[:-1], counts)
    span = k - run + 1
    if not len(first):
        return first, grams[:0], grams[:0], within, counts
    least = _sliding(grams, span, np.minimum)[first]
    spread = np.zeros(len(grams) + span - 1, U)
    spread[first + span - 1] = least
    chosen = grams[_sliding(spread, span, np.maximum) == grams]
    return within + np.repeat(at[:-1], counts), least, chosen, within, counts


def _counters(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = U((1 << bits) - 1)
    return [(hashes & mask).astype(np.int64), (mix(hashes + U(1)) & mask).astype(np.int64)]


def _sketch_part(bits: int, shard_bits: int, k: int):
    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            rows = []
            for r, counter in enumerate(_counters(np.concatenate(held), bits)):
                value, n = np.unique(counter, return_counts=True)
                value = np.sort(np.concatenate((value, value[n > 1])))  # twice is enough
                low = 1 << (bits - shard_bits)
                for shard, (c,) in dealt(value // low, 1 << shard_bits, value % low):
                    rows.append((r << shard_bits | shard, pack(np.diff(c, prepend=0).astype(np.uint32))))
            return batch(rows)

        for b in batches:
            for chunk in chunks(b.column(0)):
                chosen = _anchors(chunk.hashes(), chunk.at, k)[2]
                held.append(chosen)
                size += len(chosen)
                if size >= 2 * BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _merge(width: int):
    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(width, np.uint8)
        for blob in table.column("blob"):
            c = np.cumsum(unpack_all([blob.as_py()])[0].astype(np.int64))
            once, n = np.unique(c, return_counts=True)
            count[once] = np.minimum(count[once] + n.astype(np.uint8), 2)
        return pa.table({"key": table.column("key")[:1].cast(pa.int32()), "blob": [np.packbits(count > 1, bitorder="little").tobytes()]})

    return run


def repeated_bits(docs: DataFrame, bits: int, k: int) -> list[np.ndarray]:
    """A bitmap for each sketch row: which counters reached two."""
    shard_bits = min(6, bits - 10)
    parts = docs.select("_t").mapInArrow(_sketch_part(bits, shard_bits, k), BLOBS)
    merged = parts.groupBy("key").applyInArrow(_merge(1 << (bits - shard_bits)), BLOBS).collect()
    out = [np.zeros(1 << (bits - 3), np.uint8) for _ in range(ROWS)]
    step = 1 << (bits - shard_bits - 3)
    for key, blob in merged:
        r, shard = divmod(key, 1 << shard_bits)
        out[r][shard * step : (shard + 1) * step] = np.frombuffer(blob, np.uint8)
    return out


def _has(bitmap: np.ndarray, i: np.ndarray) -> np.ndarray:
    return (bitmap[i >> 3] >> (i & 7).astype(np.uint8)) & 1 == 1


def _first_places(h1, h2, ids, starts):
    """Order by window and place; which rows of that order are a window's least place."""
    order = np.lexsort((starts, ids, h2, h1))
    h1, h2, ids, starts = h1[order], h2[order], ids[order], starts[order]
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(new) else np.zeros(0, int)
    least = (ids == ids[head]) & (starts == starts[head])
    return h1, h2, ids, starts, new, least


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U)) % U(n)).astype(np.int64)


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _windows_part(bitmaps, bits: int, k: int, n: int):
    def run(batches):
        maps = [np.frombuffer(m, np.uint8) for m in bitmaps.value]
        held: list[tuple] = []
        size = 0

        def flush():
            h1, h2, ids, starts, new, least = _first_places(*(np.concatenate(c) for c in zip(*held, strict=True)))
            gone, one = ~least, new  # places that tie with the first are rows of one id
            rows = [(key, pack(*c)) for key, c in dealt((h1[one] >> U(32)).astype(np.int64) * n >> 32, n, h1[one], h2[one], ids[one], starts[one])]
            rows += [(n + key, pack(*c)) for key, c in dealt(_bucket(ids[gone], n), n, ids[gone], starts[gone])]
            return batch(rows)

        for b in batches:
            all_ids = _ids(b.column(0))
            for chunk in chunks(b.column(1)):
                words = chunk.hashes()
                start, least, _, within, counts = _anchors(words, chunk.at, k)
                keep = np.ones(len(least), bool)
                for bitmap, counter in zip(maps, _counters(least, bits), strict=True):
                    keep &= _has(bitmap, counter)
                start, within = start[keep], within[keep].astype(np.int32)
                if not len(start):
                    continue
                doc = np.repeat(np.arange(chunk.n), counts)[keep] + chunk.first
                hashes = []
                for base in _BASES:
                    sums = np.zeros(len(words) + 1, U)
                    np.cumsum(words * powers(base, len(words)), out=sums[1:])
                    inverse = powers(pow(base, -1, 1 << 64), len(words))
                    hashes.append(mix((sums[start + k] - sums[start]) * inverse[start]))
                held.append((*hashes, all_ids[doc], within))
                size += len(start)
                if size >= BLOCK:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


def _settle(n: int):
    def run(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        columns = unpack_all(x.as_py() for x in table.column("blob"))
        if key < n:
            _, _, ids, starts, _, least = _first_places(*columns)
            ids, starts = ids[~least], starts[~least]
        else:
            ids, starts = columns
        rows = [(k, pack(*c)) for k, c in dealt(_bucket(ids, n), n, ids, starts)]
        return pa.Table.from_batches([batch(rows)])

    return run


def _cover(k: int, with_text: bool):
    def run(texts: pa.Table, marks: pa.Table) -> pa.Table:
        ids, starts = unpack_all(x.as_py() for x in marks.column("blob")) if marks.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        order = np.argsort(ids, kind="stable")
        ids, starts = ids[order], starts[order]
        doc_ids = texts.column("_id").combine_chunks()
        own = _ids(doc_ids)
        lo, hi = np.searchsorted(ids, own), np.searchsorted(ids, own, "right")
        n_words, n_removed, digest, kept_text = [], [], [], []
        for text, a, b in zip(texts.column("_t"), lo.tolist(), hi.tolist(), strict=True):
            words = (text.as_py() or "").encode().split()  # on bytes: exactly the six white-space bytes
            n = len(words)
            if b > a:
                step = np.zeros(n + k + 1, np.int32)
                mine = np.unique(starts[a:b])
                mine = mine[mine <= n - k]  # rows of one id may have texts of different lengths
                step[mine] += 1
                step[mine + k] -= 1
                stay = np.cumsum(step)[:n] == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            left = b" ".join(words)
            n_words.append(n)
            n_removed.append(n - len(words))
            digest.append(hashlib.sha256(left).hexdigest())
            if with_text:
                kept_text.append(left.decode())
        out = {"_id": doc_ids.cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(kept_text, pa.string())
        return pa.table(out)

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 20, max_bits: int = 29, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for each row."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    size = int(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    bits = min(max_bits, max(20, (size // 4).bit_length()))
    bitmaps = spark.sparkContext.broadcast([b.tobytes() for b in repeated_bits(d, bits, k)])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = d.mapInArrow(_windows_part(bitmaps, bits, k, n), BLOBS).groupBy("key").applyInArrow(_settle(n), BLOBS)
    texts = d.mapInArrow(_dealt_texts(n), "key int, _id long, _t string")
    schema = "_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = texts.groupBy("key").cogroup(marks.groupBy("key")).applyInArrow(_cover(k, with_text), schema)
    return out.withColumnRenamed("_id", id_col)


def _dealt_texts(n: int):
    def run(batches):
        for b in batches:
            key = pa.array(_bucket(_ids(b.column(0)), n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([key, b.column(0), b.column(1)], ["key", "_id", "_t"])

    return run


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs, with_text=False)


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS p,
    unnest(list_transform(range(1, len(w) - 18), lambda i: md5(array_to_string(w[i:i+19], ' ')))) AS h
  FROM w WHERE len(w) >= 20
), m AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM g) WHERE r > 1
), c AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(p, p + 20))))) AS gone FROM m GROUP BY doc_id
), e AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM w
), k AS (
  SELECT e.doc_id, string_agg(t, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM e LEFT JOIN (SELECT doc_id, unnest(gone) AS i FROM c) q USING (doc_id, i) WHERE q.doc_id IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, (len(w.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES = {"op5_substring_dedup": OP5_SQL}
