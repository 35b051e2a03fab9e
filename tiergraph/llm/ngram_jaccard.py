"""Documents that are near duplicates by the Jaccard similarity of word n-grams.

A document can only be similar to another set if few of its n-grams are its own:
with similarity t or more, at least t of them occur in a second document.  So the
n-grams are counted first:

1. Every partition deals its texts into blocks, and sends the n-grams of each
   block, once each with the number of texts that hold them, to a shard by hash.
   A shard answers each block with those of its n-grams that two or more texts of
   the corpus hold, and how many.  A block asks once, however many of its texts
   hold an n-gram, and no table of all n-grams exists in one place.  (Within a
   shard n-grams are told apart by 32 bits; a mix-up only makes one look shared.)
2. With the answers each block finds the documents that can be similar to others
   and their prefixes: of n-grams ordered from the rarest to the most common, the
   first ``n - ceil(t * n) + 1``.  Two similar sets share an n-gram of their prefixes.
   Everything below works on these documents and their shared n-grams alone.
3. In each group of documents with one prefix n-gram the others meet a pivot, the
   member with the fewest n-grams of its own; a link joins components.
4. Groups that overlap are one cluster.  Clusters that are still in several
   components are cut into size bands, and these into tiles of a bounded number
   of n-grams.  Tiles of a band meet each other and those of the next band, but two
   tiles within the largest component do not meet.  So no pair is left out that
   a link could join, and a group of copies costs a row for each.

In a tile, and for pivots, every document has a hashed bitmap of its shared
n-grams.  The bits that only one of two documents has bound the overlap from
above, by bit counts alone; pairs that pass are verified by the exact
intersection of sorted arrays.  A tile returns only links that join components,
less than it has documents.

Equal sets are one class from the start (by a 64-bit hash of the set), so exact
copies cost one row each.  N-grams are told apart by 64-bit hashes.

Defined results: null texts and texts without words have no n-grams and are
their own component; texts with fewer than ``n`` words have their whole word
sequence as one; null ids rank as larger than all; every row gets a
result, rows with equal ids too; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.components import components
from tiergraph.llm._blocks import DEALT, TEXTS, frozen, rows, shard_of, thawed
from tiergraph.llm._memory import returning, returning_group, returning_groups
from tiergraph.llm._pack import pack, unpack
from tiergraph.llm._words import U, Chunk, chunks, mix, powers, windows
from tiergraph.plans.shared import dropped, release, written

BLOCK = 1 << 20  # n-grams and texts of a block
TILE = 1 << 19  # n-grams of a tile
NO_ID = np.iinfo(np.int64).max
_SHORT = 0xA0761D6478BD642F
_LOW = U(0xFFFFFFFF)


def shingle_sets(chunk: Chunk, n: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text, and where each text's begin."""
    words = chunk.hashes(lower)
    grams, at = windows(words, chunk.at, n)
    count = np.diff(chunk.at)
    short = np.flatnonzero((count > 0) & (count < n))
    doc = np.repeat(np.arange(chunk.n), np.diff(at))
    if len(short):
        power = powers(0xD1342543DE82EF95, n)
        whole = [mix((words[a:b] * power[: b - a]).sum(dtype=U, keepdims=True) + U(_SHORT + int(b - a)))[0] for a, b in zip(chunk.at[short], chunk.at[short + 1], strict=True)]
        grams, doc = np.concatenate((grams, np.array(whole, U))), np.concatenate((doc, short))
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(chunk.n + 1))


def classes(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(grams + U(7)), dtype=U)))
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U))


def _first(values: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind."""
    out = np.zeros(len(values), bool)
    out[np.unique(values, return_index=True)[1]] = True
    return out


def _dealt(n: int, lower: bool, shards: int):
    """For each block a row with its texts (shard -1) and a row for each shard with its n-grams."""

    def run(batches):
        base, held, texts, size, number = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def flush():
            grams, count = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(shard_of(grams, shards), np.arange(shards + 1).astype(U))
            low = (grams & _LOW).astype(np.uint32)
            key, data = [TEXTS], [frozen(texts)]
            for s in np.flatnonzero(np.diff(cut)).tolist():
                value, times = low[cut[s] : cut[s + 1]], count[cut[s] : cut[s + 1]]
                order = np.argsort(value, kind="stable")
                value, times = value[order], times[order]
                key.append(s)
                data.append(pack(np.diff(value, prepend=np.uint32(0)), times.astype(np.uint32)))
            return rows(key, [base + number] * len(key), data)

        for b in batches:
            ids, column = b.column(0).cast(pa.int64()), b.column(1)
            for chunk in chunks(column):
                grams, at = shingle_sets(chunk, n, lower)
                fresh = _first(classes(grams, at))
                held.append(grams[np.repeat(fresh, np.diff(at))])
                texts.append(pa.RecordBatch.from_arrays([ids.slice(chunk.first, chunk.n), column.slice(chunk.first, chunk.n)], ["id", "text"]))
                size += len(grams) + chunk.n
                if size >= BLOCK:
                    yield flush()
                    held, texts, size, number = [], [], 0, number + 1
        if size:
            yield flush()

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each block its n-grams that two or more texts hold, with four times the
    logarithm of how many."""
    shard, blocks, parts = table.column("shard")[0].as_py(), table.column("block").to_pylist(), [unpack(x.as_py()) for x in table.column("data")]
    value = np.concatenate([np.cumsum(p[0], dtype=np.uint32) for p in parts])
    count = np.concatenate([p[1] for p in parts])
    kind, back = np.unique(value, return_inverse=True)
    total = np.bincount(back, count, len(kind))
    level = np.where(total >= 2, np.minimum(4 * np.log2(total), 255), 0).astype(np.uint8)[back]
    edge = np.cumsum([0, *(len(p[0]) for p in parts)])
    out = []
    for block, x, y in zip(blocks, edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        shared = np.flatnonzero(level[x:y]) + x
        if len(shared):
            out.append((block, pack(value[shared], level[shared])))
    return pa.Table.from_batches([rows([shard] * len(out), [x[0] for x in out], [x[1] for x in out])])


def prefix(grams: np.ndarray, level: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Of a set of ``size`` n-grams, of which ``grams`` are shared, those of the prefix.

    The n-grams that are not shared come first in the order and meet nothing."""
    least = -(-size * percent // 100)
    return grams[np.lexsort((grams, level))[: max(0, len(grams) - least + 1)]]


def width(sizes: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set of each size: powers of two, four times the size or more."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(4 * sizes, 1))).astype(np.int64), 9, 16)


def bitmap(grams: np.ndarray) -> bytes:
    flags = np.zeros(int(width(np.array(len(grams)))), bool)
    flags[(grams >> U(20) & U(len(flags) - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, all of the least width among them."""
    least = min(map(len, maps))
    out = np.empty((len(maps), least // 8), U)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, U).reshape(-1, least // 8)
        out[i] = x[0] if len(x) == 1 else np.bitwise_or.reduce(x)
    return out


def may_link(n_a, shared_a, map_a: np.ndarray, n_b, shared_b, map_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the upper bound of the overlap, from bit counts, allows a link.

    n: sizes of the sets; shared: how many of their n-grams the bitmaps hold."""
    need = -(-(n_a + n_b) * percent // (100 + percent))
    most_a = shared_a - np.bitwise_count(map_a & ~map_b).sum(-1, dtype=np.int64)
    most_b = shared_b - np.bitwise_count(map_b & ~map_a).sum(-1, dtype=np.int64)
    return np.minimum(most_a, most_b) >= need


def linked(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int, percent: int) -> bool:
    """Exact intersection of two sorted arrays, of sets of n_a and n_b n-grams."""
    if not len(a) or not len(b):
        return False
    spot = np.searchsorted(b, a)
    spot[spot == len(b)] = 0
    shared = int((b[spot] == a).sum())
    return 100 * shared >= percent * (n_a + n_b - shared)


MET = "kind int, k long, n long, data binary, map binary, prefix array<long>"
DOCS, CLASS = 0, 1


def _met(n: int, percent: int, lower: bool, shards: int):
    """Of a block and its answers: the class and size of every text, and the classes
    that may be similar to others with their shared n-grams, bitmaps and prefixes."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [(s, *unpack(x)) for s, x in sorted(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True))]
        known = np.concatenate([np.zeros(0, U), *(U(s << 32) | v.astype(U) for s, v, _ in parts)])
        rank = np.concatenate([np.zeros(0, np.uint8), *(x[2] for x in parts)])
        out = {c: [] for c in ("kind", "k", "n", "data", "map", "prefix")}
        seen = set()

        def add(*row):
            for c, x in zip(out.values(), row, strict=True):
                c.append(x)

        for data in texts.column("data").to_pylist():
            block = thawed(data)
            ids = block.column("id").combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for chunk in chunks(block.column("text")):
                grams, at = shingle_sets(chunk, n, lower)
                size, fp = np.diff(at), classes(grams, at)
                add(DOCS, None, None, pack(ids[chunk.first : chunk.first + chunk.n], fp, size), None, None)
                level = np.zeros(len(grams), np.uint8)
                if len(known):
                    asked = shard_of(grams, shards) << U(32) | grams & _LOW
                    spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                    level = np.where(known[spot] == asked, rank[spot], 0)
                shared = np.concatenate(([0], np.cumsum(level > 0)))
                shared = shared[at[1:]] - shared[at[:-1]]
                for i in np.flatnonzero((size > 0) & (shared >= -(-size * percent // 100))).tolist():
                    if (key := int(fp[i])) in seen:
                        continue
                    seen.add(key)
                    own = np.flatnonzero(level[at[i] : at[i + 1]]) + at[i]
                    g = grams[own]
                    add(CLASS, int(fp[i : i + 1].view(np.int64)[0]), int(size[i]), g.tobytes(), bitmap(g), prefix(g, level[own], int(size[i]), percent).view(np.int64))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.table({c: pa.array(x, t) for (c, x), t in zip(out.items(), kinds, strict=True)})

    return run


def _docs_of(batches):
    for b in batches:
        for blob in b.column(0):
            ids, fp, count = unpack(blob.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(fp.view(np.int64)), pa.array(count.astype(np.int64))], ["_id", "_k", "_n"])


def _array(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), U)


def _verified(percent: int):
    """Of pairs (a, b, sizes, bitmaps, sets): the links."""

    def run(batches):
        for b in batches:
            ok = []
            for i, (n, m, p, q, x, y) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), b.column(6), b.column(7), strict=True)):
                x, y = _array(x), _array(y)
                one, two = folded([p, q])
                if may_link(n, len(x), one, m, len(y), two, percent) and linked(x, n, y, m, percent):
                    ok.append(i)
            yield b.select(["a", "b"]).take(pa.array(ok, pa.int64()))

    return run


def _tile(percent: int):
    """Of a tile: links that join components, as few as do."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("_n").to_numpy()
        order = np.argsort(n, kind="stable")
        n, k, side = n[order], table.column("_k").to_numpy()[order], table.column("_side").to_numpy()[order]
        _, c = np.unique(table.column("_c").to_numpy()[order], return_inverse=True)
        data, maps = table.column("_data").combine_chunks(), table.column("_map").combine_chunks()
        sets = [_array(data[i]) for i in order.tolist()]
        m, shared = folded([maps[i].as_py() for i in order.tolist()]), np.array(list(map(len, sets)))
        a, b = [], []
        for i in range(len(n) - 1):
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // percent, "right")))
            # Sides: 0 where a tile meets itself, else 1 meets 2.
            j = j[(c[j] != c[i]) & ((side[i] == 0) | (side[j] != side[i]))]
            if len(j):
                j = j[may_link(n[i], shared[i], m[i], n[j], shared[j], m[j], percent)]
            for x in j.tolist():
                if c[x] != c[i] and linked(sets[i], int(n[i]), sets[x], int(n[x]), percent):
                    a.append(int(k[i]))
                    b.append(int(k[x]))
                    c[c == c[x]] = c[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _components(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("node").alias("_k"), F.col("component").alias("_c"))


def _tiles(found: DataFrame, part: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Rows (_tile, _side, _k, _c, _n, _data, _map) of the clusters that are in several components."""
    own = found.join(clusters.withColumnRenamed("_c", "_cluster"), "_k").join(part, "_k", "left").withColumn("_c", F.coalesce("_c", "_k"))
    count = own.groupBy("_cluster", "_c").count()
    several = count.groupBy("_cluster").agg(F.count("*").alias("_several"), F.max_by("_c", F.struct("count", "_c")).alias("_main")).where("_several > 1")
    # A little wider than the similarity allows, so that rounding moves no pair past the next band.
    band = F.floor(F.log("_n") / F.log(F.lit(100.001 / percent))).cast("int").alias("_band")
    own = own.join(several.select("_cluster", "_main"), "_cluster")
    own = written(own.select("_cluster", band, (F.col("_c") != F.col("_main")).alias("_out"), "_k", "_c", "_n", "_data", "_map"), "open")
    weight = own.groupBy("_cluster", "_band", "_out").agg(F.ceil(F.sum(F.length("_data")) / (8 * TILE)).cast("int").alias("_cuts"))
    key = ["_cluster", "_band", "_out"]
    rows = own.join(weight, key).withColumn("_cut", F.pmod(F.xxhash64("_k"), F.greatest("_cuts", F.lit(1))).cast("int"))
    cuts = weight.select(*key, F.explode(F.sequence(F.lit(0), F.greatest("_cuts", F.lit(1)) - 1)).alias("_cut"))
    x, y = cuts.where("_out").alias("x"), cuts.alias("y")
    meet = x.join(y, F.expr("x._cluster = y._cluster and abs(x._band - y._band) <= 1"))
    meet = meet.where("not y._out or (x._band, x._cut) <= (y._band, y._cut)")
    ends = [F.struct(*[F.col(f"{s}.{c}").alias(c) for c in (*key, "_cut")]) for s in "xy"]
    meet = meet.select(ends[0].alias("_x"), ends[1].alias("_y")).withColumn("_tile", F.xxhash64("_x", "_y"))
    sides = F.when(F.col("_x") == F.col("_y"), F.array(F.struct(F.col("_x").alias("_end"), F.lit(0).alias("_side"))))
    sides = sides.otherwise(F.array(F.struct(F.col("_x").alias("_end"), F.lit(1).alias("_side")), F.struct(F.col("_y").alias("_end"), F.lit(2).alias("_side"))))
    sides = meet.select("_tile", F.explode(sides).alias("_e")).select("_tile", "_e._side", "_e._end.*")
    return rows.join(sides, [*key, "_cut"]).select("_tile", "_side", "_k", "_c", "_n", "_data", "_map")


def ngram_jaccard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(id, n_shingles, component_id) for each row: the size of its set, and the
    least id that links reach from it."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    dealt = written(d.mapInArrow(returning(_dealt(n, lower, shards)), DEALT).withColumn("own", F.col("shard") == TEXTS), "dealt", by="own")
    texts, asked = dealt.where("own"), dealt.where("not own")
    answers = written(asked.drop("own").groupBy("shard").applyInArrow(returning_group(_answers), DEALT), "answers")
    dropped(dealt, "own=false")
    release(spark)
    both = texts.select("block", "data").groupBy("block").cogroup(answers.groupBy("block"))
    met = written(both.applyInArrow(returning_groups(_met(n, percent, lower, shards)), MET), "met")
    dropped(dealt)
    dropped(answers)
    release(spark)
    members = met.where(F.col("kind") == DOCS).select("data").mapInArrow(_docs_of, "_id long, _k long, _n long")
    found = met.where(F.col("kind") == CLASS).select(F.col("k").alias("_k"), F.col("n").alias("_n"), F.col("data").alias("_data"), F.col("map").alias("_map"), F.col("prefix").alias("_prefix"))
    found = written(found.dropDuplicates(["_k"]), "classes")

    # Each group's pivot has the fewest n-grams of its own.
    groups = found.select("_k", (F.col("_n") - F.length("_data") / 8).cast("long").alias("_own"), F.explode("_prefix").alias("_gram"))
    pivots = groups.groupBy("_gram").agg(F.min(F.struct("_own", "_k"))["_k"].alias("_pivot"), F.count("*").alias("_size")).where("_size > 1")
    pairs = groups.join(pivots, "_gram").where("_k <> _pivot").select(F.least("_k", "_pivot").alias("a"), F.greatest("_k", "_pivot").alias("b"))
    pairs = written(pairs.distinct(), "pairs")
    side = lambda x: found.select(F.col("_k").alias(x), *[F.col(c).alias(c + x) for c in ("_n", "_map", "_data")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_na", "_nb", "_mapa", "_mapb", "_dataa", "_datab")
    links = written(both.mapInArrow(returning(_verified(percent)), "a long, b long"), "links")
    release(spark)
    part = written(_components(links), "part")

    tiles = _tiles(found.drop("_prefix"), part, _components(pairs), percent)
    more = written(tiles.groupBy("_tile").applyInArrow(_tile(percent), "a long, b long"), "links")
    release(spark)
    if not more.isEmpty():
        part = written(_components(links.unionByName(more)), "part")
    known = members.join(part, "_k", "left").withColumn("_c", F.coalesce("_c", "_k"))
    least = known.where("_n > 0").groupBy("_c").agg(F.min("_id").alias("_least"))
    out = known.join(least, "_c", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}
ORACLES = {"op2_ngram_jaccard_join": OP2_SQL}
