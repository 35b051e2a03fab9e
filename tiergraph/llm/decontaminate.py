"""Benchmark decontamination with DataFrame functions only.

Size-partitioned MinHash containment search: the shingles of a test item are
ordered by hash, and the item's sketch is its ``k`` least hashes, where ``k``
depends on the item's size class (sizes of one power of two).  A document with
at least ``threshold`` of the item's ``n`` shingles misses at most
``n - ceil(threshold * n)`` of them, so with one more in the sketch it must hold
a sketch hash: the search loses nothing, however long the document is.  The
candidates are then verified by exact containment of the shingle strings.

Words are maximal runs of letters and digits of the lower-cased text, so that
case and punctuation do not hide a copy.

Defined results: null and empty texts, and texts or items with fewer words than
a shingle, match nothing; rows with equal ids count once, with the best
containment; null ids count as one id, of documents and of items; an empty table on either side gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiergraph.plans.shared import where_once, written

WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")


def _each_shingle(w: str, k: int, make) -> Column:
    """make(i) for the start of each shingle of array column ``w``."""
    some = F.transform(F.sequence(F.lit(0), F.size(w) - k), make)
    return F.when(F.size(w) >= k, some)


def shingle_hashes(w: str, k: int) -> Column:
    return _each_shingle(w, k, lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))


def shingle_strings(w: str, k: int) -> Column:
    return F.array_distinct(_each_shingle(w, k, lambda i: F.array_join(F.slice(F.col(w), i + 1, k), " ")))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    inline_sketch: int = 4000,
) -> DataFrame:
    """(id, item id, n_shared, n_item): the items of which a document holds at
    least ``threshold`` of the distinct ``shingle``-word sequences.

    ``inline_sketch``: up to so many sketch hashes are tested inside each row of
    the scan, before anything is exploded; beyond it the hashes are joined.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("_item"), words(F.col(item_text_col)).alias("_iw"))
    items = items.select("_item", shingle_strings("_iw", shingle).alias("_is"), F.array_distinct(shingle_hashes("_iw", shingle)).alias("_ih"))
    items = items.where("_is is not null")
    # The upper end of the size class bounds how many shingles may be missing.
    upper = F.pow(F.lit(2.0), F.floor(F.log2(F.size("_ih").cast("double"))) + 1) - 1
    missing = F.floor(upper * (1.0 - threshold) + 1e-9).cast("int")
    items = written(items.select("_item", "_is", F.slice(F.sort_array("_ih"), 1, missing + 1).alias("_sketch")), "items")
    sketch = items.select("_item", F.explode("_sketch").alias("_hash"))

    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null")
    d = d.select("_id", words(F.col("_t")).alias("_w"))
    d = d.select("_id", "_w", shingle_hashes("_w", shingle).alias("_h"))
    hashes = [r[0] for r in sketch.select("_hash").distinct().limit(inline_sketch + 1).collect()]
    if len(hashes) <= inline_sketch:
        array = F.array(*[F.lit(h) for h in hashes]).cast("array<bigint>")
        d = where_once(d.select("_id", "_w", F.array_intersect("_h", array).alias("_hits")), F.size("_hits") > 0)
        found = d.select("_id", "_w", F.explode("_hits").alias("_hash"))
        pairs = found.join(sketch, "_hash").select("_id", "_item", "_w").distinct()
    else:
        d = where_once(d, F.col("_h").isNotNull())
        # Ids may be null or stand for several texts: the hash of the words tells them apart.
        d = d.withColumn("_r", F.xxhash64("_w"))
        keys = d.select("_id", "_r", F.explode(F.array_distinct("_h")).alias("_hash")).join(sketch, "_hash")
        keys = keys.select(F.col("_id").alias("_pid"), F.col("_r").alias("_pr"), "_item").distinct()
        pairs = keys.join(d, (F.col("_r") == F.col("_pr")) & F.col("_id").eqNullSafe(F.col("_pid"))).select("_id", "_item", "_w")
    told = items.select(F.col("_item").alias("_pitem"), "_is")
    held = pairs.join(told, F.col("_item").eqNullSafe(F.col("_pitem"))).withColumn("_ds", shingle_strings("_w", shingle))
    n_shared, n_item = F.size(F.array_intersect("_is", "_ds")), F.size("_is")
    out = held.select("_id", "_item", n_shared.alias("n_shared"), n_item.alias("n_item"))
    out = out.where(F.col("n_shared") >= F.ceil(F.col("n_item") * threshold - 1e-9))
    best = out.groupBy("_id", "_item").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))
    return best.select(
        F.col("_id").alias(id_col),
        F.col("_item").alias(item_col),
        F.col("n_shared").cast("long").alias("n_shared"),
        F.col("n_item").cast("long").alias("n_item"),
    )


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM w WHERE len(w) >= 5
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5
), n AS (
  SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id
)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n_item)::BIGINT AS n_item
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES = {"op10_decontamination": OP10_SQL}
