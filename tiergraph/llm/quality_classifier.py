"""Quality scores from gradient-boosted histogram trees over document statistics.

The trees are trained in numpy on a bounded sample of labelled rows
(``max_train`` of them, the least by a hash of their id, so that the choice does
not depend on partitions).  They are complete trees of one depth, flattened into
arrays: a row goes down all trees at once, a level a step.  Only the text is an
input of the score.

Defined results: null texts count as empty, and empty texts get the score of
their statistics, all zero; labels that are null, and ids with null, are not
trained on; of several labels of an id the least counts; without both labels in the sample every score is the share
of label 1 (0.5 without any); rows with equal ids are scored one by one; extra columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiergraph.llm._memory import returning
from tiergraph.llm._words import Chunk, chunks

_KIND = np.zeros(256, np.uint8)
for _i, _set in enumerate((b".", b",;:", b"!?", b"#*$%&<>", b"|", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n", b"@/\\_=+~^`{}[]", b"\"'()-"), 1):
    _KIND[list(_set)] = _i
_KIND[0x80:0xC0] = 11  # continuation bytes
_KIND[0xC0:] = 12
_KINDS = 13
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&<>|!"))


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of numbers for each text."""
    n, raw = chunk.n, chunk.raw
    size = np.diff(chunk.offsets)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * _KINDS + _KIND[raw], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
    words = np.diff(chunk.at)
    of = chunk.doc_of_words()
    length = chunk.ends - chunk.starts
    h = chunk.hashes(lower=True)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((h, of))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])
    per = lambda x: np.bincount(of, x, minlength=n)
    w, b = np.maximum(words, 1), np.maximum(size, 1)
    closing = raw[chunk.ends - 1] if len(of) else raw[:0]
    out = [
        np.log1p(size),
        np.log1p(words),
        per(length) / w,
        np.bincount(of[order][fresh], minlength=n) / w,
        per(same) / w,
        per(length == 1) / w,
        per(length > 20) / w,
        per(_SYMBOL[closing]) / w,
        per(closing == ord(".")) / w,
        words / (kinds[:, 7 + 1] + 1),
    ]
    out += [kinds[:, k] / b for k in range(1, _KINDS)]
    return np.stack(out, 1)


class Trees:
    """score = 1 / (1 + exp(-(base + sum of leaves)))."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        if len(self.feature):
            depth = self.leaf.shape[1].bit_length() - 1
            rows = np.arange(len(x))[:, None]
            trees = np.arange(len(self.feature))[None]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            for _ in range(depth):
                right = x[rows, self.feature[trees, node]] > self.cut[trees, node]
                node = 2 * node + 1 + right
            total += self.leaf[trees, node - (self.leaf.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-total))


def train_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0) -> Trees:
    """Boosting of the logistic loss; splits are found in histograms of ``bins`` quantiles."""
    share = float(y.mean()) if len(y) else 0.5
    none = Trees(0.0, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    if not len(y) or share in (0.0, 1.0):
        none.base = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return none
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    base = float(np.log(share / (1 - share)))
    total, inner = np.full(len(y), base), (1 << depth) - 1
    features, limits, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, limit, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            best = np.zeros(width)
            pick = [(0, -1)] * width
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                at = (node - first) * bins + binned[:, f]
                gs = np.bincount(at, g, minlength=width * bins).reshape(width, bins).cumsum(1)
                hs = np.bincount(at, h, minlength=width * bins).reshape(width, bins).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(c)]
                k = gain.argmax(1)
                for i in np.flatnonzero(gain[np.arange(width), k] > best + 1e-9):
                    best[i], pick[i] = gain[i, k[i]], (f, k[i])
            for i, (f, k) in enumerate(pick):
                if k >= 0:
                    feature[first + i], limit[first + i] = f, cuts[f][k]
            right = x[np.arange(len(y)), feature[node]] > limit[node]
            node = 2 * node + 1 + right
        own = node - inner
        leaf = -rate * np.bincount(own, g, minlength=inner + 1) / (np.bincount(own, h, minlength=inner + 1) + ridge)
        total += leaf[own]
        features.append(feature)
        limits.append(limit)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(limits), np.array(leaves))


def fold(id_col, folds: int):
    """crc32 of the id's text modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, folds: int, held_fold: int, max_train: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _t, _y) of at most ``max_train`` labelled ids outside the held fold."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col, folds) != held_fold))
    chosen = chosen.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("_y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_train)
    # Its rows are bounded by the parameter, so that it may be broadcast.
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id")


def _measured(batches):
    for b in batches:
        for c in chunks(b.column(1)):
            rows = slice(c.first, c.first + c.n)
            yield pa.RecordBatch.from_arrays([b.column(0)[rows], pa.array(list(statistics(c)), pa.list_(pa.float64())), b.column(2)[rows]], ["_id", "_x", "_y"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, folds: int = 4, held_fold: int = 2, **columns) -> Trees:
    sample = labelled_sample(docs, labels, "quality", folds, held_fold, max_train, **columns)
    rows = sample.mapInArrow(returning(_measured), "_id long, _x array<double>, _y int").toPandas().sort_values("_id", kind="stable")
    x = np.stack(rows["_x"].to_numpy()) if len(rows) else np.zeros((0, 1))
    return train_trees(x, rows["_y"].to_numpy(float))


def scored(docs: DataFrame, model: Trees, text_col: str, score: str) -> DataFrame:
    """The rows of ``docs`` with one more column, a score of 0 to 1."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for c in chunks(b.column(at)):
                out[c.first : c.first + c.n] = held.value.score(statistics(c))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, score])

    return docs.mapInArrow(returning(run), T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())]))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows whose score reaches the threshold, all their columns."""
    name = "_score"
    while name in docs.columns:
        name += "_"
    return scored(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model, "text", "score")
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
