"""Toxicity scores from a bidirectional gated recurrent network over windows of words.

Each word enters twice: as a hashed embedding of the word (A-Z lowered, without
the punctuation around it), and as the sum of hashed embeddings of the character
sequences it begins with, so that unseen forms of a known stem count.  Two
gated recurrent layers, one for each direction, run over windows of ``WINDOW``
words that overlap by half and cover the whole text; attention pools each
window to one value.  A logistic layer turns the largest values of a document's
windows, and how many there are, into its score.

The network is trained in numpy on a bounded sample of labelled rows
(``max_train`` of each label, the least by a hash of their id).  Labels are of
documents, so of a toxic one the windows that look worst so far are trained on,
and of a clean one the worst and some others.  The first embedding dimension
begins as the log-odds of the labels.

Defined results: null texts count as empty; a text without words has score 0;
null labels and ids are not trained on; of several labels of an id the least counts;
without both labels in the sample every score is the share of label 1, or 0; rows
with equal ids are scored one by one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._words import _BYTE, _INV, _ODD, LOWER, U, Chunk, chunks, mix, powers
from tiergraph.llm.quality_classifier import fold, labelled_sample

WINDOW, STRIDE = 24, 12
HIDDEN, WORD_DIM, CHAR_DIM = 8, 6, 6
WORDS, CHARS = 1 << 15, 1 << 15
PREFIXES = (3, 4, 5, 6, 7)
_PUNCT = np.isin(np.arange(256), list(b".,;:!?#*$%&|<>\"')(-"))


def inputs(chunk: Chunk) -> np.ndarray:
    """One row for each word: its bucket, and the buckets of its beginnings."""
    starts, ends = chunk.starts.copy(), chunk.ends.copy()
    for _ in range(4 if len(ends) else 0):
        ends -= (ends - 1 > starts) & _PUNCT[chunk.raw[ends - 1]]
        starts += (ends - 1 > starts) & _PUNCT[chunk.raw[starts]]
    n = len(chunk.raw)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[LOWER][chunk.raw] * powers(_ODD, n), out=sums[1:])
    inverse = powers(_INV, n)[starts] if n else sums[:0]
    out = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = mix((sums[ends] - sums[starts]) * inverse) & U(WORDS - 1)
    for k, length in enumerate(PREFIXES, 1):
        # Bucket 0 is for words that are too short, and stays zero.
        h = mix((sums[np.minimum(starts + length, ends)] - sums[starts]) * inverse + U(length))
        out[:, k] = np.where(ends - starts >= length, (h % U(CHARS - 1)).astype(np.int64) + 1, 0)
    return out


def windows_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, length) of all windows of all texts with words."""
    words = np.diff(at)
    count = np.where(words > 0, np.maximum(-(-(words - WINDOW) // STRIDE), 0) + 1, 0)
    doc = np.repeat(np.arange(len(words)), count)
    begin = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    return doc, at[:-1][doc] + begin, np.minimum(words[doc] - begin, WINDOW)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        dim = WORD_DIM + CHAR_DIM
        n = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
        self.p = {"ew": n(WORDS, WORD_DIM) * 0.1, "ec": n(CHARS, CHAR_DIM) * 0.1, "v": n(2 * HIDDEN), "u": n(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"w{k}": n(dim, 3 * HIDDEN), f"c{k}": np.zeros(3 * HIDDEN, np.float32), f"h{k}": n(HIDDEN, 3 * HIDDEN)}
        self.p["ec"][0] = 0
        self.final = np.zeros(5)

    def _embed(self, ids):
        return np.concatenate((self.p["ew"][ids[..., 0]], self.p["ec"][ids[..., 1:]].sum(-2)), -1)

    def _layer(self, x, mask, k, keep):
        n, width, _ = x.shape
        gate = x @ self.p["w" + k] + self.p["c" + k]
        h, out, memory = np.zeros((n, HIDDEN), np.float32), np.empty((n, width, HIDDEN), np.float32), []
        for t in range(width) if k == "f" else range(width - 1, -1, -1):
            back = h @ self.p["h" + k]
            zr = _sigmoid(gate[:, t, : 2 * HIDDEN] + back[:, : 2 * HIDDEN])
            z, r, q = zr[:, :HIDDEN], zr[:, HIDDEN:], back[:, 2 * HIDDEN :]
            new = np.tanh(gate[:, t, 2 * HIDDEN :] + r * q)
            if keep:
                memory.append((t, h, z, r, q, new))
            h = np.where(mask[:, t, None], new + z * (h - new), h)
            out[:, t] = h
        return out, memory

    def _pool(self, x, mask, keep=False):
        (hf, mf), (hb, mb) = (self._layer(x, mask, k, keep) for k in "fb")
        h = np.concatenate((hf, hb), 2)
        soft = np.tanh(h)
        e = np.where(mask, soft @ self.p["v"], -1e9)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        c = (a[..., None] * h).sum(1)
        return c @ self.p["u"] + self.p["b"], (h, soft, a, c, mf, mb)

    def logits(self, ids: np.ndarray, first: np.ndarray, length: np.ndarray, step: int = 2048) -> np.ndarray:
        """Of windows of the rows of ``ids``."""
        out = np.zeros(len(first), np.float32)
        word = np.empty((len(ids), WORD_DIM + CHAR_DIM), np.float32)
        for lo in range(0, len(ids), 1 << 16):
            word[lo : lo + (1 << 16)] = self._embed(ids[lo : lo + (1 << 16)])
        for lo in range(0, len(first), step):
            f, n = first[lo : lo + step], length[lo : lo + step]
            place = np.arange(WINDOW)
            mask = place < n[:, None]
            out[lo : lo + step] = self._pool(word[np.where(mask, f[:, None] + place, f[:, None])], mask)[0]
        return out

    def gradient(self, ids, mask, y, weight):
        p, g = self.p, {}
        x = self._embed(ids)
        logit, (h, soft, a, c, *memories) = self._pool(x, mask, True)
        d = ((_sigmoid(logit) - y) * weight / len(y)).astype(np.float32)
        g["u"], g["b"] = c.T @ d, np.array([d.sum()])
        dc = d[:, None] * p["u"]
        da = (h * dc[:, None]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        g["v"] = (de[..., None] * soft).sum((0, 1))
        dh = a[..., None] * dc[:, None] + de[..., None] * p["v"] * (1 - soft * soft)
        dx = np.zeros_like(x)
        for k, memory, own in (("f", memories[0], dh[..., :HIDDEN]), ("b", memories[1], dh[..., HIDDEN:])):
            g["h" + k], dgate, dnext = np.zeros_like(p["h" + k]), np.empty((*x.shape[:2], 3 * HIDDEN), np.float32), np.zeros((len(y), HIDDEN), np.float32)
            for t, before, z, r, q, new in reversed(memory):
                m = mask[:, t, None]
                dt = own[:, t] + dnext
                dn = np.where(m, dt, 0)
                dan = dn * (1 - z) * (1 - new * new)
                dback = np.concatenate((dn * (before - new) * z * (1 - z), dan * q * r * (1 - r), dan * r), 1)
                dgate[:, t] = np.concatenate((dback[:, : 2 * HIDDEN], dan), 1)
                g["h" + k] += before.T @ dback
                dnext = dn * z + np.where(m, 0, dt) + dback @ p["h" + k].T
            flat = dgate.reshape(-1, 3 * HIDDEN)
            g["w" + k], g["c" + k] = x.reshape(-1, x.shape[2]).T @ flat, flat.sum(0)
            dx += dgate @ p["w" + k].T
        g["ew"], g["ec"] = np.zeros_like(p["ew"]), np.zeros_like(p["ec"])
        np.add.at(g["ew"], ids[..., 0], dx[..., :WORD_DIM])
        for k in range(1, ids.shape[-1]):
            np.add.at(g["ec"], ids[..., k], dx[..., WORD_DIM:])
        g["ec"][0] = 0
        return g

    def train(self, ids: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = 3, epochs: int = 2, rate: float = 0.05, seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        for table, columns in (("ew", [0]), ("ec", range(1, ids.shape[1]))):
            size = len(self.p[table])
            seen = np.zeros((2, size))
            for a, b, own in zip(at[:-1].tolist(), at[1:].tolist(), y, strict=True):
                seen[int(own), np.unique(ids[a:b, columns])] += 1
            n = np.bincount(y.astype(int), minlength=2)[:, None]
            odds = np.log((seen + 0.5) / (n + 1))
            self.p[table][:, 0] = np.where(seen.sum(0) >= 3, np.clip(odds[1] - odds[0], -4, 4), 0)
        self.p["ec"][0] = 0
        doc, first, length = windows_of(at)
        strong = np.maximum(self.p["ew"][ids[:, 0], 0], 0) + np.maximum(self.p["ec"][ids[:, 1:], 0], 0).max(1)
        look = np.array([strong[f : f + n].max() for f, n in zip(first, length, strict=True)])
        speed = {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.p.items()}
        for turn in range(rounds):
            if turn:
                look = self.logits(ids, first, length)
            order = np.lexsort((r.random(len(doc)), -look, doc))
            rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
            worst = order[rank < 2]
            # The worst window of a toxic text counts, the second only if it looks toxic too.
            keep = (y[doc[worst]] == 0) | (rank[rank < 2] == 0) | (look[worst] > np.median(look))
            other = r.choice(np.flatnonzero(y[doc] == 0), min(len(worst), int((y[doc] == 0).sum())), replace=False)
            rows = np.concatenate((worst[keep], other))
            weight = np.where(y[doc[rows]] == 1, max(1.0, (y[doc[rows]] == 0).sum() / max(1, (y[doc[rows]] == 1).sum())), 1.0)
            for _ in range(epochs):
                for part in np.array_split(r.permutation(len(rows)), max(1, len(rows) // 128)):
                    f, n = first[rows[part]], length[rows[part]]
                    mask = np.arange(WINDOW) < n[:, None]
                    g = self.gradient(ids[np.where(mask, f[:, None] + np.arange(WINDOW), f[:, None])], mask, y[doc[rows[part]]], weight[part])
                    for k, x in g.items():
                        speed[k] += x * x
                        self.p[k] -= (rate * x / np.sqrt(speed[k])).astype(np.float32)
        self._finish(summary(self.logits(ids, first, length), doc, len(y)), y, at)
        return self

    def _finish(self, x, y, at):
        x, y = x[np.diff(at) > 0], y[np.diff(at) > 0]
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        z = np.concatenate(((x - self.mean) / self.spread, np.ones((len(x), 1))), 1)
        w = np.zeros(z.shape[1])
        for _ in range(30):  # Newton steps of the logistic loss
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w))
            w -= np.linalg.solve(hess, z.T @ (p - y) + 0.5 * w)
        self.final = w

    def documents(self, chunk: Chunk) -> np.ndarray:
        ids = inputs(chunk)
        doc, first, length = windows_of(chunk.at)
        x = summary(self.logits(ids, first, length), doc, chunk.n)
        z = (x - self.mean) / self.spread @ self.final[:-1] + self.final[-1]
        return np.where(np.diff(chunk.at) > 0, 1 / (1 + np.exp(-np.clip(z, -50, 50))), 0.0)


def summary(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each text: its largest and third largest window, the expected number of
    toxic windows, their share, and the number of windows."""
    out = np.full((n, 5), -8.0)
    order = np.lexsort((-logit, doc))
    rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order]) if len(doc) else order
    for k, place in ((0, 0), (1, 2)):
        rows = order[rank == place]
        out[doc[rows], k] = np.clip(logit[rows], -8, 8)
    sure = np.bincount(doc, _sigmoid(logit), minlength=n)
    count = np.bincount(doc, minlength=n)
    out[:, 2], out[:, 3], out[:, 4] = np.log1p(sure), sure / np.maximum(count, 1), np.log1p(count)
    return out


class Constant:
    def __init__(self, share: float):
        self.share = share

    def documents(self, chunk: Chunk) -> np.ndarray:
        return np.where(np.diff(chunk.at) > 0, self.share, 0.0)


def _read(batches):
    for b in batches:
        rows = []
        for c in chunks(b.column(1)):
            x = inputs(c)
            rows += [x[s:e].tobytes() for s, e in zip(c.at[:-1].tolist(), c.at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, max_train: int = 2000, folds: int = 5, held_fold: int = 0):
    found = []
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    for y in (0, 1):
        sample = labelled_sample(docs, labels.where(F.col("toxic") == y), "toxic", folds, held_fold, max_train)
        found += sample.mapInArrow(_read, "_id long, x binary, y int").collect()
    found = sorted((r for r in found if r.x), key=lambda r: (r["_id"], r.y))
    y = np.array([r.y for r in found], float)
    if len(set(y.tolist())) < 2:
        return Constant(float(y.mean()) if len(y) else 0.0)
    at = np.concatenate(([0], np.cumsum([len(r.x) for r in found]))) // (4 * (1 + len(PREFIXES)))
    ids = np.frombuffer(b"".join(r.x for r in found), np.int32).reshape(-1, 1 + len(PREFIXES))
    del found
    return Network().train(ids, at, y)


def toxicity(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows)
            for c in chunks(b.column(1), 1 << 20):
                out[c.first : c.first + c.n] = held.value.documents(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["_id", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    return d.mapInArrow(run, "_id long, score double").withColumnRenamed("_id", id_col)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
