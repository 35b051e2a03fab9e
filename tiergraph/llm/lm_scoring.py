"""Log-probabilities of texts under a log-bilinear model and a counted baseline.

Tokens are the words of the text with A-Z lowered, then one end.  Everything is
learnt from the documents outside the held fold, and from all of them:

1. Every block of texts sends its distinct words and their counts to shards by
   word hash; a shard adds the counts up and answers each block with those of its
   words.  No table of all words exists in one place.
2. The vocabulary is the most frequent words, as many as the square root of the
   training tokens, ``words`` at most.  The other words fall into 64 classes by their
   shape: how they begin and end.
3. The log-bilinear model (the vectors of the two classes before, through a
   matrix for each place, predict the vector of the next) is trained in numpy with
   noise-contrastive estimation on all training tokens: tasks train on their own
   texts, an eighth first and then the rest from what that gave, and
   their parameters are averaged, those of a word by how often each task met it.
4. Classes lie in clusters of the square root of their number, by frequency.
   Batched matrix products give the normalisers over the clusters, and over the
   classes of each token's own cluster, so that probabilities sum to one.  A rare word has the probability of its class times its smoothed share of the
   class, whose last share is for words never seen.

Words are told apart by a 64-bit hash.

Defined results: a null text is empty and has one token, its end; null ids are
never held out; rows with equal ids are documents of their own; without training
documents counts are zero, the base score is that of one unseen type and the
model is as it starts; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._blocks import DEALT, TEXTS, frozen, rows, shard_of, thawed
from tiergraph.llm._pack import BLOBS, batch, pack, unpack
from tiergraph.llm._words import U, Chunk, chunks
from tiergraph.llm.quality_classifier import fold
from tiergraph.plans.shared import dropped, release, written

SHAPES = 64
END, RARE, FIRST = 0, 1, 1 + SHAPES  # classes: rare words from RARE, others from FIRST on; as a context only, the start after them
NOISE, DIM, STEP = 32, 32, 4096
BLOCK = 1 << 20
LEVELS = 64 * 16
FEWEST, START = -2, -3  # shards of what the driver reads: frequent words, and how many there are of each level


_ENDING = np.full(256, 31, np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    _ENDING[_c] = _ENDING[_c - 32] = _i
for _i, _set in enumerate((b".", b",;:", b"0123456789", bytes(range(0x80, 0x100)), b"#*$%&<>|!?"), 26):
    _ENDING[list(_set)] = _i


def _shapes(chunk: Chunk) -> np.ndarray:
    """0 to 63: the kind of a word's last byte, and whether it begins with a letter of A to Z."""
    first, last = chunk.raw[chunk.starts], chunk.raw[chunk.ends - 1]
    return _ENDING[last] + np.where((_ENDING[first] < 26), 32, 0).astype(np.uint8)


def _level(count: np.ndarray) -> np.ndarray:
    return (16 * np.log2(np.maximum(count, 1))).astype(np.int64)


def _dealt(shards: int):
    """For each block a row with its texts, and a row for each shard with its words and their training counts."""

    def run(batches):
        base, held, texts, size, number = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def flush():
            h, train, shape = (np.concatenate(x) for x in zip(*held, strict=True))
            word, place, back = np.unique(h, return_index=True, return_inverse=True)
            count = np.bincount(back, train, len(word)).astype(np.uint32)
            cut = np.searchsorted(shard_of(word, shards), np.arange(shards + 1).astype(U))
            key, data = [TEXTS], [frozen(texts)]
            for s in np.flatnonzero(np.diff(cut)).tolist():
                key.append(s)
                own = slice(cut[s], cut[s + 1])
                data.append(pack(word[own], count[own], shape[place[own]]))
            return rows(key, [base + number] * len(key), data)

        for b in batches:
            ids, column, out = b.column(0).cast(pa.int64()), b.column(1), b.column(2)
            train = ~out.to_numpy(zero_copy_only=False).astype(bool)
            for chunk in chunks(column):
                part = slice(chunk.first, chunk.first + chunk.n)
                held.append((chunk.hashes(lower=True), train[part][chunk.doc_of_words()], _shapes(chunk)))
                texts.append(pa.RecordBatch.from_arrays([x.slice(chunk.first, chunk.n) for x in (ids, column, out)], ["id", "text", "held"]))
                size += len(chunk.starts) + chunk.n
                if size >= BLOCK:
                    yield flush()
                    held, texts, size, number = [], [], 0, number + 1
        if size:
            yield flush()

    return run


def _answers(most: int):
    """For each block the counts of its words, in their order; the shard's ``most`` frequent
    words; and the tokens and words of each level of counts and shape."""

    def run(table: pa.Table) -> pa.Table:
        shard, blocks, parts = table.column("shard")[0].as_py(), table.column("block").to_pylist(), [unpack(x.as_py()) for x in table.column("data")]
        word, place, back = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
        shape = np.concatenate([p[2] for p in parts])[place].astype(np.int64)
        total = np.bincount(back, np.concatenate([p[1] for p in parts]), len(word)).astype(np.int64)
        edge = np.cumsum([0, *(len(p[0]) for p in parts)])
        data = [pack(total[back[x:y]]) for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        known = total > 0
        level = _level(total[known]) * SHAPES + shape[known]
        sums = [np.bincount(level, w, LEVELS * SHAPES).astype(np.int64) for w in (total[known], None)]
        top = np.lexsort((word, -total))[:most]
        top = top[total[top] > 0]
        return pa.Table.from_batches([rows([shard] * len(data) + [FEWEST, START], [*blocks, shard, shard], [*data, pack(word[top], total[top]), pack(*sums)])])

    return run


def _above(least: int):
    """The words of a level of ``least`` or more."""

    def run(batches):
        for b in batches:
            for blob in b.column(0):
                word, count = unpack(blob.as_py())
                keep = _level(count) >= least
                yield batch([(0, pack(word[keep], count[keep]))])

    return run


class Vocabulary:
    """The frequent words, with the totals over all words."""

    def __init__(self, answers: DataFrame, documents: int, words: int):
        tokens, types = np.zeros((2, LEVELS * SHAPES), np.int64)
        for row in answers.where(F.col("shard") == START).select("data").toLocalIterator():
            more = unpack(bytes(row.data))
            tokens, types = tokens + more[0], types + more[1]
        tokens, types = tokens.reshape(LEVELS, SHAPES), types.reshape(LEVELS, SHAPES)
        self.documents, self.total, self.distinct = documents, int(tokens.sum()) + documents, int(types.sum()) + bool(documents)
        size = min(words, max(64, math.isqrt(self.total)))
        above = np.cumsum(types.sum(1)[::-1])[::-1]  # words of each level or more
        least = int(np.argmax(above <= size)) if (above <= size).any() else LEVELS
        found = [unpack(bytes(r.blob)) for r in answers.where(F.col("shard") == FEWEST).select("data").mapInArrow(_above(least), BLOBS).collect()]
        word, count = (np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in ((0, U), (1, np.int64)))
        order = np.lexsort((word, -count))
        self.rare_types = types[:least].sum(0)
        self.counts = np.concatenate(([documents], tokens[:least].sum(0), count[order])).astype(np.int64)
        self.words, self.number = np.sort(word), np.empty(len(word), np.int32)
        self.number[np.argsort(np.argsort(word))[order]] = np.arange(len(word)) + FIRST

    @property
    def start(self) -> int:
        return len(self.counts)

    def classes(self, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        out = shape.astype(np.int32) + RARE
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out[hit] = self.number[at[hit]]
        return out

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def within(self, cls: np.ndarray, count: np.ndarray) -> np.ndarray:
        """log10 of a rare word's share of its class; 0 for others."""
        rare = (cls >= RARE) & (cls < FIRST)
        shape = np.where(rare, cls - RARE, 0)
        return np.where(rare, np.log10((count + 0.5) / (self.counts[RARE + shape] + 0.5 * (self.rare_types[shape] + 1))), 0.0)


def _tokens(chunk: Chunk, cls: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The class of each token of each text, its end too, the two classes before it, and where texts begin."""
    at = chunk.at + np.arange(chunk.n + 1)
    out = np.full(at[-1], END, np.int32)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    out[inside] = cls
    one, two = np.empty_like(out), np.empty_like(out)
    one[1:], two[2:] = out[:-1], out[:-2]
    one[at[:-1]] = two[at[:-1]] = start
    second = at[:-1] + 1
    two[second[second < at[1:]]] = start
    return out, one, two, at


def _summed(rows_: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the gradients of each row that has some."""
    low = rows_.astype(np.uint16) if rows_.max() < 1 << 16 else rows_  # 16 bits are sorted by counting
    order = np.argsort(low, kind="stable")
    own = rows_[order]
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return own[at], np.add.reduceat(grads.take(order, axis=0), at, axis=0)


class Model:
    """log P(c | one, two) = log P(cluster of c) + log P(c in its cluster), each a softmax of
    products with q = context[one] @ place[0] + context[two] @ place[1]."""

    TABLES = ("context", "target", "bias")  # a row for each class
    WHOLE = ("near", "far", "cluster", "offset")

    def __init__(self, counts: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        self.n, self.width = len(counts), math.isqrt(len(counts) - 1) + 1
        self.clusters = -(-self.n // self.width)
        noise = (counts + 1.0) / (counts + 1.0).sum()
        self.noise, self.log_noise, self.cumulative = noise, np.log(noise).astype(np.float32), noise.cumsum()
        of = np.bincount(np.arange(self.n) // self.width, noise)
        self.log_cluster = np.log(of).astype(np.float32)
        draw = lambda *shape: r.normal(0, 0.1, shape).astype(np.float32)
        self.p = {"context": draw(self.n + 1, DIM), "target": draw(self.n, DIM), "bias": self.log_noise[:, None].copy()}
        self.p |= {"near": np.eye(DIM, dtype=np.float32), "far": np.eye(DIM, dtype=np.float32) / 2, "cluster": draw(self.clusters, DIM), "offset": self.log_cluster[:, None].copy()}
        self.old = {k: np.full((len(v), 1), 1e-6, np.float32) for k, v in self.p.items()}  # of each row

    def _step(self, name: str, rows_, grad, rate: float) -> None:
        x, v = self.p[name], self.old[name]
        v[rows_] += np.einsum("ij,ij->i", grad, grad)[:, None] / grad.shape[1]
        x[rows_] -= rate * grad / np.sqrt(v[rows_])

    def _contrast(self, q, hit, noise, vectors: str, bias: str, log_noise, rate: float):
        """One step of noise-contrastive estimation: tells each row's ``hit`` from ``noise``, which all rows share."""
        b, to, from_ = self.p[bias][:, 0], self.p[vectors].take(hit, axis=0), self.p[vectors].take(noise, axis=0)
        known, scale = math.log(len(noise)), np.float32(1 / len(q))
        d_hit = np.einsum("ij,ij->i", q, to) + (b[hit] - log_noise[hit] - known)
        d_hit = -scale / (1 + np.exp(np.clip(d_hit, -30, 30)))
        d_noise = (b[noise] - log_noise[noise] - known)[:, None] + from_ @ q.T
        np.clip(np.negative(d_noise, out=d_noise), -30, 30, out=d_noise)
        np.exp(d_noise, out=d_noise)
        d_noise += 1
        np.divide(scale, d_noise, out=d_noise)
        to *= d_hit[:, None]
        to += d_noise.T @ from_
        own, grad = _summed(np.concatenate((hit, noise)), np.concatenate((d_hit[:, None] * q, d_noise @ q)))
        slope = np.bincount(np.concatenate((hit, noise)), np.concatenate((d_hit, d_noise.sum(1))))[own]
        self._step(vectors, own, grad, rate)
        self._step(bias, own, slope[:, None].astype(np.float32), rate)
        return to

    def train(self, cls, one, two, r, rate: float = 0.05) -> None:
        for lo in range(0, len(cls), STEP):
            w, a, b = (x[lo : lo + STEP].astype(np.int64) for x in (cls, one, two))
            k = np.minimum(np.searchsorted(self.cumulative, r.random(NOISE)), self.n - 1)
            ca, cb = (self.p["context"].take(x, axis=0) for x in (a, b))
            q = ca @ self.p["near"] + cb @ self.p["far"]
            back = self._contrast(q, w, k, "target", "bias", self.log_noise, rate)
            back += self._contrast(q, w // self.width, k // self.width, "cluster", "offset", self.log_cluster, rate)
            own, grad = _summed(np.concatenate((a, b)), np.concatenate((back @ self.p["near"].T, back @ self.p["far"].T)))
            near, far = ca.T @ back, cb.T @ back
            self._step("context", own, grad, rate)
            self._step("near", slice(None), near, rate)
            self._step("far", slice(None), far, rate)

    def ready(self) -> Model:
        """Products of the contexts, with a one for the bias; clusters, and targets by cluster, as columns with their biases below."""
        context, lone = self.p["context"], np.ones((self.n + 1, 1), np.float32)
        self.one, self.two = np.hstack((context @ self.p["near"], lone)), np.hstack((context @ self.p["far"], 0 * lone))
        targets = np.zeros((self.clusters * self.width, DIM + 1), np.float32)
        targets[:, DIM] = -1e4
        targets[: self.n] = np.hstack((self.p["target"], self.p["bias"]))
        self.rows, self.row_heads = targets, np.hstack((self.p["cluster"], self.p["offset"]))
        self.targets = np.ascontiguousarray(targets.reshape(self.clusters, self.width, DIM + 1).transpose(0, 2, 1))
        self.heads = np.ascontiguousarray(self.row_heads.T)
        self.old = None
        return self

    def log10(self, cls, one, two) -> np.ndarray:
        return np.concatenate([np.zeros(0), *(self._log10(cls[lo : lo + MANY], one[lo : lo + MANY], two[lo : lo + MANY]) for lo in range(0, len(cls), MANY))])

    def _log10(self, cls, one, two) -> np.ndarray:
        """Tokens after the same two classes share one normaliser over the clusters, and one over each cluster."""
        pair, to_pair = np.unique(one.astype(np.int64) * (self.n + 1) + two, return_inverse=True)
        cluster = cls // self.width
        kind, to_kind = np.unique(cluster.astype(np.int64) * len(pair) + to_pair, return_inverse=True)
        q = self.one.take(pair // (self.n + 1), axis=0) + self.two.take(pair % (self.n + 1), axis=0)
        head, inside, own = np.empty(len(pair)), np.empty(len(kind)), kind % len(pair)
        for x in range(0, len(pair), NEAR):
            head[x : x + NEAR] = _log_sums(q[x : x + NEAR] @ self.heads)
        edge = np.searchsorted(kind, np.arange(self.clusters + 1) * len(pair))
        for c in np.flatnonzero(np.diff(edge)).tolist():
            for x in range(edge[c], edge[c + 1], NEAR):
                part = slice(x, min(x + NEAR, edge[c + 1]))
                inside[part] = _log_sums(q.take(own[part], axis=0) @ self.targets[c])
        inside += head[own]
        out = np.empty(len(cls))
        for lo in range(0, len(cls), 1 << 14):
            part = slice(lo, lo + (1 << 14))
            x, t = q.take(to_pair[part], axis=0), self.rows.take(cls[part], axis=0)
            t += self.row_heads.take(cluster[part], axis=0)
            out[part] = np.einsum("ij,ij->i", x, t)
        return (out - inside[to_kind]) * math.log10(math.e)


MANY = 1 << 18  # tokens that are scored at once
NEAR = 1 << 11  # rows of products that stay in the cache


def _log_sums(z: np.ndarray) -> np.ndarray:
    """Log of the sum of the exponentials of each row."""
    with np.errstate(over="ignore"):
        total = np.exp(z) @ np.ones(z.shape[1], z.dtype)
    if total.min() > 1e-20 and total.max() < 1e30:
        return np.log(total, dtype=np.float64)
    top = z.max(1)
    return top + np.log(np.exp(z - top[:, None]).sum(1, dtype=np.float64))


ROWS = 1 << 12  # classes of a part of the tables


def _trained(shared, first: bool):
    """Of a task: its parameters times how much each was trained, in parts, with these weights."""

    def run(batches):
        vocabulary, model = shared.value
        weight = {"context": np.zeros(model.n + 1), "target": np.zeros(model.n)}
        r, before = np.random.default_rng([7, TaskContext.get().partitionId(), first]), {k: (v.copy(), model.old[k].copy()) for k, v in model.p.items()}
        seen = 0
        for b in batches:
            for blob in b.column(0):
                block = thawed(blob.as_py())
                texts = block.filter(pa.array(~block.column("held").to_numpy(zero_copy_only=False).astype(bool)))
                for chunk in chunks(texts.column("text")):
                    h = chunk.hashes(lower=True)
                    cls, one, two, at = _tokens(chunk, vocabulary.classes(h, _shapes(chunk)), vocabulary.start)
                    # A text's length and first words say which round it is in: each is in one of them.
                    sums = np.concatenate((np.zeros(1, U), np.cumsum(h, dtype=U)))
                    early = ((sums[chunk.at[1:]] - sums[chunk.at[:-1]]) >> U(40)) % U(8) == 0
                    use = np.flatnonzero(np.repeat(early == first, np.diff(at)))
                    use = r.permutation(use)
                    model.train(cls[use], one[use], two[use], r)
                    weight["target"] += np.bincount(cls[use], minlength=model.n)
                    weight["context"] += np.bincount(one[use], minlength=model.n + 1) + np.bincount(two[use], minlength=model.n + 1)
                    seen += len(use)
        out = []
        if seen:
            weight["bias"] = weight["target"]
            weight |= {name: np.full(len(model.p[name]), float(seen)) for name in Model.WHOLE}
            for t, name in enumerate((*Model.TABLES, *Model.WHOLE)):
                w = weight[name] + 1e-3 * seen / model.n
                both = (np.concatenate((model.p[name], model.old[name]), 1) * w[:, None]).astype(np.float32)
                for at in range(0, len(w), ROWS):
                    own = slice(at, at + ROWS)
                    out.append((t << 24 | at // ROWS, pack(w[own], *both[own].T)))
        model.p, model.old = ({k: v[i] for k, v in before.items()} for i in range(2))  # the worker may be used again
        if out:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([task] * len(out), pa.int32()), pa.array([x for _, x in out], pa.binary())], ["key", "task", "blob"])

    return run


SUMS = "key int, task int, blob binary"
FAN = 32


def _added(table: pa.Table) -> pa.Table:
    total = None
    for blob in table.column("blob"):
        part = [x.astype(np.float64) for x in unpack(blob.as_py())]
        total = part if total is None else [x + y for x, y in zip(total, part, strict=True)]
    return pa.table({"key": table.column("key")[:1], "task": table.column("task")[:1], "blob": pa.array([pack(total[0], *(x.astype(np.float32) for x in total[1:]))], pa.binary())})


def _round(model: Model, vocabulary: Vocabulary, texts: DataFrame, tasks: int, first: bool) -> None:
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, model))
    sums = texts.coalesce(tasks).mapInArrow(_trained(shared, first), SUMS)
    while tasks > 1:  # no step adds up more than FAN
        sums, tasks = sums.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("key", "task").applyInArrow(_added, SUMS), -(-tasks // FAN)
    for key, _, blob in sums.collect():
        name = (*Model.TABLES, *Model.WHOLE)[key >> 24]
        weight, *columns = unpack(bytes(blob))
        value = np.stack(columns, 1) / weight[:, None]
        own = slice((key & 0xFFFFFF) * ROWS, (key & 0xFFFFFF) * ROWS + len(weight))
        model.p[name][own], model.old[name][own] = value[:, :-1], value[:, -1:]


def _score(shared):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary, model = shared.value
        parts = sorted(zip(answers.column("shard").to_pylist(), answers.column("data").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack(x)[0] for _, x in parts)])
        done = []
        for data in texts.column("data").to_pylist():
            block = thawed(data)
            own = list(chunks(block.column("text")))
            hashes = [c.hashes(lower=True) for c in own]
            word = np.unique(np.concatenate(hashes))
            for chunk, h in zip(own, hashes, strict=True):
                count = counts[np.searchsorted(word, h)] if len(h) else np.zeros(0, np.int64)
                cls, one, two, at = _tokens(chunk, vocabulary.classes(h, _shapes(chunk)), vocabulary.start)
                token = np.full(at[-1], vocabulary.documents, np.int64)
                inside = np.ones(at[-1], bool)
                inside[at[1:] - 1] = False
                token[inside] = count
                sums = lambda x, at=at: np.add.reduceat(x, at[:-1])
                done.append((np.diff(at), sums((token > 0).astype(np.int64)), sums(vocabulary.base(token)), sums(model.log10(cls, one, two) + vocabulary.within(cls, token))))
            n_tokens, n_known, base, score = (np.concatenate(x) for x in zip(*done, strict=True))
            return pa.table({"_id": block.column("id"), "held_out": block.column("held"), "n_tokens": n_tokens, "n_known": n_known, "base_score": base, "score": score})

    return run


def fitted(texts: DataFrame, vocabulary: Vocabulary) -> Model:
    """The model after all training tokens of the blocks of texts.

    A task has 256 tokens or more for each word, so that what all tasks send of their
    models is in proportion to the corpus."""
    model = Model(vocabulary.counts)
    tasks = max(1, vocabulary.total // (256 * model.n))
    for first in (True, False):
        _round(model, vocabulary, texts, tasks, first)
    return model.ready()


def lm_scoring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1, words: int = 1 << 16) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    ``words``: the size of the vocabulary at most, which bounds the model's memory: it has
    65 numbers for each word.  Below it the vocabulary grows with the corpus."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.coalesce(fold(id_col, folds) == held_fold, F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"), held.alias("_held"))
    dealt = written(d.mapInArrow(_dealt(shards), DEALT).withColumn("own", F.col("shard") == TEXTS), "dealt", by="own")
    texts, asked = dealt.where("own"), dealt.where("not own")
    answers = written(asked.drop("own").groupBy("shard").applyInArrow(_answers(words), DEALT), "answers")
    dropped(dealt, "own=false")
    release(spark)
    vocabulary = Vocabulary(answers, d.where("not _held").count(), words)
    both = spark.sparkContext.broadcast((vocabulary, fitted(texts.select("data"), vocabulary)))
    release(spark)
    texts = texts.select("block", "data").groupBy("block")
    told = answers.where("shard >= 0").groupBy("block")
    schema = "_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = texts.cogroup(told).applyInArrow(_score(both), schema)
    return out.select(F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(vocabulary.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scoring(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLES: dict[str, str] = {}
