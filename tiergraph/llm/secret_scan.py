"""Secrets by rules, and by a character network over every further candidate.

Rules: assignments to a name such as ``token``, cloud access keys, and long
hexadecimal runs.  Candidates: runs of ``[A-Za-z0-9+/_=-]`` of 16 characters or more, of
8 or more with a letter and a digit, and of 8 or more close behind a credential word;
those that overlap a span of a rule are not judged again.

A convolutional network in numpy reads each candidate with the 24 bytes before and the 16
bytes after it; a long candidate is read in overlapping windows over all its length, and
the surest one counts.  It is trained on labelled findings.  Secrets: the spans of the rules in
the texts (half of them without what stands around them, so that the name alone does not
decide), and drawn ones.  Others: candidates in the texts that are made of words and small numbers,
and drawn ones.  What neither a rule nor that evidence speaks about is not used.  The output is
calibrated on a fifth of them held back, and the threshold is the largest that keeps the wanted
recall there.

Defined results: null texts count as empty; spans are in code points, end
exclusive; empty texts have none; rows with equal ids get a row each; an empty
table gives an empty result; other columns are not read.  Work and memory are in
proportion to the text, however long it is.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._words import LOWER, Chunk, chunks

# The patterns of the rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "model")
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")

_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_IS_KEY = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_IS_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_IS_UPPER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_IS_LETTER = np.isin(LOWER, list(b"abcdefghijklmnopqrstuvwxyz"))
_CREDENTIAL = (b"passw", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"credential", b"login")
BEFORE, BODY, AFTER, STRIDE, CLASSES = 24, 56, 16, 40, 48
WIDE, LONG, SHORT = BEFORE + BODY + AFTER, 16, 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rules' spans."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def _runs(chunk: Chunk, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of member bytes inside one text, ``least`` or more long."""
    inside = member[chunk.raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    full = chunk.offsets[:-1] < chunk.offsets[1:]
    edge, last = chunk.offsets[:-1][full], chunk.offsets[1:][full] - 1
    begins[edge], stops[last] = inside[edge], inside[last]
    a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    long = b - a >= least
    return a[long], b[long]


def _found(chunk: Chunk, name: bytes) -> np.ndarray:
    """Where a name in lower case occurs, in either case."""
    if not hasattr(chunk, "lowered"):
        chunk.lowered = LOWER[chunk.raw].tobytes()
    out, at = [], chunk.lowered.find(name)
    while at >= 0:
        out.append(at)
        at = chunk.lowered.find(name, at + 1)
    return np.array(out, np.int64)


def _candidates(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Bytes where candidates begin and end."""
    a, b = _runs(chunk, _IS_KEY, SHORT)
    count = lambda member: (lambda c: c[b] - c[a])(np.concatenate(([0], np.cumsum(member[chunk.raw], dtype=np.int32))))
    keep = (b - a >= LONG) | ((count(_IS_DIGIT) > 0) & (count(_IS_LETTER) > 0))
    if not keep.all():
        # Close behind a credential word: only separators and one more word may stand between.
        ends = np.sort(np.concatenate([_found(chunk, name) + len(name) for name in _CREDENTIAL]))
        if len(ends):
            last = np.searchsorted(ends, a, "right") - 1
            keep |= (last >= 0) & (a - ends[np.maximum(last, 0)] <= 12)
    return a[keep], b[keep]


_WORD = re.compile(rb"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_HARSH = re.compile(rb"[b-df-hj-np-tv-xz]{5}|[aeiou]{4}", re.IGNORECASE)


def _made_of_words(run: bytes) -> bool:
    """Words in one case or with a capital first, and numbers of four digits at most, between marks."""
    for piece in re.split(rb"[^A-Za-z0-9]+", run):
        if piece.isdigit():
            if len(piece) > 4:
                return False
        elif piece:
            vowels = len(re.findall(rb"[aeiouy]", piece, re.IGNORECASE))
            if not _WORD.fullmatch(piece) or _HARSH.search(piece) or not 0.2 <= vowels / len(piece) <= 0.7:
                return False
    return True


def _named(chunk: Chunk) -> np.ndarray:
    """Texts that hold a name of an assignment, or the start of an access key."""
    out = np.concatenate([_found(chunk, name) for name in (*_NAMES, b"akia")])
    return np.unique(np.searchsorted(chunk.offsets, out, "right") - 1)


_CLASS = np.full(256, 47, np.uint8)
for _i, _c in enumerate(b"abcdefghijklmnopqrstuvwxyz"):
    _CLASS[_c] = _i + 1
for _i, _set in enumerate((b"0123456789", b"+/", b"_-", b"=", b":", b"\"'", b" ", b"\n\r\t", b".,", b"#*$%&|<>!?", b"()[]{}", b"@\\"), 27):
    _CLASS[list(_set)] = _i
_CLASS[_IS_UPPER] = np.arange(26, dtype=np.uint8) % 8 + 39


def windows(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of character classes, and the candidate of each: what stands before it, a window
    of it, what stands after it.  Candidate i is raw[begin[i]:end[i]] in a text raw[low[i]:high[i]]."""
    times = 1 + np.maximum(-(-(end - begin - BODY) // STRIDE), 0)
    owner = np.repeat(np.arange(len(begin)), times)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    out = np.zeros((len(owner), WIDE), np.uint8)

    def put(column, first, size, least, most):
        at = first[:, None] + np.arange(size)
        inside = (at >= least[:, None]) & (at < most[:, None])
        out[:, column : column + size] = np.where(inside, _CLASS[raw[np.clip(at, 0, max(len(raw) - 1, 0))]], 0)

    if len(owner):
        b, e = begin[owner], end[owner]
        put(0, b - BEFORE, BEFORE, low[owner], b)
        put(BEFORE, b + STRIDE * nth, BODY, b, e)
        put(BEFORE + BODY, e, AFTER, e, high[owner])
    return out, owner


def encode(texts: list[tuple[bytes, int, int]]) -> np.ndarray:
    """The first window of each candidate text[begin:end]."""
    size = np.array([len(t) for t, _, _ in texts])
    at = np.cumsum(size) - size
    begin, end = (np.array([x[i] for x in texts]) for i in (1, 2))
    x, owner = windows(np.frombuffer(b"".join(t for t, _, _ in texts), np.uint8), at + begin, at + end, at, at + size)
    return x[np.unique(owner, return_index=True)[1]]


class Network:
    """Embedding of character classes, one convolution, maximum over the places before,
    of and after the candidate, one linear layer."""

    #: Where the places of the convolution's output begin: before, of, after the candidate.
    PARTS = (0, BEFORE - 2, BEFORE + BODY - 2)

    def __init__(self, seed: int = 7, dim: int = 8, filters: int = 16, width: int = 5):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "e": r.normal(0, 0.3, (CLASSES + 1, dim)),
            "w": r.normal(0, 0.3, (width * dim, filters)),
            "b": np.zeros(filters),
            "v": r.normal(0, 0.3, 3 * filters),
            "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x):
        e = self.p["e"][x]
        view = np.lib.stride_tricks.sliding_window_view(e, self.width, 1)  # rows, places, dim, width
        view = view.transpose(0, 1, 3, 2).reshape(len(x), -1, self.p["w"].shape[0])
        z = view @ self.p["w"] + self.p["b"]
        parts = [z[:, x:y] for x, y in zip(self.PARTS, (*self.PARTS[1:], z.shape[1]), strict=True)]
        best = [h.argmax(1) for h in parts]
        top = np.concatenate([np.take_along_axis(h, k[:, None], 1)[:, 0] for h, k in zip(parts, best, strict=True)], 1)
        return view, best, np.maximum(top, 0), top

    def logit(self, x: np.ndarray) -> np.ndarray:
        """The same in one precision less: each byte class gives each place of the convolution a fixed part."""
        out = np.zeros(len(x))
        dim, filters = self.p["e"].shape[1], self.p["w"].shape[1]
        table = (self.p["e"] @ self.p["w"].reshape(self.width, dim, filters)).astype(np.float32)
        for lo in range(0, len(x), 1024):
            rows = x[lo : lo + 1024]
            places = rows.shape[1] - self.width + 1
            z = table[0][rows[:, :places]]
            for t in range(1, self.width):
                z += table[t][rows[:, t : t + places]]
            top = np.maximum.reduceat(z, self.PARTS, axis=1) + self.p["b"]
            out[lo : lo + 1024] = np.maximum(top.reshape(len(rows), -1), 0) @ self.p["v"] + self.p["c"]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.logit(x) + self.shift)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.02, recall: float = 0.98, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        held = np.arange(len(y)) % 5 == 4
        own = np.flatnonzero(~held)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, filters = 0, self.p["w"].shape[1]
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(own), max(1, len(own) // 64)):
                view, best, act, top = self._forward(x[rows])
                d = (1 / (1 + np.exp(-(act @ self.p["v"] + self.p["c"]))) - y[rows]) / len(rows)
                g = {"v": act.T @ d, "c": np.array([d.sum()]), "w": np.zeros_like(self.p["w"]), "e": np.zeros_like(self.p["e"])}
                back = d[:, None] * self.p["v"] * (top > 0)
                g["b"] = back.reshape(len(rows), 3, filters).sum((0, 1))
                for part, k in enumerate(best):
                    place = k + self.PARTS[part]
                    own_back = back[:, part * filters : (part + 1) * filters]
                    for f in range(filters):
                        seen = view[np.arange(len(rows)), place[:, f]]
                        g["w"][:, f] += seen.T @ own_back[:, f]
                        into = (own_back[:, f, None] * self.p["w"][:, f]).reshape(len(rows), self.width, -1)
                        np.add.at(g["e"], x[rows][np.arange(len(rows))[:, None], place[:, f, None] + np.arange(self.width)], into)
                step += 1
                for k, (m, v) in moment.items():
                    m += 0.1 * (g[k] - m)
                    v += 0.01 * (g[k] ** 2 - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        z, t = self.logit(x[held]), y[held]
        for _ in range(200):  # Platt scaling
            p = 1 / (1 + np.exp(-(self.scale * z + self.shift)))
            self.scale -= 0.05 * float(((p - t) * z).mean() if len(z) else 0)
            self.shift -= 0.05 * float((p - t).mean() if len(z) else 0)
        found = self.probability(x[held])[t == 1]
        self.threshold = min(0.9, float(np.quantile(found, 1 - recall))) if len(found) else 0.5
        return self


def drawn(n: int, seed: int = 11) -> tuple[list[tuple[bytes, int, int]], list[int]]:
    """Made-up findings of both kinds, as text and the place of the candidate in it."""
    r = np.random.default_rng(seed)
    pick = lambda chars, k: bytes(r.choice(np.frombuffer(chars, np.uint8), k))
    low, texts, labels = b"abcdefghijklmnopqrstuvwxyz", [], []
    word = lambda: b"".join(pick(b"bcdfghklmnprstvw", 1) + pick(b"aeiou", 1) + pick(b"lmnrst ", 1).strip() for _ in range(int(r.integers(1, 4))))
    kinds = (
        lambda: pick(b"0123456789", int(r.integers(8, 20))),
        lambda: b"-".join((word(), word(), pick(b"0123456789", 2))),
        lambda: b"_".join((word(), word(), word())),
        lambda: b"/".join(word() for _ in range(4)) + b"/" + pick(b"0123456789", 1),
        lambda: b"20" + pick(b"0123456789", 2) + b"-0" + pick(b"123456789", 1) + b"-1" + pick(b"0123456789", 1) + b"T1" + pick(b"0123456789", 1),
        lambda: b"".join(word().capitalize() for _ in range(4)),
        lambda: b"".join(word() for _ in range(5)),
        lambda: word() + word() + pick(b"0123456789", int(r.integers(1, 4))),
        lambda: pick(b"-_=+", 1) * int(r.integers(16, 60)),
    )
    for i in range(n):
        lead = b" ".join(word() for _ in range(5)) + b" "
        if i % 2:
            name = (b"key", b"pwd", b"auth", b"bearer", b"credential", b"access_key", b"private")[i // 2 % 7]
            body = pick((b"0123456789abcdef", low + b"0123456789", low + low.upper() + b"0123456789+/", low, low + low.upper())[i // 2 % 5], int(r.integers(18, 64)))
            lead += name + (b" = \"", b": ", b"=", b" ")[i // 2 % 4] if i % 3 else b""
        else:
            body = kinds[i // 2 % len(kinds)]()
        texts.append((lead + body + b" " + word(), len(lead), len(lead) + len(body)))
        labels.append(i % 2)
    return texts, labels


def _rule_texts(chunk: Chunk) -> np.ndarray:
    """Texts in which a rule may find something."""
    hexes = _runs(chunk, _IS_HEX, 24)[0]
    return np.unique(np.concatenate((_named(chunk), np.searchsorted(chunk.offsets, hexes, "right") - 1))).astype(int)


def _examples(batches):
    for b in batches:
        rows, y = [], []
        for chunk in chunks(b.column(0)):
            found = []
            for t in _rule_texts(chunk).tolist():
                lo, hi = int(chunk.offsets[t]), int(chunk.offsets[t + 1])
                text = chunk.raw[lo:hi].tobytes().decode()
                at = lo + np.append(np.flatnonzero((chunk.raw[lo:hi] & 0xC0) != 0x80), hi - lo)
                spans = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] + [(s, f) for s, k, f in base_spans(text) if k]
                found += [(at[s], at[f], lo, hi) for s, f in spans]
            if found:
                x, owner = windows(chunk.raw, *np.array(found, np.int64).T)
                x = x[np.unique(owner, return_index=True)[1]]
                bare = x.copy()
                bare[:, :BEFORE] = bare[:, BEFORE + BODY :] = 0
                x = np.where((np.arange(len(x)) % 2 == 0)[:, None], x, bare)
                rows += [r.tobytes() for r in x]
                y += [1] * len(x)
            a, e = _candidates(chunk)
            # Some of each chunk, spread by hash: the sample is bounded further on.
            names = [chunk.raw[x:z].tobytes() for x, z in zip(a.tolist(), e.tolist(), strict=True)]
            order = sorted(range(len(names)), key=lambda i: hashlib.blake2b(names[i], digest_size=8).digest())
            plain = [i for i in order[:400] if _made_of_words(names[i])][:64]
            if plain:
                text = np.searchsorted(chunk.offsets, a[plain], "right") - 1
                x, owner = windows(chunk.raw, a[plain], e[plain], chunk.offsets[text], chunk.offsets[text + 1])
                rows += [r.tobytes() for r in x[np.unique(owner, return_index=True)[1]]]
                y += [0] * len(plain)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(y, pa.int32())], ["x", "y"])


def train(docs: DataFrame, text_col: str = "text", max_train: int = 4000) -> Network:
    """``max_train``: labelled findings of each kind, the least by hash."""
    found = docs.select(F.col(text_col).alias("_t")).mapInArrow(_examples, "x binary, y int").distinct()
    rows = [r for y in (0, 1) for r in found.where(F.col("y") == y).orderBy(F.xxhash64("x"), "x").limit(max_train).collect()]
    texts, labels = drawn(4000)
    x = np.concatenate([encode(texts), *(np.frombuffer(r.x, np.uint8)[None] for r in rows)])
    y = np.array(labels + [r.y for r in rows], float)
    order = np.random.default_rng(3).permutation(len(y))
    return Network().train(x[order], y[order])


def _apart(start, end, base: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the spans overlap none of ``base``, which is in order."""
    if not base:
        return np.ones(len(start), bool)
    begins = np.array([s for s, _, _ in base])
    furthest = np.maximum.accumulate([f for _, _, f in base])
    before = np.searchsorted(begins, end)  # those that begin before each span ends
    return (before == 0) | (furthest[np.maximum(before - 1, 0)] <= start)


def _scan(model):
    def run(batches):
        empty = hashlib.sha256(b"").hexdigest()
        told = lambda found: ",".join(f"{KINDS[k]}:{s}:{f}" for s, k, f in found)
        for b in batches:
            n = b.num_rows
            counts, digest, spans = np.zeros((3, n), np.int64), [empty] * n, [""] * n
            for chunk in chunks(b.column(1)):
                a, e = _candidates(chunk)
                text = np.searchsorted(chunk.offsets, a, "right") - 1
                sure = np.zeros(len(a))
                for lo in range(0, len(a), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    x, owner = windows(chunk.raw, a[part], e[part], chunk.offsets[text[part]], chunk.offsets[text[part] + 1])
                    np.maximum.at(sure[part], owner, model.value.probability(x))
                hit = sure >= model.value.threshold
                a, e, text = a[hit], e[hit], text[hit]
                points = np.concatenate(([0], np.cumsum((chunk.raw & 0xC0) != 0x80)))
                start, end = (points[z] - points[chunk.offsets[text]] for z in (a, e))
                edge = np.searchsorted(text, np.arange(chunk.n + 1))
                rules = set(_rule_texts(chunk).tolist())
                for t in sorted(rules | set(text.tolist())):
                    base = base_spans(chunk.raw[chunk.offsets[t] : chunk.offsets[t + 1]].tobytes().decode()) if t in rules else []
                    own = slice(edge[t], edge[t + 1])
                    more = [(s, 3, f) for s, f, ok in zip(start[own].tolist(), end[own].tolist(), _apart(start[own], end[own], base).tolist(), strict=True) if ok]
                    row = chunk.first + t
                    for k in range(3):
                        counts[k, row] = sum(x[1] == k for x in base)
                    digest[row] = hashlib.sha256(told(base).encode()).hexdigest()
                    spans[row] = told(sorted(base + more))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], ["_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_scan(docs: DataFrame, model: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    out = d.mapInArrow(_scan(held), "_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return out.withColumnRenamed("_id", id_col)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan(docs, train(docs))


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLES: dict[str, str] = {}
