"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary.

A text has a space put before it and spaces are piece characters, as in
SentencePiece, so that decoding gives the text back exactly.  The
lattice has an edge for each piece, and for each character without a piece an
edge at the least score less ten that becomes the character's byte pieces.  The best
paths are those of the greatest sums of piece scores.  For a unigram vocabulary
that is what SentencePiece encodes; of a BPE vocabulary it applies merges in order
of their scores, which often gives other pieces.

Pieces begin with spaces or hold none, so the lattice falls apart before each
run of spaces, and at characters that only stand alone; the paths of a text are
the combinations of the paths of its units.  Each distinct unit of a batch is
solved once, all units of a batch side by side in numpy:

* forward Viterbi: the best score of every prefix; back along the best path the
  best of what leaves it is the score of the second path;
* backward A*, for the units whose second path loses least in some text: from the end, a partial path with suffix score g that has come
  back to place v is worth g plus the Viterbi score of v.  That heuristic is
  exact, so every entry of the open list leads to a whole path of just its value,
  no more than the N best entries are ever needed, and the k-th path to reach
  the start is the k-th best.

The N best of a text then follow from its units' score losses: each is the best
one with the pieces of one or a few units changed for another path of theirs.  No unit
beyond the N - 1 with the least losses is changed, so the others need no further paths.

Defined results: null texts count as empty; an empty text has no pieces, score 0
and no further segmentations; fewer paths than N give nulls; of two paths with
equal scores either may come first, the same one in every run; rows with equal ids get a row each;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiergraph.llm._memory import returning
from tiergraph.llm._words import _INV, _ODD, U, chunks, mix, powers

_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=U)
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BATCH = 1 << 14


class Pieces:
    """The vocabulary: bytes and score of each piece, and the ids of byte pieces."""

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)])
        self.text = {i: sp.id_to_piece(i).replace("▁", " ").encode() for i in ids}
        self._set([self.text[i] for i in ids], np.array(ids), np.array([sp.get_score(i) for i in ids]))

    def _set(self, texts: list[bytes], ids: np.ndarray, scores: np.ndarray) -> None:
        if any(b" " in t.lstrip(b" ") for t in texts):
            raise ValueError("a piece holds a space after another character")
        h = np.array([self.hash(t) for t in texts], U)
        order = np.argsort(h)
        self.hashes, self.ids, self.scores = h[order], ids[order], scores[order].astype(np.float64)
        self.longest = max(map(len, texts))
        # Pieces of spaces alone are marked as never to be merged: they count as fallbacks.
        self.fallback = float(scores[scores > -1e8].min()) - 10.0
        self.scores = np.maximum(self.scores, self.fallback)
        table = np.full(1 << 20, -1, np.int32)
        # Open addressing with a fixed number of probes.
        for k, x in enumerate(self.hashes.tolist()):
            spot = x >> 44
            while table[spot] >= 0:
                spot = (spot + 1) & 0xFFFFF
            table[spot] = k
        runs = np.flatnonzero(np.diff(np.concatenate(([0], (table >= 0).astype(int), [0]))))
        self.probes, self.table = int(np.diff(runs)[::2].max()), table
        longer = b"".join(t for t in texts if len(t) > 1)
        self.alone = [b for b in range(128) if bytes([b]) not in longer]

    @staticmethod
    def hash(t: bytes) -> int:
        x = np.frombuffer(t, np.uint8)
        return int(mix((_BYTE[x] * powers(_ODD, len(x))).sum(dtype=U, keepdims=True))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or -1."""
        spot = (h >> U(44)).astype(np.int32)
        got = self.table[spot]
        out = np.where((got >= 0) & (self.hashes[got] == h), got, -1)
        again = np.nonzero((got >= 0) & (out < 0))  # taken by another: few
        for k in range(1, self.probes):
            if not len(again[0]):
                break
            got = self.table[(spot[again] + k) & 0xFFFFF]
            hit = (got >= 0) & (self.hashes[got] == h[again])
            out[tuple(x[hit] for x in again)] = got[hit]
            again = tuple(x[(got >= 0) & ~hit] for x in again)
        return out


class Solved:
    """For each unit: the scores of its n best paths (NaN beyond the last), and
    of each of these paths the pieces: ``ids[at[u, k]:at[u, k] + length[u, k]]``."""

    def __init__(self, scores, ids, at, length):
        self.scores, self.ids, self.at, self.length = scores, ids, at, length


def _edges(pieces: Pieces, raw: np.ndarray):
    """score[u, j, l]: of the edge of l + 1 bytes that ends at byte j of unit u; -inf: none.
    which: the piece of the edge, or -1 for bytes."""
    n, width = raw.shape
    power, inverse = powers(_ODD, width), powers(_INV, width)
    sums = np.zeros((n, width + 1), U)
    np.cumsum(_BYTE[raw] * power, axis=1, out=sums[:, 1:])
    longest = min(pieces.longest, width)
    score = np.full((n, width + 1, longest), -np.inf)
    which = np.full((n, width + 1, longest), -1, np.int32)
    head = (raw & 0xC0) != 0x80  # a character begins here
    ends = np.ones((n, width + 1), bool)
    ends[:, :-1] = head
    for step in range(1, longest + 1):
        got = pieces.find(mix((sums[:, step:] - sums[:, :-step]) * inverse[: width - step + 1]))
        known = got >= 0
        one = head[:, : width - step + 1] & ends[:, step:] if step <= 4 else None
        if one is not None:
            for k in range(1, step):
                one &= ~head[:, k : width - step + 1 + k]
        value = np.where(known, pieces.scores[got], -np.inf)
        if one is not None:
            value = np.where(one & ~known, pieces.fallback, value)
        score[:, step:, step - 1] = value
        which[:, step:, step - 1] = got
    return score, which


def _forward(pieces: Pieces, units: list[bytes]):
    """The edges of units of one length, the best score of every prefix, and with each edge as its last."""
    count, width = len(units), len(units[0])
    raw = np.frombuffer(b"".join(units), np.uint8).reshape(count, width)
    score, which = _edges(pieces, raw)
    longest = score.shape[2]
    best = np.full((count, width + 1), -np.inf)
    best[:, 0] = 0
    reach = np.full_like(score, -np.inf)  # of the best path that ends with each edge
    for j in range(1, width + 1):
        most = min(j, longest)
        np.add(best[:, j - most : j][:, ::-1], score[:, j, :most], out=reach[:, j, :most])
        best[:, j] = reach[:, j, :most].max(1)
    return raw, which, best, reach.reshape(-1, longest), score.reshape(-1)


def first(pieces: Pieces, units: list[bytes]) -> tuple[Solved, np.ndarray]:
    """The best path of each unit, and how much less the second one scores (infinite: there is none).

    All units have one length.  The second path leaves the best one, seen from the end, at some place
    by another edge, and goes on as the best path to there."""
    raw, which, best, reach, edges = _forward(pieces, units)
    (count, width), longest = raw.shape, reach.shape[1]
    out, last, second = np.full((count, 1), np.nan), np.full((count, 1), -1), np.full(count, -np.inf)
    u = np.flatnonzero(best[:, width] > -np.inf)
    at, g, node = np.full(len(u), width), np.zeros(len(u)), np.full(len(u), -1)
    parents, steps, made = [], [], 0
    while len(u):
        row = u * (width + 1) + at
        here, lines = reach.take(row, axis=0), np.arange(len(u))
        edge = here.argmax(1)
        here[lines, edge] = -np.inf
        second[u] = np.maximum(second[u], here.max(1) + g)
        g = g + edges.take(row * longest + edge)
        parents.append(node)
        steps.append(np.stack((u, at, edge), 1))
        node, at = made + lines, at - 1 - edge
        made += len(u)
        done, on = at == 0, at > 0
        out[u[done], 0], last[u[done], 0] = g[done], node[done]
        u, at, g, node = u[on], at[on], g[on], node[on]
    loss = np.where(second > -np.inf, np.maximum(out[:, 0] - second, 0), np.inf)
    return _paths(pieces, raw, which, out, last, parents, steps), loss


def solve(pieces: Pieces, units: list[bytes], n: int) -> Solved:
    """All units have one length."""
    raw, which, best, reach, edges = _forward(pieces, units)
    (count, width), longest = raw.shape, reach.shape[1]

    # The open list: value, place, suffix score and last node of each entry.
    value = np.full((count, n), -np.inf)
    value[:, 0] = best[:, width]
    place, suffix = np.full((count, n), width), np.zeros((count, n))
    node = np.full((count, n), -1)
    parents, steps = [], []
    made = 0
    found = np.zeros(count, np.int64)
    out = np.full((count, n), np.nan)
    last = np.full((count, n), -1)
    active = np.arange(count)
    while len(active):
        top = value[active].argmax(1)
        alive = value[active, top] > -np.inf
        active, top = active[alive], top[alive]
        if not len(active):
            break
        v, g, at, here = value[active, top], suffix[active, top], place[active, top], node[active, top]
        value[active, top] = -np.inf
        done = at == 0
        if done.any():
            u = active[done]
            out[u, found[u]], last[u, found[u]] = v[done], here[done]
            found[u] += 1
        u, g, at, here = active[~done], g[~done], at[~done], here[~done]
        if len(u):
            row = u * (width + 1) + at
            # Only the n best of the old entries and the new ones can be needed.
            pool = np.concatenate((value[u], reach.take(row, axis=0) + g[:, None]), 1)
            keep = np.argpartition(-pool, n - 1, axis=1)[:, :n]
            rows = np.arange(len(u))[:, None]
            fresh = (keep >= n) & (pool[rows, keep] > -np.inf)
            old = np.where(keep < n, keep, 0)
            new = np.where(keep >= n, keep - n, 0)
            number = np.zeros(keep.shape, np.int64)
            number[fresh] = made + np.arange(fresh.sum())
            parents.append(np.broadcast_to(here[:, None], keep.shape)[fresh])
            steps.append(np.stack((np.broadcast_to(u[:, None], keep.shape)[fresh], np.broadcast_to(at[:, None], keep.shape)[fresh], new[fresh]), 1))
            made += int(fresh.sum())
            place[u] = np.where(fresh, at[:, None] - 1 - new, place[u[:, None], old])
            suffix[u] = np.where(fresh, g[:, None] + edges.take(row[:, None] * longest + new), suffix[u[:, None], old])
            node[u] = np.where(fresh, number, node[u[:, None], old])
            value[u] = pool[rows, keep]
        active = active[found[active] < n]
    return _paths(pieces, raw, which, out, last, parents, steps)


def _paths(pieces, raw, which, out, last, parents, steps) -> Solved:
    parent = np.concatenate(parents) if parents else np.zeros(0, np.int64)
    step = np.concatenate(steps) if steps else np.zeros((0, 3), np.int64)
    flat = last.ravel()
    have = np.flatnonzero(flat >= 0)
    path, node, ids, owner = have, flat[have], [], []
    while len(path):  # from the start of the unit to its end, a piece of each path at a time
        u, j, length = step[node].T
        got = which[u, j, length]
        ids.append(np.where(got >= 0, pieces.ids[got], -1 - j * 8 - length))
        owner.append(path)
        node = parent[node]
        path, node = path[node >= 0], node[node >= 0]
    width = np.zeros(len(flat), np.int64)
    if owner:
        owner_, ids_ = np.concatenate(owner), np.concatenate(ids)
        order = np.argsort(owner_, kind="stable")
        owner_, ids_ = owner_[order], ids_[order]
        lone = ids_ < 0
        if lone.any():  # characters without a piece: their bytes
            code = -1 - ids_
            times = np.where(lone, code % 8 + 1, 1)
            spot = np.repeat(np.arange(len(ids_)), times)
            within = np.arange(len(spot)) - np.repeat(np.cumsum(times) - times, times)
            unit = owner_[spot] // last.shape[1]
            at = np.where(lone[spot], (code // 8 - code % 8 - 1)[spot] + within, 0)
            ids_ = np.where(lone[spot], pieces.byte_ids[raw[unit, at]], ids_[spot])
            owner_ = owner_[spot]
        width = np.bincount(owner_, minlength=len(flat))
    else:
        ids_ = np.zeros(0, np.int64)
    return Solved(out, ids_.astype(np.int32), (np.cumsum(width) - width).reshape(last.shape), width.reshape(last.shape))


def _batches(pieces: Pieces, units: list[bytes]):
    """Which units go together: of one length, and not too many."""
    size = np.array([len(u) for u in units])
    order = np.argsort(size, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        step = max(1, min(BATCH, (1 << 20) // max(1, int(size[same[0]]) * min(int(size[same[0]]), pieces.longest)))) if len(same) else 1
        for k in range(0, len(same), step):
            yield same[k : k + step]


def solve_units(pieces: Pieces, units: list[bytes], n: int) -> Solved:
    """Units of any length, in batches of one length."""
    scores, at, length = np.full((len(units), n), np.nan), np.zeros((len(units), n), np.int64), np.zeros((len(units), n), np.int64)
    ids, base = [], 0
    for part in _batches(pieces, units):
        s = solve(pieces, [units[i] for i in part.tolist()], n)
        scores[part], at[part], length[part] = s.scores, s.at + base, s.length
        ids.append(s.ids)
        base += len(s.ids)
    return Solved(scores, np.concatenate(ids) if ids else np.zeros(0, np.int32), at, length)


def first_of_units(pieces: Pieces, units: list[bytes]) -> tuple[Solved, np.ndarray]:
    """``first`` of units of any length."""
    scores, at, length, loss = np.full((len(units), 1), np.nan), np.zeros((len(units), 1), np.int64), np.zeros((len(units), 1), np.int64), np.full(len(units), np.inf)
    ids, base = [], 0
    for part in _batches(pieces, units):
        s, loss[part] = first(pieces, [units[i] for i in part.tolist()])
        scores[part], at[part], length[part] = s.scores, s.at + base, s.length
        ids.append(s.ids)
        base += len(s.ids)
    return Solved(scores, np.concatenate(ids) if ids else np.zeros(0, np.int32), at, length), loss


def n_best_sums(losses: list[list[float]], n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The n least sums of one loss from each list, and which items other than the first
    of their lists are in each, as (list, item); each list rises from 0."""
    order = sorted((i for i, x in enumerate(losses) if len(x) > 1), key=lambda i: losses[i][1])
    lists = [losses[i] for i in order]
    out, heap, seen = [(0.0, ())], [], set()
    if lists:
        heap = [(lists[0][1], ((0, 1),))]
    while heap and len(out) < n:
        total, pick = heapq.heappop(heap)
        if pick in seen:
            continue
        seen.add(pick)
        out.append((total, tuple((order[i], k) for i, k in pick)))
        i, k = pick[-1]
        if k + 1 < len(lists[i]):
            heapq.heappush(heap, (total - lists[i][k] + lists[i][k + 1], pick[:-1] + ((i, k + 1),)))
        if i + 1 < len(lists):
            more = lists[i + 1][1]
            heapq.heappush(heap, (total + more, pick + ((i + 1, 1),)))
            if k == 1:
                heapq.heappush(heap, (total - lists[i][1] + more, pick[:-1] + ((i + 1, 1),)))
    return out


def least_losses(loss: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
    """The same for n of 3 at most and losses as rows (units, 2), NaN where a unit has no
    such path: two changes cost at least as much as the two least single ones."""
    flat = loss.ravel()
    have = np.flatnonzero(~np.isnan(flat))
    if len(have) > n:
        have = have[np.argpartition(flat[have], n - 2)[: n - 1]]
    have = have[np.lexsort((have, flat[have]))][: n - 1]
    return [(0.0, ())] + [(float(flat[x]), ((x // loss.shape[1], x % loss.shape[1] + 1),)) for x in have.tolist()]


def _least(loss: np.ndarray, n: int) -> np.ndarray:
    """Where the n least finite losses are."""
    at = np.sort(np.argpartition(loss, n - 1)[:n]) if len(loss) > n else np.arange(len(loss))
    return at[loss[at] < np.inf]


def _units(pieces: Pieces, chunk):
    """The bytes of all texts, each with a space before it, and where units begin."""
    full = np.diff(chunk.offsets) > 0
    raw = np.insert(chunk.raw, chunk.offsets[:-1][full], 0x20)
    at = chunk.offsets + np.concatenate(([0], np.cumsum(full)))
    cut = np.zeros(len(raw), bool)
    space = raw == 0x20
    cut[1:] = space[1:] & ~space[:-1]
    alone = np.isin(raw, pieces.alone)
    cut |= alone
    cut[1:] |= alone[:-1]
    cut[at[:-1][full]] = True
    return raw, at, np.flatnonzero(cut)


class Codec:
    """Encodes and decodes; solved units are kept up to a bound."""

    def __init__(self, pieces: Pieces, n: int, keep: int = 250_000):
        self.pieces, self.n, self.keep = pieces, n, keep
        self.width = np.zeros(int(max(pieces.ids.max(), pieces.byte_ids.max())) + 1, np.int64)
        text = [b""] * len(self.width)
        for i, t in pieces.text.items():
            text[i] = t
        for b, i in enumerate(pieces.byte_ids.tolist()):
            text[i] = bytes([b])
        self.width[:] = [len(t) for t in text]
        self.start = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(text), np.uint8)
        self._clear()

    def _clear(self):
        self.known, self.number = np.zeros(0, U), np.zeros(0, np.int64)  # hashes of units in order, and their numbers
        # Of each unit the score of its best path, what the second one loses, and the pieces of the best.
        self.scores, self.loss = np.zeros(0), np.zeros(0)
        self.ids, self.at, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.further = {}  # of some units: losses, and (pieces, whether they spell the unit), of their further paths

    def _add(self, fresh: list[bytes]):
        s, loss = first_of_units(self.pieces, fresh)
        self.at = np.concatenate((self.at, len(self.ids) + s.at[:, 0]))
        self.ids = np.concatenate((self.ids, s.ids))
        self.length = np.concatenate((self.length, s.length[:, 0]))
        self.scores = np.concatenate((self.scores, s.scores[:, 0]))
        self.loss = np.concatenate((self.loss, loss))

    def _add_further(self, units: dict[int, bytes]):
        """The n - 1 further paths of units, by their numbers."""
        s = solve_units(self.pieces, list(units.values()), self.n)
        for i, (number, unit) in enumerate(units.items()):
            best = self.ids[self.at[number] : self.at[number] + self.length[number]]
            ways = [(k, s.ids[a : a + z]) for k, (a, z) in enumerate(zip(s.at[i].tolist(), s.length[i].tolist(), strict=True)) if not np.isnan(s.scores[i, k])]
            # Of paths with equal scores another one than the best may come first here.
            ways = [w for w in ways if not np.array_equal(w[1], best)][: self.n - 1]
            loss = np.full(self.n - 1, np.nan)
            loss[: len(ways)] = [s.scores[i, 0] - s.scores[i, k] for k, _ in ways]
            self.further[number] = loss, [(ids.copy(), self._spelt(ids).tobytes() == unit) for _, ids in ways]

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        width = self.width[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(width) - width), width) + np.arange(width.sum())]

    def encode(self, chunk):
        """ids of the best paths of all texts end to end, where each text's begin,
        (texts, n) scores, and for each text its further paths: each a list of
        (begin, end, ids, sound), the parts of the best path's ids that others replace."""
        raw, at, cuts = _units(self.pieces, chunk)
        # Units are told apart by a 64-bit hash; ``round_trip`` would show a mix-up.
        sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_BYTE[raw] * powers(_ODD, len(raw)), out=sums[1:])
        stop = np.append(cuts[1:], len(raw)) if len(cuts) else cuts
        h = mix((sums[stop] - sums[cuts]) * powers(_INV, len(raw))[cuts])
        own, place, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.keep:
            self._clear()
        spot = np.searchsorted(self.known, own)
        fresh = np.ones(len(own), bool)
        inside = spot < len(self.known)
        fresh[inside] = self.known[spot[inside]] != own[inside]
        if fresh.any():
            whole, first = raw.tobytes(), len(self.known)
            for lo in range(0, len(own[fresh]), BATCH):
                part = place[fresh][lo : lo + BATCH]
                self._add([whole[a:b] for a, b in zip(cuts[part].tolist(), stop[part].tolist(), strict=True)])
            where = spot[fresh]
            self.known = np.insert(self.known, where, own[fresh])
            self.number = np.insert(self.number, where, first + np.arange(len(where)))
        unit = self.number[np.searchsorted(self.known, own)][back]
        bound = np.searchsorted(cuts, at)
        length = self.length[unit]
        ends = np.concatenate(([0], np.cumsum(length)))
        ids = self.ids[np.repeat(self.at[unit] - ends[:-1], length) + np.arange(ends[-1])]
        begin = ends[bound]
        scores = np.full((chunk.n, self.n), np.nan)
        # Sums of whole texts, each from its own start, so that order does not matter.
        scores[:, 0] = [self.scores[unit[a:b]].sum() for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
        further = [[] for _ in range(chunk.n)]
        if self.n > 1:
            picks = [a + _least(self.loss[unit[a:b]], self.n - 1) for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
            some = np.concatenate([np.zeros(0, np.int64), *picks])
            number, where = np.unique(unit[some], return_index=True)
            asked = {u: raw[cuts[i] : stop[i]].tobytes() for u, i in zip(number.tolist(), some[where].tolist(), strict=True) if u not in self.further}
            if asked:
                self._add_further(asked)
            for t, pick in enumerate(picks):
                if not len(pick):
                    continue
                own = unit[pick].tolist()
                loss = np.stack([self.further[u][0] for u in own])
                found = least_losses(loss, self.n) if self.n <= 3 else n_best_sums([[0.0, *x[~np.isnan(x)].tolist()] for x in loss], self.n)
                for k, (lost, changed) in enumerate(found[1:], 1):
                    scores[t, k] = scores[t, 0] - lost
                    further[t].append([(int(ends[pick[i]]) - int(begin[t]), int(ends[pick[i] + 1]) - int(begin[t]), *self.further[own[i]][1][r - 1]) for i, r in sorted(changed)])
        return ids, begin, scores, further

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of one text's ids."""
        return self._spelt(ids).tobytes()[1:]


def changed(best: np.ndarray, parts) -> list[np.ndarray]:
    """A further path as pieces of the best one and what replaces others, in order."""
    out, at = [], 0
    for begin, end, ids, _ in parts:
        out += [best[at:begin], ids]
        at = end
    return [*out, best[at:]]


def _encoded(held, n: int, with_ids: bool):
    def run(batches):
        codec = Codec(held.value, n)
        for b in batches:
            for chunk in chunks(b.column(1)):
                ids, begin, scores, further = codec.encode(chunk)
                count, digest, same, paths = ([[None] * chunk.n for _ in range(n)] for _ in range(4))
                for t in range(chunk.n):
                    own = ids[begin[t] : begin[t + 1]]
                    ways = [[own], *(changed(own, parts) for parts in further[t])]
                    same[0][t] = codec.decode(own) == chunk.raw[chunk.offsets[t] : chunk.offsets[t + 1]].tobytes()
                    for k, way in enumerate(ways):
                        told = hashlib.sha256()
                        for part in way:
                            told.update(part.astype("<i4").tobytes())
                        digest[k][t] = told.hexdigest()
                        count[k][t] = sum(map(len, way))
                        if k:  # a further path spells the text if the best does and its own parts spell their units
                            same[k][t] = same[0][t] and all(part[3] for part in further[t][k - 1])
                            if with_ids:
                                paths[k][t] = np.concatenate(way)
                rows = slice(chunk.first, chunk.first + chunk.n)
                columns = {"_id": b.column(0)[rows]}
                for k in range(n):
                    columns |= {f"n_pieces{_nth(k)}": pa.array(count[k], pa.int64()), f"ids_sha256{_nth(k)}": pa.array(digest[k], pa.string()), f"round_trip{_nth(k)}": pa.array(same[k], pa.bool_()), f"score_{k + 1}": pa.array(scores[:, k], mask=np.isnan(scores[:, k]))}
                    if with_ids:
                        columns[f"ids{_nth(k)}"] = pa.array(paths[k], pa.list_(pa.int32())) if k else pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _nth(k: int) -> str:
    return f"_{k + 1}" if k else ""


def encode_nbest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, model_file: str = MODEL, with_ids: bool = True) -> DataFrame:
    """For each row its id and of the best segmentation n_pieces, ids_sha256, round_trip,
    score_1 and ids; of the k-th the same as n_pieces_k, ids_sha256_k, round_trip_k, score_k, ids_k.

    The digests are of the ids as little-endian 32-bit numbers; ``round_trip`` says
    whether decoding them gave the text back.  The vocabulary is read on the
    driver; its size does not depend on the data."""
    held = docs.sparkSession.sparkContext.broadcast(Pieces(model_file))
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_t"))
    schema = "_id long" + "".join(f", n_pieces{_nth(k)} long, ids_sha256{_nth(k)} string, round_trip{_nth(k)} boolean, score_{k + 1} double" + f", ids{_nth(k)} array<int>" * with_ids for k in range(n))
    return d.mapInArrow(returning(_encoded(held, n, with_ids)), schema).withColumnRenamed("_id", id_col)


def decode_ids(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """(id, text) from (id, ids); null ids give a null text."""
    held = rows.sparkSession.sparkContext.broadcast(Pieces(model_file))

    def run(batches):
        codec = Codec(held.value, 1)
        for b in batches:
            text = [None if x is None else codec.decode(np.array(x, np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], ["_id", "text"])

    return rows.select(F.col(id_col).alias("_id"), F.col(ids_col)).mapInArrow(run, f"_id {dict(rows.dtypes)[id_col]}, text string").withColumnRenamed("_id", id_col)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_nbest(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict[str, str] = {}
