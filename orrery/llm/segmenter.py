"""Distinct sampled segmentations of texts: Gumbel top-k without replacement over the piece lattice.

The lattice of a text has an edge for every vocabulary piece at every position. Its segmentations
have probabilities in proportion to the product of their pieces' weights; backward sums over the
lattice give the conditional probability of each edge. The search keeps sets of segmentations in a
queue ordered by their perturbed bound, the largest Gumbel-perturbed log probability in the set,
which is drawn top-down and exact: popping the set with the largest bound yields the segmentation
that reaches it, and splits what is left of the set at every later edge into further sets whose
bounds are truncated Gumbel draws. The k segmentations popped first are the top k, that is, a sample
of size k without replacement; the next bound is the threshold of their inclusion scores,
log(1 - exp(-exp(log p - threshold))).

All draws are hashes of (seed, row key, sample, place in the text), so a row's samples depend on
nothing but its key and text. Lattices are built once per distinct unit, where a unit is a stretch
that no piece crosses, and are kept from one run of texts to the next until they hold `_KEPT` slots.

The vocabulary is read from a SentencePiece model file named by a parameter. Models of the unigram
kind carry log probabilities; those of the merge kind carry ranks, which are read as a Zipf law.
Characters outside the vocabulary become their byte pieces (or the unknown piece, where a model has
none). Null and empty texts have one segmentation, without pieces. A text with fewer than k
segmentations returns them all, with inclusion score 0 (certain). Rows without an id use the key 0;
repeated rows repeat their samples. Only id and text columns are read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ctw import Table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BYTES = 2 << 20
_KEPT = 2_000_000
_MASK = 0xFFFFFFFFFFFFFFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _mix_one(x: int) -> int:
    x &= _MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & _MASK
    return x ^ (x >> 31)


def _uniform_one(x: int) -> float:
    return ((_mix_one(x) >> 11) + 0.5) * 2.0**-53


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((_mix(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


@dataclass
class Vocabulary:
    pieces: list[str]
    log_p: np.ndarray  # by id, -inf for pieces that are not in the lattice
    bytes_: list[int]  # id of each byte piece, empty if there are none
    unknown: int
    table: Table | None = None
    longest: int = 1
    units: re.Pattern | None = None
    unknown_log_p: float = -30.0
    spelled: list[bytes] | None = None

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        score = np.array([model.get_score(i) for i in range(n)])
        usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)])
        named = {pieces[i]: i for i in range(n) if model.is_byte(i)}
        bytes_ = [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else []
        return Vocabulary.of(pieces, score, usable, bytes_, model.unk_id())

    @staticmethod
    def of(pieces: list[str], score: np.ndarray, usable: np.ndarray, bytes_: list[int], unknown: int) -> Vocabulary:
        """From scores: log probabilities, or (where all are whole numbers) an order read as a Zipf law."""
        log_p = np.where(usable, score, -np.inf).astype(float)
        if usable.any() and (score[usable] == np.round(score[usable])).all():
            rank = np.empty(int(usable.sum()))
            rank[np.argsort(-score[usable], kind="stable")] = np.arange(len(rank))
            weight = 1 / (rank + 2)
            log_p[usable] = np.log(weight / weight.sum())
        self = Vocabulary(pieces, log_p, bytes_, unknown)
        self.unknown_log_p = float(log_p[usable].min() - 10) if usable.any() else -30.0
        own = [i for i in np.nonzero(usable)[0] if pieces[i]]
        self.longest = max((len(pieces[i]) for i in own), default=1)
        # every prefix of a piece, with the piece's id where it is one
        prefixes: dict[str, int] = {}
        inner: set[str] = set()
        crossing = False
        for i in own:
            piece = pieces[i]
            for k in range(1, len(piece)):
                prefixes.setdefault(piece[:k], -1)
            prefixes[piece] = int(i)
            if len(piece) > 1:
                inner |= set(piece)
                crossing |= bool(re.search(f"[^{SPACE}]{SPACE}", piece))
        keys = np.array([self.key(p) for p in prefixes], _U)
        self.table = Table(keys, np.array(list(prefixes.values()), float))
        # Characters that no longer piece holds stand alone; other units start at a run of spaces, or
        # where a mark follows a character that precedes no mark in any piece.
        if crossing or not inner - {SPACE}:
            self.units = re.compile(r".+", re.S)
            return self
        before: dict[str, set[str]] = {c: set() for c in inner}
        for i in own:
            for x, y in zip(pieces[i], pieces[i][1:]):
                before[y].add(x)
        marks = {c for c in inner - {SPACE} if not c.isalpha()}
        while joined := {c for c in marks if before[c] - marks - {SPACE}}:
            marks -= joined
        one = lambda chars: "".join(re.escape(c) for c in sorted(chars))
        others = f"[{one(inner - marks - {SPACE})}]" if inner - marks - {SPACE} else "(?!)"
        mark = f"[{one(marks)}]" if marks else "(?!)"
        self.units = re.compile(f"{SPACE}+(?:{mark})*(?:{others})*|(?:{mark})+(?:{others})*|(?:{others})+|.", re.S)
        return self

    @staticmethod
    def key(piece: str) -> np.uint64:
        h = 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & _MASK
        return _U(h)

    def expand(self, ids: np.ndarray) -> np.ndarray:
        """Piece ids, with characters outside the vocabulary (negative) as their byte pieces."""
        if not (ids < 0).any():
            return ids
        out: list[int] = []
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
            elif self.bytes_:
                out += [self.bytes_[b] for b in chr(-i - 1).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unknown)
        return np.array(out, np.int32)

    def spelling(self) -> list[bytes]:
        """The bytes that each piece stands for."""
        if self.spelled is None:
            value = {i: b for b, i in enumerate(self.bytes_)}
            self.spelled = [bytes([value[i]]) if i in value else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        return self.spelled

    def decode(self, ids: list[int]) -> str:
        """The text of piece ids; the space that encoding puts in front is taken off."""
        spelled = self.spelling()
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_MOST = -0.5


class Lattice:
    """Lattices of distinct units, one after another; a unit of n characters has n + 1 slots."""

    def __init__(self, units: list[str], vocabulary: Vocabulary) -> None:
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(u) for u in units], np.int64)
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        self.sizes = sizes
        n = len(codes) + len(units)
        place = np.arange(len(codes)) + np.repeat(np.arange(len(units)), sizes)  # slot of each character
        room = np.repeat(self.start + sizes, sizes) - place
        h = np.zeros(len(codes), _U)
        alive = np.arange(len(codes))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        single = np.zeros(len(codes), bool)
        for size in range(1, vocabulary.longest + 1):
            alive = alive[room[alive] >= size]
            if not len(alive):
                break
            h[alive] = h[alive] * _BASE + (codes[alive + size - 1] + 1).astype(_U)
            value, there = vocabulary.table.get(h[alive])
            alive, value = alive[there], value[there].astype(np.int64)
            whole = value >= 0
            found.append((alive[whole], np.full(int(whole.sum()), size), value[whole]))
            if size == 1:
                single[alive[whole]] = True
        odd = np.nonzero(~single)[0]
        code = codes[odd]
        unknown = -code - 1
        if vocabulary.bytes_:
            unknown = np.where(code < 128, np.array(vocabulary.bytes_)[np.minimum(code, 127)], unknown)
        found.append((odd, np.ones(len(odd), np.int64), unknown))
        # edges in the order of their slots, placed by counting
        degree = np.zeros(n, np.int64)
        for at, _, _ in found:
            degree[place[at]] += 1  # no slot twice for one length
        self.first = np.concatenate([[0], np.cumsum(degree)]).astype(np.int32 if int(degree.sum()) < 1 << 31 else np.int64)
        edges = int(self.first[-1])
        self.piece, self.next, self.slot = (np.empty(edges, np.int32) for _ in range(3))
        weight = np.empty(edges)
        filled = self.first[:-1].copy()
        for at, length, piece in found:
            where = place[at]
            to = filled[where]
            filled[where] += 1
            self.piece[to], self.next[to], self.slot[to] = piece, where + length, where
            weight[to] = np.where(piece >= 0, vocabulary.log_p[np.maximum(piece, 0)], vocabulary.unknown_log_p)
            if at is odd:
                weight[to] = vocabulary.unknown_log_p
        # Backward sums, by distance from the unit's end, one edge of every slot at a time: plain
        # products as far as they can't underflow, logarithms beyond.
        far = np.argsort(room.astype(np.uint16) if len(room) and room.max() < 1 << 16 else room, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(room))[1:]]) if len(room) else np.zeros(1, np.int64)
        factor = np.exp(weight)
        plain = int(650 / max(1.0, -float(weight.min(initial=0.0))))
        sums_of = np.ones(n)
        beta = np.zeros(n)
        for distance, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
            if distance == plain + 1:
                beta = np.log(sums_of)
            slots = place[far[a:b]]
            at, last = self.first[slots], self.first[slots + 1]
            if distance <= plain:
                sums = factor[at] * sums_of[self.next[at]]
            else:
                sums = weight[at] + beta[self.next[at]]
            rows = np.arange(len(slots))
            while True:
                at = at + 1
                on = np.flatnonzero(at < last)
                if not len(on):
                    break
                rows, at, last = rows[on], at[on], last[on]
                if distance <= plain:
                    sums[rows] += factor[at] * sums_of[self.next[at]]
                else:
                    sums[rows] = np.logaddexp(sums[rows], weight[at] + beta[self.next[at]])
            if distance <= plain:
                sums_of[slots] = sums
            else:
                beta[slots] = sums
        if len(cuts) - 1 <= plain:
            beta = np.log(sums_of)
        slot = self.slot
        self.log_p = np.minimum(weight + beta[self.next] - beta[slot], 0.0)
        p = np.exp(self.log_p)
        heads = np.flatnonzero(np.diff(slot, prepend=-1))
        # what the edges of a slot but its leading one come to: where one takes most, 1 - p would round it away
        self.minor = np.zeros(n)
        if edges:
            self.minor[slot[heads]] = np.add.reduceat(np.where(self.log_p > _MOST, 0.0, p), heads)
        self.p = p
        self.p[self.first[slot[heads] + 1] - 1] = 2.0  # the last edge of a slot takes what rounding leaves
        self.ended = np.zeros(n, bool)
        self.ended[self.start + sizes] = True
        self.unit_start = np.repeat(self.start, sizes + 1).astype(np.int32)

    def extended(self, other: Lattice) -> Lattice:
        """This lattice with the units of another one behind its own."""
        out = Lattice.__new__(Lattice)
        slots, edges = len(self.ended), len(self.piece)
        out.sizes = np.concatenate([self.sizes, other.sizes])
        out.start = np.concatenate([self.start, other.start + slots])
        out.first = np.concatenate([self.first[:-1], other.first + other.first.dtype.type(edges)])
        for name in ("next", "slot", "unit_start"):
            part = getattr(other, name)
            setattr(out, name, np.concatenate([getattr(self, name), part + part.dtype.type(slots)]))
        for name in ("piece", "log_p", "p", "minor", "ended"):
            setattr(out, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        return out

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log probability of the other edges of each edge's slot; -inf where there is none."""
        log_p = self.log_p[edges]
        with np.errstate(divide="ignore"):
            return np.where(log_p > _MOST, np.log(self.minor[self.slot[edges]]), np.log(-np.expm1(np.minimum(log_p, _MOST))))

    def walk(self, slots: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each start to the end of its unit, in order, and their numbers."""
        steps = []
        active, at = np.arange(len(slots)), slots.copy()
        open_ = ~self.ended[at]
        active, at = active[open_], at[open_]
        place = (at - self.unit_start[at]).astype(_U)
        seed = seeds[active]
        while len(active):
            u = _uniform(seed + place * _U(0xD1342543DE82EF95))
            edge = self.first[at]
            p = self.p[edge]
            more = np.flatnonzero(u >= p)
            while len(more):
                u[more] -= p[more]
                edge[more] += 1
                p[more] = self.p[edge[more]]
                more = more[u[more] >= p[more]]
            steps.append((active, edge))
            before, at = at, self.next[edge]
            open_ = np.flatnonzero(~self.ended[at])
            active, before, at = active[open_], before[open_], at[open_]
            seed, place = seed[open_], place[open_] + (at - before).astype(_U)
        counts = np.zeros(len(slots), np.int64)
        for who, _ in steps:
            counts[who] += 1
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.int64)
        for k, (who, edge) in enumerate(steps):
            out[begin[who] + k] = edge
        return out, counts


class _Row:
    """The search of one text: its queue of sets and what has been popped."""

    __slots__ = ("units", "key", "queue", "paths", "salts", "number", "most")

    def __init__(self, units: np.ndarray, key: int, most: int) -> None:
        self.most = most
        self.units, self.key, self.queue, self.paths, self.salts, self.number = units, key, [], [], [], 0

    def push(self, bound: float, *place) -> None:
        if bound > -np.inf:
            self.number += 1
            heapq.heappush(self.queue, (-bound, self.number, *place))


def _truncated(phi, top, u):
    """Gumbel draws of location phi given that they are under `top`."""
    with np.errstate(divide="ignore", over="ignore"):
        return phi - np.log(np.exp(np.minimum(phi - top, 700.0)) - np.log(u))


class Units(dict):
    """Numbers of the units met, with the lattice of all of them; new units are numbered as they are asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self.lattice: Lattice | None = None
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number

    def ready(self) -> Lattice | None:
        """The lattice, with the new units built in."""
        if self.new:
            built, self.new = Lattice(self.new, self.vocabulary), []
            self.lattice = built if self.lattice is None else self.lattice.extended(built)
        return self.lattice

    def trim(self) -> None:
        """Start anew if what is kept has grown too large."""
        if self.lattice is not None and len(self.lattice.ended) > _KEPT:
            self.clear()
            self.lattice = None


def sample(texts: list[str | None], keys: list[int], k: int, vocabulary: Vocabulary, seed: int = 0, units_met: Units | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: (piece ids, log p, perturbed log p, log inclusion)."""
    index = Units(vocabulary) if units_met is None else units_met
    rows: list[_Row] = []
    for text, key in zip(texts, keys):
        body = SPACE + text.replace(" ", SPACE) if text else ""
        mixed = _mix_one((key ^ seed * 0x632BE59BD9B4E019) + int(_BASE))
        units = vocabulary.units.findall(body)
        rows.append(_Row(np.fromiter(map(index.__getitem__, units), np.int64, len(units)), mixed, k + 1))
    out: list[list] = [[] for _ in rows]
    lattice = index.ready()
    if lattice is None:
        return [[(np.zeros(0, np.int32), 0.0, 0.0, 0.0)] for _ in rows]
    for row in rows:
        if len(row.units):
            row.push(-math.log(-math.log(_uniform_one(row.key))), -1, 0, ())
    mixed_places = _mix(np.arange(max(len(row.units) for row in rows)).astype(_U))
    for number in range(k):
        jobs = []
        for i, row in enumerate(rows):
            while row.queue and row.queue[0][4] is None:  # a whole stretch of edges: split it first
                _split(lattice, row)
            if row.queue:
                bound, _, parent, t, excluded = heapq.heappop(row.queue)
                jobs.append((i, -bound, parent, t, excluded))
        if not jobs:
            break
        starts, seeds, heads = [], [], []
        for i, bound, parent, t, excluded in jobs:
            row = rows[i]
            salt = _U(_mix_one(row.key + (number + 1) * int(_BASE)))
            head, occ, left, first = _NONE, -1, -np.inf, 0
            if parent >= 0:
                edges, (head_size, occ_head, occ_first, counts_of), _, _ = row.paths[parent]
                slot = lattice.slot[edges[t]]
                low, high = int(lattice.first[slot]), int(lattice.first[slot + 1])
                open_ = [e for e in range(low, high) if e not in excluded]
                p = [float(lattice.log_p[e]) for e in open_]
                most = max(p)
                p = [math.exp(v - most) for v in p]
                mark, at = _uniform_one(int(salt) ^ 0xA5A5A5A5A5A5A5A5) * sum(p), 0
                while at < len(p) - 1 and mark >= p[at]:
                    mark -= p[at]
                    at += 1
                chosen = open_[at]
                others = sum(v for k_, v in enumerate(p) if k_ != at)
                left = float(lattice.log_p[edges[:t]].sum()) + most + math.log(others) if others > 0 else -np.inf
                excluded = (*excluded, chosen)
                occ = occ_head if t < head_size else occ_first + int(np.searchsorted(np.cumsum(counts_of), t - head_size, "right"))
                head = np.append(edges[:t], chosen)
                first = occ + 1
                starts.append(lattice.next[chosen : chosen + 1])
                seeds.append(salt + mixed_places[first - 1 : first])
            units = row.units[first:]
            starts.append(lattice.start[units])
            seeds.append(salt + mixed_places[first : first + len(units)])
            heads.append((head, occ, left, excluded, first - (parent >= 0), len(units) + (parent >= 0)))
        drawn, counts = lattice.walk(np.concatenate(starts), np.concatenate(seeds))
        ends = np.cumsum(counts)
        at = edge_at = 0
        for (i, bound, parent, t, _), (head, occ, left, excluded, first, n) in zip(jobs, heads):
            row = rows[i]
            mine = counts[at : at + n]
            stop = int(ends[at + n - 1]) if n else edge_at
            edges = np.concatenate([head, drawn[edge_at:stop]]) if len(head) else drawn[edge_at:stop]
            at, edge_at = at + n, stop
            upto = np.cumsum(lattice.log_p[edges])
            row.paths.append((edges, (len(head), occ, first, mine), upto, bound))
            # sets that leave this path after its head, and what remains where the head left its own
            key = (row.key ^ ((number + 1) * 0xC2B2AE3D27D4EB4F)) & _MASK
            row.salts.append(key)
            _push(lattice, row, len(row.paths) - 1, len(head), bound)
            if left > -np.inf:
                row.push(float(_truncated(left, bound, _uniform_one(key))), len(row.paths) - 1, t, excluded)
    for i, row in enumerate(rows):
        if not len(row.units):
            out[i] = [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]
            continue
        threshold = -row.queue[0][0] if row.queue else -np.inf
        for edges, _, upto, perturbed in row.paths:
            log_p = float(upto[-1])
            d = log_p - threshold
            inclusion = d if d < -30 else float(np.log(-np.expm1(-np.exp(min(d, 700.0)))))
            out[i].append((vocabulary.expand(lattice.piece[edges]).astype(np.int32), log_p, perturbed, inclusion))
    index.trim()
    return out


_NONE = np.zeros(0, np.int64)
_STRETCH = 64


def _bounds(lattice: Lattice, row: _Row, path: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Log mass of the sets that leave a path at each of the next edges, and, last, anywhere behind them."""
    edges, _, upto, _ = row.paths[path]
    part = edges[start : start + _STRETCH]
    phi = upto[start : start + len(part)] - lattice.log_p[part] + lattice.rest(part)
    stop = start + len(part)
    if stop < len(edges):
        ahead = float(upto[-1] - upto[stop - 1])  # log probability of the rest of the path, given its start
        tail = upto[stop - 1] + (math.log(-math.expm1(ahead)) if ahead < 0 else -np.inf)
        phi = np.append(phi, tail)
    noise = _uniform(_U(row.salts[path]) + np.arange(start + 1, start + 1 + len(phi)).astype(_U) * _BASE)
    return phi, noise


def _offer(row: _Row, path: int, start: int, edges: np.ndarray, bounds: np.ndarray) -> None:
    for k in np.argsort(-bounds, kind="stable")[: row.most].tolist():  # no more can come among the k + 1 largest
        at = start + k
        row.push(float(bounds[k]), path, at, (int(edges[at]),) if k < _STRETCH else None)


def _push(lattice: Lattice, row: _Row, path: int, start: int, top: float) -> None:
    """Queue the sets that leave a path from `start` on: edge by edge at first, then the rest as one set."""
    edges = row.paths[path][0]
    if start < len(edges):
        phi, noise = _bounds(lattice, row, path, start)
        _offer(row, path, start, edges, _truncated(phi, top, noise))


def _split(lattice: Lattice, row: _Row) -> None:
    """Replace the first set, a stretch behind an edge, by the sets that it is made of.

    One of them, drawn by its mass, has the stretch's bound; the others' bounds are under it.
    """
    bound, _, path, start, _ = heapq.heappop(row.queue)
    edges = row.paths[path][0]
    phi, noise = _bounds(lattice, row, path, start)
    p = np.cumsum(np.exp(phi - phi.max()))
    chosen = min(int(np.searchsorted(p, _uniform_one(row.salts[path] ^ (start * 0x9E3779B97F4A7C15)) * p[-1], "right")), int(np.flatnonzero(phi > -np.inf)[-1]))
    bounds = _truncated(phi, -bound, noise)
    bounds[chosen] = -bound
    _offer(row, path, start, edges, bounds)


def _spelled(ids: pa.Array, spelled: pa.Array) -> pa.Array:
    """The texts that lists of piece ids spell."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled.take(ids.flatten())), b"")
    led = pc.equal(pc.binary_slice(joined, 0, 1), b" ")
    text = pc.if_else(led, pc.binary_slice(joined, 1, 2**31 - 1), joined)
    try:
        return text.cast(pa.string())
    except pa.ArrowInvalid:  # ids that spell no valid text
        return pa.array([t.decode("utf-8", "replace") for t in text.to_pylist()], pa.string())


def encode(docs: DataFrame, vocabulary: Vocabulary, k: int = 2, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, sample, ids array<int>, log_p, perturbed, log_inclusion), samples from 1, without a shuffle.

    With `decoded`, also the text that the ids spell, from the ids alone, in the same pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = pa.array(shared.value.spelling(), pa.binary())
        units = Units(shared.value)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):  # some texts at a time, so that lattices take bounded memory
                end, held = at, 0
                while end < len(texts) and (end == at or held < _BYTES):
                    held += len(texts[end] or "")
                    end += 1
                found = sample(texts[at:end], [i or 0 for i in ids[at:end]], k, shared.value, seed, units)
                flat = [(i, n + 1, *s) for i, samples in zip(ids[at:end], found) for n, s in enumerate(samples)]
                at = end
                who, number, pieces, log_p, perturbed, inclusion = zip(*flat)
                offsets = np.cumsum([0, *map(len, pieces)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(pieces), pa.int32()))
                columns = [pa.array(who, pa.int64()), pa.array(number, pa.int32()), lists, pa.array(log_p, pa.float64()), pa.array(perturbed, pa.float64()), pa.array(inclusion, pa.float64())]
                yield pa.record_batch(columns + [_spelled(lists, spelling)] * decoded, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "sample", "ids", "log_p", "perturbed", "log_inclusion"] + ["text"] * decoded
    return rows.mapInArrow(run, "doc_id long, sample int, ids array<int>, log_p double, perturbed double, log_inclusion double" + ", text string" * decoded)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """`encoded` with the column `text` that its piece ids spell."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = pa.array(shared.value.spelling(), pa.binary())
        for whole in batches:
            for start in range(0, whole.num_rows, 512):  # the spelled pieces of some rows at a time
                batch = whole.slice(start, 512)
                yield pa.record_batch([*batch.columns, _spelled(batch.column(at).fill_null([]), spelled)], [*batch.schema.names, "text"])

    from pyspark.sql import types as T

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))
