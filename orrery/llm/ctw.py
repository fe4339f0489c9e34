"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A text is its words (ASCII case folded, joined by one space) and one end byte. Every byte is eight
binary decisions; each decision node of the byte has its own context tree over the preceding
bytes, up to `DEPTH` of them. A tree node weighs its Krichevsky-Trofimov estimate against the
product of its children, half and half, so the root mixes the estimates of all depths:
Pw(s) = (Pkt(s) + prod Pw(children)) / 2. The trees are learned once, from the counts of all
training texts, and then score every text. A decision is predicted at the deepest context of the
text that is a node of its tree, by the mixture of all estimates from the root to there; a decision
that no context has met is even. Each of a byte's decisions has one probability whatever the byte,
so the probabilities of all bytes sum to one, seen or not.

A context is a tree node if it is found at least `LEAST` times in the training texts, so nodes grow
with the text; what a node's own children don't cover is one further child, the rest, with counts of
its own. The tree is never held in one place: grams are dealt by their `SPLIT` nearest predecessors
into buckets, each of which holds whole subtrees. A first pass weighs the subtrees and hands up sums
for the nodes above them, which are few whatever the corpus and are weighed in the driver; a second
takes the predictions down again. Texts travel in chunks of about `_CHUNK` bytes: a chunk asks each
bucket once for every different gram it holds, and gets one prediction for each.

The base score is a word unigram with add-one smoothing over exact counts. Words (by their 64-bit
hashes) take the same way: a chunk tells each bucket of words which it holds and, if it is taught
from, how often, and gets their counts in all training texts.

Null and empty texts are scored as one end token. Rows without an id are training rows. Repeated
rows are scored each, and count in training as often as they come. With no training rows every
byte has probability 1/256. Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed

DEPTH = 6
END = 0xFF
LEAST = 2
SPLIT = 3
BUCKET_BITS = 8
WORDS = 1 << BUCKET_BITS
_BYTES = 2 << 20
_CHUNK, _CHUNK_ROWS = 8 << 20, 100_000
_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)


def _bytes_table(of: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(of, np.uint8)] = True
    return table


_SPACE = _bytes_table(b" \t\n\v\f\r")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[_SPACE] = 32
# Words are hashed by sums of random numbers for their bytes times powers of an odd number.
_POWER = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
END_WORD = 1  # stands for the end token among word hashes


class Texts:
    """Some texts as one array of bytes: each its words, ASCII case folded, by single spaces, and an end byte."""

    def __init__(self, texts: list[bytes | None]) -> None:
        raw = np.frombuffer(b"".join([(t or b"").strip(b" \t\n\v\f\r") + _END for t in texts]), np.uint8)
        space = _SPACE[raw]
        keep = ~space
        keep[:-1] |= ~space[1:]  # of a run of spaces the last stays
        self.data = _LOWER[raw[keep]]
        self.ends = np.nonzero(self.data == END)[0]
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.sizes = self.ends + 1 - self.starts

    def grams(self, depth: int = DEPTH, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Key of every byte with its `depth` predecessors (zero before the start of its text).

        The predicted byte is the key's lowest, its predecessors follow in order of nearness.
        """
        lead = min(start, depth)
        data = self.data[start - lead : stop].astype(_U)
        keys = data.copy()
        for j in range(1, depth + 1):
            keys[j:] |= data[:-j] << _U(8 * j)
        keys = keys[lead:]
        for j in range(depth):  # what lies before a text's start is no context
            at = self.starts + j - start
            at = at[(at >= 0) & (at < len(keys)) & (j < self.sizes)]
            keys[at] &= _low(j + 1)
        return keys

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the number of its text."""
        ends = np.nonzero((self.data == 32) | (self.data == END))[0]
        starts = np.concatenate([[0], ends[:-1] + 1])
        full = ends > starts
        starts, ends = starts[full], ends[full]
        h = np.empty(len(starts), _U)
        a = 0
        while a < len(starts):  # some words at a time, so that their powers stay few
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + _BYTES // 2)))
            low = starts[a]
            part = self.data[low : ends[b - 1]]
            sums = np.concatenate([[_U(0)], np.cumsum(_RANDOM[part] * _powers(len(part)), dtype=_U)])
            h[a:b] = (sums[ends[a:b] - low] - sums[starts[a:b] - low]) * _powers(len(part), inverse=True)[starts[a:b] - low]
            a = b
        h += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(32)
        h *= _U(0xC2B2AE3D27D4EB4F)
        h ^= h >> _U(29)
        return h, np.searchsorted(self.ends, starts)


_END = bytes([END])
_POWERS: dict[bool, np.ndarray] = {}


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b^2 ... modulo 2^64, of the base or of its inverse."""
    found = _POWERS.get(inverse)
    if found is None or len(found) < n:
        base = pow(_POWER, -1, 1 << 64) if inverse else _POWER
        found = np.empty(max(n, 1 << 16), _U)
        found[0] = 1
        done = 1
        while done < len(found):
            step = min(done, len(found) - done)
            found[done : done + step] = found[:step] * _U(pow(base, done, 1 << 64))
            done += step
        _POWERS[inverse] = found
    return found[:n]


_HELD = 2_000_000  # counts that a task holds before it adds them up


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key."""
    if len(parts) == 1:
        return parts[0]
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


# --- the model ------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2, by Stirling's series after a shift of eight."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted key in sorted keys, -1 if absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class Table:
    """Open-addressed map from 64-bit keys to doubles, read many keys at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.2))))
        self.shift, self.mask = _U(64 - bits), _U((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.values = np.zeros(1 << bits, values.dtype)
        slot = (keys * _U(0x9E3779B97F4A7C15)) >> self.shift
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            first = first[self.keys[slot[first]] == _EMPTY]
            self.keys[slot[first]], self.values[slot[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slot = keys[left], values[left], (slot[left] + _U(1)) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, whether present) of each key."""
        slot = ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)
        met = np.take(self.keys, slot, mode="wrap")
        there = met == keys
        values = np.take(self.values, slot, mode="wrap")
        left = np.flatnonzero(~there & (met != _EMPTY))
        slot, wanted = slot[left], keys[left]
        while len(left):
            slot = (slot + 1) & int(self.mask)
            met = np.take(self.keys, slot, mode="wrap")
            hit = np.flatnonzero(met == wanted)
            values[left[hit]], there[left[hit]] = self.values[slot[hit]], True
            on = np.flatnonzero((met != wanted) & (met != _EMPTY))
            left, slot, wanted = left[on], slot[on], wanted[on]
        return values, there


def _low(depth: int) -> np.uint64:
    return _U((1 << (8 * depth)) - 1)


@dataclass
class Model:
    """Predictions of the weighted trees.

    `grams` are sorted grams of the deepest contexts with the log10 probabilities of their bytes;
    nodes[d][k] has, for d bytes of context, the names of the nodes of the k-th decision and their
    predictions of a one.
    """

    depth: int
    grams: tuple[np.ndarray, np.ndarray]
    nodes: list[list[tuple[np.ndarray, np.ndarray]]]

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte given its predecessors."""
        out = np.zeros(len(keys))
        at = _find(self.grams[0], keys)
        out[at >= 0] = self.grams[1][at[at >= 0]]
        rest = np.flatnonzero(at < 0)
        mine = keys[rest]
        context, byte = mine >> _U(8), mine & _U(255)
        sums = np.zeros(len(rest))
        for k in range(8):
            one = np.full(len(rest), 0.5)
            left = np.arange(len(rest))
            for d in range(self.depth, -1, -1):
                names, p = self.nodes[d][k]
                at = _find(names, _head(context[left] & _low(d), byte[left], k))
                one[left[at >= 0]] = p[at[at >= 0]]
                left = left[at < 0]
                if not len(left):
                    break
            sums += np.log10(np.where(byte >> _U(7 - k) & _U(1) == 1, one, 1 - one))
        out[rest] = sums
        return out


def _head(context: np.ndarray, byte: np.ndarray, k: int) -> np.ndarray:
    """Key of the k-th decision of a byte after a context: the byte's first k bits are known."""
    return (context << _U(8)) | (byte >> _U(8 - k) << _U(8 - k) if k else byte & _U(0))


def _nodes(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the k-th decision of sorted grams, and where each begins."""
    heads = _head(keys >> _U(8), keys & _U(255), k)
    first = np.nonzero(np.concatenate([[True], heads[1:] != heads[:-1]]))[0] if len(heads) else np.zeros(0, np.int64)
    return heads[first], first


def _shorter(names: np.ndarray, depth: int) -> np.ndarray:
    """The parents' names of nodes with `depth` bytes of context."""
    return ((names >> _U(8) & _low(depth - 1)) << _U(8)) | (names & _U(255))


def _weigh(levels: list[tuple[np.ndarray, np.ndarray]], start: int = 0, entry: list[tuple] | None = None, ends: list[tuple] | None = None, down: bool = True) -> tuple[np.ndarray, list[list[tuple]], list[tuple], list[tuple]]:
    """Weigh the levels from `start` bytes of context on.

    Returns the log10 probabilities of the last level's grams, the nodes of each level and decision
    with their predictions, sums for the level above, and states for the one below. Only grams of
    contexts that are tree nodes are given, and a node's parent is a node.

    By decision, `entry` has (names, mixed, ahead) of the nodes above the first level, and `ends`
    (names, log Pw, zeros, ones) summed over the children of the last level's nodes; the two lists
    returned have the same forms. Each of a byte's eight decisions has trees of its own, so they are
    weighed one after another; sorted grams keep a decision's nodes together.
    """
    last = len(levels) - 1
    found = np.zeros(len(levels[last][0]))
    nodes: list[list[tuple]] = [[] for _ in levels]
    sums, states = [], []
    for k in range(8):
        names, zeros, ones, firsts = [], [], [], []
        for keys, n in levels:
            heads, first = _nodes(keys, k)
            bit = ((keys >> _U(7 - k)) & _U(1)) == 1
            both = np.add.reduceat(n.astype(float), first) if len(keys) else np.zeros(0)
            up = np.add.reduceat(np.where(bit, n, 0).astype(float), first) if len(keys) else np.zeros(0)
            names.append(heads)
            firsts.append(first)
            ones.append(up)
            zeros.append(both - up)
        above = [_shorter(names[i], start + i) if start + i else names[i] for i in range(last + 1)]
        parent = [np.zeros(0, np.int64)] + [_find(names[i - 1], above[i]) for i in range(1, last + 1)]
        stay: list[np.ndarray | None] = [None] * (last + 1)
        tail: list[np.ndarray] = [np.zeros(0)] * (last + 1)
        below = np.zeros(0)
        for i in range(last, -1, -1):
            own, size = log_kt(zeros[i], ones[i]), len(names[i])
            if i < last:
                children = [np.bincount(parent[i + 1], v, size) for v in (below, zeros[i + 1], ones[i + 1])]
            elif ends is not None:
                at = _find(names[i], ends[k][0])
                children = [np.bincount(at, v, size) for v in ends[k][1:]]
            else:
                below = own
                continue
            z, o = zeros[i] - children[1], ones[i] - children[2]
            below = np.logaddexp(own, children[0] + log_kt(z, o)) - np.log(2)
            stay[i] = np.exp(own - np.log(2) - below)
            tail[i] = np.where(z + o > 0, (o + 0.5) / (z + o + 1), np.nan)
        if start:
            parents, back = np.unique(above[0], return_inverse=True)
            sums.append((parents, *(np.bincount(back, v, len(parents)) for v in (below, zeros[0], ones[0]))))
        if not down:
            continue
        if entry is None:
            mixed, ahead = np.zeros(len(names[0])), np.ones(len(names[0]))
        else:
            at = _find(entry[k][0], above[0])
            mixed, ahead = entry[k][1][at], entry[k][2][at]
        for i in range(last + 1):
            own = (ones[i] + 0.5) / (zeros[i] + ones[i] + 1)
            p = mixed + ahead * (own if stay[i] is None else np.where(np.isnan(tail[i]), own, stay[i] * own + (1 - stay[i]) * tail[i]))
            nodes[i].append((names[i], p))
            if i == last:
                keys = levels[i][0]
                each = np.repeat(p, np.diff(np.append(firsts[i], len(keys))))
                found += np.log10(np.where(((keys >> _U(7 - k)) & _U(1)) == 1, each, 1 - each))
            if stay[i] is not None:
                mixed, ahead = mixed + ahead * stay[i] * own, ahead * (1 - stay[i])
            if i < last:
                mixed, ahead = mixed[parent[i + 1]], ahead[parent[i + 1]]
        states.append((names[last], mixed, ahead))
    return found, nodes, sums, states


def levels_of(keys: np.ndarray, n: np.ndarray, start: int, stop: int, least: int = LEAST) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams with `start` to `stop` bytes of context, and their counts, for contexts found `least` times."""
    keys, n = keys[n > 0], n[n > 0]
    levels = []
    for d in range(stop, start - 1, -1):
        keys, n = _merged([(keys & _low(d + 1), n), (keys[:0], n[:0])]) if len(keys) else (keys, n)
        mine = np.ones(len(keys), bool)
        if d and len(keys):
            _, first = _nodes(keys, 0)
            mine = np.repeat(np.add.reduceat(n, first) >= least, np.diff(np.append(first, len(keys))))
        levels.append((keys[mine], n[mine]))
    return levels[::-1]


def weighed(levels: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of whole trees: levels[d] has sorted grams (context of d bytes, byte) and counts."""
    found, nodes, _, _ = _weigh(levels)
    return Model(len(levels) - 1, (levels[-1][0], found), nodes)


def fit(texts: list[bytes | None], depth: int = DEPTH, least: int = LEAST) -> Model:
    """The whole trees of a few texts at once; `score` never gathers them like this, tests hold it against them."""
    grams, n = np.unique(Texts(texts).grams(depth), return_counts=True)
    return weighed(levels_of(grams, n, 0, depth, least))


# --- the trees in buckets -------------------------------------------------------------------


def _turned(keys: np.ndarray) -> np.ndarray:
    """Keys with the nearest predecessor as highest byte, so that sorted ones keep subtrees together."""
    return (keys >> _U(8)).byteswap() | keys & _U(255)


def _back(turned: np.ndarray) -> np.ndarray:
    return (turned & ~_U(255)).byteswap() << _U(8) | turned & _U(255)


def _bucket(turned: np.ndarray, split: int) -> np.ndarray:
    return ((turned >> _U(64 - 8 * split)) * _U(_POWER) >> _U(64 - BUCKET_BITS)).astype(np.uint8)


def _planes(values: np.ndarray) -> bytes:
    from zstandard import ZstdCompressor

    return ZstdCompressor(level=3).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def _values(packed: bytes, kind: type) -> np.ndarray:
    from zstandard import ZstdDecompressor

    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(ZstdDecompressor().decompress(packed), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _asked(texts: Texts, depth: int, split: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different grams of a chunk by bucket (turned, sorted in each), their counts, and where each bucket begins."""
    parts = []
    for at in range(0, len(texts.data), _BYTES):
        parts.append(np.unique(_turned(texts.grams(depth, at, at + _BYTES)), return_counts=True))
    keys, n = _merged(parts)
    bucket = _bucket(keys, split)
    order = np.argsort(bucket, kind="stable")
    return keys[order], n[order], np.searchsorted(bucket[order], np.arange((1 << BUCKET_BITS) + 1))


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words of a chunk, the end token with them, as `_asked` has its grams; a bucket holds a range of hashes."""
    keys, n = np.unique(np.append(texts.words()[0], np.full(len(texts.sizes), END_WORD, _U)), return_counts=True)
    return keys, n, np.searchsorted(keys >> _U(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1, dtype=_U))


def chunks(rows: DataFrame, training: Column, depth: int, split: int) -> DataFrame:
    """(chunk, bucket, keys, counts): texts by chunk (buckets below zero, spread by chunk), and what each chunk asks of each bucket.

    Buckets from `WORDS` on are those of words. A chunk's rows are either all training rows or none is, and then its grams count nothing.
    """
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def made(chunk: int, held: list[tuple], taught: bool) -> Iterator[pa.RecordBatch]:
        ids, bodies = zip(*held)
        table = pa.record_batch([pa.array(ids, pa.int64()), pa.array(bodies, pa.binary())], ["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(table)
        yield pa.record_batch([[chunk], [-1 - (chunk * _POWER >> 16) % (1 << 30)], [sink.getvalue().to_pybytes()], [None]], schema=schema)
        texts = Texts(list(bodies))
        for start, (keys, n, first) in ((0, _asked(texts, depth, split)), (WORDS, _words(texts))):
            found = np.flatnonzero(np.diff(first))
            spans = [slice(first[b], first[b + 1]) for b in found]
            counts = [_planes(n[s].astype(np.uint32)) for s in spans] if taught else [None] * len(spans)
            yield pa.record_batch([[chunk] * len(spans), (found + start).tolist(), [_planes(keys[s]) for s in spans], counts], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 18
        held: dict[bool, list[tuple]] = {True: [], False: []}
        sizes = {True: 0, False: 0}
        for batch in batches:
            for i, body, taught in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                taught = bool(taught)
                held[taught].append((i, body))
                sizes[taught] += len(body or b"")
                if sizes[taught] >= _CHUNK or len(held[taught]) >= _CHUNK_ROWS:
                    yield from made(chunk, held[taught], taught)
                    chunk, held[taught], sizes[taught] = chunk + 1, [], 0
        for taught, left in held.items():
            if left:
                yield from made(chunk, left, taught)
                chunk += 1

    return rows.select("doc_id", "text", training.alias("taught")).mapInArrow(run, "chunk long, bucket int, keys binary, counts binary")


def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All different grams (turned) that chunks ask of a bucket, and their counts in training chunks."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for packed, counts in zip(table["keys"], table["counts"]):
        keys = _values(packed.as_py(), _U)
        parts.append((keys, _values(counts.as_py(), np.uint32).astype(np.int64) if counts.is_valid else np.zeros(len(keys), np.int64)))
        if sum(len(k) for k, _ in parts) > max(_HELD, 2 * len(parts[0][0])):
            parts = [_merged(parts)]
    return _merged(parts)


def predicted(asked: DataFrame, depth: int, split: int, least: int = LEAST) -> tuple[DataFrame, int, int]:
    """(chunk, bucket, keys, counts): in `keys` what chunks ask for, in their order, and the numbers of training tokens and words.

    Grams get their log10 probabilities, words their counts.
    """
    spark = asked.sparkSession
    by_bucket = asked.where("bucket >= 0").groupBy("bucket")

    def up(table: pa.Table) -> pa.Table:
        turned, n = _gathered(table)
        if table["bucket"][0].as_py() >= WORDS:
            return pa.table([pa.array([9 << 56]), *(pa.array([float(v)]) for v in (0, n.sum(), (n > 0).sum()))], ["tag", "below", "zeros", "ones"])
        keys = _back(turned)
        sums = _weigh(levels_of(keys, n, split, depth, least), split, down=False)[2]
        grams, n = levels_of(keys, n, split - 1, split - 1, 1)[0]
        sums.append((grams, np.zeros(len(grams)), n.astype(float), np.zeros(len(grams))))
        tags = np.concatenate([s[0] | _U(k << 56) for k, s in enumerate(sums)]).view(np.int64)
        return pa.table([pa.array(tags), *(pa.array(np.concatenate([s[i] for s in sums])) for i in (1, 2, 3))], ["tag", "below", "zeros", "ones"])

    sums = by_bucket.applyInArrow(up, "tag long, below double, zeros double, ones double").groupBy("tag").agg(*(F.sum(c).alias(c) for c in ("below", "zeros", "ones"))).toArrow()
    tags = np.asarray(sums["tag"], np.int64).view(_U) if sums.num_rows else np.zeros(0, _U)
    columns = [np.asarray(sums[c], float) if sums.num_rows else np.zeros(0) for c in ("below", "zeros", "ones")]
    ends = [(tags[tags >> _U(56) == k] & _low(7), *(c[tags >> _U(56) == k] for c in columns)) for k in range(8)]
    grams = tags >> _U(56) == 8
    top = levels_of(tags[grams] & _low(7), columns[1][grams].astype(np.int64), 0, split - 1, least)
    seen, distinct = (int(c[tags >> _U(56) == 9].sum()) for c in columns[1:])
    _, nodes, _, states = _weigh(top, ends=ends)
    shared = spark.sparkContext.broadcast((nodes, states))

    def down(table: pa.Table) -> pa.Table:
        above, entry = shared.value
        turned, n = _gathered(table)
        if table["bucket"][0].as_py() >= WORDS:
            values = n.astype(_U)
        else:
            keys = _back(turned)
            local = levels_of(keys, n, split, depth, least)
            found, below, _, _ = _weigh(local, split, entry)
            model = Model(depth, (local[-1][0], found), above + below)
            values = np.concatenate([model.log_p(keys[at : at + _BYTES]) for at in range(0, len(keys), _BYTES)]).astype(np.float32)
        out = [_planes(values[np.searchsorted(turned, _values(packed.as_py(), _U))]) for packed in table["keys"]]
        return pa.table([table["chunk"], table["bucket"], pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], ["chunk", "bucket", "keys", "counts"])

    return by_bucket.applyInArrow(down, "chunk long, bucket int, keys binary, counts binary"), seen, distinct


# --- scoring --------------------------------------------------------------------------------


def score(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every row.

    Rows for which `training` (over doc_id) holds teach the model and the base.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = min(SPLIT, depth)
    asked = bucketed(chunks(rows, F.coalesce(training, F.lit(False)), depth, split), "bucket")
    answers, seen, distinct = predicted(asked, depth, split, least)
    divisor = float(np.log10(seen + distinct + 1))

    def run(table: pa.Table) -> pa.Table:
        own = table.take(pa.array(np.argsort(np.asarray(table["bucket"]))))
        at = np.asarray(own["bucket"])
        batch = pa.ipc.open_stream(own["keys"][0].as_py()).read_all().combine_chunks()
        texts = Texts(batch["text"].to_pylist())
        first = int(np.searchsorted(at, WORDS))
        scores = _sums(texts, np.concatenate([_values(v.as_py(), np.float32) for v in own["keys"][1:first]]), depth, split)
        counts = np.concatenate([_values(v.as_py(), _U) for v in own["keys"][first:]]).astype(float)
        n = len(texts.sizes)
        words, owner = texts.words()
        _, back = np.unique(np.append(words, _U(END_WORD)), return_inverse=True)
        log, met = np.log10(counts + 1)[back], (counts > 0)[back]
        n_tokens = np.bincount(owner, minlength=n) + 1
        base = np.bincount(owner, log[:-1], n) + log[-1] - n_tokens * divisor
        n_known = np.bincount(owner, met[:-1], n).astype(np.int64) + int(met[-1])
        columns = [n_tokens, n_known, np.full(n, seen), base, scores, texts.sizes]
        return pa.table([batch["doc_id"], *(pa.array(c) for c in columns)], names)

    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    whole = answers.unionByName(asked.where("bucket < 0")).groupBy("chunk")
    return whole.applyInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def _scores(trees: Model, texts: Texts) -> np.ndarray:
    """log10 probability of each text; keys are made and looked up some bytes at a time."""
    out = np.zeros(len(texts.sizes))
    for at in range(0, len(texts.data), _BYTES):
        stop = min(at + _BYTES, len(texts.data))
        log_p = trees.log_p(texts.grams(trees.depth, at, stop))
        first = int(np.searchsorted(texts.ends, at))
        heads = np.maximum(texts.starts[first : int(np.searchsorted(texts.starts, stop))] - at, 0)
        out[first : first + len(heads)] += np.add.reduceat(log_p, heads)
    return out


def _sums(texts: Texts, values: np.ndarray, depth: int, split: int) -> np.ndarray:
    """log10 probability of each text, from the predictions of a chunk's different grams by bucket."""
    keys, _, _ = _asked(texts, depth, split)
    order = np.argsort(keys)
    keys, values = keys[order], values[order].astype(float)
    out = np.zeros(len(texts.sizes))
    for at in range(0, len(texts.data), _BYTES):
        stop = min(at + _BYTES, len(texts.data))
        mine, back = np.unique(_turned(texts.grams(depth, at, stop)), return_inverse=True)
        log_p = values[np.searchsorted(keys, mine)][back]
        first = int(np.searchsorted(texts.ends, at))
        heads = np.maximum(texts.starts[first : int(np.searchsorted(texts.starts, stop))] - at, 0)
        out[first : first + len(heads)] += np.add.reduceat(log_p, heads)
    return out
