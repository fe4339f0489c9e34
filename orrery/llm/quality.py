"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages, its 512-byte windows (every window of the whole text). A passage
is encoded from its bytes: shares of character classes, a hashed histogram of byte pairs, and how
many different byte groups it holds. A hidden layer maps the encoding to an embedding e; gated
attention a = softmax(w . (tanh(V e) * sigmoid(U e))) weighs the passages, and the label is read
from the weighted passage representation sum(a e). All weights are learned together from document
labels alone.

Learning reads at most `MAX_LABELS` labelled rows (the smallest hashes of their ids) and every
passage of each, in blocks of bags whose gradients are added up; scoring reads every passage of
every text.

Null and empty texts are one empty passage. Labels that are null or contradict each other for one
id are left out. Without labels of both kinds every row scores the share of the label seen (0.5 if
none). Only id and text columns are read; repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled

MAX_LABELS = 6000
WINDOW = 512
CLASSES, PAIRS, GROUPS = 16, 64, 1024
FEATURES = CLASSES + PAIRS + 2
HIDDEN, GATE = 24, 12
_BLOCK = 4096


def _class_table() -> np.ndarray:
    """Class of each byte: padding, controls, digits, letters by case, punctuation by kind."""
    kinds = ["\0", "\t\r\v\f", "\n", " ", "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".", ",;:", "!", "?", "*#$%&", "|", "\"'()[]{}<>", "-_/\\=+@~^`"]
    table = np.full(256, len(kinds), np.uint8)
    for k, chars in enumerate(kinds):
        table[np.frombuffer(chars.encode(), np.uint8)] = k
    return table


_TABLE = _class_table()


def encode(windows: np.ndarray) -> np.ndarray:
    """Encodings (P, FEATURES) of windows (P, WINDOW) of bytes padded with zeros."""
    n = len(windows)
    row = np.arange(n, dtype=np.int32)[:, None]
    size = np.maximum((windows != 0).sum(1), 1).astype(np.float32)[:, None]
    classes = np.bincount((_TABLE[windows] + row * CLASSES).ravel(), minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    classes[:, 0] = 0
    wide = windows.astype(np.uint16)
    pair = (wide[:, :-1] * np.uint16(251) + wide[:, 1:]) * np.uint16(40503)
    both = windows[:, 1:] != 0
    pairs = np.bincount(((pair >> 10) + row * (PAIRS + 1) + np.where(both, 0, PAIRS - (pair >> 10)).astype(np.int32)).ravel(), minlength=n * (PAIRS + 1))
    pairs = pairs.reshape(n, PAIRS + 1)[:, :PAIRS].astype(np.float32)
    group = (pair[:, :-2] * np.uint16(31) + pair[:, 2:]) * np.uint16(40503) >> 6
    seen = np.zeros((n, GROUPS), bool)
    seen[row, group] = True
    different = seen.sum(1)[:, None].astype(np.float32)
    return np.hstack([np.sqrt(classes / size), np.sqrt(pairs / size), different / size, size / WINDOW])


def windows_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, and the number of windows of each."""
    counts = np.array([max(1, -(-len(t or b"") // WINDOW)) for t in texts], np.int64)
    body = b"".join((t or b"").ljust(int(c) * WINDOW, b"\0") for t, c in zip(texts, counts))
    return np.frombuffer(body, np.uint8).reshape(-1, WINDOW), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _softmax(s: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), counts))
    return e / np.repeat(np.add.reduceat(e, starts), counts)


@dataclass
class Model:
    weights: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention logit and label evidence of each encoded passage."""
        w = self.weights
        e = np.tanh(((x - w["mean"]) / w["std"]) @ w["W"] + w["b"])
        return (np.tanh(e @ w["V"]) * _sigmoid(e @ w["U"])) @ w["a"], e @ w["c"]

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if "constant" in self.weights:
            return np.full(len(texts), float(self.weights["constant"]))
        out = np.zeros(len(texts))
        start = 0
        while start < len(texts):  # some texts at a time, so that windows take bounded memory beside the batch
            end, total = start, 0
            while end < len(texts) and (end == start or total < 8 * _BLOCK * WINDOW):
                total += len(texts[end] or b"")
                end += 1
            rows, counts = windows_of(texts[start:end])
            read = [self.passages(encode(rows[i : i + _BLOCK])) for i in range(0, len(rows), _BLOCK)]
            attention, evidence = (np.concatenate(v) for v in zip(*read))
            starts = np.cumsum(counts) - counts
            weight = _softmax(attention, starts, counts)
            out[start:end] = _sigmoid(np.add.reduceat(weight * evidence, starts) + self.weights["d"])
            start = end
        return out


def train(x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 250, rate: float = 0.02, ridge: float = 1e-4, seed: int = 7) -> Model:
    """Full-batch Adam on the log loss; x holds the bags' passages one after another."""
    rng = np.random.default_rng(seed)
    mean, std = x.mean(0), x.std(0) + 0.02
    x = ((x - mean) / std).astype(np.float32)
    w = {"W": rng.normal(0, 0.15, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(())}
    w = {k: np.asarray(v, np.float32) for k, v in w.items()}
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    parts = list(_bag_blocks(counts))
    for step in range(1, epochs + 1):
        grad = {k: np.zeros_like(p) for k, p in w.items()}
        for bags, rows in parts:
            for k, g in gradient(w, x[rows], counts[bags], y[bags], len(y))[1].items():
                grad[k] += g
        for k in w:
            q = grad[k] + ridge * w[k]
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.999 * v[k] + 0.001 * q * q
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(w | {"mean": mean.astype(np.float32), "std": std.astype(np.float32)})


def _bag_blocks(counts: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[slice, slice]]:
    """Ranges of bags of about `most` passages, one bag at least, and the ranges of their passages."""
    ends = np.cumsum(counts)
    a = start = 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(ends, start + most, "right")))
        yield slice(a, b), slice(start, int(ends[b - 1]))
        a, start = b, int(ends[b - 1])


def gradient(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray, total: int) -> tuple[float, dict[str, np.ndarray]]:
    """Log loss of some bags over `total`, and its gradient; x holds their scaled passages."""
    starts = np.cumsum(counts) - counts
    e = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(e @ w["V"]), _sigmoid(e @ w["U"])
    alpha = _softmax((t * g) @ w["a"], starts, counts)
    value = e @ w["c"]
    pooled = np.add.reduceat(alpha * value, starts)
    p = _sigmoid(pooled + w["d"])
    delta = (p - y) / total
    each = np.repeat(delta, counts)
    d_s = alpha * each * (value - np.repeat(pooled, counts))
    d_tg = d_s[:, None] * w["a"]
    d_t, d_g = d_tg * g * (1 - t * t), d_tg * t * g * (1 - g)
    d_e = (alpha * each)[:, None] * w["c"] + d_t @ w["V"].T + d_g @ w["U"].T
    d_h = d_e * (1 - e * e)
    loss = -float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()) / total
    return loss, {"W": x.T @ d_h, "b": d_h.sum(0), "V": e.T @ d_t, "U": e.T @ d_g, "a": (t * g).T @ d_s, "c": e.T @ (alpha * each), "d": delta.sum()}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", target: str = "quality", most: int = MAX_LABELS) -> Model:
    """Learn from the labelled rows for which `usable` (over __id) holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                rows, _ = windows_of([text])
                bags.append(b"".join(encode(rows[i : i + _BLOCK]).astype("<f4").tobytes() for i in range(0, len(rows), _BLOCK)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    sample = labelled(docs, labels, target, usable, id_col, text_col, most)
    rows = sample.mapInArrow(run, "doc_id long, label int, bag binary").toArrow().sort_by("doc_id")
    y = np.array(rows["label"].to_pylist(), np.float32)
    if len(y) == 0 or y.min() == y.max():
        return Model({"constant": np.float32(y.mean() if len(y) else 0.5)})
    bags = [np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in rows["bag"].to_pylist()]
    return train(np.concatenate(bags), np.array([len(b) for b in bags]), y)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(model.score(texts), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that score `threshold` or more, with all their columns, in one pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.score(batch.column(at).cast(pa.binary()).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
