"""Toxicity from a weighted finite-state pattern grammar.

A text is cut into clauses at sentence marks and line ends, and its tokens are read as symbols
(insult, threat, target, negation, speech, quote, other). Five weighted transducers read them:

* insult   - writes 1 for a learned insult, whose own weight it scales;
* threat   - writes `THREAT` for a threat verb (fixed list);
* target   - remembers a second or third person reference, before or after; at the clause's end it
             raises what was matched, and threats without a target count nothing;
* negation - damps matches among the `NEGATION_SPAN` words behind a negation;
* reported - damps matches behind a speech verb or within quotation marks.

`compose` makes one automaton of them: its states are tuples of theirs, and the weights on its arcs
are products. A clause is scored by the path it takes through the automaton; a threat verb counts
once in a clause. Contractions are read by their parts (don't is a negation, you'll a target). What
a document gets is a logistic reading of its clause scores, with coefficients learned from labels.

The insult lexicon is learned: a word enters if labelled toxic texts hold it in several different
surroundings (so that copies of one text count once) and hardly any clean text holds it. Learning
reads a sample of at most `MAX_LABELS` labelled rows, those with the smallest hash of their id: a
bound of the model, not of what is scored. The lexicon has all words of the sample that qualify.

Null and empty texts have no clause and get the score of a text without matches. Labels that are
null or contradict each other for one id are left out of learning. With no usable label of either
kind every row scores 0. Repeated rows are scored each; only id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LABELS = 40_000
MIN_CONTEXTS = 3
MIN_LOG_ODDS = 3.0
NEGATION_SPAN = 3
NEGATED, REPORTED, AIMED = 0.3, 0.6, 1.25
THREAT = 1.5

# Fixed word lists of the grammar.
TARGETS = frozenset("you your yours yourself he she they him her them his their du dich dir ihr euch sie er tu te toi vous il elle ils elles usted ustedes tú ti él ella ellos ellas".split())
NEGATIONS = frozenset("not no never neither nor cannot nicht kein keine keinen nie niemals ne pas jamais aucun non nunca jamás ningún ninguna".split())
SPEECH = frozenset("said says wrote writes quoted called reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split())
THREATS = frozenset("kill hurt destroy burn stab shoot beat töten umbringen tuer frapper brûler matar golpear quemar".split())

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]|[\"«»„“”]")
_WORD = re.compile(r"[^\W\d_]+")
_ELIDED = {"n": "ne", "t": "te"}  # French words before an apostrophe

INSULT, THREATEN, TARGET, NEGATION, SAY, QUOTE, OTHER = SYMBOLS = ("insult", "threat", "target", "negation", "speech", "quote", "other")
_FIXED = {**{w: TARGET for w in TARGETS}, **{w: NEGATION for w in NEGATIONS}, **{w: SAY for w in SPEECH}, **{w: THREATEN for w in THREATS}, **{q: QUOTE for q in '"«»„“”'}}


@dataclass(frozen=True)
class Transducer:
    """States with arcs (state, symbol) -> (state, weight); `final` weighs a kind of match at the clause's end."""

    start: Hashable
    arcs: dict[tuple[Hashable, str], tuple[Hashable, float]]
    final: dict[tuple[Hashable, str], float] = field(default_factory=dict)

    def step(self, state: Hashable, symbol: str) -> tuple[Hashable, float]:
        """What is not named stays where it is, with weight 1."""
        return self.arcs.get((state, symbol), (state, 1.0))


def transducers() -> list[Transducer]:
    insult = Transducer(0, {(0, INSULT): (0, 1.0)})
    threat = Transducer(0, {(0, THREATEN): (0, THREAT)})
    target = Transducer("unaimed", {("unaimed", TARGET): ("aimed", 1.0)}, {("aimed", INSULT): AIMED, ("aimed", THREATEN): AIMED, ("unaimed", THREATEN): 0.0})
    damped = {(left, symbol): (left - 1, NEGATED if symbol in (INSULT, THREATEN) else 1.0) for left in range(1, NEGATION_SPAN + 1) for symbol in SYMBOLS}
    negation = Transducer(0, damped | {(left, NEGATION): (NEGATION_SPAN, 1.0) for left in range(NEGATION_SPAN + 1)})
    reported = Transducer(
        "plain",
        {("plain", SAY): ("reported", 1.0), ("plain", QUOTE): ("reported", 1.0), ("reported", QUOTE): ("plain", 1.0), **{("reported", m): ("reported", REPORTED) for m in (INSULT, THREATEN)}},
    )
    return [insult, threat, target, negation, reported]


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both transducers reading the same symbols: states are pairs, weights are products."""
    start = (a.start, b.start)
    arcs, final, left = {}, {}, [start]
    seen = {start}
    while left:
        state = left.pop()
        for symbol in SYMBOLS:
            (p, u), (q, v) = a.step(state[0], symbol), b.step(state[1], symbol)
            arcs[state, symbol] = ((p, q), u * v)
            if (p, q) not in seen:
                seen.add((p, q))
                left.append((p, q))
        for kind in (INSULT, THREATEN):
            final[state, kind] = a.final.get((state[0], kind), 1.0) * b.final.get((state[1], kind), 1.0)
    return Transducer(start, arcs, final)


def _numbered(t: Transducer) -> tuple[int, list[dict[str, tuple[int, float]]], list[tuple[float, float]]]:
    """A composed transducer by numbers of its states: start, arcs and final weights of each."""
    names = list(dict.fromkeys(state for state, _ in t.arcs))
    number = {state: k for k, state in enumerate(names)}
    arcs = [{symbol: (number[t.arcs[state, symbol][0]], t.arcs[state, symbol][1]) for symbol in SYMBOLS} for state in names]
    return number[t.start], arcs, [(t.final[state, INSULT], t.final[state, THREATEN]) for state in names]


GRAMMAR = reduce(compose, transducers())
_START, _ARCS, _FINAL = _numbered(GRAMMAR)


def tokens(text: str) -> Iterator[str]:
    """Lower-case words and marks; contractions by their parts, those of `not` as that word."""
    for token in _TOKEN.findall(text.lower()):
        if "'" not in token and "’" not in token:
            yield token
        elif token[-3:] in ("n't", "n’t"):
            yield "not"
        else:
            *first, last = re.split("['’]", token)
            yield from (_ELIDED.get(w, w) for w in first)
            yield last


def clauses(text: str, lexicon: dict[str, float]) -> list[tuple[float, int]]:
    """(score, matches) of each clause with a match."""
    out = []
    state, insults, matches = _START, 0.0, 0
    threats: dict[str, float] = {}
    for token in [*tokens(text), "."]:
        if token in ".!?;\n":
            if matches or threats:
                by_insult, by_threat = _FINAL[state]
                found = matches + (len(threats) if by_threat else 0)
                if found:
                    out.append((insults * by_insult + sum(threats.values()) * by_threat, found))
                insults, matches, threats = 0.0, 0, {}
            state = _START
            continue
        own = lexicon.get(token)
        symbol = INSULT if own is not None else _FIXED.get(token, OTHER)
        state, weight = _ARCS[state][symbol]
        if symbol is INSULT:
            insults, matches = insults + own * weight, matches + 1
        elif symbol is THREATEN:
            threats[token] = max(threats.get(token, 0.0), weight)
    return out


def features(text: str | None, lexicon: dict[str, float]) -> tuple[float, ...]:
    """Strongest clause, sum of clauses (damped), matched clauses per log length."""
    if not text:
        return (0.0, 0.0, 0.0)
    found = set(_WORD.findall(text.lower()))
    if found.isdisjoint(lexicon) and found.isdisjoint(THREATS):
        return (0.0, 0.0, 0.0)
    matched = clauses(text, lexicon)
    total = sum(s for s, _ in matched)
    return (max((s for s, _ in matched), default=0.0), float(np.log1p(total)), sum(n for _, n in matched) / (1 + np.log1p(len(text))))


@dataclass
class Grammar:
    lexicon: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [-30.0, 0.0, 0.0, 0.0])

    def score(self, text: str | None) -> tuple[float, float]:
        x = features(text, self.lexicon)
        z = self.coefficients[0] + sum(w * v for w, v in zip(self.coefficients[1:], x))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30)))), x[0]


def labelled(docs: DataFrame, labels: DataFrame, target: str, usable: Column, id_col: str, text_col: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` usable labelled ids, the smallest hashes first.

    The label side is bounded by `most` and broadcast, so the texts are never shuffled.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("__id"), F.col(target).cast("int").alias("__label"))
        .where("__id is not null and __label in (0, 1)")
        .where(usable)
        .groupBy("__id")
        .agg(F.min("__label").alias("__label"), F.max("__label").alias("__most"))
        .where("__label = __most")
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(most)
        .select("__id", "__label")
    )
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", F.col("__label").alias("label"))


def _evidence(sample: DataFrame) -> DataFrame:
    """(word, context, toxic, clean): toxic holders by surrounding words, and numbers of clean ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(clean), pa.string()), pa.array([0] * len(clean), pa.int64()), pa.array([0] * len(clean), pa.int64()), pa.array(list(clean.values()), pa.int64())], ["word", "context", "toxic", "clean"])

        for batch in batches:
            words, contexts = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = _WORD.findall((text or "").lower())
                if label:
                    seen = {(w, hash_of(a, b)) for a, w, b in zip(["", *tokens], tokens, [*tokens[1:], ""])}
                    words += [w for w, _ in seen]
                    contexts += [c for _, c in seen]
                else:
                    clean.update(set(tokens))
            if words:
                yield pa.record_batch([pa.array(words, pa.string()), pa.array(contexts, pa.int64()), pa.array([1] * len(words), pa.int64()), pa.array([0] * len(words), pa.int64())], ["word", "context", "toxic", "clean"])
            if len(clean) > 300_000:
                yield flushed()
                clean.clear()
        if clean:
            yield flushed()

    return sample.select("text", "label").mapInArrow(run, "word string, context long, toxic long, clean long")


def hash_of(a: str, b: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(f"{a} {b}".encode()) >> 1


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", target: str = "toxic", most: int = MAX_LABELS) -> Grammar:
    """Learn lexicon and coefficients from the labelled rows for which `usable` (over __id) holds."""
    sample = labelled(docs, labels, target, usable, id_col, text_col, most)
    counts = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Grammar()
    by_word = (
        _evidence(sample)
        .groupBy("word", "context")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("toxic"), F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("contexts"), F.sum("clean").alias("clean"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
    )
    odds = F.log((F.col("contexts") + 0.5) / (counts[1] + 1)) - F.log((F.col("clean") + 0.5) / (counts[0] + 1))
    enough = (F.col("clean") <= 0.02 * F.col("contexts")) | (odds >= MIN_LOG_ODDS + 2)
    chosen = by_word.withColumn("odds", odds).where((F.col("odds") >= MIN_LOG_ODDS) & enough).select("word", "odds", "contexts").orderBy("word").collect()
    lexicon = {r["word"]: float(min(r["odds"], 8.0) * min(1.0, r["contexts"] / 8)) for r in chosen}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([v[k] for v in x], pa.float64()) for k in range(3)] + [batch.column(1).cast(pa.int64())], ["a", "b", "c", "label"])

    seen = sample.select("text", "label").mapInArrow(run, "a double, b double, c double, label long")
    # equal feature rows are counted once, so what reaches the driver is small
    table = np.array([tuple(r) for r in seen.groupBy("a", "b", "c", "label").agg(F.count(F.lit(1))).collect()], float)
    return Grammar(lexicon, logistic(table[:, :3], table[:, 3], table[:, 4]))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> list[float]:
    """Intercept and weights of a ridge logistic regression over counted rows, by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1]) * np.array([0.01, *[1.0] * x.shape[1]])
    total = n.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (n * (p - y)) / total + penalty @ w
        hessian = (a * (n * p * (1 - p))[:, None]).T @ a / total + penalty
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, float(np.abs(step).max()) / 4)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, strongest): one row per input row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [grammar.score(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([m for _, m in found], pa.float64())], ["doc_id", "score", "strongest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, strongest double")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of `docs` scored under `threshold`, with all their columns, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [grammar.score(t)[0] < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(run, docs.schema)
