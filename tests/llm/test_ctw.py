import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import ctw, queries


def kt(a, b):
    """Krichevsky-Trofimov probability, one symbol after another."""
    p, za, zb = 1.0, 0, 0
    for _ in range(a):
        p *= (za + 0.5) / (za + zb + 1)
        za += 1
    for _ in range(b):
        p *= (zb + 0.5) / (za + zb + 1)
        zb += 1
    return p


def test_closed_form():
    for a, b in [(0, 0), (1, 0), (3, 5), (40, 2)]:
        assert math.isclose(float(ctw.log_kt(a, b)), math.log(kt(a, b)), abs_tol=1e-9)


def plain_trees(bodies, depth, least):
    """Predictions by recursion over dictionaries: p(one | context, head of the byte)."""
    counts = [defaultdict(lambda: [0, 0]) for _ in range(depth + 1)]
    total = [Counter() for _ in range(depth + 1)]
    for body in bodies:
        data = b"\0" * depth + body
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                context = data[i - d : i]
                total[d][context] += 1
                for k in range(8):
                    counts[d][context, k, data[i] >> (8 - k)][data[i] >> (7 - k) & 1] += 1
    kept = [{c for c, n in t.items() if d == 0 or n >= least} for d, t in enumerate(total)]

    def children(c):
        return [x for x in kept[len(c) + 1] if x[1:] == c] if len(c) < depth else []

    def rest(c, k, h):
        z, o = counts[len(c)].get((c, k, h), (0, 0))
        for x in children(c):
            a, b = counts[len(x)].get((x, k, h), (0, 0))
            z, o = z - a, o - b
        return z, o

    def weighted(c, k, h):
        own = kt(*counts[len(c)].get((c, k, h), (0, 0)))
        if len(c) == depth:
            return own
        p = kt(*rest(c, k, h))
        for x in children(c):
            p *= weighted(x, k, h)
        return (own + p) / 2

    def one(c, k, h):
        """Mixed prediction of a decision that context c, a tree node, has met."""
        p, ahead = 0.0, 1.0
        for e in range(len(c) + 1):
            x = c[len(c) - e :]
            z, o = counts[e][x, k, h]
            own = (o + 0.5) / (z + o + 1)
            if e == depth:
                return p + ahead * own
            stay = kt(z, o) / 2 / weighted(x, k, h)
            if e < len(c):
                p, ahead = p + ahead * stay * own, ahead * (1 - stay)
                continue
            z, o = rest(x, k, h)
            return p + ahead * (own if z + o == 0 else stay * own + (1 - stay) * (o + 0.5) / (z + o + 1))

    def predict(c, b):
        """Each decision at the deepest node that has met it; even if none has."""
        p = 1.0
        for k in range(8):
            head = b >> (8 - k)
            met = [c[len(c) - d :] for d in range(len(c) + 1) if c[len(c) - d :] in kept[d] and (c[len(c) - d :], k, head) in counts[d]]
            q = one(met[-1], k, head) if met else 0.5
            p *= q if b >> (7 - k) & 1 else 1 - q
        return p

    def log10(body):
        data = b"\0" * depth + body
        return sum(math.log10(predict(data[i - depth : i], data[i])) for i in range(depth, len(data)))

    return log10


TEXTS = ["the cat sat", "the hat", "a cat and a hat", "the cat sat on the mat", "that cat", ""] * 2


def test_words():
    texts = ctw.Texts([b" The  cat\tTHE ", None, b"", b"the \xc3\x89", b"cat"])
    assert bytes(texts.data) == b"the cat the\xff\xff\xffthe \xc3\x89\xffcat\xff"
    h, owner = texts.words()
    assert owner.tolist() == [0, 0, 0, 3, 3, 4]
    assert h[0] == h[2] == h[3] and h[1] == h[5] and len(set(h.tolist())) == 3


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t, "x") for i, t in enumerate([*TEXTS, "the unseen zebra", "Cat  SAT\ton"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return rows, {r["doc_id"]: r for r in ctw.score(docs, F.col("doc_id") < len(TEXTS), depth=3).collect()}


def body_of(text):
    return b" ".join(text.encode().lower().split()) + b"\xff"


def test_against_plain_trees(scored):
    rows, got = scored
    log10 = plain_trees([body_of(t) for t in TEXTS], 3, 2)
    for i, t, _ in rows:
        assert got[i]["score"] == pytest.approx(log10(body_of(t)), rel=1e-4, abs=1e-4)
        assert got[i]["n_bytes"] == len(body_of(t))


def test_probabilities_sum_to_one():
    model = ctw.fit([t.encode() for t in TEXTS], 3)
    for context in (b"the", b"zzz", b"\0\0\0", b"at "):
        keys = np.array([(context[2] << 8 | context[1] << 16 | context[0] << 24) | b for b in range(256)], np.uint64)
        assert (10 ** model.log_p(keys)).sum() == pytest.approx(1, abs=1e-5)


def test_base_against_brute_force(spark, sf_dir, texts):
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), None]
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not out[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in queries.op10_context_tree(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        words = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-6)
    held = [r for r in got.values() if r["held_out"]]
    assert 1 < sum(r["bits_per_byte"] for r in held) / len(held) < 4


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    body = bytes(rng.choice(list(b"ab c"), 5000).tolist())
    texts = ctw.Texts([body[:10], body, b"", None, body[:50]])
    u, n = np.unique(texts.grams(3), return_counts=True)
    levels = [tuple(np.unique(u & ctw._low(d + 1), return_inverse=True)) for d in range(4)]
    levels = [(g, np.bincount(back, n)) for g, back in levels]
    model = ctw.weighed(levels)
    whole, words = ctw._scores(model, texts), texts.words()
    monkeypatch.setattr(ctw, "_BYTES", 776)
    assert ctw._scores(model, texts) == pytest.approx(whole)
    assert all((a == b).all() for a, b in zip(texts.words(), words))


def test_odd_rows(odd_docs, no_docs):
    rows = ctw.score(odd_docs, F.lit(True)).collect()
    assert len(rows) == odd_docs.count()
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4, 5)} == {1}
    assert all(r["score"] < 0 for r in rows)
    assert ctw.score(no_docs, F.lit(True)).count() == 0
    untrained = ctw.score(odd_docs, F.lit(False)).where("doc_id = 8").first()
    assert untrained["score"] == pytest.approx(-4 * 8 * math.log10(2)) and untrained["train_tokens"] == 0


def test_every_context_met_twice_is_a_node(spark):
    """A context's own prediction does not depend on how much other text there is."""
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400)]
    bodies = ["qzxjkv wyqzxp"] * 2 + [" ".join(rng.choice(words, 800)) for _ in range(130)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(bodies)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(docs, F.lit(True)).collect()}
    model = ctw.fit([t.encode() for t in bodies])
    whole = ctw._scores(model, ctw.Texts([t.encode() for t in bodies]))
    assert [got[i] for i in range(len(bodies))] == pytest.approx(whole, rel=1e-5)
    assert np.uint64(int.from_bytes(b"qzxjkv", "big")) in model.nodes[6][0][0] >> np.uint64(8)
