import math
from collections import Counter

import numpy as np
import pytest

from orrery.llm import queries, segmenter


@pytest.fixture(scope="module")
def tiny():
    pieces = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab"]
    score = np.array([0.0, -2.3, -1.7, -2.1, -1.2, -1.9, -2.6, -3.3])
    return segmenter.Vocabulary.of(pieces, score, np.array([False] + [True] * 7), [], 0)


def all_segmentations(text, vocabulary):
    """(pieces, log p) of every path of the lattice, by recursion."""
    names = {p: i for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.log_p[i])}

    def walk(rest):
        if not rest:
            yield (), 0.0
        for k in range(1, len(rest) + 1):
            if rest[:k] in names:
                for tail, p in walk(rest[k:]):
                    yield (names[rest[:k]], *tail), p + vocabulary.log_p[names[rest[:k]]]

    found = list(walk("▁" + text.replace(" ", "▁")))
    total = math.log(sum(math.exp(p) for _, p in found))
    return {ids: p - total for ids, p in found}


@pytest.mark.parametrize("text", ["abab", "ba ab", "a", "babab ab"])
def test_all_paths_with_their_probabilities(tiny, text):
    every = all_segmentations(text, tiny)
    got = segmenter.sample([text], [1], len(every) + 5, tiny)[0]
    assert len(got) == len(every)
    assert {tuple(ids.tolist()): round(p, 9) for ids, p, _, _ in got} == {k: round(v, 9) for k, v in every.items()}
    bounds = [g for _, _, g, _ in got]
    assert bounds == sorted(bounds, reverse=True)
    assert all(q == 0 for *_, q in got)  # all are certain to be in


def test_first_samples_follow_the_probabilities(tiny):
    every = all_segmentations("abab", tiny)
    n = 4000
    first = Counter(tuple(s[0][0].tolist()) for s in segmenter.sample(["abab"] * n, list(range(n)), 1, tiny))
    for ids, log_p in every.items():
        p = math.exp(log_p)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_two_samples_are_a_sample_without_replacement(tiny):
    every = all_segmentations("ab", tiny)
    p = {k: math.exp(v) for k, v in every.items()}
    n = 4000
    pairs = Counter()
    for a, b in segmenter.sample(["ab"] * n, list(range(n)), 2, tiny):
        x, y = tuple(a[0].tolist()), tuple(b[0].tolist())
        assert x != y
        pairs[x, y] += 1
    for (x, y), count in pairs.items():
        expected = p[x] * p[y] / (1 - p[x])
        assert abs(count / n - expected) < 5 * math.sqrt(expected / n) + 1e-3
    # inclusion scores weigh an unbiased estimate of the number of paths
    weights = [sum(math.exp(-q) for *_, q in s) for s in segmenter.sample(["abab"] * n, list(range(n)), 3, tiny)]
    assert abs(np.mean(weights) - len(all_segmentations("abab", tiny))) < 4 * np.std(weights) / math.sqrt(n)


def test_rows_are_seeded_by_key_alone(tiny):
    together = segmenter.sample(["abab", "ba ab", "abab"], [7, 8, 9], 2, tiny, seed=3)
    alone = segmenter.sample(["ba ab"], [8], 2, tiny, seed=3)
    assert [(s[0].tolist(), s[1:]) for s in together[1]] == [(s[0].tolist(), s[1:]) for s in alone[0]]


def test_query_round_trip(spark, sf_dir, texts):
    import hashlib

    rows = queries.op5_gumbel_segmentations(spark, sf_dir).collect()
    assert len(rows) == 2 * len(texts)
    assert all(hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() == r["decoded_sha256"] for r in rows)
    assert all(r["log_p"] < 1e-9 and r["log_inclusion"] <= 0 for r in rows)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], set()).add(r["ids_hash"])
    assert all(len(v) == 2 for v in by_doc.values())


def test_odd_rows(odd_docs, no_docs):
    vocabulary = segmenter.Vocabulary.load()
    coded = segmenter.encode(odd_docs, vocabulary)
    assert {r["doc_id"] for r in coded.where("size(ids) = 0").collect()} == {3, 4, None}
    spelled = segmenter.decode(coded, vocabulary)
    texts = {(r["doc_id"], r["text"] or "") for r in odd_docs.collect()}
    assert {(r["doc_id"], r["text"]) for r in spelled.collect()} == texts
    assert segmenter.encode(no_docs, vocabulary).count() == 0
    assert vocabulary.decode([vocabulary.bytes_[b] for b in "é".encode()]) == "é"


def test_long_units_do_not_underflow(tiny):
    """Past the reach of plain products the sums are kept as logarithms; both must agree with a direct sum."""
    text = "ab" * 400
    (ids, log_p, *_), _ = segmenter.sample([text], [3], 2, tiny)[0]
    body = "▁" + text
    names = {p: tiny.log_p[i] for i, p in enumerate(tiny.pieces) if np.isfinite(tiny.log_p[i])}
    forward = [0.0] + [-math.inf] * len(body)
    for end in range(1, len(body) + 1):
        forward[end] = np.logaddexp.reduce([forward[end - k] + names[body[end - k : end]] for k in range(1, 4) if end >= k and body[end - k : end] in names])
    assert "".join(tiny.pieces[i] for i in ids) == body
    assert log_p == pytest.approx(sum(tiny.log_p[i] for i in ids) - forward[-1], rel=1e-9)
