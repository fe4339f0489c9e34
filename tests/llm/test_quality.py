import zlib

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import quality, queries


def test_held_out_accuracy(spark, sf_dir, duck):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    got = queries.op7_quality(spark, sf).toPandas()
    truth = duck.sql(f"select doc_id, quality from '{sf}/labels.parquet'").df().merge(got, on="doc_id")
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    out = truth[truth["held_out"]]
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_attention_finds_the_bad_passage():
    """Bags of good passages, some with one bad passage: attention must go to it."""
    rng = np.random.default_rng(1)
    good = lambda: rng.choice(list(b"abcdefgh    "), quality.WINDOW).astype(np.uint8)
    bad = lambda: rng.choice(list(b"$#*%A"), quality.WINDOW).astype(np.uint8)
    bags, y = [], []
    for k in range(120):
        bag = [good() for _ in range(int(rng.integers(3, 8)))]
        if k % 2:
            bag[int(rng.integers(len(bag)))] = bad()
        bags.append(quality.encode(np.array(bag)))
        y.append(1 - k % 2)
    model = quality.train(np.concatenate(bags), np.array([len(b) for b in bags]), np.array(y, np.float32))
    bag = np.array([good(), good(), bad(), good()])
    attention, evidence = model.passages(quality.encode(bag))
    assert attention.argmax() == 2 and evidence[2] < 0
    text = bag.tobytes()
    assert model.score([text])[0] < 0.3 < model.score([bag[:2].tobytes()])[0]


def test_blocks_of_windows_do_not_matter(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(32, 127, int(n)).astype(np.uint8)) for n in (0, 5, 700, 20_000)] + [None]
    model = quality.train(np.concatenate([quality.encode(quality.windows_of([t])[0]) for t in texts[:4]]), quality.windows_of(texts[:4])[1], np.array([0, 1, 0, 1], np.float32), epochs=5)
    whole = model.score(texts)
    monkeypatch.setattr(quality, "_BLOCK", 3)
    assert np.allclose(model.score(texts), whole) and whole[0] == whole[4]


def test_odd_rows(odd_docs, no_docs, labels):
    odd = labels.sparkSession.createDataFrame([(1, 1, None), (6, 0, None), (7, 1, None), (8, None, None), (None, 1, 1), (5, 0, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, odd, F.lit(True))
    rows = quality.score(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    nothing = quality.fit(no_docs, odd, F.lit(True))
    assert quality.score(odd_docs, nothing).where("score <> 0.5").count() == 0
    assert quality.score(no_docs, model).count() == 0
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns


def _plain(weights, bag):
    """Score of one bag of scaled passages, written out passage by passage."""
    import math

    logits, values = [], []
    for x in bag:
        e = [math.tanh(sum(a * b for a, b in zip(x, column)) + bias) for column, bias in zip(weights["W"].T, weights["b"])]
        gate = [math.tanh(sum(a * b for a, b in zip(e, v))) / (1 + math.exp(-sum(a * b for a, b in zip(e, u)))) for v, u in zip(weights["V"].T, weights["U"].T)]
        logits.append(sum(a * b for a, b in zip(gate, weights["a"])))
        values.append(sum(a * b for a, b in zip(e, weights["c"])))
    share = [math.exp(s - max(logits)) for s in logits]
    return 1 / (1 + math.exp(-(sum(s * v for s, v in zip(share, values)) / sum(share) + float(weights["d"]))))


def test_scores_and_gradients_against_brute_force():
    """Scores against a passage-by-passage reading; gradients against differences of the loss, whole and in blocks."""
    rng = np.random.default_rng(6)
    shapes = {"W": (quality.FEATURES, quality.HIDDEN), "b": quality.HIDDEN, "V": (quality.HIDDEN, quality.GATE), "U": (quality.HIDDEN, quality.GATE), "a": quality.GATE, "c": quality.HIDDEN, "d": ()}
    w = {k: rng.normal(0, 0.3, s) for k, s in shapes.items()}
    counts, y = np.array([3, 1, 5]), np.array([1.0, 0.0, 1.0])
    x = rng.normal(0, 1, (9, quality.FEATURES))
    loss, grad = quality.gradient(w, x, counts, y, 3)
    for k, at in (("W", (4, 2)), ("b", (3,)), ("V", (5, 1)), ("U", (0, 3)), ("a", (2,)), ("c", (7,)), ("d", ())):
        step = {n: v.copy() for n, v in w.items()}
        step[k][at] += 1e-6
        assert np.isclose((quality.gradient(step, x, counts, y, 3)[0] - loss) / 1e-6, grad[k][at], atol=1e-5)
    blocks = list(quality._bag_blocks(counts, 4))
    assert [b for b, _ in blocks] == [slice(0, 2), slice(2, 3)] and [r for _, r in blocks] == [slice(0, 4), slice(4, 9)]
    summed = sum(quality.gradient(w, x[r], counts[b], y[b], 3)[1]["W"] for b, r in blocks)
    assert np.allclose(summed, grad["W"])
    texts = [bytes(rng.integers(32, 127, n).astype(np.uint8)) for n in (100, 1500, 40_000)]
    model = quality.Model(w | {"mean": np.zeros(quality.FEATURES), "std": np.ones(quality.FEATURES)})
    for text, s in zip(texts, model.score(texts)):
        assert np.isclose(s, _plain(w, quality.encode(quality.windows_of([text])[0])))
