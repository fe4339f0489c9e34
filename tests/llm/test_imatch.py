import hashlib

import numpy as np

from orrery.llm import imatch, queries


def test_edits_against_brute_force(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in queries.op2_imatch(spark, sf_dir).collect()}
    ids = sorted(texts)
    terms = imatch.lexicon(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert set(got) == set(ids)
    for i, k in enumerate(ids):
        t, after = texts[k], texts[ids[(i + 1) % len(ids)]]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        row = got[k]
        assert row["n_chars"] == len(t) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (imatch.codes(x.encode(), terms) for x in (t, edited, after))
        assert row["fingerprint"] == imatch.written(own) and row["edited_fingerprint"] == imatch.written(other)
        assert row["near_edited"] == imatch.likeness(own, other) and row["near_next"] == imatch.likeness(own, following)
    mean = {c: np.mean([r[c] for r in got.values()]) for c in ("near_edited", "near_next")}
    assert mean["near_edited"] > mean["near_next"] + 0.3


def test_lexicon_is_the_band(spark, texts, docs):
    terms = imatch.lexicon(docs, min_share=0.02, max_share=0.1)
    df = {}
    for t in texts.values():
        for w in imatch._terms(t.encode()):
            df[w] = df.get(w, 0) + 1
    n = len(texts)
    inside = sorted(imatch._hashes([w for w, c in df.items() if max(2, 0.02 * n) <= c <= 0.1 * n]).tolist())
    assert terms.tolist() == inside


def test_likeness():
    a = imatch.codes(b"alpha beta gamma delta " * 3, np.zeros(0, np.uint64))
    assert imatch.likeness(a, a) == 1.0
    assert imatch.likeness(a, imatch.codes(b"entirely other words", np.zeros(0, np.uint64))) == 0.0
    assert (imatch.codes(b"beta alpha delta gamma", np.zeros(0, np.uint64)) == a).all()
    assert not imatch.codes(b"", np.zeros(0, np.uint64)).any() and not imatch.codes(None, np.zeros(0, np.uint64)).any()


def test_odd_rows(odd_docs, no_docs):
    terms = imatch.lexicon(odd_docs)
    rows = imatch.against_edits(odd_docs, terms).collect()
    assert len(rows) == odd_docs.count()
    zero = "0" * (imatch.SEEDS * imatch.LEVELS * 4)
    assert all((r["fingerprint"] == zero) == (r["doc_id"] in (3, 4, 5) or (r["doc_id"] is None and r["n_chars"] == 0)) for r in rows)
    equal = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}
    assert len(equal) == 1
    assert imatch.fingerprints(odd_docs, terms).count() == len(rows)
    assert imatch.against_edits(no_docs, imatch.lexicon(no_docs)).count() == 0


def test_one_document_follows_itself(spark):
    one = spark.createDataFrame([(5, "alpha beta gamma delta")], "doc_id long, text string")
    row = imatch.against_edits(one, imatch.lexicon(one)).collect()
    text = "alpha beta gamma delta"
    assert len(row) == 1 and row[0]["near_next"] == 1.0
    assert row[0]["edited_sha256"] == hashlib.sha256((text[: len(text) - 5] + text[:5]).encode()).hexdigest()
