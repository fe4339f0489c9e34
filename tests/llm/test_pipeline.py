"""The pipeline's stages against what they are made of, applied one after another by hand."""

import corpus_pipeline
from pyspark.sql import functions as F

from orrery.llm import packing, quality, toxicity
from orrery.llm.common import remainder


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "packing"]


def test_run_against_separate_decisions(spark, sf_dir, docs, labels):
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r["doc_id"], []).append(r)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    grammar = toxicity.fit(docs, labels, F.coalesce(remainder("__id", 3) != 1, F.lit(False)))
    clean = {i for i, t in texts.items() if grammar.score(t)[0] < 0.7}
    kept = docs.where(F.col("doc_id").isin(list(clean)))
    model = quality.fit(kept, labels, F.coalesce(remainder("__id", 5) != 0, F.lit(False)))
    order = sorted(clean)
    good = {i for i, s in zip(order, model.score([texts[i].encode() for i in order])) if s >= 0.3}
    from test_simhash import plain_survivors

    # the stage's contract: five words and a similarity of 0.8, besides fingerprints within two bits
    assert set(got) == plain_survivors({i: texts[i] for i in good})
    for i, pieces in got.items():
        assert sum(p["length"] for p in pieces) == len(texts[i].encode().split()) + 1


def test_stages_keep_columns(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(60), sf_dir).columns == docs.columns


def test_empty(spark, no_docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert packing.CAPACITY > 0
