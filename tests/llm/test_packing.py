import numpy as np
from pyspark.sql import functions as F

from orrery.llm import packing, queries


def brute(items, capacity):
    """Best fit by looking at every open bin for each item."""
    bins, out = [], []
    for length, source, cluster in items:
        pieces, start = [], 0
        while length - start > capacity:
            pieces.append((len(bins), 0, start, capacity))
            bins.append([0, source, cluster])
            start += capacity
        need = length - start
        fits = [(left, k) for k, (left, s, c) in enumerate(bins) if left > 0 and left >= need and not s & source and not c & cluster]
        if fits:
            left, k = min(fits)
            bins[k] = [left - need, bins[k][1] | source, bins[k][2] | cluster]
        else:
            left, k = capacity, len(bins)
            bins.append([capacity - need, source, cluster])
        pieces.append((k, capacity - left, start, need))
        out.append(pieces)
    return out


def test_tightest_compatible_bin():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(1, 80))
        items = [(int(rng.integers(0, 130)), 1 << int(rng.integers(0, 5)) if rng.random() < 0.8 else 0, 1 << int(rng.integers(0, 3)) if rng.random() < 0.3 else 0) for _ in range(n)]
        items.sort(key=lambda i: -i[0])
        assert packing.pack(items, 50) == brute(items, 50)


def held(rows, capacity, of):
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault((r["shard"], r["bin"]), []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_bin.values():
        pieces.sort(key=lambda r: (r["bin_offset"], r["length"]))
        assert sum(r["length"] for r in pieces) <= capacity
        assert all(a["bin_offset"] + a["length"] == b["bin_offset"] for a, b in zip(pieces, pieces[1:]))
        for k in range(2):
            keys = [of[r["doc_id"]][k] for r in pieces if of[r["doc_id"]][k] is not None]
            assert len(keys) == len(set(keys))
    return by_doc


def test_query(spark, sf_dir):
    rows = queries.op8_best_fit_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", packing.same_text().alias("c"), packing.words().alias("n")).collect()
    by_doc = held(rows, packing.CAPACITY, {d["doc_id"]: (d["source"], d["c"]) for d in docs})
    assert {d["doc_id"] for d in docs} == set(by_doc)
    for d in docs:
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])
        assert sum(p["length"] for p in pieces) == d["n"]
        assert [p["start"] for p in pieces] == [packing.CAPACITY * k for k in range(len(pieces))]


def test_shards_and_one_hot_source(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("source"), (F.col("id") % 90 + 1).alias("n"))
    rows = packing.best_fit(docs, F.col("n"), F.col("source"), F.col("n") % 7, capacity=128, shard_rows=500).collect()
    assert len({r["shard"] for r in rows}) == 6
    held(rows, 128, {d["doc_id"]: (d["source"], d["n"] % 7) for d in docs.collect()})
    assert len(rows) == 3000


def test_odd_rows(odd_docs, no_docs):
    args = (packing.words("text"), F.col("source"), packing.same_text("text"))
    rows = packing.best_fit(odd_docs, *args).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 6) == 40_001 + 1
    assert sum(r["piece"] == 0 for r in rows) == odd_docs.count()
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert packing.best_fit(no_docs, *args).count() == 0
    assert packing.best_fit(odd_docs, F.lit(None), F.lit(None), F.lit(None)).where("length > 0").count() == 0
