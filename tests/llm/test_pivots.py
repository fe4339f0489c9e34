import numpy as np
import pytest
from comparing import same
from pyspark.sql import functions as F

from orrery.llm import pivots, queries


def brute(rows, k=10):
    vectors = {i: np.floor(1024 * np.array(v, float)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    width = max((len(v) for v in vectors.values()), default=0)
    vectors = {i: np.pad(v, (0, width - len(v))) for i, v in vectors.items()}
    out = []
    for q in vectors:
        if q % 100 == 0:
            best = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def found(rows, spark, k=10):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in pivots.top_k(frame, F.col("vec_id") % 100 == 0, k).collect())


def test_against_sql(spark, sf_dir, duck):
    assert same(queries.op6_pivot_top_k(spark, sf_dir).toPandas(), duck.sql(queries.SQL["op6_pivot_top_k"]).df())


@pytest.mark.parametrize("kind", ["random", "clustered", "equal"])
def test_against_brute_force(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8))
    if kind == "clustered":
        x = rng.normal(size=(7, 8))[rng.integers(0, 7, 700)] * 3 + rng.normal(0, 0.05, (700, 8))
    if kind == "equal":
        x[100:500] = x[0]
    x = x.astype(np.float32)
    rows = [(int(i), [float(c) for c in v], 0) for i, v in enumerate(x)]
    assert found(rows, spark) == brute([(i, v) for i, v, _ in rows])


def test_bounds_save_work():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16)) * 4000
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 16)))
    search = pivots.Search(np.arange(5), x[:5], x[rng.integers(0, 4000, 16)], 10)
    search.add(np.arange(4000), x)
    assert search.evaluated < 0.5 * 5 * 4000


def test_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(100 * i, [float(np.float32(c)) for c in rng.normal(size=4)], 0) for i in range(50)]
    monkeypatch.setattr(pivots, "QUERY_BLOCK", 7)
    assert found(rows, spark, 3) == brute([(i, v) for i, v, _ in rows], 3)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, None), (2, [1.0, None], 2), (3, [float("nan"), 1.0], 3), (4, [float("inf"), 1.0], 1), (5, [], 1), (6, [0.5], 1), (None, [1.0, 1.0], 1), (7, [2.0, 2.0, 9.0], 1)]
    got = found(rows, spark)
    assert [(q, r, i) for q, r, i, _ in got] == [(0, 1, 7), (0, 2, 6), (0, 3, 5)]
    assert got[0][3] == 1024 * 2048 + 2048 * 2048
    assert found([], spark) == []
    assert found([(100, [1.0], 0)], spark) == []
