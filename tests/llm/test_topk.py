import math
import random

import numpy as np
import pytest

from parchmint.llm import topk as K


def brute(rows, k=5):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in sorted({i: e for i, e in v if i % 50 == 0}.items()):
        scores = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in v if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("cell, block", [(16_384, 4096), (40, 2)])
def test_equals_brute_force(spark, cell, block):
    rng = random.Random(0)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.2))) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(60)]  # ties
    rows += [(401, None), (402, [None] * 8), (403, [math.nan] * 8), (404, [math.inf] * 8), (405, [0.5, -0.25]), (406, []), (77, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "2 AS score", "3 AS v")
    all_rows = K.quantized(df.repartition(3))
    got = K.top_k(all_rows.filter("vec_id % 50 = 0"), all_rows, cell_rows=cell, query_rows=block)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_blocks_are_pruned():
    rng = np.random.default_rng(0)
    c = np.concatenate([rng.integers(0, 3, (256 * 20, 8)), rng.integers(90, 99, (256, 8))])
    q, ids = rng.integers(50, 60, (10, 8)), np.arange(len(c))
    _, cand, _, scored = K.best_of_cell(np.full(10, -1), q, ids, c, 5)
    assert scored == 10 and (cand >= 256 * 20).all()


def test_large_components_stay_exact():
    c = np.array([[2**40, 1], [2**40, 2], [2**39, 3]])
    _, cand, score, _ = K.best_of_cell(np.array([9]), np.array([[2**20, 1]]), np.arange(3), c, 2)
    assert cand.tolist() == [1, 0] and score.tolist() == [2**60 + 2, 2**60 + 1]


def test_few_and_none(spark):
    one = K.quantized(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>"))
    assert K.top_k(one, one).collect() == [] and K.top_k(one.limit(0), one).collect() == []
