import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueloom.llm import ball_tree as bt


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, dim int, score string")


def brute(rows, k):
    good = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard,leaf,spread", [(8192, 128, 1.0), (50, 8, 1.0), (40, 4, 0.01)])
def test_same_as_all_products(spark, monkeypatch, shard, leaf, spread):
    monkeypatch.setattr(bt, "SHARD_ROWS", shard)
    monkeypatch.setattr(bt, "LEAF_ROWS", leaf)
    monkeypatch.setattr(bt, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(leaf)
    centres = rng.normal(size=(5, 6))
    rows = [(i, (centres[i % 5] + spread * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(400)]
    got = sorted(tuple(r) for r in bt.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)


def test_odd_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(0, 60)] + [
        (100, None), (120, [1.0, None, 2.0]), (140, [float("nan"), 1.0, 1.0]), (160, [float("inf"), 0.0, 0.0]), (None, same),
        (180, []), (200, [1.0, 2.0]), (201, [3.0, -1.0]), (220, [1e15, -1e15, 3.0]),
    ]
    got = sorted(tuple(r) for r in bt.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, 20).collect())
    assert [r for r in got if r[0] < 220] == [r for r in brute(rows, 20) if r[0] < 220]


def test_pruning_leaves_balls_out():
    rng = np.random.default_rng(2)
    vectors = np.concatenate([rng.integers(-3, 4, (500, 4)), 1000 + rng.integers(-3, 4, (500, 4))])
    tree = bt.build_tree(np.arange(1000), vectors)
    for node in range(len(tree["lo"])):
        inside = tree["vectors"][tree["lo"][node]:tree["hi"][node]]
        assert (np.sqrt(((inside - tree["centre"][node]) ** 2).sum(axis=1)) <= tree["radius"][node]).all()
    kth = np.full(1, 3_000_000.0)
    q, d, s = bt.search(tree, np.array([5000]), np.array([[1000, 1000, 1000, 1000]]), kth, 10)
    assert len(q) == 10 and s.min() > 3_900_000 and kth[0] == s.min()


def test_no_queries_and_empty_table(spark):
    assert bt.top_k(table(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []
    assert bt.top_k(table(spark, []), F.col("vec_id") % 20 == 0).collect() == []
