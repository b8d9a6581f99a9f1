"""Strassen products and hard negatives against plain loops."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cueloom.llm import hard_negatives as hn


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(1, 40), st.integers(0, 2**32), st.sampled_from([1, 2, 5, 16]))
def test_strassen(m, k, n, seed, leaf):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**63), 2**63 - 1, (m, k)), rng.integers(-(2**63), 2**63 - 1, (k, n))
    exact = a.astype(object) @ b.astype(object)
    wrapped = np.array([[(int(x) + 2**63) % 2**64 - 2**63 for x in row] for row in exact], np.int64)
    assert (hn.strassen(a, b, leaf) == wrapped).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.integers(-5, 5)), max_size=40), st.integers(0, 40), st.integers(1, 4))
def test_heaps_merge(rows, cut, k):
    def heap(part):
        return tuple(np.array([r[i] for r in part], np.int64) for i in range(3))

    got = hn.merged(hn.merged(hn.EMPTY, heap(rows[:cut]), k), hn.merged(hn.EMPTY, heap(rows[cut:]), k), k)
    want = []
    for slot in sorted({r[0] for r in rows}):
        want += sorted((r for r in rows if r[0] == slot), key=lambda r: (-r[2], r[1]))[:k]
    assert [tuple(int(x[i]) for x in got) for i in range(len(got[0]))] == want


def test_windows():
    for score in (*range(-30, 60), 10**18, 2**63 - 1, -(2**63)):
        lo, hi = hn._window(score, 50, 95)
        for n in {lo - 1, lo, hi, hi + 1, 0}:
            assert (lo <= n <= hi) == (50 * score <= 100 * n <= 95 * score)


def plain(rows, every):
    part = []
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) or abs(math.floor(256 * x)) >= 2**63 for x in v):
            continue
        part.append((i, str(label), [math.floor(256 * x) for x in v]))
    out = []
    chosen = {}
    for i, label, v in part:
        if i % every == 0:
            chosen[i] = max(chosen.get(i, ("", [])), (label, v))
    for i, (label, v) in chosen.items():
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in part if j != i and len(w) == len(v)]
        positives = sorted(s for s in scored if s[2] == label)[:5]
        others = sorted(s for s in scored if s[2] != label)
        for ps, p, _ in positives:
            fit = [(n, s) for s, n, _ in others if -50 * ps <= -100 * s <= -95 * ps][:3]
            out += [(i, p, rank, n, -ps, -s) for rank, (n, s) in enumerate(fit, 1)]
    return sorted(out)


CLASH = ("v", "dim", "bucket", "part", "block", "slice", "score", "rank", "found", "anchors", "place")


def table(spark, rows):
    shape = "vec_id long, label int, embedding array<double>, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *["x"] * len(CLASH)) for r in rows], shape)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def vectors(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d))
    label = rng.integers(0, labels, n)
    return [(i, int(l), list(map(float, np.round(centres[l] + rng.normal(size=d) * 0.9, 2)))) for i, l in enumerate(label)]


@pytest.mark.parametrize("small", [False, True])
def test_against_loops(spark, monkeypatch, small):
    """Also with blocks of a few rows, two buckets and heaps handed on at once."""
    if small:
        for name, value in (("ANCHOR_ROWS", 7), ("CANDIDATE_ROWS", 16), ("BUCKETS", 2), ("SLICES", 3), ("HELD", 1), ("LEAF", 2)):
            monkeypatch.setattr(hn, name, value)
    rows = vectors(260, 6, 3) + [(1000 + i, i % 3, [0.5, 0.25, 0.0, 0.0, -0.5, 1.0]) for i in range(30)]
    want = plain(rows, 10)
    assert len(want) > 100 and got(hn.mine(table(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(40, 3, 5, 2) + [
        (None, 1, [1.0, 1.0, 1.0]), (100, None, [1.0, 1.0, 1.0]), (101, 1, None), (102, 1, []), (103, 1, [1.0, None, 1.0]),
        (104, 1, [nan, 1.0, 1.0]), (105, 1, [inf, 1.0, 1.0]), (106, 1, [1e300, 1.0, 1.0]), (110, 1, [2.0, 1.0]), (111, 1, [1.5, 1.0]),
        (112, 0, [1.2, 0.7]), (120, 0, [0.0, 0.0, 0.0]), (121, 0, [0.0, 0.0, 0.0]), (130, 9, [1.0, 2.0, 3.0]),
        (200, 1, [1e6, -1e6, 3.0]), (200, 1, [1e6, -1e6, 3.0]), (203, 1, [1e6, 0.0, 3.0]), (204, 0, [8e5, 0.0, 3.0]),
    ]
    want = plain(rows, 10)
    assert want and got(hn.mine(table(spark, rows), F.col("vec_id") % 10 == 0)) == want


def test_empty(spark):
    assert got(hn.mine(table(spark, []), F.col("vec_id") % 10 == 0)) == []
    assert got(hn.mine(table(spark, vectors(20, 3, 1)), F.lit(False))) == []


@pytest.mark.parametrize("on", [("dim", "bucket"), ("dim",)])
@pytest.mark.parametrize("most", [1, 12, 1024])
def test_blocks_meet_once(spark, monkeypatch, on, most):
    """Whatever the number of cells, also where a length or a bucket has no anchors."""
    monkeypatch.setattr(hn, "SCORES", 1)
    monkeypatch.setattr(hn, "SLICES", most)

    def blocks(counts, size):
        rows = [(d, b, part, 10 * size, size, f"{d} {b} {part}".encode()) for (d, b), n in counts.items() for part in range(n)]
        return rows, spark.createDataFrame(rows, "dim int, bucket int, part int, rows long, size long, block binary")

    some, anchors = blocks({(3, 1): 1, (3, 2): 5, (4, 1): 2}, 2)
    others, candidates = blocks({(3, 1): 9, (3, 2): 4, (3, 5): 1, (4, 1): 1, (7, 0): 3}, 30)
    want = sorted((x[5], y[5]) for x in some for y in others if x[: len(on)] == y[: len(on)])
    assert sorted((bytes(a), bytes(b)) for a, b in hn._met(anchors, candidates, *on).collect()) == want


def test_copies_of_blocks_are_not_broadcast(spark, monkeypatch):
    """Blocks are copied for the cells they meet others in; those copies do not go through the driver."""
    for name, value in (("ANCHOR_ROWS", 7), ("CANDIDATE_ROWS", 16)):
        monkeypatch.setattr(hn, name, value)
    df = hn.mine(table(spark, vectors(260, 6, 3)), F.col("vec_id") % 10 == 0)
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[[^]]*slice", plan) and not re.search(r"BroadcastHashJoin \[[^]]*slice", plan)
