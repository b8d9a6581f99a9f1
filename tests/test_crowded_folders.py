"""Paths below a crowded folder do not meet in one task of Spark."""

from __future__ import annotations

import pytest

from cueloom.operators import matching as ma


@pytest.mark.parametrize("top", [False, True])
def test_renames_below_a_crowded_folder(spark, monkeypatch, top):
    monkeypatch.setattr(ma, "CROWD", 7)
    paths = {i: f"/jobs/c{i % 9}/d{i % 2}/t{i}.mp4" for i in range(200)}
    moves = {f"/jobs/c{c}": f"/new/{c}" for c in (1, 2, 3)} | {"/jobs/c2/d1": "/deep"} | ({"/jobs": "/all"} if top else {})

    def moved(path):
        old = max((o for o in moves if path.startswith(o + "/")), key=len, default=None)
        return path if old is None else moves[old] + path[len(old):]

    rows = spark.createDataFrame(list(paths.items()), "task_id long, source_path string")
    got = ma.apply_renames(rows, spark.createDataFrame(list(moves.items()), "old string, new string"), "task_id")
    assert sorted(map(tuple, got.collect())) == [(i, moved(p)) for i, p in paths.items()]
    # The join on the folder meets the paths of a crowded one by share.
    assert "_share" in got._jdf.queryExecution().optimizedPlan().toString()
