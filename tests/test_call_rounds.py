"""Capped calls run in rounds; a task keeps its calling thread."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from cueloom.operators import enrich as en


def _service():
    """A service whose paths tell the thread that called; made here, so it travels by value."""
    def by_thread(texts, model, endpoint=""):
        import threading

        return [f"/{threading.current_thread().name}/{x}" for x in texts]

    return by_thread


def test_more_work_makes_more_rounds_and_no_larger_tasks(spark, monkeypatch):
    work = spark.range(120).repartition(6).select(
        F.col("id").cast("string").alias("cache_key"), F.concat(F.lit("t"), "id").alias("text"), F.lit("m").alias("model")
    )
    one = en.enrich(work, _service(), batch_size=5, pause_s=0.0, parallelism=2)
    assert 1 <= len(one.inputFiles()) <= 2
    monkeypatch.setattr(en, "ROUND_MB", 0.0001)
    many = en.enrich(work, _service(), batch_size=1, pause_s=0.0, parallelism=2)
    rows = many.collect()
    assert sorted(r.result_path.split("/")[2] for r in rows) == sorted(f"t{i}" for i in range(120)) and all(r.ok for r in rows)
    sizes = [r["count"] for r in many.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 4 and max(sizes) <= 40
    # No more calls at once than the cap, over all rounds.
    assert en.calls_under_way(many).agg(F.max("running")).first()[0] <= 2
    # A task keeps its thread from call to call.
    assert len({r.result_path.split("/")[1] for r in rows}) <= len(sizes)
    assert {r.called_us for r in many.collect()} == {r.called_us for r in rows}


def test_capped_work_without_rows(spark):
    none = spark.createDataFrame([], "cache_key string, text string, model string")
    assert en.enrich(none, _service(), parallelism=3).collect() == []


def test_calls_go_on_after_a_hanging_one():
    def slow_once(texts, model, endpoint):
        if texts == ["hang"]:
            time.sleep(3)
        return [f"/{texts[0]}"]

    caller = en._Caller()
    began = time.time()
    assert en.call_one(slow_once, "a", "m", 1, 0, caller=caller)[:2] == ("/a", True)
    assert en.call_one(slow_once, "hang", "m", 1, 0, limit_s=0.2, caller=caller)[1] is False
    assert en.call_one(slow_once, "b", "m", 1, 0, caller=caller)[:2] == ("/b", True)
    assert time.time() - began < 2
