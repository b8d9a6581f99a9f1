"""A stream's final table equals its batch twin."""

from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.operators import jobs as jb
from cueloom.plans import fixtures as fx
from cueloom.streaming import live as lv

SMALL = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_first_reports(spark):
    t = fx.Tables(spark, SMALL)
    live = lv.latest_update(lv.to_table(lv.first_reports(fx.event_stream(t)), "update"), "task_id", "step")
    cols = ("task_id", "step", "ok", "msg")
    assert rows(live, *cols) == rows(jb.first_reports(fx.job_events(t), "step"), *cols)


def test_progress_and_severity(spark):
    t = fx.Tables(spark, SMALL)
    live = lv.latest_update(lv.to_table(lv.step_progress(fx.event_stream(t)), "update"), "step")
    assert rows(live, "step", "pct") == rows(fx.job_events(t).groupBy("step").agg(F.max("pct").alias("pct")), "step", "pct")
    live = lv.to_table(lv.severity_counts(fx.event_stream(t), "1 day"))
    batch = fx.job_events(t).groupBy(F.date_trunc("day", "ts").alias("w"), tx.severity(F.col("msg")).alias("s")).agg(
        F.count(F.lit(1)).alias("n")
    )
    closed = rows(live, "window_start", "severity", "n")
    assert closed and set(closed) <= set(rows(batch, "w", "s", "n"))


def test_hand_off(spark):
    lv.use_rocksdb(spark)
    t = fx.Tables(spark, SMALL)
    live = lv.to_table(lv.stage_hand_off(fx.event_stream(t)))
    cols = ("task_id", "action", "event_id")
    assert rows(live, *cols) == rows(lv.hand_off_batch(fx.job_events(t)), *cols)


def test_folders_are_released(spark):
    from cueloom import session

    frozen = session.freeze(spark.range(5))
    assert frozen.count() == 5 and session.release(spark) >= 1 and session.release(spark) == 0
    assert not [f for f in frozen.inputFiles() if __import__("os").path.exists(f.removeprefix("file://"))]
