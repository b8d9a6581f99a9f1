"""Live variants on Structured Streaming (J1-J7). Each has a batch twin in ``operators``.

``events`` is a streaming table of job events (event_id, ts, task_id, step, kind, ok, pct, msg) with ``ts``
as a timestamp with time zone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import constants as K
from ..functions import text as tx
from ..operators import enrich as en
from ..session import fresh_dir
from . import stateful as st

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(
    stream: DataFrame, on_batch: Callable[[DataFrame, int], None], mode: str = "append", location: str | None = None
) -> None:
    """Process what is there now, batch by batch, and stop."""
    where = location or fresh_dir(stream.sparkSession, "stream")
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(on_batch)
        .option("checkpointLocation", where)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end and read what it wrote.

    Every batch goes to its own folder, so a batch that runs again replaces itself. ``append`` and ``update``
    keep all batches, with ``batch_id``; see :func:`latest_update`. ``complete`` keeps the last one only.
    """
    spark = stream.sparkSession
    base = fresh_dir(spark, "stream-out")
    last = {"id": -1}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
        last["id"] = max(last["id"], batch_id)

    run_to_end(stream, write, mode)
    if last["id"] < 0:
        extra = [] if mode == "complete" else [StructField("batch_id", LongType())]
        return spark.createDataFrame([], StructType([*stream.schema.fields, *extra]))
    schema = stream.schema
    with_batch = StructType([*schema.fields, StructField("batch_id", LongType())])
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{base}/batch_id={last['id']}")
    return spark.read.schema(with_batch).option("basePath", base).parquet(base)


def span_ms(span: str) -> int:
    """Milliseconds of a span such as ``300 milliseconds`` or ``2 days``."""
    number, unit = span.split()
    sizes = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}
    return int(number) * sizes[unit.removesuffix("s")]


def latest_update(updates: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each key of an ``update`` stream's table."""
    rest = [c for c in updates.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*rest), "batch_id")
    return updates.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


# --- J1 ---------------------------------------------------------------------

def micro_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], size: int = 20, linger: str = "300 milliseconds",
    keys: tuple[str, ...] = (), order: tuple[str, ...] = ("event_id",), chunk_rows: int = 4096,
    available_now: bool = False, location: str | None = None,
):
    """What arrives within ``linger`` is numbered in groups of at most ``size`` and handed on.

    ``order`` must start with a whole number; it also gives the chunks of the numbering scan.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # The numbering reads the batch twice; a source should be read once.
        batch.persist()
        numbered = en.number_micro_batches(
            batch, order, F.floor(F.col(order[0]) / chunk_rows), size, keys
        )
        handle(numbered.withColumn("trigger_no", F.lit(batch_id).cast("long")), batch_id)
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", location or fresh_dir(stream.sparkSession, "micro")
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": linger}
    return writer.trigger(**trigger).start()


BATCH_SCHEMA = "key string, batch_no long, at_ms long, item_id long, item string"


def keyed_batches(
    stream: DataFrame, key: str = "task_id", item_id: str = "event_id", item: str = "msg", size: int = 20,
    linger: str = "300 milliseconds", delay: str = "1 minute",
) -> DataFrame:
    """Batches for each key, ``(key, batch_no, at_ms, item_id, item)`` in one row for each item.

    A batch is opened by its key's first item that is in none, takes what the key brings before ``linger`` has passed,
    and leaves with ``size`` items or at the end of that time, by event time ``ts``. Items count in the order of
    (ts, item_id) whatever order they come in, so a batch waits until the watermark, ``delay`` behind the newest
    event, is past its end; later items are left out. The state is a key's waiting items and its next batch number.
    Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    rows = stream.withWatermark("ts", delay).filter("ts IS NOT NULL").select(
        F.col(key).cast("string").alias("key"), "ts", F.unix_millis("ts").alias("at_ms"),
        F.col(item_id).cast("long").alias("item_id"), F.col(item).cast("string").alias("item"),
    )
    return rows.groupBy("key").transformWithState(
        st.KeyedBatches(size, span_ms(linger)), BATCH_SCHEMA, "append", "EventTime"
    )


# --- J2, J4, J6 -------------------------------------------------------------

def first_reports(events: DataFrame) -> DataFrame:
    """The first report (by ts, then event_id) per task and step, for ``update`` mode.

    A report that arrives late but is earlier replaces the one held, and goes out as an update; see
    :func:`latest_update`. The state is one short row for each task and step.
    """
    first = F.min_by(F.struct("ok", "msg", "ts", "event_id"), F.struct("ts", "event_id"))
    return events.groupBy("task_id", "step").agg(first.alias("_r")).select("task_id", "step", "_r.*")


def first_reports_of_runs(events: DataFrame, quiet: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """J2 with an end, for ``append`` mode: the first report (by ts, then event_id) of each run of a task and step.

    A run is over once nothing was reported for ``quiet``, and when the watermark, ``delay`` behind the newest event,
    is past that, its first report goes out, once, and the run leaves the state. Within a run reports may come in any
    order; those that are late for a run that is over are left out.
    """
    first = F.min_by(F.struct("ok", "msg", "ts", "event_id"), F.struct("ts", "event_id"))
    return (
        events.withWatermark("ts", delay)
        .groupBy("task_id", "step", F.session_window("ts", quiet).alias("_w"))
        .agg(first.alias("_r"), F.count(F.lit(1)).alias("n_reports"))
        .select("task_id", "step", F.col("_w.start").alias("run_start"), F.col("_w.end").alias("run_end"), "n_reports", "_r.*")
    )


def step_progress(events: DataFrame) -> DataFrame:
    """Percent per step that never goes back."""
    return events.groupBy("step").agg(F.max("pct").alias("pct"))


def severity_counts(log: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Messages per time window and severity, for (ts, msg)."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), tx.severity(F.col("msg")).alias("severity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "severity", "n")
    )


# --- J5 ---------------------------------------------------------------------

def _newest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of what a task reads at once, the newest report of each task and step."""
    for pdf in batches:
        yield pdf.sort_values(["at_us", "event_id"]).drop_duplicates(["task_id", "step"], keep="last")


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of tasks as they are, and one difference for each group instead of one for each of its tasks."""
    for pdf in batches:
        sums = pdf[pdf["kind"] == "group"].groupby(["kind", "id", "group_id"], as_index=False)[list(st.COUNTERS)].sum()
        yield pd.concat([pdf[pdf["kind"] == "task"], sums])[list(pdf.columns)]


def rollup_changes(events: DataFrame, groups: DataFrame, idle: str | None = None, delay: str = "1 day") -> DataFrame:
    """The stream of changed tasks (kind ``task``) and of the new counters of their groups (kind ``group``).

    Two stateful steps: a task's step sends what a change takes from and adds to its group, and the group's step adds
    that up, so a trigger works on what changed and never on the table of all tasks. ``groups`` (task_id, group_id) is
    the initial state; tasks it does not name are in no group. Differences are summed up in every task of the first
    step, so a group with a third of all tasks sends a row from each.

    The state is one row for each task and for each group. A task's older reports are left out before the shuffle. With ``idle`` a task without a report for so long (by event
    time, once the watermark is past it) leaves the state and its group; reports that are more than ``delay`` late
    are then left out. Without it nothing is late and nothing leaves. Needs the RocksDB state store
    (:func:`use_rocksdb`).
    """
    rows = events if idle is None else events.withWatermark("ts", delay)
    reports = rows.filter(F.col("ts").isNotNull() & F.col("step").isin(*K.STEPS)).select(
        "task_id", "step", "ok", "event_id", F.unix_micros("ts").alias("at_us"), *(["ts"] if idle else [])
    )
    # The time column must keep its watermark, so with ``idle`` all reports go on as they are.
    newest = reports if idle else reports.mapInPandas(_newest, reports.schema)
    changes = (
        newest.groupBy("task_id")
        .transformWithState(
            st.TaskChanges(None if idle is None else span_ms(idle)), st.CHANGE, "append", "none" if idle is None else "EventTime",
            initialState=groups.select("task_id", "group_id").groupBy("task_id"),
        )
    )
    # Changed tasks only pass the second step: a few keys are enough for them.
    slot = F.when(F.col("kind") == "task", F.pmod(F.xxhash64("id"), F.lit(64)).cast("string")).otherwise(F.col("id"))
    return (
        changes.mapInPandas(_combined, st.CHANGE).withColumn("slot", slot).groupBy("kind", "slot")
        .transformWithState(st.GroupTotals(), st.CHANGE, "append", "none")
    )


def group_state(changes: DataFrame) -> DataFrame:
    """F4, F5, F6 from a group's counters: group_id, n_tasks, progress, n_done, status."""
    n = F.col("n_tasks")
    status = (
        F.when(F.col("n_running") > 0, K.RUNNING)
        .when((n > 0) & (F.col("n_done") == n), K.DONE)
        .when(F.col("n_failed") > 0, K.FAILED)
        .otherwise(K.PENDING)
    )
    progress = F.when(n > 0, F.col("n_steps") / (n * len(K.STEPS))).otherwise(0.0)
    return changes.filter(F.col("kind") == "group").select(
        "group_id", "n_tasks", progress.alias("progress"), "n_done", status.alias("status")
    )


def live_rollup(
    events: DataFrame, groups: DataFrame, on_update: Callable[[DataFrame, DataFrame, int], None],
    location: str | None = None, idle: str | None = None, delay: str = "1 day",
) -> None:
    """After every trigger, ``on_update(tasks, groups, trigger)`` with what changed in it.

    ``tasks`` are the wide rows (task_id, group_id, s1_status .. s3_status) of tasks with a new report and ``groups``
    the rollup (as of :func:`cueloom.operators.jobs.group_rollup`) of groups whose figures changed; a group that all its
    tasks have left comes once more, with none. See :func:`rollup_changes`.
    """
    use_rocksdb(events.sparkSession)

    def on_batch(batch: DataFrame, number: int) -> None:
        # Both frames come from one pass over the stateful steps.
        batch.persist()
        tasks = batch.filter(F.col("kind") == "task").select(
            F.col("id").alias("task_id"), "group_id", *[f"s{s}_status" for s in K.STEPS]
        )
        on_update(tasks, group_state(batch), number)
        batch.unpersist()

    base = location or fresh_dir(events.sparkSession, "rollup")
    run_to_end(rollup_changes(events, groups, idle, delay), on_batch, "append", f"{base}/checkpoint")


# --- J3 ---------------------------------------------------------------------

HANDOFF_SCHEMA = "task_id string, action string, event_id long"


def stage_hand_off(
    events: DataFrame, ready: DataFrame | None = None, keep: str = "365 days", delay: str = "1 day"
) -> DataFrame:
    """One row per task when it becomes ready to mix or drops out, as soon as that is known.

    Tasks of the table ``ready`` (task_id) have their speech already: they enter once, without an event, after the first
    trigger that brings events, and reports of theirs do not hand them over again. A task that was handed over or
    stopped is remembered for ``keep`` of event time and then leaves the state; what it reports later is a new run.
    Events more than ``delay`` late are left out. Needs the RocksDB state store (:func:`use_rocksdb`).
    """
    rows = events.withWatermark("ts", delay).filter("ts IS NOT NULL").select(
        "task_id", "step", "ok", "event_id", "ts", F.unix_millis("ts").alias("at_ms")
    )
    start = None if ready is None else ready.select("task_id").distinct().groupBy("task_id")
    return rows.groupBy("task_id").transformWithState(
        st.HandOff(span_ms(keep)), HANDOFF_SCHEMA, "append", "EventTime", initialState=start
    )


def hand_off_batch(events: DataFrame) -> DataFrame:
    """Batch twin of J3: each task's first failed step 1 or 2, or finished step 2."""
    decisive = events.filter((F.col("step") <= 2) & (~F.col("ok") | (F.col("step") == 2)))
    action = F.when(F.col("ok"), "mix").otherwise("drop")
    return decisive.groupBy("task_id").agg(
        F.min_by(action, "event_id").alias("action"), F.min("event_id").alias("event_id")
    )


def use_rocksdb(spark: SparkSession) -> None:
    """State on disk. There is one small store for each task, so files are not made larger in advance."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
