"""Job state: readiness, rollups, outcomes, progress.

``tasks`` is wide (task_id, group_id, s1_status .. s3_status); ``steps`` is melted
(task_id, step, status). Every rollup is an aggregate that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.scan import segmented_scan

STEP_STATUS = {step: f"s{step}_status" for step in K.STEPS}


def status_of(step: int) -> Column:
    return F.col(STEP_STATUS[step])


def _any(states: Sequence[str]) -> Column:
    test = F.lit(False)
    for step in K.STEPS:
        test = test | status_of(step).isin(*states)
    return test


def melt_steps(tasks: DataFrame, *keep: str) -> DataFrame:
    """One row per task and step."""
    step = [F.struct(F.lit(s).alias("step"), status_of(s).alias("status")) for s in K.STEPS]
    return tasks.select("task_id", *keep, F.explode(F.array(*step)).alias("_s")).select(
        "task_id", *keep, "_s.step", "_s.status"
    )


def step_ready(step: int) -> Column:
    """Step 1 always; a later step once the one before is done or skipped."""
    return F.lit(True) if step == 1 else status_of(step - 1).isin(*K.FINISHED)


def with_readiness(tasks: DataFrame) -> DataFrame:
    for step in K.STEPS:
        tasks = tasks.withColumn(f"s{step}_ready", step_ready(step))
    return tasks


def disposition(step: int, failed: Column | None = None) -> Column:
    """What a batch run does with a task at a step."""
    status = status_of(step)
    bad = F.lit(False) if failed is None else failed
    return (
        F.when(bad, "skip_failed")
        .when(status.isin(*K.FINISHED), "skip_done")
        .when(status == K.RUNNING, "skip_running")
        .when(~step_ready(step), "fail_not_ready")
        .otherwise("run")
    )


def pending_for(tasks: DataFrame, step: int) -> DataFrame:
    """Tasks with the step still open, with ``ready``."""
    return tasks.filter(~status_of(step).isin(*K.FINISHED)).withColumn("ready", step_ready(step))


def not_ready_preview(tasks: DataFrame, step: int, n: int = 10, name: str = "source_name") -> DataFrame:
    """H5: the first ``n`` open tasks that are not ready, in natural order."""
    blocked = pending_for(tasks, step).filter(~F.col("ready"))
    return blocked.orderBy(tx.natural_key(F.col(name)), "task_id").limit(n)


# --- rollups ----------------------------------------------------------------

def task_progress() -> Column:
    """share of the three steps done or skipped."""
    done = sum((status_of(s).isin(*K.FINISHED).cast("int") for s in K.STEPS), F.lit(0))
    return done / 3.0


def task_status() -> Column:
    """F8: step 3 done, else any failed, else any running, else pending."""
    return (
        F.when(status_of(3) == K.DONE, K.DONE)
        .when(_any([K.FAILED]), K.FAILED)
        .when(_any([K.RUNNING]), K.RUNNING)
        .otherwise(K.PENDING)
    )


def group_rollup(tasks: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """tasks, mean progress, done count and status per group.

    With ``groups`` (group_id, ..) empty groups appear too: no progress, pending.
    """
    sums = tasks.filter(F.col("group_id") != "").groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.avg(task_progress()).alias("progress"),
        F.count_if(status_of(3) == K.DONE).alias("n_done"),
        F.bool_or(_any([K.RUNNING])).alias("_running"),
        F.bool_and(status_of(3) == K.DONE).alias("_done"),
        F.bool_or(_any([K.FAILED])).alias("_failed"),
    )
    rows = sums if groups is None else groups.select("group_id").join(sums, "group_id", "left")
    status = (
        F.when(F.col("_running"), K.RUNNING)
        .when(F.col("_done"), K.DONE)
        .when(F.col("_failed"), K.FAILED)
        .otherwise(K.PENDING)
    )
    return rows.select(
        "group_id",
        F.coalesce("n_tasks", F.lit(0)).alias("n_tasks"),
        F.coalesce("progress", F.lit(0.0)).alias("progress"),
        F.coalesce("n_done", F.lit(0)).alias("n_done"),
        status.alias("status"),
    )


def group_step_status(tasks: DataFrame) -> DataFrame:
    """status per group and step: running > failed > all done or skipped > pending.

    Tasks without a group are in none.
    """
    aggs = []
    for s in K.STEPS:
        aggs.append(
            F.when(F.bool_or(status_of(s) == K.RUNNING), K.RUNNING)
            .when(F.bool_or(status_of(s) == K.FAILED), K.FAILED)
            .when(F.bool_and(status_of(s).isin(*K.FINISHED)), K.DONE)
            .otherwise(K.PENDING)
            .alias(f"step{s}")
        )
    wide = tasks.filter(F.col("group_id") != "").groupBy("group_id").agg(*aggs)
    pairs = [F.struct(F.lit(s).alias("step"), F.col(f"step{s}").alias("status")) for s in K.STEPS]
    return wide.select("group_id", F.explode(F.array(*pairs)).alias("_s")).select("group_id", "_s.*")


def progress_levels(tasks: DataFrame) -> DataFrame:
    """F3, F4 as one table: a row per task, per group (task NULL) and for all (both NULL); tasks without a group are left out."""
    return tasks.filter(F.col("group_id") != "").rollup("group_id", "task_id").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.avg(task_progress()).alias("progress")
    )


def run_outcome(
    tasks: DataFrame,
    steps: Sequence[int],
    rule: str = "by_step",
    source_ok: Column | None = None,
    failed: Column | None = None,
    running: str = "skip",
) -> DataFrame:
    """tasks with ``outcome`` success, fail or skipped after a run of ``steps``.

    ``source_ok`` says whether the source was found and ``failed`` whether a step failed in this run.
    The statuses are those after the run, so a step that was not run keeps its state from before.
    ``by_step`` (also the two-stage order): a missing source, a failed step or a step whose dependency is
    open fails the task; all selected steps done or skipped succeed; anything else is skipped.
    ``by_task``: a missing source or a running step skips the task; then a failed step or an open
    dependency fails it; anything else succeeds. ``running='run'`` treats running steps as open work.
    """
    found = F.lit(True) if source_ok is None else source_ok
    broke = F.lit(False) if failed is None else failed
    ordered = sorted(steps)
    finished = F.lit(True)
    for s in ordered:
        finished = finished & status_of(s).isin(*K.FINISHED)
    blocked = F.lit(False)
    for s in ordered:
        open_step = ~status_of(s).isin(*K.FINISHED)
        if running == "skip":
            open_step = open_step & (status_of(s) != K.RUNNING)
        blocked = blocked | (open_step & ~step_ready(s))
    if rule == "by_task":
        busy = _any([K.RUNNING]) if running == "skip" else F.lit(False)
        outcome = (
            F.when(~found | busy, "skipped").when(broke | blocked, "fail").otherwise("success")
        )
    else:
        outcome = (
            F.when(~found | broke | blocked, "fail").when(finished, "success").otherwise("skipped")
        )
    return tasks.withColumn("outcome", outcome)


def outcome_counts(outcomes: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "fail", "skipped")]
    return outcomes.groupBy(*by).agg(*counts)


def first_reports(events: DataFrame, *by: str) -> DataFrame:
    """the first result reported per task (and ``by``), later ones are ignored."""
    keys = ["task_id", *by]
    first = F.min_by(F.struct("ok", "msg"), F.struct("ts", "event_id"))
    return events.groupBy(*keys).agg(first.alias("_r")).select(*keys, "_r.ok", "_r.msg")


def report_counts(events: DataFrame, *by: str) -> DataFrame:
    """successes and failures over first reports."""
    firsts = first_reports(events, *by)
    return firsts.groupBy(*by).agg(
        F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed")
    )


def completion_gate(tasks: DataFrame, folder: str = "folder") -> DataFrame:
    """tasks with ``gate_open``: every task of the folder is done, failed or skipped."""
    gates = tasks.groupBy(folder).agg(
        F.bool_and(status_of(3).isin(*K.TERMINAL)).alias("gate_open")
    )
    return tasks.join(gates, folder, "inner")


def without_failed(tasks: DataFrame, failed: DataFrame) -> DataFrame:
    """I4: tasks less the failed ones."""
    return tasks.join(failed.select("task_id"), "task_id", "left_anti")


# --- running figures --------------------------------------------------------

def _time_chunk(window: str | None) -> Column | None:
    return None if window is None else F.date_trunc(window, "ts")


def with_eta(events: DataFrame, keys: Sequence[str], window: str | None = None) -> DataFrame:
    """After each finished item of a run: items done, mean seconds per item, seconds left.

    ``events`` has (event_id, ts) and the run's ``keys``; a run starts at its first event. Count, total and
    start come from one chunked scan, so one long run is not one task and nothing is joined twice. Chunks are
    cut by row count (a sort by range) unless ``window`` names a time span that bounds the rows of a run.
    """
    numbered = segmented_scan(
        events, keys, ["ts", "event_id"], _time_chunk(window), rank="done", size="total", lows={"_t0": "ts"}
    )
    elapsed = (F.unix_micros("ts") - F.unix_micros("_t0")) / 1e6
    left = elapsed / F.col("done") * (F.col("total") - F.col("done"))
    return (
        numbered.withColumn("avg_sec", elapsed / F.col("done"))
        .withColumn("left_sec", left)
        .withColumn("eta", tx.eta_text(left))
        .drop("_t0")
    )


def stage_percent(events: DataFrame, keys: Sequence[str], window: str | None = None) -> DataFrame:
    """Cumulative percent of a stage after each finished task; ``window`` as in :func:`with_eta`."""
    numbered = segmented_scan(
        events, keys, ["ts", "event_id"], _time_chunk(window), rank="done", size="total"
    )
    return numbered.withColumn("stage_pct", tx.percent(F.col("done"), F.col("total")))


def log_tail(log: DataFrame, n: int = 5000, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The last ``n`` log lines; each task keeps its own last ``n`` and one merges them."""
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(n)
