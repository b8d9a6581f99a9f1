"""Streaming queries (J1-J7): the events table, or a folder of files, read as a stream to its end."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import jobs as jb
from ..session import fresh_dir
from ..sources import files as fl
from ..streaming import live as lv
from . import fixtures as fx
from .oracle import with_tables
from .registry import query


@query("j1_micro_batches", "trigger_no:l batch_no:l n:l first:l", with_tables("", """
    SELECT 0 AS trigger_no, b AS batch_no, count(*) AS n, min(event_id) AS first FROM (
        SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 20 AS b FROM events) GROUP BY b"""))
def j1(t):
    out = fresh_dir(t.spark, "micro-out")

    def handle(batch, trigger):
        batch.groupBy("trigger_no", "batch_no").agg(
            F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")
        ).write.mode("overwrite").parquet(f"{out}/trigger={trigger}")

    lv.micro_batches(fx.event_stream(t), handle, available_now=True).awaitTermination()
    return t.spark.read.schema("trigger_no long, batch_no long, n long, first long").parquet(f"{out}/*")


_LINGER = 2 * 86_400_000


# Batches of each task: what it sends within two days of a batch's first event, four at most, as a recursion.
@query("j1_keyed_batches", "key:s batch_no:l item_id:l", with_tables("job_events", f"""
    SELECT key, batch_no, item_id FROM walk""",
    items="""SELECT task_id AS key, event_id AS item_id, epoch_us(ts) // 1000 AS ms,
        row_number() OVER (PARTITION BY task_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM job_events""",
    walk=f"""
        SELECT key, n, item_id, ms AS first_ms, 1 AS k, CAST(0 AS BIGINT) AS batch_no FROM items WHERE n = 1
        UNION ALL
        SELECT i.key, i.n, i.item_id, CASE WHEN w.k < 4 AND i.ms < w.first_ms + {_LINGER} THEN w.first_ms ELSE i.ms END,
               CASE WHEN w.k < 4 AND i.ms < w.first_ms + {_LINGER} THEN w.k + 1 ELSE 1 END,
               CASE WHEN w.k < 4 AND i.ms < w.first_ms + {_LINGER} THEN w.batch_no ELSE w.batch_no + 1 END
        FROM walk w JOIN items i ON i.key = w.key AND i.n = w.n + 1"""))
def j1_keyed(t):
    lv.use_rocksdb(t.spark)
    stream = _cut_stream(t, heartbeat=True)
    return lv.to_table(lv.keyed_batches(stream, size=4, linger="2 days", delay="400 days"))


def _cut_stream(t, files: int = 6, heartbeat: bool = False):
    """The events as a stream of several files, two in each trigger; the files are cut across the order of time.

    With ``heartbeat`` a last event, of task -1 and a hundred years later, moves the watermark past all others.
    """
    folder = fresh_dir(t.spark, "events")
    t.events.repartition(files, F.pmod(F.col("event_id"), F.lit(files))).write.parquet(folder)
    if heartbeat:
        late = {"event_id": -1, "user_id": -1, "event_type": "view", "value": 0.0, "ts": datetime(2124, 1, 1)}
        row = tuple(late.get(f.name) for f in t.events.schema)
        t.spark.createDataFrame([row], t.events.schema).write.mode("append").parquet(folder)
    raw = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return fx.event_rows(raw)


@query("j2_first_reports", "task_id:s step:l ok:b msg:s", with_tables("job_events", """
    SELECT task_id, step, arg_min(ok, (ts, event_id)) AS ok, arg_min(msg, (ts, event_id)) AS msg
    FROM job_events GROUP BY 1, 2"""))
def j2(t):
    updates = lv.to_table(lv.first_reports(_cut_stream(t)), "update")
    return lv.latest_update(updates, "task_id", "step")


# Runs of a task's step, a day apart; all are over when the heartbeat has passed.
@query("j2_first_reports_of_runs", "task_id:s step:l n_reports:l ok:b msg:s event_id:l", with_tables("job_events", """
    SELECT task_id, step, count(*) AS n_reports, arg_min(ok, (ts, event_id)) AS ok, arg_min(msg, (ts, event_id)) AS msg,
           arg_min(event_id, (ts, event_id)) AS event_id
    FROM (SELECT *, sum(cut) OVER (PARTITION BY task_id, step ORDER BY ts, event_id) AS run FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id, step ORDER BY ts, event_id) < INTERVAL 1 DAY THEN 0
                       ELSE 1 END AS cut FROM job_events)) GROUP BY task_id, step, run"""))
def j2_runs(t):
    return lv.to_table(lv.first_reports_of_runs(_cut_stream(t, heartbeat=True), "1 day", "400 days"))


@query("j3_stage_hand_off", "task_id:s action:s event_id:l", with_tables("job_events", """
    SELECT task_id, CASE WHEN arg_min(ok, event_id) THEN 'mix' ELSE 'drop' END AS action, min(event_id) AS event_id
    FROM job_events WHERE step <= 2 AND (NOT ok OR step = 2) GROUP BY task_id"""))
def j3(t):
    lv.use_rocksdb(t.spark)
    return lv.to_table(lv.stage_hand_off(fx.event_stream(t)))


# Every fourth task has its speech already: it enters once, without an event.
@query("j3_ready_hand_off", "task_id:s action:s event_id:l", with_tables("job_events", """
    SELECT task_id, CASE WHEN arg_min(ok, event_id) THEN 'mix' ELSE 'drop' END AS action, min(event_id) AS event_id
    FROM job_events WHERE step <= 2 AND (NOT ok OR step = 2) AND CAST(task_id AS BIGINT) % 4 <> 0 GROUP BY task_id
    UNION ALL
    SELECT DISTINCT task_id, 'mix', CAST(NULL AS BIGINT) FROM job_events WHERE CAST(task_id AS BIGINT) % 4 = 0"""))
def j3_ready(t):
    lv.use_rocksdb(t.spark)
    ready = fx.job_events(t).select("task_id").filter(F.col("task_id").cast("long") % 4 == 0)
    return lv.to_table(lv.stage_hand_off(fx.event_stream(t), ready))


@query("j4_step_progress", "step:l pct:l", with_tables("job_events", "SELECT step, max(pct) AS pct FROM job_events GROUP BY 1"))
def j4(t):
    return lv.latest_update(lv.to_table(lv.step_progress(fx.event_stream(t)), "update"), "step")


_LIVE = """
    SELECT task_id, CASE WHEN CAST(task_id AS BIGINT) % 9 = 0 THEN '' ELSE 'g' || (CAST(task_id AS BIGINT) % 9) END AS group_id,
           coalesce(max(CASE WHEN step = 1 THEN s END), 'pending') AS s1, coalesce(max(CASE WHEN step = 2 THEN s END), 'pending') AS s2,
           coalesce(max(CASE WHEN step = 3 THEN s END), 'pending') AS s3
    FROM (SELECT task_id, step, CASE WHEN arg_max(ok, (ts, event_id)) THEN 'done' ELSE 'failed' END AS s
          FROM job_events GROUP BY 1, 2) GROUP BY 1"""
_PART = "(CAST(s1 = 'done' AS INTEGER) + CAST(s2 = 'done' AS INTEGER) + CAST(s3 = 'done' AS INTEGER)) / 3.0"


# The last update of every task and of every group; each trigger reports what it changed.
@query("j5_live_rollup", "kind:s id:s status:s progress:d", with_tables("job_events", f"""
    SELECT 'task' AS kind, task_id AS id,
           CASE WHEN s3 = 'done' THEN 'done' WHEN 'failed' IN (s1, s2, s3) THEN 'failed' ELSE 'pending' END AS status,
           {_PART} AS progress FROM live
    UNION ALL
    SELECT 'group', group_id, CASE WHEN bool_and(s3 = 'done') THEN 'done' WHEN bool_or('failed' IN (s1, s2, s3)) THEN 'failed'
           ELSE 'pending' END, avg({_PART}) FROM live WHERE group_id <> '' GROUP BY group_id""", live=_LIVE))
def j5(t):
    number = F.col("task_id").cast("long") % 9
    groups = fx.job_events(t).select("task_id").distinct().filter(number != 0).withColumn(
        "group_id", F.concat(F.lit("g"), number.cast("string"))
    )
    out = fresh_dir(t.spark, "rollup-out")

    def keep(tasks, rolled, trigger):
        rows = tasks.select(F.lit("task").alias("kind"), F.col("task_id").alias("id"), jb.task_status().alias("status"),
                            jb.task_progress().alias("progress"))
        both = rows.union(rolled.select(F.lit("group"), "group_id", "status", "progress"))
        both.write.mode("overwrite").parquet(f"{out}/batch_id={trigger}")

    lv.live_rollup(_cut_stream(t), groups, keep)
    updates = t.spark.read.schema("kind string, id string, status string, progress double, batch_id long").option(
        "basePath", out
    ).parquet(out)
    return lv.latest_update(updates, "kind", "id")


@query("j6_severity_counts", "window_start:s severity:s n:l", with_tables("job_events", """
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS window_start,
           CASE kind WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warning' WHEN 'purchase' THEN 'success' ELSE 'info' END AS severity,
           count(*) AS n FROM job_events GROUP BY 1, 2"""))
def j6(t):
    updates = lv.to_table(lv.severity_counts(fx.event_stream(t)), "update")
    counts = lv.latest_update(updates, "window_start", "severity")
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH"))


# Cues of each source written as files, then picked up as they arrive.
@query("j7_arriving_files", "source:s n_bytes:l", """
    SELECT source, sum(octet_length(encode(text)) + 1) AS n_bytes FROM documents GROUP BY source""")
def j7(t):
    folder = fresh_dir(t.spark, "arrivals")
    t.documents.select("source", "text").write.partitionBy("source").text(folder)
    seen = lv.to_table(fl.watch_folder(t.spark, folder, "*.txt").select("path", "length"))
    source = F.regexp_extract(tx.dir_name(F.col("path")), "source=([^/]*)", 1)
    return seen.groupBy(source.alias("source")).agg(F.sum("length").alias("n_bytes"))
