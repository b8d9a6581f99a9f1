"""Queries on job state."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..operators import jobs as jb
from ..operators import transitions as tr
from ..session import fresh_dir
from ..sources import tables as tb
from . import fixtures as fx
from .oracle import natural, with_tables
from .registry import query

_FIN = "IN ('done', 'skipped')"
_R2, _R3 = f"s1 {_FIN}", f"s2 {_FIN}"
_PROGRESS = f"(CAST(s1 {_FIN} AS INTEGER) + CAST(s2 {_FIN} AS INTEGER) + CAST(s3 {_FIN} AS INTEGER)) / 3.0"
_ANY = "('{0}' IN (s1, s2, s3))"


def _full_tasks(t):
    """Tasks with all fields of the task record."""
    out = fx.tasks(t)
    extra = {f"s{s}_output": F.when(F.col(f"s{s}_status") == K.DONE, F.concat(F.lit(f"/out{s}/"), "source_name")).otherwise("") for s in K.STEPS}
    extra |= {f"s{s}_error": F.when(F.col(f"s{s}_status") == K.FAILED, F.lit(f"error {s}")).otherwise("") for s in K.STEPS}
    extra |= {"custom_subtitle": F.lit(""), "custom_mix_folder": F.lit("")}
    return out.withColumns(extra)


_FULL = """
    SELECT *, CASE WHEN s1 = 'done' THEN '/out1/' || source_name ELSE '' END AS o1,
           CASE WHEN s2 = 'done' THEN '/out2/' || source_name ELSE '' END AS o2,
           CASE WHEN s3 = 'done' THEN '/out3/' || source_name ELSE '' END AS o3,
           CASE WHEN s1 = 'failed' THEN 'error 1' ELSE '' END AS e1,
           CASE WHEN s2 = 'failed' THEN 'error 2' ELSE '' END AS e2,
           CASE WHEN s3 = 'failed' THEN 'error 3' ELSE '' END AS e3 FROM tasks"""
_SPEC = "task_id:l s1_status:s s2_status:s s3_status:s s1_output:s s2_output:s s3_output:s s1_error:s s2_error:s s3_error:s"


def _full(select: str, **parts: str) -> str:
    """SQL of a rewritten task table; ``parts`` overrides columns s1..s3, o1..o3, e1..e3."""
    cols = []
    for key, name in (("s", "status"), ("o", "output"), ("e", "error")):
        for s in K.STEPS:
            cols.append(f"{parts.get(f'{key}{s}', f'{key}{s}')} AS s{s}_{name}")
    return with_tables("tasks", f"SELECT task_id, {', '.join(cols)} FROM {select}", full_tasks=_FULL)


@query("a8_task_snapshot", "task_id:s source_path:s s1_status:s from_folder:b group_id:s custom_subtitle:s",
       with_tables("tasks", """
    SELECT task_id, source_path, s1 AS s1_status, from_folder, group_id, '' AS custom_subtitle FROM tasks"""))
def a8(t):
    path = fresh_dir(t.spark, "tasks")
    tb.write_task_snapshot(fx.tasks(t), path)
    return tb.read_task_snapshot(t.spark, path)


@query("b3_step_readiness", "task_id:l s1_ready:b s2_ready:b s3_ready:b", with_tables("tasks", f"""
    SELECT task_id, true AS s1_ready, {_R2} AS s2_ready, {_R3} AS s3_ready FROM tasks"""))
def b3(t):
    return jb.with_readiness(fx.tasks(t))


@query("b4_dispositions", "disposition:s n:l", with_tables("tasks", f"""
    SELECT CASE WHEN s1 = 'failed' THEN 'skip_failed' WHEN s3 {_FIN} THEN 'skip_done' WHEN s3 = 'running' THEN 'skip_running'
                WHEN NOT ({_R3}) THEN 'fail_not_ready' ELSE 'run' END AS disposition, count(*) AS n
    FROM tasks GROUP BY 1"""))
def b4(t):
    d = jb.disposition(3, F.col("s1_status") == K.FAILED)
    return fx.tasks(t).groupBy(d.alias("disposition")).agg(F.count(F.lit(1)).alias("n"))


@query("b5_group_pending", "task_id:l group_id:s ready:b", with_tables("tasks", f"""
    SELECT task_id, group_id, {_R2} AS ready FROM tasks WHERE NOT (s2 {_FIN})"""))
def b5(t):
    return jb.pending_for(fx.tasks(t), 2)


@query("h5_not_ready_preview", "task_id:l source_name:s", with_tables("tasks", f"""
    SELECT task_id, source_name FROM tasks WHERE NOT (s3 {_FIN}) AND NOT ({_R3})
    ORDER BY {natural('source_name')}, task_id LIMIT 10"""))
def h5(t):
    return jb.not_ready_preview(fx.tasks(t), 3)


@query("f3_task_progress", "task_id:l progress:d", with_tables("tasks", f"SELECT task_id, {_PROGRESS} AS progress FROM tasks"))
def f3(t):
    return fx.tasks(t).select("task_id", jb.task_progress().alias("progress"))


_GROUPS = f"""
    SELECT group_id, count(*) AS n_tasks, avg({_PROGRESS}) AS progress, count_if(s3 = 'done') AS n_done,
           CASE WHEN bool_or({_ANY.format('running')}) THEN 'running' WHEN bool_and(s3 = 'done') THEN 'done'
                WHEN bool_or({_ANY.format('failed')}) THEN 'failed' ELSE 'pending' END AS status
    FROM tasks GROUP BY group_id"""


@query("f4_group_progress", "group_id:s n_tasks:l progress:d", with_tables("tasks", """
    SELECT CAST(c_custkey AS VARCHAR) AS group_id, coalesce(n_tasks, 0) AS n_tasks, coalesce(progress, 0) AS progress
    FROM customer LEFT JOIN g ON g.group_id = CAST(c_custkey AS VARCHAR)""", g=_GROUPS))
def f4(t):
    return jb.group_rollup(fx.tasks(t), t.customer.select(F.col("c_custkey").cast("string").alias("group_id")))


@query("f5_group_done", "group_id:s n_done:l", with_tables("tasks", _GROUPS))
def f5(t):
    return jb.group_rollup(fx.tasks(t))


@query("f6_group_status", "group_id:s status:s", with_tables("tasks", """
    SELECT CAST(c_custkey AS VARCHAR) AS group_id, coalesce(status, 'pending') AS status
    FROM customer LEFT JOIN g ON g.group_id = CAST(c_custkey AS VARCHAR)""", g=_GROUPS))
def f6(t):
    return jb.group_rollup(fx.tasks(t), t.customer.select(F.col("c_custkey").cast("string").alias("group_id")))


@query("f7_group_step_status", "group_id:s step:l status:s", with_tables("tasks", f"""
    SELECT group_id, step, CASE WHEN bool_or(s = 'running') THEN 'running' WHEN bool_or(s = 'failed') THEN 'failed'
           WHEN bool_and(s {_FIN}) THEN 'done' ELSE 'pending' END AS status
    FROM (SELECT group_id, 1 AS step, s1 AS s FROM tasks UNION ALL SELECT group_id, 2, s2 FROM tasks
          UNION ALL SELECT group_id, 3, s3 FROM tasks) GROUP BY 1, 2"""))
def f7(t):
    return jb.group_step_status(fx.tasks(t))


@query("f8_task_status", "task_id:l status:s", with_tables("tasks", f"""
    SELECT task_id, CASE WHEN s3 = 'done' THEN 'done' WHEN {_ANY.format('failed')} THEN 'failed'
           WHEN {_ANY.format('running')} THEN 'running' ELSE 'pending' END AS status FROM tasks"""))
def f8(t):
    return fx.tasks(t).select("task_id", jb.task_status().alias("status"))


@query("f3_progress_levels", "level:s n_tasks:l progress:d", with_tables("tasks", f"""
    SELECT coalesce(group_id, 'all') AS level, count(*) AS n_tasks, avg({_PROGRESS}) AS progress
    FROM tasks GROUP BY ROLLUP (group_id)"""))
def f3_levels(t):
    levels = jb.progress_levels(fx.tasks(t)).filter(F.col("task_id").isNull())
    return levels.withColumn("level", F.coalesce("group_id", F.lit("all")))


# Every tenth source is missing; tasks whose last selected step failed broke in this run.
_BLOCK12 = f"(NOT (s2 {_FIN}) AND s2 <> 'running' AND NOT ({_R2}))"
_BLOCK3 = f"(NOT (s3 {_FIN}) AND s3 <> 'running' AND NOT ({_R3}))"
_MISSING, _BROKE = "task_id % 10 = 0", "'failed' IN (s1, s2, s3)"


@query("f9_outcome_by_step", "success:l fail:l skipped:l", with_tables("tasks", f"""
    SELECT count_if(o = 's') AS success, count_if(o = 'f') AS fail, count_if(o = 'k') AS skipped FROM (
        SELECT CASE WHEN {_MISSING} OR {_BROKE} OR {_BLOCK12} OR {_BLOCK3} THEN 'f'
                    WHEN s1 {_FIN} AND s2 {_FIN} AND s3 {_FIN} THEN 's' ELSE 'k' END AS o FROM tasks)"""))
def f9(t):
    out = jb.run_outcome(
        fx.tasks(t), [1, 2, 3], "by_step", F.col("task_id") % 10 != 0, jb._any([K.FAILED])
    )
    return jb.outcome_counts(out)


@query("f10_outcome_by_task", "group_id:s success:l fail:l skipped:l", with_tables("tasks", f"""
    SELECT group_id, count_if(o = 's') AS success, count_if(o = 'f') AS fail, count_if(o = 'k') AS skipped FROM (
        SELECT group_id, CASE WHEN {_MISSING} OR 'running' IN (s1, s2, s3) THEN 'k'
                    WHEN {_BROKE} OR {_BLOCK12} OR {_BLOCK3} THEN 'f' ELSE 's' END AS o FROM tasks) GROUP BY 1"""))
def f10(t):
    out = jb.run_outcome(
        fx.tasks(t), [1, 2, 3], "by_task", F.col("task_id") % 10 != 0, jb._any([K.FAILED])
    )
    return jb.outcome_counts(out, "group_id")


@query("f11_first_reports", "step:l n_ok:l n_failed:l", with_tables("job_events", """
    SELECT step, count_if(ok) AS n_ok, count_if(NOT ok) AS n_failed FROM (
        SELECT step, ok, row_number() OVER (PARTITION BY task_id, step ORDER BY ts, event_id) AS n FROM job_events)
    WHERE n = 1 GROUP BY step"""))
def f11(t):
    return jb.report_counts(fx.job_events(t), "step")


@query("f14_completion_gate", "task_id:l gate_open:b", with_tables("tasks", """
    SELECT task_id, bool_and(s3 IN ('done', 'failed', 'skipped')) OVER (PARTITION BY group_id) AS gate_open FROM tasks"""))
def f14(t):
    return jb.completion_gate(fx.tasks(t).withColumn("folder", F.col("group_id")))


_ETA = """
    SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY task_id)) / 1e6::DOUBLE AS elapsed,
           row_number() OVER (PARTITION BY task_id ORDER BY ts, event_id) AS done,
           count(*) OVER (PARTITION BY task_id) AS total FROM job_events"""


@query("g7_eta", "event_id:l done:l total:l avg_ms:l left_ms:l", with_tables("job_events", """
    SELECT event_id, done, total, floor(elapsed / done * 1000) AS avg_ms,
           floor(elapsed / done * (total - done) * 1000) AS left_ms FROM eta""", eta=_ETA))
def g7(t):
    eta = jb.with_eta(fx.job_events(t), ["task_id"])
    return eta.withColumns({
        "avg_ms": F.floor(F.col("avg_sec") * 1000), "left_ms": F.floor(F.col("left_sec") * 1000)
    })


@query("g8_stage_percent", "event_id:l stage_pct:l", with_tables("job_events", """
    SELECT event_id, CAST(trunc(done * 100 / total) AS BIGINT) AS stage_pct FROM (
        SELECT event_id, row_number() OVER (PARTITION BY step ORDER BY ts, event_id) AS done,
               count(*) OVER (PARTITION BY step) AS total FROM job_events)"""))
def g8(t):
    return jb.stage_percent(fx.job_events(t), ["step"])


@query("g9_log_tail", "event_id:l msg:s", with_tables("job_events", """
    SELECT event_id, msg FROM job_events ORDER BY ts DESC, event_id DESC LIMIT 5000"""))
def g9(t):
    return jb.log_tail(fx.job_events(t))


@query("i4_without_failed", "task_id:l", with_tables("tasks", f"SELECT task_id FROM tasks WHERE NOT {_BROKE}"))
def i4(t):
    tasks = fx.tasks(t)
    return jb.without_failed(tasks, tasks.filter(jb._any([K.FAILED])))


def _site(t):
    """A subtitle for tasks by 8 plus 4, its speech if also by 3, a dub folder for tasks by 10 plus 5, a mix for those by 7."""
    tasks, k = fx.tasks(t), F.col("task_id")
    name = F.col("source_name")
    print_of = tx.fingerprint(name)
    kinds = (
        (k % 8 == 4, F.lit("/subs"), F.concat(name, F.lit(".lrc"))),
        ((k % 8 == 4) & (k % 3 == 0), F.concat(F.lit("/ws/"), print_of), F.lit("0001.wav")),
        (k % 10 == 5, F.concat(F.lit("/dub/"), name), F.lit("0001.wav")),
        (k % 7 == 0, F.concat(tx.dir_name(F.col("source_path")), F.lit(f"/{K.BILINGUAL_DIR}")), F.concat(name, F.lit(f"{K.MIXED_SUFFIX}.mp4"))),
    )
    rows = [tasks.filter(when).select(*fx.inventory_row(folder, file)) for when, folder, file in kinds]
    inventory = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    prints = tasks.select(F.concat(F.lit("/subs/"), name, F.lit(".lrc")).alias("path"), print_of.alias("fingerprint"))
    return tr.Site(inventory, prints, "/ws")


_FOUND = """
    SELECT *, task_id % 8 = 4 AS sub, task_id % 10 = 5 AS dub, task_id % 8 = 4 AND task_id % 3 = 0 AS spoken,
           task_id % 7 = 0 AND NOT (from_folder AND dir LIKE '/jobs/双语-%') AS mixed,
           '/subs/' || source_name || '.lrc' AS sub_path, '/dub/' || source_name AS dub_path,
           '/ws/' || substr(md5(source_name), 1, 8) AS speech_path, dir || '/双语/' || source_name || '_mixed.mp4' AS mix_path
    FROM full_tasks"""


# Subtitles are given for tasks by 4 and dub folders for those by 5; half of each are gone.
@query("l1_auto_skip", _SPEC, _full(
    f"({_FOUND})",
    s1="CASE WHEN sub THEN 'skipped' ELSE s1 END", o1="CASE WHEN sub THEN sub_path ELSE o1 END",
    s2="CASE WHEN dub OR spoken THEN 'skipped' ELSE s2 END",
    o2="CASE WHEN dub THEN dub_path WHEN spoken THEN speech_path ELSE o2 END",
    s3="CASE WHEN mixed THEN 'skipped' ELSE s3 END", o3="CASE WHEN mixed THEN mix_path ELSE o3 END"))
def l1(t):
    k = F.col("task_id")
    tasks = _full_tasks(t).withColumns({
        "custom_subtitle": F.when(k % 4 == 0, F.concat(F.lit("/subs/"), "source_name", F.lit(".lrc"))).otherwise(""),
        "custom_mix_folder": F.when(k % 5 == 0, F.concat(F.lit("/dub/"), "source_name")).otherwise(""),
    })
    return tr.detect_and_skip(tasks, _site(t))


@query("l2_rerun", _SPEC, _full("full_tasks", s2="'pending'", s3="'pending'", o2="''", o3="''", e2="''"))
def l2(t):
    return tr.rerun(_full_tasks(t), 2)


_NOFIN = "CASE WHEN {0} AND NOT ({1} " + _FIN + ") THEN 'pending' ELSE {1} END"


# Tasks by 3 get a subtitle, which is there for some, or lose theirs; then they are looked at anew.
@query("l3_new_subtitle", _SPEC, _full(
    f"(SELECT *, hit AND NOT gone AND sub AS there FROM (SELECT *, task_id % 3 = 0 AS hit, task_id % 6 = 3 AS gone FROM ({_FOUND})))",
    s1="CASE WHEN there THEN 'skipped' WHEN gone AND s1 = 'skipped' THEN 'pending' ELSE s1 END",
    o1="CASE WHEN there THEN sub_path WHEN hit THEN '' ELSE o1 END", e1="CASE WHEN hit THEN '' ELSE e1 END",
    s2="CASE WHEN there AND spoken THEN 'skipped' ELSE " + _NOFIN.format("hit", "s2") + " END",
    o2="CASE WHEN there AND spoken THEN speech_path ELSE o2 END",
    s3="CASE WHEN hit AND mixed THEN 'skipped' ELSE " + _NOFIN.format("hit", "s3") + " END",
    o3="CASE WHEN hit AND mixed THEN mix_path ELSE o3 END"))
def l3(t):
    tasks = _full_tasks(t)
    path = F.concat(F.lit("/subs/"), "source_name", F.lit(".lrc"))
    updates = tasks.filter(F.col("task_id") % 3 == 0).select(
        "task_id", F.when(F.col("task_id") % 6 == 3, "").otherwise(path).alias("custom_subtitle")
    )
    return tr.set_subtitle(tasks, updates, _site(t))


@query("l4_new_dub_folder", _SPEC, _full(
    f"(SELECT *, task_id % 3 = 0 AS hit FROM ({_FOUND}))",
    s2="CASE WHEN hit AND dub THEN 'skipped' WHEN hit AND s2 <> 'done' THEN 'pending' ELSE s2 END",
    o2="CASE WHEN hit AND dub THEN dub_path WHEN hit AND s2 <> 'done' THEN '' ELSE o2 END",
    s3="CASE WHEN hit AND mixed THEN 'skipped' WHEN hit AND s3 <> 'done' THEN 'pending' ELSE s3 END",
    o3="CASE WHEN hit AND mixed THEN mix_path WHEN hit AND s3 <> 'done' THEN '' ELSE o3 END"))
def l4(t):
    tasks = _full_tasks(t)
    updates = tasks.filter(F.col("task_id") % 3 == 0).select(
        "task_id", F.concat(F.lit("/dub/"), "source_name").alias("custom_mix_folder")
    )
    return tr.set_dub_folder(tasks, updates, _site(t))


# Events of users as results of the tasks with the same number.
@query("l5_step_results", _SPEC, with_tables("tasks job_events", """
    SELECT t.task_id, {s}, {o}, {e} FROM full_tasks t LEFT JOIN r1 USING (task_id) LEFT JOIN r2 USING (task_id)
    LEFT JOIN r3 USING (task_id)""".format(
        s=", ".join(f"CASE WHEN r{s}.ok THEN 'done' WHEN NOT r{s}.ok THEN 'failed' ELSE s{s} END AS s{s}_status" for s in K.STEPS),
        o=", ".join(f"CASE WHEN r{s}.ok THEN r{s}.msg ELSE o{s} END AS s{s}_output" for s in K.STEPS),
        e=", ".join(f"CASE WHEN NOT r{s}.ok THEN r{s}.msg ELSE e{s} END AS s{s}_error" for s in K.STEPS)),
    full_tasks=_FULL,
    **{f"r{s}": f"""
        SELECT CAST(task_id AS BIGINT) AS task_id, arg_max(ok, (ts, event_id)) AS ok, arg_max(msg, (ts, event_id)) AS msg
        FROM job_events WHERE step = {s} GROUP BY 1""" for s in K.STEPS}))
def l5(t):
    events = fx.job_events(t).withColumn("task_id", F.col("task_id").cast("long"))
    return tr.apply_results(_full_tasks(t), events)


# Groups ending in 0 go with their tasks; each customer without an order gets a new task.
@query("l6_add_and_remove", "task_id:l group_id:s from_folder:b import_folder:s", with_tables("tasks", """
    SELECT task_id, group_id, from_folder, CASE WHEN from_folder THEN dir ELSE '' END AS import_folder
    FROM tasks WHERE CAST(group_id AS BIGINT) % 10 <> 0
    UNION ALL SELECT -1 - c_custkey, CAST(c_custkey AS VARCHAR), true, '/import/' || c_custkey FROM customer
    WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT group_id FROM tasks)"""))
def l6(t):
    groups = t.customer.select(
        F.col("c_custkey").cast("string").alias("group_id"),
        F.concat(F.lit("/import/"), F.col("c_custkey").cast("string")).alias("folder_path"),
    )
    tasks = fx.tasks(t).select("task_id", "group_id", "from_folder", "import_folder")
    gone = groups.filter(F.col("group_id").cast("long") % 10 == 0)
    kept, _ = tr.remove_groups(tasks, groups, gone)
    new = groups.join(tasks.select("group_id"), "group_id", "left_anti").select(
        (-1 - F.col("group_id").cast("long")).alias("task_id"), "group_id", F.lit(False).alias("from_folder"),
        F.lit("").alias("import_folder"),
    )
    return tr.add_tasks(kept, new, groups)
