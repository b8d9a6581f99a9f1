"""Rewrites of the task table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from .matching import detect_mix_outputs


def _set(tasks: DataFrame, **changes: Column) -> DataFrame:
    """Several columns at once, all read from the state before."""
    return tasks.withColumns(changes)


def _out(step: int) -> str:
    return f"s{step}_output"


def _err(step: int) -> str:
    return f"s{step}_error"


def _status(step: int) -> str:
    return f"s{step}_status"


def auto_skip(tasks: DataFrame) -> DataFrame:
    """L1: skip steps whose result is there already.

    Reads what the detection joins found: ``subtitle_found`` (boolean), ``dub_found`` (boolean),
    ``speech_dir`` and ``mix_output`` (NULL when absent). A given subtitle skips step 1; a given dub
    folder skips step 2; without one, speech made from the subtitle does if step 1 is skipped; an existing
    mix skips step 3.
    """
    sub = (F.col("custom_subtitle") != "") & F.col("subtitle_found")
    s1 = F.when(sub, K.SKIPPED).otherwise(F.col("s1_status"))
    dub = (F.col("custom_mix_folder") != "") & F.col("dub_found")
    speech = ~dub & (s1 == K.SKIPPED) & F.col("speech_dir").isNotNull()
    mixed = F.col("mix_output").isNotNull()
    return _set(
        tasks,
        s1_status=s1,
        s1_output=F.when(sub, F.col("custom_subtitle")).otherwise(F.col("s1_output")),
        s2_status=F.when(dub | speech, K.SKIPPED).otherwise(F.col("s2_status")),
        s2_output=F.when(dub, F.col("custom_mix_folder"))
        .when(speech, F.col("speech_dir"))
        .otherwise(F.col("s2_output")),
        s3_status=F.when(mixed, K.SKIPPED).otherwise(F.col("s3_status")),
        s3_output=F.coalesce("mix_output", "s3_output"),
    )


@dataclass(frozen=True)
class Site:
    """What lies where: an inventory (path, dir, name, stem, ext), fingerprints (path, fingerprint) of subtitle files,
    and the folder that holds a speech folder for each fingerprint."""

    inventory: DataFrame
    fingerprints: DataFrame
    workspace: str


#: Shares the tasks with an empty key are dealt into by :func:`look_up`.
EMPTY_SHARES = 1024


def look_up(tasks: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Tasks left joined with ``table`` by ``key``, a field that most tasks may have empty.

    The tasks without a value are dealt into shares by their id, so no task of Spark gets them all; a row of ``table``
    for the empty value is there for every share.
    """
    share = F.pmod(F.xxhash64("task_id"), F.lit(EMPTY_SHARES))
    none = F.coalesce(F.col(key), F.lit("")) == ""
    first, last = F.lit(0).cast("long"), F.lit(EMPTY_SHARES - 1).cast("long")
    dealt = tasks.withColumn("_share", F.when(none, share).otherwise(first))
    copies = F.when(none, F.sequence(first, last)).otherwise(F.array(first))
    wanted = table.filter(F.col(key).isNotNull()).withColumn("_share", F.explode(copies))
    return dealt.join(wanted, [key, "_share"], "left").drop("_share")


def find_inputs(tasks: DataFrame, site: Site, chosen: Column | None = None) -> DataFrame:
    """Tasks with what the site holds for them: ``subtitle_found``, ``dub_found``, ``speech_dir``, ``mix_output``.

    Speech is looked for under the fingerprint of the subtitle that stands for step 1: the given one if it exists,
    else the step's output. For tasks that are not ``chosen`` nothing counts as found.
    """
    pick = F.lit(True) if chosen is None else F.coalesce(chosen, F.lit(False))
    paths = site.inventory.select(F.col("path").alias("custom_subtitle")).distinct().withColumn("_sub", F.lit(True))
    dirs = site.inventory.select(F.col("dir").alias("custom_mix_folder")).distinct().withColumn("_dub", F.lit(True))
    spoken = site.inventory.filter(F.col("name").endswith(".wav")).select(F.col("dir").alias("_speech")).distinct()
    prints = site.fingerprints.select(F.col("path").alias("_text"), tx.join_path(F.lit(site.workspace), F.col("fingerprint")).alias("_speech"))
    speech = prints.join(spoken, "_speech", "left_semi")
    found = look_up(look_up(tasks, paths, "custom_subtitle"), dirs, "custom_mix_folder")
    found = found.withColumn("_text", F.when(F.col("_sub"), F.col("custom_subtitle")).otherwise(F.col("s1_output")))
    found = detect_mix_outputs(look_up(found, speech, "_text"), site.inventory)
    return found.withColumns({
        "subtitle_found": pick & F.col("_sub").isNotNull(), "dub_found": pick & F.col("_dub").isNotNull(),
        "speech_dir": F.when(pick, F.col("_speech")), "mix_output": F.when(pick, F.col("mix_output")),
    }).drop("_sub", "_dub", "_text", "_speech")


def detect_and_skip(tasks: DataFrame, site: Site, chosen: Column | None = None) -> DataFrame:
    """L1 with its joins: look at the site and skip steps whose result is there already."""
    found = auto_skip(find_inputs(tasks, site, chosen))
    return found.drop("subtitle_found", "dub_found", "speech_dir", "mix_output")


def rerun(tasks: DataFrame, step: int, chosen: Column | None = None) -> DataFrame:
    """L2: reset a step and all later ones; only the step's own error is cleared."""
    pick = F.lit(True) if chosen is None else chosen
    changes = {_err(step): F.when(pick, F.lit("")).otherwise(F.col(_err(step)))}
    for s in K.STEPS[step - 1:]:
        changes[_status(s)] = F.when(pick, K.PENDING).otherwise(F.col(_status(s)))
        changes[_out(s)] = F.when(pick, F.lit("")).otherwise(F.col(_out(s)))
    return _set(tasks, **changes)


def _chosen_value(tasks: DataFrame, updates: DataFrame, value: str) -> DataFrame:
    """Tasks with ``_new``: the new value of the tasks in ``updates`` (task_id, value), NULL elsewhere."""
    return tasks.join(updates.select("task_id", F.col(value).alias("_new")), "task_id", "left")


def set_subtitle(tasks: DataFrame, updates: DataFrame, site: Site | None = None) -> DataFrame:
    """L3: a new (or, when empty, removed) subtitle per task in ``updates`` (task_id, custom_subtitle).

    Step 1's output and error are cleared; a removed subtitle un-skips step 1; later steps that are
    neither done nor skipped go back to pending. With ``site`` the updated tasks are looked at anew (L1).
    """
    t = _chosen_value(tasks, updates, "custom_subtitle")
    hit = F.col("_new").isNotNull()
    unskip = hit & (F.col("_new") == "") & (F.col("s1_status") == K.SKIPPED)
    changes = {
        "custom_subtitle": F.coalesce("_new", "custom_subtitle"),
        "s1_status": F.when(unskip, K.PENDING).otherwise(F.col("s1_status")),
        "s1_output": F.when(hit, F.lit("")).otherwise(F.col("s1_output")),
        "s1_error": F.when(hit, F.lit("")).otherwise(F.col("s1_error")),
    }
    for s in (2, 3):
        reset = hit & ~F.col(_status(s)).isin(*K.FINISHED)
        changes[_status(s)] = F.when(reset, K.PENDING).otherwise(F.col(_status(s)))
    return _looked_at(_set(t, **changes), site)


def _looked_at(tasks: DataFrame, site: Site | None) -> DataFrame:
    """Updated tasks (``_new`` not NULL) after a new detection."""
    return (tasks if site is None else detect_and_skip(tasks, site, F.col("_new").isNotNull())).drop("_new")


def set_dub_folder(tasks: DataFrame, updates: DataFrame, site: Site | None = None) -> DataFrame:
    """L4: a new dub folder per task in ``updates`` (task_id, custom_mix_folder).

    Steps 2 and 3 go back to pending with no output unless done. With ``site`` the updated tasks are looked at anew (L1).
    """
    t = _chosen_value(tasks, updates, "custom_mix_folder")
    changes = {"custom_mix_folder": F.coalesce("_new", "custom_mix_folder")}
    for s in (2, 3):
        reset = F.col("_new").isNotNull() & (F.col(_status(s)) != K.DONE)
        changes[_status(s)] = F.when(reset, K.PENDING).otherwise(F.col(_status(s)))
        changes[_out(s)] = F.when(reset, F.lit("")).otherwise(F.col(_out(s)))
    return _looked_at(_set(t, **changes), site)


def latest_results(events: DataFrame) -> DataFrame:
    """Latest result per task as one wide row: r1 .. r3 of struct(ok, msg)."""
    at = F.struct("ts", "event_id")
    aggs = [
        F.max_by(F.struct("ok", "msg"), F.when(F.col("step") == s, at)).alias(f"r{s}") for s in K.STEPS
    ]
    return events.groupBy("task_id").agg(*aggs)


def apply_results(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Fold step results (task_id, step, ts, event_id, ok, msg) into the tasks, latest per step."""
    t = tasks.join(latest_results(events), "task_id", "left")
    changes = {}
    for s in K.STEPS:
        r = F.col(f"r{s}")
        changes[_status(s)] = (
            F.when(r["ok"], K.DONE).when(~r["ok"], K.FAILED).otherwise(F.col(_status(s)))
        )
        changes[_out(s)] = F.when(r["ok"], r["msg"]).otherwise(F.col(_out(s)))
        changes[_err(s)] = F.when(~r["ok"], r["msg"]).otherwise(F.col(_err(s)))
    return _set(t, **changes).drop("r1", "r2", "r3")


def add_tasks(tasks: DataFrame, new: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Add tasks; those of a known group are marked as its folder import."""
    if groups is not None:
        g = groups.select("group_id", F.col("folder_path").alias("_folder"))
        new = new.join(g, "group_id", "left")
        known = F.col("_folder").isNotNull()
        new = _set(
            new,
            from_folder=F.when(known, F.lit(True)).otherwise(F.col("from_folder")),
            import_folder=F.coalesce("_folder", "import_folder"),
        ).drop("_folder")
    return tasks.unionByName(new, allowMissingColumns=True)


def remove_tasks(tasks: DataFrame, gone: DataFrame) -> DataFrame:
    """L6."""
    return tasks.join(gone.select("task_id"), "task_id", "left_anti")


def remove_groups(tasks: DataFrame, groups: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks and groups left after removing groups together with their tasks."""
    ids = gone.select("group_id")
    return tasks.join(ids, "group_id", "left_anti"), groups.join(ids, "group_id", "left_anti")
