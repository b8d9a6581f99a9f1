"""Queries on matching by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.scan import global_rank
from ..operators import matching as ma
from ..sources import files as fl
from . import fixtures as fx
from .oracle import natural, with_tables
from .registry import query


@query("e1_matching_subtitles", "doc_id:l subtitle:s", with_tables("subs", """
    SELECT doc_id, CASE WHEN kind < 2 THEN dir || '/' || name END AS subtitle FROM subs"""))
def e1(t):
    return ma.match_subtitles(fx.media_files(t), fx.subtitle_files(t))


# Output files: exact for a third, the name inside a longer one for another third, a note for the rest.
_OUTPUTS = """
    SELECT doc_id, source AS folder, CASE doc_id % 3 WHEN 0 THEN 'doc' || doc_id || '.lrc'
        WHEN 1 THEN 'x-doc' || doc_id || '-y.lrc' ELSE 'doc' || doc_id || '.md' END AS name FROM documents"""


def _outputs(t):
    d = F.concat(F.lit("doc"), F.col("doc_id").cast("string"))
    name = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(d, F.lit(".lrc")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("x-"), d, F.lit("-y.lrc")))
        .otherwise(F.concat(d, F.lit(".md")))
    )
    return t.documents.select("doc_id", F.col("source").alias("folder"), name.alias("name"))


@query("e2_batch_outputs", "task_id:l output:s", with_tables("", f"""
    SELECT t.doc_id AS task_id, coalesce(any_value(e.name), arg_min(o.name, ({natural('o.name')}, o.name))) AS output
    FROM (SELECT doc_id, source AS folder, 'doc' || doc_id AS name FROM documents) t
    LEFT JOIN outputs e ON e.folder = t.folder AND e.name = t.name || '.lrc'
    LEFT JOIN outputs o ON o.folder = t.folder AND o.name LIKE '%.lrc' AND contains(o.name, t.name) AND e.name IS NULL
    GROUP BY t.doc_id""", outputs=_OUTPUTS))
def e2(t):
    tasks = t.documents.select(
        F.col("doc_id").alias("task_id"), F.col("source").alias("folder"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_name"),
    )
    return ma.match_batch_outputs(tasks, _outputs(t).select("folder", "name"))


@query("e3_folder_outputs", "task_id:l output:s", with_tables("", f"""
    SELECT t.doc_id AS task_id, coalesce(e.name, f.name) AS output
    FROM (SELECT doc_id, source AS folder, 'doc' || doc_id AS name FROM documents) t
    LEFT JOIN outputs e ON e.folder = t.folder AND e.name = t.name || '.lrc'
    LEFT JOIN (SELECT folder, arg_min(name, ({natural('name')}, name)) AS name FROM outputs
               WHERE name LIKE '%.lrc' GROUP BY folder) f ON f.folder = t.folder""", outputs=_OUTPUTS))
def e3(t):
    tasks = t.documents.select(
        F.col("doc_id").alias("task_id"), F.col("source").alias("dir"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source_name"),
    )
    return ma.match_folder_outputs(tasks, _outputs(t).select(F.col("folder").alias("dir"), "name"))


@query("e4_dropped_subtitles", "path:s task_id:s match_kind:s", with_tables("", """
    SELECT '/drop/' || d.doc_id || '/' || d.source || '.lrc' AS path, coalesce(CAST(q.task AS VARCHAR), 'cur') AS task_id,
           CASE WHEN q.task IS NULL THEN 'current' ELSE 'name' END AS match_kind
    FROM documents d LEFT JOIN q ON q.source = d.source""",
    q="SELECT source, min(doc_id) AS task FROM documents WHERE source < 'src5' GROUP BY source"))
def e4(t):
    subs = t.documents.select(
        F.concat(F.lit("/drop/"), F.col("doc_id").cast("string"), F.lit("/"), "source", F.lit(".lrc")).alias("path"),
        F.col("source").alias("stem"),
    )
    tasks = t.documents.filter(F.col("source") < "src5").select(
        F.col("doc_id").cast("string").alias("task_id"), F.col("source").alias("source_name"),
        F.col("doc_id").alias("queue_pos"),
    )
    return ma.match_dropped_subtitles(subs, tasks, "cur")


# Outputs for two tasks of three: in the sub-folder, or beside it with the prefix.
_MIXES = """
    SELECT task_id, CASE WHEN task_id % 3 = 0 THEN dir || '/双语/' || source_name || '_mixed.mp4'
        WHEN from_folder AND dir LIKE '/jobs/双语-%' THEN dir || '/' || source_name || '.mp3'
        WHEN from_folder THEN '/jobs/双语-' || substr(dir, 7) || '/' || source_name || '.mp3' END AS mix_output
    FROM tasks WHERE task_id % 3 < 2"""


@query("e8_mix_outputs", "task_id:l mix_output:s", with_tables("tasks", """
    SELECT t.task_id, CASE WHEN t.task_id % 3 = 0 AND t.from_folder AND t.dir LIKE '/jobs/双语-%' THEN NULL
                           ELSE m.mix_output END AS mix_output
    FROM tasks t LEFT JOIN mixes m USING (task_id)""", mixes=_MIXES))
def e8(t):
    tasks = fx.tasks(t)
    src = tx.dir_name(F.col("source_path"))
    prefixed = tx.base_name(src).startswith(K.BILINGUAL_PREFIX)
    sibling = F.when(prefixed, src).otherwise(F.concat(F.lit(f"/jobs/{K.BILINGUAL_PREFIX}"), tx.base_name(src)))
    folder = F.when(F.col("task_id") % 3 == 0, F.concat(src, F.lit("/双语"))).when(
        (F.col("task_id") % 3 == 1) & F.col("from_folder"), sibling
    )
    name = F.concat("source_name", F.when(F.col("task_id") % 3 == 0, "_mixed.mp4").otherwise(".mp3"))
    inventory = tasks.filter(folder.isNotNull()).select(*fx.inventory_row(folder, name))
    return ma.detect_mix_outputs(tasks, inventory)


# Of the task sources a third is where it should be, a third lies under the toggled folder, a third is gone.
_TOGGLED = "CASE WHEN dir LIKE '/jobs/双语-%' THEN '/jobs/' || substr(dir, 10) ELSE '/jobs/双语-' || substr(dir, 7) END"


@query("e10_repaired_paths", "task_id:l resolved_path:s path_state:s", with_tables("tasks", f"""
    SELECT task_id, CASE task_id % 3 WHEN 0 THEN source_path
                         WHEN 1 THEN {_TOGGLED} || '/' || source_name || '.mp4' END AS resolved_path,
           CASE task_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' ELSE 'missing' END AS path_state
    FROM tasks"""))
def e10(t):
    tasks = fx.tasks(t).select("task_id", "source_path")
    there = F.when(F.col("task_id") % 3 == 0, F.col("source_path")).when(
        F.col("task_id") % 3 == 1, F.get(tx.prefix_variants(F.col("source_path")), F.lit(0))["path"]
    )
    inventory = tasks.select(there.alias("path")).filter(F.col("path").isNotNull())
    return ma.repair_paths(tasks, inventory)


# Folders of customers with an even number are renamed.
@query("e16_renamed_paths", "task_id:l source_path:s import_folder:s", with_tables("tasks", """
    SELECT task_id, CASE WHEN moved THEN '/new' || source_path ELSE source_path END AS source_path,
           CASE WHEN moved THEN '/new' || dir WHEN from_folder THEN dir ELSE '' END AS import_folder
    FROM (SELECT *, CAST(group_id AS BIGINT) % 2 = 0 AS moved FROM tasks)"""))
def e16(t):
    tasks = fx.tasks(t).select("task_id", "group_id", "source_path", "import_folder")
    old = tx.dir_name(F.col("source_path"))
    renames = tasks.filter(F.col("group_id").cast("long") % 2 == 0).select(
        old.alias("old"), F.concat(F.lit("/new"), old).alias("new")
    ).distinct()
    return ma.apply_renames(tasks, renames, "task_id")


@query("f12_group_inputs", "folder:s n_tasks:l n_names:l", with_tables("tasks", """
    SELECT dir AS folder, count(*) AS n_tasks, count(DISTINCT source_name) AS n_names FROM tasks GROUP BY dir"""))
def f12(t):
    return ma.group_inputs(fx.tasks(t))


@query("f13_folders_to_rename", "folder:s new_folder:s", with_tables("tasks", """
    SELECT DISTINCT dir AS folder, '/jobs/双语-' || substr(dir, 7) AS new_folder FROM tasks
    WHERE from_folder AND s3 IN ('done', 'skipped') AND dir NOT LIKE '/jobs/双语-%'"""))
def f13(t):
    return ma.folders_to_rename(fx.tasks(t))


@query("h1_natural_order", "c_custkey:l pos:l", f"""
    SELECT c_custkey, row_number() OVER (ORDER BY {natural("'c' || c_custkey")}, c_custkey) AS pos FROM customer""")
def h1(t):
    names = t.customer.select("c_custkey", F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"))
    return ma.natural_rank(names, "name", "c_custkey")


@query("d3_natural_keys", "p_partkey:l pos:l", f"""
    SELECT p_partkey, row_number() OVER (ORDER BY {natural("p_brand")}, p_partkey) AS pos FROM part""")
def d3(t):
    return ma.natural_rank(t.part.select("p_partkey", "p_brand"), "p_brand", "p_partkey")


# Groups are customers; orders of customers with an odd number stand alone.
@query("h2_tree_order", "kind:s id:s pos:l", with_tables("tasks", f"""
    SELECT kind, id, row_number() OVER (ORDER BY {natural('top')}, top, gid, child, {natural('name')}, id) AS pos FROM (
        SELECT 'group' AS kind, gid AS id, 'task' || gid AS name, 'task' || gid AS top, gid, 0 AS child
        FROM (SELECT DISTINCT group_id AS gid FROM tasks WHERE CAST(group_id AS BIGINT) % 2 = 0)
        UNION ALL SELECT 'task', CAST(task_id AS VARCHAR), source_name, 'task' || group_id, group_id, 1
        FROM tasks WHERE CAST(group_id AS BIGINT) % 2 = 0
        UNION ALL SELECT 'task', CAST(task_id AS VARCHAR), source_name, source_name, '', 0
        FROM tasks WHERE CAST(group_id AS BIGINT) % 2 = 1)"""))
def h2(t):
    tasks = fx.tasks(t).select(
        F.col("task_id").cast("string").alias("task_id"), "source_name",
        F.when(F.col("group_id").cast("long") % 2 == 0, F.col("group_id")).otherwise("").alias("group_id"),
    )
    groups = tasks.filter(F.col("group_id") != "").select("group_id").distinct().withColumn(
        "group_name", F.concat(F.lit("task"), "group_id")
    )
    return ma.tree_rank(tasks, groups)


@query("h3_sequence_order", "doc_id:l idx:l pos:l", with_tables("plain", """
    SELECT doc_id, idx, row_number() OVER (ORDER BY idx, doc_id) AS pos FROM plain"""))
def h3(t):
    return global_rank(fx.line_requests(t).select("doc_id", "idx"), ["idx", "doc_id"], "pos")


@query("h4_first_per_key", "source:s first_doc:l", "SELECT source, arg_min(doc_id, doc_id) AS first_doc FROM documents GROUP BY source")
def h4(t):
    return t.documents.groupBy("source").agg(F.min_by("doc_id", "doc_id").alias("first_doc"))


@query("i3_distinct_folders", "dir:s", with_tables("media", "SELECT DISTINCT dir FROM media"))
def i3(t):
    return fx.media_files(t).select("dir").distinct()


@query("i5_supported_extensions", "ext:s n:l", with_tables("media subs", """
    SELECT ext, count(*) AS n FROM media WHERE ext IN (SELECT DISTINCT ext FROM media) GROUP BY ext"""))
def i5(t):
    files = fx.media_files(t).unionByName(fx.subtitle_files(t))
    return fl.media_inventory(files).groupBy("ext").agg(F.count(F.lit(1)).alias("n"))
