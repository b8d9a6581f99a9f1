"""Ranked matching of media, subtitles and outputs by name.

"Begins with" and "contains" are turned into equality: the side with the longer name lists the shorter
names it could match, and both sides join on (folder, name). No folder is ever joined with itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.scan import global_rank
from ..session import freeze


def order_index(ext: Column, order: Sequence[str]) -> Column:
    """Place of an extension in an order, NULL when it is not in it."""
    at = F.array_position(F.array(*[F.lit(e) for e in order]), ext)
    return F.when(at > 0, at)


def match_subtitles(media: DataFrame, inventory: DataFrame) -> DataFrame:
    """Media (dir, stem, ..) with the best subtitle of the same folder in ``subtitle``, else NULL.

    ``stem.lrc`` > ``stem.srt`` > ``stem.vtt``, then the first file ``stem.*.ext`` in natural order;
    letter case does not count.
    """
    low = F.lower(F.col("name"))
    subs = inventory.select("dir", "name", order_index(F.col("ext"), K.SUBTITLE_EXTS).alias("_e")).filter(
        F.col("_e").isNotNull()
    )

    def stems(pieces: Column) -> Column:
        whole = F.size(pieces) - 1
        return F.transform(
            F.sequence(F.lit(1), whole),
            lambda n: F.struct(
                F.array_join(F.slice(pieces, F.lit(1), n), ".").alias("prefix"),
                F.when(n == whole, 0).otherwise(1).alias("loose"),
            ),
        )

    prefixes = tx.bind(F.split(low, r"\."), stems)
    options = subs.select("dir", "name", "_e", F.explode(prefixes).alias("_p")).select(
        "dir",
        F.col("_p.prefix").alias("_stem"),
        F.struct(
            F.col("_p.loose").alias("loose"),
            F.when(F.col("_p.loose") == 0, F.col("_e")).otherwise(F.lit(0)).alias("e"),
            tx.natural_key(F.col("name")).alias("nk"),
            F.col("name").alias("name"),
        ).alias("_o"),
    )
    best = options.groupBy("dir", "_stem").agg(F.min("_o").alias("_o")).select(
        "dir", "_stem", F.col("_o.name").alias("_sub")
    )
    return (
        media.withColumn("_stem", F.lower(F.col("stem")))
        .join(best, ["dir", "_stem"], "left")
        .withColumn("subtitle", tx.join_path(F.col("dir"), F.col("_sub")))
        .drop("_stem", "_sub")
    )


#: Characters of a name's parts in the index of :func:`match_batch_outputs`.
FRAGMENT = 4


def _fragments(name: Column, size: Column) -> Column:
    """The distinct parts of a name that have ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(name) - size + 1)
    return F.array_distinct(F.transform(starts, lambda at: F.substring(name, at, size)))


def match_batch_outputs(
    tasks: DataFrame, outputs: DataFrame, group: str = "folder", formats: Sequence[str] = ("lrc",)
) -> DataFrame:
    """Tasks (group, task_id, source_name) with their output file of the same group in ``output``.

    The exact ``name.fmt`` in format order comes first, then the first file in natural order whose name
    contains the task's name. For the second rule files are indexed by the parts of ``FRAGMENT`` characters of their
    names, one row for each place at most. A task looks up the part of its name that the fewest files have, and what it
    finds there is compared in full; a part that no file has settles that there is no match. A name shorter than a part
    is its own part, and only groups with such names list parts of that length.
    """
    offered = outputs.select(group, "name", order_index(tx.ext_of(F.col("name")), formats).alias("_f")).filter(
        F.col("_f").isNotNull()
    )
    exact = offered.groupBy(group, tx.stem_of(F.col("name")).alias("source_name")).agg(
        F.min_by("name", "_f").alias("_exact")
    )
    first = tasks.join(exact, [group, "source_name"], "left")
    size = F.least(F.length("source_name"), F.lit(FRAGMENT))
    wanted = first.filter(F.col("_exact").isNull() & (size > 0)).select(group, "source_name", size.alias("_size")).distinct()
    # At most FRAGMENT sizes in a group.
    sizes = wanted.groupBy(group).agg(F.collect_set("_size").alias("_sizes"))
    fitting = F.filter("_sizes", lambda n: n <= F.length("name"))
    parts = F.flatten(F.transform(fitting, lambda n: _fragments(F.col("name"), n)))
    index = freeze(
        offered.select(group, "name").distinct().join(sizes, group).select(group, "name", F.explode(parts).alias("_part"))
    )
    counts = index.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.select(group, "source_name", F.explode(_fragments(F.col("source_name"), F.col("_size"))).alias("_part"))
    rarest = (
        asked.join(counts, [group, "_part"], "left")
        .groupBy(group, "source_name")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_part").alias("part"))).alias("_r"))
        .filter(F.col("_r.n") > 0)
        .select(group, "source_name", F.col("_r.part").alias("_part"))
    )
    loose = (
        rarest.join(index, [group, "_part"])
        .filter(F.contains("name", "source_name"))
        .groupBy(group, "source_name")
        .agg(F.min(F.struct(tx.natural_key(F.col("name")).alias("nk"), F.col("name").alias("name"))).alias("_l"))
        .select(group, "source_name", F.col("_l.name").alias("_loose"))
    )
    return (
        first.join(loose, [group, "source_name"], "left")
        .withColumn("output", F.coalesce("_exact", "_loose"))
        .drop("_exact", "_loose")
    )


def match_folder_outputs(
    tasks: DataFrame, outputs: DataFrame, formats: Sequence[str] = ("lrc",)
) -> DataFrame:
    """Tasks (dir, source_name) with the exact output, else the first file of the folder in a format.

    The folder's first file is found once per folder and looked up, since a folder may hold a large share of
    the tasks.
    """
    offered = outputs.select(
        "dir", "name", order_index(tx.ext_of(F.col("name")), formats).alias("_f")
    ).filter(F.col("_f").isNotNull())
    exact = offered.groupBy("dir", tx.stem_of(F.col("name")).alias("source_name")).agg(
        F.min_by("name", "_f").alias("_exact")
    )
    first = offered.groupBy("dir").agg(
        F.min(F.struct(tx.natural_key(F.col("name")).alias("nk"), F.col("name").alias("name"))).alias("_o")
    ).select("dir", F.col("_o.name").alias("_first"))
    named = tasks.join(exact, ["dir", "source_name"], "left")
    return (
        named.join(first, "dir", "left")
        .withColumn("output", F.coalesce("_exact", "_first"))
        .drop("_exact", "_first")
    )


def match_dropped_subtitles(
    subs: DataFrame, tasks: DataFrame, current_task: str | None = None
) -> DataFrame:
    """Dropped subtitles (path, stem) with the task they go to.

    The first task in queue order with that name, else the current task, else none; ``match_kind`` is
    name, current or orphan. ``tasks`` has (task_id, source_name, queue_pos).
    """
    firsts = tasks.groupBy(F.col("source_name").alias("stem")).agg(
        F.min_by("task_id", "queue_pos").alias("_task")
    )
    fallback = F.lit(current_task).cast("string")
    return (
        subs.join(firsts, "stem", "left")
        .withColumn("task_id", F.coalesce(F.col("_task"), fallback))
        .withColumn(
            "match_kind",
            F.when(F.col("_task").isNotNull(), "name")
            .when(F.col("task_id").isNotNull(), "current")
            .otherwise("orphan"),
        )
        .drop("_task")
    )


def detect_mix_outputs(tasks: DataFrame, inventory: DataFrame) -> DataFrame:
    """Tasks with an existing mixed output in ``mix_output``, over the three folder layouts."""
    ends = F.col("stem").endswith(K.MIXED_SUFFIX)
    bare = F.when(
        ends, F.substring(F.col("stem"), F.lit(1), F.length("stem") - len(K.MIXED_SUFFIX))
    ).otherwise(F.col("stem"))
    found = (
        inventory.filter(F.col("ext").isin(*K.MIX_OUTPUT_EXTS))
        .groupBy(F.col("dir").alias("_dir"), bare.alias("source_name"))
        # Names with one stem differ only behind it, where natural order is letter order.
        .agg(F.min_by("path", F.struct(F.lower("name"), "name")).alias("_path"))
    )
    src, leaf, parent = F.col("_src"), F.col("_leaf"), F.col("_parent")
    sub = tx.join_path(src, F.lit(K.BILINGUAL_DIR))
    sibling = tx.join_path(parent, F.concat(F.lit(K.BILINGUAL_PREFIX), leaf))
    folders = (
        F.when(F.col("from_folder") & leaf.startswith(K.BILINGUAL_PREFIX), F.array(src))
        .when(F.col("from_folder") & (parent != "") & (leaf != ""), F.array(sub, sibling))
        .otherwise(F.array(sub))
    )
    picked = (
        tasks.select("task_id", "source_name", "from_folder", tx.dir_name(F.col("source_path")).alias("_src"))
        .withColumns({"_leaf": tx.base_name(src), "_parent": tx.dir_name(src)})
        .select("task_id", "source_name", F.posexplode(folders).alias("_at", "_dir"))
        .join(found, ["_dir", "source_name"])
        .groupBy("task_id")
        .agg(F.min_by("_path", "_at").alias("mix_output"))
    )
    return tasks.join(picked, "task_id", "left")


def detect_speech(tasks: DataFrame, clips: DataFrame) -> DataFrame:
    """Tasks (workspace, fingerprint, ..) whose fingerprint folder holds at least one wav."""
    ready = (
        clips.filter(F.col("name").endswith(".wav")).select("dir").distinct().withColumnRenamed("dir", "_dir")
    )
    folder = tx.join_path(F.col("workspace"), F.col("fingerprint"))
    # Copies of one subtitle share a folder, so that key may be hot.
    found = tasks.withColumn("_dir", folder).join(ready, "_dir", "left_semi")
    return found.withColumnRenamed("_dir", "speech_dir")


def repair_paths(rows: DataFrame, inventory: DataFrame, key: str = "task_id", path: str = "source_path") -> DataFrame:
    """Rows with ``resolved_path``: the path if it exists, else the nearest prefix variant that does.

    ``path_state`` is ok, repaired or missing.
    """
    files = inventory.select(F.col("path").alias("_try")).distinct()
    known = rows.select(key, F.col(path).alias("_try")).join(
        files.withColumn("_ok", F.lit(True)), "_try", "left"
    )
    # An existing path keeps one option, itself at depth -1; only the others list their variants.
    variants = F.when(
        F.col("_ok").isNotNull(), F.array(F.struct(F.lit(-1).alias("depth"), F.col("_try").alias("path")))
    ).otherwise(tx.prefix_variants(F.col("_try")))
    tried = known.select(key, F.explode(variants).alias("_v")).select(
        key, "_v.depth", F.col("_v.path").alias("_try")
    )
    best = tried.join(files, "_try", "left_semi").groupBy(key).agg(
        F.min(F.struct("depth", "_try")).alias("_b")
    )
    return (
        rows.join(best, key, "left")
        .withColumn("resolved_path", F.col("_b._try"))
        .withColumn(
            "path_state",
            F.when(F.col("_b").isNull(), "missing").when(F.col("_b.depth") < 0, "ok").otherwise("repaired"),
        )
        .drop("_b")
    )


#: Paths below one folder that :func:`apply_renames` hands to one share.
CROWD = 100_000


def apply_renames(rows: DataFrame, renames: DataFrame, key: str, path: str = "source_path") -> DataFrame:
    """Paths under a renamed folder (old, new) moved with it; the deepest renamed folder counts.

    Each path lists its folders and joins on equality; only rows that move come back from the join. A folder high up
    may stand above most paths. Folders with more than ``CROWD`` paths below are counted first, their paths dealt into
    shares by key, and a rename of such a folder goes to all its shares.
    """
    listed = rows.select(key, F.col(path).alias("_path"), F.explode(tx.ancestors(F.col(path))).alias("old"))
    above = listed.filter(F.col("old") != "")
    # At most one folder for CROWD listed ones.
    crowded = F.broadcast(
        above.groupBy("old").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CROWD)
        .select("old", F.ceil(F.col("_n") / CROWD).alias("_shares"))
    )
    shares = F.coalesce("_shares", F.lit(1))
    dealt = above.join(crowded, "old", "left").withColumn("_share", F.pmod(F.xxhash64(key), shares)).drop("_shares")
    wanted = renames.select("old", "new").join(crowded, "old", "left").select(
        "old", "new", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("_share")
    )
    hits = dealt.join(wanted, ["old", "_share"], "inner")
    moved = hits.groupBy(key).agg(
        F.max_by(F.struct("old", "new", "_path"), F.length("old")).alias("_m")
    ).select(
        key,
        F.concat(F.col("_m.new"), F.substring(F.col("_m._path"), F.length("_m.old") + 1, F.length("_m._path"))).alias("_moved"),
        F.col("_m.new").alias("_folder"),
    )
    out = rows.join(moved, key, "left").withColumn(path, F.coalesce("_moved", path))
    if "import_folder" in rows.columns:
        out = out.withColumn("import_folder", F.coalesce("_folder", "import_folder"))
    return out.drop("_moved", "_folder")


def input_folder() -> Column:
    """the import folder of a folder import, else the folder of the source."""
    return F.when(
        F.col("from_folder") & (F.col("import_folder") != ""), F.col("import_folder")
    ).otherwise(tx.dir_name(F.col("source_path")))


def group_inputs(tasks: DataFrame) -> DataFrame:
    """tasks and names per input folder."""
    return tasks.groupBy(input_folder().alias("folder")).agg(
        F.count(F.lit(1)).alias("n_tasks"), F.countDistinct("source_name").alias("n_names")
    )


def folders_to_rename(tasks: DataFrame) -> DataFrame:
    """Folders of finished folder imports that lack the prefix, with the new name."""
    leaf = tx.base_name(F.col("folder"))
    return (
        tasks.filter(F.col("from_folder") & F.col("s3_status").isin(*K.FINISHED))
        .select(input_folder().alias("folder"))
        .distinct()
        .filter(~leaf.startswith(K.BILINGUAL_PREFIX))
        .withColumn(
            "new_folder",
            tx.join_path(tx.dir_name(F.col("folder")), F.concat(F.lit(K.BILINGUAL_PREFIX), leaf)),
        )
    )


def natural_rank(rows: DataFrame, name: str, tie: str, out: str = "pos") -> DataFrame:
    """H1: place in natural order of ``name``, ties by ``tie`` (insertion order)."""
    keyed = rows.withColumn("_nk", tx.natural_key(F.col(name)))
    return global_rank(keyed, ["_nk", tie], out).drop("_nk")


def tree_rank(tasks: DataFrame, groups: DataFrame, out: str = "pos") -> DataFrame:
    """H2: one list of groups and loose tasks by name, each group followed by its tasks by name.

    ``tasks`` has (task_id, source_name, group_id), ``groups`` has (group_id, group_name).
    """
    named = tasks.filter(F.col("group_id") != "")
    children = named.join(groups, "group_id", "inner").select(
        F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("source_name").alias("name"),
        F.col("group_name").alias("_top"), "group_id", F.lit(1).alias("_child"),
    )
    loose = tasks.filter(F.col("group_id") == "").select(
        F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("source_name").alias("name"),
        F.col("source_name").alias("_top"), F.lit("").alias("group_id"), F.lit(0).alias("_child"),
    )
    heads = groups.select(
        F.lit("group").alias("kind"), F.col("group_id").alias("id"), F.col("group_name").alias("name"),
        F.col("group_name").alias("_top"), "group_id", F.lit(0).alias("_child"),
    )
    rows = heads.unionByName(loose).unionByName(children)
    keyed = rows.withColumn("_tk", tx.natural_key(F.col("_top"))).withColumn(
        "_nk", tx.natural_key(F.col("name"))
    )
    # Tops with equal names stay whole: the group id comes before the child flag.
    ranked = global_rank(keyed, ["_tk", "_top", "group_id", "_child", "_nk", "id"], out)
    return ranked.drop("_tk", "_nk", "_top", "_child")


def resolve_preset(settings: DataFrame) -> DataFrame:
    """Export settings (bitrate, sample_rate, channels) with the preset they equal, else custom."""
    name = F.lit(K.CUSTOM_PRESET)
    for preset, bitrate, rate, channels in reversed(K.PRESETS):
        same = (
            (F.col("bitrate") == bitrate) & (F.col("sample_rate") == rate) & (F.col("channels") == channels)
        )
        name = F.when(same, F.lit(preset)).otherwise(name)
    return settings.withColumn("preset", name)


def preset_parameters(rows: DataFrame, preset: str = "preset") -> DataFrame:
    """Preset names with their bitrate, sample rate and channel count; the table has four rows."""
    table = rows.sparkSession.createDataFrame(
        list(K.PRESETS), f"{preset} string, bitrate string, sample_rate int, channels int"
    )
    return rows.join(F.broadcast(table), preset, "left")
