"""File scans: timed-text files, media inventories, clip inventories, mixed drops (A1-A5, A10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import constants as K
from ..functions import text as tx


def read_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``binaryFile`` rows: path, modificationTime, length, content."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )


@F.pandas_udf(StringType())
def strict_gbk(content: pd.Series) -> pd.Series:
    """GBK text, NULL where the bytes are not GBK."""

    def one(raw):
        try:
            return None if raw is None else raw.decode("gbk")
        except UnicodeDecodeError:
            return None

    return content.map(one)


def decode_text(files: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """A2: strict UTF-8, else strict GBK, else NULL; a leading BOM is dropped.

    Only bytes that are not UTF-8 are sent to Python. The function counts as non-deterministic so that a
    later filter on the text does not make the optimizer run it twice.
    """
    raw = F.col(content)
    tried = files.withColumn("_utf8", F.is_valid_utf8(raw.cast("string"))).withColumn(
        "_gbk", strict_gbk.asNondeterministic()(F.when(~F.col("_utf8"), raw))
    )
    text = F.when(F.col("_utf8"), raw.cast("string")).otherwise(F.col("_gbk"))
    return tried.withColumn(out, F.ltrim(text, F.lit("\ufeff"))).drop("_utf8", "_gbk")


@F.pandas_udf(StringType())
def decode_console_line(lines: pd.Series) -> pd.Series:
    """A3: UTF-8, else GBK with replacement characters; Spark has no replacing GBK decoder."""

    def one(raw):
        if raw is None:
            return None
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return raw.decode("gbk", errors="replace")

    return lines.map(one)


def line_ranges(
    spark: SparkSession, path: str, pattern: str = "*", range_lines: int = 20_000, recursive: bool = True
) -> DataFrame:
    """A1 for files of any size: (source_id, range_no, format, text, source_version), each row a run of lines.

    A file is read by several tasks, each its own stretch; a row holds ``range_lines`` lines at most, whatever the
    file. Ranges sort by their number (start of the stretch, place in it) and, joined by line ends, are the file without
    its last line end. UTF-8 only; a leading BOM is dropped; extensions other than those of timed text drop out. See
    :func:`cueloom.operators.cue_ranges.parse_ranges`.
    """
    lines = (
        spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(path)
        .select(
            F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.file_block_start").alias("start"),
            F.col("_metadata.file_modification_time").alias("mtime"), F.monotonically_increasing_id().alias("at"), "value",
        )
        .withColumn("format", tx.ext_of(tx.base_name(F.col("source_id"))))
        .filter(F.col("format").isin(*K.CUE_FORMATS))
    )
    # Rows of a task are numbered in the order of lines, so equal parts of that number are runs of lines.
    run = F.floor(F.col("at") / range_lines)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    ranges = lines.groupBy("source_id", "format", "start", run.alias("run")).agg(
        joined.alias("text"), F.max("mtime").alias("mtime")
    )
    number = F.concat_ws("-", F.lpad(F.col("start").cast("string"), 19, "0"), F.lpad(F.col("run").cast("string"), 19, "0"))
    first = (F.col("start") == 0) & F.col("text").startswith("\ufeff")
    return ranges.select(
        "source_id", number.alias("range_no"), "format", F.when(first, F.ltrim("text", F.lit("\ufeff"))).otherwise(F.col("text")).alias("text"),
        F.coalesce(tx.file_version(F.col("mtime")), F.lit("0")).alias("source_version"),
    )


def timed_text_sources(files: DataFrame) -> DataFrame:
    """A1: ``binaryFile`` rows to (source_id, format, text, source_version); other extensions drop out.

    Files that decode neither way are skipped. The version is the modification time in whole seconds.
    """
    ext = tx.ext_of(tx.base_name(F.col("path")))
    wanted = files.select(
        F.col("path").alias("source_id"),
        ext.alias("format"),
        F.coalesce(tx.file_version(F.col("modificationTime")), F.lit("0")).alias("source_version"),
        "content",
    ).filter(F.col("format").isin(*K.CUE_FORMATS))
    return decode_text(wanted).drop("content").filter(F.col("text").isNotNull())


def inventory(files: DataFrame) -> DataFrame:
    """Path parts of every file; the content column is never read."""
    name = tx.base_name(F.col("path"))
    return files.select(
        "path",
        tx.dir_name(F.col("path")).alias("dir"),
        name.alias("name"),
        tx.stem_of(name).alias("stem"),
        tx.ext_of(name).alias("ext"),
        "length",
        F.col("modificationTime").alias("mtime"),
    )


def media_inventory(inv: DataFrame) -> DataFrame:
    """Inventory rows with a media extension."""
    return inv.filter(F.col("ext").isin(*K.VIDEO_EXTS, *K.AUDIO_EXTS))


def clip_inventory(inv: DataFrame, exact: bool = False) -> DataFrame:
    """A5: clips of an inventory; names that do not parse drop out. Order by (folder, seq) to list them."""
    return (
        inv.filter(F.col("name").endswith(".wav"))
        .withColumn("_parts", tx.clip_parts(F.col("name"), exact))
        .filter(F.col("_parts").isNotNull())
        .select(F.col("dir").alias("folder"), F.col("name").alias("file_name"), "_parts.*")
    )


def classify_drop(paths: DataFrame) -> DataFrame:
    """A10: paths (path, is_dir) with the branch each takes: folder, subtitle, dub_audio, media, unsupported."""
    ext = tx.ext_of(tx.base_name(F.col("path")))
    kind = F.when(F.col("is_dir"), "folder").otherwise(tx.file_kind(ext))
    return paths.withColumn("kind", kind)


def plan_drop(
    drop: DataFrame, has_current_task: bool = False, current_step2: str = K.PENDING
) -> DataFrame:
    """A10: the action for each dropped path.

    A wav becomes the dub of the current task unless that task's step 2 is done or running; without a
    current task it is a source of its own.
    """
    if not has_current_task:
        wav = "add_task"
    elif current_step2 in (K.DONE, K.RUNNING):
        wav = "ignore"
    else:
        wav = "set_dub_folder"
    action = (
        F.when(F.col("kind") == "folder", "scan_folder")
        .when(F.col("kind") == "media", "add_task")
        .when(F.col("kind") == "dub_audio", wav)
        .when(F.col("kind") == "subtitle", "set_subtitle")
        .otherwise("ignore")
    )
    return classify_drop(drop).withColumn("action", action)


def watch_folder(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Stream of files as they arrive; feed it to :func:`inventory` or :func:`timed_text_sources`."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
