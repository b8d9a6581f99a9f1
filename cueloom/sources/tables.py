"""Table sources and sinks: result cache, task snapshots, output routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from .. import schemas
from ..functions import text as tx


def read_result_cache(spark: SparkSession, path: str) -> DataFrame:
    """A6."""
    return spark.read.schema(schemas.RESULT_CACHE).parquet(path)


def write_result_cache(cache: DataFrame, path: str) -> None:
    """Write a version of the cache to a new path."""
    cache.write.parquet(path)


#: Parts a bucketed cache is cut into by its keys.
CACHE_BUCKETS = 256
_LAYOUT = ("of", "bucket")


def in_buckets(rows: DataFrame, of: int) -> DataFrame:
    """Rows with the number of buckets and the bucket of their ``cache_key``."""
    bucket = F.pmod(F.crc32(F.col("cache_key").cast("binary")), F.lit(of)).cast("int")
    return rows.withColumns({"of": F.lit(of), "bucket": bucket})


def write_buckets(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Write rows of :func:`in_buckets`; with ``mode='overwrite'`` only the buckets that occur are replaced."""
    rows.repartition(*_LAYOUT).write.option("partitionOverwriteMode", "dynamic").partitionBy(*_LAYOUT).mode(mode).parquet(path)


def write_bucketed_cache(cache: DataFrame, path: str, buckets: int = CACHE_BUCKETS) -> None:
    """A cache table whose rows lie in ``buckets`` folders by key; see :func:`cueloom.operators.reuse.merge_into_cache`."""
    write_buckets(in_buckets(cache, buckets), path)


def read_bucketed_cache(spark: SparkSession, path: str, layout: bool = False) -> DataFrame:
    """The rows of a bucketed cache; with ``layout`` also the number of buckets (``of``) and the ``bucket``."""
    rows = spark.read.schema(f"{schemas.RESULT_CACHE}, of int, bucket int").option("basePath", path).parquet(path)
    return rows if layout else rows.drop(*_LAYOUT)


def write_task_snapshot(tasks: DataFrame, path: str, fmt: str = "json") -> None:
    """A8."""
    tasks.write.format(fmt).save(path)


def read_task_snapshot(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Fields an older snapshot lacks come back as pending, empty or false."""
    schema = StructType.fromDDL(schemas.TASKS)
    raw = spark.read.schema(schema).format(fmt).load(path)
    filled = []
    for field in schema:
        if field.name.endswith("_status"):
            default = F.lit(K.PENDING)
        elif field.dataType.simpleString() == "boolean":
            default = F.lit(False)
        else:
            default = F.lit("")
        filled.append(F.coalesce(F.col(field.name), default).alias(field.name))
    return raw.select(*filled)


def output_dir(
    src: Column, from_folder: Column, custom_dir: str = "", folder_prefix: bool = False
) -> Column:
    """Custom folder, else the prefixed sibling of ``src`` for folder imports, else its sub-folder."""
    sub = tx.join_path(src, F.lit(K.BILINGUAL_DIR))
    if custom_dir.strip():
        return F.lit(custom_dir.strip())
    if not folder_prefix:
        return sub
    name = tx.base_name(src)
    sibling = tx.join_path(tx.dir_name(src), F.concat(F.lit(K.BILINGUAL_PREFIX), name))
    return F.when(~from_folder, sub).when(name.startswith(K.BILINGUAL_PREFIX), src).otherwise(sibling)


def route_outputs(
    tasks: DataFrame,
    custom_dir: str = "",
    folder_prefix: bool = False,
    fmt: str | None = None,
    add_suffix: bool = True,
) -> DataFrame:
    """Tasks with ``out_dir`` and ``out_path``. Write with ``partitionBy('out_dir')``."""
    ext = tx.ext_of(tx.base_name(F.col("source_path")))
    form = tx.output_format(ext, None if fmt is None else F.lit(fmt))
    suffix = K.MIXED_SUFFIX if add_suffix else ""
    sourced = tasks.withColumn("_src", tx.dir_name(F.col("source_path")))
    routed = sourced.withColumn(
        "out_dir", output_dir(F.col("_src"), F.col("from_folder"), custom_dir, folder_prefix)
    ).drop("_src")
    name = F.concat(F.col("source_name"), F.lit(suffix + "."), form)
    return routed.withColumn("out_path", tx.join_path(F.col("out_dir"), name))
