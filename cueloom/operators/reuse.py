"""Result reuse by content key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..session import freeze
from ..sources import tables

CACHE_COLUMNS = (
    "cache_key", "text", "result_path", "model", "endpoint", "created_at", "file_size", "use_count"
)


def upsert_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by key; a new row starts with a use count of 1.

    ``new`` has the cache columns but ``use_count``, and may have ``batch_no``. The latest row of a key
    wins, rows of ``new`` over cached ones of the same time. Copies are combined before the shuffle.
    """
    rank = F.col("batch_no") if "batch_no" in new.columns else F.lit(1)
    fresh = new.withColumn("_order", rank.cast("long")).withColumn("use_count", F.lit(1).cast("long"))
    both = cache.withColumn("_order", F.lit(-1).cast("long")).unionByName(
        fresh.select(*CACHE_COLUMNS, "_order")
    )
    row = F.struct(*[c for c in CACHE_COLUMNS if c != "cache_key"])
    latest = F.max_by(row, F.struct("created_at", "_order", "result_path"))
    return both.groupBy("cache_key").agg(latest.alias("_row")).select("cache_key", "_row.*")


def merge_into_cache(spark: SparkSession, path: str, new: DataFrame) -> int:
    """A7 on a bucketed cache table: upsert ``new`` and write only the buckets it touches; their number.

    Buckets without a new key are neither read nor written. The merged rows are written aside before they replace the
    buckets, and the same ``new`` merged again gives the same table, so a run that broke off is simply repeated.
    """
    first = tables.read_bucketed_cache(spark, path, layout=True).select("of").first()
    of = first["of"] if first else tables.CACHE_BUCKETS
    fresh = freeze(tables.in_buckets(new, of))
    # At most as many numbers as there are buckets.
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
    if not touched:
        return 0
    old = tables.read_bucketed_cache(spark, path, layout=True).filter(F.col("bucket").isin(touched))
    merged = freeze(tables.in_buckets(upsert_cache(old.select(*CACHE_COLUMNS), fresh.drop("of", "bucket")), of))
    tables.write_buckets(merged, path, "overwrite")
    return len(touched)


def live_entries(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows whose result file exists. ``files`` has a ``path`` column."""
    return cache.join(files.select(F.col("path").alias("result_path")).distinct(), "result_path", "left_semi")


def dangling_entries(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Cache rows whose result file is gone."""
    return cache.join(files.select(F.col("path").alias("result_path")), "result_path", "left_anti")


def cache_hits(requests: DataFrame, cache: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """E5: requests with the stored result, for keys present whose file exists."""
    usable = cache if files is None else live_entries(cache, files)
    return requests.join(usable.select("cache_key", "result_path"), "cache_key", "inner")


def cache_misses(requests: DataFrame, cache: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Requests without a usable cache row, with all their columns."""
    usable = cache if files is None else live_entries(cache, files)
    return requests.join(usable.select("cache_key"), "cache_key", "left_anti")


def missing_outputs(cues: DataFrame, existing: DataFrame, folder: str = "folder") -> DataFrame:
    """Cues whose clip file does not exist yet. ``existing`` has (folder, file_name)."""
    named = cues.withColumn("file_name", tx.clip_name(F.col("idx"), F.col("ts_text"), F.col("text")))
    there = existing.select(folder, "file_name").distinct()
    return named.join(there, [folder, "file_name"], "left_anti")


def distinct_work(requests: DataFrame) -> DataFrame:
    """K6: one row per content key with how many requests ask for it."""
    return requests.groupBy("cache_key").agg(
        F.min(F.struct("text", "model")).alias("_one"), F.count(F.lit(1)).alias("n_requests")
    ).select("cache_key", "_one.text", "_one.model", "n_requests")


def cache_stats(cache: DataFrame) -> DataFrame:
    """rows, total size and total reuse; 0 where there is nothing."""
    return cache.agg(
        F.count(F.lit(1)).alias("total_count"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("use_count"), F.lit(0)).alias("total_reuse"),
    )


def count_reuse(cache: DataFrame, requests: DataFrame) -> DataFrame:
    """the cache after one more use per request that hits."""
    hits = requests.groupBy("cache_key").agg(F.count(F.lit(1)).alias("_hits"))
    return (
        cache.join(hits, "cache_key", "left")
        .withColumn("use_count", F.col("use_count") + F.coalesce(F.col("_hits"), F.lit(0)))
        .drop("_hits")
    )


def clear_report(cache: DataFrame, files: DataFrame) -> DataFrame:
    """cache rows and existing files a clear would remove; deleting is the caller's."""
    there = files.select(F.col("path").alias("result_path")).distinct().withColumn("_there", F.lit(1))
    return cache.join(there, "result_path", "left").agg(
        F.count(F.lit(1)).alias("deleted_rows"), F.count("_there").alias("deleted_files")
    )


def merge_results(requests: DataFrame, cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Every request with its outcome.

    ``cached`` has (cache_key, result_path); ``fresh`` has (cache_key, result_path, ok, message). A request
    found in neither failed because nothing came back for it.
    """
    stored = cached.select(
        "cache_key", "result_path", F.lit(True).alias("ok"), F.lit(K.MSG_REUSED).alias("message"),
        F.lit(0).alias("_from"),
    )
    computed = fresh.select("cache_key", "result_path", "ok", "message", F.lit(1).alias("_from"))
    answer = F.min_by(F.struct("result_path", "ok", "message"), F.struct("_from", "message"))
    answers = stored.unionByName(computed).groupBy("cache_key").agg(answer.alias("_a"))
    return (
        requests.join(answers, "cache_key", "left")
        .withColumn("ok", F.coalesce(F.col("_a.ok"), F.lit(False)))
        .withColumn("result_path", F.col("_a.result_path"))
        .withColumn("message", F.coalesce(F.col("_a.message"), F.lit(K.MSG_NO_RESULT)))
        .drop("_a")
    )


def reuse_by_group(requests: DataFrame, cache: DataFrame, group: str) -> DataFrame:
    """Per group: requests, distinct contents, requests the cache answers, contents still to compute.

    Counts per (group, key) are taken first, so a content that fills a third of the table is one row per
    group before it meets the cache.
    """
    counts = requests.groupBy(group, "cache_key").agg(F.count(F.lit(1)).alias("_n"))
    known = cache.select("cache_key").withColumn("_known", F.lit(True))
    hit = F.col("_known").isNotNull()
    return counts.join(known, "cache_key", "left").groupBy(group).agg(
        F.sum("_n").alias("n_cues"),
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("n_reused"),
        F.count(F.when(~hit, 1)).alias("n_to_compute"),
    )
