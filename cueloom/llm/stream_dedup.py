"""Exact dedup of a growing table as a stateful stream (operator 11).

The table is read as a stream of files. The state, kept on disk by RocksDB and never expired, is one row for each text
digest: the row that stays (its id, and its locator: file and row number, from which the content can be read), and how
many rows had that digest. Equal digests of one task are combined before the shuffle, so a text with a third of all rows
sends one row from each task.

A digest that came more than once is a hit, and its rows are compared by their full bytes: texts of hits are grouped
by digest and whole text. Where one digest turns out to stand for several texts, the groups follow the texts. Only texts
that a bit map of the hits lets through are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import fresh_dir, freeze
from ..streaming.live import ROCKSDB, latest_update, run_to_end

#: Bytes of new files in one trigger; a trigger that fails runs again as a whole.
PER_TRIGGER = 64 << 30
#: Bits of the map for each hit, and the most bits it gets: 128 MB. A fuller map only lets more texts through.
HIT_BITS, MOST_BITS = 8, 1 << 30
#: The state on disk; files are not made larger in advance, since there is one small store for each task.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    """Lowercase hex of the SHA-256 of a text in UTF-8."""
    return F.sha2(text, 256)


def _rows(table: DataFrame, digest: Callable[[Column], Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, at, text, digest, and columns of the table as one struct) of every row; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = table.metadataColumn("_metadata")  # also where the table has a column of that name
    at = F.struct(place["file_path"].alias("file"), place["row_index"].alias("row"))
    extra = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("source")] if keep else []
    rows = table.select(F.col("doc_id").cast("long").alias("id"), at.alias("at"), text.alias("text"), *extra)
    return rows.withColumn("digest", digest(F.col("text")))


def _stream_path(spark: SparkSession, path: str) -> str:
    """Streams take folders and patterns, no single files: the name of a file becomes a pattern for just that file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(at) and fs.getFileStatus(at).isFile() else path


def update_state(
    spark: SparkSession, path: str, location: str, digest: Callable[[Column], Column] = sha256, per_trigger: int = PER_TRIGGER
) -> None:
    """Take the files of the Parquet table at ``path`` that ``location`` has not seen into the state kept there.

    Every trigger writes what it changed to ``location/changes/batch_id=N``, replacing itself if it runs again.
    """
    schema = spark.read.parquet(path).schema
    files = spark.readStream.schema(schema).option("maxBytesPerTrigger", per_trigger)
    stream = files.parquet(_stream_path(spark, path))
    best = F.max(F.struct("id", "at")).alias("stays")
    state = _rows(stream, digest).groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{location}/changes/batch_id={number}")

    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        run_to_end(state, write, "update", f"{location}/checkpoint")
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_AT = "struct<file: string, row: bigint>"


def groups(spark: SparkSession, location: str) -> DataFrame:
    """What the state at ``location`` holds: ``(digest, stays: struct<id, at>, n)``."""
    shape = StructType.fromDDL(f"digest string, stays struct<id: bigint, at: {_AT}>, n long")
    changes = spark.read.schema(StructType([*shape.fields, StructField("batch_id", LongType())])).option(
        "basePath", f"{location}/changes"
    )
    try:
        found = changes.parquet(f"{location}/changes")
    except Exception as exc:  # a table without a row never had a trigger
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], shape)
    return latest_update(found, "digest")


def _past_map(rows: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    """Rows whose digest may be one of ``hits``; the broadcast map has ``MOST_BITS`` bits at most."""
    bits = min(MOST_BITS, 1 << max(15, (HIT_BITS * n_hits - 1).bit_length()))
    place = (F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1).alias("place")
    parts = hits.select(place).groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
    )
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(parts), "bucket")
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _decisions(spark, path, location, digest, keep):
    """Every row with the group it belongs to, after the check of full bytes."""
    state = freeze(groups(spark, location))
    rows = _rows(spark.read.parquet(path), digest, keep)
    hits = state.filter("n > 1").select("digest")
    n_hits = hits.count()
    plain = rows.drop("text").join(state, "digest").withColumn("text_sha256", F.col("digest"))
    if digest is not sha256:
        plain = rows.withColumn("text_sha256", sha256(F.col("text"))).drop("text").join(state, "digest")
    if not n_hits:
        return plain
    # Whole texts are the grouping key here: what one digest stands for is compared byte by byte.
    texts = _past_map(rows.select("digest", "text"), hits, n_hits).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("k"))
    several = freeze(
        texts.groupBy("digest").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("digest")
        .join(hits, "digest", "left_semi")
    )
    n_several = several.count()
    if not n_several:
        return plain
    shared = _past_map(rows, several, n_several).join(several, "digest", "left_semi")
    own = shared.groupBy("digest", "text").agg(F.max(F.struct("id", "at")).alias("stays"), F.count(F.lit(1)).alias("n"))
    by_text = shared.join(own, ["digest", "text"]).withColumn("text_sha256", sha256(F.col("text"))).drop("text")
    return plain.join(several, "digest", "left_anti").unionByName(by_text)


def deduplicate(
    spark: SparkSession, path: str, location: str | None = None, digest: Callable[[Column], Column] = sha256,
    per_trigger: int = PER_TRIGGER,
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256, keep_file, keep_row)`` for every row of the Parquet table at ``path``.

    Rows with the same text, byte by byte, are a group (null counts as empty). The row with the largest doc_id stays; a
    null doc_id is smaller than any other, and of rows that repeat an id the one in the last file, and there the last
    one, stays. ``keep_file`` and ``keep_row`` locate its content. Further columns take no part; an empty table gives no
    rows. With a ``location`` (a folder all machines share) the state stays there, and the next call reads only new
    files into it; one location belongs to one table and one ``digest``, and files are added to a table, never changed.
    """
    where = location or fresh_dir(spark, "dedup")
    update_state(spark, path, where, digest, per_trigger)
    return _decisions(spark, path, where, digest, ()).select(
        F.col("id").alias("doc_id"), F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("at") == F.col("stays.at")).alias("kept"), "text_sha256",
        F.col("stays.at.file").alias("keep_file"), F.col("stays.at.row").alias("keep_row"),
    )


def kept_rows(
    spark: SparkSession, path: str, location: str | None = None, digest: Callable[[Column], Column] = sha256,
    per_trigger: int = PER_TRIGGER,
) -> DataFrame:
    """The rows that stay, unchanged and with all columns; ties and nulls as in :func:`deduplicate`."""
    where = location or fresh_dir(spark, "dedup")
    update_state(spark, path, where, digest, per_trigger)
    columns = tuple(spark.read.parquet(path).columns)
    rows = _decisions(spark, path, where, digest, columns)
    return rows.filter(F.col("at") == F.col("stays.at")).select("source.*")
