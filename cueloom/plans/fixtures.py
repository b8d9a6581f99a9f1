"""Media-job tables derived from the given tables; the same rules stand in ``plans/oracle.py`` as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as tx
from ..functions.scan import segmented_scan
from ..session import spread

LINE_CS = 237
EVENT_RATE = 100
EMBED_LEN = 64
FULL_SCALE = 32767.0

# Fixed values: (return flag, line status) -> step status.
STEP_STATES = {"AF": K.DONE, "AO": K.RUNNING, "RF": K.FAILED, "RO": K.PENDING, "NF": K.SKIPPED, "NO": K.DONE}


class Tables:
    """The given tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def _clock(cs: Column, sep: str, tail: Column | None = None) -> Column:
    """``HH:MM:SS<sep>cc`` with optional further digits."""
    text = F.format_string(
        f"%02d:%02d:%02d{sep}%02d",
        F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100,
    )
    return text if tail is None else F.concat(text, tail.cast("string"))


def _line_cs(doc_id: Column, i: Column) -> Column:
    return (doc_id % 50) * 7 + i.cast("long") * LINE_CS


def render(doc_id: Column, text: Column, fmt: str) -> Column:
    """A document as a subtitle file; its lines are the cue texts.

    LRC: short stamps on even lines. Blocks: every fifth has a time and no text, every seventh other
    block has a second text line.
    """
    lines = F.split(text, "\n")
    if fmt == "txt":
        return text

    def lrc(line: Column, i: Column) -> Column:
        full = _clock(_line_cs(doc_id, i), ".")
        stamp = F.when(i % 2 == 1, full).otherwise(F.substring(full, 4, 8))
        return F.concat(F.lit("["), stamp, F.lit("]"), line)

    def block(line: Column, i: Column) -> Column:
        sep = "." if fmt == "vtt" else ","
        cs = _line_cs(doc_id, i)
        start, end = _clock(cs, sep, i % 10), _clock(cs + 200, sep, i % 10)
        body = F.when(i % 5 == 4, F.lit("")).when(
            i % 7 == 6, F.concat(line, F.lit("\n  and more \n"))
        ).otherwise(F.concat(line, F.lit("\n")))
        return F.concat((i + 1).cast("string"), F.lit("\n"), start, F.lit(" --> "), end, F.lit("\n"), body)

    if fmt == "lrc":
        return F.array_join(F.transform(lines, lrc), "\n")
    body = F.array_join(F.transform(lines, block), "\n")
    return F.concat(F.lit("WEBVTT\n\n"), body) if fmt == "vtt" else body


def sources(t: Tables, fmt: str) -> DataFrame:
    """Every document as a file of one format."""
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.lit(fmt).alias("format"),
        render(F.col("doc_id"), F.col("text"), fmt).alias("text"),
        F.lit("0").alias("source_version"),
    )


def mixed_sources(t: Tables) -> DataFrame:
    """Every document as a file, the format by its id."""
    fmt = F.element_at(
        F.array(*[F.lit(f) for f in K.CUE_FORMATS]), (F.col("doc_id") % 4 + 1).cast("int")
    )
    text = F.lit(None).cast("string")
    for name in K.CUE_FORMATS:
        text = F.when(fmt == name, render(F.col("doc_id"), F.col("text"), name)).otherwise(text)
    return spread(t.documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("source_id"), fmt.alias("format"), text.alias("text"),
        F.lit("0").alias("source_version"),
    )


def line_requests(t: Tables) -> DataFrame:
    """Lines of all documents as requests: place, text, model (language), key."""
    from ..operators.cues import parse_plain

    docs = spread(t.documents, "doc_id").select(
        F.col("doc_id").cast("string").alias("source_id"), "doc_id", "text", "lang", "source",
        F.lit("0").alias("source_version"),
    )
    return parse_plain(docs).select(
        "doc_id", "source", "line_start", "idx", "ts_text", "text", F.col("lang").alias("model"),
        tx.cache_key(F.col("text"), F.col("lang"), F.col("source_version")).alias("cache_key"),
    )


def inventory_row(folder: Column, name: Column) -> list[Column]:
    return [
        tx.join_path(folder, name).alias("path"), folder.alias("dir"), name.alias("name"),
        tx.stem_of(name).alias("stem"), tx.ext_of(name).alias("ext"),
    ]


def media_files(t: Tables) -> DataFrame:
    """One media file per document in ``/media/<source>``."""
    exts = [*K.VIDEO_EXTS, *K.AUDIO_EXTS]
    ext = F.element_at(F.array(*[F.lit(e) for e in exts]), (F.col("doc_id") % len(exts) + 1).cast("int"))
    folder = F.concat(F.lit("/media/"), F.col("source"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return t.documents.select("doc_id", *inventory_row(folder, name))


def subtitle_files(t: Tables) -> DataFrame:
    """A subtitle for two documents of three: ``.lrc`` or ``.zh.srt``; the rest have a note file."""
    tail = (
        F.when(F.col("doc_id") % 3 == 0, ".lrc").when(F.col("doc_id") % 3 == 1, ".zh.srt").otherwise(".md")
    )
    folder = F.concat(F.lit("/media/"), F.col("source"))
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), tail)
    return t.documents.select("doc_id", *inventory_row(folder, name))


def result_cache(t: Tables) -> DataFrame:
    """Cache of the distinct texts of a third of the documents; the file size is the text's length."""
    key = tx.cache_key(F.col("text"), F.col("lang"), F.lit("0"))
    docs = t.documents.filter(F.col("doc_id") % 3 == 0).select(
        key.alias("cache_key"), "text", F.col("lang").alias("model"), "doc_id"
    )
    row = F.struct("doc_id", "text", "model")
    return docs.groupBy("cache_key").agg(F.min(row).alias("_r")).select(
        "cache_key",
        F.col("_r.text").alias("text"),
        F.concat(F.lit("/cache/"), "cache_key", F.lit(".wav")).alias("result_path"),
        F.col("_r.model").alias("model"),
        F.lit("local").alias("endpoint"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("_r.doc_id")).alias("created_at"),
        F.length("_r.text").cast("long").alias("file_size"),
        F.lit(1).cast("long").alias("use_count"),
    )


def doc_requests(t: Tables) -> DataFrame:
    """One request per document: its whole text."""
    return t.documents.select(
        "doc_id", "source", "text", F.col("lang").alias("model"),
        tx.cache_key(F.col("text"), F.col("lang"), F.lit("0")).alias("cache_key"),
    )


def cache_files(t: Tables) -> DataFrame:
    """Result files that still exist: those whose key does not start with 0 or 1."""
    return result_cache(t).filter(~F.substring("cache_key", 1, 1).isin("0", "1")).select(
        F.col("result_path").alias("path")
    )


def step_events(t: Tables) -> DataFrame:
    code = F.concat("l_returnflag", "l_linestatus")
    pairs = [F.lit(v) for kv in STEP_STATES.items() for v in kv]
    return t.lineitem.select(
        F.col("l_orderkey").alias("task_id"), ((F.col("l_linenumber") - 1) % 3 + 1).cast("int").alias("step"),
        F.element_at(F.create_map(*pairs), code).alias("status"),
        F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"),
    )


def tasks(t: Tables) -> DataFrame:
    """One task per order with the latest status of its three steps; its group is the customer."""
    latest = step_events(t).groupBy("task_id").agg(
        *[
            F.max_by("status", F.when(F.col("step") == s, F.col("at"))).alias(f"s{s}_status")
            for s in K.STEPS
        ]
    )
    folder = F.concat(F.lit("/jobs/c"), F.col("o_custkey").cast("string"))
    prefixed = F.when(
        F.col("o_custkey") % 10 == 0, F.concat(F.lit(f"/jobs/{K.BILINGUAL_PREFIX}c"), F.col("o_custkey").cast("string"))
    ).otherwise(folder)
    return (
        t.orders.select(
            F.col("o_orderkey").alias("task_id"), F.col("o_custkey").cast("string").alias("group_id"),
            F.concat(F.lit("task"), F.col("o_orderkey").cast("string")).alias("source_name"),
            F.concat(prefixed, F.lit("/task"), F.col("o_orderkey").cast("string"), F.lit(".mp4")).alias("source_path"),
            (F.col("o_orderstatus") != "P").alias("from_folder"),
            F.when(F.col("o_orderstatus") != "P", prefixed).otherwise("").alias("import_folder"),
        )
        .join(latest, "task_id", "left")
        .withColumns({f"s{s}_status": F.coalesce(f"s{s}_status", F.lit(K.PENDING)) for s in K.STEPS})
    )


def event_rows(events: DataFrame) -> DataFrame:
    """Events as job events."""
    kind = F.col("event_type")
    msg = (
        F.when(kind == "error", F.lit("处理失败"))
        .when(kind == "signup", F.lit("警告 signup"))
        .when(kind == "purchase", F.lit("完成 purchase"))
        .when(kind == "click", F.concat((F.col("event_id") % 100).cast("string"), F.lit("/100")))
        .otherwise(F.concat(F.col("value").cast("string"), F.lit("%")))
    )
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("task_id"),
        (F.col("event_id") % 3 + 1).cast("int").alias("step"),
        kind.alias("kind"),
        (kind != "error").alias("ok"),
        F.least(F.lit(99), F.floor(F.col("value") / 5)).cast("int").alias("pct"),
        msg.alias("msg"),
    )


def job_events(t: Tables) -> DataFrame:
    return event_rows(t.events)


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream."""
    raw = (
        t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    )
    return event_rows(raw)


def series(t: Tables) -> DataFrame:
    """Events per user in time order as frames of a signal; 100 frames a second."""
    rows = t.events.select(
        F.col("user_id").cast("string").alias("signal_id"), "ts", "event_id",
        (F.col("value") * 50).alias("value"), "event_type",
    )
    numbered = segmented_scan(
        rows, ["signal_id"], ["ts", "event_id"], None, rank="_rn"
    )
    return numbered.select("signal_id", (F.col("_rn") - 1).alias("frame_no"), "value", "event_type", "event_id")


def blocks(t: Tables) -> DataFrame:
    """Embeddings per label as stereo blocks of 64 samples: even ranks left, odd ranks right."""
    ranked = segmented_scan(
        t.embeddings.select("vec_id", "label", "embedding"), ["label"], ["vec_id"],
        F.floor(F.col("vec_id") / 4096), rank="_rn",
    )
    return ranked.select(
        F.col("label").cast("string").alias("signal_id"),
        ((F.col("_rn") - 1) % 2).cast("int").alias("channel"),
        F.floor((F.col("_rn") - 1) / 2).alias("block_no"),
        F.transform("embedding", lambda x: x.cast("double") * FULL_SCALE).alias("samples"),
        "vec_id",
    )
