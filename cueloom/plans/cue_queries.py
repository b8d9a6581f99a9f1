"""Queries on cues and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cue_ranges as cr
from ..operators import cues as cu
from ..sources import files as fl
from . import fixtures as fx
from .oracle import with_tables
from .registry import query

CUE = "source_id:s idx:l ts_text:s text:s"


@query("c1_lrc_cues", "source_id:s line_start:l idx:l ts_text:s text:s",
       with_tables("lrc", "SELECT doc_id AS source_id, * FROM lrc"))
def c1(t):
    return cu.parse_lrc(fx.sources(t, "lrc"))


@query("c2_vtt_cues", CUE, with_tables("vtt", "SELECT doc_id AS source_id, * FROM vtt"))
def c2(t):
    return cu.parse_vtt(fx.sources(t, "vtt"))


@query("c3_srt_cues", CUE, with_tables("srt", "SELECT doc_id AS source_id, * FROM srt"))
def c3(t):
    return cu.parse_srt(fx.sources(t, "srt"))


@query("c4_plain_cues", "source_id:s line_start:l idx:l start_ms:l text:s",
       with_tables("plain", "SELECT doc_id AS source_id, line_start, idx, 0 AS start_ms, text FROM plain"))
def c4(t):
    return cu.parse_plain(fx.sources(t, "txt"))


@query("c5_centisecond_cut", "cs:l n:l", with_tables(
    "srt", "SELECT CAST(substr(ts_text, 10, 2) AS BIGINT) AS cs, count(*) AS n FROM srt GROUP BY 1"))
def c5(t):
    cs = F.substring("ts_text", 10, 2).cast("long")
    return cu.parse_srt(fx.sources(t, "srt")).groupBy(cs.alias("cs")).agg(F.count(F.lit(1)).alias("n"))


@query("c6_dense_numbers", "source_id:s n:l first:l last:l",
       with_tables("srt", "SELECT doc_id AS source_id, count(*) AS n, 1 AS first, count(*) AS last FROM srt GROUP BY 1"))
def c6(t):
    return cu.parse_srt(fx.sources(t, "srt")).groupBy("source_id").agg(
        F.countDistinct("idx").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last")
    )


@query("c7_stamp_ms", "source_id:s idx:l start_ms:l",
       with_tables("stamped", "SELECT doc_id AS source_id, idx, start_ms FROM stamped"))
def c7(t):
    return cu.parse_lrc(fx.sources(t, "lrc")).select("source_id", "idx", "start_ms")


# Every document read as SRT although only one in four is, so the others have no cue.
@query("c8_empty_sources", "source_id:s n_cues:l failed:b", with_tables("srt", """
    SELECT d.doc_id AS source_id, count(s.doc_id) AS n_cues, count(s.doc_id) = 0 AS failed
    FROM documents d LEFT JOIN srt s ON d.doc_id = s.doc_id AND d.doc_id % 4 = 2 GROUP BY d.doc_id"""))
def c8(t):
    src = fx.mixed_sources(t)
    return cu.sources_without_cues(src, cu.parse_srt(src))


_MIXED = """
    SELECT doc_id, idx, ts_text, text FROM lrc WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id, idx, ts_text, text FROM vtt WHERE doc_id % 4 = 1
    UNION ALL SELECT doc_id, idx, ts_text, text FROM srt WHERE doc_id % 4 = 2
    UNION ALL SELECT doc_id, idx, '00:00:00.00', text FROM plain WHERE doc_id % 4 = 3"""


@query("i1_cues_of_all_formats", CUE,
       with_tables("lrc vtt srt plain", f"SELECT doc_id AS source_id, * FROM ({_MIXED})"))
def i1(t):
    return cu.parse_timed_text(fx.mixed_sources(t))


def _in_ranges(docs, lines=7):
    """Documents cut into ranges of a few lines, so that most cues of block formats are cut through."""
    cut = F.split("text", "\n")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / lines)), lambda k: F.array_join(
        F.slice(cut, (k * lines + 1).cast("int"), F.lit(lines)), "\n"))
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(pieces).alias("range_no", "text"))


@query("a1_ranges_of_lines", "source_id:s line_start:l idx:l ts_text:s text:s", with_tables("lrc vtt srt plain", f"""
    SELECT m.doc_id AS source_id, coalesce(l.line_start, p.line_start) AS line_start, m.idx, m.ts_text, m.text
    FROM ({_MIXED}) m LEFT JOIN lrc l ON m.doc_id % 4 = 0 AND l.doc_id = m.doc_id AND l.idx = m.idx
    LEFT JOIN plain p ON m.doc_id % 4 = 3 AND p.doc_id = m.doc_id AND p.idx = m.idx"""))
def a1_ranges(t):
    cues = cr.parse_ranges(_in_ranges(fx.mixed_sources(t)))
    # The SQL knows no line numbers of block formats; the tests compare those with the uncut parse.
    block = (F.col("source_id").cast("long") % 4).isin(1, 2)
    return cues.withColumn("line_start", F.when(~block, F.col("line_start")))


def _as_files(t):
    """Every document as a file row with bytes; extensions in capitals on even ids."""
    src = fx.mixed_sources(t)
    ext = F.when(F.col("source_id").cast("long") % 2 == 0, F.upper("format")).otherwise(F.col("format"))
    return src.select(
        F.concat(F.lit("/subs/doc"), "source_id", F.lit("."), ext).alias("path"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("source_id").cast("long")).alias("modificationTime"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query("a1_timed_text_scan", "path:s version:s n_cues:l last_ts:s", with_tables("lrc vtt srt plain", f"""
    SELECT '/subs/doc' || doc_id || ['.LRC', '.vtt', '.SRT', '.txt'][CAST(doc_id % 4 + 1 AS INTEGER)] AS path,
           CAST(1704067200 + doc_id AS VARCHAR) AS version, count(*) AS n_cues, max(ts_text) AS last_ts
    FROM ({_MIXED}) GROUP BY doc_id"""))
def a1(t):
    cues = cu.parse_timed_text(fl.timed_text_sources(_as_files(t)))
    return cues.groupBy(F.col("source_id").alias("path"), F.col("source_version").alias("version")).agg(
        F.count(F.lit(1)).alias("n_cues"), F.max("ts_text").alias("last_ts")
    )


# Half of the files are GBK; those whose id ends in 9 are neither charset and are skipped.
@query("a2_charset_fallback", "doc_id:l text:s", """
    SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN NULL ELSE '文档' || source END AS text FROM documents""")
def a2(t):
    label = F.concat(F.lit("文档"), F.col("source"))
    gbk = F.concat(F.unhex(F.lit("CEC4B5B5")), F.encode("source", "US-ASCII"))
    raw = (
        F.when(F.col("doc_id") % 10 == 9, F.concat(gbk, F.unhex(F.lit("FFFF"))))
        .when(F.col("doc_id") % 2 == 1, gbk)
        .otherwise(F.encode(label, "UTF-8"))
    )
    return fl.decode_text(t.documents.select("doc_id", raw.alias("content")))


@query("a3_console_lines", "doc_id:l line:s", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN '文档' || source || chr(65533) ELSE '文档' || source END AS line
    FROM documents""")
def a3(t):
    gbk = F.concat(F.unhex(F.lit("CEC4B5B5")), F.encode("source", "US-ASCII"), F.unhex(F.lit("FF")))
    raw = F.when(F.col("doc_id") % 2 == 1, gbk).otherwise(
        F.encode(F.concat(F.lit("文档"), F.col("source")), "UTF-8")
    )
    return t.documents.select("doc_id", fl.decode_console_line(raw).alias("line"))


# Segments from events: start at the event, length from its value; overlapping ones are cut at the next start.
_SEGMENTS = """
    SELECT user_id AS source_id, event_id AS seg_no, event_type AS text, start_ms,
           least(start_ms + 1 + CAST(floor(value * 360000) AS BIGINT),
                 coalesce(lead(start_ms) OVER (PARTITION BY user_id ORDER BY start_ms, event_id), 9e15)) AS end_ms
    FROM (SELECT *, epoch_us(ts) // 1000 AS start_ms FROM events)"""
_GAP_MS, _CAP_MS = 600_000, 60_000_000


def _segments(t):
    from ..functions.scan import segmented_scan

    e = t.events.select(
        F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("seg_no"),
        F.col("event_type").alias("text"), "value",
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("start_ms"),
    )
    nxt = segmented_scan(
        e, ["source_id"], ["start_ms", "seg_no"], F.floor(F.col("start_ms") / 3_600_000), leads={"_next": "start_ms"}
    )
    length = F.col("start_ms") + 1 + F.floor(F.col("value") * 360000)
    return nxt.withColumn("end_ms", F.least(length, "_next")).drop("_next", "value")


_RUNS = """
    SELECT *, sum(cut) OVER (PARTITION BY source_id ORDER BY start_ms, seg_no) AS run FROM (
        SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY source_id ORDER BY start_ms, seg_no)
                       <= {gap} THEN 0 ELSE 1 END AS cut FROM segments)"""


@query("c9_merge_by_gap", "source_id:s start_ms:l end_ms:l n_parts:l text:s", with_tables("", """
    SELECT source_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_parts,
           string_agg(text, ' ' ORDER BY start_ms, seg_no) AS text
    FROM runs GROUP BY source_id, run""", segments=_SEGMENTS, runs=_RUNS.format(gap=_GAP_MS)))
def c9_gap(t):
    return cu.merge_close_segments(_segments(t), _GAP_MS, None)


# The greedy rule as a recursion: each merged segment starts where the one before had to stop.
@query("c9_merge_with_cap", "source_id:s start_ms:l end_ms:l n_parts:l text:s", with_tables("", """
    SELECT w.source_id, min(s.start_ms) AS start_ms, max(s.end_ms) AS end_ms, count(*) AS n_parts,
           string_agg(s.text, ' ' ORDER BY s.start_ms, s.seg_no) AS text
    FROM walk w JOIN numbered s USING (source_id, run, n) GROUP BY w.source_id, w.run, w.part""",
    segments=_SEGMENTS, runs=_RUNS.format(gap=_GAP_MS),
    numbered="SELECT *, row_number() OVER (PARTITION BY source_id, run ORDER BY start_ms, seg_no) AS n FROM runs",
    walk=f"""
        SELECT source_id, run, n, start_ms AS first_ms, 1 AS part FROM numbered WHERE n = 1
        UNION ALL
        SELECT s.source_id, s.run, s.n,
               CASE WHEN s.end_ms - w.first_ms <= {_CAP_MS} THEN w.first_ms ELSE s.start_ms END,
               CASE WHEN s.end_ms - w.first_ms <= {_CAP_MS} THEN w.part ELSE w.part + 1 END
        FROM walk w JOIN numbered s ON s.source_id = w.source_id AND s.run = w.run AND s.n = w.n + 1"""))
def c9_cap(t):
    return cu.merge_close_segments(_segments(t), _GAP_MS, _CAP_MS)


# Frames of 10 ms whose score is the event's value over 100.
@query("c10_threshold_segments", "signal_id:s start_ms:l end_ms:l", with_tables("series", """
    SELECT signal_id, greatest(min(start_ms) - 20, any_value(lo)) AS start_ms,
           least(max(end_ms) + 20, any_value(hi)) AS end_ms
    FROM (SELECT *, sum(cut) OVER (PARTITION BY signal_id ORDER BY start_ms) AS run FROM (
        SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY signal_id ORDER BY start_ms) < 30
                       THEN 0 ELSE 1 END AS cut
        FROM (SELECT signal_id, frame_no * 10 AS start_ms, frame_no * 10 + 10 AS end_ms, value,
                     min(frame_no * 10) OVER (PARTITION BY signal_id) AS lo,
                     max(frame_no * 10 + 10) OVER (PARTITION BY signal_id) AS hi FROM series)
        WHERE value >= 2500))
    GROUP BY signal_id, run HAVING max(end_ms) - min(start_ms) >= 20"""))
def c10(t):
    scores = fx.series(t).select(
        "signal_id", (F.col("frame_no") * 10).alias("start_ms"), (F.col("frame_no") * 10 + 10).alias("end_ms"),
        (F.col("value") / 5000).alias("score"),
    )
    return cu.threshold_segments(
        scores, threshold=0.5, min_silence_ms=30, min_speech_ms=20, pad_ms=20, window_ms=1000
    )
