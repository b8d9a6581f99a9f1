"""Queries on names, paths, keys, progress and log text."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import sound as sd
from ..functions import text as tx
from ..operators import matching as ma
from ..sources import files as fl
from ..sources import tables as tb
from . import fixtures as fx
from .oracle import natural, with_tables
from .registry import query

_SUBS = "['lrc','srt','vtt']"
_MEDIA = "['mp4','mkv','avi','mov','flv','wmv','webm','ts','wav','mp3','flac','ogg','m4a','aac','wma']"
_VIDEO = "['mp4','mkv','avi','mov','flv','wmv','webm','ts']"


def _in(expr: str, names: str) -> str:
    return f"list_contains({names}, {expr})"


def _all_files(t):
    return fx.media_files(t).unionByName(fx.subtitle_files(t))


_FILES = """
    SELECT doc_id, dir, stem || '.' || ext AS name, ext FROM media
    UNION ALL SELECT doc_id, dir, name, regexp_extract(name, '[^.]*$') AS ext FROM subs"""


@query("a4_media_inventory", "path:s pos:l", with_tables("media subs", f"""
    SELECT path, row_number() OVER (ORDER BY {natural("path")}, path) AS pos
    FROM (SELECT *, dir || '/' || name AS path FROM ({_FILES})) WHERE {_in('ext', _MEDIA)}"""))
def a4(t):
    return ma.natural_rank(fl.media_inventory(_all_files(t)).select("path"), "path", "path")


_CLIP_NAMES = """
    SELECT source AS folder, printf('%04d', CAST(idx AS INTEGER)) || '_00-00-00.00_' ||
           CASE WHEN safe = '' THEN '无' ELSE substr(safe, 1, 2) END || '.wav' AS file_name, doc_id, idx, safe
    FROM (SELECT *, regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g') AS safe FROM plain)"""


@query("a5_clip_inventory", "folder:s seq:l n:l", with_tables(
    "plain", "SELECT folder, idx AS seq, count(*) AS n FROM clips GROUP BY 1, 2", clips=_CLIP_NAMES))
def a5(t):
    lines = fx.line_requests(t)
    name = tx.clip_name(F.col("idx"), F.col("ts_text"), F.col("text"))
    # Each clip has a neighbour whose name does not parse.
    named = lines.select(F.col("source").alias("dir"), name.alias("name"))
    inv = named.select("dir", F.explode(F.array("name", F.concat(F.lit("x"), "name"))).alias("name"))
    return fl.clip_inventory(inv).groupBy("folder", "seq").agg(F.count(F.lit(1)).alias("n"))


@query("a9_output_routing", "task_id:l out_dir:s out_path:s", with_tables("tasks", """
    SELECT task_id, out_dir, out_dir || '/' || source_name || '_mixed.mp4' AS out_path FROM (
        SELECT *, CASE WHEN NOT from_folder THEN dir || '/双语' WHEN dir LIKE '/jobs/双语-%' THEN dir
                       ELSE '/jobs/双语-' || substr(dir, 7) END AS out_dir FROM tasks)"""))
def a9(t):
    return tb.route_outputs(fx.tasks(t), folder_prefix=True)


@query("a10_drop_plan", "path:s kind:s action:s", with_tables("media subs", f"""
    SELECT dir || '/' || name AS path,
           CASE WHEN {_in('ext', _SUBS)} THEN 'subtitle' WHEN ext = 'wav' THEN 'dub_audio'
                WHEN {_in('ext', _MEDIA)} THEN 'media' ELSE 'unsupported' END AS kind,
           CASE WHEN {_in('ext', _SUBS)} THEN 'set_subtitle' WHEN {_in('ext', _MEDIA)} THEN 'add_task'
                ELSE 'ignore' END AS action
    FROM ({_FILES}) UNION ALL SELECT DISTINCT dir, 'folder', 'scan_folder' FROM media"""))
def a10(t):
    files = _all_files(t).select("path", F.lit(False).alias("is_dir"))
    dirs = fx.media_files(t).select(F.col("dir").alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return fl.plan_drop(files.unionByName(dirs))


@query("b1_file_kinds", "kind:s n:l", with_tables("media subs", f"""
    SELECT CASE WHEN {_in('ext', _SUBS)} THEN 'subtitle' WHEN ext = 'wav' THEN 'dub_audio'
                WHEN {_in('ext', _MEDIA)} THEN 'media' ELSE 'unsupported' END AS kind, count(*) AS n
    FROM ({_FILES}) GROUP BY 1"""))
def b1(t):
    return _all_files(t).groupBy(tx.file_kind(F.col("ext")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("b2_output_format", "ext:s video:b fmt:s n:l", with_tables("media", f"""
    SELECT ext, {_in('ext', _VIDEO)} AS video, CASE WHEN {_in('ext', _VIDEO)} THEN 'mp4' ELSE 'mp3' END AS fmt,
           count(*) AS n FROM media GROUP BY 1, 2, 3"""))
def b2(t):
    ext = F.col("ext")
    return fx.media_files(t).groupBy(
        "ext", tx.is_video(ext).alias("video"), tx.output_format(ext).alias("fmt")
    ).agg(F.count(F.lit(1)).alias("n"))


_SEVERITY = (
    "CASE WHEN regexp_matches(lower(msg), '失败|错误|异常|中止|不存在|error|failed') THEN 'error' "
    "WHEN regexp_matches(lower(msg), '警告|warn') THEN 'warning' "
    "WHEN regexp_matches(lower(msg), '完成|成功|done|success') THEN 'success' ELSE 'info' END"
)


@query("b7_log_severity", "kind:s severity:s n:l",
       with_tables("job_events", f"SELECT kind, {_SEVERITY} AS severity, count(*) AS n FROM job_events GROUP BY 1, 2"))
def b7(t):
    return fx.job_events(t).groupBy("kind", tx.severity(F.col("msg")).alias("severity")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("b8_progress_in_text", "event_id:l pct:l", with_tables("job_events", """
    SELECT event_id, least(99, CASE WHEN regexp_matches(msg, '[0-9]%')
        THEN CAST(floor(CAST(regexp_extract(msg, '([0-9]+(\\.[0-9]+)?)%', 1) AS DOUBLE)) AS BIGINT)
        WHEN regexp_matches(msg, '^[0-9]+/100$') THEN CAST(split_part(msg, '/', 1) AS BIGINT) ELSE NULL END) AS pct
    FROM job_events WHERE kind IN ('click', 'view')
    UNION ALL SELECT event_id, NULL FROM job_events WHERE kind NOT IN ('click', 'view')"""))
def b8(t):
    return fx.job_events(t).select("event_id", tx.progress_in_text(F.col("msg")).alias("pct"))


@query("b9_log_lines", "event_id:l line:s label:s msg:s", with_tables("job_events", """
    SELECT event_id, strftime(ts, '[%H:%M:%S] ') || '[' || task_id || '] ' || msg AS line, task_id AS label, msg
    FROM job_events"""))
def b9(t):
    e = fx.job_events(t).withColumn("own", tx.attribute_message(F.col("task_id"), F.col("msg")))
    parts = tx.message_parts(F.col("own"))
    return e.select(
        "event_id", tx.stamp_message(F.col("ts"), F.col("own")).alias("line"), parts["label"].alias("label"),
        parts["msg"].alias("msg"),
    )


# Every line twice: as it is, and wrapped in an ideographic space and a tab with blank ones beside it.
@query("b10_non_blank", "n_lines:l n_kept:l n_chars:l", with_tables("plain", """
    SELECT count(*) * 2 AS n_lines, count(*) AS n_kept, sum(length(text)) AS n_chars FROM plain"""))
def b10(t):
    lines = fx.line_requests(t).select("text")
    odd = lines.select(F.concat(F.lit("\u3000"), F.lit("\t"), F.lit(" ")).alias("text"))
    both = lines.select(F.concat(F.lit("\u3000\t"), "text", F.lit("\x85 ")).alias("text")).unionByName(odd)
    kept = tx.non_blank(F.col("text"))
    return both.agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(kept).alias("n_kept"),
        F.sum(F.length(tx.strip(F.col("text")))).alias("n_chars"),
    )


@query("d1_clip_names", "doc_id:l idx:l file_name:s",
       with_tables("plain", "SELECT doc_id, idx, file_name FROM clips", clips=_CLIP_NAMES))
def d1(t):
    return fx.line_requests(t).select(
        "doc_id", "idx", tx.clip_name(F.col("idx"), F.col("ts_text"), F.col("text")).alias("file_name")
    )


@query("d2_clip_name_parts", "doc_id:l idx:l seq:l start_ms:l short_text:s", with_tables("stamped", """
    SELECT doc_id, idx, idx AS seq, start_ms, CASE WHEN safe = '' THEN '无' ELSE substr(safe, 1, 2) END AS short_text
    FROM (SELECT *, regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g') AS safe FROM stamped)"""))
def d2(t):
    from ..operators.cues import parse_lrc

    cues = parse_lrc(fx.sources(t, "lrc"))
    name = tx.clip_name(F.col("idx"), F.col("ts_text"), F.col("text"))
    named = cues.select(F.col("source_id").alias("doc_id"), "idx", name.alias("name"))
    return named.select("doc_id", "idx", tx.clip_parts(F.col("name")).alias("p")).select("doc_id", "idx", "p.*")


@query("d4_sanitized_names", "page_id:l name:s",
       r"""SELECT page_id, trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')) AS name FROM pages""")
def d4(t):
    return t.pages.select("page_id", tx.sanitize_name(F.col("url")).alias("name"))


_PATH = "split_part(split_part(regexp_replace(url, '^[a-z]+:/', ''), '?', 1), '#', 1)"


def _url_path():
    return F.substring_index(F.substring_index(F.regexp_replace("url", "^[a-z]+:/", ""), "?", 1), "#", 1)


@query("d5_path_parts", "page_id:l dir:s base:s stem:s ext:s", f"""
    SELECT page_id, regexp_extract(p, '^(.*)/[^/]*$', 1) AS dir, base,
           CASE WHEN dot > 0 THEN substr(base, 1, length(base) - dot) ELSE base END AS stem,
           CASE WHEN dot > 0 THEN lower(right(base, dot - 1)) ELSE '' END AS ext
    FROM (SELECT *, CASE WHEN regexp_matches(base, '[^.].*\\.[^.]*$') AND base NOT LIKE '.%'
                         THEN length(regexp_extract(base, '\\.[^.]*$')) ELSE 0 END AS dot
          FROM (SELECT page_id, {_PATH} AS p, regexp_extract({_PATH}, '[^/]*$') AS base FROM pages))""")
def d5(t):
    p = _url_path()
    base = tx.base_name(p)
    return t.pages.select(
        "page_id", tx.dir_name(p).alias("dir"), base.alias("base"), tx.stem_of(base).alias("stem"),
        tx.ext_of(base).alias("ext"),
    )


@query("d6_cache_keys", "doc_id:l idx:l cache_key:s",
       with_tables("plain", "SELECT doc_id, idx, cache_key FROM plain"))
def d6(t):
    return fx.line_requests(t)


@query("d7_voice_keys", "doc_id:l cache_key:s",
       "SELECT doc_id, md5(text || '|' || lang || '|edge_tts|12') AS cache_key FROM documents")
def d7(t):
    return t.documents.select("doc_id", tx.voice_key(F.col("text"), F.col("lang"), F.lit(12)).alias("cache_key"))


@query("d8_fingerprints", "doc_id:l fingerprint:s",
       "SELECT doc_id, substr(md5(text), 1, 8) AS fingerprint FROM documents")
def d8(t):
    return t.documents.select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))


@query("d9_identifiers", "o_orderkey:l task_label:s group_label:s task_key:s", """
    SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_task' || o_orderkey AS task_label,
           'grp_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_' || o_custkey AS group_label,
           md5('/jobs/' || o_orderkey) AS task_key FROM orders""")
def d9(t):
    at = F.col("o_orderdate")
    key = F.col("o_orderkey").cast("string")
    return t.orders.select(
        "o_orderkey", tx.task_label(at, F.concat(F.lit("task"), key)).alias("task_label"),
        tx.group_label(at, F.col("o_custkey")).alias("group_label"),
        tx.task_key(F.concat(F.lit("/jobs/"), key)).alias("task_key"),
    )


@query("d10_eta_text", "o_orderkey:l eta:s", """
    SELECT o_orderkey, CASE WHEN s <= 0 THEN '计算中...'
        WHEN s >= 3600 THEN w // 3600 || '小时' || (w % 3600) // 60 || '分' || w % 60 || '秒'
        WHEN s >= 60 THEN w // 60 || '分' || w % 60 || '秒' ELSE w || '秒' END AS eta
    FROM (SELECT o_orderkey, o_totalprice / 20 - 100 AS s,
                 CAST(floor(o_totalprice / 20 - 100) AS BIGINT) AS w FROM orders)""")
def d10(t):
    return t.orders.select("o_orderkey", tx.eta_text(F.col("o_totalprice") / 20 - 100).alias("eta"))


@query("d11_gain", "event_id:l linear:d clamped:d", """
    SELECT event_id, pow(10, greatest(-50, least(50, value - 100)) / 20) AS linear, greatest(-50, least(50, value - 100)) AS clamped
    FROM events""")
def d11(t):
    db = F.col("value") - 100
    return t.events.select("event_id", sd.db_to_linear(sd.clamp_gain(db)).alias("linear"), sd.clamp_gain(db).alias("clamped"))


@query("d12_pan", "event_id:l l:d r:d", """
    SELECT event_id, cos(radians(event_id % 181) / 2) AS l, sin(radians(event_id % 181) / 2) AS r FROM events""")
def d12(t):
    a = F.col("event_id") % 181
    return t.events.select("event_id", sd.pan_left(a).alias("l"), sd.pan_right(a).alias("r"))


@query("d13_soft_limit", "signal_id:s channel:l block_no:l total:l lowest:l highest:l", with_tables("samples", """
    SELECT signal_id, channel, block_no, sum(y) AS total, min(y) AS lowest, max(y) AS highest FROM (
        SELECT *, CAST(trunc(greatest(-32768.0, least(32767.0, sign(x) * 32767.0 *
            CASE WHEN abs(x) / 32767.0 > 0.9 THEN 0.9 + tanh((abs(x) / 32767.0 - 0.9) / (1.0::DOUBLE - 0.9::DOUBLE)) * (1.0::DOUBLE - 0.9::DOUBLE)
                 ELSE abs(x) / 32767.0 END))) AS BIGINT) AS y
        FROM (SELECT *, value * 5 AS x FROM samples)) GROUP BY 1, 2, 3"""))
def d13(t):
    from ..operators.mixing import limit_blocks

    loud = fx.blocks(t).withColumn("samples", F.transform("samples", lambda x: x * 5))
    y = F.col("samples")
    return limit_blocks(loud, 2).select(
        "signal_id", "channel", "block_no",
        F.aggregate(y, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.array_min(y).alias("lowest"), F.array_max(y).alias("highest"),
    )


@query("d14_angle_of_side", "side:s angle:l n:l", """
    SELECT side, CASE side WHEN 'left' THEN 155 WHEN 'right' THEN 25 WHEN 'both' THEN 135 ELSE 180 END AS angle,
           count(*) AS n
    FROM (SELECT CASE event_type WHEN 'click' THEN 'left' WHEN 'view' THEN 'right' WHEN 'error' THEN 'both'
                 ELSE event_type END AS side FROM events) GROUP BY 1, 2""")
def d14(t):
    kind = F.col("event_type")
    side = F.when(kind == "click", "left").when(kind == "view", "right").when(kind == "error", "both").otherwise(kind)
    e = t.events.select(side.alias("side"))
    return e.groupBy("side", sd.angle_of_side(F.col("side")).alias("angle")).agg(F.count(F.lit(1)).alias("n"))


# Part sizes pick a bitrate and a rate, so some settings equal a preset and some do not.
@query("d15_presets", "p_partkey:l preset:s bitrate:s", """
    SELECT p_partkey, CASE WHEN r = 0 AND rate = 44100 THEN 'low' WHEN r = 1 AND rate = 44100 THEN 'standard'
        WHEN r = 2 AND rate = 44100 THEN 'high' WHEN r = 3 AND rate = 48000 THEN 'extreme' ELSE 'custom' END AS preset,
        CASE WHEN r = 0 AND rate = 44100 THEN '128k' WHEN r = 1 AND rate = 44100 THEN '192k'
        WHEN r = 2 AND rate = 44100 THEN '256k' WHEN r = 3 AND rate = 48000 THEN '320k' ELSE NULL END AS bitrate
    FROM (SELECT p_partkey, p_size % 4 AS r, CASE WHEN p_partkey % 3 = 0 THEN 48000 ELSE 44100 END AS rate FROM part)""")
def d15(t):
    rates = F.array(*[F.lit(p[1]) for p in K.PRESETS])
    settings = t.part.select(
        "p_partkey", F.element_at(rates, F.col("p_size") % 4 + 1).alias("bitrate"),
        F.when(F.col("p_partkey") % 3 == 0, 48000).otherwise(44100).alias("sample_rate"),
        F.lit(2).alias("channels"),
    )
    named = ma.resolve_preset(settings).select("p_partkey", "preset")
    return ma.preset_parameters(named)


@query("d16_percents", "event_id:l plain:l in_span:l across:l", """
    SELECT event_id, least(100, CAST(trunc(event_id % 150 * 100 / 120) AS BIGINT)) AS plain,
           CAST(least(100, 33 + trunc(pct / 100.0::DOUBLE * 33)) AS BIGINT) AS in_span,
           CAST(least(100, trunc((event_id % 4 / 4 + pct / 100.0::DOUBLE / 4) * 100)) AS BIGINT) AS across
    FROM (SELECT event_id, least(99, CAST(floor(value / 5) AS BIGINT)) AS pct FROM events)""")
def d16(t):
    e = fx.job_events(t)
    return e.select(
        "event_id",
        tx.percent(F.col("event_id") % 150, F.lit(120)).alias("plain"),
        tx.percent_in_span(F.col("pct"), F.lit(33), F.lit(33)).alias("in_span"),
        tx.percent_across(F.col("pct"), F.col("event_id") % 4, F.lit(4)).alias("across"),
    )


@query("d17_prefix_variants", "page_id:l depth:l path:s", f"""
    SELECT page_id, n - k AS depth,
           '/' || array_to_string(list_transform(parts, lambda p, i: CASE WHEN i <> k THEN p
               WHEN p LIKE '双语-_%' THEN substr(p, 4) ELSE '双语-' || p END), '/') || '/' || base AS path
    FROM (SELECT *, len(parts) AS n, unnest(range(1, len(parts) + 1)) AS k FROM (
        SELECT page_id, regexp_extract(p, '[^/]*$') AS base,
               list_filter(string_split(regexp_extract(p, '^(.*)/[^/]*$', 1), '/'), lambda x: x <> '') AS parts
        FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/双语-a' || {_PATH} ELSE {_PATH} END AS p FROM pages)))""")
def d17(t):
    p = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/双语-a"), _url_path())).otherwise(_url_path())
    return t.pages.select("page_id", F.explode(tx.prefix_variants(p)).alias("v")).select("page_id", "v.*")
