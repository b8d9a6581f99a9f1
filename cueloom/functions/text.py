"""Column functions on names, paths, keys and log text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character at both ends."""
    return F.btrim(c, F.lit(K.WHITESPACE))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def non_blank(c: Column) -> Column:
    """Text with something left after trimming."""
    return strip(c) != ""


# --- paths (D5) -------------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Everything before the last slash; ``/`` for a name under the root, empty without a slash."""
    before = F.length(path) - F.length(base_name(path)) - 1
    return F.when(before < 0, "").when(before == 0, "/").otherwise(F.left(path, before))


def dotted_ext(name: Column) -> Column:
    """Extension with its dot, as written; the last dot counts, leading dots do not."""
    return F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)$", 1)


def ext_of(name: Column) -> Column:
    """Lower-case extension without the dot."""
    return F.lower(F.ltrim(dotted_ext(name), F.lit(".")))


def stem_of(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(dotted_ext(name)))


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), name))


# --- file kinds -------------------------------------------------------------

def file_kind(ext: Column) -> Column:
    """B1: subtitle, dub audio, media or unsupported; the first that fits."""
    return (
        F.when(ext.isin(*K.SUBTITLE_EXTS), "subtitle")
        .when(ext.isin(*K.DUB_EXTS), "dub_audio")
        .when(ext.isin(*K.VIDEO_EXTS, *K.AUDIO_EXTS), "media")
        .otherwise("unsupported")
    )


def is_video(ext: Column) -> Column:
    """B2: true for the eight video extensions."""
    return ext.isin(*K.VIDEO_EXTS)


def output_format(ext: Column, wanted: Column | None = None) -> Column:
    """B2: the wanted format, else mp4 for video and mp3 for audio."""
    fallback = F.when(is_video(ext), "mp4").otherwise("mp3")
    return fallback if wanted is None else F.coalesce(wanted, fallback)


# --- names ------------------------------------------------------------------

def natural_key(s: Column) -> Column:
    """D3: sortable array; digit runs compare as numbers, other runs in lower case."""
    runs = F.regexp_extract_all(F.lower(s), F.lit("([0-9]+|[^0-9]+)"), 1)

    def part(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(
            run.rlike("^[0-9]"),
            F.struct(F.lit(0).alias("kind"), F.length(digits).alias("len"), digits.alias("val")),
        ).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("len"), run.alias("val")))

    return F.transform(runs, part)


def sanitize_name(name: Column) -> Column:
    """Characters that file systems reject become underscores."""
    return strip(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))


def short_text(text: Column) -> Column:
    """The first two CJK or ASCII alphanumeric characters; the match stops there."""
    kept, other = r"[\x{4e00}-\x{9fa5}a-zA-Z0-9]", r"[^\x{4e00}-\x{9fa5}a-zA-Z0-9]*"
    pattern = f"^{other}({kept})(?:{other}({kept}))?"
    two = F.concat(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2))
    return bind(two, lambda t: F.when(t == "", F.lit(K.NO_TEXT)).otherwise(t))


def clip_name(idx: Column, ts_text: Column, text: Column) -> Column:
    """``0001_00-00-01.50_Hi.wav``; more than four index digits stay whole."""
    number = idx.cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return F.concat(
        padded, F.lit("_"), F.translate(ts_text, ":", "-"), F.lit("_"), short_text(text), F.lit(".wav")
    )


def clip_parts(name: Column, exact: bool = False) -> Column:
    """struct(seq, start_ms, short_text) of a clip name, NULL when it does not parse.

    ``exact`` keeps the rule of exactly four index digits, which loses clips from 10000 on.
    """
    digits = "{4}" if exact else "{4,}"
    pattern = rf"(?s)^[0-9]{digits}_[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}\.[0-9]{{2}}_.+\.wav$"
    number = F.substring_index(name, "_", 1)
    at = F.length(number)
    return F.when(
        name.rlike(pattern),
        F.struct(
            number.cast("long").alias("seq"),
            stamp_ms(F.substring(name, at + 2, F.lit(11))).alias("start_ms"),
            F.substring(name, at + 14, F.length(name) - at - 17).alias("short_text"),
        ),
    )


def stamp_ms(stamp: Column) -> Column:
    """Milliseconds of an eleven-character ``HH:MM:SS.cc`` (any separators)."""

    def number(at: int) -> Column:
        return F.substring(stamp, at, 2).cast("long")

    return number(1) * 3600000 + number(4) * 60000 + number(7) * 1000 + number(10) * 10


def cache_key(text: Column, model: Column, version: Column, *extra: Column) -> Column:
    """MD5 of ``text|model|version``; NULL counts as empty. ``extra`` widens the key."""
    parts = [or_empty(c.cast("string")) for c in (text, model, version, *extra)]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def voice_key(text: Column, voice: Column, version: Column) -> Column:
    """Key of the voice mode."""
    joined = F.concat_ws("|", or_empty(text), or_empty(voice))
    return cache_key(joined, F.lit(K.VOICE_MODEL), version)


def file_version(mtime: Column) -> Column:
    """Whole seconds of a modification time, as the key's version part."""
    return F.unix_seconds(mtime).cast("string")


def fingerprint(content: Column) -> Column:
    """The first eight hex digits of the MD5 of whole content."""
    return F.substring(F.md5(content.cast("binary")), 1, 8)


def task_label(created_at: Column, source_name: Column) -> Column:
    """``YYYYMMDD_HHMMSS_name``, for display; rows are keyed by :func:`task_key`."""
    return F.concat_ws("_", F.date_format(created_at, "yyyyMMdd_HHmmss"), source_name)


def group_label(created_at: Column, number: Column) -> Column:
    """``grp_<time>_<n>``."""
    return F.concat_ws(
        "_", F.lit("grp"), F.date_format(created_at, "yyyyMMdd_HHmmss"), number.cast("string")
    )


def task_key(source_path: Column) -> Column:
    return F.md5(source_path.cast("binary"))


# --- progress and time left -------------------------------------------------

def eta_text(seconds: Column) -> Column:
    """``1小时2分5秒``; zero and less are unknown."""
    whole = F.floor(seconds)
    hours, minutes, secs = F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60
    h = F.concat(hours.cast("string"), F.lit(K.ETA_HOURS))
    m = F.concat(minutes.cast("string"), F.lit(K.ETA_MINUTES))
    s = F.concat(secs.cast("string"), F.lit(K.ETA_SECONDS))
    return (
        F.when(seconds <= 0, F.lit(K.ETA_UNKNOWN))
        .when(hours > 0, F.concat(h, m, s))
        .when(minutes > 0, F.concat(m, s))
        .otherwise(s)
    )


def percent(done: Column, total: Column) -> Column:
    """Whole percent in 0..100; an unknown total passes ``done`` through."""
    pct = (done * 100 / total).cast("long")
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), pct))).otherwise(done.cast("long"))


def percent_in_span(pct: Column, base: Column, span: Column) -> Column:
    """Percent of one item mapped to a sub-range."""
    mapped = base.cast("long") + (pct / 100.0 * span).cast("long")
    return F.greatest(F.lit(0), F.least(F.lit(100), mapped))


def percent_across(pct: Column, index: Column, total: Column) -> Column:
    """Percent over ``total`` items while item ``index`` is at ``pct``."""
    mapped = F.when(total > 1, ((index / total + pct / 100.0 / total) * 100).cast("long")).otherwise(
        pct.cast("long")
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), mapped))


# --- logs -------------------------------------------------------------------

def severity(msg: Column) -> Column:
    """Error, warning, success or info by the words in a message."""
    low = F.lower(msg)
    return (
        F.when(low.rlike("|".join(K.ERROR_WORDS)), "error")
        .when(low.rlike("|".join(K.WARNING_WORDS)), "warning")
        .when(low.rlike("|".join(K.SUCCESS_WORDS)), "success")
        .otherwise("info")
    )


def progress_in_text(msg: Column) -> Column:
    """``45.5%`` or ``3/4`` in a line as whole percent up to 99, else NULL."""
    share = F.regexp_extract(msg, r"([0-9]+(?:\.[0-9]+)?)%", 1)
    part = F.regexp_extract(msg, r"([0-9]+)/([0-9]+)", 1).try_cast("double")
    whole = F.regexp_extract(msg, r"([0-9]+)/([0-9]+)", 2).try_cast("double")
    pct = F.when(share != "", F.floor(share.try_cast("double"))).when(
        whole > 0, F.floor(part * 100 / whole)
    )
    return F.when(pct.isNotNull(), F.least(pct, F.lit(99)))


def attribute_message(task: Column, msg: Column) -> Column:
    """``[task] message``."""
    return F.format_string("[%s] %s", task, msg)


def stamp_message(ts: Column, msg: Column) -> Column:
    """``[HH:MM:SS] message``."""
    return F.format_string("[%s] %s", F.date_format(ts, "HH:mm:ss"), msg)


def message_parts(line: Column) -> Column:
    """Inverse of B9: struct(label, msg)."""
    pattern = r"(?s)^\[([^\]]+)\] (.*)$"
    return F.struct(
        F.regexp_extract(line, pattern, 1).alias("label"),
        F.regexp_extract(line, pattern, 2).alias("msg"),
    )


# --- prefixed directories (D17) ---------------------------------------------

def toggle_prefix(segment: Column) -> Column:
    bare = F.substring(segment, F.lit(len(K.BILINGUAL_PREFIX) + 1), F.length(segment))
    return F.when(
        segment.startswith(K.BILINGUAL_PREFIX) & (F.length(segment) > len(K.BILINGUAL_PREFIX)), bare
    ).otherwise(F.concat(F.lit(K.BILINGUAL_PREFIX), segment))


def prefix_variants(path: Column) -> Column:
    """The path with each directory's prefix toggled, nearest directory first.

    Array of struct(depth, path); empty for a path without directories.
    """
    root = F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    none = F.array().cast("array<struct<depth:int,path:string>>")

    def variants(known: Column) -> Column:
        parts, last = known["parts"], F.size(known["parts"]) - 1

        def variant(depth: Column) -> Column:
            at = last - depth
            rebuilt = F.concat(
                F.slice(parts, F.lit(1), at), F.array(toggle_prefix(F.get(parts, at))), F.slice(parts, at + 2, depth)
            )
            whole = F.concat(known["root"], F.array_join(rebuilt, "/"), F.lit("/"), known["name"])
            return F.struct(depth.alias("depth"), whole.alias("path"))

        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), variant)).otherwise(none)

    parts = F.filter(F.split(dir_name(path), "/"), lambda p: (p != "") & (p != "."))
    return bind(F.struct(parts.alias("parts"), root.alias("root"), base_name(path).alias("name")), variants)


def ancestors(path: Column) -> Column:
    """All directories above a path, without a trailing slash."""

    def above(parts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
        )

    return bind(F.split(dir_name(path), "/"), above)
