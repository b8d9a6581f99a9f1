"""Queries on the result cache (A6, A7, E5-E7, E9, E17, F1, F2, F21, I2, K6) and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import matching as ma
from ..operators import reuse as ru
from ..session import fresh_dir
from ..sources import tables as tb
from . import fixtures as fx
from .oracle import with_tables
from .registry import query

_LINE_CACHE = """
    SELECT DISTINCT cache_key FROM plain WHERE doc_id % 3 = 0"""


@query("flagship_reuse_by_source", "source:s n_cues:l n_texts:l n_reused:l n_to_compute:l", with_tables("plain", """
    SELECT source, sum(n) AS n_cues, count(*) AS n_texts, sum(CASE WHEN k.cache_key IS NULL THEN 0 ELSE n END) AS n_reused,
           sum(CASE WHEN k.cache_key IS NULL THEN 1 ELSE 0 END) AS n_to_compute
    FROM (SELECT source, cache_key, count(*) AS n FROM plain GROUP BY 1, 2) c LEFT JOIN k USING (cache_key)
    GROUP BY source""", k=_LINE_CACHE))
def flagship(t):
    cues = fx.line_requests(t)
    cache = cues.filter(F.col("doc_id") % 3 == 0).select("cache_key").distinct()
    return ru.reuse_by_group(cues, cache, "source")


@query("a6_result_cache", "cache_key:s model:s file_size:l use_count:l",
       with_tables("cache", "SELECT * FROM cache"))
def a6(t):
    path = fresh_dir(t.spark, "cache")
    tb.write_result_cache(fx.result_cache(t), path)
    return tb.read_result_cache(t.spark, path)


# Documents in other languages than English are saved anew, some of the cached ones among them.
_UPSERTED = """
    SELECT cache_key, coalesce(n.result_path, c.result_path) AS result_path,
           CASE WHEN n.cache_key IS NULL THEN 'local' ELSE 'new' END AS endpoint, 1 AS use_count
    FROM cache c FULL JOIN n USING (cache_key)"""
_NEW = "SELECT cache_key, '/new/' || max(doc_id) AS result_path FROM doc_keys WHERE lang <> 'en' GROUP BY cache_key"


def _new_results(t):
    return fx.doc_requests(t).filter(F.col("model") != "en").select(
        "cache_key", "text", F.concat(F.lit("/new/"), F.col("doc_id").cast("string")).alias("result_path"), "model",
        F.lit("new").alias("endpoint"), F.timestamp_seconds(F.lit(1800000000) + F.col("doc_id")).alias("created_at"),
        F.length("text").cast("long").alias("file_size"), F.lit(1).alias("batch_no"),
    )


@query("a7_cache_upsert", "cache_key:s result_path:s endpoint:s use_count:l", with_tables("doc_keys cache", _UPSERTED, n=_NEW))
def a7(t):
    return ru.upsert_cache(fx.result_cache(t), _new_results(t))


@query("a7_bucketed_upsert", "cache_key:s result_path:s endpoint:s use_count:l", with_tables("doc_keys cache", _UPSERTED, n=_NEW))
def a7_buckets(t):
    path = fresh_dir(t.spark, "cache")
    tb.write_bucketed_cache(fx.result_cache(t), path, 16)
    ru.merge_into_cache(t.spark, path, _new_results(t))
    return tb.read_bucketed_cache(t.spark, path)


@query("e5_cache_hits", "doc_id:l result_path:s", with_tables("doc_keys files", """
    SELECT doc_id, path AS result_path FROM doc_keys JOIN files ON path = '/cache/' || cache_key || '.wav'"""))
def e5(t):
    return ru.cache_hits(fx.doc_requests(t).select("doc_id", "cache_key"), fx.result_cache(t), fx.cache_files(t))


@query("e6_cache_misses", "doc_id:l cache_key:s", with_tables("doc_keys files", """
    SELECT doc_id, cache_key FROM doc_keys
    WHERE NOT EXISTS (SELECT 1 FROM files WHERE path = '/cache/' || cache_key || '.wav')"""))
def e6(t):
    return ru.cache_misses(fx.doc_requests(t).select("doc_id", "cache_key"), fx.result_cache(t), fx.cache_files(t))


# Clips of the documents in other languages than English are there already.
@query("e7_missing_outputs", "doc_id:l idx:l file_name:s", with_tables("plain", """
    SELECT doc_id, idx, file_name FROM named a WHERE NOT EXISTS (
        SELECT 1 FROM named b WHERE b.lang <> 'en' AND b.source = a.source AND b.file_name = a.file_name)""",
    named="""
    SELECT doc_id, idx, source, lang, printf('%04d', CAST(idx AS INTEGER)) || '_00-00-00.00_' ||
           CASE WHEN safe = '' THEN '无' ELSE substr(safe, 1, 2) END || '.wav' AS file_name
    FROM (SELECT *, regexp_replace(text, '[^\\x{4e00}-\\x{9fa5}a-zA-Z0-9]', '', 'g') AS safe FROM plain)"""))
def e7(t):
    cues = fx.line_requests(t).select("doc_id", "idx", "ts_text", "text", F.col("source").alias("folder"), "model")
    name = tx.clip_name(F.col("idx"), F.col("ts_text"), F.col("text"))
    done = cues.filter(F.col("model") != "en").select("folder", name.alias("file_name")).distinct()
    return ru.missing_outputs(cues, done)


@query("e9_finished_speech", "doc_id:l speech_dir:s", with_tables("doc_keys cache", """
    SELECT doc_id, '/ws/' || substr(md5(text), 1, 8) AS speech_dir FROM doc_keys
    WHERE substr(md5(text), 1, 8) IN (SELECT substr(md5(text), 1, 8) FROM cache)"""))
def e9(t):
    tasks = t.documents.select("doc_id", F.lit("/ws").alias("workspace"), tx.fingerprint(F.col("text")).alias("fingerprint"))
    clips = fx.result_cache(t).select(
        F.concat(F.lit("/ws/"), tx.fingerprint(F.col("text"))).alias("dir"), F.lit("0001_00-00-00.00_a.wav").alias("name")
    )
    return ma.detect_speech(tasks, clips)


@query("e17_dangling_entries", "cache_key:s result_path:s", with_tables("cache files", """
    SELECT cache_key, result_path FROM cache WHERE result_path NOT IN (SELECT path FROM files)"""))
def e17(t):
    return ru.dangling_entries(fx.result_cache(t), fx.cache_files(t))


@query("f1_cache_stats", "total_count:l total_size:l total_reuse:l", with_tables("cache", """
    SELECT count(*) AS total_count, coalesce(sum(file_size), 0) AS total_size,
           coalesce(sum(use_count), 0) AS total_reuse FROM cache"""))
def f1(t):
    return ru.cache_stats(fx.result_cache(t))


@query("f2_reuse_counts", "cache_key:s use_count:l", with_tables("doc_keys cache", """
    SELECT cache_key, 1 + count(d.doc_id) AS use_count FROM cache LEFT JOIN doc_keys d USING (cache_key) GROUP BY 1"""))
def f2(t):
    return ru.count_reuse(fx.result_cache(t), fx.doc_requests(t))


@query("f21_clear_report", "deleted_rows:l deleted_files:l", with_tables("cache files", """
    SELECT count(*) AS deleted_rows, count(path) AS deleted_files FROM cache LEFT JOIN files ON path = result_path"""))
def f21(t):
    return ru.clear_report(fx.result_cache(t), fx.cache_files(t))


# Misses of English documents come back computed; the others get no answer.
@query("i2_merged_results", "doc_id:l ok:b result_path:s message:s", with_tables("doc_keys cache", """
    SELECT d.doc_id, c.cache_key IS NOT NULL OR f.cache_key IS NOT NULL AS ok,
           coalesce(c.result_path, '/new/' || f.cache_key) AS result_path,
           CASE WHEN c.cache_key IS NOT NULL THEN '缓存复用' WHEN f.cache_key IS NOT NULL THEN '批量完成'
                ELSE '服务器未返回音频' END AS message
    FROM doc_keys d LEFT JOIN cache c USING (cache_key)
    LEFT JOIN (SELECT DISTINCT cache_key FROM doc_keys WHERE lang = 'en') f USING (cache_key)"""))
def i2(t):
    requests = fx.doc_requests(t).select("doc_id", "model", "cache_key")
    cache = fx.result_cache(t)
    fresh = ru.cache_misses(requests, cache).filter(F.col("model") == "en").select(
        "cache_key", F.concat(F.lit("/new/"), "cache_key").alias("result_path"), F.lit(True).alias("ok"),
        F.lit("批量完成").alias("message"),
    )
    return ru.merge_results(requests, cache, fresh)


@query("k6_distinct_work", "cache_key:s n_requests:l",
       with_tables("plain", "SELECT cache_key, count(*) AS n_requests FROM plain GROUP BY 1"))
def k6(t):
    return ru.distinct_work(fx.line_requests(t))
