"""Queries on endpoints and enrichment."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import functions as F

from ..operators import enrich as en
from ..session import freeze
from . import fixtures as fx
from .oracle import with_tables
from .registry import query


def _endpoints(t, ok="s_acctbal > 5000"):
    """Suppliers as endpoints; the rich ones answer."""
    return t.supplier.select(
        F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"),
        F.when(F.expr(ok), "success").otherwise("failed").alias("status"),
    )


@query("b6_endpoints_multi", "pos:l name:s", "SELECT s_suppkey AS pos, s_name AS name FROM supplier WHERE s_acctbal > 5000")
def b6(t):
    return en.available_endpoints(_endpoints(t), multi=True)


@query("b6_endpoints_fallback", "pos:l name:s", "SELECT s_suppkey AS pos, s_name AS name FROM supplier WHERE s_suppkey = 1")
def b6_fallback(t):
    return en.available_endpoints(_endpoints(t, "s_acctbal > 1e9"), multi=True, current=1)


@query("b6_endpoints_single", "pos:l name:s", "SELECT s_suppkey AS pos, s_name AS name FROM supplier WHERE s_suppkey = 0")
def b6_single(t):
    return en.available_endpoints(_endpoints(t), multi=False, current=1_000_000_000)


@query("f22_endpoint_health", "n_total:l n_usable:l",
       "SELECT count(*) AS n_total, count_if(s_acctbal > 5000) AS n_usable FROM supplier")
def f22(t):
    return en.endpoint_summary(_endpoints(t))


@query("g10_micro_batches", "source:s batch_no:l n:l first:l last:l", with_tables("plain", """
    SELECT source, batch_no, count(*) AS n, min(pos) AS first, max(pos) AS last FROM (
        SELECT source, doc_id * 100000 + idx AS pos,
               (row_number() OVER (PARTITION BY source ORDER BY doc_id * 100000 + idx) - 1) // 20 AS batch_no FROM plain)
    GROUP BY 1, 2"""))
def g10(t):
    work = fx.line_requests(t).select("source", (F.col("doc_id") * 100_000 + F.col("idx")).alias("pos"))
    numbered = en.number_micro_batches(work, ["pos"], F.floor(F.col("pos") / 100_000_000), 20, ["source"])
    return numbered.groupBy("source", "batch_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last")
    )


@query("k4_endpoint_slots", "slot:l n:l", with_tables("plain", """
    SELECT CAST('0x' || substr(md5(cache_key), 1, 8) AS BIGINT) % 5 AS slot, count(*) AS n FROM plain GROUP BY 1"""))
def k4(t):
    return en.spread_over_endpoints(fx.line_requests(t), 5).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))


def _named_speech(texts, model, endpoint):
    """A service whose paths tell which endpoint was called."""
    return [f"/{endpoint}/{p}" for p in _fake_speech(texts, model)]


@query("k4_calls_per_endpoint", "name:s n:l", with_tables("doc_keys", """
    SELECT name, count(*) AS n FROM (SELECT DISTINCT cache_key FROM doc_keys) JOIN (
        SELECT s_name AS name, row_number() OVER (ORDER BY s_suppkey) - 1 AS slot, count(*) OVER () AS m
        FROM supplier WHERE s_acctbal > 5000)
        ON CAST('0x' || substr(md5(cache_key), 1, 8) AS BIGINT) % m = slot GROUP BY 1"""))
def k4_calls(t):
    from ..operators.reuse import distinct_work

    up = en.available_endpoints(_endpoints(t), multi=True)
    done = en.enrich(distinct_work(fx.doc_requests(t)), _named_speech, pause_s=0.0, parallelism=4, endpoints=up)
    called = F.split("result_path", "/")[1]
    return done.groupBy(called.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def _fake_speech(texts, model, endpoint=""):
    """Stands for a speech service: one path per text, after its content."""
    return [f"/made/{hashlib.md5(x.encode('utf-8')).hexdigest()}" for x in texts]


def _short_answers(texts, model, endpoint=""):
    """A service that answers bulk calls without results and refuses texts of an even length."""
    if len(texts) > 1:
        raise en.NoResult("bulk")
    if len(texts[0]) % 2 == 0:
        raise ValueError("even")
    return _fake_speech(texts, model)


def _cached(t):
    """Cached enrichment of all documents; some results' files are gone."""
    return en.cached_enrichment(
        fx.doc_requests(t), fx.result_cache(t), _fake_speech, F.timestamp_seconds(F.lit(1800000000)), fx.cache_files(t),
        pause_s=0.0, parallelism=4,
    )


@query("k1_cached_enrichment", "doc_id:l ok:b result_path:s message:s", with_tables("doc_keys cache files", """
    SELECT d.doc_id, true AS ok, coalesce(c.result_path, '/made/' || md5(d.text)) AS result_path,
           CASE WHEN c.cache_key IS NULL THEN '批量完成' ELSE '缓存复用' END AS message
    FROM doc_keys d LEFT JOIN (SELECT * FROM cache WHERE result_path IN (SELECT path FROM files)) c USING (cache_key)"""))
def k1(t):
    # A batch with a single text reports as a single call; only the outcome is compared.
    outcome, _ = _cached(t)
    return outcome.withColumn("message", F.when(F.col("message") == "完成", "批量完成").otherwise(F.col("message")))


@query("k1_new_cache", "cache_key:s result_path:s use_count:l", with_tables("doc_keys cache files", """
    SELECT cache_key, coalesce(any_value(c.result_path), '/made/' || md5(any_value(d.text))) AS result_path,
           CASE WHEN any_value(c.result_path) IS NULL THEN 1 ELSE 1 + count(*) END AS use_count
    FROM doc_keys d LEFT JOIN (SELECT * FROM cache WHERE result_path IN (SELECT path FROM files)) c USING (cache_key)
    GROUP BY cache_key"""))
def k1_cache(t):
    return _cached(t)[1]


@query("k2_bulk_fallback", "cache_key:s ok:b message:s", with_tables("doc_keys", """
    SELECT DISTINCT cache_key, length(text) % 2 = 1 AS ok,
           CASE WHEN length(text) % 2 = 1 THEN '完成' ELSE '失败(已重试2次): even' END AS message FROM doc_keys"""))
def k2(t):
    from ..operators.reuse import distinct_work

    work = distinct_work(fx.doc_requests(t))
    return en.enrich(work, _short_answers, batch_size=7, max_tries=2, pause_s=0.0, parallelism=4)


def _holed_answers(texts, model, endpoint=""):
    """A bulk service that leaves a hole for texts of an even length, and an error for those of a length by 5."""
    def one(x):
        return ValueError("five") if len(x) % 5 == 0 else None if len(x) % 2 == 0 else f"/made/{len(x)}"

    return [one(x) for x in texts]


@query("k2_row_failures", "cache_key:s ok:b message:s", with_tables("doc_keys", """
    SELECT DISTINCT cache_key, length(text) % 5 <> 0 AND length(text) % 2 = 1 AS ok,
           CASE WHEN length(text) % 5 = 0 THEN 'five' WHEN length(text) % 2 = 0 THEN '服务器未返回音频' ELSE '完成' END AS message
    FROM doc_keys"""))
def k2_holes(t):
    from ..operators.reuse import distinct_work

    work = distinct_work(fx.doc_requests(t))
    done = en.enrich(work, _holed_answers, batch_size=7, max_tries=1, pause_s=0.0, parallelism=4)
    # A batch of one text is a single call, whose messages are worded differently.
    plain = F.regexp_replace(F.regexp_replace("message", "^失败\\(已重试1次\\): ", ""), "^批量完成$", "完成")
    return done.withColumn("message", plain)


@query("k3_attempts", "attempts:l n:l", with_tables("doc_keys", """
    SELECT CASE WHEN length(text) % 2 = 1 THEN 1 ELSE 3 END AS attempts, count(*) AS n
    FROM (SELECT DISTINCT cache_key, text FROM doc_keys) GROUP BY 1"""))
def k3(t):
    from ..operators.reuse import distinct_work

    work = distinct_work(fx.doc_requests(t))
    done = en.enrich(work, _short_answers, batch_size=1, max_tries=3, pause_s=0.0, parallelism=4)
    return done.groupBy("attempts").agg(F.count(F.lit(1)).alias("n"))


def _slow_speech(texts, model, endpoint=""):
    """A service that takes a while."""
    time.sleep(0.003)
    return _fake_speech(texts, model)


# Two enrichments with one cap; what overlaps is measured by when calls began and ended.
@query("k5_call_cap", "within_cap:b n:l", with_tables("doc_keys", """
    SELECT true AS within_cap, count(DISTINCT cache_key) AS n FROM doc_keys"""))
def k5(t):
    from ..operators.reuse import distinct_work

    work = distinct_work(fx.doc_requests(t))
    even = F.crc32(F.col("cache_key").cast("binary")) % 2 == 0
    done = freeze(en.enrich_together([(work.filter(even), _fake_speech), (work.filter(~even), _slow_speech)], 3, pause_s=0.0))
    most = en.calls_under_way(done).agg(F.max("running").alias("m"))
    return done.agg(F.countDistinct("cache_key").alias("n")).select((most.select("m").scalar() <= 3).alias("within_cap"), "n")
