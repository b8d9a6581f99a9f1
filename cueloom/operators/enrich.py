"""Batched enrichment: endpoints, micro-batches, retry, fallback.

A user function computes results for a list of texts. It runs inside ``mapInPandas``; failures come back
as rows, never as a failed job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as CallTimeout

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.scan import global_rank, segmented_scan
from ..session import freeze, fresh_dir
from .reuse import count_reuse, distinct_work, live_entries, merge_results, upsert_cache

Compute = Callable[[Sequence[str], str, str], Sequence[str | Exception | None]]
"""(texts, model, endpoint) -> one result path per text, in order; may return fewer, or raise.

``None`` or an exception in place of a path is the failure of that text alone. ``endpoint`` is the name the work was
spread to, empty without endpoints."""

#: Seconds an attempt for one text may take, and a call for many.
SINGLE_LIMIT_S, BULK_LIMIT_S = 15.0, 300.0

#: MB of files that one task of a round of :func:`in_rounds` gets, on average.
ROUND_MB = 64

RESULT_SCHEMA = (
    "cache_key string, text string, model string, endpoint string, result_path string, ok boolean, message string, "
    "attempts int, called_us long, answered_us long"
)


class NoResult(Exception):
    """Raised by a user function that answered without results."""


# --- endpoints --------------------------------------------------------------

def available_endpoints(endpoints: DataFrame, multi: bool, current: int = 0) -> DataFrame:
    """Endpoints (pos, status, ..) to use.

    Multi mode uses all that answer; if none does, or in single mode, the current one, or the first when
    the current index is out of range.
    """
    usable = F.col("status") == "success"
    facts = endpoints.agg(
        F.max(usable).alias("any_ok"), F.max(F.col("pos") == current).alias("has_current")
    )
    any_ok = F.coalesce(facts.select("any_ok").scalar(), F.lit(False))
    has_current = F.coalesce(facts.select("has_current").scalar(), F.lit(False))
    first = endpoints.select(F.min("pos")).scalar()
    single = F.when(has_current, F.col("pos") == current).otherwise(F.col("pos") == first)
    return endpoints.filter(F.when(any_ok, usable).otherwise(single) if multi else single)


def endpoint_summary(endpoints: DataFrame) -> DataFrame:
    """endpoints and usable ones."""
    return endpoints.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("status") == "success").alias("n_usable")
    )


def spread_over_endpoints(work: DataFrame, n_endpoints: Column | int, key: str = "cache_key") -> DataFrame:
    """K4: work with ``slot`` 0..n-1 by a hash of its key; the same key goes to the same endpoint."""
    n = F.lit(n_endpoints) if isinstance(n_endpoints, int) else n_endpoints
    return work.withColumn("slot", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long"), n))


def assign_endpoints(work: DataFrame, endpoints: DataFrame, key: str = "cache_key") -> DataFrame:
    """K4: work with the ``endpoint`` (name) its key is spread to, of ``endpoints(pos, name)`` in order of ``pos``.

    The endpoints are numbered by a sort and met by that number, so their list may be of any length and never passes
    through the driver. Without any the endpoint is empty.
    """
    named = endpoints.select("pos", F.col("name").alias("endpoint"))
    numbered = global_rank(named, ["pos", "endpoint"], "_rank").select((F.col("_rank") - 1).alias("slot"), "endpoint")
    n = F.nullif(endpoints.select(F.count(F.lit(1))).scalar(), F.lit(0))
    return spread_over_endpoints(work, n, key).join(numbered, "slot", "left").withColumn(
        "endpoint", F.coalesce("endpoint", F.lit(""))
    ).select(*work.columns, "endpoint")


def number_micro_batches(
    work: DataFrame, order: Sequence[str], chunk: Column | None, size: int = 20, keys: Sequence[str] = ()
) -> DataFrame:
    """``batch_no`` of consecutive groups of at most ``size`` rows per key, in order.

    Without keys the numbers run over the whole table: they come from one sort by range, so no task sees a row, or a
    chunk, of every other task.
    """
    if not keys:
        return global_rank(work, list(order), "_rn").withColumn("batch_no", F.floor((F.col("_rn") - 1) / size)).drop("_rn")
    ranked = segmented_scan(work, list(keys), list(order), chunk, rank="_rn")
    return ranked.withColumn("batch_no", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


# --- calls ------------------------------------------------------------------

class _Caller:
    """Makes calls in a thread that is kept for the next call: making one costs more than a short call."""

    def __init__(self):
        self._pool = None

    def within(self, compute: Compute, texts: Sequence[str], model: str, endpoint: str, limit_s: float | None) -> list:
        """The answer of one call; a call that takes longer than ``limit_s`` counts as lost."""
        if not limit_s:
            return list(compute(texts, model, endpoint))
        self._pool = self._pool or ThreadPoolExecutor(1)
        call = self._pool.submit(compute, texts, model, endpoint)
        try:
            return list(call.result(limit_s))
        except CallTimeout:
            raise ConnectionError(f"no answer in {limit_s:g} s") from None
        finally:
            if not call.done():
                # It is not waited for, so a hanging call keeps its thread but not the task.
                self._pool.shutdown(wait=False, cancel_futures=True)
                self._pool = None


def _failure(got) -> str | None:
    """Why one entry of an answer is no result, or None."""
    return K.MSG_NO_RESULT if got is None else str(got) if isinstance(got, Exception) else None


def call_one(
    compute: Compute, text: str, model: str, max_tries: int, pause_s: float, endpoint: str = "",
    limit_s: float | None = SINGLE_LIMIT_S, caller: _Caller | None = None,
):
    """K3: up to ``max_tries`` attempts of ``limit_s`` seconds with a pause; the last error is reported."""
    caller, error = caller or _Caller(), ""
    for attempt in range(1, max_tries + 1):
        try:
            got = caller.within(compute, [text], model, endpoint, limit_s)
            error = _failure(got[0]) if got else K.MSG_NO_RESULT
            if error is None:
                return got[0], True, K.MSG_DONE, attempt
        except Exception as exc:  # noqa: BLE001 - any failure of a call is a row
            error = str(exc)
        if attempt < max_tries:
            time.sleep(pause_s)
    return None, False, K.MSG_FAILED.format(n=max_tries, error=error), max_tries


def call_batch(
    compute: Compute, texts: Sequence[str], model: str, max_tries: int, pause_s: float, fallback: str,
    endpoint: str = "", limit_s: float | None = SINGLE_LIMIT_S, bulk_limit_s: float | None = BULK_LIMIT_S,
    caller: _Caller | None = None,
):
    """K2: one call for many texts: (path, ok, message, attempts) per text.

    Texts beyond a short answer fail, and so does a text whose entry is None or an exception. An answer without
    results or a lost connection falls back to one call per text; with ``fallback='any'`` every error does, otherwise
    other errors fail the batch.
    """
    caller = caller or _Caller()

    def singly():
        return [call_one(compute, t, model, max_tries, pause_s, endpoint, limit_s, caller) for t in texts]

    if len(texts) == 1:
        return singly()
    try:
        got = caller.within(compute, texts, model, endpoint, bulk_limit_s)
    except Exception as exc:  # noqa: BLE001
        if fallback == "any" or isinstance(exc, (NoResult, ConnectionError)):
            return singly()
        return [(None, False, str(exc), 1) for _ in texts]
    done = []
    for one in got[: len(texts)]:
        error = _failure(one)
        done.append((one, True, K.MSG_BULK_DONE, 1) if error is None else (None, False, error, 1))
    return done + [(None, False, K.MSG_NO_RESULT, 1)] * (len(texts) - len(done))


def enrich(
    work: DataFrame,
    compute: Compute,
    batch_size: int = 20,
    max_tries: int = 3,
    pause_s: float = 1.0,
    parallelism: int | None = None,
    fallback: str = "any",
    endpoints: DataFrame | None = None,
    limit_s: float | None = SINGLE_LIMIT_S,
    bulk_limit_s: float | None = BULK_LIMIT_S,
) -> DataFrame:
    """K1-K5: compute (cache_key, text, model) rows in batches of one model and endpoint.

    ``parallelism`` caps how many calls of this enrichment run at once: it is the partition count of its rounds, which
    run here and now, see :func:`in_rounds`. For a cap over several enrichments see :func:`enrich_together`. Rows are spread by key hash, so a model with most of the work still fills every partition. With
    ``endpoints`` (pos, name, status; see :func:`available_endpoints`) each row is called at the one its key is
    spread to.
    """

    rows = work.select("cache_key", "text", "model")
    rows = rows.withColumn("endpoint", F.lit("")) if endpoints is None else assign_endpoints(rows, endpoints)
    calls = _Calls([compute], batch_size, max_tries, pause_s, fallback, limit_s, bulk_limit_s)
    rows = rows.withColumn("job", F.lit(0))
    done = in_rounds(rows, calls, parallelism) if parallelism else rows.mapInPandas(calls.run, calls.schema)
    return done.drop("job")


def enrich_together(
    works: Sequence[tuple[DataFrame, Compute]], cap: int, endpoints: DataFrame | None = None, batch_size: int = 20,
    max_tries: int = 3, pause_s: float = 1.0, fallback: str = "any", limit_s: float | None = SINGLE_LIMIT_S,
    bulk_limit_s: float | None = BULK_LIMIT_S,
) -> DataFrame:
    """K5: several enrichments with one cap: (job, and the columns of :func:`enrich`), ``job`` the place in ``works``.

    All their rows go through the same rounds of ``cap`` tasks, each of which has one call under way (see
    :func:`in_rounds`), so the whole application makes at most ``cap`` calls at a time as long as its work goes through
    here (and Spark runs no task twice at once, ``spark.speculation``). ``called_us`` and ``answered_us`` tell when the call of a row began and ended.
    """
    rows = None
    for job, (work, _) in enumerate(works):
        part = work.select(F.lit(job).alias("job"), "cache_key", "text", "model")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("endpoint", F.lit("")) if endpoints is None else assign_endpoints(rows, endpoints)
    calls = _Calls([compute for _, compute in works], batch_size, max_tries, pause_s, fallback, limit_s, bulk_limit_s)
    return in_rounds(rows, calls, cap)


class _Calls:
    """The calls of one task, one after the other: batches of one job, model and endpoint."""

    schema = f"job int, {RESULT_SCHEMA}"

    def __init__(self, computes: Sequence[Compute], batch_size: int, max_tries: int, pause_s: float, fallback: str,
                 limit_s: float | None, bulk_limit_s: float | None):
        self._computes, self._batch_size = list(computes), batch_size
        self._options = (max_tries, pause_s, fallback)
        self._limits = (limit_s, bulk_limit_s)

    def run(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = _Caller()
        for pdf in batches:
            together: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(pdf["job"], pdf["model"], pdf["endpoint"])):
                together.setdefault(key, []).append(at)
            texts, answers = pdf["text"].tolist(), [()] * len(pdf)
            for (job, model, endpoint), places in together.items():
                for first in range(0, len(places), self._batch_size):
                    batch = places[first: first + self._batch_size]
                    began = time.time_ns() // 1000
                    got = call_batch(
                        self._computes[job], [texts[at] for at in batch], model, *self._options, endpoint, *self._limits,
                        caller,
                    )
                    ended = time.time_ns() // 1000
                    for at, answer in zip(batch, got):
                        answers[at] = (*answer, began, ended)
            if not answers:
                continue
            pdf[["result_path", "ok", "message", "attempts", "called_us", "answered_us"]] = answers
            yield pdf


def in_rounds(rows: DataFrame, calls: _Calls, cap: int) -> DataFrame:
    """K5: the results of ``calls`` for ``rows``, from rounds of ``cap`` tasks that run one after the other, here and now.

    The rows are written first. A round takes files of up to ``cap`` times ``ROUND_MB``, so more rows make more rounds,
    not larger tasks. Every call is made once, however often the results are read.
    """
    spark = rows.sparkSession
    at, path = fresh_dir(spark, "work"), fresh_dir(spark, "answers")
    rows.write.parquet(at)
    work = spark.read.schema(rows.schema).parquet(at)
    # One name and size per file.
    files = work.select("_metadata.file_name", "_metadata.file_size").distinct().collect()
    rounds, room = [[]], cap * ROUND_MB * 1_000_000
    for file in sorted(files):
        if room < file.file_size and rounds[-1]:
            rounds.append([])
            room = cap * ROUND_MB * 1_000_000
        rounds[-1].append(f"{at}/{file.file_name}")
        room -= file.file_size
    for names in rounds:
        part = spark.read.schema(work.schema).parquet(*names) if names else work
        part.repartition(cap, "cache_key").mapInPandas(calls.run, calls.schema).write.mode("append").parquet(path)
    return spark.read.schema(calls.schema).parquet(path)


def calls_under_way(results: DataFrame) -> DataFrame:
    """K5: how many calls of ``results`` (with ``called_us`` and ``answered_us``) were under way when each began.

    ``(called_us, running)`` for every distinct call: those begun up to then less those answered by then, from one scan.
    """
    calls = results.select("called_us", "answered_us").distinct()
    turns = calls.select(F.explode(F.array(
        F.struct(F.col("called_us").alias("at"), F.lit(1).alias("step"), F.col("answered_us").alias("other")),
        F.struct(F.col("answered_us").alias("at"), F.lit(-1).alias("step"), F.col("called_us").alias("other")),
    )).alias("t")).select("t.*")
    scanned = segmented_scan(turns, [], ["at", "step", "other"], None, sums={"running": "step"})
    return scanned.filter("step = 1").select(F.col("at").alias("called_us"), "running")


def to_cache_rows(results: DataFrame, created_at: Column, batch_no: int = 0) -> DataFrame:
    """Successful results as new cache rows, with the endpoint that made them."""
    return results.filter("ok").select(
        "cache_key", "text", "result_path", "model", "endpoint",
        created_at.alias("created_at"), F.lit(None).cast("long").alias("file_size"),
        F.lit(batch_no).alias("batch_no"),
    )


def cached_enrichment(
    requests: DataFrame, cache: DataFrame, compute: Compute, created_at: Column, files: DataFrame | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """K1: (requests with outcome, new cache).

    A cache row counts only if its file is in ``files`` (path); without ``files`` all rows count. Distinct contents are
    taken before the cache lookup (K6), so a content requested many times is looked up and computed once. The computed
    rows are written to the shared folder before anything uses them, so no call is made twice for the two results.
    The new cache has no rows whose file is gone, one more use for every request that a kept row answers, and the
    computed rows with a use count of 1.
    """
    usable = cache if files is None else live_entries(cache, files)
    fresh = freeze(fresh_results(requests, usable, compute, **options))
    outcome = merge_results(requests, usable, fresh)
    return outcome, upsert_cache(count_reuse(usable, requests), to_cache_rows(fresh, created_at))


def fresh_results(requests: DataFrame, cache: DataFrame, compute: Compute, **options) -> DataFrame:
    """Computed results of the distinct contents the cache lacks."""
    todo = distinct_work(requests).join(cache.select("cache_key"), "cache_key", "left_anti")
    return enrich(todo, compute, **options)
