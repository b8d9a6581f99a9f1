"""Ordered computations that split large groups over many tasks.

A window over a key puts the whole key into one task. The functions here cut each key into chunks
along its order, run the window inside a chunk, and add what the earlier chunks contribute. The second
step sees one row per chunk, so a key with a third of all rows stays spread out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import freeze


def segmented_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | None,
    rank: str | None = None,
    size: str | None = None,
    lows: Mapping[str, str] | None = None,
    sums: Mapping[str, str] | None = None,
    lags: Mapping[str, str] | None = None,
    leads: Mapping[str, str] | None = None,
) -> DataFrame:
    """Row number, running sums (inclusive), previous and next values per key.

    ``chunk`` must not decrease along ``order`` within a key, and one chunk of a key goes to one task. Where
    no expression cuts evenly, ``None`` sorts the table by range, writes it, and takes the sort's partitions
    as chunks: these hold about the same number of rows whatever the keys and the order. ``lows``, ``sums``, ``lags`` and ``leads`` map
    a new column to an input column; previous and next are NULL at the ends. ``size`` is the number of rows
    and ``lows`` the smallest value of the whole key: the chunk table has them at no extra shuffle.
    ``order`` must be unique in a key.
    """
    lows, sums, lags, leads = dict(lows or {}), dict(sums or {}), dict(lags or {}), dict(leads or {})
    keys, order = list(keys), list(order)
    if chunk is None:
        cut = freeze(df.orderBy(*keys, *order).withColumn("_chunk", F.spark_partition_id()))
    else:
        cut = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)

    local = cut.withColumn("_rn", F.row_number().over(inside))
    for out, src in sums.items():
        local = local.withColumn(out, F.sum(src).over(upto))
    for out, src in lags.items():
        local = local.withColumn(out, F.lag(src).over(inside))
    if leads:
        local = local.withColumn("_last", F.lead(F.lit(False), 1, True).over(inside))
        for out, src in leads.items():
            local = local.withColumn(out, F.lead(src).over(inside))

    at = F.struct(*order)
    ends = [F.count(F.lit(1)).alias("_n")]
    ends += [F.min(src).alias(f"_low_{out}") for out, src in lows.items()]
    ends += [F.sum(src).alias(f"_sum_{out}") for out, src in sums.items()]
    ends += [F.max_by(F.struct(src), at).alias(f"_tail_{out}") for out, src in lags.items()]
    ends += [F.min_by(F.struct(src), at).alias(f"_head_{out}") for out, src in leads.items()]
    across = W.partitionBy(*keys).orderBy("_chunk")
    before = across.rowsBetween(W.unboundedPreceding, -1)
    entire = W.partitionBy(*keys)
    carry = cut.groupBy(*keys, "_chunk").agg(*ends).select(
        *keys,
        "_chunk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
        F.sum("_n").over(entire).alias("_whole"),
        *[F.min(f"_low_{o}").over(entire).alias(o) for o in lows],
        *[F.sum(f"_sum_{o}").over(before).alias(f"_sum_{o}") for o in sums],
        *[F.lag(f"_tail_{o}").over(across).alias(f"_tail_{o}") for o in lags],
        *[F.lead(f"_head_{o}").over(across).alias(f"_head_{o}") for o in leads],
    )

    joined = local.join(carry, [*keys, "_chunk"])
    if rank:
        joined = joined.withColumn(rank, F.col("_rn") + F.col("_base"))
    if size:
        joined = joined.withColumn(size, F.col("_whole"))
    for out in sums:
        joined = joined.withColumn(out, F.col(out) + F.coalesce(F.col(f"_sum_{out}"), F.lit(0)))
    for out, src in lags.items():
        joined = joined.withColumn(
            out, F.when(F.col("_rn") == 1, F.col(f"_tail_{out}")[src]).otherwise(F.col(out))
        )
    for out, src in leads.items():
        joined = joined.withColumn(
            out, F.when(F.col("_last"), F.col(f"_head_{out}")[src]).otherwise(F.col(out))
        )
    new = [c for c in (rank, size) if c] + [*lows, *sums, *lags, *leads]
    return joined.select(*[c for c in df.columns if c not in new], *new)


def segmented_runs(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, start: str, end: str,
    apart: Callable[[Column], Column], out: str,
) -> DataFrame:
    """Number of the run each interval lies in; a run ends where ``apart(start - previous end)`` holds.

    Inside a chunk the cuts are counted by a window. Whether the first interval of a chunk begins a run is
    known from the end of the chunk before, so the chunk table settles both the cut and the count.
    """
    keys, order = list(keys), list(order)
    cut = df.withColumn("_chunk", chunk)
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    gap = F.col(start) - F.lag(end).over(inside)
    local = cut.withColumn("_cut", F.coalesce(apart(gap), F.lit(False)).cast("long")).withColumn(
        out, F.sum("_cut").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    at = F.struct(*order)
    across = W.partitionBy(*keys).orderBy("_chunk")
    carry = (
        local.groupBy(*keys, "_chunk")
        .agg(F.sum("_cut").alias("_cuts"), F.min_by(start, at).alias("_head"), F.max_by(end, at).alias("_tail"))
        .withColumn("_first", F.coalesce(apart(F.col("_head") - F.lag("_tail").over(across)), F.lit(True)).cast("long"))
        .select(
            *keys, "_chunk",
            (F.sum(F.col("_cuts") + F.col("_first")).over(across) - F.col("_cuts")).alias("_base"),
        )
    )
    return (
        local.join(carry, [*keys, "_chunk"])
        .withColumn(out, F.col(out) + F.col("_base"))
        .select(*df.columns, out)
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str) -> DataFrame:
    """Position of each row in the sort over the whole table, from 1.

    The rows are sorted once by range and written; each partition then needs only its start, a table
    with one row per partition. ``order`` must be unique over the table.
    """
    frozen = freeze(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts = frozen.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part",
        F.coalesce(
            F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    # One row per partition of the sort, so its size is bounded by the partition count, not by the data.
    return (
        frozen.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(out, F.col("_start") + local + 1)
        .drop("_at", "_part", "_start")
    )


def neighbours(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], span: int = 1
) -> DataFrame:
    """Values at ``index`` and at the next ``span`` whole-number indexes, without a window.

    Each row is sent to its own index and to the ones before it; one grouping puts them together, so the
    shuffle key is (key, index). Value ``v`` becomes ``v`` and ``v_1`` .. ``v_span``, NULL where missing.
    """
    sent = df.select(
        *keys, *values, F.col(index), F.explode(F.sequence(F.lit(0), F.lit(span))).alias("_back")
    ).withColumn(index, F.col(index) - F.col("_back"))
    picks = []
    for step in range(span + 1):
        for v in values:
            name = v if step == 0 else f"{v}_{step}"
            picks.append(F.max(F.when(F.col("_back") == step, F.col(v))).alias(name))
    own = F.max(F.when(F.col("_back") == 0, F.lit(True))).alias("_own")
    return sent.groupBy(*keys, index).agg(own, *picks).filter("_own").drop("_own")
