"""Hard negatives for anchors by exact integer scores (operator 13).

Rows are packed into blocks of bounded size. A block of anchors meets a block of candidates as one tile, whose scores are
one product of two integer matrices by Strassen's recursion: seven products of half size instead of eight, on matrices
padded with zeros, with whole-number additions only. A task keeps the best of each anchor as a small heap that merges
with the heap of the next tile; heaps of different tasks are merged by Spark.

There are two passes. The first finds each anchor's positives; candidates are packed by a hash of their label, so anchors
meet only blocks that can hold their own label. The second looks for negatives in the window of scores that each positive
opens; anchors meet all blocks (the stated anchors against all rows, block by block). Blocks meet through a shuffle, never
a broadcast: what goes through the driver does not grow with the table.

Numbers are added and multiplied modulo 2**64, which sums and differences of Strassen's method survive: a score is exact
whenever it fits into a long.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import freeze

SCALE = 256
ANCHOR_ROWS, CANDIDATE_ROWS = 256, 1024
#: Labels are packed by a hash with so many values; pairs of blocks are dealt into so many cells at most.
BUCKETS, SLICES = 64, 1024
#: Scores a cell has at least, if there are that many, and cells for each core at most.
SCORES, CELLS = 1 << 22, 16
#: A product with a side up to this is taken at once.
LEAF = 16
#: Blocks of anchors a task holds heaps for before it hands them on.
HELD = 64


# --- products ---------------------------------------------------------------

def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices of any shape, modulo 2**64."""
    levels, shortest = 0, min(*a.shape, b.shape[1])
    while shortest > leaf:
        levels, shortest = levels + 1, -(-shortest // 2)
    return _product(_padded(a, levels), _padded(b, levels), levels)[: a.shape[0], : b.shape[1]]


def _padded(a: np.ndarray, levels: int) -> np.ndarray:
    """With zeros up to sides that can be halved ``levels`` times."""
    return np.pad(a, [(0, -n % (1 << levels)) for n in a.shape])


def _product(a: np.ndarray, b: np.ndarray, levels: int) -> np.ndarray:
    if not levels:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    m1 = _product(a11 + a22, b11 + b22, levels - 1)
    m2 = _product(a21 + a22, b11, levels - 1)
    m3 = _product(a11, b12 - b22, levels - 1)
    m4 = _product(a22, b21 - b11, levels - 1)
    m5 = _product(a11 + a12, b22, levels - 1)
    m6 = _product(a21 - a11, b11 + b12, levels - 1)
    m7 = _product(a12 - a22, b21 + b22, levels - 1)
    out = np.empty((2 * m, 2 * n), np.int64)
    out[:m, :n] = m1 + m4 - m5 + m7
    out[:m, n:] = m3 + m5
    out[m:, :n] = m2 + m4
    out[m:, n:] = m1 - m2 + m3 + m6
    return out


# --- heaps ------------------------------------------------------------------

Heap = tuple[np.ndarray, np.ndarray, np.ndarray]
EMPTY: Heap = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def merged(one: Heap, other: Heap, k: int) -> Heap:
    """The ``k`` best (slot, id, score) of each slot: by score, then smaller id."""
    slot, ids, scores = (np.concatenate(x) for x in zip(one, other))
    order = np.lexsort((ids, ~scores, slot))
    slot, ids, scores = slot[order], ids[order], scores[order]
    keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < k
    return slot[keep], ids[keep], scores[keep]


def best_of(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, slots: np.ndarray, k: int) -> Heap:
    """The ``k`` best allowed cells of each row of a tile as a heap; rows go by ``slots``."""
    some = np.flatnonzero(allowed.any(axis=1))
    if not len(some):
        return EMPTY
    low = np.iinfo(np.int64).min
    masked = np.where(allowed[some], scores[some], low)
    if masked.shape[1] > k:
        low = np.partition(masked, -k, axis=1)[:, -k][:, None]
    row, column = np.nonzero((masked >= low) & allowed[some])
    return merged(EMPTY, (slots[some][row], ids[column], masked[row, column]), k)


# --- blocks -----------------------------------------------------------------

def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``floor(SCALE * x)`` of every component; rows that take no part go."""
    for batch in batches:
        keep, out = [], []
        for i, v in enumerate(batch.column(2)):
            if not v.is_valid or v.values.null_count or not len(v.values):
                continue
            x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(float))
            if (np.abs(x) < 2.0**63).all():
                keep.append(i)
                out.append(x.astype("<i8").tobytes())
        rows = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], ["vec_id", "label", "v"])


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if a.size and np.iinfo(kind).min <= a.min() and a.max() <= np.iinfo(kind).max:
            return a.astype(kind)
    return a


def _block(rows: pa.Table) -> pa.Table:
    """Rows of one block as one value; the windows of anchors go with them."""
    label = rows.column("label").to_numpy(zero_copy_only=False).astype("U")
    parts = {"id": rows.column("vec_id").to_numpy(), "label": label,
             "v": _narrow(np.stack([np.frombuffer(v.as_py(), "<i8") for v in rows.column("v")]))}
    if "found" in rows.column_names:
        for name in ("ids", "scores"):
            lists = [[x[name] for x in found] for found in rows.column("found").to_pylist()]
            parts[f"n_{name}"] = np.array([len(x) for x in lists])
            parts[name] = np.array([y for x in lists for y in x], np.int64)
    out = io.BytesIO()
    np.savez(out, **parts)
    return pa.table({
        "dim": rows.column("dim")[:1], "bucket": rows.column("bucket")[:1], "part": rows.column("part")[:1],
        "rows": pa.array([rows.num_rows], pa.int64()), "size": pa.array([len(out.getvalue())], pa.int64()),
        "block": pa.array([out.getvalue()], pa.binary()),
    })


def _opened(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k].astype(np.int64) if z[k].dtype.kind == "i" else z[k] for k in z.files}


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """``(dim, bucket, part, rows, size, block)`` with about ``size`` rows in each block, and each block's bytes."""
    # One row for each vector length and label bucket.
    counts = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    part = F.pmod(F.xxhash64("vec_id", "v"), F.col("parts")).cast("int")
    dealt = rows.join(counts, ["dim", "bucket"]).withColumn("part", part).drop("parts")
    shape = "dim int, bucket int, part int, rows long, size long, block binary"
    return freeze(dealt.groupBy("dim", "bucket", "part").applyInArrow(_block, shape))


def _met(anchors: DataFrame, candidates: DataFrame, *on: str) -> DataFrame:
    """``(anchors, block)``: each block of anchors with each block of candidates that agrees in ``on``.

    All pairs form a rectangle for each ``on``. It is cut into cells, so many groups of anchors by so many slices of
    candidates that the copies of both have about the fewest bytes.
    """

    def summed(blocks: DataFrame, of: str) -> DataFrame:
        rows, size = (F.sum(x).cast("double").alias(f"{of}_{x}") for x in ("rows", "size"))
        return blocks.groupBy(*on).agg(F.count(F.lit(1)).alias(f"{of}_n"), rows, size)

    sides = summed(anchors, "a").join(summed(candidates, "c"), [*on])
    scores = F.col("a_rows") * F.col("c_rows")
    most = min(SLICES, CELLS * anchors.sparkSession.sparkContext.defaultParallelism)
    cells = F.ceil(scores / max(SCORES, (sides.agg(F.sum(scores)).first()[0] or 0) / most))
    even = F.round(F.sqrt(cells * F.col("c_size") / F.col("a_size")))
    slices = F.least(F.greatest(even, F.ceil(cells / F.col("a_n"))), cells, "c_n")
    groups = F.least(F.ceil(cells / F.col("slices")), "a_n")
    sides = sides.withColumn("slices", slices.cast("int")).withColumn("groups", groups.cast("int"))
    # A few numbers for each vector length and label bucket.
    sides = F.broadcast(sides.select(*on, "slices", "groups"))

    def share(of: str) -> Column:
        """Blocks of a bucket go round."""
        return F.pmod(F.pmod(F.xxhash64("bucket"), F.col(of)) + F.col("part"), F.col(of)).cast("int")

    def each(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    asked = anchors.join(sides, [*on]).select(
        *on, share("groups").alias("group"), each("slices").alias("slice"), F.col("block").alias("anchors")
    )
    given = candidates.join(sides, [*on]).select(
        *on, each("groups").alias("group"), share("slices").alias("slice"), "block"
    )
    # Spark takes exploded rows to be no larger than what they were made of, and would broadcast the copies.
    return asked.hint("merge").join(given.hint("merge"), [*on, "group", "slice"]).select("anchors", "block")


# --- tiles ------------------------------------------------------------------

def _heaps(tile: Callable[[dict, dict], Heap], out: Callable[[dict, Heap], list[pa.Array]], names: list[str], k: int):
    """Rows (anchors, candidates) to the heaps of the task's tiles, merged for each block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[dict, Heap]] = {}

        def handed():
            for anchors, heap in held.values():
                yield pa.RecordBatch.from_arrays(out(anchors, heap), names)
            held.clear()

        for batch in batches:
            for key, candidates in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in held and len(held) == HELD:
                    yield from handed()
                anchors, heap = held.get(key) or (_opened(key), EMPTY)
                held[key] = (anchors, merged(heap, tile(anchors, _opened(candidates.as_py())), k))
        yield from handed()

    return run


def _positives(k: int):
    def tile(anchors: dict, rows: dict) -> Heap:
        allowed = (anchors["label"][:, None] == rows["label"]) & (anchors["id"][:, None] != rows["id"])
        if not allowed.any():
            return EMPTY
        scores = strassen(anchors["v"], rows["v"].T)
        return best_of(scores, allowed, rows["id"], np.arange(len(scores)), k)

    def out(anchors: dict, heap: Heap) -> list[pa.Array]:
        slot, ids, scores = heap
        return [pa.array(anchors["id"][slot]), pa.array(ids), pa.array(scores)]

    return _heaps(tile, out, ["anchor_id", "vec_id", "score"], k)


def _window(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole numbers ``n`` with ``low * score <= 100 * n <= high * score``, cut to the range of a long."""
    most = np.iinfo(np.int64)
    lo, hi = -(-low * score // 100), high * score // 100
    return (1, 0) if lo > hi else (max(lo, most.min), min(hi, most.max))


def _negatives(low: int, high: int, k: int):
    def tile(anchors: dict, rows: dict) -> Heap:
        other = anchors["label"][:, None] != rows["label"]
        if not other.any():
            return EMPTY
        scores = strassen(anchors["v"], rows["v"].T)
        ends = np.cumsum(anchors["n_ids"])
        heap = EMPTY
        for place in range(int(anchors["n_ids"].max(initial=0))):
            own = np.flatnonzero(anchors["n_ids"] > place)
            slots = (ends - anchors["n_ids"])[own] + place
            lo, hi = np.array([_window(int(s), low, high) for s in anchors["scores"][slots]], np.int64).T
            allowed = other[own] & (scores[own] >= lo[:, None]) & (scores[own] <= hi[:, None])
            heap = tuple(np.concatenate(x) for x in zip(heap, best_of(scores[own], allowed, rows["id"], slots, k)))
        return heap

    def out(anchors: dict, heap: Heap) -> list[pa.Array]:
        slot, ids, scores = heap
        anchor = np.repeat(anchors["id"], anchors["n_ids"])[slot]
        place = (np.arange(len(anchors["ids"])) - np.repeat(np.cumsum(anchors["n_ids"]) - anchors["n_ids"], anchors["n_ids"]))[slot]
        return [pa.array(anchor), pa.array(anchors["ids"][slot]), pa.array(place), pa.array(anchors["scores"][slot]),
                pa.array(ids), pa.array(scores)]

    return _heaps(tile, out, ["anchor_id", "positive_id", "place", "positive_score", "negative_id", "negative_score"], k)


# --- operator ---------------------------------------------------------------

def mine(
    vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for ``vectors(vec_id, label, embedding)``.

    A score is the inner product of ``floor(256 * x)``. An anchor's positives are its ``n_positives`` best other rows of
    the same label; for each of them the ``n_negatives`` best rows of other labels whose score lies between ``low`` and
    ``high`` percent of the positive's, ends included. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, an empty vector, or a component that is null, not finite, or beyond a long after
    scaling take no part. Vectors meet only those with as many components. Rows that repeat an id count one by one as
    candidates, but never for an anchor of that id; of anchors that repeat an id the one with the largest (label,
    vector) counts. Scores beyond a long wrap. Further columns take no part; an empty table gives no rows.
    """
    ready = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL").mapInArrow(_integers, "vec_id long, label string, v binary")
    dim, bucket = F.floor(F.octet_length("v") / 8).cast("int"), F.pmod(F.xxhash64("label"), F.lit(BUCKETS)).cast("int")
    rows = freeze(ready.withColumns({"dim": dim, "bucket": bucket}))
    candidates = _packed(rows, CANDIDATE_ROWS)
    one = F.max(F.struct("label", "v", "dim", "bucket")).alias("r")
    anchors = freeze(rows.filter(is_anchor).groupBy("vec_id").agg(one).select("vec_id", "r.*"))

    # Blocks of one bucket.
    hits = _met(_packed(anchors, ANCHOR_ROWS), candidates, "dim", "bucket").mapInArrow(
        _positives(n_positives), "anchor_id long, vec_id long, score long"
    )
    place = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id"))
    positives = hits.withColumn("place", place).filter(F.col("place") <= n_positives)
    found = F.array_sort(F.collect_list(F.struct("place", F.col("vec_id").alias("ids"), F.col("score").alias("scores"))))
    # The files of anchors can be far smaller than their rows, so neither side is broadcast by its files.
    opened = anchors.hint("merge").join(
        positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(found.alias("found")).hint("merge"), "vec_id"
    )

    # All blocks, whatever their bucket.
    pairs = _met(_packed(opened, ANCHOR_ROWS), candidates, "dim").mapInArrow(
        _negatives(low, high, n_negatives),
        "anchor_id long, positive_id long, place long, positive_score long, negative_id long, negative_score long",
    )
    rank = F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
