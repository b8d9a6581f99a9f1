"""Exact top-k by inner product with a ball tree in every shard (operator 6).

Vectors are dealt into shards of bounded size; each shard becomes one row that holds its ball tree. Queries are packed
into blocks of bounded size. A block meets a shard in one task: for a ball of centre c and radius r the inner product
with q is at most ``q.c + |q| r``, so balls are visited from the highest bound down, and a ball whose bound is below
the query's kth score is left out with everything in it.

The kth score is shared: every block searches one shard first, and what it finds there is the starting kth score in
all other shards. Pruning is strict (a ball that could tie is visited), so ties to smaller ids come out right.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import freeze

SHARD_ROWS = 8192
BLOCK_ROWS = 512
LEAF_ROWS = 128
SCALE = 64
#: Scores up to here are exact in float64 products.
EXACT = 2.0**52


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """floor(SCALE * x) of every component; vectors that are null or hold null or non-finite components go."""
    for batch in batches:
        ids, vectors = batch.column(0), batch.column(1)
        keep, out = [], []
        for i in range(batch.num_rows):
            v = vectors[i]
            if not v.is_valid or not ids[i].is_valid or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(float)
            if np.isfinite(x).all():
                keep.append(i)
                out.append(np.floor(SCALE * x).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array(out, pa.binary())], ["vec_id", "v"])


def _pack(**arrays: np.ndarray) -> bytes:
    f = io.BytesIO()
    np.savez(f, **{k: _narrow(a) for k, a in arrays.items()})
    return f.getvalue()


def _narrow(a: np.ndarray) -> np.ndarray:
    if a.dtype.kind == "i" and a.size:
        for t in (np.int8, np.int16, np.int32):
            if np.iinfo(t).min <= a.min() and a.max() <= np.iinfo(t).max:
                return a.astype(t)
    return a


def _unpack(b: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(b)) as z:
        return {k: z[k] for k in z.files}


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Rows in leaf order and nodes in level order: centre, radius, row range, parent, and whether it is a leaf."""
    x = vectors.astype(float)
    order = np.lexsort((ids,))
    lo, hi, parent, leaf, centre, radius = [0], [len(ids)], [-1], [], [], []
    at = 0
    while at < len(lo):
        rows = order[lo[at] : hi[at]]
        c = x[rows].mean(axis=0)
        d = np.sqrt(((x[rows] - c) ** 2).sum(axis=1))
        centre.append(c)
        radius.append(d.max() * (1 + 1e-9) + 1e-9)
        split = len(rows) > LEAF_ROWS and d.max() > 0
        if split:
            a = x[rows[d.argmax()]]
            b = x[rows[((x[rows] - a) ** 2).sum(axis=1).argmax()]]
            side = np.argsort((x[rows] - a) @ (b - a), kind="stable")
            order[lo[at] : hi[at]] = rows[side]
            mid = lo[at] + len(rows) // 2
            lo += [lo[at], mid]
            hi += [mid, hi[at]]
            parent += [at, at]
        leaf.append(not split)
        at += 1
    return {
        "ids": ids[order], "vectors": vectors[order], "centre": np.array(centre), "radius": np.array(radius),
        "lo": np.array(lo), "hi": np.array(hi), "parent": np.array(parent), "leaf": np.array(leaf),
    }


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best hits of each query: by score, then smaller id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return q[keep], ids[keep], scores[keep]


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int):
    """Hits (query number, id, score) among the tree's rows that may be in a query's top k; kth is updated in place."""
    big = float(np.abs(tree["vectors"]).max(initial=0)) * float(np.abs(queries).max(initial=0)) * queries.shape[1]
    kind = float if big < EXACT else np.int64
    qs, rows = queries.astype(kind), tree["vectors"].astype(kind)
    norm = np.sqrt((queries.astype(float) ** 2).sum(axis=1))
    bound = queries.astype(float) @ tree["centre"].T + norm[:, None] * tree["radius"][None, :]
    bound += 1e-9 * np.abs(bound) + 1e-6
    for node in range(1, bound.shape[1]):
        # A child is out where its parent is.
        bound[:, node] = np.minimum(bound[:, node], bound[:, tree["parent"][node]])
    leaves = np.flatnonzero(tree["leaf"])
    leaves = leaves[np.argsort(-bound[:, leaves].max(axis=0), kind="stable")]
    found_q, found_id, found_s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh: list[tuple[np.ndarray, ...]] = []
    held = 0
    for i, node in enumerate(leaves):
        live = np.flatnonzero(bound[:, node] >= kth)
        if len(live):
            lo, hi = int(tree["lo"][node]), int(tree["hi"][node])
            s = qs[live] @ rows[lo:hi].T
            own = ids[live][:, None] == tree["ids"][lo:hi][None, :].astype(np.int64)
            a, b = np.nonzero((s >= kth[live][:, None]) & ~own)
            if len(a):
                fresh.append((live[a], tree["ids"][lo:hi][b].astype(np.int64), s[a, b].astype(np.int64)))
                held += len(a)
        if held and (held > 4 * k * len(ids) or i == len(leaves) - 1 or i in (0, 3, 15)):
            q, d, s = (np.concatenate([old, *new]) for old, new in zip((found_q, found_id, found_s), zip(*fresh)))
            found_q, found_id, found_s = _best(q, d, s, k)
            fresh, held = [], 0
            count = np.bincount(found_q, minlength=len(ids))
            last = np.cumsum(count) - 1
            full = count >= k
            kth[full] = np.maximum(kth[full], found_s[last[full]])
    if fresh:
        q, d, s = (np.concatenate([old, *new]) for old, new in zip((found_q, found_id, found_s), zip(*fresh)))
        found_q, found_id, found_s = _best(q, d, s, k)
    return found_q, found_id, found_s


def _stack(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vec_id").to_numpy().astype(np.int64)
    return ids, np.stack([np.frombuffer(v.as_py(), "<i8") for v in rows.column("v")])


def _shard(rows: pa.Table) -> pa.Table:
    ids, vectors = _stack(rows)
    return pa.table({
        "dim": rows.column("dim")[:1], "shard": rows.column("part")[:1],
        "tree": pa.array([_pack(**build_tree(ids, vectors))], pa.binary()),
    })


def _block(rows: pa.Table) -> pa.Table:
    ids, vectors = _stack(rows)
    order = np.argsort(ids, kind="stable")
    kth = np.full(len(ids), -np.inf)
    return pa.table({
        "dim": rows.column("dim")[:1], "block": rows.column("part")[:1],
        "queries": pa.array([_pack(ids=ids[order], vectors=vectors[order], kth=kth)], pa.binary()),
    })


def _hits(k: int):
    """Rows (tree, queries) to hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, queries in zip(batch.column(0), batch.column(1)):
                b = _unpack(queries.as_py())
                ids = b["ids"].astype(np.int64)
                q, d, s = search(_unpack(tree.as_py()), ids, b["vectors"].astype(np.int64), b["kth"].copy(), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _warm(k: int):
    """Rows (dim, block, tree, queries) to the blocks with the kth score that the one shard gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, queries in zip(batch.column(2), batch.column(3)):
                b = _unpack(queries.as_py())
                kth = b["kth"].copy()
                search(_unpack(tree.as_py()), b["ids"].astype(np.int64), b["vectors"].astype(np.int64), kth, k)
                out.append(_pack(ids=b["ids"], vectors=b["vectors"], kth=kth))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["dim", "block", "queries"]
            )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for every row of ``vectors(vec_id, embedding)`` with ``is_query``.

    Scores are inner products of ``floor(64 * x)``. A query's own id is no candidate; ties go to the smaller vec_id,
    rows that repeat an id count one by one. Vectors (or ids) that are null, and vectors with null or non-finite
    components, take no part; vectors meet only those with as many components. Products beyond 2 ** 63 wrap.
    """
    ready = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
        _integers, "vec_id long, v binary"
    )
    rows = freeze(ready.withColumn("dim", F.floor(F.octet_length("v") / 8).cast("int")).filter("dim > 0"))
    asked = rows.filter(is_query)
    n, q = rows.count(), asked.count()
    shards, blocks = math.ceil(n / SHARD_ROWS) or 1, math.ceil(q / BLOCK_ROWS) or 1
    part = lambda count, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(count)).cast("int")
    trees = freeze(
        rows.withColumn("part", part(shards, 1)).groupBy("dim", "part").applyInArrow(_shard, "dim int, shard int, tree binary")
    )
    packed = asked.withColumn("part", part(blocks, 2)).groupBy("dim", "part").applyInArrow(
        _block, "dim int, block int, queries binary"
    )
    home = packed.withColumn("shard", F.pmod("block", F.lit(shards)).cast("int"))
    warm = freeze(
        home.join(trees, ["dim", "shard"], "left").filter("tree IS NOT NULL").select("dim", "block", "tree", "queries")
        .mapInArrow(_warm(k), "dim int, block int, queries binary")
        .union(home.join(trees, ["dim", "shard"], "left_anti").select("dim", "block", "queries"))
    )
    # Every block goes to every shard: the stated queries against all rows, block by block.
    sent = warm.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    hits = trees.join(sent, ["dim", "shard"]).select("tree", "queries").mapInArrow(
        _hits(k), "query_id long, vec_id long, score long"
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
