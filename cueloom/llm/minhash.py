"""Near-duplicate documents by MinHash with tensored banding (operator 10).

A document's set is its distinct five-word shingles. Instead of one fresh group of minhashes for each of L tables,
two collections of sqrt(L) groups are computed and a table's key joins one group of each: 8 + 8 groups of two
minhashes (32 in all) make 64 tables. Documents that share a table key are candidates.

Candidates are verified on full sets, block against block: every document goes to a block named after the smallest
document it shares a key with, large blocks are cut by total set size, and two blocks are compared if some key has
documents of both. No group of copies meets in one task, and no pair is dropped: a block comparison counts all
intersections by a matrix product and returns a spanning forest of the links it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from . import tokens
from .components import components

SHINGLE = 5
GROUPS = 8
#: Weight of a block: shingles plus a fixed charge for each document, so blocks are bounded in both.
BLOCK_WEIGHT = 1 << 17
DOC_CHARGE = 128

_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, 4 * GROUPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, 4 * GROUPS, dtype=np.uint64)
_C = _rng.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE = tokens.blank_table()


def _shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one document's word hashes."""
    k = min(SHINGLE, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, np.uint64) * _C[SHINGLE]
    for j in range(k):
        h += words[j : j + n] * _C[j]
    return np.unique(tokens.mix(h))


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed numbers."""
    a = tokens.mix(s ^ _B[0]).sum(dtype=np.uint64)
    b = tokens.mix(s ^ _B[1]).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _groups(s: np.ndarray) -> np.ndarray:
    """The 2 * GROUPS keys of the two hash collections: each joins two minhashes."""
    low = np.empty(len(_A), np.uint64)
    for lo in range(0, len(s), 4096):
        x = (s[None, lo : lo + 4096] + _B[:, None]) * _A[:, None]
        x ^= x >> np.uint64(29)
        part = x.min(axis=1)
        low = part if lo == 0 else np.minimum(low, part)
    return tokens.mix(low[0::2] * _C[0] + low[1::2] * _C[1])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, lo, hi, keys = [], [], [], []
        for _, words, bounds in tokens.hashed(batch.column(1), _TABLE):
            for a, b in zip(bounds[:-1], bounds[1:]):
                s = _shingles(words[a:b])
                n.append(len(s))
                x, y = _set_hash(s) if len(s) else (0, 0)
                lo.append(x)
                hi.append(y)
                keys.append(_signed(_groups(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
             pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "set_lo", "set_hi", "groups"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the wanted rows; a row whose text is not the wanted set is left out."""
    for batch in batches:
        wanted = batch.column(2).to_pylist()
        ids, sets = [], []
        for at, words, bounds in tokens.hashed(batch.column(1), _TABLE):
            for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                s = _shingles(words[a:b])
                if len(s) and _set_hash(s)[0] == wanted[at + i]:
                    ids.append(at + i)
                    sets.append(s.tobytes())
        take = pa.array(ids, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(3).take(take), batch.column(0).take(take), pa.array(sets, pa.binary())],
            ["block", "node", "elements"],
        )


def _links(left: list, right: list | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of ``(node, set)``, or within one."""
    rows = left + (right or [])
    sizes = np.array([len(s) for _, s in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, element, count = np.unique(np.concatenate([s for _, s in rows]), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[element]
    owner, element = owner[keep], number[element[keep]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    cut = len(left)
    both = np.zeros((cut, len(rows) - cut if right is not None else cut), np.float64)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        i, j = np.searchsorted(element, [lo, lo + 4096])
        m = np.zeros((len(rows), 4096), np.float32)
        m[owner[i:j], element[i:j] - lo] = 1
        both += m[:cut] @ (m[cut:] if right is not None else m).T
    inter = np.rint(both).astype(np.int64)
    other = sizes[cut:] if right is not None else sizes
    hit = 100 * inter >= percent * (sizes[:cut, None] + other[None, :] - inter)
    a, b = np.nonzero(hit)
    if right is not None:
        b = b + cut
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((rows[x][0], rows[y][0]))
    return out


def _members(cell: list) -> list[tuple[int, np.ndarray]]:
    return [(r["node"], np.frombuffer(r["elements"], np.uint64)) for r in cell]


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                left = _members(batch.column(0)[i].as_py())
                right = _members(batch.column(1)[i].as_py()) if batch.num_columns > 1 else None
                if right is not None or len(left) > 1:
                    out += _links(left, right, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"]
            )

    return run


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row of ``docs(doc_id, text)``.

    Documents are linked if ``100 * intersection >= percent * union`` of their five-word shingle sets (words split
    at ASCII blanks, A-Z lower-cased; with fewer words, the whole sequence is the one shingle). The chance that a
    link at exactly 85 % is never a candidate is below 0.0001, and falls with the similarity.

    Null or blank texts have an empty set and are linked with nothing. Rows that repeat a doc_id are one node.
    A null doc_id takes no part: its row has a null component and is kept. Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    info = freeze(
        source.mapInArrow(
            _sketches, "doc_id long, n_shingles long, set_lo long, set_hi long, groups array<long>"
        )
    )
    real = info.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = ["set_lo", "set_hi", "n_shingles"]
    classes = freeze(real.groupBy(*same).agg(F.min("doc_id").alias("node"), F.any_value("groups").alias("groups")))

    pairs = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(GROUPS) for j in range(GROUPS)
    ])
    keys = classes.select("node", "n_shingles", "set_lo", "groups", F.explode(pairs).alias("t")).select(
        F.xxhash64(
            F.col("groups")[F.col("t.i")], F.col("groups")[F.col("t.j") + GROUPS], F.col("t.i"), F.col("t.j")
        ).alias("key"), "node",
    )
    multi = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1")
    # Both sides of the large joins grow with the input: they are merge joins at every size.
    members = freeze(keys.join(multi.select("key", "hub").hint("merge"), "key").select("key", "node", "hub"))
    named = members.groupBy("node").agg(F.min("hub").alias("hub")).join(
        classes.select("node", "set_lo", "n_shingles"), "node"
    )
    weight = named.groupBy("hub").agg(
        F.ceil(F.sum(F.col("n_shingles") + DOC_CHARGE) / BLOCK_WEIGHT).alias("parts")
    )
    placed = freeze(
        named.join(weight, "hub").select(
            "node", "set_lo",
            F.concat_ws("_", "hub", F.pmod(F.xxhash64("node"), "parts")).alias("block"),
        )
    )
    own = placed.select(F.col("node").alias("doc_id"), "set_lo", "block")
    sets = source.join(own.hint("merge"), "doc_id").select("doc_id", "text", "set_lo", "block").mapInArrow(
        _sets, "block string, node long, elements binary"
    )
    blocks = freeze(sets.groupBy("block").agg(F.collect_list(F.struct("node", "elements")).alias("rows")))

    held = members.join(placed.select("node", "block"), "node").select("key", "block").distinct()
    some = held.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    held = held.join(some, "key")
    met = held.select("key", F.col("block").alias("a")).join(held.select("key", F.col("block").alias("b")), "key")
    met = met.filter("a < b").select("a", "b").distinct()
    crossed = met.join(blocks.select(F.col("block").alias("a"), F.col("rows").alias("left")), "a").join(
        blocks.select(F.col("block").alias("b"), F.col("rows").alias("right")), "b"
    )
    # A lost link between rows of one doc_id would split a node.
    twice = real.join(classes.drop("groups"), same).groupBy("doc_id").agg(
        F.min("node").alias("u"), F.max("node").alias("v")
    ).filter("u <> v").select("u", "v")
    links = (
        blocks.select("rows").mapInArrow(_verify(percent), "u long, v long")
        .union(crossed.select("left", "right").mapInArrow(_verify(percent), "u long, v long"))
        .union(twice)
    )
    named = components(links)
    final = classes.drop("groups").join(named.withColumnRenamed("component", "low"), "node", "left").select(
        *same, F.coalesce("low", "node").alias("component")
    )
    joined = info.drop("groups").join(final.hint("merge"), same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, unchanged; all columns stay.

    Documents without words are kept, as they are linked with nothing. Of several rows with one doc_id, all stay if
    that id is kept.
    """
    gone = near_duplicates(docs, percent).filter("NOT kept").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, F.col("row.doc_id") == F.col("id"), "left_anti").select("row.*")
