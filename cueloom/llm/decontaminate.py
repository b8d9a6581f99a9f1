"""Benchmark decontamination by spaced seeds (operator 2).

A document leaks a benchmark item if ``WINDOW`` consecutive words of both, laid side by side, differ in at most
``SUBSTITUTIONS`` places. Positions of a window fall into four interleaved classes; each of six fixed masks looks at
two classes and ignores the other two. Two substitutions touch two classes at most, so some mask sees none of them:
the seeds find every leak. Seeds of documents and items are joined, and the joined windows are compared word by word.
An item of fewer words is one window of its own length, which a document leaks if it has the same words in a row; documents
are also cut into windows of the lengths of such items.

Document seeds are looked up in a bit map of the benchmark's seeds first (fixed size, two bits for each seed); only
those that may match become rows of the join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import freeze
from . import tokens

WINDOW = 12
SUBSTITUTIONS = 2
CLASSES = 4
#: Each mask is the pair of position classes it looks at.
MASKS = tuple(combinations(range(CLASSES), 2))
#: Bits of the map of benchmark seeds (2 MB; the map never grows).
MAP_BITS = 1 << 24

_rng = np.random.default_rng(11)
_C = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = _rng.integers(1, 2**63, len(MASKS), dtype=np.uint64)
_TABLE = tokens.blank_table()
_OUT = "seed long, id long, pos long, words array<long>"


def _starts(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``size`` words, and the text each is in."""
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(len(words)) + size <= ends)
    return starts, np.searchsorted(bounds, starts, "right") - 1


def _seeds(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the text each is in, and a row of seeds for each mask."""
    starts, text = _starts(words, bounds, WINDOW)
    if not len(starts):
        return starts, text, np.zeros((len(MASKS), 0), np.uint64)
    n = len(words) - WINDOW + 1
    classes = []
    for c in range(CLASSES):
        total = np.zeros(n, np.uint64)
        for p in range(c, WINDOW, CLASSES):
            total += words[p : p + n] * _C[p]
        classes.append(total[starts])
    return starts, text, np.stack([tokens.mix(classes[a] + classes[b] + m) for (a, b), m in zip(MASKS, _M)])


def _short_seeds(words: np.ndarray, bounds: np.ndarray, size: int, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`_seeds` for windows of fewer words, with one seed of all of them; ``whole`` texts are one window or none."""
    starts, text = _starts(words, bounds, size)
    if whole:
        own = np.diff(bounds)[text] == size
        starts, text = starts[own], text[own]
    total = np.full(len(starts), size, np.uint64)
    for p in range(size):
        total += words[starts + p] * _C[p]
    return starts, text, tokens.mix(total)[None, :]


def _places(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (seeds & np.uint64(MAP_BITS - 1)).astype(np.int64), (seeds >> np.uint64(40)).astype(np.int64) & (MAP_BITS - 1)


def _rows(bits: np.ndarray | None, short: Sequence[int], whole: bool = False):
    """Rows ``(seed, id, pos, words)`` of windows, also of ``short`` lengths; with a map, of those that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, words, bounds in tokens.hashed(batch.column(1), _TABLE, latin=True):
                for size in (WINDOW, *short):
                    starts, text, seeds = (
                        _seeds(words, bounds) if size == WINDOW else _short_seeds(words, bounds, size, whole)
                    )
                    hit = np.ones(seeds.shape, bool)
                    if bits is not None:
                        a, b = _places(seeds)
                        hit = (bits[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 1
                        hit &= (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
                    _, col = np.nonzero(hit)
                    if not len(col):
                        continue
                    window = words[starts[col][:, None] + np.arange(size)].view(np.int64)
                    offsets = pa.array(np.arange(len(col) + 1) * size, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(seeds[hit].view(np.int64)), ids.take(pa.array(at + text[col])),
                         pa.array(starts[col] - bounds[text[col]]), pa.ListArray.from_arrays(offsets, pa.array(window.ravel()))],
                        ["seed", "id", "pos", "words"],
                    )

    return run


def _map(seeds: DataFrame) -> np.ndarray:
    """The bit map of the benchmark's seeds, built by Spark; MAP_BITS bits reach the driver, whatever its size."""
    low = F.col("seed").bitwiseAND(F.lit(MAP_BITS - 1))
    high = F.shiftrightunsigned("seed", 40).bitwiseAND(F.lit(MAP_BITS - 1))
    place = seeds.select(F.explode(F.array(low, high)).alias("p")).select((F.col("p") + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in parts.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        lo = (r["bucket"] - 1) * len(part)
        out[lo : lo + len(part)] = part[: len(out) - lo]
    return out


def _windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of the items, once for each item, and those windows of documents whose seed may be one of theirs."""
    items = freeze(
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id IS NOT NULL")
        .mapInArrow(_rows(None, range(1, WINDOW), whole=True), _OUT)
        .select("seed", F.col("id").alias("item_id"), F.col("words").alias("item_words")).distinct()
    )
    # Fewer than WINDOW numbers.
    size = F.size("item_words")
    short = [r["n"] for r in items.filter(size < WINDOW).select(size.alias("n")).distinct().collect()]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("doc_id IS NOT NULL")
    found = texts.mapInArrow(_rows(_map(items), short), _OUT)
    return items, found.select("seed", F.col("id").alias("doc_id"), "pos", "words")


def _differing() -> Column:
    """In how many places the two windows of a row differ; null if those are too many, or the windows not of one length."""
    n = F.size(F.filter(F.zip_with("words", "item_words", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    most = F.when(F.size("words") == WINDOW, SUBSTITUTIONS).otherwise(0)
    return F.when((F.size("words") == F.size("item_words")) & (n <= most), n.cast("long"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, n_windows, first_word, mismatches)`` for every document that leaks an item.

    ``n_windows`` counts window positions of the document that match the item, ``first_word`` is the first of them
    and ``mismatches`` the fewest differing words. Words are split at ASCII blanks; A-Z and U+00C0-U+00DE are lower-cased.
    An item with fewer than ``WINDOW`` words leaks where all its words stand in a row, without a difference; a document
    with fewer words than an item's window leaks nothing of it. Items without words, null texts and null ids take no
    part; rows that repeat an id count as one document or item.
    """
    items, found = _windows(docs, benchmark)
    met = found.join(items, "seed")
    return (
        met.withColumn("mismatches", _differing()).filter("mismatches IS NOT NULL")
        .groupBy("doc_id", "item_id", "pos").agg(F.min("mismatches").alias("mismatches"))
        .groupBy("doc_id", "item_id").agg(
            F.count(F.lit(1)).alias("n_windows"), F.min("pos").alias("first_word"), F.min("mismatches").alias("mismatches")
        )
    )


def drop_leaking(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, unchanged, without documents that leak an item; rows with a null doc_id stay.

    Which items those are does not matter here, so a window that many items have counts once.
    """
    items, found = _windows(docs, benchmark)
    known = items.select("seed", "item_words").distinct()
    bad = found.join(known, (found["seed"] == known["seed"]) & _differing().isNotNull(), "left_semi").select(
        F.col("doc_id").alias("id")
    ).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(bad, F.col("row.doc_id") == F.col("id"), "left_anti").select("row.*")
