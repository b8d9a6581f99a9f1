"""Substring deduplication by sliding sentence spans (operator 3).

A text is cut into sentences, every run of ``RUN`` consecutive sentences (more, where they are so short that the run
would have fewer than ``MIN_WORDS`` words) is hashed, and equal runs are found by one global aggregation. Sentences that
a run covers go, unless the run is the first of its kind (smallest doc_id, then position). A text too short for a run is
one run as a whole, so its copies go too. Sentences end after ``.``, ``!`` or ``?`` before a blank, or at a line end; one of more than ``PIECE`` words
counts as several pieces, so a passage of a few long sentences has runs too.

Runs travel as (hash, doc_id, number): texts are not shuffled for the search. A run that a third of all documents share
is one row of the aggregated side, and its many places are the side that skew handling may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..session import freeze
from . import tokens

RUN = 3
#: Words of a run at least; runs of fewer repeat by chance, so they go on to the next sentences.
MIN_WORDS = 10
PIECE = 12

_TABLE = tokens.blank_table()
_rng = np.random.default_rng(3)
_C = _rng.integers(1, 2**63, max(RUN, PIECE, MIN_WORDS) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _marks() -> tuple[np.ndarray, np.ndarray]:
    stop, line = np.zeros(256, bool), np.zeros(256, bool)
    stop[[33, 46, 63]] = True
    line[10:14] = True
    return stop, line


_STOP, _LINE = _marks()


def sentence_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of a chunk of texts: hash, words, first byte, end byte, and the first piece of each text."""
    base = int(offsets[0])
    raw = data[base : int(offsets[-1])]
    words, bounds = tokens.hash_words(data, offsets, _TABLE)
    inside = _TABLE[raw] != 0
    at = offsets - base
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = at[:-1][at[:-1] < len(raw)]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return words, none, none, none, np.zeros(len(offsets), np.int64)
    ends_mask = inside.copy()
    ends_mask[:-1] &= ~inside[1:]
    tails = at[1:][at[1:] > 0] - 1
    ends_mask[tails] = inside[tails]
    ends = np.flatnonzero(ends_mask) + 1
    # A sentence opens at the first word of a text, after a word that ends in a stop, and after a line end.
    opens = np.zeros(len(starts), bool)
    opens[bounds[:-1][bounds[:-1] < len(starts)]] = True
    opens[1:] |= _STOP[raw[ends[:-1] - 1]]
    breaks = np.concatenate([[0], np.cumsum(_LINE[raw])])
    opens[1:] |= breaks[starts[1:]] > breaks[ends[:-1]]
    first = np.flatnonzero(opens)
    place = np.arange(len(starts)) - np.repeat(first, np.diff(first, append=len(starts)))
    cut = np.flatnonzero(place % PIECE == 0)
    size = np.diff(cut, append=len(starts))
    hashes = tokens.mix(np.add.reduceat(words * _C[place % PIECE], cut) + size.astype(np.uint64))
    return hashes, size, starts[cut], ends[cut + size - 1], np.searchsorted(cut, bounds)


def _run_hashes(h: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the run that starts at each piece its hash, and its number of pieces (0 where the text ends before it).

    Where a text ends before its first run does, that run is the text.
    """
    words = np.concatenate([[0], np.cumsum(size)])
    last = np.searchsorted(words, words[:-1] + MIN_WORDS)
    at = np.arange(len(h))
    length = np.maximum(last - at, RUN)
    own = np.diff(bounds)
    first, own = bounds[:-1][own > 0], own[own > 0]
    short = length[first] > own
    length[first[short]] = own[short]
    total = np.zeros(len(h), np.uint64)
    for j in range(min(len(h), max(RUN, MIN_WORDS))):
        total[: len(h) - j] += np.where(j < length[: len(h) - j], h[j:] * _C[j], np.uint64(0))
    ends = np.repeat(bounds[1:], np.diff(bounds))
    return tokens.mix(total + length.astype(np.uint64)).view(np.int64), np.where(at + length <= ends, length, 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        data, off = tokens.texts_of(batch.column(1))
        for lo, hi in tokens.chunks(off):
            h, size, _, _, bounds = sentence_pieces(data, off[lo : hi + 1])
            if not len(h):
                continue
            run, length = _run_hashes(h, size, bounds)
            good = np.flatnonzero(length)
            text = np.searchsorted(bounds, good, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(run[good]), ids.take(pa.array(lo + text)),
                 pa.array((good - bounds[text]).astype(np.int32))],
                ["run", "doc_id", "at"],
            )


def _cover(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Merge runs (start, pieces) into ranges of sentences (end excluded)."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(set(runs)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n))
        else:
            out.append((s, s + n))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their repeated runs to kept text and the ranges taken out, in sentences and in bytes."""
    for batch in batches:
        data, off = tokens.texts_of(batch.column(1))
        texts, spans = [None] * batch.num_rows, [None] * batch.num_rows
        gone = batch.column(2).to_pylist()
        for lo, hi in tokens.chunks(off):
            h, size, begin, end, bounds = sentence_pieces(data, off[lo : hi + 1])
            run, length = _run_hashes(h, size, bounds)
            for i in range(lo, hi):
                if not gone[i]:
                    continue
                head = int(off[i] - off[lo])
                raw = data[off[i] : off[i + 1]].tobytes()
                a, b = begin[bounds[i - lo] : bounds[i - lo + 1]] - head, end[bounds[i - lo] : bounds[i - lo + 1]] - head
                keep, at, ranges = [], 0, []
                first, own = int(bounds[i - lo]), len(a)
                # A row that only shares the doc_id has other runs there.
                mine = [
                    (g["at"], int(length[first + g["at"]]))
                    for g in gone[i] if g["at"] < own and length[first + g["at"]] and run[first + g["at"]] == g["run"]
                ]
                for s, e in _cover(mine):
                    stop = int(a[e]) if e < len(a) else len(raw)
                    keep.append(raw[at : int(a[s])])
                    ranges.append({"first": s, "last": e - 1, "start": int(a[s]), "end": int(b[e - 1])})
                    at = stop
                keep.append(raw[at:])
                texts[i], spans[i] = b"".join(keep).decode(), ranges
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()),
             pa.array(spans, pa.list_(pa.struct([(k, pa.int64()) for k in ("first", "last", "start", "end")])))],
            ["row", "kept", "spans"],
        )


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, at, run, first_doc)`` of every run that stands somewhere before: its sentences go."""
    runs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    ).mapInArrow(_runs, "run long, doc_id long, at int")
    runs = freeze(runs)
    first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    return runs.join(first.filter("n > 1"), "run").filter(F.struct("doc_id", "at") != F.col("first")).select(
        "doc_id", "at", "run", F.col("first.doc_id").alias("first_doc")
    )


def dedup_spans(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` with repeated sentences taken out of ``text``, and ``removed_spans``.

    ``removed_spans`` is an array of (first and last sentence, start and end byte) in the old text, null where nothing
    went. Null texts and rows with a null doc_id stay as they are. Of rows that repeat a doc_id, equal runs at the same
    place are one run. A column named removed_spans is replaced.
    """
    gone = repeated_runs(docs).groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("at", "run")).alias("at"))
    names = [c for c in docs.columns if c != "removed_spans"]
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    joined = docs.select(row.alias("row"), F.col("text").cast("string").alias("text")).join(
        gone, F.col("row.doc_id") == F.col("id"), "left"
    )
    span = ArrayType(StructType([StructField(k, LongType()) for k in ("first", "last", "start", "end")]))
    shape = StructType([*joined.select("row").schema, StructField("kept", StringType()), StructField("spans", span)])
    cut = joined.select("row", "text", "at").mapInArrow(_cut, shape)
    return cut.select(
        *[F.coalesce("kept", "row.text").alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names],
        F.col("spans").alias("removed_spans"),
    )
