"""Toxicity scores by FTRL-proximal logistic regression over hashed word features (operator 7).

Features of a text: its distinct words, bigrams and skip-grams (one word left out), hashed to ``2 ** BITS`` places;
each counts once. Words are runs of ASCII letters, digits and bytes from 0x80, A-Z lower-cased.

Training reads a bounded sample of the labelled rows (``max_rows``, chosen by a hash of doc_id): texts are encoded where
they lie, and one task runs FTRL over the encoded rows, in an order given by a hash, for a few epochs. Per-coordinate
rates and L1 leave few non-zero weights; only these pass through the driver, and travel to the scoring tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

BITS = 20
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 8.0, 0.1
#: Most labelled rows that training reads.
MAX_ROWS = 16_000
#: Hash place of the constant feature.
BIAS = 0

_TABLE = tokens.letter_table()
_M1, _M2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _features(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash places of all features of a chunk of texts, and the text each belongs to."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    place, text = [words >> np.uint64(64 - BITS)], [owner]
    for gap, m in ((1, _M1), (2, _M2)):
        if len(words) > gap:
            pair = tokens.mix(words[:-gap] * m + words[gap:])
            inside = owner[:-gap] == owner[gap:]
            place.append((pair >> np.uint64(64 - BITS))[inside])
            text.append(owner[:-gap][inside])
    return np.concatenate(place).astype(np.int64), np.concatenate(text)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for _, words, bounds in tokens.hashed(batch.column(1), _TABLE):
            place, text = _features(words, bounds)
            order = np.argsort(text, kind="stable")
            cut = np.searchsorted(text[order], np.arange(len(bounds)))
            place = place[order]
            out += [np.unique(place[a:b]).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["doc_id", "label", "places"]
        )


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    keep = np.abs(z) > L1
    return np.where(keep, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FTRL over all rows of the partition, ``EPOCHS`` times; the non-zero weights. Texts without words still move the constant."""
    rows = [
        (label, np.append(np.frombuffer(places, "<i4"), BIAS))
        for batch in batches
        for label, places in zip(batch.column("label").to_pylist(), batch.column("places").to_pylist())
    ]
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(EPOCHS):
        for label, x in rows:
            zx, nx = z[x], n[x]
            w = _weights(zx, nx)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            n[x] = nx + g * g
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA * w
    w = _weights(z, n)
    places = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(w[places])], ["place", "weight"])


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights by hash place from ``labels(doc_id, label)`` rows where ``may_learn`` holds (a condition on doc_id).

    Null ids, null labels and labels other than 0 and 1 are left out; of a repeated id the smallest label counts.
    Without labelled rows all weights are zero.
    """
    marked = labels.filter(may_learn).filter("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(
        F.min("label").alias("label")
    )
    share = max_rows / max(1, marked.count())
    if share < 1:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # The sample is bounded by max_rows, so it may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(marked), "doc_id").select("doc_id", "text", F.col("label").cast("int"))
    encoded = sample.mapInArrow(_encode, "doc_id long, label int, places binary")
    ordered = encoded.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "places")
    weights = np.zeros(1 << BITS, np.float32)
    for r in ordered.mapInArrow(_learn, "place long, weight double").collect():
        weights[r["place"]] = r["weight"]
    return weights


def _score(places: np.ndarray, values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS, np.float32)
        w[places] = values
        for batch in batches:
            total = np.full(batch.num_rows, float(w[BIAS]))
            for at, words, bounds in tokens.hashed(batch.column(1), _TABLE):
                place, text = _features(words, bounds)
                hit = (w[place] != 0) & (place != BIAS)
                once = np.unique(text[hit] << BITS | place[hit])
                np.add.at(total, at + (once >> BITS), w[once & ((1 << BITS) - 1)].astype(float))
            score = 1 / (1 + np.exp(-np.clip(total, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(doc_id, score)`` for every row; a null or empty text has the score of the constant alone."""
    places = np.flatnonzero(weights)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _score(places, weights[places]), "doc_id long, score double"
    )


def _score_rows(places: np.ndarray, values: np.ndarray, threshold: float):
    """Keep whole rows (a struct) whose text scores below the threshold."""
    inner = _score(places, values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (scored,) = inner(iter([batch]))
            keep = pa.array(scored.column(1).to_numpy() < threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep)], ["row"])

    return run


def drop_toxic(docs: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores below ``threshold``."""
    places = np.flatnonzero(weights)
    schema = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).schema
    return (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string"))
        .mapInArrow(_score_rows(places, weights[places], threshold), schema)
        .select("row.*")
    )
