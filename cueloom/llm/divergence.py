"""How the word use of a source differs from other sources of its language, and from the language (operator 12).

Terms that enough documents of a language hold make its vocabulary. It is sorted and numbered once, cut into ranges of
bounded size, and each range becomes a minimal acyclic transducer (:mod:`.transducer`). Texts are then counted again:
a task sums up the words of its texts, every word goes to the transducer of its range, and what the transducer knows
comes out as an ordinal, under which its counts are added up. How many rows a range will get is known from the first
count; one with many is served by several tasks, each with a copy of its transducer. From there on terms are numbers: counts are compared in
blocks of neighbouring ordinals, and ties are broken by them, since ordinals are in byte order.

All arithmetic is on whole numbers. With ``c`` occurrences of a term in a group, ``N`` of all kept terms and ``V`` kept
terms, ``p = 1 + floor(10**9 (c + 1) / (N + V))``, and a group's ``p`` differs from another's ``q`` by
``floor((p - q)**2 / q)``. The sum of such values over a vocabulary stays below 4 * 10**18 for up to 10**9 terms.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scan import segmented_scan
from ..session import freeze
from .transducer import Transducer

UNIT = 1_000_000_000
#: Bytes of terms in a transducer, at least; a larger vocabulary is cut into this many ranges and not more.
RANGE_BYTES, RANGES = 1 << 14, 4096
#: Rows of words that a task takes through a copy of a transducer, about.
RANGE_ROWS = 2_000_000
#: Ordinals compared together, and the most (source, ordinal) cells of such a block.
BLOCK_TERMS, BLOCK_CELLS = 256, 1 << 18
#: Bytes of texts a task sums up at once; a longer text is summed up by itself.
SLICE_BYTES = 12 << 20

_LETTERS = bytes.maketrans(
    bytes(range(128)), bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(128))
)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """(name, text) batches in slices of about ``SLICE_BYTES``: names, and texts in small letters with blanks between terms."""
    for batch in batches:
        names, texts, size = [], [], 0
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            names.append(name)
            texts.append(text.as_py().translate(_LETTERS))
            size += len(texts[-1])
            if size >= SLICE_BYTES:
                yield names, texts
                names, texts, size = [], [], 0
        if names:
            yield names, texts


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and, for each, the sum of its counts (or how often it is there)."""
    code, distinct = pd.factorize(keys)
    if counts is None:
        return distinct, np.bincount(code, minlength=len(distinct))
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, code, counts)
    return distinct, sums


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """For every word of the texts the number of its text and of its term, and the terms."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = joined != 32
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    # Words with one blank behind each, so that they lie side by side.
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts + 1, out=offsets[1:])
    words = _strings(joined[inside | before], offsets).dictionary_encode()
    _, ends, data = words.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(words.dictionary) + 1]
    data = np.frombuffer(data, np.uint8)[: ends[-1]] if data is not None else np.zeros(0, np.uint8)
    first = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    number = np.searchsorted(first, starts, "right") - 1
    return number, words.indices.to_numpy().astype(np.int64), _strings(data[data != 32], ends - np.arange(len(ends)))


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, term, n): in how many documents of a slice a term is."""
    for names, texts in _slices(batches):
        document, code, terms = _terms(texts)
        langs, lang = np.unique(np.array(names, object), return_inverse=True)
        width = len(terms) or 1
        once = pd.unique(document * width + code)
        key, n = _summed(lang[once // width] * width + once % width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs[key // width], pa.string()), terms.take(pa.array(key % width)).cast(pa.binary()).cast(pa.string()),
             pa.array(n, pa.int64())], ["lang", "term", "n"],
        )


def _word_counts(ranges: dict[str, tuple[list[bytes], list[int], list[int]]]):
    """((lang, source), text) to (turn, term, sources, counts): a term's occurrences in a slice, for its range.

    ``ranges`` has the first terms, the first turns and the numbers of copies of each language's ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for names, texts in _slices(batches):
            # Groups sorted by language and source, so a term's counts in one language follow each other.
            names = [(n["lang"], n["source"]) for n in names]
            pairs = sorted(set(names))
            at = {pair: i for i, pair in enumerate(pairs)}
            document, code, terms = _terms(texts)
            group = np.array([at[n] for n in names], np.int64)
            key, n = _summed(code * len(pairs) + group[document])
            order = np.argsort(key)
            key, n = key[order], n[order]
            code, group = key // len(pairs), key % len(pairs)
            langs = sorted({lang for lang, _ in pairs})
            lang = np.array([langs.index(pair[0]) for pair in pairs], np.int64)[group]
            head = np.flatnonzero(np.diff(code * len(langs) + lang, prepend=-1))
            words = terms.take(pa.array(code[head]))
            own = [ranges.get(x, ((), (), ())) for x in langs]
            place = [bisect_right(own[which][0], word) - 1 for word, which in zip(words.to_pylist(), lang[head].tolist())]
            kept = [i for i, at in enumerate(place) if at >= 0]
            which = lang[head]
            turns = [own[which[i]][1][place[i]] + 2 * (task % own[which[i]][2][place[i]]) + 1 for i in kept]
            rows = pa.array(kept, pa.int64())
            offsets = pa.array(np.append(head, len(key)), pa.int32())
            sources = pa.array([pair[1] for pair in pairs], pa.string()).take(pa.array(group))
            yield pa.RecordBatch.from_arrays(
                [pa.array(turns, pa.int64()), words.take(rows).cast(pa.binary()),
                 pa.ListArray.from_arrays(offsets, sources).take(rows),
                 pa.ListArray.from_arrays(offsets, pa.array(n, pa.int64())).take(rows)],
                ["turn", "term", "sources", "counts"],
            )

    return run


def _transducers(rows: pa.Table) -> pa.Table:
    """One range of a vocabulary (lang, part, term, ordinal, rows) as a transducer, with its first term and ordinal."""
    at = rows.column("ordinal").to_numpy()
    order = np.argsort(at)
    terms = rows.column("term").take(pa.array(order)).to_pylist()
    return pa.table({
        "lang": rows.column("lang")[:1], "part": rows.column("part")[:1], "start": pa.array([terms[0]], pa.binary()),
        "base": pa.array([int(at[order[0]])], pa.int64()), "rows": pa.array([int(rows.column("rows").to_numpy().sum())], pa.int64()),
        "machine": pa.array([Transducer.build(terms).dump()], pa.binary()),
    })


class _Recount:
    """The sums of one range: terms go through its transducer, counts are added up by ordinal and source."""

    #: Sums that wait to be added up.
    WAITING = 1 << 20

    def __init__(self, lang: str, base: int, data: bytes):
        self._lang, self._base, self._machine = lang, base, Transducer.load(data)
        self._known: dict[bytes, int] = {}
        self._sources: dict[str, int] = {}
        self._keys: list[np.ndarray] = []
        self._counts: list[np.ndarray] = []

    def add(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray) -> None:
        known, ordinal = self._known, self._machine.ordinal
        places = np.empty(len(terms), np.int64)
        for i, term in enumerate(terms.to_pylist()):
            place = known.get(term)
            if place is None:
                place = known[term] = ordinal(term)
            places[i] = place
        place = np.repeat(places, np.diff(sources.offsets.to_numpy()))
        named = sources.flatten().dictionary_encode()
        numbers = [self._sources.setdefault(name, len(self._sources)) for name in named.dictionary.to_pylist()]
        source = np.array(numbers, np.int64)[named.indices.to_numpy()]
        there = place >= 0
        self._keys.append(source[there] << 32 | place[there])
        self._counts.append(counts.flatten().to_numpy()[there])
        if sum(map(len, self._keys)) > 2 * self.WAITING:
            self._add_up()

    def _add_up(self) -> None:
        keys, sums = _summed(np.concatenate(self._keys), np.concatenate(self._counts))
        self._keys, self._counts = [keys], [sums]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self._keys:
            return
        self._add_up()
        keys, sums = self._keys[0], self._counts[0]
        names = pa.array(list(self._sources), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([self._lang] * len(keys), pa.string()), names.take(pa.array(keys >> 32)),
             pa.array((keys & 0xFFFFFFFF) + self._base), pa.array(sums)], ["lang", "source", "ordinal", "n"],
        )


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to sums by ordinal. Rows come in turns: a range's transducer, then all words of the range."""
    now = None
    for batch in batches:
        turn = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(turn)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if turn[lo] % 2:
                now.add(*(part.column(i) for i in (1, 2, 3)))
                continue
            if now is not None:
                yield from now.rows()
            now = _Recount(*(part.column(i)[0].as_py() for i in (4, 5, 6)))
    if now is not None:
        yield from now.rows()


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + floor(UNIT * (counts + 1) / total)``, exact for totals below 9 * 10**15."""
    rest, out = counts + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block of a language: for every two sources, the sum of their differences over the block's ordinals.

    Rows without an ordinal name the language's sources, with N + V as ``n``.
    """
    named = pdf[pdf["ordinal"].isna()].sort_values("source")
    cells = pdf[pdf["ordinal"].notna()]
    sources, totals = named["source"].to_numpy(), named["n"].to_numpy(np.int64)
    if len(cells):
        row = np.searchsorted(sources, cells["source"].to_numpy())
        _, column = np.unique(cells["ordinal"].to_numpy(), return_inverse=True)
        counts = np.zeros((len(sources), int(column.max()) + 1), np.int64)
        counts[row, column] = cells["n"].to_numpy(np.int64)
        p = shares(counts, totals[:, None])
        values = np.stack([((p[i] - p) ** 2 // p).sum(axis=1) for i in range(len(sources))])
    else:
        values = np.zeros((len(sources), len(sources)), np.int64)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    return pd.DataFrame({"lang": pdf["lang"].iloc[0], "source": sources[a], "item": sources[b], "value": values[a, b]})


def vocabulary(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """``(lang, term, ordinal, n_terms, upto, bytes, rows)`` of the terms that ``min_docs`` documents of a language hold.

    ``ordinal`` counts from 0 in byte order; ``upto`` are the bytes of terms up to this one, ``rows`` the slices of texts
    that have the term.
    """
    found = docs.select("lang", F.col("text").cast("binary")).mapInArrow(_document_counts, "lang string, term string, n long")
    kept = found.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).filter(
        F.col("n") >= min_docs
    ).select("lang", "term", "rows", (F.octet_length("term") + 1).cast("long").alias("bytes"))
    numbered = segmented_scan(kept, ["lang"], ["term"], None, rank="ordinal", size="n_terms", sums={"upto": "bytes"})
    return freeze(numbered.select("lang", "term", (F.col("ordinal") - 1).alias("ordinal"), "n_terms", "upto", "bytes", "rows"))


def recount(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``(lang, source, ordinal, n)``: how often each source uses each term of ``terms`` (:func:`vocabulary`)."""
    size = terms.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    width = max(RANGE_BYTES, -(-size // RANGES))
    part = F.floor((F.col("upto") - F.col("bytes")) / width).cast("int")
    machines = freeze(
        terms.select("lang", part.alias("part"), F.col("term").cast("binary").alias("term"), "ordinal", "rows")
        .groupBy("lang", "part")
        .applyInArrow(_transducers, "lang string, part int, start binary, base long, rows long, machine binary")
    )
    # The first term of each range, to the driver and to all tasks: RANGES and one for each language at most.
    found = machines.select("lang", "part", "start", "rows").orderBy("lang", "part").collect()
    ranges: dict[str, tuple[list[bytes], list[int], list[int]]] = {}
    numbers, turn = [], 0
    for r in found:
        starts, turns, copies = ranges.setdefault(r["lang"], ([], [], []))
        starts.append(bytes(r["start"]))
        turns.append(turn)
        copies.append(1 + r["rows"] // RANGE_ROWS)
        numbers.append((r["lang"], r["part"], turn, copies[-1]))
        turn += 2 * copies[-1]
    table = terms.sparkSession.createDataFrame(numbers, "lang string, part int, first long, copies long")
    words = docs.select(F.struct("lang", "source"), F.col("text").cast("binary")).mapInArrow(
        _word_counts(ranges), "turn long, term binary, sources array<string>, counts array<long>"
    )
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    ready = machines.join(F.broadcast(table), ["lang", "part"]).withColumn("copy", each).select(
        (F.col("first") + 2 * F.col("copy")).alias("turn"), "lang", "base", "machine"
    )
    mixed = words.unionByName(ready, allowMissingColumns=True)
    # A copy of a transducer has the turn before that of its words.
    sent = mixed.repartition(F.floor(F.col("turn") / 2)).sortWithinPartitions("turn")
    sums = sent.select("turn", "term", "sources", "counts", "lang", "base", "machine").mapInArrow(
        _through, "lang string, source string, ordinal long, n long"
    )
    return sums.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def audit(documents: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: what sets each source apart.

    Part ``pair``: every other source of the language and how much it differs, over all kept terms. Part ``term``: the
    ``top`` terms the source uses more than its language does. Higher values first, then items in byte order.

    Null texts, languages and sources are empty strings; every row is a document, also one that repeats another. A source
    without terms has pairs and no terms; in a language without kept terms all values are 0. An empty table gives no
    rows; further columns take no part.
    """
    docs = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    terms = vocabulary(docs, min_docs)
    counts = freeze(recount(docs, terms))
    sizes = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    used = counts.groupBy("lang", "source").agg(F.sum("n").alias("used"))
    zero = F.lit(0).cast("long")
    groups = freeze(
        docs.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(sizes, "lang", "left").select(
            "lang", "source", F.coalesce("used", zero).alias("used"), F.coalesce("v", zero).alias("v")
        )
    )
    return _pair_part(counts, groups).unionByName(_term_part(counts, groups, terms, top))


def _pair_part(counts: DataFrame, groups: DataFrame) -> DataFrame:
    by_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("s"), F.max("v").alias("v"))
    most = by_lang.agg(F.max("s").alias("s")).first()["s"] or 1
    width = max(1, min(BLOCK_TERMS, BLOCK_CELLS // most))
    last = F.greatest(F.ceil(F.col("v") / width), F.lit(1)) - 1
    blocks = by_lang.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    # Every block gets the names of all sources of its language; a language without terms has one empty block.
    names = blocks.join(groups, "lang").select(
        "lang", "block", "source", F.lit(None).cast("long").alias("ordinal"), (F.col("used") + F.col("v")).alias("n")
    )
    cells = counts.select("lang", F.floor(F.col("ordinal") / width).alias("block"), "source", "ordinal", "n")
    sums = cells.unionByName(names).groupBy("lang", "block").applyInPandas(
        _pairs, "lang string, source string, item string, value long"
    )
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _term_part(counts: DataFrame, groups: DataFrame, terms: DataFrame, top: int) -> DataFrame:
    whole = groups.groupBy("lang").agg((F.sum("used") + F.max("v")).alias("all_total"))
    totals = groups.join(whole, "lang").select("lang", "source", (F.col("used") + F.col("v")).alias("total"), "all_total")
    everywhere = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("all_n"))
    share = "1 + (cast({} + 1 as decimal(19,0)) * {}) div cast({} as decimal(19,0))"
    both = counts.join(everywhere, ["lang", "ordinal"]).join(totals, ["lang", "source"]).select(
        "lang", "source", "ordinal",
        F.expr(share.format("n", UNIT, "total")).alias("p"), F.expr(share.format("all_n", UNIT, "all_total")).alias("q"),
    )
    more = both.filter("p > q").select("lang", "source", "ordinal", F.expr("(p - q) * (p - q) div q").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))
    best = more.withColumn("rank", rank).filter(F.col("rank") <= top)
    return best.join(terms.select("lang", "ordinal", "term"), ["lang", "ordinal"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"
    )
