"""URL filter by rules and, where no rule fits, by a ratio of character language models (operator 5).

URLs that a rule allows or blocks train two Markov models over characters, one of accepted and one of rejected URLs.
Contexts have up to ``order - 1`` characters; an estimate is mixed with that of the next shorter context in proportion
to how often and how variedly the context was seen, so the order varies with the evidence. A URL's score is the mean
over its characters of the difference of log probabilities, and the cut is set on URLs that did not train.

Counts and estimates are tables keyed by context and character. They grow with the input, are made by aggregations
and joins, and never pass through the driver or a broadcast. Characters are bytes, and all bytes are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import freeze

#: Characters of a context and the one behind it: at most eight, so that they are one 64-bit number.
ORDER = 8
#: Different bytes, and none before the start; UTF-8 has no byte 255, so its number is that of 254.
KINDS = 256
#: Every so many-th decided URL (by hash of its text) sets the cut instead of training.
FOLDS = 5
BINS, SPAN = 4000, 10.0

Rule = tuple[str, str, str]  # verdict, host, path prefix


#: Number of each byte plus one; 0 stands before the start.
_BYTES = np.minimum(np.arange(1, 257), 255).astype(np.uint8)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule (ties: the smaller text) and its verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _grams(order: int):
    """Map ``(id, url)`` to ``(id, gram, n)``: how often each character after its full context is in a URL.

    A gram has eight bits for each symbol, the character itself lowest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from . import tokens

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = tokens.texts_of(batch.column(1))
            for lo, hi in tokens.chunks(off):
                base, sizes = off[lo], np.diff(off[lo : hi + 1])
                symbol = _BYTES[data[base : off[hi]]].astype(np.uint64)
                owner = np.repeat(np.arange(lo, hi), sizes)
                place = np.arange(len(symbol)) - np.repeat(off[lo:hi] - base, sizes)
                gram = symbol.copy()
                for back in range(1, order):
                    before = np.zeros_like(symbol)
                    before[back:] = symbol[:-back]
                    gram |= np.where(place >= back, before, np.uint64(0)) << np.uint64(8 * back)
                at = np.lexsort((gram, owner))
                gram, owner = gram[at], owner[at]
                new = np.ones(len(gram), bool)
                new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
                first = np.flatnonzero(new)
                n = np.diff(first, append=len(gram))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[owner[first]]), pa.array(gram[first].view(np.int64)), pa.array(n)], ["id", "gram", "n"]
                )

    return run


def _model(grams: DataFrame, order: int) -> DataFrame:
    """``(gram, ratio)``: difference of the log probabilities, of each row of ``grams(gram, allow, block)``.

    Rows with no counts are characters and contexts that only scored URLs have. Every level has one row for each
    context and character; a group or a key has at most 256 of them.
    """
    out = None
    for level in range(1, order + 1):
        bits = (1 << 8 * level) - 1
        low = F.col("gram") if level == 8 else F.col("gram").bitwiseAND(F.lit(bits))
        context = W.partitionBy(F.call_function("shiftrightunsigned", F.col("gram"), F.lit(8)))
        seen = grams.groupBy(low.alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        seen = seen.select(
            "gram", "allow", "block", *[F.sum(c).over(context).alias(f"{c}_all") for c in ("allow", "block")],
            *[F.count_if(F.col(c) > 0).over(context).alias(f"{c}_kinds") for c in ("allow", "block")],
        )
        if out is None:
            mixed = seen.withColumns({f"{c}_p": F.lit(1 / KINDS) for c in ("allow", "block")})
        else:
            mixed = seen.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(bits >> 8))).join(
                out.withColumnRenamed("gram", "suffix"), "suffix"
            )
        out = mixed.select("gram", *[
            F.when(F.col(f"{c}_all") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_p")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds")))
            .otherwise(F.col(f"{c}_p")).alias(f"{c}_p") for c in ("allow", "block")
        ])
    return out.select("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def _cut(scored: DataFrame) -> float:
    """The score that errs least on held-back URLs, both kinds weighing the same; 0 without both kinds."""
    place = F.least(F.greatest(F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN))), F.lit(0)), F.lit(BINS - 1))
    rows = scored.groupBy(place.cast("int").alias("bin"), "label").agg(F.count(F.lit(1)).alias("n")).collect()
    hist = np.zeros((2, BINS))
    for r in rows:
        hist[r["label"], r["bin"]] += r["n"]
    if not hist.sum(axis=1).all():
        return 0.0
    share = hist / hist.sum(axis=1, keepdims=True)
    blocked = np.concatenate([np.zeros((2, 1)), np.cumsum(share, axis=1)], axis=1)
    error = blocked[1] + (1 - blocked[0])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    edges = -SPAN + np.arange(BINS + 1) * (2 * SPAN / BINS)
    return float(edges[best][np.argmin(np.abs(edges[best]))])


def judge(pages: DataFrame, rules: Sequence[Rule], order: int = ORDER) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row of ``pages(page_id, url)``.

    ``verdict`` is the rule's, else ``allow`` if the score reaches the cut. A null or empty url scores 0. If no URL is
    allowed by a rule, or none is blocked, all scores are 0 and the cut is 0. Contexts have ``order - 1`` bytes at most.
    """
    host, path = parts(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select(
        "page_id", "url", host.alias("host"), path.alias("path")
    )
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0
    # A row is known by a number that stays the same when tasks run again.
    marked = freeze(urls.select(
        "page_id", "url", "host", "path", name.alias("rule"), verdict.alias("ruled"), held.alias("held")
    ).withColumn("id", F.monotonically_increasing_id()))
    grams = freeze(
        marked.filter("url <> ''").select("id", "url").mapInArrow(_grams(order), "id long, gram long, n long")
    )
    learns = marked.filter("ruled IS NOT NULL AND NOT held").select("id", "ruled")
    known = {r["ruled"] for r in learns.join(grams.select("id"), "id", "left_semi").select("ruled").distinct().collect()}
    if known == {"allow", "block"}:
        counted = grams.join(learns, "id", "left").groupBy("gram").agg(*[
            F.sum(F.when(F.col("ruled") == c, F.col("n")).otherwise(0)).alias(c) for c in ("allow", "block")
        ])
        ratios = _model(freeze(counted), order)
        sums = grams.join(ratios, "gram").groupBy("id").agg(F.sum(F.col("n") * F.col("ratio")).alias("total"))
        scored = marked.join(sums, "id", "left").withColumn(
            "score", F.coalesce(F.col("total") / F.octet_length("url"), F.lit(0.0))
        )
        scored = freeze(scored.select("page_id", "url", "host", "path", "rule", "ruled", "held", "score"))
    else:
        scored = marked.withColumn("score", F.lit(0.0))
    cut = _cut(scored.filter("ruled IS NOT NULL AND url <> '' AND held").select(
        (F.col("ruled") == "allow").cast("int").alias("label"), "score"
    ))
    said = F.coalesce("ruled", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", said.alias("verdict"), "score")
