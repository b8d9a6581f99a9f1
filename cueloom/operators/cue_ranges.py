"""Cues of documents that come as ranges of lines (A1, C1-C4 for documents too large for one row).

A range is worked on in its row, like a whole document in :mod:`.cues`. What a block format needs to know from the lines
before is one of three states: no time is pending, a time waits for words, or a cue is open. So each range first
tells, for each state it may be entered in, what it leaves open at its end and how many cues it closes; the short
reports of a document are chained in order; then every range makes its cues on its own, with what was open before it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .cues import BLANK, BLOCK_CUE, BLOCK_FORMATS, CUES_BY_FORMAT, ESCAPE, TIME, WORDS, cues_of_matches, marked_lines

_CLOSED = BLOCK_CUE + BLANK
# What was open before a range, in its report: an escape that no text contains, as long as a stamp and a line number.
_HELD_TIME = TIME + (ESCAPE + "x") * 10
_HELD_CUE = _HELD_TIME + WORDS + ESCAPE + "x"
_ENTRIES = ("", _HELD_TIME, _HELD_CUE)
_TIME_PIECE = re.compile(f"({TIME}.{{11}})([0-9]{{9}})", re.DOTALL)


def _left_open(marked: Column) -> Column:
    """The end of marked lines that belongs to no closed cue: an open cue, else the last time, else nothing."""
    rest = F.regexp_replace(marked, _CLOSED, "")
    at = F.locate(TIME, rest)
    cue = F.substring(rest, at, F.length(rest))
    time = F.concat(F.lit(TIME), F.substring(F.substring_index(rest, TIME, -1), 1, 20))
    return F.when(at == 0, "").when(F.contains(cue, F.lit(WORDS)), cue).otherwise(time)


def _report(text: Column) -> Column:
    """For each format, an array of (what is left open, cues closed) by the state a range is entered in."""
    out = F.lit(None)
    for fmt, cues in CUES_BY_FORMAT.items():
        if fmt in BLOCK_FORMATS:
            marked = marked_lines(text, fmt)
            runs = F.transform(F.array(*[F.lit(e) for e in _ENTRIES]), lambda entry: F.concat(entry, marked))
            one = F.transform(runs, lambda run: F.struct(
                _left_open(run).alias("open"), F.size(F.regexp_extract_all(run, F.lit(_CLOSED), 0)).cast("long").alias("n")
            ))
        else:
            n = F.size(cues(text)).cast("long")
            one = F.transform(F.array(F.lit(""), F.lit(""), F.lit("")), lambda e: F.struct(e.alias("open"), n.alias("n")))
        out = F.when(F.col("format") == fmt, one).otherwise(out)
    return out


def _n_lines(text: Column) -> Column:
    one_end = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.length(one_end) - F.length(F.replace(one_end, F.lit("\n"), F.lit(""))) + 1


def _kind(held: str) -> int:
    return 0 if not held else 2 if WORDS in held else 1


def _chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (source_id, range_no) to what is open, and the lines and cues, before each range."""
    source, waiting = None, None
    held, line, idx = "", 0, 0
    for pdf in batches:
        out = []
        for key, number, n_lines, opens, counts in zip(*(pdf[c] for c in ("source_id", "range_no", "n_lines", "opens", "counts"))):
            if waiting is not None:
                out.append((*waiting, key != source))
            if key != source:
                source, held, line, idx = key, "", 0, 0
            waiting = (key, number, held, line, idx)
            kind = _kind(held)
            # Line numbers of the report are those in the range; what was held has numbers of the document already.
            left = _TIME_PIECE.sub(lambda m, first=line: f"{m[1]}{int(m[2]) + first:09d}", opens[kind])
            held = left.replace(_ENTRIES[kind], held) if kind else left
            line, idx = line + int(n_lines), idx + int(counts[kind])
        if out:
            yield pd.DataFrame(out, columns=["source_id", "range_no", "held", "first_line", "first_idx", "last"])
    if waiting is not None:
        yield pd.DataFrame([(*waiting, True)], columns=["source_id", "range_no", "held", "first_line", "first_idx", "last"])


def parse_ranges(ranges: DataFrame) -> DataFrame:
    """Cues of (source_id, range_no, format, text, source_version) rows, as :func:`.cues.parse_timed_text` gives them.

    The ranges of a document, in order of ``range_no`` and joined by line ends, are the document; wherever it is cut
    between lines, the cues, their lines and their numbers are the same. Texts are shuffled once, to meet what is open
    before them; the reports are as long as the cues that reach over a cut. Null texts are empty ranges. Further
    columns are carried along.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ranges.schema}
    rows = ranges.filter(F.col("format").isin(*CUES_BY_FORMAT)).withColumn("text", F.coalesce("text", F.lit("")))
    reports = rows.select(
        "source_id", "range_no", _n_lines(F.col("text")).cast("long").alias("n_lines"), _report(F.col("text")).alias("r")
    ).select("source_id", "range_no", "n_lines", F.col("r.open").alias("opens"), F.col("r.n").alias("counts"))
    chained = reports.repartition("source_id").sortWithinPartitions("source_id", "range_no").mapInPandas(
        _chain,
        f"source_id {kinds['source_id']}, range_no {kinds['range_no']}, held string, first_line long, first_idx long, last boolean",
    )
    met = rows.join(chained, ["source_id", "range_no"])
    text, cues = F.col("text"), F.lit(None)
    for fmt, parse in CUES_BY_FORMAT.items():
        if fmt in BLOCK_FORMATS:
            marked = F.concat("held", marked_lines(text, fmt, F.col("first_line")))
            closed = F.transform(F.regexp_extract_all(marked, F.lit(_CLOSED), 0), lambda m: F.translate(m, BLANK, ""))
            found = cues_of_matches(F.when(F.col("last"), F.regexp_extract_all(marked, F.lit(BLOCK_CUE), 0)).otherwise(closed))
        else:
            found = F.transform(
                parse(text), lambda c: F.struct((c["line"] + F.col("first_line")).cast("int").alias("line"), c["ts"].alias("ts"), c["text"].alias("text"))
            )
        cues = F.when(F.col("format") == fmt, found).otherwise(cues)
    extra = [c for c in ranges.columns if c not in ("source_id", "range_no", "source_version", "text", "format")]
    return met.select("source_id", "source_version", "first_idx", *extra, F.posexplode(cues).alias("_pos", "_cue")).select(
        "source_id", F.col("_cue.line").cast("int").alias("line_start"), (F.col("first_idx") + F.col("_pos") + 1).cast("int").alias("idx"),
        F.col("_cue.ts").alias("ts_text"), tx.stamp_ms(F.col("_cue.ts")).alias("start_ms"), F.col("_cue.text").alias("text"),
        "source_version", *extra,
    )
