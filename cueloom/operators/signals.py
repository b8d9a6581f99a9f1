"""Sampled signals: pieces, levels, envelopes, onsets, channel energy.

Signals are *pieces* (keys, ``at``, ``samples``): runs of samples with the place of the first one; a block table is a
piece table with ``at = block_no * block_size``. Levels, envelopes and onsets are worked out from a few sums per piece
and cell, taken inside the array, so a sample never becomes a row. Shuffle keys always include a place in time, so a
long signal is spread out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import sound as sd
from ..functions import text as tx
from ..functions.scan import neighbours, segmented_scan

VOICE_BAND = (85.0, 3000.0)
FFT_LEN, FFT_HOP, FFT_RUN = 2048, 1024, 16
SIDE_RATIO = 1.2
SIDE_WINDOW_S, SIDE_MIN_S = 10, 2
ONSET_FRAME, ONSET_HOP = 1024, 512
ONSET_SHARE, ONSET_MAX_MS = 0.3, 500
CUES_PER_CHUNK = 4096


def part_of(samples: Column | str, at: Column, start: Column, end: Column) -> Column:
    """Samples between two places of a piece that begins at ``at``; empty when the places are reversed.

    The optimizer may evaluate a slice before the filter that stands in front of it, so this never fails.
    """
    first = F.greatest(F.lit(1), start - at + 1).cast("int")
    return F.slice(samples, first, F.greatest(F.lit(0), end - start).cast("int"))


# --- forms ------------------------------------------------------------------

def decode_pcm(rows: DataFrame, content: str = "content", width: str = "width") -> DataFrame:
    """Little-endian PCM bytes of 1, 2 or 4 bytes per sample to ``samples array<float>``."""
    kinds = {1: "<i1", 2: "<i2", 4: "<i4"}
    keep = [f for f in rows.schema.fields if f.name != content]

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=[content])
            out["samples"] = [
                np.frombuffer(raw[: len(raw) - len(raw) % int(w)], dtype=kinds[int(w)]).astype(np.float32)
                for raw, w in zip(pdf[content], pdf[width])
            ]
            yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", samples array<float>"
    return rows.mapInPandas(convert, schema)


def rescale_width(samples: Column, from_width: Column | int, to_width: Column | int) -> Column:
    """Samples of one width on the scale of another."""
    factor = sd.full_scale(to_width) / sd.full_scale(from_width)
    return F.transform(samples, lambda x: x * factor)


def pieces_of(blocks: DataFrame, block_size: int) -> DataFrame:
    return blocks.withColumn("at", F.col("block_no") * block_size)


def frames_of(pieces: DataFrame, *keys: str) -> DataFrame:
    """Explode pieces into frames."""
    return pieces.select(*keys, "at", F.posexplode("samples").alias("_i", "value")).select(
        *keys, (F.col("at") + F.col("_i")).alias("frame_no"), F.col("value").cast("double").alias("value")
    )


def mono_pieces(blocks: DataFrame, *keys: str) -> DataFrame:
    """Mean of the two channels per piece; a signal with one channel stays as it is."""
    side = [F.max(F.when(F.col("channel") == c, F.col("samples"))).alias(f"_c{c}") for c in (0, 1)]
    both = F.zip_with("_c0", "_c1", lambda a, b: (a + b) / 2.0)
    doubles = F.coalesce("_c0", "_c1").cast("array<double>")
    return blocks.groupBy(*keys, "at").agg(*side).select(
        *keys, "at",
        F.when(F.col("_c0").isNotNull() & F.col("_c1").isNotNull(), both).otherwise(doubles).alias("samples"),
    )


def decimate(pieces: DataFrame, stride: Column) -> DataFrame:
    """Every ``stride``-th sample counted from place 0, no low-pass."""
    kept = F.filter(F.col("samples"), lambda _x, i: (F.col("at") + i) % stride == 0)
    return pieces.withColumn("samples", kept).withColumn("at", F.ceil(F.col("at") / stride))


def cut_windows(pieces: DataFrame, keys: Sequence[str], span: int, hop: int) -> DataFrame:
    """Windows of up to ``span`` samples every ``hop``: (keys, window_no, samples); short at the signal's end.

    Each piece is sliced for the windows it touches; a window gathers at most its own length.
    """
    end = F.col("at") + F.size("samples")
    first = F.greatest(F.lit(0), F.floor((F.col("at") - span) / hop) + 1)
    last = F.floor((end - 1) / hop)
    sliced = (
        pieces.filter(F.size("samples") > 0)
        .select(*keys, "at", "samples", F.explode(F.sequence(first, last)).alias("window_no"))
        .withColumn("_s", F.greatest(F.col("at"), F.col("window_no") * hop))
        .withColumn("_e", F.least(end, F.col("window_no") * hop + span))
        .filter(F.col("_e") > F.col("_s"))
        .withColumn(
            "_part",
            part_of("samples", F.col("at"), F.col("_s"), F.col("_e")),
        )
    )
    parts = F.array_sort(F.collect_list(F.struct(F.col("_s").alias("s"), F.col("_part").alias("p"))))
    return sliced.groupBy(*keys, "window_no").agg(
        F.flatten(F.transform(parts, lambda x: x["p"])).alias("samples")
    )


# --- levels -----------------------------------------------------------------

def _square_sum(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))


def _peak(samples: Column) -> Column:
    return F.greatest(F.array_max(samples), -F.array_min(samples)).cast("double")


def signal_level(pieces: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Level in dBFS, peak and length per signal."""
    samples = F.col("samples")
    return pieces.groupBy(*keys).agg(
        F.sum(F.size(samples)).cast("long").alias("n_frames"),
        sd.rms_db(F.sum(_square_sum(samples)) / F.sum(F.size(samples)), width).alias("rms_db"),
        F.max(_peak(samples)).alias("peak"),
    )


def cells_of(pieces: DataFrame, keys: Sequence[str], cell: Column | int) -> DataFrame:
    """Sums of squares per cell of ``cell`` samples: (keys, cell, ss, n, head).

    Each piece gives one row for each cell it touches; ``head`` is the square of a cell's first sample, if it is here.
    """
    cell = F.lit(cell) if isinstance(cell, int) else cell
    at, end = F.col("at"), F.col("at") + F.size("samples")

    def sums(c: Column) -> Column:
        begin = F.greatest(at, c * cell)
        stop = F.least(end, (c + 1) * cell)
        first = F.get(F.col("samples"), (c * cell - at).cast("int")).cast("double")
        return F.struct(
            c.alias("cell"), _square_sum(part_of("samples", at, begin, stop)).alias("ss"), (stop - begin).alias("n"),
            F.when(c * cell >= at, first * first).alias("head"),
        )

    touched = F.sequence(F.floor(at / cell), F.floor((end - 1) / cell))
    parts = pieces.filter(F.size("samples") > 0).select(*keys, F.explode(F.transform(touched, sums)).alias("c"))
    return parts.groupBy(*keys, F.col("c.cell").alias("cell")).agg(
        F.sum("c.ss").alias("ss"), F.sum("c.n").alias("n"), F.max("c.head").alias("head")
    )


def sliding_mean_square(pieces: DataFrame, keys: Sequence[str], window: int, hop: int) -> DataFrame:
    """Mean square over ``window`` samples every ``hop``: (keys, hop_no, mean_square).

    Sums per cell (the common divisor of both lengths) come first, then each cell is added to the windows
    that cover it. Incomplete windows at the end drop out; a signal shorter than a window keeps one point.
    """
    cell = gcd(window, hop)
    per_hop, per_window = hop // cell, window // cell
    cells = cells_of(pieces, keys, cell)
    first = F.greatest(F.lit(0), F.ceil((F.col("cell") - per_window + 1) / per_hop))
    last = F.floor(F.col("cell") / per_hop)
    covered = cells.filter(first <= last).select(*keys, "ss", "n", F.explode(F.sequence(first, last)).alias("hop_no"))
    return (
        covered.groupBy(*keys, "hop_no")
        .agg(F.sum("ss").alias("_ss"), F.sum("n").alias("_n"))
        .filter((F.col("_n") == window) | (F.col("hop_no") == 0))
        .select(*keys, "hop_no", (F.col("_ss") / F.col("_n")).alias("mean_square"))
    )


def envelope(
    pieces: DataFrame, keys: Sequence[str], sample_rate: int, width: int,
    window_ms: int = 100, hop_ms: int = 50,
) -> DataFrame:
    """Loudness envelope (keys, hop_no, env_db)."""
    window, hop = int(window_ms * sample_rate / 1000), int(hop_ms * sample_rate / 1000)
    ms = sliding_mean_square(pieces, keys, window, hop)
    return ms.select(*keys, "hop_no", sd.envelope_db(F.col("mean_square"), width).alias("env_db"))


def envelope_segments(env: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each envelope point with the next one; the last point continues level. ``last_hop`` is per signal."""
    pairs = neighbours(env, keys, "hop_no", ["env_db"])
    return pairs.select(
        *keys, "hop_no", F.col("env_db").alias("e0"), F.coalesce("env_db_1", "env_db").alias("e1")
    )


def interpolate_envelope(
    points: DataFrame, env: DataFrame, hop_frames: int, key: str = "signal_id"
) -> DataFrame:
    """Points (signal, frame_no, ..) with ``env_db`` between the two envelope points around them.

    Both envelope points are in one row, so one join on (signal, hop) answers it; places beyond the ends
    take the end value.
    """
    last = env.groupBy(key).agg(F.max("hop_no").alias("_last"))
    pos = F.greatest(F.lit(0.0), F.col("frame_no") / hop_frames)
    placed = (
        points.join(last, key, "inner")
        .withColumn("_pos", F.least(pos, F.col("_last").cast("double")))
        .withColumn("hop_no", F.floor("_pos"))
    )
    frac = F.col("_pos") - F.col("hop_no")
    return (
        placed.join(envelope_segments(env, [key]), [key, "hop_no"])
        .withColumn("env_db", F.col("e0") * (1.0 - frac) + F.col("e1") * frac)
        .drop("_last", "_pos", "hop_no", "e0", "e1")
    )


# --- onsets -----------------------------------------------------------------

def energy_rises(
    pieces: DataFrame, keys: Sequence[str], frame_len: int = ONSET_FRAME, hop: int = ONSET_HOP
) -> DataFrame:
    """Short-time RMS and its rise to the next frame, kept at the earlier frame; never negative.

    The last frame has no rise.
    """
    rms = sliding_mean_square(pieces, keys, frame_len, hop).select(
        *keys, "hop_no", F.sqrt("mean_square").alias("rms")
    )
    pairs = neighbours(rms, keys, "hop_no", ["rms"])
    rise = F.when(F.col("rms_1").isNotNull(), F.greatest(F.col("rms_1") - F.col("rms"), F.lit(0.0)))
    return pairs.select(*keys, "hop_no", "rms", rise.alias("rise"))


def neighbour_bounds(cues: DataFrame, durations: DataFrame, key: str = "signal_id") -> DataFrame:
    """G1: cues (signal, seq, start_ms) with ``lo_ms`` (previous start, else 0) and ``hi_ms`` (next start,
    else the signal's ``duration_ms``)."""
    scanned = segmented_scan(
        cues, [key], ["seq"], F.floor(F.col("seq") / CUES_PER_CHUNK),
        lags={"_prev": "start_ms"}, leads={"_next": "start_ms"},
    )
    return (
        scanned.join(durations.select(key, "duration_ms"), key, "inner")
        .withColumn("lo_ms", F.coalesce("_prev", F.lit(0)))
        .withColumn("hi_ms", F.coalesce("_next", "duration_ms"))
        .drop("_prev", "_next")
    )


def nearest_onsets(
    bounded: DataFrame,
    pieces: DataFrame,
    sample_rate: int,
    frame_len: int = ONSET_FRAME,
    hop: int = ONSET_HOP,
    max_offset_ms: int = ONSET_MAX_MS,
    grid: str = "global",
    key: str = "signal_id",
) -> DataFrame:
    """Cues (signal, seq, start_ms, lo_ms, hi_ms, duration_ms) with ``aligned_ms``.

    Rises of at least 30 % of the largest one in the search range are onsets; the nearest to the cue
    is taken, the earliest on a tie, if it is within ``max_offset_ms``; otherwise the cue stays.

    ``pieces`` are the signal's samples (signal, at, samples). ``grid='cue'`` anchors the frames at each
    search start, ``'global'`` at 0. On the one grid the largest rise of a range is that of a few blocks of frames
    (:func:`_covering_blocks`), and only frames within ``max_offset_ms``, which alone can win, are met one by one: a cue
    with a range of hours reads some hundred rows. Frames of a grid of its own are worked out for each cue, in time
    buckets.
    """
    cue = [key, "seq"]
    start = F.floor(F.col("lo_ms") * sample_rate / 1000)
    stop = F.floor(F.least(F.col("hi_ms"), F.col("duration_ms")) * sample_rate / 1000)
    ranged = bounded.withColumn("_from", start).withColumn("_to", stop)
    usable = (F.col("hi_ms") > F.col("lo_ms")) & (F.col("_to") - F.col("_from") >= sample_rate)
    place_ms = F.col("_place") * (1000.0 / sample_rate)
    off = F.abs(place_ms - F.col("start_ms"))
    # At most 2 * max_offset_ms / hop rises are near a cue, so the list is short.
    close = F.collect_list(F.when(off <= max_offset_ms, F.struct(off.alias("off"), place_ms.alias("ms"), "rise")))
    picks = [F.max("rise").alias("_max"), F.count("rise").alias("_n"), close.alias("_close")]
    loud = F.filter("_close", lambda c: c["rise"] >= F.col("_max") * ONSET_SHARE)
    found = F.when((F.col("_max") >= 1e-10) & (F.col("_n") >= 2), F.array_min(loud)["ms"])
    aligned = F.coalesce(F.floor(found), F.col("start_ms")).alias("aligned_ms")

    if grid == "cue":
        bucket = 64 * hop
        buckets = F.sequence(F.floor(F.col("_from") / bucket), F.floor((F.col("_to") - 1) / bucket))
        end = F.col("at") + F.size("samples")
        touched = F.sequence(F.floor(F.col("at") / bucket), F.floor((end - 1) / bucket))
        s = F.greatest("at", "_from", F.col("_bucket") * bucket)
        e = F.least(end, F.col("_to"), (F.col("_bucket") + 1) * bucket)
        known = [*cue, "start_ms", "_from"]
        spread = ranged.filter(usable).select(*known, "_to", F.explode(buckets).alias("_bucket"))
        inside = (
            pieces.filter(F.size("samples") > 0)
            .withColumn("_bucket", F.explode(touched))
            .join(spread, [key, "_bucket"])
            .filter(e > s)
            .withColumns({"samples": part_of("samples", F.col("at"), s, e), "at": s - F.col("_from")})
        )
        rises = energy_rises(inside, known, frame_len, hop)
        placed = rises.withColumn("_place", F.col("_from") + F.col("hop_no") * hop)
        best = placed.groupBy(*cue).agg(*picks)
        return bounded.join(best, cue, "left").select(*bounded.columns, aligned)

    # Frames of the one grid that lie in the range, and those near the cue.
    low, high = F.ceil(F.col("_from") / hop), F.floor((F.col("_to") - hop - frame_len) / hop)
    per_ms = sample_rate / 1000.0 / hop
    near = F.transform(
        _whole_numbers(
            F.greatest(low, F.floor((F.col("start_ms") - max_offset_ms) * per_ms)),
            F.least(high, F.ceil((F.col("start_ms") + max_offset_ms) * per_ms)),
        ),
        lambda at: _block(0, at, False),
    )
    # Cues without a usable range keep one row with no block, so they come through the left join.
    none = F.array(F.lit(None).cast("struct<level: int, block: bigint, whole: boolean>"))
    spread = ranged.withColumn(
        "_b", F.explode_outer(F.when(usable, F.concat(_covering_blocks(low, high), near)).otherwise(none))
    ).withColumns({"level": F.col("_b.level"), "block": F.col("_b.block")})
    rises = energy_rises(pieces, [key], frame_len, hop).filter(F.col("rise").isNotNull())
    met = spread.join(_block_maxima(rises, key), [key, "level", "block"], "left")
    place_ms = F.col("block") * hop * (1000.0 / sample_rate)
    off = F.abs(place_ms - F.col("start_ms"))
    whole = F.col("_b.whole")
    close = F.when(~whole & (off <= max_offset_ms) & F.col("rise").isNotNull(), F.struct(off.alias("off"), place_ms.alias("ms"), "rise"))
    picks = [F.max(F.when(whole, F.col("rise"))).alias("_max"), F.sum(F.when(whole, F.col("n"))).alias("_n"),
             F.collect_list(close).alias("_close")]
    return met.groupBy(*bounded.columns).agg(*picks).select(*bounded.columns, aligned)


#: Frames in a block of the first level, and blocks in one of the next; and the levels above single frames.
BLOCK_FRAMES, BLOCK_LEVELS = 64, 3


def _block(level: int, number: Column, whole: bool) -> Column:
    return F.struct(F.lit(level).alias("level"), number.cast("long").alias("block"), F.lit(whole).alias("whole"))


def _whole_numbers(first: Column, last: Column) -> Column:
    """All whole numbers from first to last, none if last is smaller."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _covering_blocks(low: Column, high: Column, level: int = 0) -> Column:
    """The blocks that make up the frames from ``low`` to ``high``: small ones at both ends, large ones between.

    No more than ``2 * BLOCK_FRAMES`` of each level but the last, however long the range.
    """
    def listed(first: Column, last: Column) -> Column:
        return F.transform(_whole_numbers(first, last), lambda at: _block(level, at, True))

    def ends_and_rest(r: Column) -> Column:
        first, last = r["first"], r["last"]
        if level == BLOCK_LEVELS:
            return listed(first, last)
        up, down = F.ceil(first / BLOCK_FRAMES), F.floor((last + 1) / BLOCK_FRAMES)
        split = F.concat(
            listed(first, up * BLOCK_FRAMES - 1), listed(down * BLOCK_FRAMES, last), _covering_blocks(up, down - 1, level + 1)
        )
        return F.when(up < down, split).otherwise(listed(first, last))

    return tx.bind(F.struct(low.cast("long").alias("first"), high.cast("long").alias("last")), ends_and_rest)


def _block_maxima(rises: DataFrame, key: str) -> DataFrame:
    """(key, level, block, rise, n): the largest rise and the number of rises of every block; level 0 are the rises."""
    at = F.col("hop_no").cast("long")
    blocks = F.array(*[
        F.struct(F.lit(n).alias("level"), F.floor(at / BLOCK_FRAMES**n).alias("block")) for n in range(BLOCK_LEVELS + 1)
    ])
    return rises.select(key, "rise", F.inline(blocks)).groupBy(key, "level", "block").agg(
        F.max("rise").alias("rise"), F.count(F.lit(1)).alias("n")
    )


def clip_onsets(
    pieces: DataFrame, sample_rate: int, key: str = "clip_id", ratio: float = 0.02, min_ms: float = 10.0
) -> DataFrame:
    """Where a clip's sound starts, in ms; 0 if it never does or the clip is too short.

    ``pieces`` are (clip, at, samples).

    Frames of min(1024, n/4) samples overlap by half; the first whose RMS reaches 2 % of the clip's own,
    or 1, counts. A frame that ends with the last sample is left out.
    """
    samples = F.col("samples")
    whole = pieces.groupBy(key).agg(
        F.sum(F.size(samples)).cast("long").alias("_n"), (F.sum(_square_sum(samples)) / F.sum(F.size(samples))).alias("_ms")
    )
    length = F.least(F.lit(1024), F.floor(F.col("_n") / 4))
    whole = whole.withColumn("_len", length).withColumn("_hop", F.floor(length / 2))
    fit = whole.filter((F.col("_len") >= 64) & (F.col("_n") >= sample_rate // 10))
    known = pieces.select(key, "at", "samples").join(fit.select(key, "_hop"), key, "inner")
    # An odd frame reaches one sample into a third cell, so cells carry their first square.
    cells = cells_of(known, [key, "_hop"], F.col("_hop"))
    near = neighbours(cells, [key], "cell", ["ss", "head"], span=2)
    extra = F.when(F.col("_len") % 2 == 1, F.coalesce("head_2", F.lit(0.0))).otherwise(F.lit(0.0))
    level = F.sqrt((F.col("ss") + F.coalesce("ss_1", F.lit(0.0)) + extra) / F.col("_len"))
    threshold = F.greatest(F.sqrt("_ms") * ratio, F.lit(1.0))
    begin = F.col("cell") * F.col("_hop")
    first = (
        near.join(fit, key, "inner")
        .filter((begin < F.col("_n") - F.col("_len")) & (level >= threshold))
        .groupBy(key)
        .agg(F.min(begin).alias("_at"))
    )
    onset = F.when(F.col("_at").isNotNull(), F.greatest(F.col("_at") / sample_rate * 1000.0, F.lit(min_ms)))
    return whole.select(key).join(first, key, "left").select(
        key, F.coalesce(onset, F.lit(0.0)).alias("onset_ms")
    )


def align_to_onset(pos_ms: Column, onset_ms: Column, sample_rate: int) -> tuple[Column, Column]:
    """(position in ms, frames to trim): the clip moves up by its onset, the rest is cut off."""
    moved = pos_ms - onset_ms
    late = moved >= 0
    pos = F.when(onset_ms <= 0, pos_ms.cast("double")).when(late, moved).otherwise(F.lit(0.0))
    trim = F.when((onset_ms > 0) & ~late, F.rint(-moved * sample_rate / 1000)).otherwise(F.lit(0.0))
    return pos, trim.cast("long")


# --- channel energy ---------------------------------------------------------

def voice_band_energy(fft_len: int, hop: int):
    """Arrow function of (samples, sample rate): power between 85 and 3000 Hz over Hann-weighted windows.

    Windows begin every ``hop`` samples; one that ends with the last sample is left out.
    """

    @F.pandas_udf(DoubleType())
    def energy(stretches: pd.Series, rates: pd.Series) -> pd.Series:
        weights = np.hanning(fft_len)
        out = np.zeros(len(stretches))
        for i, (samples, rate) in enumerate(zip(stretches, rates)):
            x = np.asarray(samples, dtype=np.float64)
            if len(x) <= fft_len:
                continue
            windows = np.lib.stride_tricks.sliding_window_view(x[:-1], fft_len)[::hop]
            power = np.abs(np.fft.rfft(windows * weights, axis=1)) ** 2
            bins = np.fft.rfftfreq(fft_len) * rate
            out[i] = power[:, (bins >= VOICE_BAND[0]) & (bins <= VOICE_BAND[1])].sum()
        return pd.Series(out)

    return energy


def channel_energy(
    pieces: DataFrame, keys: Sequence[str], sample_rate: int, fft_len: int = FFT_LEN, hop: int = FFT_HOP
) -> DataFrame:
    """voice-band energy per key (which names the channel too), over decimated pieces.

    The signal is cut into stretches of ``FFT_RUN`` windows, which overlap by what the windows at their
    border share. A stretch is one row, so the work is spread whatever the length of a signal.
    """
    stride = max(1, sample_rate // 16000) if sample_rate > 16000 else 1
    rate = sample_rate // stride
    thin = decimate(pieces.select(*keys, "at", "samples"), F.lit(stride)) if stride > 1 else pieces
    # The sample after a stretch's last window belongs to it: it shows that the window is not the end.
    stretches = cut_windows(thin, keys, (FFT_RUN - 1) * hop + fft_len + 1, FFT_RUN * hop)
    energy = voice_band_energy(fft_len, hop)(F.col("samples"), F.lit(float(rate)))
    return stretches.select(*keys, energy.alias("_e")).groupBy(*keys).agg(F.sum("_e").alias("energy"))


def side_of(left: Column, right: Column, seconds: Column | None = None) -> Column:
    """left, right or both by channel energy; short or silent stretches are both."""
    side = (
        F.when(left + right < 1e-10, "both")
        .when(left > right * SIDE_RATIO, "left")
        .when(right > left * SIDE_RATIO, "right")
        .otherwise("both")
    )
    return side if seconds is None else F.when(seconds < SIDE_MIN_S, "both").otherwise(side)


def slice_intervals(intervals: DataFrame, blocks: DataFrame, block_size: int, key: str = "signal_id") -> DataFrame:
    """Pieces of a signal inside intervals (signal, .., from_frame, to_frame).

    An interval lists its block numbers and joins blocks on (signal, block_no); ``at`` counts from the
    interval's start.
    """
    first = F.floor(F.col("from_frame") / block_size)
    last = F.floor((F.col("to_frame") - 1) / block_size)
    wanted = intervals.filter(F.col("to_frame") > F.col("from_frame")).withColumn(
        "block_no", F.explode(F.sequence(first, last))
    )
    begin = F.col("block_no") * block_size
    s = F.greatest(F.col("from_frame"), begin)
    e = F.least(F.col("to_frame"), begin + F.size("samples"))
    return (
        wanted.join(blocks.select(key, "channel", "block_no", "samples"), [key, "block_no"], "inner")
        .withColumn("_s", s)
        .withColumn("_e", e)
        .filter(F.col("_e") > F.col("_s"))
        .withColumn("samples", part_of("samples", begin, F.col("_s"), F.col("_e")))
        .withColumn("at", F.col("_s") - F.col("from_frame"))
        .drop("_s", "_e", "block_no")
    )


def detect_sides(
    clips: DataFrame, blocks: DataFrame, lengths: DataFrame, sample_rate: int, block_size: int,
    channel_map: dict[str, int] | None = None, fft_len: int = FFT_LEN, hop: int = FFT_HOP,
) -> DataFrame:
    """M5: clips (signal_id, clip_id, start_ms) with ``side`` and ``angle``, from ten seconds of the signal.

    ``lengths`` has (signal_id, n_frames); a signal with one channel counts as both.
    """
    placed = clips.join(lengths.select("signal_id", "n_frames"), "signal_id", "inner")
    begin = F.floor(F.col("start_ms") * sample_rate / 1000)
    timed = placed.withColumn("from_frame", begin).withColumn(
        "to_frame", F.least(begin + SIDE_WINDOW_S * sample_rate, F.col("n_frames"))
    )
    long_enough = timed.filter(
        F.col("to_frame") - F.col("from_frame") >= SIDE_MIN_S * sample_rate
    ).select("signal_id", "clip_id", "from_frame", "to_frame")
    cut = slice_intervals(long_enough, blocks, block_size)
    energy = channel_energy(cut, ["signal_id", "clip_id", "channel"], sample_rate, fft_len, hop)
    e = F.coalesce("energy", F.lit(0.0))
    sides = energy.groupBy("signal_id", "clip_id").agg(
        F.sum(F.when(F.col("channel") == 0, e)).alias("_l"), F.sum(F.when(F.col("channel") == 1, e)).alias("_r")
    ).select(
        "signal_id", "clip_id",
        side_of(F.coalesce("_l", "_r"), F.coalesce("_r", "_l")).alias("side"),
    )
    return (
        clips.join(sides, ["signal_id", "clip_id"], "left")
        .withColumn("side", F.coalesce("side", F.lit("both")))
        .withColumn("angle", sd.angle_of_side(F.col("side"), channel_map))
    )


def pan_histogram(clips: DataFrame, *by: str) -> DataFrame:
    """clips heard left, centre and right."""
    place = sd.pan_position(F.col("angle"))
    return clips.groupBy(*by).agg(
        *[F.count_if(place == p).alias(f"n_{p}") for p in ("left", "center", "right")]
    )


def attach_angles(clips: DataFrame, angles: DataFrame) -> DataFrame:
    """Clips (folder, file_name) with their angle, 180 where none was found."""
    return clips.join(angles.select("folder", "file_name", "angle"), ["folder", "file_name"], "left").withColumn(
        "angle", F.coalesce("angle", F.lit(180))
    )
