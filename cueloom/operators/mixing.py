"""Gain, placement, overlay and limiting over signal pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sound as sd
from . import signals as sg


#: Sums a task of :func:`overlay_add` keeps before it hands on what is complete.
HELD_SAMPLES = 4_000_000


def place_pieces(pieces: DataFrame, block_size: int, keys: Sequence[str]) -> DataFrame:
    """Pieces at absolute places cut at block borders: (keys, block_no, offset, samples).

    Needs ``n_frames``, the length of the signal; what lies beyond it is cut and empty overlap drops out.
    """
    end = F.least(F.col("at") + F.size("samples"), F.col("n_frames"))
    cut = pieces.filter(end > F.col("at")).withColumn(
        "block_no",
        F.explode(F.sequence(F.floor(F.col("at") / block_size), F.floor((end - 1) / block_size))),
    )
    begin = F.col("block_no") * block_size
    s = F.greatest(F.col("at"), begin)
    e = F.least(end, begin + block_size)
    return cut.select(
        *keys,
        "block_no",
        (s - begin).cast("int").alias("offset"),
        sg.part_of("samples", F.col("at"), s, e).alias("samples"),
    )


def overlay_add(parts: DataFrame, keys: Sequence[str], held_samples: int = HELD_SAMPLES) -> DataFrame:
    """add parts (keys, offset, samples) that fall on the same block, sample by sample.

    Each task first adds the parts it holds, block by block, so that many parts of one block leave it as
    one; it keeps at most ``held_samples`` sums at a time. Then the parts of a block meet in order of key and
    are added as they are read. No group is gathered, whatever the number of parts.
    """
    keys = list(keys)
    fields = {f.name: f.dataType.simpleString() for f in parts.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", offset int, samples array<double>"

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}

        def table(done: list[tuple]) -> pd.DataFrame:
            rows = [{**dict(zip(keys, k)), "offset": 0, "samples": sums.pop(k)} for k in done]
            return pd.DataFrame(rows, columns=[*keys, "offset", "samples"])

        for pdf in batches:
            key = None
            for *key, offset, samples in zip(*[pdf[k] for k in keys], pdf["offset"], pdf["samples"]):
                key = tuple(key)
                piece = np.asarray(samples, dtype=np.float64)
                need = int(offset) + len(piece)
                have = sums.get(key)
                if have is None:
                    have = np.zeros(need)
                elif len(have) < need:
                    have = np.concatenate([have, np.zeros(need - len(have))])
                have[int(offset):need] += piece
                sums[key] = have
            # The last key may go on in the next batch; in sorted rows all others are complete.
            if len(sums) > 1 and sum(map(len, sums.values())) > held_samples:
                yield table([k for k in sums if k != key])
        if sums:
            yield table(list(sums))

    columns = [*keys, "offset", "samples"]
    partial = parts.select(*columns).mapInPandas(combine, schema)
    grouped = partial.repartition(*keys).sortWithinPartitions(*keys)
    return grouped.mapInPandas(combine, schema).drop("offset")


def limit_blocks(blocks: DataFrame, width: int) -> DataFrame:
    """D13 over blocks: whole-number samples within the width."""
    return blocks.withColumn("samples", F.transform("samples", lambda x: sd.soft_limit(x, width)))


def constant_gain(volume_db: float) -> Column:
    """M1: the same factor everywhere."""
    return sd.db_to_linear(F.lit(float(volume_db)))


def matched_gain(base_db: Column, clip_db: Column, volume_db: float) -> Column:
    """M2: factor that brings a clip to the base level plus ``volume_db``, within 50 dB."""
    return sd.db_to_linear(sd.clamp_gain(base_db + volume_db - clip_db))


def scale_samples(samples: Column, gain: Column) -> Column:
    return F.transform(samples, lambda x: x * gain)


def follow_envelope(
    pieces: DataFrame, env: DataFrame, hop_frames: int, volume_db: float, fallback_db: Column
) -> DataFrame:
    """M3: pieces (signal_id, clip_id, at, samples, clip_db, last_hop) whose gain follows the envelope.

    Pieces are cut at envelope points, so each needs the two points around it: one join on (signal, hop),
    where many clips may lie on one place. ``last_hop`` is the signal's last envelope point.
    A signal without an envelope uses ``fallback_db``, its overall level.
    """
    end = F.col("at") + F.size("samples")
    cut = pieces.withColumn(
        "_hop", F.explode(F.sequence(F.floor(F.col("at") / hop_frames), F.floor((end - 1) / hop_frames)))
    )
    begin = F.col("_hop") * hop_frames
    s, e = F.greatest(F.col("at"), begin), F.least(end, begin + hop_frames)
    cut = cut.withColumns({
        "samples": sg.part_of("samples", F.col("at"), s, e),
        "at": s,
        "hop_no": F.least("_hop", "last_hop"),
    })
    segments = sg.envelope_segments(env, ["signal_id"])
    joined = cut.join(segments, ["signal_id", "hop_no"], "left")
    beyond = F.col("_hop") >= F.col("last_hop")

    def gained(x: Column, i: Column) -> Column:
        frac = (F.col("at") + i) / hop_frames - F.col("_hop")
        level = (
            F.when(F.col("e0").isNull(), fallback_db)
            .when(beyond, F.col("e0"))
            .otherwise(F.col("e0") * (1.0 - frac) + F.col("e1") * frac)
        )
        return x * sd.db_to_linear(sd.clamp_gain(level + volume_db - F.col("clip_db")))

    return joined.withColumn("samples", F.transform("samples", gained)).drop(
        "_hop", "last_hop", "hop_no", "e0", "e1"
    )


def mix(
    base: DataFrame,
    clips: DataFrame,
    clip_blocks: DataFrame,
    sample_rate: int,
    block_size: int,
    width: int = 2,
    clip_width: int | None = None,
    volume_db: float = 0.0,
    auto_volume: str = "fixed",
    align_onset: bool = True,
    content_alignment: bool = False,
    onset_grid: str = "global",
    onset_frame: int = sg.ONSET_FRAME,
    onset_hop: int = sg.ONSET_HOP,
    channels: int | None = None,
) -> DataFrame:
    """M4: mix clips into their base signals: (signal_id, channel, block_no, samples array<int>), stereo.

    ``base`` is (signal_id, channel, block_no, samples), ``clips`` (signal_id, clip_id, seq, start_ms,
    angle), ``clip_blocks`` (clip_id, block_no, samples) of one channel. Order of work: content alignment,
    onset alignment, width, gain, trim, placement, pan, sum, limit. All positions are per clip, all sample
    work is per block. ``channels`` says that every signal has that many; without it the blocks are
    grouped once more to see which have one channel only.
    """
    base = sg.pieces_of(base, block_size)
    mono = sg.mono_pieces(base, "signal_id")
    lengths = base.groupBy("signal_id").agg(F.max(F.col("at") + F.size("samples")).alias("n_frames"))
    pos = clips.withColumn("pos_ms", F.col("start_ms").cast("double"))
    if content_alignment:
        durations = lengths.withColumn("duration_ms", F.floor(F.col("n_frames") * 1000 / sample_rate))
        bounded = sg.neighbour_bounds(clips, durations)
        pos = sg.nearest_onsets(
            bounded, mono, sample_rate, onset_frame, onset_hop, grid=onset_grid
        ).withColumn("pos_ms", F.col("aligned_ms").cast("double"))
    pos = pos.select("signal_id", "clip_id", "angle", "pos_ms").withColumn("trim", F.lit(0).cast("long"))

    clip_pieces = sg.pieces_of(clip_blocks, block_size).select("clip_id", "at", "samples")
    if align_onset:
        onsets = sg.clip_onsets(clip_pieces, sample_rate)
        moved, trim = sg.align_to_onset(F.col("pos_ms"), F.coalesce("onset_ms", F.lit(0.0)), sample_rate)
        pos = pos.join(onsets, "clip_id", "left").withColumns({"pos_ms": moved, "trim": trim}).drop("onset_ms")

    levels = sg.signal_level(clip_pieces, ["clip_id"], clip_width or width)
    # A trim as long as the clip is ignored.
    trim = F.when(F.col("trim") < F.col("_n"), F.col("trim")).otherwise(F.lit(0))
    placed = (
        pos.join(levels.select("clip_id", F.col("rms_db").alias("clip_db"), F.col("n_frames").alias("_n")), "clip_id")
        .withColumn("trim", trim)
        .withColumn("_start", F.rint(F.col("pos_ms") * sample_rate / 1000).cast("long"))
        .drop("_n", "pos_ms")
    )
    placed = placed.join(lengths, "signal_id", "inner")
    if auto_volume != "off":
        base_level = sg.signal_level(base, ["signal_id"], width).select("signal_id", F.col("rms_db").alias("base_db"))
        placed = placed.join(base_level, "signal_id", "inner")

    env = None
    if auto_volume == "auto":
        env = sg.envelope(mono, ["signal_id"], sample_rate, width)
        last = env.groupBy("signal_id").agg(F.max("hop_no").alias("last_hop"))
        placed = placed.join(last, "signal_id", "left")

    pieces = clip_pieces.join(placed, "clip_id")
    if clip_width and clip_width != width:
        pieces = pieces.withColumn("samples", sg.rescale_width(F.col("samples"), clip_width, width))
    # Trim: drop samples before ``trim`` and shift the rest to the front.
    drop_n = F.greatest(F.lit(0), F.col("trim") - F.col("at"))
    left = F.size("samples") - drop_n
    pieces = pieces.filter(left > 0).withColumns({
        "samples": sg.part_of("samples", F.lit(0), drop_n, drop_n + left),
        "at": F.greatest(F.col("at"), F.col("trim")) - F.col("trim") + F.col("_start"),
    })
    if env is not None:
        hop_frames = int(50 * sample_rate / 1000)
        pieces = follow_envelope(pieces, env, hop_frames, volume_db, F.col("base_db"))
    elif auto_volume == "fixed":
        gain = matched_gain(F.col("base_db"), F.col("clip_db"), volume_db)
        pieces = pieces.withColumn("samples", scale_samples(F.col("samples"), gain))
    else:
        pieces = pieces.withColumn("samples", scale_samples(F.col("samples"), constant_gain(volume_db)))

    cut = place_pieces(pieces, block_size, ["signal_id", "angle"])
    sides = F.array(
        F.struct(F.lit(0).alias("channel"), sd.pan_left(F.col("angle")).alias("g")),
        F.struct(F.lit(1).alias("channel"), sd.pan_right(F.col("angle")).alias("g")),
    )
    panned = cut.withColumn("_side", F.explode(sides)).select(
        "signal_id", F.col("_side.channel").alias("channel"), "block_no", "offset",
        scale_samples(F.col("samples"), F.col("_side.g")).alias("samples"),
    )
    ground = stereo_ground(base, channels).select(
        "signal_id", "channel", "block_no", F.lit(0).alias("offset"), F.col("samples").cast("array<double>")
    )
    summed = overlay_add(ground.unionByName(panned), ["signal_id", "channel", "block_no"])
    return limit_blocks(summed, width)


def stereo_ground(base: DataFrame, channels: int | None = None) -> DataFrame:
    """Base blocks as two channels; one channel is copied to the other."""
    if channels == 2:
        return base.select("signal_id", "block_no", "channel", "samples")
    if channels == 1:
        both = F.explode(F.array(F.lit(0), F.lit(1))).alias("channel")
        return base.select("signal_id", "block_no", both, "samples")
    side = [F.max(F.when(F.col("channel") == c, F.col("samples"))).alias(f"_c{c}") for c in (0, 1)]
    pair = F.array(
        F.struct(F.lit(0).alias("channel"), F.coalesce("_c0", "_c1").alias("samples")),
        F.struct(F.lit(1).alias("channel"), F.coalesce("_c1", "_c0").alias("samples")),
    )
    return base.groupBy("signal_id", "block_no").agg(*side).select(
        "signal_id", "block_no", F.inline(pair)
    )
