"""Column functions on levels, pans and samples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K

SILENCE_DB = -100.0
MAX_GAIN_DB = 50.0
LIMIT_FROM = 0.9


def full_scale(width: Column | int) -> Column:
    """``2^(8w-1)`` for a sample of ``w`` bytes."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.pow(F.lit(2.0), w * 8 - 1)


def db_to_linear(db: Column) -> Column:
    """D11."""
    return F.pow(F.lit(10.0), db / 20.0)


def clamp_gain(db: Column) -> Column:
    """Gain kept within 50 dB either way."""
    return F.greatest(F.lit(-MAX_GAIN_DB), F.least(F.lit(MAX_GAIN_DB), db))


def pan_left(angle: Column) -> Column:
    """Constant-power share of the left channel; 0 is left, 180 right."""
    return F.cos(F.radians(angle.cast("double")) / 2)


def pan_right(angle: Column) -> Column:
    return F.sin(F.radians(angle.cast("double")) / 2)


def soft_limit(x: Column, width: Column | int) -> Column:
    """Level above 0.9 is bent by tanh, then clipped and cut to a whole number."""
    top = full_scale(width) - 1
    level = F.abs(x) / top
    room = 1.0 - LIMIT_FROM
    bent = F.when(
        level > LIMIT_FROM, F.lit(LIMIT_FROM) + F.tanh((level - LIMIT_FROM) / room) * room
    ).otherwise(level)
    return F.greatest(-top - 1, F.least(top, F.signum(x) * bent * top)).cast("int")


def angle_of_side(side: Column, channel_map: Mapping[str, int] | None = None) -> Column:
    """Angle for a side, 180 where the map has none."""
    pairs = [F.lit(v) for kv in (channel_map or K.CHANNEL_MAP).items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), side), F.lit(K.DEFAULT_ANGLE))


def pan_position(angle: Column) -> Column:
    """where an angle is heard."""
    return F.when(angle < 45, "left").when(angle > 135, "right").otherwise("center")


def mono(left: Column, right: Column) -> Column:
    """Mean of both channels."""
    return (left + right) / 2.0


def left_of_interleaved(samples: Column) -> Column:
    """Every other sample of an interleaved stereo array."""
    return F.filter(samples, lambda x, i: i % 2 == 0)


def decimation(sample_rate: Column | int) -> Column:
    """Stride that brings a rate above 16 kHz down towards it."""
    rate = F.lit(sample_rate) if isinstance(sample_rate, int) else sample_rate
    return F.when(rate > 16000, F.floor(rate / 16000)).otherwise(F.lit(1)).cast("int")


def rms_db(mean_square: Column, width: Column | int) -> Column:
    """F16: level in dBFS of a mean square; under one step of amplitude it counts as silence."""
    rms = F.sqrt(mean_square)
    return F.when(rms < 1, F.lit(SILENCE_DB)).otherwise(20.0 * F.log10(rms / full_scale(width)))


def envelope_db(mean_square: Column, width: Column | int) -> Column:
    """Level in dBFS with the amplitude floored at one step."""
    return 20.0 * F.log10(F.greatest(F.sqrt(mean_square), F.lit(1.0)) / full_scale(width))
