"""Loudness, rate and time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions import vocabulary as V


def gain(lufs: Column, reference: float = V.TARGET_LUFS) -> Column:
    return F.lit(reference) - lufs


def linear_peak(decibel: Column) -> Column:
    return F.pow(F.lit(10.0), decibel / 20.0)


def q78(gain_db: Column) -> Column:
    """Signed 8.8 fixed point, halves to even."""
    return F.bround(gain_db * 256.0, 0).cast("long")


def from_q78(value: Column) -> Column:
    return value / 256.0


def lufs_from_tag(tag: Column, reference: Column) -> Column:
    """Loudness back from a gain tag such as ``-3.21 dB``."""
    return reference - F.regexp_extract(tag, r"([-+]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def loudness_state(lufs: Column) -> Column:
    return F.when(lufs.isNull(), "missing").when(lufs <= V.SILENCE_FLOOR, "silence").otherwise("ok")


def flagged(lufs: Column, peak: Column, target: float = V.TARGET_LUFS, tolerance: float = V.LUFS_TOLERANCE, ceiling: float = V.TARGET_TRUE_PEAK) -> Column:
    return ~lufs.between(target - tolerance, target + tolerance) | F.coalesce(peak > ceiling, F.lit(False))


def flag_reasons(lufs: Column, peak: Column, target: float = V.TARGET_LUFS, tolerance: float = V.LUFS_TOLERANCE, ceiling: float = V.TARGET_TRUE_PEAK) -> Column:
    return F.concat_ws("; ", F.when(lufs < target - tolerance, "too quiet"), F.when(lufs > target + tolerance, "too loud"), F.when(peak > ceiling, "peak too high"))


def hash_timeout(seconds: Column, sample_rate: Column) -> Column:
    return F.greatest(F.lit(120), F.ceil(seconds * F.greatest(F.lit(1.0), sample_rate / 48000.0)) + 30).cast("long")


def loudness_timeout(seconds: Column) -> Column:
    return F.least(F.lit(600.0), F.greatest(F.lit(30.0), seconds * 0.3))


def energy(raw: Column) -> Column:
    return F.least(F.lit(1.0), raw / 500000.0)


def confidence(score: Column) -> Column:
    return F.round(score.cast("double") / 100.0, 4)


def kbps(bitrate: Column) -> Column:
    return F.floor(bitrate / 1000).cast("long")


def utc_seconds(ts: Column) -> Column:
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
