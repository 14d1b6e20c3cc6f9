"""Radar expressions: decibel scaling, adaptive thresholds, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .colour import clip


def decibels(raw: Column, despeckled: Column, low: Column, high: Column) -> Column:
    """Three ways by the scene's raw extremes: decibels already, linear power, or digital numbers."""
    ready = clip(raw, -50.0, 15.0)
    power = clip(10.0 * F.log10(F.greatest(despeckled, F.lit(1e-6))), -50.0, 15.0)
    scaled = clip(10.0 * F.log10(F.greatest(F.try_divide(despeckled, high), F.lit(1e-5))) * (35.0 / 25.0) - 10.0, -50.0, 15.0)
    return F.when((low < -5) & (high < 25), ready).when(high <= 10, power).otherwise(scaled)


def water_threshold(median: Column, p35: Column, std: Column, otsu: Column) -> Column:
    dark = text.rounded(F.least(F.lit(-16.0), F.greatest(F.lit(-38.0), p35 - 0.2 * std)), 2)
    return F.when(median <= -22.0, dark).otherwise(text.rounded(F.least(F.lit(-14.0), F.greatest(F.lit(-26.0), otsu)), 2))


def cross_threshold(p35: Column, std: Column) -> Column:
    return text.rounded(F.least(F.lit(-20.0), F.greatest(F.lit(-45.0), p35 - 0.2 * std)), 2)


def bounce_threshold(median: Column, std: Column) -> Column:
    return text.rounded(F.greatest(F.lit(-8.0), median + 1.5 * std), 2)


def water_mask(vv: Column, t_vv: Column, vh: Column, t_vh: Column) -> Column:
    """Without a cross-polarised band the first condition alone counts."""
    return (vv <= t_vv) & F.coalesce(vh <= t_vh, F.lit(True))


def bounce_mask(vv: Column, threshold: Column) -> Column:
    return vv >= threshold


def volume_mask(vh: Column, median: Column, std: Column) -> Column:
    return vh >= median + 0.5 * std


def display(vv: Column, p2: Column, p98: Column) -> Column:
    span = p98 > p2
    low, high = F.when(span, p2).otherwise(F.lit(-35.0)), F.when(span, p98).otherwise(F.lit(0.0))
    return clip((vv - low) / (high - low))
