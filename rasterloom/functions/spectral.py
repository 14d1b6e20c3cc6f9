"""Optical expressions: reflectance scaling, indices, water and vegetation masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .colour import clip

EPS = 1e-6


def reflectance(v: Column, top: Column) -> Column:
    """Digital numbers by the band's own maximum in the scene."""
    return F.when(top > 255, clip(v / 10000.0)).when(top > 1, clip(v / 255.0)).otherwise(clip(v))


def ratio(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def ndwi(b03: Column, b08: Column) -> Column:
    return ratio(b03, b08)


def ndvi(b04: Column, b08: Column) -> Column:
    return ratio(b08, b04)


def water_proxy(b02: Column, b03: Column, b04: Column) -> Column:
    return ratio(b02 + b03, 2.0 * b04)


def vegetation_proxy(b02: Column, b03: Column, b04: Column) -> Column:
    return (2.0 * b03 - b04 - b02) / (2.0 * b03 + b04 + b02 + EPS)


def water_threshold(median_ndwi: Column) -> Column:
    return text.rounded(clip(median_ndwi + 0.05, 0.05, 0.30), 3)


def water_mask(index: Column, threshold: Column, b03: Column, b04: Column, b08: Column) -> Column:
    return (index >= threshold) & (b08 <= 0.28) & (b03 >= 0.70 * b04)


def vegetation_mask(index: Column, b08: Column) -> Column:
    return (index >= 0.30) & (b08 >= 0.20)


def water_mask_rgb(proxy: Column, lum: Column) -> Column:
    return (proxy >= 0.15) & (lum <= 0.35)


def vegetation_mask_rgb(proxy: Column, b03: Column, b04: Column) -> Column:
    return (proxy >= 0.20) & (b03 >= b04)


def stretch(v: Column, low: Column, high: Column, otherwise: Column) -> Column:
    """To [0, 1] between two percentiles; ``otherwise`` where they coincide."""
    return F.when(high > low, clip(F.try_divide(v - low, high - low))).otherwise(otherwise)


def grey(r: Column, g: Column, b: Column) -> Column:
    """BT.601 grey of channels, on their own scale."""
    return 0.299 * r + 0.587 * g + 0.114 * b
