"""Colour expressions: sRGB to linear, XYZ, LAB, and their distance; luminance and display composites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear RGB to XYZ (D65), reference white, LAB constants.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 0.008856, 903.3


def clip(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def tristimulus(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """XYZ over the reference white of linear channels."""
    return tuple(sum((F.lit(k) * c for k, c in zip(row, (r, g, b))), F.lit(0.0)) / white for row, white in zip(TO_XYZ, WHITE))


def xyz(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    return tristimulus(*map(linear, (r, g, b)))


def lightness(t: Column) -> Column:
    return F.when(t > EPSILON, F.cbrt(t)).otherwise((F.lit(KAPPA) * t + 16.0) / 116.0)


def opponents(fx: Column, fy: Column, fz: Column) -> tuple[Column, Column, Column]:
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """LAB as one expression; ``change.difference`` binds its steps instead."""
    return opponents(*map(lightness, xyz(r, g, b)))


def distance(one: tuple[Column, ...], two: tuple[Column, ...]) -> Column:
    """Euclidean: Delta E 1976 for LAB triples."""
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(one, two)), F.lit(0.0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return clip(0.299 * r + 0.587 * g + 0.114 * b)


def heat(magnitude: Column) -> tuple[Column, Column, Column]:
    """Black over red and yellow to white."""
    m = F.pow(clip(magnitude), F.lit(0.7))
    return clip(3.0 * m), clip(3.0 * m - 1.0), clip(3.0 * m - 2.0)


def overlay(band: Column, highlight: float, magnitude: Column, changed: Column) -> Column:
    alpha = 0.45 * clip(magnitude, 0.3, 1.0)
    return F.when(changed, clip(band * (1.0 - alpha) + F.lit(highlight) * alpha)).otherwise(clip(band))


#: Fixed value: the overlay's colour.
HIGHLIGHT = (1.0, 0.15, 0.55)


def false_nir(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """False colour of 0..255 channels in which vegetation turns red."""
    top = F.lit(255.0)
    return F.least(top, 1.15 * g), F.least(top, 0.45 * r + 0.25 * b), F.least(top, 0.85 * b)


def heat_agreement(lum: Column, water: Column, structure: Column, flooded: Column) -> tuple[Column, Column, Column]:
    """Grey ground; flooded vegetation over structure over water."""
    paint = ((flooded, (0.95, 0.85, 0.10)), (structure, (0.98, 0.20, 0.50)), (water, (0.05, 0.78, 0.98)))
    out = []
    for k in range(3):
        c = F.lit(None).cast("double")
        for mask, colour in reversed(paint):
            c = F.when(mask, F.lit(colour[k])).otherwise(c)
        out.append(F.coalesce(c, 0.25 * lum))
    return tuple(out)
