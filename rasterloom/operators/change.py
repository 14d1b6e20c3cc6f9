"""Bi-temporal change analysis as a relational plan."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour, text
from . import components, regions, stats, stencil, tiles

TAPS = stencil.gaussian_taps(2.0)
HALO = len(TAPS) // 2

#: Lines of a trace around those that tell figures, and those of pictures.
BEGUN = ("Input validation started", "✓ Both images present and non-empty", "Image alignment / dimension matching")
DRAWN = ("Generating change map visualisation", "✓ Change map generated", "Generating change overlay", "✓ Change overlay generated")
INTERPRETED = ("AI interpretation started", "✓ AI interpretation complete (rule-based fallback)", "Pipeline complete")


def joined(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two RGB rasters (scene_id, y, x, r, g, b) side by side: r0..b0 and r1..b1."""
    one = before.select("scene_id", "y", "x", *[F.col(c).alias(c + "0") for c in "rgb"])
    two = after.select("scene_id", "y", "x", *[F.col(c).alias(c + "1") for c in "rgb"])
    return one.join(two, ["scene_id", "y", "x"])


def difference(pairs: DataFrame) -> DataFrame:
    """(scene_id, y, x, delta, top, m): LAB distance, the scene's largest, and their ratio (0 where nothing differs)."""
    place = ("scene_id", "y", "x")
    # each step binds its columns, as one expression for all would repeat its inputs at every level
    lit = pairs.select(*place, *[colour.linear(F.col(c + k)).alias(c + k) for k in "01" for c in "rgb"])
    tri = lit.select(*place, *[t.alias(f"_{n}{k}") for k in "01" for n, t in zip("xyz", colour.tristimulus(*(F.col(c + k) for c in "rgb")))])
    even = tri.select(*place, *[colour.lightness(F.col(f"_{n}{k}")).alias(f"_{n}{k}") for k in "01" for n in "xyz"])
    d = even.select(*place, colour.distance(*(colour.opponents(*(F.col(f"_{n}{k}") for n in "xyz")) for k in "01")).alias("delta"))
    top = d.groupBy("scene_id").agg(F.max("delta").alias("top"))
    return stats.with_scene(d, top).withColumn("m", F.when(F.col("top") > 0, F.try_divide(F.col("delta"), F.col("top"))).otherwise(F.lit(0.0)))


def thresholded(pairs: DataFrame, magnitudes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a detector returns, from the magnitude of every pixel that may have changed; others are unchanged."""
    magnitudes = components.settled(magnitudes)  # read by the histogram and by the pixels
    cut = components.settled(stats.change_threshold(magnitudes, "magnitude").select("scene_id", F.greatest("threshold", F.lit(0.05)).alias("threshold")))
    pixels = stats.with_scene(magnitudes, cut).withColumn("changed", F.col("magnitude") > F.col("threshold"))
    found = pixels.groupBy("scene_id").agg(F.first("threshold").alias("threshold"), F.sum(F.col("changed").cast("int")).alias("n_changed"))
    size = pairs.groupBy("scene_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    scenes = size.join(found.hint("shuffle_hash"), "scene_id", "left").withColumn("n_changed", F.coalesce("n_changed", F.lit(0))).withColumn("fraction", F.col("n_changed") / (F.col("h") * F.col("w")))
    return pixels.drop("threshold"), scenes


def differing(pairs: DataFrame) -> DataFrame:
    """(scene_id, y, x, m) of scenes with any difference: others never reach the blur, and come back with threshold null."""
    return difference(pairs).where("top > 0").select("scene_id", "y", "x", "m")


def detect(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pixels with magnitude and changed, scenes with threshold, changed share and size)."""
    smooth = stencil.gaussian(differing(pairs), "m")
    return thresholded(pairs, smooth.select("scene_id", "y", "x", colour.clip(F.col("m")).alias("magnitude")))


def smoothed(tile: dict[str, np.ndarray]) -> np.ndarray:
    """The blur of ``detect`` for a tile: along rows, then along columns, cut off to 0..1."""
    out = tile["m"]
    for _ in range(2):
        wide = np.pad(out, ((0, 0), (HALO, HALO)), mode="symmetric")
        out = sum(t * wide[:, d : d + out.shape[1]] for d, t in enumerate(TAPS)).T
    return np.clip(out, 0.0, 1.0)


def detect_tiles(pairs: DataFrame, tile: int = tiles.SIDE) -> tuple[DataFrame, DataFrame]:
    """The same as ``detect``, a tile at a time: halos are exchanged once, where ``detect`` shuffles for each direction."""
    return thresholded(pairs, tiles.mapped(differing(pairs), ["m"], smoothed, "magnitude", HALO, tile))


def tiled(score: Callable[[dict[str, np.ndarray]], np.ndarray], halo: int, tile: int = tiles.SIDE) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A detector for ``DETECTORS`` of a function of tiles, such as a trained model.

    ``score`` gets r0..b1 of a tile with ``halo`` pixels around it, as arrays, and gives a magnitude from 0 to 1 of each
    pixel; the threshold is the scene's. It must not look further than ``halo``, or tiles show.
    """
    return lambda pairs: thresholded(pairs, tiles.mapped(pairs, [c + k for k in "01" for c in "rgb"], score, "magnitude", halo, tile))


#: Detectors by name; a detector maps pairs to what ``detect`` returns.
DETECTORS = {"lab": detect, "lab_tiles": detect_tiles}


def find_regions(pixels: DataFrame, scenes: DataFrame, label=components.grouped) -> DataFrame:
    mask = pixels.where("changed").select("scene_id", "y", "x", "magnitude")
    return regions.change_regions(components.labelled(mask, label), scenes.select("scene_id", "h", "w"))


def analyse(pairs: DataFrame, query: str | DataFrame = "", detector: str = "lab", label=components.by_size) -> DataFrame:
    """One row per scene pair: percentage, ranked regions, confidence, evidence, narrative and trace.

    ``query``: of all scenes, or (scene_id, query) of each.
    """
    pixels, scenes = DETECTORS[detector](pairs)
    scenes = components.settled(scenes)
    return told(scenes, find_regions(pixels, scenes, label), query)


def traced(drawn: bool) -> Column:
    """The steps of an analysis with their figures."""
    lines = [
        *map(F.lit, BEGUN), F.concat(F.lit("✓ Images aligned to "), F.col("w").cast("string"), F.lit("×"), F.col("h").cast("string"), F.lit(" px")),
        F.lit("Change detection started (LAB perceptual differencing)"), F.concat(F.lit("✓ Change detection complete: "), F.col("changed_percent").cast("string"), F.lit("% changed")),
        F.lit("Region extraction started (connected component analysis)"), F.concat(F.lit("✓ "), F.size("regions").cast("string"), F.lit(" significant change region(s) extracted")),
    ]
    return F.array(*lines, *map(F.lit, DRAWN if drawn else ()), *map(F.lit, INTERPRETED))


def told(scenes: DataFrame, found: DataFrame, query: str | DataFrame = "", drawn: bool = False) -> DataFrame:
    """The rows of ``analyse`` of what has been detected and found."""
    out = regions.collected(scenes, found, regions.region_struct())
    percent = text.rounded(F.col("fraction") * 100.0, 2)
    mean = F.aggregate("regions", F.lit(0.0), lambda a, r: a + r["confidence"]) / F.size("regions")
    out = out.withColumn("changed_percent", percent).withColumn("overall_confidence", F.when(F.size("regions") == 0, 0.9).otherwise(text.fixed(mean, 3).cast("double")))
    out, q = text.asked(out, query)
    summary = F.concat(F.lit("DETECTED CHANGE\n"), F.col("evidence"), F.lit("\n\nAI INTERPRETATION\n"), F.col("narrative"))
    out = out.withColumn("evidence", text.change_evidence(F.col("regions"), F.col("changed_percent"))).withColumn("narrative", text.change_narrative(F.col("regions"), F.col("changed_percent"), q))
    return out.select("scene_id", "h", "w", "threshold", "changed_percent", "overall_confidence", F.size("regions").alias("n_regions"), "regions", "evidence", "narrative", summary.alias("summary"), traced(drawn).alias("trace"), F.lit(True).alias("simulated"))
