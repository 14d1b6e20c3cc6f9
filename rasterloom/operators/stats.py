"""Scene statistics: exact percentiles, histograms, Otsu thresholds. One aggregation per call, joined back by scene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.colour import clip

PERCENTS = (2, 5, 10, 25, 35, 50, 75, 90, 95, 98)


def profile(pixels: DataFrame, bands: list[str], percents: tuple[int, ...] = PERCENTS, keys: tuple[str, ...] = ("scene_id",), large: bool = False, listed: bool = False, more: tuple[Column, ...] = ()) -> DataFrame:
    """Per scene and band: {band}_mean, _std (population), _min, _max, _p2 ... with linear interpolation.

    ``percentile`` is exact and keeps counts of distinct values per scene; partial aggregation runs before the shuffle. For
    scenes too ``large`` for that, ranks are selected by refinement of buckets, with a state that is independent of their size.
    ``listed``: for bands of which hardly a value repeats; values are sorted as arrays, at a fraction of the time. ``more``: named
    aggregates that come of the same pass.
    """
    if large:
        from . import selection

        few = [F.avg(b).alias(f"{b}_mean") for b in bands] + [F.stddev_pop(b).alias(f"{b}_std") for b in bands] + [f(b).alias(f"{b}_{n}") for b in bands for f, n in ((F.min, "min"), (F.max, "max"))]
        one, two = pixels.groupBy("scene_id").agg(*few, *more), selection.percentiles(pixels, bands, percents)
        both = one.alias("a").join(two.alias("b"), F.expr("a.scene_id <=> b.scene_id"), "left")
        return both.select("a.scene_id", *[c for b in bands for c in (*[f"{b}_{s}" for s in ("mean", "std", "min", "max")], *[f"{b}_p{p}" for p in percents])], *[c for c in one.columns[1 + 4 * len(bands) :]])
    shares = F.array(*[F.lit(p / 100.0) for p in percents])
    aggs = []
    for b in bands:
        aggs += [F.avg(b).alias(f"{b}_mean"), F.stddev_pop(b).alias(f"{b}_std"), F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"), (F.collect_list(F.col(b).cast("double")) if listed else F.percentile(b, shares)).alias(f"{b}_ps")]
    rows = pixels.groupBy(*keys).agg(*aggs, *more)
    if listed:
        rows = rows.withColumns({f"{b}_ps": F.sort_array(f"{b}_ps") for b in bands}).withColumns({f"{b}_ps": F.array(*[at_share(F.col(f"{b}_ps"), p / 100.0) for p in percents]) for b in bands})
    out = [F.col(k) for k in keys]
    for b in bands:
        out += [F.col(f"{b}_{s}") for s in ("mean", "std", "min", "max")] + [F.col(f"{b}_ps")[i].alias(f"{b}_p{p}") for i, p in enumerate(percents)]
    return rows.select(*out, *rows.columns[len(keys) + len(aggs) :])


def at_share(ordered: Column, part: float) -> Column:
    """What ``percentile`` gives of an ordered array."""
    at = F.lit(part) * (F.size(ordered) - 1)
    low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
    return F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def histogram(pixels: DataFrame, value: str, low: float, high: float, bins: int, clamp: bool = False) -> DataFrame:
    """(scene_id, bin from 0, n); the last bin holds its right edge. Values outside count only if clamped."""
    v = clip(F.col(value), low, high) if clamp else F.col(value)
    # all clamped values are inside, and a filter on them would be moved below the steps that make them, as one expression of all
    inside = pixels if clamp else pixels.where(v.between(low, high))
    number = F.least(F.floor((v - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return inside.groupBy("scene_id", number.alias("bin")).agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, low: float, high: float, bins: int, edge: bool = False, otherwise: float = 0.5) -> DataFrame:
    """(scene_id, threshold): the first bin that separates best. ``edge``: its left edge, else its centre."""
    step = (high - low) / bins
    upto = Window.partitionBy("scene_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("scene_id")
    centre = low + (F.col("bin") + 0.5) * step
    h = hist.withColumn("c", centre).withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(F.col("n") * F.col("c")).over(upto))
    h = h.withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col("n") * F.col("c")).over(all_))
    w1 = F.col("w") - F.col("w0")
    gap = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("s") - F.col("s0"), w1)
    share = F.col("w0") * 1.0 / F.col("w")
    valid = (share > 1e-6) & (1.0 - share > 1e-6) if edge else w1 > 0
    h = h.withColumn("between", F.when(valid, F.round(share * (w1 * 1.0 / F.col("w")) * gap * gap, 12)))
    best = h.groupBy("scene_id").agg(F.max_by("bin", F.struct("between", -F.col("bin"))).alias("bin"), F.max("between").alias("top"))
    place = low + F.col("bin") * step if edge else low + (F.col("bin") + 0.5) * step
    return best.select("scene_id", F.when(F.col("top") > 0, place).otherwise(F.lit(low if edge else otherwise)).alias("threshold"))


def change_threshold(pixels: DataFrame, value: str) -> DataFrame:
    return otsu(histogram(pixels, value, 0.0, 1.0, 256), 0.0, 1.0, 256)


def radar_threshold(pixels: DataFrame, value: str) -> DataFrame:
    return otsu(histogram(pixels, value, -35.0, -5.0, 128, clamp=True), -35.0, -5.0, 128, edge=True)


def share(mask: Column, digits: int, scale: float = 100.0) -> Column:
    part = F.avg(F.coalesce(mask, F.lit(False)).cast("int")) * scale
    return text.rounded(part, digits) if digits <= 4 else F.round(part, digits)


def with_scene(pixels: DataFrame, stats: DataFrame) -> DataFrame:
    """Scene scalars back to pixels. The scalars are what a task holds of the join.

    Spark takes rows that are made by ``explode`` for as few as those that they come from, and would broadcast the pixels. Pixels that
    are dealt out by scene stay where they are.
    """
    return pixels.join(stats.hint("shuffle_hash"), "scene_id")


def pooled(bands: list[str]) -> Column:
    """The aggregate of ``pooled_std``."""
    n = F.count("*") * len(bands)
    total, squares = sum((F.sum(b) for b in bands), F.lit(0.0)), sum((F.sum(F.col(b) * F.col(b)) for b in bands), F.lit(0.0))
    return F.sqrt(F.greatest(squares / n - (total / n) * (total / n), F.lit(0.0)))


def pooled_std(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """(scene_id, rgb_std): population deviation over the samples of all bands together, without unpivoting them."""
    return pixels.groupBy("scene_id").agg(pooled(bands).alias("rgb_std"))
