"""Neighbourhood operators. Rows of a scene become arrays, so a pass is one shuffle and no pixel is multiplied."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, floor, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stats import with_scene


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    return [r / sum(raw) for r in raw]


def convolved(lines: pa.ListArray, taps: list[float]) -> np.ndarray:
    """The values of all lines, blurred along each. Borders are half-sample symmetric, however short the line is."""
    size, values = np.diff(lines.offsets.to_numpy()), lines.flatten().to_numpy()
    start, out, radius = np.concatenate([[0], np.cumsum(size)[:-1]]), np.empty(len(values)), len(taps) // 2
    for n in np.unique(size[size > 0]).tolist():  # lines of one length together
        place = start[size == n][:, None] + np.arange(n)
        wide = np.pad(values[place], ((0, 0), (radius, radius)), mode="symmetric")
        out[place] = sum(t * wide[:, d : d + n] for d, t in enumerate(taps))
    return out


def along(pixels: DataFrame, value: str, line: str, place: str, taps: list[float]) -> DataFrame:
    """Blurs the values of each line of a scene in the order of ``place``. A task holds some lines at a time, no scene."""
    rows = pixels.select("scene_id", F.col(line).cast("int").alias(line), F.col(place).cast("int").alias(place), F.col(value).cast("double").alias(value))
    names = rows.columns
    lines = rows.groupBy("scene_id", line).agg(F.sort_array(F.collect_list(F.struct(place, value))).alias("a"))
    lines = lines.select("scene_id", line, F.col(f"a.{place}").alias("p"), F.col(f"a.{value}").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                p, v = part.column(2), part.column(3)
                row = pa.array(np.repeat(np.arange(len(p)), np.diff(p.offsets.to_numpy())))
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), p.flatten(), pa.array(convolved(v, taps))], names)

    return lines.mapInArrow(run, rows.schema)


def gaussian(pixels: DataFrame, value: str, sigma: float = 2.0) -> DataFrame:
    """(scene_id, y, x, value) blurred along rows, then along columns."""
    taps = gaussian_taps(sigma)
    once = along(pixels, value, "y", "x", taps)
    return along(once, value, "x", "y", taps).select("scene_id", "y", "x", value)


def middle(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def neighbours(pixels: DataFrame, medians: dict[str, str], slopes: dict[str, str]) -> DataFrame:
    """Adds 3 x 3 medians and slopes of columns, each named by ``out`` in {value: out}: one pass along rows and one along columns for all.

    At radius 1 symmetric borders repeat the border pixel. A median of nine is the middle one of the largest low, the middle mid
    and the smallest high of three rows; nulls sort before all values. A slope is the size of central differences, zero on borders.
    """
    row, col = Window.partitionBy("scene_id", "y").orderBy("x"), Window.partitionBy("scene_id", "x").orderBy("y")
    c = F.col
    wide = pixels.withColumns({f"_{o}_{k}": f(v).over(row) for v, o in (medians | slopes).items() for k, f in (("a", F.lag), ("b", F.lead))})
    threes = {f"_{o}_x": F.coalesce((c(f"_{o}_b") - c(f"_{o}_a")) / 2.0, F.lit(0.0)) for o in slopes.values()}
    for v, o in medians.items():
        three = [F.coalesce(c(f"_{o}_a"), c(v)), c(v), F.coalesce(c(f"_{o}_b"), c(v))]
        none = sum((t.isNull().cast("int") for t in three[1:]), three[0].isNull().cast("int"))
        least = F.lit(float("-inf")).cast(pixels.schema[v].dataType)
        three = [F.coalesce(t, least) for t in three]
        threes[f"_{o}_t"] = F.struct(F.least(*three).alias("low"), middle(*three).alias("mid"), F.greatest(*three).alias("high"), none.alias("none"))
    wide = wide.withColumns(threes).drop(*[f"_{o}_{k}" for o in (medians | slopes).values() for k in "ab"])
    sides = [f"_{o}_t" for o in medians.values()] + list(slopes)
    wide = wide.withColumns({f"_{k}_{p}": f(p).over(col) for p in sides for k, f in (("u", F.lag), ("d", F.lead))})
    # each step binds its columns: a task's code stays short enough to be compiled
    wide = wide.withColumns({f"_{k}_{p}": F.coalesce(f"_{k}_{p}", p) for p in sides[: len(medians)] for k in "ud"})
    three = lambda o, part: [c(f"{k}_{o}_t" if not k else f"{k}__{o}_t")[part] for k in ("_u", "", "_d")]
    steps, out = {}, {}
    for o in medians.values():
        steps |= {f"_{o}_low": F.greatest(*three(o, "low")), f"_{o}_mid": middle(*three(o, "mid")), f"_{o}_high": F.least(*three(o, "high")), f"_{o}_none": sum(three(o, "none"), F.lit(0))}
        out[o] = F.when(c(f"_{o}_none") <= 4, middle(c(f"_{o}_low"), c(f"_{o}_mid"), c(f"_{o}_high")))
    for v, o in slopes.items():
        steps[f"_{o}_y"] = F.coalesce((c(f"_d_{v}") - c(f"_u_{v}")) / 2.0, F.lit(0.0))
        out[o] = F.sqrt(c(f"_{o}_x") * c(f"_{o}_x") + c(f"_{o}_y") * c(f"_{o}_y"))
    return wide.withColumns(steps).withColumns(out).select(*[n for n in pixels.columns if n not in out], *out)


def median3(pixels: DataFrame, value: str, out: str) -> DataFrame:
    """3 x 3 median; at radius 1 symmetric borders repeat the border pixel. Other columns stay."""
    return neighbours(pixels, {value: out}, {})


def gradient(pixels: DataFrame, value: str, out: str) -> DataFrame:
    """Central differences, zero on borders; magnitude over the scene's largest, unchanged where that is 0."""
    steps = neighbours(pixels, {}, {value: "_g"})
    top = steps.groupBy("scene_id").agg(F.max("_g").alias("_top"))  # joined back, so that no scene is gathered in a task
    return with_scene(steps, top).withColumn(out, of_largest(F.col("_g"), F.col("_top"))).drop("_g", "_top")


def of_largest(size: Column, top: Column) -> Column:
    return F.when(top > 0, F.try_divide(size, top)).otherwise(size)


def lanczos_taps(source: int, target: int, a: int = 3) -> list[tuple[int, int, float]]:
    """(to, from, weight); the support widens by the scale when shrinking."""
    scale = source / target
    wide = max(scale, 1.0)
    out = []
    for to in range(target):
        centre = (to + 0.5) * scale
        low, high = max(0, floor(centre - a * wide + 0.5)), min(source, ceil(centre + a * wide - 0.5) + 1)
        raw = []
        for j in range(low, high):
            u = (j + 0.5 - centre) / wide
            w = 1.0 if u == 0 else a * sin(pi * u) * sin(pi * u / a) / (pi * pi * u * u) if abs(u) < a else 0.0
            raw.append((j, w))
        total = sum(w for _, w in raw)
        out += [(to, j, w / total) for j, w in raw if w]
    return out


def resize(pixels: DataFrame, bands: list[str], height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Separable Lanczos on bands quantised to 8 bits (floor), rounded and clamped after each pass; identity if equal.

    Tap tables have about 6 entries per line of the image: their size is that of one edge, not of the data.
    """
    if (height, width) == (new_height, new_width):
        return pixels.select("scene_id", "y", "x", *bands)
    spark = pixels.sparkSession
    now = pixels.select("scene_id", "y", "x", *[F.floor(F.col(b) * 255.0).cast("double").alias(b) for b in bands])
    for place, other, n, m in (("x", "y", width, new_width), ("y", "x", height, new_height)):
        if n == m:
            continue
        taps = F.broadcast(spark.createDataFrame(lanczos_taps(n, m), f"_to int, {place} int, _w double"))
        level = [F.least(F.greatest(F.floor(F.sum(F.col(b) * F.col("_w")) + 0.5), F.lit(0)), F.lit(255)).cast("double").alias(b) for b in bands]
        now = now.join(taps, place).groupBy("scene_id", other, "_to").agg(*level).withColumnRenamed("_to", place)
    return now.select("scene_id", "y", "x", *[(F.col(b) / 255.0).alias(b) for b in bands])


#: Lobes of the kernel, bits of the weights.
LOBES, WEIGHT_BITS = 3, 22


@lru_cache(maxsize=256)
def fixed_taps(source: int, target: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) of shape (target, taps): Lanczos weights that sum to about one, in units of 2**-WEIGHT_BITS."""
    scale = source / target
    wide = max(scale, 1.0)
    centre = (np.arange(target) + 0.5) * scale
    low = np.maximum((centre - LOBES * wide + 0.5).astype(np.int64), 0)
    high = np.minimum((centre + LOBES * wide + 0.5).astype(np.int64), source)
    place = low[:, None] + np.arange(int((high - low).max()))
    u = (place - centre[:, None] + 0.5) / wide
    raw = np.where((u >= -LOBES) & (u < LOBES) & (place < high[:, None]), np.sinc(u) * np.sinc(u / LOBES), 0.0)
    share = raw / raw.sum(axis=1, keepdims=True) * (1 << WEIGHT_BITS)
    return np.minimum(place, source - 1), np.trunc(share + np.where(share < 0, -0.5, 0.5)).astype(np.int64)


def resized_lines(pixels: DataFrame, bands: list[str], line: str, place: str, source: str, target: str) -> DataFrame:
    """One pass over 8-bit levels: each line from ``source`` to ``target`` pixels, which are columns. Lines are whole in a task, scenes aren't."""
    names = ["scene_id", "h", "w", "out_h", "out_w"]
    lines = pixels.groupBy(*names, line).agg(F.sort_array(F.collect_list(F.struct(place, *bands))).alias("a"))
    lines = lines.select(*names, line, F.col(f"a.{place}").alias("_p"), *[F.col(f"a.{b}").alias(b) for b in bands])
    at, n, m = len(names) + 1, names.index(source), names.index(target)
    schema = StructType([pixels.schema["scene_id"], *StructType.fromDDL(f"h int, w int, out_h int, out_w int, {line} int, {place} int"), *StructType.fromDDL(", ".join(f"`{b}` int" for b in bands))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, out = [], [], [[] for _ in bands]
            sizes = list(zip(batch.column(n).to_pylist(), batch.column(m).to_pylist()))
            for k, (have, want) in enumerate(sizes):
                own = batch.column(at)[k].values.to_numpy()
                taps, weights = fixed_taps(have, want) if have != want else (None, None)
                rows.append(np.full(want, k))
                places.append(np.arange(want, dtype=np.int32))
                for b in range(len(bands)):
                    level = np.zeros(have, np.int64)
                    level[own] = batch.column(at + 1 + b)[k].values.to_numpy()
                    if taps is not None:
                        level = np.clip(((level[taps] * weights).sum(axis=1) + (1 << (WEIGHT_BITS - 1))) >> WEIGHT_BITS, 0, 255)
                    out[b].append(level.astype(np.int32))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(at)], pa.array(np.concatenate(places)), *[pa.array(np.concatenate(o)) for o in out]], [f.name for f in schema])

    return lines.mapInArrow(run, schema)


def resize_scenes(pixels: DataFrame, bands: list[str], sizes: DataFrame, ranged: bool = True) -> DataFrame:
    """Lanczos with a size for every scene; (scene_id, y, x, bands).

    ``sizes``: scene_id, h, w, out_h, out_w; scenes without a row are absent. Bands become 8-bit levels, cut off, of their
    range in the scene (``ranged``), or of 0 to 1; rows are resized, then columns, in whole numbers with fixed-point
    weights, rounded and clamped after each; levels become values again. Scenes of the size that they should have keep their
    values. Missing pixels are level 0, missing values too.
    """
    size = sizes.select("scene_id", *[F.col(c).cast("int").alias(c) for c in ("h", "w", "out_h", "out_w")])
    p = with_scene(pixels.select("scene_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(b).cast("double").alias(b) for b in bands]), size)
    same = (F.col("h") == F.col("out_h")) & (F.col("w") == F.col("out_w"))
    asis, other = p.where(same).select("scene_id", "y", "x", *bands), p.where(~same)
    if ranged:
        ends = other.groupBy("scene_id").agg(*[f(b).alias(f"_{n}_{b}") for b in bands for f, n in ((F.min, "lo"), (F.max, "hi"))])
    else:
        ends = size.select("scene_id", *[F.lit(v).alias(f"_{n}_{b}") for b in bands for v, n in ((0.0, "lo"), (1.0, "hi"))])
    span = lambda b: F.when(F.col(f"_hi_{b}") > F.col(f"_lo_{b}"), F.col(f"_hi_{b}") - F.col(f"_lo_{b}")).otherwise(1.0)
    level = lambda b: F.coalesce(F.floor(F.least(F.greatest((F.col(b) - F.col(f"_lo_{b}")) / span(b), F.lit(0.0)), F.lit(1.0)) * 255.0), F.lit(0)).cast("int").alias(b)
    levels = with_scene(other, ends).select("scene_id", "h", "w", "out_h", "out_w", "y", "x", *[level(b) for b in bands])
    once = resized_lines(levels, bands, "y", "x", "w", "out_w")
    twice = with_scene(resized_lines(once, bands, "x", "y", "h", "out_h"), ends)
    back = twice.select("scene_id", "y", "x", *[(F.col(b) / 255.0 * span(b) + F.col(f"_lo_{b}")).alias(b) for b in bands])
    return asis.unionByName(back)
