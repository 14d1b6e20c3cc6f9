"""Co-registration: extent intersection, the common grid, bilinear resampling and warping onto it, dimension match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as to_arrow
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import projection

#: Side of the buckets that extents are joined by, in map units; an extent joins once per bucket that it touches.
CELL = 100_000.0


def extents(one: DataFrame, two: DataFrame, cell: float = CELL) -> DataFrame:
    """Pairs of overlapping extents with equal crs, and their intersection.

    Inputs have id, crs, left, bottom, right, top. Extents are bucketed on a grid, pairs come from an equi-join on
    buckets, and a pair counts in the bucket that holds its intersection's lower left corner alone.
    """

    def bucketed(df: DataFrame, s: str) -> DataFrame:
        cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        named = df.select(F.col("id").alias("id" + s), "crs", *[F.col(c).alias(c + s) for c in ("left", "bottom", "right", "top")])
        return named.withColumn("_i", cells("left" + s, "right" + s)).withColumn("_j", cells("bottom" + s, "top" + s))

    both = bucketed(one, "1").join(bucketed(two, "2"), ["crs", "_i", "_j"]).where("left1 < right2 AND left2 < right1 AND bottom1 < top2 AND bottom2 < top1")
    both = both.withColumns({"left": F.greatest("left1", "left2"), "bottom": F.greatest("bottom1", "bottom2"), "right": F.least("right1", "right2"), "top": F.least("top1", "top2")})
    own = (F.floor(F.col("left") / cell) == F.col("_i")) & (F.floor(F.col("bottom") / cell) == F.col("_j"))
    return both.where(own).select("id1", "id2", "crs", "left", "bottom", "right", "top")


def grid(pairs: DataFrame, res_x: str = "res_x", res_y: str = "res_y") -> DataFrame:
    """Adds width and height of the common grid, at least 5, ties to even."""
    side = lambda a, b, r: F.greatest(F.lit(5), F.bround((F.col(b) - F.col(a)) / F.col(r)).cast("int"))
    return pairs.withColumn("out_w", side("left", "right", res_x)).withColumn("out_h", side("bottom", "top", res_y))


def resample(pixels: DataFrame, source: DataFrame, target: DataFrame, bands: list[str]) -> DataFrame:
    """Bilinear values at the centres of the target grid, equal crs.

    ``source``: scene_id, left, top, res_x, res_y; ``target``: scene_id, left, top, res_x, res_y, out_w, out_h. A source
    pixel offers itself to the target centres within one source pixel of its own centre; weights are summed per target
    pixel. Target pixels that no source pixel covers are absent, never filled.
    """
    s = source.select("scene_id", *[F.col(c).alias("s_" + c) for c in ("left", "top", "res_x", "res_y")])
    t = target.select("scene_id", *[F.col(c).alias("t_" + c) for c in ("left", "top", "res_x", "res_y")], "out_w", "out_h")
    p = pixels.join(s.join(t, "scene_id"), "scene_id")
    px, py = F.col("s_left") + (F.col("x") + 0.5) * F.col("s_res_x"), F.col("s_top") - (F.col("y") + 0.5) * F.col("s_res_y")
    tx, ty = (px - F.col("t_left")) / F.col("t_res_x") - 0.5, (F.col("t_top") - py) / F.col("t_res_y") - 0.5
    p = p.withColumns({"_tx": tx, "_ty": ty, "_wx": F.col("s_res_x") / F.col("t_res_x"), "_wy": F.col("s_res_y") / F.col("t_res_y")})
    inner = lambda c, w, n: F.sequence(F.greatest(F.ceil(F.col(c) - F.col(w) + 1e-9), F.lit(0)).cast("int"), F.least(F.floor(F.col(c) + F.col(w) - 1e-9), F.col(n) - 1).cast("int"))
    some = lambda c, w, n: F.greatest(F.ceil(F.col(c) - F.col(w) + 1e-9), F.lit(0)) <= F.least(F.floor(F.col(c) + F.col(w) - 1e-9), F.col(n) - 1)
    p = p.where(some("_tx", "_wx", "out_w") & some("_ty", "_wy", "out_h")).withColumn("_x", F.explode(inner("_tx", "_wx", "out_w"))).withColumn("_y", F.explode(inner("_ty", "_wy", "out_h")))
    weight = (1.0 - F.abs(F.col("_x") - F.col("_tx")) / F.col("_wx")) * (1.0 - F.abs(F.col("_y") - F.col("_ty")) / F.col("_wy"))
    p = p.withColumn("_w", weight).where("_w > 0")
    out = p.groupBy("scene_id", F.col("_y").alias("y"), F.col("_x").alias("x")).agg(*[(F.sum(F.col(b) * F.col("_w")) / F.sum("_w")).alias(b) for b in bands], F.sum("_w").alias("coverage"))
    return out


#: Side of the source blocks that target pixels gather from, in source pixels where both grids are as fine.
BLOCK = 64
#: Points along each edge of an extent, corners included, that its image in another system is bounded by.
EDGE_POINTS = 23


def bounds_in(extents_: DataFrame, crs: str = "to_crs") -> DataFrame:
    """(scene_id, left, bottom, right, top): each extent in the system of its column ``crs``, bounded by points along its edges."""
    part = F.col("_i") / (EDGE_POINTS - 1)
    points = extents_.select("scene_id", "crs", crs, "left", "bottom", "right", "top", F.explode(F.sequence(F.lit(0), F.lit(EDGE_POINTS - 1))).alias("_i"))
    at = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * part
    edges = [(at("left", "right"), F.col("bottom")), (at("left", "right"), F.col("top")), (F.col("left"), at("bottom", "top")), (F.col("right"), at("bottom", "top"))]
    points = points.select("scene_id", "crs", crs, F.explode(F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in edges])).alias("p")).select("scene_id", "crs", crs, "p.x", "p.y")
    there = projection.converted(points, "x", "y", F.col("crs"), F.col(crs), "u", "v")
    return there.groupBy("scene_id").agg(F.min("u").alias("left"), F.min("v").alias("bottom"), F.max("u").alias("right"), F.max("v").alias("top"))


def common(one: DataFrame, two: DataFrame) -> DataFrame:
    """The grid that both rasters of a scene share: in the system and at the resolution of the first, over what both cover.

    Inputs: scene_id, crs, left, bottom, right, top, res_x, res_y. Scenes that don't meet, or lack a supported system, are absent.
    """
    a = one.where(projection.supported(F.col("crs"))).select("scene_id", F.col("crs").alias("to_crs"), *[F.col(c).alias("_" + c) for c in ("left", "bottom", "right", "top")], "res_x", "res_y")
    b = two.where(projection.supported(F.col("crs"))).join(a.select("scene_id", "to_crs"), "scene_id")
    both = a.join(bounds_in(b), "scene_id")
    both = both.select("scene_id", F.col("to_crs").alias("crs"), *[f("_" + c, c).alias(c) for f, c in ((F.greatest, "left"), (F.greatest, "bottom"), (F.least, "right"), (F.least, "top"))], F.abs("res_x").alias("res_x"), F.abs("res_y").alias("res_y"))
    return grid(both.where("left < right AND bottom < top"))


def finer(s: Column, s_crs: Column, t: Column, t_crs: Column) -> Column:
    """Target pixels along a source pixel, about; a degree counts as 111,320 map units."""
    units = lambda r, c: F.abs(r) * F.when(projection.geographic(c), 111320.0).otherwise(1.0)
    return units(s, s_crs) / units(t, t_crs)


def warp(pixels: DataFrame, source: DataFrame, target: DataFrame, bands: list[str], block: int = BLOCK) -> DataFrame:
    """(scene_id, y, x, bands, coverage): bilinear values at every pixel of the target grid, whatever both systems are.

    ``source``: scene_id, crs, left, bottom, right, top, res_x, res_y; ``target``: scene_id, crs, left, top, res_x, res_y, out_w,
    out_h. Centres of target pixels are mapped back into the source; each gathers from the four source pixels around it that
    exist, weights summing to one. Pixels outside the source, or with none of the four, are 0 and have coverage 0.

    Target pixels meet the source in blocks of at most ``block`` source pixels a side, smaller where the target is finer, so
    that a group stays of one size; a source pixel goes to one block, and on a block's edge to the next one too.
    """
    s = source.select("scene_id", *[F.col(c).alias("s_" + c) for c in ("crs", "left", "bottom", "right", "top", "res_x", "res_y")])
    t = target.select("scene_id", *[F.col(c).alias("t_" + c) for c in ("crs", "left", "top", "res_x", "res_y")], "out_w", "out_h")
    fine = F.greatest(*[finer(F.col("s_" + r), F.col("s_crs"), F.col("t_" + r), F.col("t_crs")) for r in ("res_x", "res_y")], F.lit(1.0))
    both = s.join(t, "scene_id").withColumn("_b", F.greatest(F.lit(1), F.floor(block / fine)).cast("int"))
    # rows of a grid are dealt out before they become pixels, as one scene may be most of the data
    rows = both.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("out_h") - 1))).repartition("scene_id", "y")
    to = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("out_w") - 1)))
    to = to.withColumns({"_tx": F.col("t_left") + (F.col("x") + 0.5) * F.col("t_res_x"), "_ty": F.col("t_top") - (F.col("y") + 0.5) * F.col("t_res_y")})
    to = projection.converted(to, "_tx", "_ty", F.col("t_crs"), F.col("s_crs"), "_sx", "_sy")
    sx, sy = F.col("_sx"), F.col("_sy")
    inside = F.coalesce((sx >= F.col("s_left")) & (sx < F.col("s_right")) & (sy <= F.col("s_top")) & (sy > F.col("s_bottom")), F.lit(False))
    u, v = (sx - F.col("s_left")) / F.col("s_res_x") - 0.5, (F.col("s_top") - sy) / F.col("s_res_y") - 0.5
    to = to.select("scene_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.when(inside, u).alias("u"), F.when(inside, v).alias("v"), "_b")
    # blocks begin at -1; pixels outside the source form groups below that, which meet nothing
    own = lambda c, at: F.coalesce(F.floor(F.floor(F.col(c)) / F.col("_b")), -2 - F.floor(F.col(at) / block)).cast("int")
    to = to.withColumns({"_j": own("v", "y"), "_i": own("u", "x")})
    p = pixels.select("scene_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(b).cast("double").alias(b) for b in bands]).join(both.select("scene_id", "_b"), "scene_id")
    near = lambda c: F.explode(F.array_distinct(F.array(*[F.floor((F.col(c) - k) / F.col("_b")).cast("int") for k in (0, 1)])))
    p = p.withColumn("_j", near("y")).withColumn("_i", near("x")).select(*[F.col(c).alias(c) for c in ("scene_id", "_j", "_i", "y", "x", *bands)])  # names of their own
    schema = StructType([StructField("scene_id", pixels.schema["scene_id"].dataType), *StructType.fromDDL("y int, x int"), *[StructField(b, DoubleType()) for b in bands], StructField("coverage", DoubleType())])

    def gathered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        n = right.num_rows
        if not n:
            return pa.Table.from_arrays([pa.array([], to_arrow(f.dataType)) for f in schema], [f.name for f in schema])
        y, x, u, v = (right.column(c).to_numpy() for c in ("y", "x", "u", "v"))
        j, i, size = key[1].as_py(), key[2].as_py(), right.column("_b")[0].as_py()
        if j < -1:
            return pa.Table.from_arrays([right.column("scene_id"), pa.array(y), pa.array(x), *[pa.array(np.zeros(n))] * (len(bands) + 1)], [f.name for f in schema])
        y0, x0 = np.floor(v).astype(np.int64), np.floor(u).astype(np.int64)
        place = (left.column("y").to_numpy() - j * size) * (size + 1) + left.column("x").to_numpy() - i * size
        corners = []
        for dy in (0, 1):
            for dx in (0, 1):
                w = np.where(dy, v - y0, 1 - (v - y0)) * np.where(dx, u - x0, 1 - (u - x0))
                corners.append(((y0 + dy - j * size) * (size + 1) + x0 + dx - i * size, w))
        out, cover = [], np.zeros(n)
        for b in bands:
            dense = np.full((size + 1) ** 2, np.nan)
            dense[place] = left.column(b).to_numpy()
            total, weight = np.zeros(n), np.zeros(n)
            for at, w in corners:
                value = dense[at]
                there = ~np.isnan(value)
                total += np.where(there, value * w, 0.0)
                weight += np.where(there, w, 0.0)
            some = weight > 1e-9
            out.append(np.where(some, total / np.where(some, weight, 1.0), 0.0))
            cover = np.maximum(cover, np.where(some, weight, 0.0))
        return pa.Table.from_arrays([right.column("scene_id"), pa.array(y), pa.array(x), *map(pa.array, out), pa.array(cover)], [f.name for f in schema])

    keys = ("scene_id", "_j", "_i")
    return p.groupBy(*keys).cogroup(to.groupBy(*keys)).applyInArrow(gathered, schema)


def matched(one: DataFrame, two: DataFrame) -> DataFrame:
    """Dimension match: scene_id, out_h, out_w, the smaller of both sizes; inputs have scene_id, h, w."""
    a, b = one.select("scene_id", "h", "w"), two.select("scene_id", F.col("h").alias("h2"), F.col("w").alias("w2"))
    return a.join(b, "scene_id").select("scene_id", F.least("h", "h2").alias("out_h"), F.least("w", "w2").alias("out_w"))
