"""Rasters from the supplied tables: pixels are rows, bands are columns.

* ``tiles``: each embedding is one 8 x 8 band.
* ``pairs``: six consecutive embeddings are a before and an after RGB scene, or four optical and two radar bands.
* ``scenes``: each supplier is a 64 x 64 optical and radar scene whose pixels follow from (key, y, x).
* ``large``: all orders are one raster of width 500.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.colour import clip

SIDE, TILE, WIDTH = 64, 8, 500
#: Scenes that one task makes.
TASK = 64

#: Fixed values of the generator: noise number, then (low, high) on background, water and urban ground.
BANDS = {
    "b02": (2, (0.07, 0.11), (0.11, 0.14), (0.22, 0.30)),
    "b03": (3, (0.09, 0.14), (0.14, 0.18), (0.23, 0.31)),
    "b04": (4, (0.08, 0.13), (0.03, 0.05), (0.25, 0.33)),
    "b08": (8, (0.25, 0.40), (0.015, 0.03), (0.20, 0.28)),
    "vv_raw": (11, (0.02, 0.08), (0.0005, 0.002), (0.60, 1.80)),
    "vh_raw": (12, (0.003, 0.015), (0.0001, 0.0005), (0.08, 0.25)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, v), v in [0, 1]."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("scene_id"), F.posexplode("embedding"))
    p = F.col("pos")
    return e.select("scene_id", F.floor(p / TILE).cast("int").alias("y"), (p % TILE).cast("int").alias("x"), clip((F.col("col").cast("double") + 0.6) / 1.2).alias("v"))


def six_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, v0..v5) of every complete group of six embeddings. One aggregation, no join."""
    t = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("scene_id"), (F.col("vec_id") % 6).cast("int").alias("k"), "embedding")
    g = t.groupBy("scene_id").agg(*[F.max(F.when(F.col("k") == k, F.col("embedding"))).alias(f"e{k}") for k in range(6)])
    full = g.where(reduce(lambda a, b: a & b, [F.col(f"e{k}").isNotNull() for k in range(6)]))
    z = full.select("scene_id", F.posexplode(F.arrays_zip(*[f"e{k}" for k in range(6)])))
    p = F.col("pos")
    bands = [clip((F.col("col")[f"e{k}"].cast("double") + 0.6) / 1.2).alias(f"v{k}") for k in range(6)]
    return z.select("scene_id", F.floor(p / TILE).cast("int").alias("y"), (p % TILE).cast("int").alias("x"), *bands)


def change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, r0, g0, b0, r1, g1, b1)."""
    names = ("r0", "g0", "b0", "r1", "g1", "b1")
    return six_bands(spark, sf_dir).select("scene_id", "y", "x", *[F.col(f"v{k}").alias(n) for k, n in enumerate(names)])


def noisy_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, b02, b03, b04, b08, vv_raw, vh_raw) from six embeddings; radar bands are linear power."""
    s = six_bands(spark, sf_dir)
    power = [F.pow(F.lit(10.0), (40.0 * F.col(f"v{k}") - off) / 10.0).alias(n) for k, off, n in ((4, 18.0, "vv_raw"), (5, 26.0, "vh_raw"))]
    return s.select("scene_id", "y", "x", *[F.col(f"v{k}").alias(n) for k, n in enumerate(("b02", "b03", "b04", "b08"))], *power)


def block(k: Column, a: int | Column, h: int, w: int) -> Column:
    y0, x0 = (k * 7 + a) % (SIDE - h), (k * 11 + a * 3) % (SIDE - w)
    y, x = F.col("y"), F.col("x")
    return (y >= y0) & (y < y0 + h) & (x >= x0) & (x < x0 + w)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id, y, x, bands of BANDS, b02m..b04m: the optical RGB with the radar's water block)."""
    # one small file gives one task; every key becomes SIDE * SIDE rows, so keys are dealt out before that, so few to a task that it
    # can sort them in memory. Rows of a scene stay together: grouping by it moves nothing
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_id"))
    keys = keys.repartition(max(4 * spark.sparkContext.defaultParallelism, -(-keys.count() // TASK)), "scene_id")
    grid = keys.select("scene_id", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))).alias("i")).select("scene_id", F.floor(F.col("i") / SIDE).cast("int").alias("y"), (F.col("i") % SIDE).cast("int").alias("x"))
    k, x, y = F.col("scene_id"), F.col("x").cast("long"), F.col("y").cast("long")
    shifted = F.when(k % 2 == 0, F.lit(0)).otherwise(F.lit(6)).cast("long")
    wet_o, wet_s = block(k, 0, 20, 24), block(k, shifted, 20, 24)
    town = block(k, 29, 10, 12)

    def value(name: str, wet: Column) -> Column:
        number, ground, water, urban = BANDS[name]
        noise = ((x * 73 + y * 151 + x * y * 37 + k * 31 + number * 17) % 97) / 97.0
        pick = lambda i: F.when(wet, F.lit(water[i])).when(town, F.lit(urban[i])).otherwise(F.lit(ground[i]))
        return pick(0) + (pick(1) - pick(0)) * noise

    optical = [value(n, wet_o).alias(n) for n in ("b02", "b03", "b04", "b08")]
    radar = [value(n, wet_s).alias(n) for n in ("vv_raw", "vh_raw")]
    moved = [value(n, wet_s).alias(n + "m") for n in ("b02", "b03", "b04")]
    return grid.select("scene_id", "y", "x", *optical, *radar, *moved)


def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_id 0, y, x, v) of all orders."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(F.lit(0).cast("long").alias("scene_id"), F.floor(key / WIDTH).cast("int").alias("y"), (key % WIDTH).cast("int").alias("x"), (F.col("o_totalprice") / 500000.0).alias("v"))


def mulberry(seeds: DataFrame, column: str, n: int) -> DataFrame:
    """Seeded random numbers (seed, i, value) of the 32-bit mulberry generator, as expressions on 64-bit integers."""
    low = F.lit(0xFFFFFFFF)

    def times(a: Column, b: Column) -> Column:
        return (F.shiftleft((F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(low)

    rows = seeds.select(F.col(column).cast("long").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    a = (F.col("seed") + (F.col("i").cast("long") + 1) * F.lit(0x6D2B79F5)).bitwiseAND(low)
    rows = rows.withColumn("a", a).withColumn("t", times(F.col("a").bitwiseXOR(F.shiftrightunsigned("a", 15)), F.col("a").bitwiseOR(F.lit(1))))
    t = F.col("t")
    second = (t + times(t.bitwiseXOR(F.shiftrightunsigned("t", 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(low).bitwiseXOR(t)
    rows = rows.withColumn("t", second)
    return rows.select("seed", "i", (t.bitwiseXOR(F.shiftrightunsigned("t", 14)).bitwiseAND(low) / 4294967296.0).alias("value"))
