"""Plans over generated scenes: what moves, what is kept, and the same values by the shorter way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import change, components, fusion, regions, stats, stencil
from rasterloom.sources import synth

RAW = ("scene_id", "y", "x", "b02", "b03", "b04", "b08", "vv_raw", "vh_raw")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixels_of_generated_scenes_stay_where_they_are_made(spark, sf):
    p = fusion.prepared(synth.scenes(spark, sf).select(*RAW))
    for df in (p, fusion.metrics(fusion.masks(p, fusion.scene_scalars(p)))):
        text = plan(df)
        assert "Broadcast" not in text
        assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") > 0


def test_more_keys_make_more_tasks_and_not_larger_ones(spark, tmp_path):
    spark.range(10 * synth.TASK * spark.sparkContext.defaultParallelism).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    keys = synth.scenes(spark, str(tmp_path)).where("y = 0 AND x = 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert keys < 2 * synth.TASK


def test_prepared_is_its_steps_in_turn(spark, sf):
    raw = synth.scenes(spark, sf).select(*RAW).where("scene_id < 4").withColumn("vh_raw", F.when((F.col("scene_id") > 1) & (F.col("x") % 5 < F.col("y") % 4), F.col("vh_raw")))
    steps = fusion.optical_indices(fusion.decibels(fusion.decibels(fusion.scaled(raw, ["b02", "b03", "b04", "b08"]), "vv_raw", "vv"), "vh_raw", "vh"))
    short = fusion.prepared(raw).select(*steps.columns)
    assert short.exceptAll(steps).isEmpty() and steps.exceptAll(short).isEmpty()


def test_median_sorts_nulls_before_all_values(spark):
    image = np.random.default_rng(3).integers(0, 9, (11, 14)).astype(float)
    rows = [(y, x, None if (y * 7 + x * 3) % 5 < 2 else float(image[y, x])) for y in range(11) for x in range(14)]
    value = {(y, x): v for y, x, v in rows}

    def want(y, x):
        nine = []
        for j in (max(y - 1, 0), y, min(y + 1, 10)):
            own = value[j, x]
            nine += [own if x == 0 or value[j, x - 1] is None else value[j, x - 1], own, own if x == 13 or value[j, x + 1] is None else value[j, x + 1]]
        return sorted(nine, key=lambda v: (v is not None, v or 0.0))[4]

    df = spark.createDataFrame([(0, *r) for r in rows], "scene_id long, y int, x int, v double")
    got = {(r.y, r.x): r.m for r in stencil.median3(df, "v", "m").collect()}
    assert got == {k: want(*k) for k in value}


def test_listed_percentiles_are_those_of_percentile(spark):
    rng = np.random.default_rng(4)
    rows = [(s, None if i % 7 == 3 else float(v)) for s in range(3) for i, v in enumerate(rng.normal(size=40 * s + 1))]
    df = spark.createDataFrame(rows, "scene_id long, v double")
    one, two = (sorted(stats.profile(df, ["v"], listed=k).collect()) for k in (False, True))
    assert one == two


def test_labels_bring_the_pixels_columns_along(spark):
    rng = np.random.default_rng(5)
    rows = [(s, int(y), int(x), float(rng.random())) for s in range(2) for y, x in zip(*np.nonzero(rng.random((70, 9)) > 0.5))]
    df = spark.createDataFrame(rows, "scene_id long, y int, x int, v double")
    found = [sorted(components.labelled(df, k).select("scene_id", "y", "x", "v", "label").collect()) for k in (components.grouped, components.by_size, components.distributed)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_pictures_and_regions_join_without_broadcasts(spark, sf):
    p = fusion.prepared(synth.scenes(spark, sf).select(*RAW))
    s = components.settled(fusion.scene_scalars(p))
    m = fusion.masks(p, s)
    assert "Broadcast" not in plan(fusion.composites(m))
    found = fusion.features(m, s, components.grouped)
    assert "Broadcast" not in plan(found)
    assert "Broadcast" not in plan(regions.collected(s, found, F.struct("rank", "kind")))


def test_changed_regions_join_without_broadcasts(spark, sf):
    pairs = synth.scenes(spark, sf).select("scene_id", "y", "x", *[F.col(c + k).alias(n + i) for k, i in (("", "0"), ("m", "1")) for c, n in (("b04", "r"), ("b03", "g"), ("b02", "b"))])
    pixels, sizes = change.detect(pairs)
    assert "Broadcast" not in plan(sizes)
    assert "Broadcast" not in plan(change.find_regions(pixels, sizes, components.grouped))
