"""Operators against NumPy and against values worked out by hand."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.operators import change, components, fusion, router, stats, stencil, tiles
from rasterloom.sources import geotiff, images, png, synth


def frame(spark, image, name="v", scene=0):
    h, w = image.shape
    return spark.createDataFrame([(scene, y, x, float(image[y, x])) for y in range(h) for x in range(w)], f"scene_id long, y int, x int, {name} double")


def back(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r[name]
    return out


def flood(mask):
    label, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask)):
        if label[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        label[y, x] = n
        while stack:
            a, b = stack.pop()
            for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= c < mask.shape[0] and 0 <= d < mask.shape[1] and mask[c, d] and not label[c, d]:
                    label[c, d] = n
                    stack.append((c, d))
    return label


@pytest.mark.parametrize("shape", [(9, 13), (1, 7), (3, 2)])
def test_gaussian_is_the_matrix_form(spark, shape):
    image = np.random.default_rng(1).random(shape)
    taps = stencil.gaussian_taps(2.0)

    def matrix(n):
        m = np.zeros((n, n))
        for i in range(n):
            for d, t in zip(range(-8, 9), taps):
                j = (i + d) % (2 * n)
                m[i, j if j < n else 2 * n - 1 - j] += t
        return m

    want = matrix(shape[0]) @ image @ matrix(shape[1]).T
    assert np.allclose(back(stencil.gaussian(frame(spark, image), "v"), "v", shape), want)


def test_median_and_gradient(spark):
    image = np.random.default_rng(2).random((6, 7))
    padded = np.pad(image, 1, mode="edge")
    want = np.median([padded[i : i + 6, j : j + 7] for i in range(3) for j in range(3)], axis=0)
    assert np.allclose(back(stencil.median3(frame(spark, image), "v", "m"), "m", image.shape), want)
    gy, gx = np.zeros_like(image), np.zeros_like(image)
    gy[1:-1], gx[:, 1:-1] = (image[2:] - image[:-2]) / 2, (image[:, 2:] - image[:, :-2]) / 2
    g = np.hypot(gx, gy)
    assert np.allclose(back(stencil.gradient(frame(spark, image), "v", "g"), "g", image.shape), g / g.max())


@pytest.mark.parametrize("label", [components.grouped, components.distributed])
def test_components_equal_a_flood_fill(spark, label):
    mask = np.random.default_rng(3).random((12, 15)) > 0.45
    rows = [(0, int(y), int(x)) for y, x in zip(*np.nonzero(mask))]
    got = label(spark.createDataFrame(rows, "scene_id long, y int, x int")).collect()
    want = flood(mask)
    assert len(got) == len(rows) and all(want[r.y, r.x] == r.label for r in got)


def test_diagonal_contact_does_not_join(spark):
    got = components.grouped(spark.createDataFrame([(0, 0, 0), (0, 1, 1)], "scene_id long, y int, x int"))
    assert sorted(r.label for r in got.collect()) == [1, 2]


def test_empty_mask(spark):
    empty = spark.createDataFrame([], "scene_id long, y int, x int")
    assert components.grouped(empty).count() == 0 and components.distributed(empty).count() == 0


def test_otsu_of_a_constant_scene_is_the_default(spark):
    assert stats.change_threshold(frame(spark, np.full((4, 4), 0.3)), "v").first().threshold == 0.5


def test_resize_keeps_equal_sizes_and_constants(spark):
    flat = frame(spark, np.full((8, 8), 0.5))
    assert stencil.resize(flat, ["v"], 8, 8, 8, 8).count() == 64
    small = stencil.resize(flat, ["v"], 8, 8, 5, 6).collect()
    assert len(small) == 30 and {r.v for r in small} == {127 / 255}


def uniform_pair(spark, one, two, n=20):
    rows = [(0, y, x, *(c / 255 for c in one), *(c / 255 for c in two)) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "scene_id long, y int, x int, r0 double, g0 double, b0 double, r1 double, g1 double, b1 double")


def test_uniform_change_is_total(spark):
    r = change.analyse(uniform_pair(spark, (50, 100, 50), (150, 60, 40))).first()
    assert (r.threshold, r.changed_percent, r.n_regions) == (0.5, 100.0, 1)
    assert r.regions[0].confidence == 1.0 and r.regions[0].location == "center of the scene"


def test_identical_pair_has_no_change(spark):
    r = change.analyse(uniform_pair(spark, (9, 9, 9), (9, 9, 9))).first()
    assert (r.changed_percent, r.n_regions, r.overall_confidence) == (0.0, 0, 0.9)


def test_even_scenes_do_not_change_and_odd_ones_do(spark, sf):
    from rasterloom import plans

    rows = {r.scene_id: r for r in plans.queries()["change_pipeline"](spark, sf).collect()}
    assert all((rows[k].n_regions == 0) == (k % 2 == 0) for k in rows)


#: scene: (t_ndwi, t_vv, t_vh, t_db, iou, areas by kind)
GOLDEN = {
    1: (0.05, -26.0, -22.36, -4.64, 8.5, {1: [83], 2: [20], 3: [393]}),
    2: (0.05, -26.0, -22.42, -4.60, 81.1, {1: [476]}),
    3: (0.05, -26.0, -22.19, -4.52, 2.6, {1: [27], 3: [449]}),
    4: (0.05, -26.0, -22.27, -4.48, 81.8, {1: [476], 2: [22]}),
    7: (0.05, -26.0, -22.23, -4.71, 6.0, {1: [27, 33], 3: [415]}),
}


def test_fusion_scenes_have_the_known_masks_and_regions(spark, sf):
    p = fusion.prepared(synth.scenes(spark, sf).where(F.col("scene_id").isin(*GOLDEN)).select("scene_id", "y", "x", "b02", "b03", "b04", "b08", "vv_raw", "vh_raw"))
    p = components.settled(p)
    s = components.settled(fusion.scene_scalars(p))
    m = components.settled(fusion.masks(p, s))
    t = {r.scene_id: r for r in s.collect()}
    iou = {r.scene_id: r.iou_pct for r in fusion.metrics(m).collect()}
    areas: dict = {}
    for r in fusion.features(m, s).collect():
        areas.setdefault(r.scene_id, {}).setdefault(r.kind, []).append(r.area)
    for k, (ndwi, vv, vh, db, overlap, regions) in GOLDEN.items():
        if k in t:
            assert (t[k].t_ndwi, t[k].t_vv, t[k].t_vh, t[k].t_db) == (ndwi, vv, vh, db)
            assert abs(iou[k] - overlap) < 0.06
            assert {a: sorted(b) for a, b in areas[k].items()} == regions


def test_geotiff_round_trip(spark, tmp_path):
    spark.dataSource.register(geotiff.GeoTiffSource)
    bands = (np.random.default_rng(4).random((5, 7, 4)) * 3000).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(bands, 250000.0, 3050000.0, 10.0, 32642))
    (tmp_path / "b.tif").write_bytes(b"not an image")
    geo_rows = {r.scene_id[-5:]: r for r in spark.read.format("rasterloom_geotiff").option("what", "geo").load(str(tmp_path)).collect()}
    a = geo_rows["a.tif"]
    assert (a.crs, a.left, a.top, a.right, a.bottom, a.bands) == ("EPSG:32642", 250000.0, 3050000.0, 250070.0, 3049950.0, 4)
    assert geo_rows["b.tif"].crs is None
    px = spark.read.format("rasterloom_geotiff").load(str(tmp_path / "a.tif")).collect()
    assert len(px) == 35 and all(bands[r.y, r.x, 1] == r.v2 for r in px)


def test_png_round_trip(spark):
    import base64

    image = np.random.default_rng(5).random((6, 4, 3))
    rows = [(1, y, x, *map(float, image[y, x])) for y in range(6) for x in range(4)]
    df = spark.createDataFrame(rows, "scene_id long, y int, x int, r double, g double, b double")
    data = base64.b64decode(png.pictures(df, ["r", "g", "b"]).first().png)
    assert (png.decode(data) == np.floor(image * 255)).all()


def test_image_source_reads_what_was_written(spark, tmp_path):
    from rasterloom.sources import images

    image = np.arange(36, dtype=np.uint8).reshape(3, 4, 3)
    (tmp_path / "x.png").write_bytes(png.encode(image))
    rows = images.rgb(spark, str(tmp_path)).collect()
    assert len(rows) == 12
    assert all(np.allclose([r.r * 255, r.g * 255, r.b * 255], image[r.y, r.x]) for r in rows)


def test_router_validates_and_takes_pipeline_results(spark):
    q = spark.createDataFrame([(1, "what changed?", 1, ["image/png"]), (2, "what changed?", 2, ["image/png"] * 2), (3, "describe", 1, ["text/html"]), (4, "hello", 1, ["image/png"])], "request_id int, query string, n_images int, content_types array<string>")
    done = spark.createDataFrame([(2, "a lot", 87, ["step"])], "request_id int, answer string, confidence int, trace array<string>")
    rows = {r.request_id: r for r in router.answered(q, {"change": done}).collect()}
    assert rows[1].task == rows[3].task == "Validation Error"
    assert (rows[2].answer, rows[2].confidence) == ("a lot", 87) and rows[2].trace[-1] == "step"
    assert rows[4].confidence == 60


def test_formats(spark):
    r = spark.range(1).select(geo.dms(F.lit(-12.5), "lat").alias("a"), geo.decimal_degrees(F.lit(70.25), "lon").alias("b")).first()
    assert (r.a, r.b) == ("12° 30′ 0.0″ S", "70.2500° E")


def test_question_files(spark, tmp_path):
    from rasterloom.operators import qa
    from rasterloom.sources import records

    (tmp_path / "q.json").write_text('{"questions": [{"id": 1, "img_id": "7", "question": "a?"}, {"id": 2, "img_id": "8", "question": "b?"}]}')
    (tmp_path / "a.json").write_text('{"answers": [{"question_id": 1, "answer": "no"}, {"question_id": 1, "answer": "yes"}]}')
    both = qa.pairs(records.questions(spark, str(tmp_path / "q.json")), records.answers(spark, str(tmp_path / "a.json")))
    files = spark.createDataFrame([("7.png",), ("7.jpg",)], "name string")
    out = qa.with_files(both, files, "/d")
    records.write_lines(out, str(tmp_path / "out"))
    assert [tuple(r) for r in records.read_lines(spark, str(tmp_path / "out")).collect()] == [("/d/7.png", "a?", "yes")]


def test_stream_of_scenes(spark, sf, tmp_path):
    from rasterloom.streaming import analyse_stream

    t = synth.tiles(spark, sf).where("scene_id < 3")
    t.write.parquet(str(tmp_path / "in"))
    analyse = lambda df: stats.change_threshold(df, "v")
    analyse_stream(spark, str(tmp_path / "in"), "scene_id long, y int, x int, v double", analyse, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_scenes_may_be_named_by_text_and_span_batches(spark):
    rng = np.random.default_rng(5)
    masks = {f"s{k}" if k else None: rng.random((7, 9)) > 0.5 for k in range(12)}
    rows = [(name, y, x) for name, m in masks.items() for y, x in zip(*map(np.ndarray.tolist, np.nonzero(m)))]
    df = spark.createDataFrame(rows, "scene_id string, y int, x int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        assert components.STRIDE > 2**31 - 1
        for n in ("10000", "5"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got: dict = {}
            for r in components.grouped(df).collect():
                got.setdefault(r.scene_id, np.zeros((7, 9), int))[r.y, r.x] = r.label
            assert all((got[k] == flood(m)).all() for k, m in masks.items())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    shown = df.selectExpr("scene_id", "y", "x", "0.5 AS r", "0.5 AS g", "1.0 AS b")
    assert {r.scene_id for r in png.pictures(shown, ["r", "g", "b"]).collect()} == set(masks)


def test_servers_refuse_types_that_are_not_theirs(spark):
    df = spark.createDataFrame([(1, "what is here?", 1, ["image/tiff"]), (2, "what is here?", 1, ["image/geotiff"]), (3, "what is here?", 1, ["IMAGE/PNG"])], "request_id long, query string, n_images int, content_types array<string>")
    assert [r.error is None for r in router.classified(df).orderBy("request_id").collect()] == [True, False, False]


@pytest.mark.parametrize("rows", [1, 3, 64])
def test_blocks_of_rows_join_across_borders(spark, rows, monkeypatch):
    monkeypatch.setattr(components, "ROWS", rows)
    masks = [np.random.default_rng(k).random((11, 8)) > 0.4 for k in range(3)]
    data = [(k, y, x) for k, m in enumerate(masks) for y, x in zip(*map(np.ndarray.tolist, np.nonzero(m)))]
    got = np.zeros((3, 11, 8), int)
    for r in components.distributed(spark.createDataFrame(data, "scene_id long, y int, x int")).collect():
        got[r.scene_id, r.y, r.x] = r.label
    assert all((g == flood(m)).all() for g, m in zip(got, masks))


def test_optical_and_radar_meet_on_the_common_grid(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((8, 8)), rng.random((8, 8))
    geo = "scene_id string, crs string, left double, bottom double, right double, top double, res_x double, res_y double"
    one = spark.createDataFrame([("s", "EPSG:32643", 0.0, 0.0, 80.0, 80.0, 10.0, 10.0)], geo)
    two = spark.createDataFrame([("s", "EPSG:32643", 20.0, 0.0, 100.0, 80.0, 10.0, 10.0)], geo)
    got = fusion.aligned(frame(spark, a, "b04").withColumn("scene_id", F.lit("s")), frame(spark, b, "vv_raw").withColumn("scene_id", F.lit("s")), one, two, ["b04"], ["vv_raw"])
    assert np.allclose(back(got, "b04", (8, 6)), a[:, 2:]) and np.allclose(back(got, "vv_raw", (8, 6)), b[:, :6])
    apart = two.withColumns({"left": F.lit(500.0), "right": F.lit(580.0)})
    assert fusion.aligned(frame(spark, a, "b04").withColumn("scene_id", F.lit("s")), frame(spark, b, "vv_raw").withColumn("scene_id", F.lit("s")), one, apart, ["b04"], ["vv_raw"]).count() == 0


def test_radar_bands_methods_and_empty_payloads(spark):
    df = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.5, 0.1), (3, 0.5, 0.1)], "n int, v1 double, v2 double")
    assert [tuple(r) for r in df.select(*images.radar_bands(*map(F.col, ("n", "v1", "v2")))).collect()] == [(0.5, None), (0.5, 0.1), (0.5, 0.1)]
    files = spark.createDataFrame([(b"x",), (b"",), (None,)], "content binary")
    assert [(r.status, r.error is None) for r in images.checked(files).collect()] == [(200, True), (400, False), (400, False)]
    p = fusion.prepared(synth.scenes(spark, "/root/testdata/sf0.001").where("scene_id = 1").select("scene_id", "y", "x", "b02", "b03", "b04", "b08", "vv_raw", "vh_raw"))
    p = components.settled(p)
    m = components.settled(fusion.masks(p, components.settled(fusion.scene_scalars(p))))
    rows = lambda name: [tuple(r) for r in fusion.fused_picture(m, name).orderBy("y", "x").limit(50).collect()]
    assert rows("composite") == rows("anything") != rows("ihs")


def test_decimals_of_texts_are_those_of_the_exact_value(spark):
    import random

    from pyspark.sql import functions as F

    from rasterloom.functions import text

    draw = random.Random(5)
    some = [round(draw.uniform(-60, 120), draw.choice((1, 2, 3, 4))) for _ in range(3000)] + [n / 64 for n in range(-64, 640)] + [0.0, -0.04, 12.35, 6.25, 1e-9, 999999.9999, 0.5, 1.5, 2.5]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(some)], "i int, v double").select("i", *[text.fixed(F.col("v"), n).alias(f"d{n}") for n in range(5)], text.worded("%d: %+.3f%%, %s", F.col("i"), F.col("v"), F.lit("x")).alias("w"))
    for r in rows.collect():
        v = some[r["i"]]
        assert [r[f"d{n}"] for n in range(5)] == [f"{v:.{n}f}" for n in range(5)]
        assert r["w"] == f"{r['i']}: {v:+.3f}%, x"
    empty = spark.createDataFrame([(None,)], "v double").select(text.fixed(F.col("v"), 2).alias("t")).first()["t"]
    assert empty is None


def geo_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "scene_id long, crs string, left double, bottom double, right double, top double, res_x double, res_y double")


def test_projection_of_known_points_and_back(spark):
    from rasterloom.functions import projection

    # metres of the meridian from the equator to 45 degrees are known to the millimetre; on it the easting is the false one
    rows = [(3.0, 45.0, "EPSG:32631"), (3.0, 0.0, "EPSG:32631"), (2.2945, 48.8582, "EPSG:32631"), (-70.5, -33.4, "EPSG:32719"), (100.0, 13.75, "EPSG:3857"), (72.6, 23.0, "EPSG:32643"), (1.0, 1.0, "EPSG:2154"), (1.0, 1.0, None)]
    d = spark.createDataFrame(rows, "lon double, lat double, crs string")
    there = projection.from_degrees(d, "lon", "lat", F.col("crs"), "x", "y")
    back = projection.to_degrees(there, "x", "y", F.col("crs"), "lon2", "lat2").collect()
    assert abs(back[0].x - 500000) < 1e-6 and abs(back[0].y - 0.9996 * 4984944.378) < 1e-3
    assert abs(back[1].x - 500000) < 1e-6 and abs(back[1].y) < 1e-6
    assert abs(back[2].x - 448251.8) < 0.1 and abs(back[2].y - 5411932.7) < 0.1
    assert back[3].y > 6_000_000 and abs(back[4].x - 11131949.08) < 0.01
    for r in back[:6]:
        assert abs(r.lon2 - r.lon) < 1e-11 and abs(r.lat2 - r.lat) < 1e-11
    assert all(r.x is None and r.lon2 is None for r in back[6:])


def test_projection_is_conformal(spark):
    from rasterloom.functions import projection

    h = 1e-4
    rows = [(lon + dx * h, lat + dy * h, lon, lat, dx, dy) for lon, lat in ((4.5, 10.0), (0.3, 70.0), (6.0, -50.0)) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    d = spark.createDataFrame(rows, "lon double, lat double, a double, b double, dx int, dy int")
    got = {(r.a, r.b, r.dx, r.dy): np.array([r.x, r.y]) for r in projection.from_degrees(d, "lon", "lat", F.lit("EPSG:32631"), "x", "y").collect()}
    for a, b in {k[:2] for k in got}:
        east, north = got[a, b, 1, 0] - got[a, b, -1, 0], got[a, b, 0, 1] - got[a, b, 0, -1]
        e2, phi = 2 / 298.257223563 - 298.257223563**-2, np.radians(b)
        # a degree of longitude and of latitude on the ellipsoid keep their ratio and their right angle
        ratio = (1 - e2) / (1 - e2 * np.sin(phi) ** 2) / np.cos(phi)
        assert abs(east @ north) / (np.linalg.norm(east) * np.linalg.norm(north)) < 1e-7
        assert abs(np.linalg.norm(north) / np.linalg.norm(east) - ratio) < 1e-6


@pytest.mark.parametrize("block", [64, 3, 1])
def test_warp_equals_bilinear_of_every_target_pixel(spark, block):
    from rasterloom.operators import align

    image = np.random.default_rng(5).random((7, 9))
    source = geo_frame(spark, (0, "EPSG:32643", 500.0, 930.0, 590.0, 1000.0, 10.0, 10.0))
    target = spark.createDataFrame([(0, "EPSG:32643", 493.0, 1004.0, 4.0, 5.0, 27, 16)], "scene_id long, crs string, left double, top double, res_x double, res_y double, out_w int, out_h int")
    pixels = frame(spark, image).where("NOT (y = 3 AND x IN (4, 5))")
    got = {(r.y, r.x): (r.v, r.coverage) for r in align.warp(pixels, source, target, ["v"], block=block).collect()}
    assert len(got) == 27 * 16
    for y in range(16):
        for x in range(27):
            mx, my = 493 + 4 * (x + 0.5), 1004 - 5 * (y + 0.5)
            u, v = (mx - 500) / 10 - 0.5, (1000 - my) / 10 - 0.5
            w = {(j, i): (1 - abs(i - u)) * (1 - abs(j - v)) for j in range(7) for i in range(9) if abs(i - u) < 1 and abs(j - v) < 1 and not (j == 3 and i in (4, 5))}
            inside = 500 <= mx < 590 and 930 < my <= 1000 and sum(w.values()) > 1e-9
            want = (sum(image[k] * f for k, f in w.items()) / sum(w.values()), sum(w.values())) if inside else (0.0, 0.0)
            assert np.allclose(got[y, x], want), (y, x)


def test_scenes_in_two_systems_share_the_optical_grid(spark):
    from rasterloom.functions import projection

    # the radar scene is a plane over longitude and latitude, so its warped values are known wherever the grid lies
    one = geo_frame(spark, (1, "EPSG:32643", 600000.0, 2199200.0, 600800.0, 2200000.0, 100.0, 100.0), (2, "EPSG:32643", 600000.0, 2199200.0, 600800.0, 2200000.0, 100.0, 100.0), (3, None, 0.0, 0.0, 8.0, 8.0, 1.0, 1.0))
    two = geo_frame(spark, (1, "EPSG:4326", 75.9, 19.8, 76.0, 19.9, 0.001, 0.001), (2, "EPSG:4326", 10.0, 10.0, 10.1, 10.1, 0.001, 0.001), (3, "EPSG:4326", 75.9, 19.8, 76.0, 19.9, 0.001, 0.001))
    optical = spark.createDataFrame([(s, y, x, float(10 * y + x)) for s in (1, 2, 3) for y in range(8) for x in range(8)], "scene_id long, y int, x int, b04 double")
    radar = spark.createDataFrame([(1, y, x, (75.9 + (x + 0.5) * 0.001) * 10 + 19.9 - (y + 0.5) * 0.001) for y in range(100) for x in range(100)], "scene_id long, y int, x int, vv double")
    rows = fusion.warped(optical, radar, one, two, ["b04"], ["vv"]).collect()
    assert {r.scene_id for r in rows} == {1} and len(rows) == 64
    d = spark.createDataFrame([(r.y, r.x, 600000 + 100 * (r.x + 0.5), 2200000 - 100 * (r.y + 0.5)) for r in rows], "y int, x int, e double, n double")
    where = {(r.y, r.x): (r.lon, r.lat) for r in projection.to_degrees(d, "e", "n", F.lit("EPSG:32643"), "lon", "lat").collect()}
    for r in rows:
        lon, lat = where[r.y, r.x]
        assert r.b04 == 10 * r.y + r.x and abs(r.vv - (10 * lon + lat)) < 1e-9


def test_a_file_of_64_tiles_gives_64_tasks_and_a_window_skips_tiles(spark, tmp_path):
    bands = (np.random.default_rng(6).random((128, 125, 3)) * 60000).astype(np.uint16)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(bands, 0.0, 0.0, 10.0, 32642, tile=16, deflate=True))
    (tmp_path / "b.tif").write_bytes(geotiff.encode(bands[:5, :6].astype(np.float32), 0.0, 0.0, 10.0, 32642))
    path = str(tmp_path / "a.tif")
    px = geotiff.load(spark, str(tmp_path), split_bytes=500)
    assert geotiff.load(spark, path, split_bytes=500).rdd.getNumPartitions() == 64
    got = np.zeros(bands.shape)
    for r in px.where(F.col("scene_id") == path).collect():
        got[r.y, r.x] = (r.v1, r.v2, r.v3)
        assert (r.h, r.w, r.n_bands, r.v4) == (128, 125, 3, None)
    assert (got == bands).all()
    # of the rows from 20 to 40 and the columns from 33 to 47, two rows of tiles and one column of them are read
    few = geotiff.load(spark, path, split_bytes=500, rows=(20, 40), columns=(33, 47))
    assert few.rdd.getNumPartitions() == 2
    assert sorted((r.y, r.x, r.v2) for r in few.collect()) == [(y, x, float(bands[y, x, 1])) for y in range(20, 41) for x in range(33, 48)]
    assert px.where("y = 3 OR x = 1").count() == 125 + 128 - 1 + 6 + 5 - 1 and px.count() == 128 * 125 + 30
    assert geotiff.load(spark, path, split_bytes=500, rows=(500, 600)).count() == 0


def test_headers_are_read_without_the_samples(tmp_path):
    bands = np.zeros((400, 500, 4), np.float64)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(bands, 1.0, 2.0, 0.5, 4326, tile=64))
    asked = []
    with geotiff.Opened(str(tmp_path / "a.tif")) as fetch:
        t = geotiff.Tiff(lambda at, n: asked.append(n) or fetch(at, n))
        assert t.geo()["crs"] == "EPSG:4326" and t.geo()["bottom"] == 2.0 - 200 and (t.blocks, t.bands) == (56, 4)
    assert sum(asked) < 3 * geotiff.HEAD < bands.nbytes / 100


def test_big_and_planar_tiff(tmp_path):
    import struct

    image = np.arange(6, dtype=np.uint16).reshape(2, 3)
    body = image.tobytes() + (image + 100).astype(np.uint16).tobytes()
    entries = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 2, 16 | 16 << 16), (259, 3, 1, 1), (273, 3, 2, 16 | 28 << 16), (277, 3, 1, 2), (278, 3, 1, 2), (279, 3, 2, 12 | 12 << 16), (284, 3, 1, 2)]
    data = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + len(body)) + body + struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", *e) for e in entries) + struct.pack("<Q", 0)
    t = geotiff.Tiff(data)
    assert (t.array()[:, :, 0] == image).all() and (t.array()[:, :, 1] == image + 100).all()


def test_a_file_that_ends_early_has_no_header(tmp_path, spark):
    whole = geotiff.encode(np.zeros((9, 9, 1), np.uint8), 1.0, 2.0, 0.5, 4326)
    (tmp_path / "a.tif").write_bytes(whole[:-30])
    (tmp_path / "empty.tif").write_bytes(b"")
    assert [r.crs for r in geotiff.load(spark, str(tmp_path), what="geo").collect()] == [None, None]


def test_pictures_of_many_strips_are_read_by_another_decoder(spark, tmp_path):
    import base64

    image = (np.random.default_rng(8).integers(0, 256, (50, 9, 3))).astype(np.uint8)
    rows = [(7, y, x, *(float(c) / 255 + 1e-9 for c in image[y, x])) for y in range(50) for x in range(9) if (y, x) != (20, 3)]
    df = spark.createDataFrame(rows, "scene_id long, y int, x int, r double, g double, b double")
    image[20, 3] = 0
    data = base64.b64decode(png.pictures(df, ["r", "g", "b"], rows=7).first().png)
    assert data.count(b"IDAT") == 10 and (png.decode(data) == image).all()
    (tmp_path / "many.png").write_bytes(data)
    (tmp_path / "one.png").write_bytes(png.encode(image))
    read = images.rgb(spark, str(tmp_path)).collect()
    assert len(read) == 2 * 450 and all(np.allclose([r.r * 255, r.g * 255, r.b * 255], image[r.y, r.x]) for r in read)


def test_strips_without_pixels_and_scenes_without_names(spark):
    import base64

    df = spark.createDataFrame([(None, 0, 0, 1.0, 0.5, 0.0), (None, 29, 2, 0.0, 0.0, 1.0), ("a", 0, 0, 1.0, 1.0, 1.0)], "scene_id string, y int, x int, r double, g double, b double")
    got = {r.scene_id: png.decode(base64.b64decode(r.png)) for r in png.pictures(df, ["r", "g", "b"], rows=8).collect()}
    assert got[None].shape == (30, 3, 3) and got["a"].shape == (1, 1, 3)
    assert got[None][0, 0].tolist() == [255, 127, 0] and got[None][29, 2].tolist() == [0, 0, 255] and got[None].sum() == 637
    assert png.pictures(df.limit(0), ["r", "g", "b"]).count() == 0


def test_marks_are_boxes_grounds_and_letters_in_order(spark):
    import base64

    flat = spark.createDataFrame([(1, y, x, 0.0, 0.0, 0.0) for y in range(40) for x in range(60)], "scene_id long, y int, x int, r double, g double, b double")
    f = spark.createDataFrame([(1, 1, 2, 5, 20, 10, "Surface Water / Inundation Candidate", 0.579), (1, 2, 4, 30, 6, 5, "Built-up", 1.0)], "scene_id long, feature_id int, bx int, by int, bw int, bh int, category string, agreement double")
    image = png.decode(base64.b64decode(png.pictures(flat, ["r", "g", "b"], png.feature_boxes(f), rows=16).first().png))
    wet, other, ground = list(png.WATER_BOX), list(png.OTHER_BOX), list(png.FEATURE_GROUND)
    # the first box reaches from (5, 2) to (15, 22); its label "F1: Water (57%)" lies over its top
    assert image[15, 2].tolist() == image[14, 10].tolist() == image[12, 22].tolist() == wet and image[13, 10].tolist() == [0, 0, 0] and image[12, 23].tolist() == [0, 0, 0]
    assert image[0, 2].tolist() == ground and image[8, 2].tolist() == ground and image[9, 2].tolist() == wet
    letter = image[1:8, 2 + 1 : 2 + 6]
    assert ["".join("1" if p.tolist() == wet else "0" for p in row) for row in letter] == png.FONT["F"].split()
    assert image[30, 4].tolist() == other and image[35, 10].tolist() == other and image[36, 4].tolist() == [0, 0, 0]


def test_selected_percentiles_equal_percentile(spark):
    from rasterloom.operators import selection

    g = np.random.default_rng(9)
    scenes = {
        0: g.normal(size=700) * 10.0 ** g.integers(-200, 200, 700), 1: np.repeat([-0.0, 0.0, 5.0], 30), 2: np.array([3.5]), 3: np.array([]),
        None: np.nextafter(1.0, 2.0, dtype=float) + np.arange(40) * 2.0**-52, 5: -np.arange(100.0), 6: np.array([1.0, np.nan, 2.0, np.inf, -np.inf]), 7: g.integers(0, 256, 900) / 255,
    }
    rows = [(s, float(v), float(-v) if k % 3 else None) for s, a in scenes.items() for k, v in enumerate(a)] + [(3, None, None), (0, None, 1.0)]
    g.shuffle(rows := np.array(rows, object))
    df = spark.createDataFrame([tuple(r) for r in rows], "scene_id long, v double, w double").repartition(3)
    percents = (0, 2, 5, 10, 25, 35, 50, 75, 90, 95, 98, 100)
    got = {r[0]: list(r)[1:] for r in selection.percentiles(df, ["v", "w"], percents).collect()}
    shares = F.array(*[F.lit(p / 100.0) for p in percents])
    want = {r[0]: [*(r.v or [None] * 12), *(r.w or [None] * 12)] for r in df.groupBy("scene_id").agg(F.percentile("v", shares).alias("v"), F.percentile("w", shares).alias("w")).collect()}
    assert set(got) == set(want) - {3} and all(np.array_equal(np.array(got[s], float), np.array(want[s], float), equal_nan=True) for s in got)
    large = {r.scene_id: r for r in stats.profile(df, ["v", "w"], percents, large=True).collect()}
    assert large[3].v_p50 is None and large[2].v_mean == 3.5 and set(large) == set(want)
    assert selection.percentiles(df.limit(0), ["v"], percents).count() == 0


def test_what_a_turn_keeps_is_independent_of_pixels(spark):
    from rasterloom.operators import selection

    sizes = []
    for n in (2_000, 20_000):
        df = spark.range(n).select(F.lit(1).cast("long").alias("scene_id"), F.rand(3).alias("v"))
        sizes.append(selection.counted(selection.packed(df, ["v"]), 0).count())
    assert sizes[1] < 1.5 * sizes[0] < 500


def test_one_broken_image_fails_one_request(spark):
    image = np.random.default_rng(1).integers(0, 256, (12, 10, 3)).astype(np.uint8)
    other, small = np.roll(image, 5, axis=1), image[:9, :8]
    whole, broken = png.encode(image), png.encode(image)[:80]
    q = spark.createDataFrame([(1, "what changed?"), (2, "what changed?"), (3, "fuse radar and optical"), (4, "what changed?"), (5, "what changed?"), (6, "hello"), (7, "compare them")], "request_id long, query string")
    rows = [(1, 0, whole), (1, 1, png.encode(other)), (2, 0, whole), (2, 1, broken), (3, 0, whole), (3, 1, png.encode(small)), (4, 0, whole), (5, 0, b""), (5, 1, whole), (6, 0, whole), (7, 0, whole), (7, 1, png.encode(small)), (7, 2, broken)]
    files = spark.createDataFrame([(r, p, f"i{p}.png", "image/png", d) for r, p, d in rows], "request_id long, position int, filename string, content_type string, content binary")
    got = {r.request_id: r for r in router.run(q, files).collect()}
    assert len(got) == 7
    for k in (1, 7):
        assert got[k].model == "Change Detection Pipeline (rule-based)" and got[k].answer.startswith("DETECTED CHANGE") and got[k].trace[-1] == "Change analysis pipeline complete"
    assert got[1].trace[:5] == ["Query received", "Query classified", "Input validated: 2 image(s)", "Task identified: Bi-Temporal Change Analysis", "Routing to change analysis pipeline"]
    assert got[3].model == "Multimodal Fusion Pipeline (rule-based)" and got[3].confidence >= 45 and got[3].trace[-1] == "Fusion pipeline complete"
    for k, why in ((2, "the PNG's samples are broken"), (5, "the image is empty")):
        assert got[k].confidence == 50 and got[k].model == "Simulated (Change Understanding Model not yet trained/integrated)"
        assert got[k].trace[5] == f"Change pipeline error: cannot identify image: {why} — falling back to stub" and got[k].trace[-1].startswith("Specialist model 'Change Understanding Model'")
    assert got[4].answer == "Task 'change' requires two co-registered images (received 1)." and got[4].task == "Validation Error"
    assert got[6].trace[-1] == "Real VQA model unavailable (Model loading disabled) -- using simulated fallback"


def test_validation_names_the_first_bad_file(spark):
    q = spark.createDataFrame([(1, "hello", 2, ["image/png", "text/html"], ["a.png", "b.html"]), (2, "hello", 0, [], [])], "request_id long, query string, n_images int, content_types array<string>, filenames array<string>")
    got = {r.request_id: r.error for r in router.classified(q).collect()}
    assert got == {1: "Unsupported format 'text/html' for b.html.", 2: "At least one image is required."}


def test_png_of_every_filter_and_kind(spark):
    import struct
    import zlib

    g = np.random.default_rng(2)
    for kind, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        image = g.integers(0, 256, (10, 7, channels)).astype(np.uint8)
        flat, lines, above = image.reshape(10, -1).astype(int), [], np.zeros(7 * channels, int)
        for y in range(10):
            left = np.concatenate([np.zeros(channels, int), flat[y][:-channels]])
            corner = np.concatenate([np.zeros(channels, int), above[:-channels]])
            p = left + above - corner
            near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
            guess = [0 * left, left, above, (left + above) // 2, near][y % 5]
            lines.append(bytes([y % 5]) + ((flat[y] - guess) % 256).astype(np.uint8).tobytes())
            above = flat[y]
        data = b"\x89PNG\r\n\x1a\n" + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, kind, 0, 0, 0)) + png.chunk(b"IDAT", zlib.compress(b"".join(lines))) + png.chunk(b"IEND", b"")
        assert (png.read(data) == image[:, :, : 3 if channels > 2 else 1]).all()


def test_resize_with_a_size_for_every_scene(spark):
    image = np.random.default_rng(3).random((8, 8))
    pixels = frame(spark, image).unionByName(frame(spark, image * 40 - 7, scene=1)).unionByName(frame(spark, np.full((8, 8), 2.5), scene=2))
    sizes = spark.createDataFrame([(0, 8, 8, 8, 8), (1, 8, 8, 5, 3), (2, 8, 8, 20, 9)], "scene_id long, h int, w int, out_h int, out_w int")
    got = stencil.resize_scenes(pixels, ["v"], sizes)
    assert np.array_equal(back(got.where("scene_id = 0"), "v", (8, 8)), image)
    assert (back(got.where("scene_id = 2"), "v", (20, 9)) == 2.5).all()
    small = back(got.where("scene_id = 1"), "v", (5, 3))
    assert small.min() >= image.min() * 40 - 7 - 1e-9 and small.max() <= image.max() * 40 - 7 + 1e-9
    places, weights = stencil.fixed_taps(8, 5)
    assert abs(weights.sum(axis=1) - (1 << 22)).max() <= weights.shape[1] and places.max() == 7


def test_shares_are_rounded_by_their_exact_value(spark):
    from rasterloom.functions import text

    values = [65.625, 3.125, 0.375, 2.675, 1.005, 0.0005, 12.0, 0.125, 100.0, 0.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.rounded(F.col("v"), 2).alias("r"), text.shortest(F.col("v"), 4).alias("s")).collect()
    assert [r.r for r in rows] == [round(r.v, 2) for r in rows] and [r.s for r in rows] == [str(round(r.v, 4)) for r in rows]


@pytest.mark.parametrize("few", [0, None])
def test_scenes_without_a_name_keep_their_pixels(spark, few, monkeypatch):
    monkeypatch.setattr(components, "ROWS", 2)
    masks = {None: np.random.default_rng(5).random((9, 11)) > 0.4, 3: np.random.default_rng(6).random((9, 11)) > 0.4}
    rows = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m))]
    got = {k: np.zeros((9, 11), int) for k in masks}
    for r in components.distributed(spark.createDataFrame(rows, "scene_id long, y int, x int"), few=few).collect():
        got[r.scene_id][r.y, r.x] = r.label
    assert all((got[k] == flood(m)).all() for k, m in masks.items())


def test_the_way_to_label_follows_the_measured_size(spark, monkeypatch):
    taken = []
    for name in ("grouped", "distributed"):
        monkeypatch.setattr(components, name, lambda m, n=name: taken.append(n) or m)
    mask = spark.range(10).selectExpr("0L AS scene_id", "0 AS y", "CAST(id AS INT) AS x")
    components.by_size(mask)
    monkeypatch.setattr(components, "LARGE", 9)
    components.by_size(mask)
    components.by_size(mask.limit(0))
    assert taken == ["grouped", "distributed", "grouped"]


def test_a_replayed_batch_adds_nothing_to_the_history(spark, tmp_path):
    import json

    from rasterloom import streaming

    entries, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    (tmp_path / "in").mkdir()

    def say(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"query": q}) + "\n" for q in rows))
        streaming.record_history(spark, entries, "query string", out, log).awaitTermination()

    say("a.json", "one", "two")
    say("b.json", "three")
    assert [r.query for r in streaming.history(spark, out).collect()] == ["three", "two", "one"]
    for f in (tmp_path / "log" / "commits").glob("*1*"):  # as if the driver had been lost before it committed the second batch
        f.unlink()
    streaming.record_history(spark, entries, "query string", out, log).awaitTermination()
    rows = streaming.history(spark, out).collect()
    assert [r.query for r in rows] == ["three", "two", "one"] and len({(r.batch, r.place) for r in rows}) == 3


def test_responses_carry_pictures_regions_and_failures(spark, tmp_path):
    import base64

    from rasterloom.sources import responses

    failed = spark.createDataFrame([(9, "broken")], "scene_id long, error string")
    made = responses.change_responses(uniform_pair(spark, (50, 100, 50), (150, 60, 40)).unionByName(uniform_pair(spark, (9, 9, 9), (9, 9, 9)).withColumn("scene_id", F.lit(1).cast("long"))), "what changed?", failed)
    responses.write(made, str(tmp_path / "r"))
    got = {r.scene_id: r for r in responses.read_changes(spark, str(tmp_path / "r")).collect()}
    assert (got[9].status, got[9].detail, got[9].changes) == (500, "Change analysis error: broken", None)
    assert (got[0].status, got[0].changed_area_percentage, got[0].query) == (200, 100.0, "what changed?")
    (region,) = got[0].changes
    assert (region.region_id, region.bbox.asDict(), region.area_pixels, region.area_fraction) == (1, {"x": 0, "y": 0, "width": 20, "height": 20}, 400, 1.0)
    pictures = {n: png.decode(base64.b64decode(got[0][n])) for n in ("before_image", "after_image", "change_map", "change_overlay")}
    assert pictures["before_image"][7, 7].tolist() == [50, 100, 50] and all(p.shape == (20, 20, 3) for p in pictures.values())
    assert pictures["change_overlay"][0, 19].tolist() == list(png.CHANGE_BOX) or pictures["change_overlay"][10, 0].tolist() == list(png.CHANGE_BOX)
    assert got[1].changes == [] and png.decode(base64.b64decode(got[1].change_map)).sum() == 0


def sensors(optical_at, radar_at, res, epsg):
    """An optical file and a radar file of a scene with a lake and a town, in counts and in linear power."""
    g = np.random.default_rng(42)
    ranges = [((700, 1100), (1100, 1400), (2200, 3000)), ((900, 1400), (1400, 1800), (2300, 3100)), ((800, 1300), (300, 500), (2500, 3300)), ((2500, 4000), (150, 300), (2000, 2800))]
    optical = np.zeros((150, 200, 4))
    for b, (land, water, town) in enumerate(ranges):
        optical[:, :, b] = g.uniform(*land, (150, 200))
        optical[50:110, 40:120, b] = g.uniform(*water, (60, 80))
        optical[20:45, 140:180, b] = g.uniform(*town, (25, 40))
    radar = np.zeros((140, 180, 2))
    for b, (land, water, town) in enumerate([((0.02, 0.08), (0.0005, 0.002), (0.6, 1.8)), ((0.003, 0.015), (0.0001, 0.0005), (0.08, 0.25))]):
        radar[:, :, b] = g.uniform(*land, (140, 180))
        radar[40:100, 30:110, b] = g.uniform(*water, (60, 80))
        radar[15:40, 130:170, b] = g.uniform(*town, (25, 40))
    return geotiff.encode(optical.astype(np.uint16), *optical_at, res, epsg, tile=64, deflate=True), geotiff.encode(radar.astype(np.float32), *radar_at, res, epsg)


@pytest.mark.parametrize("places", [((250000.0, 3050000.0), (250100.0, 3049900.0), 10.0, 32642, (140, 180)), ((68.10, 27.60), (68.1010, 27.5990), 0.0001, 4326, (140, 180))])
def test_files_to_fused_regions(spark, tmp_path, places):
    *where, size = places
    heads, pixels = [], []
    for name, data in zip(("o", "r"), sensors(*where)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1.tif").write_bytes(data)
        heads.append(geotiff.load(spark, str(tmp_path / name), what="geo").withColumn("scene_id", F.lit(1)))
        pixels.append(geotiff.load(spark, str(tmp_path / name), split_bytes=20_000).withColumn("scene_id", F.lit(1)))
    p = components.settled(fusion.from_files(*pixels, *heads))
    assert tuple(p.agg(F.max("y") + 1, F.max("x") + 1, F.count("*")).first()) == (*size, size[0] * size[1])
    r = fusion.analyse(p, "is there surface water?").first()
    kinds = {f.category for f in r.features}
    assert fusion.WATER in kinds and all(0 <= f.optical_score <= 1 and 0 <= f.sar_score <= 1 and f.area > 0 for f in r.features)
    lake = next(f for f in r.features if f.category == fusion.WATER)
    # both sensors see the lake at the same place of the ground, some 60 by 80 pixels from row 40 and column 30 of the common grid
    assert abs(lake.bx - 30) <= 3 and abs(lake.by - 40) <= 3 and abs(lake.bw - 80) <= 5 and abs(lake.bh - 60) <= 5
    assert r.iou_pct > 80 and r.agreement_pct > 95 and 45 <= r.confidence <= 96


@pytest.mark.parametrize("tile", [3, 7, 64])
def test_blur_over_tiles_is_that_of_the_scene(spark, tile):
    image = np.random.default_rng(3).uniform(-0.2, 1.2, (19, 23))
    f = frame(spark, image, "m")
    whole = np.clip(back(stencil.gaussian(f, "m"), "m", image.shape), 0, 1)
    assert np.array_equal(back(tiles.mapped(f, ["m"], change.smoothed, "g", change.HALO, tile), "g", image.shape), whole)


def test_tiles_of_odd_scenes(spark):
    """No rows, no name, holes and nulls, bands with names of the operator's own; a function that changes the shape is refused."""
    rows = [(None, 0, 0, 1.0), (None, 0, 5, None), (7, 4, 4, 2.0)]
    f = spark.createDataFrame(rows, "scene_id long, y int, x int, `_y` double")
    seen = {(r.scene_id, r.y, r.x): r.n for r in tiles.mapped(f.withColumnRenamed("_y", "v"), ["v"], lambda t: t["v"] + t["v"].size, "n", 1, 4).collect()}
    assert seen == {(None, 0, 0): 2.0, (None, 0, 5): 1.0, (7, 4, 4): 3.0}
    assert tiles.mapped(f.withColumnRenamed("_y", "v").limit(0), ["v"], lambda t: t["v"], "n", 1).count() == 0
    with pytest.raises(ValueError):
        tiles.mapped(f, ["_y"], lambda t: t["_y"], "n", 1, 0)
    with pytest.raises(Exception, match="became one of"):
        tiles.mapped(f.withColumnRenamed("_y", "v"), ["v"], lambda t: t["v"][:0], "n", 1).collect()


def test_a_detector_of_tiles_is_chosen_by_name(spark, sf, monkeypatch):
    pairs = synth.change_pairs(spark, sf)
    columns = ("scene_id", "threshold", "changed_percent", "n_regions", "summary", "trace")
    want, got = ({r.scene_id: r for r in change.analyse(pairs, "", name).select(*columns).collect()} for name in ("lab", "lab_tiles"))
    assert got == want and any(r.n_regions for r in want.values())
    red = change.tiled(lambda t: np.abs(t["r1"] - t["r0"]), 0, 3)
    monkeypatch.setitem(change.DETECTORS, "red", red)
    one = uniform_pair(spark, (50, 100, 50), (50, 60, 40), 6).unionByName(uniform_pair(spark, (0, 0, 0), (255, 0, 0), 6).withColumn("scene_id", F.lit(1).cast("long")))
    assert {r.scene_id: r.changed_percent for r in change.analyse(one, "", "red").collect()} == {0: 0.0, 1: 100.0}


def test_fusion_responses_carry_pictures_features_and_failures(spark, sf, tmp_path):
    import base64

    from rasterloom.sources import responses

    p = synth.scenes(spark, sf).where("scene_id <= 2").select("scene_id", "y", "x", "b02", "b03", "b04", "b08", "vv_raw", "vh_raw")
    failed = spark.createDataFrame([(99, "no radar")], "scene_id long, error string")
    places = spark.createDataFrame([(1, "geo_referenced", "by zone", "EPSG:32643", "1,2,3,4")], "scene_id long, method string, details string, crs string, bounds string")
    responses.write(responses.fusion_responses(p, "flooding?", "composite", places, failed), str(tmp_path / "r"))
    got = {r.scene_id: r for r in responses.read_fusions(spark, str(tmp_path / "r")).collect()}
    plain = {r.scene_id: r for r in fusion.analyse(p, "flooding?").collect()}
    assert (got[99].status, got[99].detail, got[99].features) == (500, "Fusion analysis error: no radar", None)
    assert (got[1].alignment_method, got[1].geo_crs, got[2].alignment_method, got[2].geo_bounds) == ("geo_referenced", "EPSG:32643", "dimension_matched", None)
    for k in (1, 2):
        r, a = got[k], plain[k]
        assert (r.status, r.summary, r.fused_interpretation, r.confidence) == (200, a.summary, a.interpretation, a.confidence)
        assert [(f.id, f.bbox.x, f.bbox.width, f.category, f.agreement_score, f.confidence) for f in r.features] == [(f.feature_id, f.bx, f.bw, f.category, f.agreement_score, f.confidence) for f in a.features]
        assert (r.diagnostics.inundation_iou_pct, r.diagnostics.number_of_regions) == (a.iou_pct, len(a.features))
        shown = {n: png.decode(base64.b64decode(r[n])) for n in ("optical_image", "sar_image", "fusion_visualization", "evidence_map")}
        assert all(s.shape == (64, 64, 3) for s in shown.values())
        assert np.array_equal(shown["sar_image"][:, :, 0], shown["sar_image"][:, :, 2]) and shown["optical_image"].std() > 0
        f = next(f for f in r.features if f.category == fusion.WATER)
        box = shown["fusion_visualization"][f.bbox.y + f.bbox.height - 1, f.bbox.x + 3]
        assert box.tolist() == list(png.WATER_BOX)
        assert r.execution_trace[0].endswith("payloads received") and "Cross-modal fusion execution (method: composite)" in r.execution_trace
        assert set(a.trace) < set(r.execution_trace) and any(str(a.agreement_pct) + "% physical sensor agreement" in s for s in a.trace)
