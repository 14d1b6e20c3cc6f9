"""Queries of texts, requests, alignment, image records and the rarer branches of the analyses."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import projection, radar, scores, spectral, text
from ..operators import align, change, fusion, router, stencil
from ..sources import images, png, synth
from . import pixel, words
from .registry import SIX, TILES, exact, r6, register, shortest
from .scene import CHANGE, COMPONENTS, _thirds
from .words import case

C = F.col

LOCATION = "CASE WHEN v = 'central' AND w = 'central' THEN 'center of the scene' WHEN v = 'central' THEN w || ' portion of the scene' WHEN w = 'central' THEN v || '-central portion of the scene' ELSE v || '-' || w || ' portion of the scene' END"


@register("t3_change_texts", f"""WITH RECURSIVE {CHANGE}, mask AS (SELECT scene_id, y, x, y * 8 + x AS p FROM ch WHERE c),
{COMPONENTS.split('),', 1)[1].strip()}, lb AS (SELECT scene_id, y, x, dense_rank() OVER (PARTITION BY scene_id ORDER BY root)::BIGINT AS region_id FROM roots JOIN mask USING (scene_id, p)),
rg AS (SELECT scene_id, region_id, count(*) AS area, avg(x) / 8 AS cx, avg(y) / 8 AS cy, avg(g) AS m FROM lb JOIN ch USING (scene_id, y, x) GROUP BY ALL),
nm AS (SELECT *, {_thirds('cy', 'upper', 'lower')} AS v, {_thirds('cx', 'left', 'right')} AS w, row_number() OVER (PARTITION BY scene_id ORDER BY area DESC, region_id) AS rank, {exact('least(1.0::DOUBLE, 0.5 + 0.3 * m + 2.0 * area / 64.0::DOUBLE)', 3)} AS confidence FROM rg),
lo AS (SELECT *, {LOCATION} AS location FROM nm WHERE rank <= 20),
ag AS (SELECT scene_id, count(*) AS n, printf('%.3f', sum(confidence ORDER BY rank) / count(*))::DOUBLE AS conf, max(m) FILTER (rank = 1) AS m, max(location) FILTER (rank = 1) AS l1, max(location) FILTER (rank = 2) AS l2, max(location) FILTER (rank = 3) AS l3,
 string_agg(printf('  • Region %d: %s, area %.2f%%, magnitude %.2f, confidence %.0f%%', region_id, location, area / 64.0::DOUBLE * 100, m, confidence * 100), chr(10) ORDER BY rank) FILTER (rank <= 5) AS lines FROM lo GROUP BY 1),
pc AS (SELECT scene_id, {exact('avg(c::INT) * 100', 2)} AS percent FROM ch GROUP BY 1)
SELECT scene_id, percent AS changed_percent, coalesce(n, 0)::INT AS n_regions, CASE WHEN n IS NULL THEN 0.9 ELSE conf END::DOUBLE AS overall_confidence,
 CASE WHEN n IS NULL THEN '{text.NO_CHANGE_EVIDENCE}' ELSE printf('Detected %d significant change region(s) covering approximately %.1f%% of the total scene area.', n, percent) || chr(10) || lines END AS evidence,
 CASE WHEN n IS NULL THEN '{text.NO_CHANGE}' ELSE printf('Significant changes were detected between the two temporal observations. %d distinct change region(s) were identified, covering approximately %.1f%% of the scene.', n, percent) || ' The most prominent changes are located in the ' || l1 || CASE WHEN l2 <> l1 THEN ', ' || l2 ELSE '' END || CASE WHEN l3 NOT IN (l1, l2) THEN ', ' || l3 ELSE '' END || '. ' || CASE WHEN m > 0.6 THEN '{text.BAND_TEXT['high']}' WHEN m > 0.3 THEN '{text.BAND_TEXT['moderate']}' ELSE '{text.BAND_TEXT['low']}' END || ' {text.CONTEXT_TEXT['water']}' END AS narrative
FROM pc LEFT JOIN ag USING (scene_id)""")
def t3_change_texts(spark, d):
    out = change.analyse(synth.change_pairs(spark, d), "how did the river change?")
    return out.select("scene_id", "changed_percent", "n_regions", "overall_confidence", "evidence", "narrative")


#: Scalars of scenes as the texts read them: ((k * a) % m - s) / q, by name.
NUMBERS = {
    "b02_mean": (37, 983, 0, 2000), "b03_mean": (41, 977, 0, 2000), "b04_mean": (43, 971, 0, 2000), "b08_mean": (47, 967, -20, 2000),
    "ndwi_mean": (53, 1999, 1000, 2000), "ndwi_p50": (59, 1997, 1000, 2000), "ndwi_std": (61, 991, 0, 2000), "vegetation_pct": (67, 9973, 0, 100),
    "t_ndwi": (71, 250, -50, 1000), "optical_water_pct": (73, 9967, 0, 100), "edge_mean": (79, 997, 0, 1000), "lum_mean": (83, 1993, 0, 2000),
    "vh_mean": (89, 2999, 4000, 100), "vh_p50": (97, 2998, 4000, 100), "vv_mean": (101, 2503, 3000, 100), "vv_p50": (103, 2501, 3000, 100),
    "vv_p10": (107, 2499, 3500, 100), "vv_p90": (109, 2497, 2500, 100), "vv_std": (113, 997, 0, 100), "t_vv": (127, 1201, 2600, 100),
    "sar_water_pct": (131, 9949, 0, 100), "t_db": (137, 801, 800, 100), "bounce_pct": (139, 9941, 0, 100), "agreement_pct": (149, 9931, 0, 100),
    "iou_pct": (151, 9929, 0, 100), "consensus_pct": (157, 9923, 0, 100), "optical_only_pct": (163, 9907, 0, 100), "sar_only_pct": (167, 9901, 0, 100), "structure_pct": (173, 9887, 0, 100),
}
QUESTIONS = ("is there flooding near the river?", "map the urban area", "crop health", "what hides under cloud", "tell me more")
PLACES = ((1, "northern sector"), (1, "western sector"), (2, "eastern sector"), (3, "southern sector"), (3, "northern-eastern quadrant"))
SCALARS = ", ".join(f"((k * {a}) % {m} - ({s})) / {q}::DOUBLE AS {n}" for n, (a, m, s, q) in NUMBERS.items())
BITS = ", ".join(f"((k >> {i}) & 1) AS f{i}" for i in range(len(PLACES)))
FOUND = "f0 + f1 AS n1, f2 AS n2, f3 + f4 AS n3, CASE WHEN f0 = 1 THEN 'northern sector' WHEN f1 = 1 THEN 'western sector' END AS p1, CASE WHEN f2 = 1 THEN 'eastern sector' END AS p2, CASE WHEN f3 = 1 THEN 'southern sector' WHEN f4 = 1 THEN 'northern-eastern quadrant' END AS p3"
NOTE = "[Note: Since this analysis evaluates single-date acquisitions without a historical baseline, candidate water is reported rather than confirmed permanent vs flood water]."


@register("f9_fusion_texts", f"""WITH s0 AS (SELECT s_suppkey AS k FROM supplier), s1 AS (SELECT k, k % 3 <> 0 AS four, k % 4 <> 1 AS dual, 45 + k % 52 AS confidence, {SCALARS}, {BITS} FROM s0), s2 AS (SELECT *, {FOUND}, CASE WHEN four THEN vegetation_pct ELSE 0.0::DOUBLE END AS veg, CASE WHEN dual THEN 'dual_pol' ELSE 'single_pol' END AS pol FROM s1),
s AS (SELECT s2.*, theme FROM s2, (VALUES ('water'), ('urban'), ('vegetation'), ('clouds'), ('general')) t(theme))
SELECT k, theme,
 printf('Optical multispectral imagery (%d bands: B02 Blue=%.3f, B03 Green=%.3f, B04 Red=%.3f', CASE WHEN four THEN 4 ELSE 3 END, b02_mean, b03_mean, b04_mean) || CASE WHEN four THEN ', B08 NIR: ' || {shortest('b08_mean', 4)} ELSE '' END || printf(') shows mean NDWI of %+.3f (median: %+.3f, std: %.3f). ', ndwi_mean, ndwi_p50, ndwi_std)
 || CASE theme WHEN 'water' THEN printf('Applying NDWI threshold >= %.2f combined with NIR absorption criteria (B08 <= 0.28) isolates %.2f%% of the scene as optical water / inundation candidate pixels. ', t_ndwi, optical_water_pct) || CASE WHEN n1 > 0 THEN printf('Detected %d distinct contiguous candidate water zone(s), prominently in the %s.', n1, p1) ELSE 'No dominant isolated open water clusters detected.' END
  WHEN 'urban' THEN printf('Spatial edge analysis indicates mean gradient of %.2f. ', edge_mean) || CASE WHEN n2 > 0 THEN printf('Detected %d dense structural cluster(s) in the %s.', n2, p2) ELSE 'Terrain exhibits predominantly uniform radiometric texture.' END
  WHEN 'vegetation' THEN printf('Vegetation index response indicates active photosynthetic biomass across approximately %.1f%% of the scene.', veg)
  ELSE printf('Surface classification reveals %.2f%% optical water candidate signature, %.1f%% vegetative canopy, and mean scene luminance of %.1f%%.', optical_water_pct, veg, lum_mean * 100.0) END AS optical_evidence,
 printf('Calibrated SAR radar backscatter (%s) records mean VV intensity of %.1f dB [median: ', pol, vv_mean) || {shortest('vv_p50', 2)} || ' dB, p10: ' || {shortest('vv_p10', 2)} || ' dB, p90: ' || {shortest('vv_p90', 2)} || printf(' dB, std: %.1f dB]', vv_std) || CASE WHEN dual THEN ', VH cross-pol mean: ' || {shortest('vh_mean', 2)} || ' dB (median: ' || {shortest('vh_p50', 2)} || ' dB)' ELSE '' END || '. '
 || CASE theme WHEN 'water' THEN printf('Adaptive low-backscatter thresholding (VV <= %.1f dB) identifies %.2f%% of the radar scene as specular reflection candidates where microwave pulses reflect away from the sensor.', t_vv, sar_water_pct)
  WHEN 'urban' THEN printf('High-intensity double-bounce returns (VV >= %.1f dB) occupy %.2f%% of the scene, characteristic of dihedral corner reflections between vertical walls/structures and the ground plane.', t_db, bounce_pct)
  WHEN 'vegetation' THEN CASE WHEN dual THEN 'Cross-polarization volume scattering indicates canopy interaction across vegetated ground.' ELSE printf('Moderate VV backscatter (%.1f dB) corresponds to surface roughness across agricultural terrain.', vv_mean) END
  ELSE printf('Radar returns isolate %.2f%% low-backscatter candidate surfaces and %.2f%% high-intensity double-bounce structures.', sar_water_pct, bounce_pct) END AS sar_evidence,
 printf('Cross-modal fusion achieves %.2f%% physical sensor agreement across the common spatial domain (Inundation IoU: %.2f%%). ', agreement_pct, iou_pct)
 || CASE theme WHEN 'water' THEN 'Regarding surface water and inundation: Optical NDWI (thresh >= ' || t_ndwi::VARCHAR || printf(') and SAR specular backscatter (thresh <= %.1f dB) jointly confirm %.2f%% surface water / inundation candidate area. Sensor discrepancies account for %.2f%% optical-only and %.2f%% SAR-only candidate detections.', t_vv, consensus_pct, optical_only_pct, sar_only_pct)
   || CASE WHEN n3 > 0 THEN printf(' Additionally, %d sector(s) of potential flooded vegetation / sub-canopy wetness were detected in the %s.', n3, p3) ELSE '' END || CASE WHEN n1 > 0 THEN printf(' Primary candidate water bodies are delineated in the %s.', p1) ELSE '' END || ' {NOTE}'
  WHEN 'urban' THEN printf('Regarding built-up infrastructure: Optical edge contrast and SAR double-bounce backscatter (VV >= %.1f dB) confirm %.2f%% dense urban footprint.', t_db, structure_pct) || CASE WHEN n2 > 0 THEN printf(' Main settlement clusters are localized in the %s.', p2) ELSE '' END
  WHEN 'clouds' THEN 'SAR microwave penetration bypasses optical atmospheric attenuation, confirming terrain structures and surface moisture directly beneath cloud cover.'
  ELSE printf('Multimodal analysis provides all-weather characterization: %d candidate water zone(s) and %d built-up infrastructure cluster(s) isolated with high cross-sensor consistency.', n1, n2) END AS interpretation,
 printf('Optical + SAR fusion (%d-band Optical + %s SAR): %.1f%% agreement (IoU: %.1f%%), %d feature region(s), confidence: %d%%.', CASE WHEN four THEN 4 ELSE 3 END, pol, agreement_pct, iou_pct, n1 + n2 + n3, confidence) AS summary
FROM s""")
def f9_fusion_texts(spark, d):
    """The texts of every supplier's scalars under a question of each theme."""
    k = C("k")
    s = synth.table(spark, d, "supplier").select(C("s_suppkey").cast("long").alias("k"))
    numbers = [(((k * a) % m - F.lit(s_)) / float(q)).alias(n) for n, (a, m, s_, q) in NUMBERS.items()]
    items = F.array(*[F.when(F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1, F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("location"))) for i, (kind, p) in enumerate(PLACES)])
    s = s.select("k", (k % 3 != 0).alias("four"), (k % 4 != 1).alias("dual"), (45 + k % 52).alias("confidence"), *numbers, F.filter(items, lambda f: f.isNotNull()).alias("features"))
    told = [fusion.texts(s, q).select("k", "theme", "optical_evidence", "sar_evidence", "interpretation", "summary") for q in QUESTIONS]
    return reduce(lambda a, b: a.unionByName(b), told)


def _bilinear(source: str, value: str, tx: str, ty: str, w: int, h: int) -> str:
    weight = f"(1 - abs(i - ({tx}))) * (1 - abs(j - ({ty})))"
    return f"SELECT scene_id, j::INT AS y, i::INT AS x, sum({value} * {weight}) / sum({weight}) AS {value}, sum({weight}) AS coverage FROM {source}, range({w}) a(i), range({h}) b(j) WHERE abs(i - ({tx})) < 1 AND abs(j - ({ty})) < 1 GROUP BY ALL"


@register("j2_aligned", f"WITH {TILES}, o AS (SELECT scene_id, y, x, v AS b02 FROM tiles), r AS (SELECT scene_id, y, x, 1 - v AS vv FROM tiles), p AS ({_bilinear('o', 'b02', 'x - 0.5', 'y', 8, 8)}), q AS ({_bilinear('r', 'vv', 'x', 'y - 0.25', 8, 8)}) SELECT scene_id, y, x, round(b02, 6) AS b02, round(vv, 6) AS vv FROM p JOIN q USING (scene_id, y, x)")
def j2_aligned(spark, d):
    """Optical and radar tiles whose extents differ by half a pixel and a quarter, on their common grid."""
    t = synth.tiles(spark, d)
    ids = t.select("scene_id").distinct()

    def extent(left: float, top: float):
        return ids.select("scene_id", F.lit("EPSG:32643").alias("crs"), F.lit(left).alias("left"), F.lit(top - 8).alias("bottom"), F.lit(left + 8).alias("right"), F.lit(top).alias("top"), F.lit(1.0).alias("res_x"), F.lit(1.0).alias("res_y"))

    optical, sar = t.withColumnRenamed("v", "b02"), t.select("scene_id", "y", "x", (1.0 - C("v")).alias("vv"))
    return fusion.aligned(optical, sar, extent(0.0, 8.0), extent(0.5, 8.25), ["b02"], ["vv"]).select("scene_id", "y", "x", r6("b02"), r6("vv"))


def _warp_sql() -> str:
    """Kind 0: zone 43 to zone 44; 1: zone 43 to degrees; 2: degrees to zone 43."""
    to_deg, to_zone = projection.zone_to_degrees_sql, projection.degrees_to_zone_sql
    return f"""WITH {TILES}, s AS (SELECT DISTINCT scene_id, scene_id % 3 AS kind, CASE WHEN scene_id % 3 < 2 THEN 600000.0::DOUBLE + scene_id % 50 * 1000 ELSE 77.0::DOUBLE + (scene_id % 50) / 100.0::DOUBLE END AS l,
 CASE WHEN scene_id % 3 < 2 THEN 2200000.0::DOUBLE + scene_id % 70 * 10000 ELSE 20.0::DOUBLE + (scene_id % 70) / 10.0::DOUBLE END AS t FROM tiles),
c01 AS ({to_deg('(SELECT * FROM s WHERE kind < 2)', 'l', 't', '43')}), c2 AS (SELECT *, l AS lon, t AS lat FROM s WHERE kind = 2),
corner AS (SELECT *, east - 300 AS tl, north + 300 AS tt, 1000.0::DOUBLE AS r FROM ({to_zone('(SELECT * FROM c01 WHERE kind = 0)', '44')}) UNION ALL SELECT *, 0::DOUBLE AS east, 0::DOUBLE AS north, lon - 0.003 AS tl, lat + 0.003 AS tt, 0.01::DOUBLE AS r FROM c01 WHERE kind = 1 UNION ALL SELECT *, east - 300 AS tl, north + 300 AS tt, 1000.0::DOUBLE AS r FROM ({to_zone('c2', '43')})),
target AS (SELECT scene_id, kind, l, t, y::INT AS y, x::INT AS x, tl + (x + 0.5::DOUBLE) * r AS px, tt - (y + 0.5::DOUBLE) * r AS py FROM corner, range(9) a(y), range(9) b(x)),
back0 AS (SELECT scene_id, kind, l, t, y, x, east AS sx, north AS sy FROM ({to_zone('(' + to_deg('(SELECT * FROM target WHERE kind = 0)', 'px', 'py', '44') + ')', '43')})),
back1 AS (SELECT scene_id, kind, l, t, y, x, east AS sx, north AS sy FROM ({to_zone('(SELECT *, px AS lon, py AS lat FROM target WHERE kind = 1)', '43')})),
back2 AS (SELECT scene_id, kind, l, t, y, x, lon AS sx, lat AS sy FROM ({to_deg('(SELECT * FROM target WHERE kind = 2)', 'px', 'py', '43')})),
back AS (SELECT *, CASE WHEN kind < 2 THEN 1000.0::DOUBLE ELSE 0.01::DOUBLE END AS r FROM (SELECT * FROM back0 UNION ALL SELECT * FROM back1 UNION ALL SELECT * FROM back2)),
place AS (SELECT scene_id, y, x, CASE WHEN sx >= l AND sx < l + 8 * r AND sy <= t AND sy > t - 8 * r THEN (sx - l) / r - 0.5 END AS u, (t - sy) / r - 0.5 AS v FROM back),
sums AS (SELECT a.scene_id, a.y, a.x, sum(p.v * (1 - abs(p.x - u)) * (1 - abs(p.y - a.v))) AS total, sum((1 - abs(p.x - u)) * (1 - abs(p.y - a.v))) AS weight FROM place a JOIN tiles p ON p.scene_id = a.scene_id AND abs(p.x - u) < 1 AND abs(p.y - a.v) < 1 GROUP BY ALL)
SELECT scene_id, y, x, round(coalesce(total / weight, 0), 5) AS v, round(coalesce(weight, 0), 5) AS coverage FROM place LEFT JOIN sums USING (scene_id, y, x)"""


@register("s5_warp", _warp_sql())
def s5_warp(spark, d):
    """Tiles of a kilometre or a hundredth of a degree a pixel, warped between zones and degrees; the grid hangs over their edges."""
    t = synth.tiles(spark, d)
    k = C("scene_id")
    zone, kind = k % 3 < 2, k % 3
    step = lambda c: F.when(c, 1000.0).otherwise(0.01)
    g = t.select("scene_id").distinct().select(
        "scene_id", F.when(zone, "EPSG:32643").otherwise("EPSG:4326").alias("crs"), F.when(kind == 0, "EPSG:32644").when(kind == 1, "EPSG:4326").otherwise("EPSG:32643").alias("to_crs"),
        F.when(zone, 600000.0 + k % 50 * 1000).otherwise(77.0 + k % 50 / 100.0).alias("left"), F.when(zone, 2200000.0 + k % 70 * 10000).otherwise(20.0 + k % 70 / 10.0).alias("top"), step(zone).alias("res_x"), step(zone).alias("res_y"),
    )
    g = g.withColumns({"right": C("left") + 8 * C("res_x"), "bottom": C("top") - 8 * C("res_y")})
    r = step(kind != 1)
    to = projection.converted(g, "left", "top", C("crs"), C("to_crs"), "u", "v")
    to = to.select("scene_id", C("to_crs").alias("crs"), (C("u") - 0.3 * r).alias("left"), (C("v") + 0.3 * r).alias("top"), r.alias("res_x"), r.alias("res_y"), F.lit(9).alias("out_w"), F.lit(9).alias("out_h"))
    return align.warp(t, g, to, ["v"]).select("scene_id", "y", "x", F.round("v", 5).alias("v"), F.round("coverage", 5).alias("coverage"))


register("s5_resample", f"WITH {TILES} SELECT scene_id, y, x, round(v, 6) AS v, round(coverage, 6) AS coverage FROM ({_bilinear('tiles', 'v', 'x - 0.25', 'y - 0.25', 7, 7)})")(words.s5_resample)


def _pass(source: str, place: str, other: str, n: int, m: int) -> str:
    taps = ", ".join(f"({to}, {j}, {w!r}::DOUBLE)" for to, j, w in stencil.lanczos_taps(n, m))
    return f"SELECT scene_id, {other}, t AS {place}, least(greatest(floor(sum(v * w) + 0.5), 0), 255)::DOUBLE AS v FROM {source} JOIN (VALUES {taps}) k(t, f, w) ON f = {place} GROUP BY ALL"


@register("s4_resize_levels", f"WITH {TILES}, a AS (SELECT scene_id, y, x, floor(v * 255)::DOUBLE AS v FROM tiles), b AS ({_pass('a', 'x', 'y', 8, 6)}), c AS ({_pass('b', 'y', 'x', 8, 5)}) SELECT scene_id, y, x, (v)::INT AS level FROM c")
def s4_resize_levels(spark, d):
    s = stencil.resize(synth.tiles(spark, d), ["v"], 8, 8, 5, 6)
    return s.select("scene_id", C("y").cast("int").alias("y"), C("x").cast("int").alias("x"), F.round(C("v") * 255.0).cast("int").alias("level"))


def _fixed_pass(source: str, place: str, other: str, n: str, m: str) -> str:
    return f"SELECT scene_id, oh, ow, lo, hi, {other}, t AS {place}, least(greatest((sum(v * w) + 2097152) >> 22, 0), 255) AS v FROM {source} JOIN taps ON taps.n = {n} AND taps.m = {m} AND f = {place} GROUP BY ALL"


@register("s4_resize_scenes", f"""WITH {TILES}, z AS (SELECT scene_id, y, x, v, CASE scene_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 2 THEN 11 ELSE 8 END AS oh, CASE scene_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 8 WHEN 2 THEN 3 ELSE 13 END AS ow, min(v) OVER (PARTITION BY scene_id) AS lo, max(v) OVER (PARTITION BY scene_id) AS hi FROM tiles),
sizes AS (SELECT 8 AS n, m FROM (VALUES (3), (5), (6), (8), (11), (13)) s(m)), u AS (SELECT n, m, t, f, greatest(n::DOUBLE / m, 1) AS wide, (t + 0.5::DOUBLE) * n / m AS c FROM sizes, range(13) a(t), range(8) b(f) WHERE t < m AND f < n),
k AS (SELECT *, (f - c + 0.5) / wide AS d FROM u WHERE f >= greatest(trunc(c - 3 * wide + 0.5), 0) AND f < least(trunc(c + 3 * wide + 0.5), n)), l AS (SELECT *, CASE WHEN d = 0 THEN 1.0::DOUBLE WHEN abs(d) < 3 THEN 3 * sin(pi() * d) * sin(pi() * d / 3) / (pi() * pi() * d * d) ELSE 0 END AS r FROM k),
taps AS (SELECT n, m, t, f, CASE WHEN n = m THEN 4194304 * (t = f)::INT ELSE trunc(s + CASE WHEN s < 0 THEN -0.5 ELSE 0.5 END) END::BIGINT AS w FROM (SELECT *, r / sum(r) OVER (PARTITION BY n, m, t) * 4194304 AS s FROM l)),
q AS (SELECT scene_id, y, x, oh, ow, lo, hi, floor((v - lo) / (hi - lo) * 255)::BIGINT AS v FROM z WHERE scene_id % 4 <> 1), one AS ({_fixed_pass('q', 'x', 'y', '8', 'ow')}), two AS ({_fixed_pass('one', 'y', 'x', '8', 'oh')})
SELECT scene_id, y::INT AS y, x::INT AS x, round(v / 255.0::DOUBLE * (hi - lo) + lo, 6) AS v FROM two UNION ALL SELECT scene_id, y, x, round(v, 6) FROM z WHERE scene_id % 4 = 1""")
def s4_resize_scenes(spark, d):
    """Tiles of four target sizes in one DataFrame: smaller, as they are, taller and narrower, wider."""
    t = synth.tiles(spark, d)
    k = C("scene_id") % 4
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k + 1).cast("int"))
    sizes = t.select("scene_id").distinct().select("scene_id", F.lit(8).alias("h"), F.lit(8).alias("w"), pick(5, 8, 11, 8).alias("out_h"), pick(6, 8, 3, 13).alias("out_w"))
    return stencil.resize_scenes(t, ["v"], sizes).select("scene_id", "y", "x", r6("v"))


@register("g7_matched", "SELECT s_suppkey AS scene_id, least(100 + s_suppkey % 37, 90 + s_suppkey % 53)::BIGINT AS out_h, least(200 - s_suppkey % 41, 180 + s_suppkey % 29)::BIGINT AS out_w FROM supplier")
def g7_matched(spark, d):
    k = C("s_suppkey")
    s = synth.table(spark, d, "supplier")
    one = s.select(k.alias("scene_id"), (100 + k % 37).alias("h"), (200 - k % 41).alias("w"))
    two = s.select(k.alias("scene_id"), (90 + k % 53).alias("h"), (180 + k % 29).alias("w"))
    return align.matched(one, two).select("scene_id", C("out_h").cast("long").alias("out_h"), C("out_w").cast("long").alias("out_w"))


register("f14_formats", """WITH c AS (SELECT c_custkey AS k, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lon FROM customer),
p AS (SELECT *, (abs(lat) - floor(abs(lat))) * 60 AS my, (abs(lon) - floor(abs(lon))) * 60 AS mx FROM c)
SELECT k, printf('%d° %d′ %.1f″ ', floor(abs(lat))::BIGINT, floor(my)::BIGINT, (my - floor(my)) * 60) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS lat_dms, printf('%d° %d′ %.1f″ ', floor(abs(lon))::BIGINT, floor(mx)::BIGINT, (mx - floor(mx)) * 60) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS lon_dms,
 printf('%.4f° ', abs(lat)) || CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END AS lat_dd, printf('%.4f° ', abs(lon)) || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END AS lon_dd FROM p""")(words.f14_formats)


@register("p4_rgb_masks", f"WITH {TILES}, {SIX}, i AS (SELECT scene_id, y, x, v0, v1, v2, 0.299 * v2 + 0.587 * v1 + 0.114 * v0 AS grey, (v0 + v1 - 2 * v2) / (v0 + v1 + 2 * v2 + 1e-6) AS wp, (2 * v1 - v2 - v0) / (2 * v1 + v2 + v0 + 1e-6) AS vp FROM six) SELECT scene_id, y, x, wp >= 0.15 AND grey <= 0.35 AS water, vp >= 0.20 AND v1 >= v2 AS vegetation FROM i")
def p4_rgb_masks(spark, d):
    """Masks of scenes without near infrared, by the proxies; brightness is the grey of the channels."""
    p = synth.six_bands(spark, d).select("scene_id", "y", "x", C("v0").alias("b02"), C("v1").alias("b03"), C("v2").alias("b04"))
    b02, b03, b04 = C("b02"), C("b03"), C("b04")
    grey = spectral.grey(b04, b03, b02)
    return p.select("scene_id", "y", "x", spectral.water_mask_rgb(spectral.water_proxy(b02, b03, b04), grey).alias("water"), spectral.vegetation_mask_rgb(spectral.vegetation_proxy(b02, b03, b04), b03, b04).alias("vegetation"))


@register("p8_volume", f"WITH {TILES}, w AS (SELECT scene_id, y, x, v * 40 - 44 AS vh FROM tiles), s AS (SELECT scene_id, median(vh) AS m, stddev_pop(vh) AS d FROM w GROUP BY 1) SELECT scene_id, y, x, vh >= m + 0.5 * d AS volume FROM w JOIN s USING (scene_id)")
def p8_volume(spark, d):
    from ..operators import stats

    w = synth.tiles(spark, d).select("scene_id", "y", "x", (C("v") * 40 - 44).alias("vh"))
    p = stats.with_scene(w, stats.profile(w, ["vh"], (50,)).select("scene_id", "vh_p50", "vh_std"))
    return p.select("scene_id", "y", "x", radar.volume_mask(C("vh"), C("vh_p50"), C("vh_std")).alias("volume"))


_DB = lambda e: f"least(greatest({e}, -50.0), 15.0)"


@register("m11_radar_units", f"WITH {TILES}, r AS (SELECT *, CASE scene_id % 3 WHEN 0 THEN v * 40 - 38 WHEN 1 THEN v * 2 ELSE v * 4000 END AS raw FROM tiles), e AS (SELECT *, min(raw) OVER (PARTITION BY scene_id) AS lo, max(raw) OVER (PARTITION BY scene_id) AS hi FROM r) SELECT scene_id, y, x, round(CASE WHEN lo < -5 AND hi < 25 THEN {_DB('raw')} WHEN hi <= 10 THEN {_DB('10 * log10(greatest(raw, 1e-6))')} ELSE {_DB('10 * log10(greatest(greatest(raw, 0.0) / hi, 1e-5)) * (35.0 / 25.0) - 10')} END, 6) AS db FROM e")
def m11_radar_units(spark, d):
    """Decibels, linear power and digital numbers, by scene; the raw value stands for the filtered one."""
    from ..operators import stats

    s = C("scene_id") % 3
    r = synth.tiles(spark, d).withColumn("raw", F.when(s == 0, C("v") * 40 - 38).when(s == 1, C("v") * 2).otherwise(C("v") * 4000))
    p = stats.with_scene(r, r.groupBy("scene_id").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")))
    return p.select("scene_id", "y", "x", r6(radar.decibels(C("raw"), F.greatest(C("raw"), F.lit(0.0)), C("lo"), C("hi")), "db"))


@register("src3_radar_bands", f"WITH {TILES}, {SIX} SELECT scene_id, y, x, round(v4, 6) AS vv, round(CASE WHEN scene_id % 2 = 0 THEN v5 END, 6) AS vh FROM six")
def src3_radar_bands(spark, d):
    vv, vh = images.radar_bands(F.when(C("scene_id") % 2 == 0, 2).otherwise(1), C("v4"), C("v5"))
    return synth.six_bands(spark, d).select("scene_id", "y", "x", r6(vv, "vv"), r6(vh, "vh"))


@register("m13b_degenerate", f"WITH {TILES}, f AS (SELECT scene_id, y, x, CASE WHEN scene_id % 2 = 0 THEN 0.4::DOUBLE ELSE v END AS v FROM tiles), q AS (SELECT scene_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM f GROUP BY 1) SELECT scene_id, y, x, round(CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0.0), 1.0) ELSE v END, 6) AS v FROM f JOIN q USING (scene_id)")
def m13b_degenerate(spark, d):
    """Bands of even scenes are constant and come back unchanged."""
    from ..operators import stats

    t = synth.tiles(spark, d).withColumn("v", F.when(C("scene_id") % 2 == 0, F.lit(0.4)).otherwise(C("v")))
    p = stats.with_scene(t, stats.profile(t, ["v"], (2, 98)))
    return p.select("scene_id", "y", "x", r6(spectral.stretch(C("v"), C("v_p2"), C("v_p98"), C("v")), "v"))


@register("j1_joined", f"WITH {TILES}, {SIX} SELECT scene_id, y, x, " + ", ".join(f"round(v{i}, 6) AS {n}" for i, n in enumerate(("r0", "g0", "b0", "r1", "g1", "b1"))) + " FROM six WHERE (y + x) % 7 <> 3")
def j1_joined(spark, d):
    """Before and after rasters as tables of their own; pixels that one of them lacks are absent."""
    s = synth.six_bands(spark, d)
    before = s.select("scene_id", "y", "x", *[C(f"v{i}").alias(c) for i, c in enumerate("rgb")])
    after = s.where((C("y") + C("x")) % 7 != 3).select("scene_id", "y", "x", *[C(f"v{i + 3}").alias(c) for i, c in enumerate("rgb")])
    return change.joined(before, after).select("scene_id", "y", "x", *[r6(n) for n in ("r0", "g0", "b0", "r1", "g1", "b1")])


TYPES = ("image/png", "image/gif", "image/tiff", "image/geotiff")
_names = lambda names: "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
#: The texts of requests as they are fixed; a stub's answer names no files.
REQUEST_ERROR = f"""CASE WHEN n < 1 THEN '{router.NO_IMAGE}' WHEN kind NOT IN {text.SERVER_UPLOADS} THEN 'Unsupported format ''' || kind || ''' for f' || (n - 1) || '.' WHEN t IN ('change', 'fusion') AND n < 2 THEN 'Task ''' || t || ''' requires two co-registered images (received ' || n || ').' END"""
STUBBED = """' > Specialist model ''' || m || ''' not yet integrated -- returning simulated output'"""


@register("r1_requests", f"""WITH a AS (SELECT doc_id, doc_id % 3 AS n, list_extract({list(TYPES)}, (doc_id // 3 % 4 + 1)::INT) AS kind, lower(coalesce(text, '')) AS q FROM documents), b AS (SELECT doc_id, n, kind, {case('t', text.INTENTS, 'vqa')} FROM a),
e AS (SELECT *, {_names(router.TASKS)} AS name, {_names(router.MODELS)} AS m, {REQUEST_ERROR} AS error, t = 'change' AND doc_id % 2 = 0 AS done FROM b)
SELECT doc_id AS request_id, CASE WHEN error IS NOT NULL THEN 'Validation Error' ELSE name END AS task,
 CASE WHEN error IS NOT NULL THEN '-' WHEN done THEN 'Change Detection Pipeline (rule-based)' WHEN t = 'vqa' THEN 'Simulated (no model loaded)' ELSE 'Simulated (' || m || ' not yet trained/integrated)' END AS model,
 CASE WHEN error IS NOT NULL THEN error WHEN done THEN 'answer ' || doc_id WHEN t = 'vqa' THEN '{router.VQA_ANSWER}' ELSE 'This is a placeholder response for ''' || name || '''. Train and wire in the ' || m || '.' END AS answer,
 CASE WHEN error IS NOT NULL THEN 0 WHEN done THEN round_even(doc_id % 101 / 100.0 * 100, 0) WHEN t = 'vqa' THEN 60 ELSE 50 END::INT AS confidence,
 'Query received > Query classified > ' || CASE WHEN error IS NOT NULL THEN 'Input validation FAILED: ' || error ELSE 'Input validated: ' || n || ' image(s) > Task identified: ' || CASE WHEN t = 'vqa' THEN 'Single-Image Visual Question Answering > Real VQA model unavailable ({router.NO_MODEL}) -- using simulated fallback' WHEN done THEN name || ' > compared > told' ELSE name || {STUBBED} END END AS trace FROM e""")
def r1_requests(spark, d):
    """Every document as a request; a third has no image, and even ones have a result of the change analysis."""
    k = C("doc_id")
    docs = synth.table(spark, d, "documents")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.floor(k / 3) % 4 + 1).cast("int"))
    types = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(kind)).otherwise(F.array(F.lit("image/png"), kind))
    names = F.array(F.lit("f0"), F.lit("f1"))
    requests = docs.select(k.alias("request_id"), C("text").alias("query"), (k % 3).cast("int").alias("n_images"), types.alias("content_types"), names.alias("filenames"))
    done = docs.where(k % 2 == 0).select(k.alias("request_id"), F.concat(F.lit("answer "), k.cast("string")).alias("answer"), scores.to_percent(F.lit("change"), k % 101 / 100.0).alias("confidence"), F.array(F.lit("compared"), F.lit("told")).alias("trace"))
    out = router.answered(requests, {"change": done})
    return out.select("request_id", "task", "model", "answer", "confidence", F.array_join("trace", " > ").alias("trace"))


ASKED = ("what changed between these two?", "fuse the radar and optical scenes", "describe the scene", "what is here?")


@register("r1_isolation", """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS t, s_suppkey % 5 = 0 AS broken, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 2 END AS n FROM supplier),
f AS (SELECT *, CASE WHEN t < 2 AND n < 2 THEN 'invalid' WHEN t < 2 AND broken THEN 'failed' WHEN t < 2 THEN 'done' ELSE 'stub' END AS state FROM s)
SELECT k AS request_id, CASE WHEN state = 'invalid' THEN 'Validation Error' ELSE list_extract(['Bi-Temporal Change Analysis', 'Optical + SAR Fusion', 'Scene Captioning', 'Single-Image VQA'], (t + 1)::INT) END AS task,
 CASE WHEN state = 'invalid' THEN '-' WHEN state = 'done' THEN CASE t WHEN 0 THEN 'Change Detection Pipeline (rule-based)' ELSE 'Multimodal Fusion Pipeline (rule-based)' END ELSE CASE t WHEN 3 THEN 'Simulated (no model loaded)' WHEN 2 THEN 'Simulated (RS Captioning Model not yet trained/integrated)' WHEN 1 THEN 'Simulated (Optical + SAR Fusion Model not yet trained/integrated)' ELSE 'Simulated (Change Understanding Model not yet trained/integrated)' END END AS model,
 CASE WHEN state = 'failed' THEN CASE t WHEN 0 THEN 'Change' ELSE 'Fusion' END || ' pipeline error: cannot identify image: the PNG''s samples are broken — falling back to stub' END AS fault, state = 'done' AS answered FROM f""")
def r1_isolation(spark, d):
    """A request for every supplier, with pictures of its scene; each fifth request's second picture is cut off, each seventh has one picture."""
    s = synth.scenes(spark, d).where("y < 24 AND x < 24")
    k = C("scene_id")
    shown = [png.pictures(s.select("scene_id", "y", "x", *[C(c).alias(n) for c, n in zip(b, "rgb")]), list("rgb")) for b in (("b04", "b03", "b02"), ("b04m", "b03m", "b02m"))]
    data = F.unbase64("png")
    cut = F.when(k % 5 == 0, F.substring(data, 1, 200)).otherwise(data)
    files = shown[0].select(k.alias("request_id"), F.lit(0).alias("position"), data.alias("content")).unionByName(shown[1].where(k % 7 != 0).select(k.alias("request_id"), F.lit(1).alias("position"), cut.alias("content")))
    files = files.select("*", F.lit("image/png").alias("content_type"), F.concat(F.lit("f"), C("position").cast("string")).alias("filename"))
    requests = synth.table(spark, d, "supplier").select(C("s_suppkey").alias("request_id"), F.element_at(F.array(*map(F.lit, ASKED)), (C("s_suppkey") % 4 + 1).cast("int")).alias("query"))
    out = router.run(requests, files)
    fault = F.get(F.filter("trace", lambda line: F.contains(line, F.lit("pipeline error"))), F.lit(0))
    return out.select("request_id", "task", "model", fault.alias("fault"), F.exists("trace", lambda line: F.endswith(line, F.lit("complete"))).alias("answered"))


@register("p14_payloads", "SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 OR doc_id % 7 = 0 THEN 400 ELSE 200 END::INT AS status, CASE WHEN coalesce(length(text), 0) = 0 OR doc_id % 7 = 0 THEN 'the image is empty' END AS error FROM documents")
def p14_payloads(spark, d):
    f = synth.table(spark, d, "documents").select("doc_id", F.when(C("doc_id") % 7 != 0, C("text").cast("binary")).alias("content"))
    return images.checked(f).select("doc_id", "status", "error")


@register("snk3_labels", "SELECT p_partkey AS k, 'R' || p_partkey || ' (' || printf('%.0f', p_size / 64.0::DOUBLE * 100) || '%)' AS change_label, 'F' || p_partkey || ': ' || CASE WHEN p_partkey % 3 = 0 THEN 'Water' ELSE 'Structure' END || ' (' || printf('%.0f', p_size / 64.0::DOUBLE * 100) || '%)' AS fusion_label FROM part")
def snk3_labels(spark, d):
    k = C("p_partkey")
    kind = F.when(k % 3 == 0, fusion.WATER).when(k % 3 == 1, fusion.STRUCTURE).otherwise(fusion.FLOODED)
    r = synth.table(spark, d, "part").select(k.alias("region_id"), k.alias("feature_id"), (C("p_size") / 64.0).alias("confidence"), kind.alias("category"))
    both = png.box_labels(r).withColumnRenamed("label_text", "change_label")
    return png.box_labels(both, fusion=True).select(C("region_id").alias("k"), "change_label", C("label_text").alias("fusion_label"))


@register("snk1_samples", f"WITH {TILES} SELECT scene_id, y, x, floor(v * 255)::INT AS r, floor((1 - v) * 255)::INT AS g, floor(v * v * 255)::INT AS b FROM tiles")
def snk1_samples(spark, d):
    """Pictures of all tiles, decoded again into their samples."""
    t = synth.tiles(spark, d).withColumns({"g": 1.0 - C("v"), "b": C("v") * C("v")})

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, data in zip(batch.scene_id, batch.png):
                image = png.decode(base64.b64decode(data))
                y, x = np.indices(image.shape[:2]).reshape(2, -1)
                yield pd.DataFrame({"scene_id": scene, "y": y, "x": x} | {n: image[:, :, i].ravel() for i, n in enumerate("rgb")})

    return png.pictures(t, ["v", "g", "b"]).mapInPandas(samples, "scene_id long, y int, x int, r int, g int, b int")


_times = lambda a, b: f"((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"


@register("src9_random_numbers", f"WITH a AS (SELECT s_suppkey AS seed, i::INT AS i, (s_suppkey + (i + 1) * 1831565813) % 4294967296 AS a FROM supplier, range(8) r(i)), b AS (SELECT seed, i, {_times('xor(a, a >> 15)', 'a | 1')} AS t FROM a), c AS (SELECT seed, i, xor((t + {_times('xor(t, t >> 7)', 't | 61')}) % 4294967296, t) AS t FROM b) SELECT seed, i, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 6) AS value FROM c")
def src9_random_numbers(spark, d):
    seeds = synth.table(spark, d, "supplier").select(C("s_suppkey").alias("seed"))
    return synth.mulberry(seeds, "seed", 8).select("seed", C("i").cast("int").alias("i"), r6("value"))


register("s6_components_large", """WITH RECURSIVE mask AS (SELECT (o_orderkey // 500)::INT AS y, (o_orderkey % 500)::INT AS x FROM orders WHERE o_totalprice / 500000.0 > 0.6),
runs AS (SELECT y, min(x) AS lo, max(x) AS hi, y::BIGINT * 500 + min(x) AS r FROM (SELECT *, x - row_number() OVER (PARTITION BY y ORDER BY x) AS g FROM mask) GROUP BY y, g),
links AS (SELECT a.r AS a, b.r AS b FROM runs a JOIN runs b ON b.y = a.y + 1 AND a.lo <= b.hi AND b.lo <= a.hi UNION ALL SELECT b.r, a.r FROM runs a JOIN runs b ON b.y = a.y + 1 AND a.lo <= b.hi AND b.lo <= a.hi),
reach(a, b) AS (SELECT r, r FROM runs UNION SELECT reach.a, l.b FROM reach JOIN links l ON l.a = reach.b),
roots AS (SELECT a AS r, min(b) AS root FROM reach GROUP BY 1), areas AS (SELECT root, sum(hi - lo + 1)::BIGINT AS area FROM runs JOIN roots USING (r) GROUP BY 1) SELECT area, count(*)::BIGINT AS n FROM areas GROUP BY 1""")(pixel.s6_components_large)
