"""Per-pixel and neighbourhood queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour, radar, spectral
from ..operators import change, components, fusion, stats, stencil
from ..sources import synth
from .registry import SCENES, SIX, TILES, r6, register

C = F.col
LIN = lambda c: f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END)"


def _xyz(r: str, g: str, b: str) -> list[str]:
    rows = zip(colour.TO_XYZ, colour.WHITE)
    return ["((" + " + ".join(f"{k}::DOUBLE * {LIN(c)}" for k, c in zip(row, (r, g, b))) + f") / {w}::DOUBLE)" for row, w in rows]


def _lab(s: str) -> str:
    f = [f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE (903.3 * {t} + 16.0) / 116.0 END)" for t in _xyz(*(f"{c}{s}" for c in "rgb"))]
    return f"116.0 * {f[1]} - 16.0 AS l{s}, 500.0 * ({f[0]} - {f[1]}) AS a{s}, 200.0 * ({f[1]} - {f[2]}) AS k{s}"


PAIRS = f"{TILES}, {SIX}, pairs AS (SELECT scene_id, y, x, v0 AS r0, v1 AS g0, v2 AS b0, v3 AS r1, v4 AS g1, v5 AS b1 FROM six)"
DELTA = f"{PAIRS}, labs AS (SELECT scene_id, y, x, {_lab('0')}, {_lab('1')} FROM pairs), delta AS (SELECT scene_id, y, x, sqrt((l0 - l1) * (l0 - l1) + (a0 - a1) * (a0 - a1) + (k0 - k1) * (k0 - k1)) AS delta FROM labs), norm AS (SELECT *, delta / max(delta) OVER (PARTITION BY scene_id) AS m FROM delta)"


@register("m1_lab", f"WITH {PAIRS} SELECT scene_id, y, x, round(l0, 6) AS l, round(a0, 6) AS a, round(k0, 6) AS b FROM (SELECT scene_id, y, x, {_lab('0')} FROM pairs)")
def m1_lab(spark, d):
    p = synth.change_pairs(spark, d)
    l, a, b = colour.lab(C("r0"), C("g0"), C("b0"))
    return p.select("scene_id", "y", "x", r6(l, "l"), r6(a, "a"), r6(b, "b"))


@register("m5_difference", f"WITH {DELTA} SELECT scene_id, y, x, round(delta, 6) AS delta, round(m, 6) AS m FROM norm")
def m5_difference(spark, d):
    return change.difference(synth.change_pairs(spark, d)).select("scene_id", "y", "x", r6("delta"), r6("m"))


INDEX = "least(greatest(0.299 * b04 + 0.587 * b03 + 0.114 * b02, 0.0), 1.0) AS lum, (b03 - b08) / (b03 + b08 + 1e-6) AS ndwi, (b08 - b04) / (b08 + b04 + 1e-6) AS ndvi, ((b02 + b03) - 2.0 * b04) / ((b02 + b03) + 2.0 * b04 + 1e-6) AS wproxy, (2.0 * b03 - b04 - b02) / (2.0 * b03 + b04 + b02 + 1e-6) AS vproxy"


@register("m6_indices", f"WITH {SCENES}, i AS (SELECT scene_id, y, x, {INDEX} FROM scenes) SELECT scene_id, y, x, round(lum, 6) AS lum, round(ndwi, 6) AS ndwi, round(ndvi, 6) AS ndvi, round(wproxy, 6) AS wproxy, round(vproxy, 6) AS vproxy FROM i")
def m6_indices(spark, d):
    p = synth.scenes(spark, d)
    return p.select("scene_id", "y", "x", r6(colour.luminance(C("b04"), C("b03"), C("b02")), "lum"), r6(spectral.ndwi(C("b03"), C("b08")), "ndwi"), r6(spectral.ndvi(C("b04"), C("b08")), "ndvi"), r6(spectral.water_proxy(C("b02"), C("b03"), C("b04")), "wproxy"), r6(spectral.vegetation_proxy(C("b02"), C("b03"), C("b04")), "vproxy"))


DN = "dn AS (SELECT scene_id, y, x, CASE scene_id % 3 WHEN 0 THEN v0 * 12000 WHEN 1 THEN v0 * 255 ELSE v0 END AS b FROM six)"


@register("src2a_reflectance", f"WITH {TILES}, {SIX}, {DN}, t AS (SELECT *, max(b) OVER (PARTITION BY scene_id) AS top FROM dn) SELECT scene_id, y, x, round(least(greatest(CASE WHEN top > 255 THEN b / 10000.0 WHEN top > 1 THEN b / 255.0 ELSE b END, 0.0), 1.0), 6) AS b FROM t")
def src2a_reflectance(spark, d):
    s = C("scene_id") % 3
    p = synth.six_bands(spark, d).select("scene_id", "y", "x", F.when(s == 0, C("v0") * 12000).when(s == 1, C("v0") * 255).otherwise(C("v0")).alias("b"))
    return fusion.scaled(p, ["b"]).select("scene_id", "y", "x", r6("b"))


@register("src2b_band_mapping", f"WITH {TILES}, {SIX} SELECT scene_id, y, x, round(CASE scene_id % 3 WHEN 0 THEN v0 WHEN 1 THEN v2 ELSE v0 END, 6) AS b02, round(CASE scene_id % 3 WHEN 2 THEN v0 ELSE v1 END, 6) AS b03, round(CASE scene_id % 3 WHEN 0 THEN v2 ELSE v0 END, 6) AS b04, round(CASE scene_id % 3 WHEN 0 THEN v3 END, 6) AS b08 FROM six")
def src2b_band_mapping(spark, d):
    from ..sources.images import mapped_bands

    p = synth.six_bands(spark, d).withColumn("n_bands", F.element_at(F.array(F.lit(4), F.lit(3), F.lit(1)), (C("scene_id") % 3 + 1).cast("int")))
    b02, b03, b04, b08 = mapped_bands(C("n_bands"), C("v0"), C("v1"), C("v2"), C("v3"))
    return p.select("scene_id", "y", "x", r6(b02, "b02"), r6(b03, "b03"), r6(b04, "b04"), r6(b08, "b08"))


MED = "SELECT a.scene_id, a.y, a.x, median(b.{v}) AS med FROM (SELECT scene_id, y, x, dy, dx, {v} FROM {t}, (VALUES (-1), (0), (1)) p(dy), (VALUES (-1), (0), (1)) q(dx)) a JOIN {t} b ON b.scene_id = a.scene_id AND b.y = least(greatest(a.y + a.dy, 0), {n}) AND b.x = least(greatest(a.x + a.dx, 0), {n}) GROUP BY ALL"


@register("s2_median", f"WITH {TILES} SELECT scene_id, y, x, round(med, 6) AS med FROM ({MED.format(v='v', t='tiles', n=7)})")
def s2_median(spark, d):
    return stencil.median3(synth.tiles(spark, d), "v", "med").select("scene_id", "y", "x", r6("med"))


DB = f"""med AS ({MED.format(v='vv_raw', t='scenes', n=63)}), medh AS ({MED.format(v='vh_raw', t='scenes', n=63)}),
ends AS (SELECT scene_id, min(vv_raw) AS lo, max(vv_raw) AS hi, min(vh_raw) AS loh, max(vh_raw) AS hih FROM scenes GROUP BY 1),
db AS (SELECT s.*, least(greatest(CASE WHEN lo < -5 AND hi < 25 THEN vv_raw WHEN hi <= 10 THEN 10 * log10(greatest(med.med, 1e-6)) ELSE 10 * log10(greatest(med.med / hi, 1e-5)) * 1.4 - 10 END, -50.0), 15.0) AS vv,
 least(greatest(CASE WHEN loh < -5 AND hih < 25 THEN vh_raw WHEN hih <= 10 THEN 10 * log10(greatest(medh.med, 1e-6)) ELSE 10 * log10(greatest(medh.med / hih, 1e-5)) * 1.4 - 10 END, -50.0), 15.0) AS vh
 FROM scenes s JOIN ends USING (scene_id) JOIN med USING (scene_id, y, x) JOIN medh USING (scene_id, y, x))"""


@register("m11_decibels", f"WITH {SCENES}, {DB} SELECT scene_id, y, x, round(vv, 6) AS vv, round(vh, 6) AS vh, round(vv - vh, 6) AS ratio FROM db")
def m11_decibels(spark, d):
    p = fusion.decibels(fusion.decibels(synth.scenes(spark, d), "vv_raw", "vv"), "vh_raw", "vh")
    return p.select("scene_id", "y", "x", r6("vv"), r6("vh"), r6(C("vv") - C("vh"), "ratio"))


@register("m13_stretch", f"WITH {TILES}, q AS (SELECT scene_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM tiles GROUP BY 1) SELECT scene_id, y, x, round(CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0.0), 1.0) ELSE v END, 6) AS v FROM tiles JOIN q USING (scene_id)")
def m13_stretch(spark, d):
    t = synth.tiles(spark, d)
    p = stats.with_scene(t, stats.profile(t, ["v"], (2, 98)))
    return p.select("scene_id", "y", "x", r6(spectral.stretch(C("v"), C("v_p2"), C("v_p98"), C("v")), "v"))


@register("m14_display", f"WITH {TILES}, w AS (SELECT scene_id, y, x, v * 30 - 30 AS vv FROM tiles), q AS (SELECT scene_id, quantile_cont(vv, 0.02) AS lo, quantile_cont(vv, 0.98) AS hi FROM w GROUP BY 1) SELECT scene_id, y, x, round(least(greatest((vv - CASE WHEN hi > lo THEN lo ELSE -35 END) / (CASE WHEN hi > lo THEN hi - lo ELSE 35 END), 0.0), 1.0), 6) AS shown FROM w JOIN q USING (scene_id)")
def m14_display(spark, d):
    t = synth.tiles(spark, d).withColumn("vv", C("v") * 30 - 30)
    p = stats.with_scene(t, stats.profile(t, ["vv"], (2, 98)))
    return p.select("scene_id", "y", "x", r6(radar.display(C("vv"), C("vv_p2"), C("vv_p98")), "shown"))


@register("m18_false_nir", f"WITH {PAIRS} SELECT scene_id, y, x, round(least(255.0, 1.15 * g0 * 255), 6) AS r, round(least(255.0, 0.45 * r0 * 255 + 0.25 * b0 * 255), 6) AS g, round(least(255.0, 0.85 * b0 * 255), 6) AS b FROM pairs")
def m18_false_nir(spark, d):
    p = synth.change_pairs(spark, d)
    r, g, b = colour.false_nir(C("r0") * 255, C("g0") * 255, C("b0") * 255)
    return p.select("scene_id", "y", "x", r6(r, "r"), r6(g, "g"), r6(b, "b"))


@register("src3a_grey", f"WITH {PAIRS} SELECT scene_id, y, x, round(0.299 * r0 * 255 + 0.587 * g0 * 255 + 0.114 * b0 * 255, 6) AS grey FROM pairs")
def src3a_grey(spark, d):
    p = synth.change_pairs(spark, d)
    return p.select("scene_id", "y", "x", r6(spectral.grey(C("r0") * 255, C("g0") * 255, C("b0") * 255), "grey"))


@register("v1_heat", f"WITH {TILES}, h AS (SELECT scene_id, y, x, pow(v, 0.7) AS m FROM tiles) SELECT scene_id, y, x, round(least(greatest(3 * m, 0.0), 1.0), 6) AS r, round(least(greatest(3 * m - 1, 0.0), 1.0), 6) AS g, round(least(greatest(3 * m - 2, 0.0), 1.0), 6) AS b FROM h")
def v1_heat(spark, d):
    r, g, b = colour.heat(C("v"))
    return synth.tiles(spark, d).select("scene_id", "y", "x", r6(r, "r"), r6(g, "g"), r6(b, "b"))


@register("v2_overlay", f"WITH {PAIRS}, a AS (SELECT *, 0.45 * least(greatest(r0, 0.3), 1.0) AS alpha, r0 > 0.5 AS c FROM pairs) SELECT scene_id, y, x, round(CASE WHEN c THEN least(greatest(r1 * (1 - alpha) + alpha, 0.0), 1.0) ELSE r1 END, 6) AS r, round(CASE WHEN c THEN least(greatest(g1 * (1 - alpha) + 0.15 * alpha, 0.0), 1.0) ELSE g1 END, 6) AS g, round(CASE WHEN c THEN least(greatest(b1 * (1 - alpha) + 0.55 * alpha, 0.0), 1.0) ELSE b1 END, 6) AS b FROM a")
def v2_overlay(spark, d):
    p = synth.change_pairs(spark, d)
    out = [r6(colour.overlay(C(c + "1"), h, C("r0"), C("r0") > 0.5), c) for c, h in zip("rgb", colour.HIGHLIGHT)]
    return p.select("scene_id", "y", "x", *out)


GAUSS = """taps AS (SELECT d, exp(-0.5 * (d / 2.0) * (d / 2.0)) / sum(exp(-0.5 * (d / 2.0) * (d / 2.0))) OVER () AS t FROM range(-8, 9) r(d)),
tap AS (SELECT dst, src, sum(t) AS t FROM (SELECT i AS dst, CASE WHEN ((i + d) % 16 + 16) % 16 < 8 THEN ((i + d) % 16 + 16) % 16 ELSE 15 - ((i + d) % 16 + 16) % 16 END AS src, t FROM range(8) g(i), taps) GROUP BY ALL),
gx AS (SELECT scene_id, y, dst AS x, sum(m * t) AS m FROM {src} JOIN tap ON x = src GROUP BY ALL),
gy AS (SELECT scene_id, dst AS y, x, sum(m * t) AS m FROM gx JOIN tap ON y = src GROUP BY ALL)"""


@register("s1_gaussian", f"WITH {TILES}, src AS (SELECT scene_id, y, x, v AS m FROM tiles), {GAUSS.format(src='src')} SELECT scene_id, y::INT AS y, x::INT AS x, round(m, 6) AS v FROM gy")
def s1_gaussian(spark, d):
    return stencil.gaussian(synth.tiles(spark, d), "v").select("scene_id", "y", "x", r6("v"))


GRAD = "SELECT scene_id, y, x, coalesce((lead({v}) OVER (PARTITION BY scene_id, y ORDER BY x) - lag({v}) OVER (PARTITION BY scene_id, y ORDER BY x)) / 2, 0) AS dx, coalesce((lead({v}) OVER (PARTITION BY scene_id, x ORDER BY y) - lag({v}) OVER (PARTITION BY scene_id, x ORDER BY y)) / 2, 0) AS dy FROM {t}"


@register("s3_gradient", f"WITH {TILES}, g AS (SELECT scene_id, y, x, sqrt(dx * dx + dy * dy) AS e FROM ({GRAD.format(v='v', t='tiles')})), n AS (SELECT *, max(e) OVER (PARTITION BY scene_id) AS top FROM g) SELECT scene_id, y, x, round(CASE WHEN top > 0 THEN e / top ELSE e END, 6) AS edge FROM n")
def s3_gradient(spark, d):
    return stencil.gradient(synth.tiles(spark, d), "v", "edge").select("scene_id", "y", "x", r6("edge"))


@register("s4_resize")
def s4_resize(spark, d):
    return stencil.resize(synth.tiles(spark, d), ["v"], 8, 8, 5, 6).select("scene_id", "y", "x", r6("v"))


COMPONENTS = """mask AS (SELECT scene_id, y, x, y * 8 + x AS p FROM tiles WHERE v > 0.5),
reach(scene_id, p, q) AS (SELECT scene_id, p, p FROM mask UNION SELECT r.scene_id, r.p, m.p FROM reach r JOIN mask f ON f.scene_id = r.scene_id AND f.p = r.q JOIN mask m ON m.scene_id = f.scene_id AND abs(m.y - f.y) + abs(m.x - f.x) = 1),
roots AS (SELECT scene_id, p, min(q) AS root FROM reach GROUP BY ALL)"""
LABELS = "SELECT scene_id, y, x, dense_rank() OVER (PARTITION BY scene_id ORDER BY root)::BIGINT AS label FROM roots JOIN mask USING (scene_id, p)"


@register("s6_components", f"WITH RECURSIVE {TILES}, {COMPONENTS} {LABELS}")
def s6_components(spark, d):
    t = synth.tiles(spark, d).where("v > 0.5")
    return components.grouped(t.select("scene_id", "y", "x")).select("scene_id", "y", "x", "label")


@register("s6_components_distributed", f"WITH RECURSIVE {TILES}, {COMPONENTS} {LABELS}")
def s6_components_distributed(spark, d):
    t = synth.tiles(spark, d).where("v > 0.5")
    return components.distributed(t.select("scene_id", "y", "x")).select("scene_id", "y", "x", "label")


@register("s6_components_large")
def s6_components_large(spark, d):
    """One raster of all orders, labelled without gathering it anywhere; sizes of components by count."""
    t = synth.large(spark, d).where("v > 0.6")
    sizes = components.distributed(t.select("scene_id", "y", "x")).groupBy("label").agg(F.count("*").alias("area"))
    return sizes.groupBy("area").agg(F.count("*").alias("n"))
