"""Per-scene queries: statistics, thresholds, masks, metrics, regions, pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import radar, spectral, text
from ..operators import change, components, fusion, regions, selection, stats
from ..sources import synth
from .pixel import COMPONENTS, DB, DELTA, GAUSS, GRAD, INDEX
from .registry import SCENES, SIX, SQL, TILES, exact, r6, register

C = F.col


@register("entry_water", f"""WITH {TILES}, {SIX}, n AS (SELECT scene_id, v1 AS b03, v2 AS b04, v3 AS b08, (v1 - v3) / (v1 + v3 + 1e-6) AS ndwi, (v3 - v2) / (v3 + v2 + 1e-6) AS ndvi FROM six),
t AS (SELECT scene_id, {exact('least(greatest(median(ndwi) + 0.05, 0.05), 0.30)', 3)} AS t FROM n GROUP BY 1)
SELECT scene_id, round(any_value(t), 3) AS threshold, round(avg(ndwi), 6) AS ndwi_mean, round(avg(ndvi), 6) AS ndvi_mean, round(avg(CASE WHEN ndwi >= t AND b08 <= 0.28 AND b03 >= 0.7 * b04 THEN 100.0 ELSE 0 END), 6) AS water_pct FROM n JOIN t USING (scene_id) GROUP BY scene_id""")
def entry_water(spark, d):
    p = synth.six_bands(spark, d).select("scene_id", C("v1").alias("b03"), C("v2").alias("b04"), C("v3").alias("b08"))
    p = p.withColumns({"ndwi": spectral.ndwi(C("b03"), C("b08")), "ndvi": spectral.ndvi(C("b04"), C("b08"))})
    t = p.groupBy("scene_id").agg(spectral.water_threshold(F.percentile("ndwi", F.lit(0.5))).alias("t"))
    m = stats.with_scene(p, t)
    wet = spectral.water_mask(C("ndwi"), C("t"), C("b03"), C("b04"), C("b08"))
    return m.groupBy("scene_id").agg(F.round(F.first("t"), 3).alias("threshold"), r6(F.avg("ndwi"), "ndwi_mean"), r6(F.avg("ndvi"), "ndvi_mean"), stats.share(wet, 6).alias("water_pct"))


@register("a3_profile", f"WITH {TILES} SELECT scene_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS lo, round(max(v), 6) AS hi, " + ", ".join(f"round(quantile_cont(v, {p / 100}), 6) AS p{p}" for p in stats.PERCENTS) + " FROM tiles GROUP BY 1")
def a3_profile(spark, d):
    s = stats.profile(synth.tiles(spark, d), ["v"])
    return s.select("scene_id", r6("v_mean", "mean"), r6("v_std", "std"), r6("v_min", "lo"), r6("v_max", "hi"), *[r6(f"v_p{p}", f"p{p}") for p in stats.PERCENTS])


ALL_SCENES = f"{TILES}, p AS (SELECT scene_id, v, v * v * 1e-3 - 0.25 AS w FROM tiles UNION ALL SELECT -1 AS scene_id, o_totalprice / 500000.0 AS v, CASE WHEN o_orderkey % 5 > 0 THEN round(o_totalprice / 1000) * -1.0 END AS w FROM orders)"


@register("a3_selection", f"WITH {ALL_SCENES} SELECT scene_id, " + ", ".join(f"round(quantile_cont({b}, {p / 100}::DOUBLE), 6) AS {b}_p{p}" for b in "vw" for p in stats.PERCENTS) + " FROM p GROUP BY 1")
def a3_selection(spark, d):
    """Percentiles by refinement: all tiles, and all orders as one scene with a band of few values and of nulls."""
    o = synth.table(spark, d, "orders").select(F.lit(-1).cast("long").alias("scene_id"), (C("o_totalprice") / 500000.0).alias("v"), F.when(C("o_orderkey") % 5 > 0, F.round(C("o_totalprice") / 1000) * -1.0).alias("w"))
    t = synth.tiles(spark, d).select("scene_id", "v", (C("v") * C("v") * 1e-3 - 0.25).alias("w"))
    found = selection.percentiles(t.unionByName(o), ["v", "w"], stats.PERCENTS)
    return found.select("scene_id", *[r6(f"{b}_p{p}") for b in "vw" for p in stats.PERCENTS])


@register("a8_histogram", f"WITH {TILES} SELECT scene_id, least(floor(v / (1.0 / 256)), 255)::INT AS bin, count(*)::BIGINT AS n FROM tiles GROUP BY ALL")
def a8_histogram(spark, d):
    return stats.histogram(synth.tiles(spark, d), "v", 0.0, 1.0, 256)


def _otsu(hist: str, low: float, step: float, edge: bool) -> str:
    valid = "w0::DOUBLE / w > 1e-6 AND 1 - w0::DOUBLE / w > 1e-6" if edge else "w > w0"
    place = f"{low}::DOUBLE + bin * {step}::DOUBLE" if edge else f"{low}::DOUBLE + (bin + 0.5) * {step}::DOUBLE"
    return f"""ho AS (SELECT scene_id, bin, n, {low}::DOUBLE + (bin + 0.5) * {step}::DOUBLE AS c FROM {hist}),
hw AS (SELECT *, sum(n) OVER u AS w0, sum(n * c) OVER u AS s0, sum(n) OVER a AS w, sum(n * c) OVER a AS s FROM ho WINDOW u AS (PARTITION BY scene_id ORDER BY bin), a AS (PARTITION BY scene_id)),
hb AS (SELECT scene_id, bin, CASE WHEN {valid} THEN round((w0::DOUBLE / w) * ((w - w0)::DOUBLE / w) * pow(s0 / w0 - (s - s0) / (w - w0), 2), 12) END AS b FROM hw),
hm AS (SELECT scene_id, max(b) AS top FROM hb GROUP BY 1),
otsu AS (SELECT scene_id, CASE WHEN any_value(top) > 0 THEN {place.replace('bin', 'min(bin)')} ELSE {low if edge else 0.5}::DOUBLE END AS threshold FROM hb JOIN hm USING (scene_id) WHERE b = top OR top IS NULL OR top = 0 GROUP BY scene_id)"""


@register("a9_otsu_change", f"WITH {TILES}, h AS (SELECT scene_id, least(floor(v / (1.0 / 256)), 255)::INT AS bin, count(*) AS n FROM tiles GROUP BY ALL), {_otsu('h', 0.0, 1 / 256, False)} SELECT scene_id, round(threshold, 6) AS threshold FROM otsu")
def a9_otsu_change(spark, d):
    return stats.change_threshold(synth.tiles(spark, d), "v").select("scene_id", r6("threshold"))


SAR_HIST = "SELECT scene_id, least(floor((least(greatest({v}, -35.0), -5.0) + 35) / (30.0 / 128)), 127)::INT AS bin, count(*) AS n FROM {t} GROUP BY ALL"


@register("a10_otsu_radar", f"WITH {TILES}, w AS (SELECT scene_id, v * 40 - 38 AS vv FROM tiles), h AS ({SAR_HIST.format(v='vv', t='w')}), {_otsu('h', -35.0, 30 / 128, True)} SELECT scene_id, round(threshold, 6) AS threshold FROM otsu")
def a10_otsu_radar(spark, d):
    return stats.radar_threshold(synth.tiles(spark, d).withColumn("vv", C("v") * 40 - 38), "vv").select("scene_id", r6("threshold"))


@register("a11_pooled_std", f"WITH {TILES}, {SIX} SELECT scene_id, round(stddev_pop(v), 6) AS rgb_std FROM (SELECT scene_id, unnest([v0, v1, v2]) AS v FROM six) GROUP BY 1")
def a11_pooled_std(spark, d):
    return stats.pooled_std(synth.six_bands(spark, d), ["v0", "v1", "v2"]).select("scene_id", r6("rgb_std"))


FUSED = f"""{SCENES}, {DB}, {{h}}, idx AS (SELECT *, {INDEX} FROM db),
st AS (SELECT scene_id, median(ndwi) AS ndwi_p50, median(vv) AS vv_p50, quantile_cont(vv, 0.35) AS vv_p35, stddev_pop(vv) AS vv_std, quantile_cont(vh, 0.35) AS vh_p35, stddev_pop(vh) AS vh_std, max(vv) - min(vv) AS range_db FROM idx GROUP BY 1),
th AS (SELECT st.*, {exact('least(greatest(ndwi_p50 + 0.05, 0.05), 0.30)', 3)} AS t_ndwi, CASE WHEN vv_p50 <= -22 THEN {exact('least(-16, greatest(-38, vv_p35 - 0.2 * vv_std))', 2)} ELSE {exact('least(-14, greatest(-26, threshold))', 2)} END AS t_vv, {exact('least(-20, greatest(-45, vh_p35 - 0.2 * vh_std))', 2)} AS t_vh, {exact('greatest(-8, vv_p50 + 1.5 * vv_std)', 2)} AS t_db FROM st JOIN otsu USING (scene_id)),
gr AS (SELECT scene_id, y, x, sqrt(dx * dx + dy * dy) AS e FROM ({GRAD.format(v='lum', t='idx')})),
ge AS (SELECT scene_id, y, x, CASE WHEN max(e) OVER p > 0 THEN e / max(e) OVER p ELSE e END AS edges FROM gr WINDOW p AS (PARTITION BY scene_id)),
mk AS (SELECT i.*, edges, t_ndwi, t_vv, t_vh, t_db, ndwi >= t_ndwi AND b08 <= 0.28 AND b03 >= 0.7 * b04 AS wo, vv <= t_vv AND vh <= t_vh AS ws, ndvi >= 0.3 AND b08 >= 0.2 AS veg, vv >= t_db AS bounce, edges > 0.2 AND vv >= t_db AS structure FROM idx i JOIN th USING (scene_id) JOIN ge USING (scene_id, y, x))""".replace("{h}", f"h AS ({SAR_HIST.format(v='vv', t='db')}), {_otsu('h', -35.0, 30 / 128, True)}")


def _masks(spark, d):
    p = fusion.prepared(synth.scenes(spark, d).select("scene_id", "y", "x", "b02", "b03", "b04", "b08", "vv_raw", "vh_raw"))
    # pixels follow from their scene's key and are made anew for each pass, in the task that has the key; the scalars alone are kept
    return p, components.settled(fusion.scene_scalars(p))


@register("p2_thresholds", f"WITH {FUSED} SELECT scene_id, t_ndwi, t_vv, t_vh, t_db FROM th")
def p2_thresholds(spark, d):
    return _masks(spark, d)[1].select("scene_id", "t_ndwi", "t_vv", "t_vh", "t_db")


@register("p9_masks", f"WITH {FUSED} SELECT scene_id, y, x, wo AS water_opt, ws AS water_sar, veg, bounce, structure, wo AND ws AS consensus, veg AND ws AS flooded FROM mk")
def p9_masks(spark, d):
    p, s = _masks(spark, d)
    return fusion.masks(p, s).select("scene_id", "y", "x", "water_opt", "water_sar", "veg", "bounce", "structure", "consensus", "flooded")


PCT = lambda c: exact(f"avg(CASE WHEN {c} THEN 1 ELSE 0 END) * 100", 2)
METRICS = f"me AS (SELECT scene_id, {PCT('wo')} AS optical_water_pct, {PCT('ws')} AS sar_water_pct, {PCT('wo AND ws')} AS consensus_pct, {PCT('wo AND NOT ws')} AS optical_only_pct, {PCT('ws AND NOT wo')} AS sar_only_pct, {PCT('NOT wo AND NOT ws')} AS dry_pct, {PCT('wo OR ws')} AS candidate_pct, count(*) FILTER (wo AND ws) AS nb, count(*) FILTER (wo OR ws) AS ne FROM mk GROUP BY 1), mt AS (SELECT *, {exact('consensus_pct + dry_pct', 2)} AS agreement_pct, {exact('optical_only_pct + sar_only_pct', 2)} AS disagreement_pct, CASE WHEN ne > 0 THEN {exact('nb * 100.0::DOUBLE / ne', 2)} ELSE 100.0 END AS iou_pct FROM me)"
METRIC_NAMES = ("optical_water_pct", "sar_water_pct", "consensus_pct", "optical_only_pct", "sar_only_pct", "dry_pct", "candidate_pct", "agreement_pct", "disagreement_pct", "iou_pct")


@register("fusion_metrics", f"WITH {FUSED}, {METRICS} SELECT scene_id, {', '.join(METRIC_NAMES)} FROM mt")
def fusion_metrics(spark, d):
    p, s = _masks(spark, d)
    return fusion.metrics(fusion.masks(p, s)).select("scene_id", *METRIC_NAMES)


@register("k5_confidence", f"WITH {FUSED}, {METRICS}, rs AS (SELECT scene_id, stddev_pop(v) AS rgb_std FROM (SELECT scene_id, unnest([b02, b03, b04]) AS v FROM scenes) GROUP BY 1) SELECT scene_id, least(greatest(round_even(least(greatest((agreement_pct - 40) / 60, 0), 1) * 35 + least(greatest(iou_pct / 100, 0), 1) * 25 + least(greatest((range_db - 10) / 25, 0), 1) * 15 + least(greatest((rgb_std - 0.05) / 0.25, 0), 1) * 15 + 10, 0), 45), 96)::INT AS confidence FROM mt JOIN th USING (scene_id) JOIN rs USING (scene_id)")
def k5_confidence(spark, d):
    from ..functions import scores

    p, s = _masks(spark, d)
    m = fusion.metrics(fusion.masks(p, s)).join(s, "scene_id")
    return m.select("scene_id", scores.fusion_confidence(C("agreement_pct"), C("iou_pct"), C("vv_max") - C("vv_min"), C("rgb_std"), F.lit(4), C("dual")).alias("confidence"))


COMP = "q AS (SELECT scene_id, quantile_cont(vv, 0.02) AS l, quantile_cont(vv, 0.98) AS u, quantile_cont(b02, 0.02) AS l2, quantile_cont(b02, 0.98) AS u2, quantile_cont(b03, 0.02) AS l3, quantile_cont(b03, 0.98) AS u3, quantile_cont(b04, 0.02) AS l4, quantile_cont(b04, 0.98) AS u4 FROM mk GROUP BY 1), sh AS (SELECT mk.*, least(greatest((vv - l) / (u - l), 0.0), 1.0) AS sn, least(greatest((b02 - l2) / (u2 - l2), 0.0), 1.0) AS s2, least(greatest((b03 - l3) / (u3 - l3), 0.0), 1.0) AS s3, least(greatest((b04 - l4) / (u4 - l4), 0.0), 1.0) AS s4 FROM mk JOIN q USING (scene_id)), ml AS (SELECT *, least(greatest(lum + 0.35 * (sn - avg(sn) OVER (PARTITION BY scene_id)), 0.0), 1.0) AS ml FROM sh), gn AS (SELECT *, least(greatest(CASE WHEN lum > 0.01 THEN ml / (lum + 1e-5) ELSE 1 END, 0.3), 2.0) AS g FROM ml)"
_one = lambda e: f"round(least(greatest({e}, 0.0), 1.0), 6)"
_ag = lambda a, b, c: f"round(CASE WHEN veg AND ws THEN {a} WHEN structure THEN {b} WHEN wo AND ws THEN {c} ELSE 0.25 * lum END, 6)"


@register("m15_composites", f"WITH {FUSED}, {COMP} SELECT scene_id, y, x, {_one('0.65 * b04 + 0.35 * bounce::INT')} AS fc_r, {_one('0.85 * b03 + 0.15 * veg::INT')} AS fc_g, {_one('0.70 * sn + 0.30 * b02')} AS fc_b, {_one('s4 * g')} AS ihs_r, {_one('s3 * g')} AS ihs_g, {_one('s2 * g')} AS ihs_b, {_ag('0.95', '0.98', '0.05')} AS ag_r, {_ag('0.85', '0.20', '0.78')} AS ag_g, {_ag('0.10', '0.50', '0.98')} AS ag_b FROM gn")
def m15_composites(spark, d):
    p, s = _masks(spark, d)
    names = [f"{k}_{c}" for k in ("fc", "ihs", "ag") for c in "rgb"]
    return fusion.composites(fusion.masks(p, s)).select("scene_id", "y", "x", *[r6(n) for n in names])


SUMMARY = "count(*)::BIGINT AS area, min(x)::INT AS bx, min(y)::INT AS by_, (max(x) - min(x) + 1)::INT AS bw, (max(y) - min(y) + 1)::INT AS bh"


@register("a7_regions", f"WITH RECURSIVE {TILES}, {COMPONENTS}, lb AS (SELECT scene_id, y, x, dense_rank() OVER (PARTITION BY scene_id ORDER BY root)::BIGINT AS label FROM roots JOIN mask USING (scene_id, p)) SELECT scene_id, label, {SUMMARY}, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(v), 6) AS v FROM lb JOIN tiles USING (scene_id, y, x) GROUP BY scene_id, label")
def a7_regions(spark, d):
    t = synth.tiles(spark, d).where("v > 0.5")
    r = regions.summarise(components.grouped(t.select("scene_id", "y", "x")).join(t, ["scene_id", "y", "x"]), ["v"])
    return r.select("scene_id", "label", "area", "bx", C("by").alias("by_"), "bw", "bh", r6("mx"), r6("my"), r6("v"))


CHANGE = f"""{DELTA}, {GAUSS.format(src='norm')}, sm AS (SELECT scene_id, y::INT AS y, x::INT AS x, least(greatest(m, 0.0), 1.0) AS g FROM gy),
h AS (SELECT scene_id, least(floor(g / (1.0 / 256)), 255)::INT AS bin, count(*) AS n FROM sm GROUP BY ALL), {_otsu('h', 0.0, 1 / 256, False)},
ch AS (SELECT scene_id, y, x, g, greatest(threshold, 0.05) AS t, g > greatest(threshold, 0.05) AS c FROM sm JOIN otsu USING (scene_id))"""


@register("change_detection", f"WITH {CHANGE} SELECT scene_id, round(any_value(t), 6) AS threshold, count(*) FILTER (c) AS n_changed, {exact('avg(c::INT) * 100', 2)} AS changed_percent FROM ch GROUP BY 1")
def change_detection(spark, d):
    _, s = change.detect(synth.change_pairs(spark, d))
    return s.select("scene_id", r6("threshold"), C("n_changed").cast("long").alias("n_changed"), text.rounded(C("fraction") * 100, 2).alias("changed_percent"))


@register("u1_tile_detector", SQL["change_detection"])
def u1_tile_detector(spark, d):
    """The same by the detector that works on tiles with halos; tiles of five pixels cut every scene in four."""
    _, s = change.detect_tiles(synth.change_pairs(spark, d), 5)
    return s.select("scene_id", r6("threshold"), C("n_changed").cast("long").alias("n_changed"), text.rounded(C("fraction") * 100, 2).alias("changed_percent"))


_thirds = lambda v, a, b: f"(CASE WHEN {v} < 0.33 THEN '{a}' WHEN {v} > 0.66 THEN '{b}' ELSE 'central' END)"


@register("change_regions", f"""WITH RECURSIVE {CHANGE}, mask AS (SELECT scene_id, y, x, y * 8 + x AS p FROM ch WHERE c),
{COMPONENTS.split('),', 1)[1].strip()}, lb AS (SELECT scene_id, y, x, dense_rank() OVER (PARTITION BY scene_id ORDER BY root)::BIGINT AS region_id FROM roots JOIN mask USING (scene_id, p)),
rg AS (SELECT scene_id, region_id, count(*)::BIGINT AS area, min(x)::INT AS bx, min(y)::INT AS by_, (max(x) - min(x) + 1)::INT AS bw, (max(y) - min(y) + 1)::INT AS bh, avg(x) / 8 AS cx, avg(y) / 8 AS cy, avg(g) AS magnitude FROM lb JOIN ch USING (scene_id, y, x) GROUP BY ALL),
nm AS (SELECT *, {_thirds('cy', 'upper', 'lower')} AS v, {_thirds('cx', 'left', 'right')} AS w, row_number() OVER (PARTITION BY scene_id ORDER BY area DESC, region_id)::INT AS rank FROM rg)
SELECT scene_id, rank, region_id, area, bx, by_, bw, bh, round(magnitude, 6) AS magnitude, {exact('least(1.0::DOUBLE, 0.5 + 0.3 * magnitude + 2.0 * area / 64.0::DOUBLE)', 3)} AS confidence,
 CASE WHEN v = 'central' AND w = 'central' THEN 'center of the scene' WHEN v = 'central' THEN w || ' portion of the scene' WHEN w = 'central' THEN v || '-central portion of the scene' ELSE v || '-' || w || ' portion of the scene' END AS location FROM nm WHERE rank <= 20""")
def change_regions(spark, d):
    p, s = change.detect(synth.change_pairs(spark, d))
    r = change.find_regions(p, s)
    return r.select("scene_id", "rank", "region_id", "area", "bx", C("by").alias("by_"), "bw", "bh", r6("magnitude"), "confidence", "location")


@register("change_pipeline")
def change_pipeline(spark, d):
    """Whole change analysis of the supplier scenes: even keys are identical pairs, odd keys moved their water."""
    s = synth.scenes(spark, d)
    pairs = s.select("scene_id", "y", "x", C("b04").alias("r0"), C("b03").alias("g0"), C("b02").alias("b0"), C("b04m").alias("r1"), C("b03m").alias("g1"), C("b02m").alias("b1"))
    return change.analyse(pairs, "how did the river change?")


@register("fusion_features", f"""WITH RECURSIVE {FUSED}, anywet AS (SELECT scene_id, max((wo AND ws)::INT) AS s FROM mk GROUP BY 1),
kinds AS (SELECT scene_id, y, x, unnest([1, 2, 3]) AS kind, unnest([CASE WHEN s = 1 THEN wo AND ws ELSE wo OR ws END, structure, veg AND ws]) AS f, ndwi, ndvi, vv, edges, (wo AND ws)::INT AS agree FROM mk JOIN anywet USING (scene_id)),
mask AS (SELECT *, y * 64 + x AS p, scene_id * 4 + kind AS s FROM kinds WHERE f),
runs AS (SELECT s, y, min(x) AS lo, max(x) AS hi, min(p) AS r FROM (SELECT *, x - row_number() OVER (PARTITION BY s, y ORDER BY x) AS g FROM mask) GROUP BY s, y, g),
links AS (SELECT a.s, a.r AS a, b.r AS b FROM runs a JOIN runs b ON a.s = b.s AND abs(a.y - b.y) = 1 AND a.lo <= b.hi AND b.lo <= a.hi),
reach(s, a, b) AS (SELECT s, r, r FROM runs UNION SELECT reach.s, reach.a, l.b FROM reach JOIN links l ON l.s = reach.s AND l.a = reach.b WHERE l.b < 1e9),
roots AS (SELECT s, a AS r, min(b) AS root FROM reach GROUP BY ALL),
lb AS (SELECT m.*, root FROM mask m JOIN runs u ON u.s = m.s AND u.y = m.y AND m.x BETWEEN u.lo AND u.hi JOIN roots o ON o.s = m.s AND o.r = u.r),
rg AS (SELECT scene_id, kind, root, count(*)::BIGINT AS area, min(x)::INT AS bx, min(y)::INT AS by_, (max(x) - min(x) + 1)::INT AS bw, (max(y) - min(y) + 1)::INT AS bh, avg(ndwi) AS ndwi, avg(ndvi) AS ndvi, avg(vv) AS vv, avg(edges) AS edges, avg(agree) AS agree FROM lb GROUP BY ALL HAVING count(*) >= 15),
sc AS (SELECT rg.*, row_number() OVER (PARTITION BY scene_id ORDER BY kind, root)::INT AS feature_id, least(greatest(CASE kind WHEN 1 THEN (ndwi - t_ndwi + 0.2) / 0.6 WHEN 2 THEN edges / 0.5 ELSE ndvi / 0.6 END, 0.0), 1.0) AS o, least(greatest(CASE kind WHEN 1 THEN (t_vv - vv + 5) / 15 WHEN 2 THEN (vv - t_db + 5) / 10 ELSE (t_vv - vv + 3) / 10 END, 0.0), 1.0) AS r, CASE kind WHEN 1 THEN agree ELSE 1.0 END AS a FROM rg JOIN th USING (scene_id))
SELECT scene_id, feature_id, kind::INT AS kind, area, bx, by_, bw, bh, round(o, 6) AS optical, round(r, 6) AS sar, round(a, 6) AS agreement, row_number() OVER (PARTITION BY scene_id ORDER BY bw * bh DESC, feature_id)::INT AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY bw * bh DESC, feature_id) <= 15""")
def fusion_features(spark, d):
    p, s = _masks(spark, d)
    f = fusion.features(fusion.masks(p, s), s, exact=True)
    return f.select("scene_id", "feature_id", "kind", "area", "bx", C("by").alias("by_"), "bw", "bh", r6("optical"), r6("sar"), r6("agreement"), "rank")


@register("fusion_pipeline")
def fusion_pipeline(spark, d):
    p = synth.scenes(spark, d).select("scene_id", "y", "x", "b02", "b03", "b04", "b08", "vv_raw", "vh_raw")
    out = fusion.analyse(p, "is there flooding near the river?", keep=False)
    return out.select("scene_id", "confidence", "agreement_pct", "iou_pct", "features", "theme", "optical_evidence", "sar_evidence", "interpretation", "summary", "simulated")


@register("p6_radar_threshold_cases", f"WITH c AS (SELECT p_partkey AS k, -30.0::DOUBLE + p_partkey % 20 AS m, -26.0::DOUBLE + p_partkey * 7 % 20 AS p, 0.5::DOUBLE + p_partkey % 5 * 0.5::DOUBLE AS s, -34.0::DOUBLE + p_partkey * 3 % 30 AS o FROM part) SELECT k, CASE WHEN m <= -22 THEN {exact('least(-16, greatest(-38, p - 0.2 * s))', 2)} ELSE {exact('least(-14, greatest(-26, o))', 2)} END AS t_vv FROM c")
def p6_radar_threshold_cases(spark, d):
    """Thresholds of scalars that follow from every part's key, through all bounds."""
    k = C("p_partkey")
    rows = synth.table(spark, d, "part").select(k.alias("k"), (-30.0 + k % 20).alias("m"), (-26.0 + k * 7 % 20).alias("p"), (0.5 + k % 5 * 0.5).alias("s"), (-34.0 + k * 3 % 30).alias("o"))
    return rows.select("k", radar.water_threshold(C("m"), C("p"), C("s"), C("o")).alias("t_vv"))
