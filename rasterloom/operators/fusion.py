"""Optical and radar fusion as a relational plan over (scene_id, y, x, b02, b03, b04, b08?, vv_raw, vh_raw?)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour, radar, scores, spectral, text
from ..sources import images
from . import align, components, regions, selection, stats, stencil

WATER, STRUCTURE, FLOODED = "Surface Water / Inundation Candidate", "Built-up Infrastructure / Settlement", "Flooded Agricultural Canopy / Wetland"
C = F.col


def scaled(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """Digital numbers to reflectance, each band by its own maximum in the scene."""
    tops = pixels.groupBy("scene_id").agg(*[F.max(b).alias(f"_{b}") for b in bands])
    both = stats.with_scene(pixels, tops)
    return both.select(*[spectral.reflectance(C(c), C(f"_{c}")).alias(c) if c in bands else C(c) for c in pixels.columns])


def decibels(pixels: DataFrame, raw: str, out: str) -> DataFrame:
    """Adds the decibel band; speckle is filtered by a 3 x 3 median unless the input is in decibels already."""
    ends = pixels.groupBy("scene_id").agg(F.min(raw).alias("_lo"), F.max(raw).alias("_hi"))
    despeckled = stats.with_scene(stencil.median3(pixels, raw, "_med"), ends)
    return despeckled.withColumn(out, radar.decibels(C(raw), F.greatest(C("_med"), F.lit(0.0)), C("_lo"), C("_hi"))).drop("_med", "_lo", "_hi")


def optical_indices(pixels: DataFrame) -> DataFrame:
    """Adds lum, ndwi and ndvi; scenes without near infrared use the visible proxies."""
    has = C("b08").isNotNull()
    return pixels.withColumns({
        "lum": colour.luminance(C("b04"), C("b03"), C("b02")),
        "ndwi": F.when(has, spectral.ndwi(C("b03"), C("b08"))).otherwise(spectral.water_proxy(C("b02"), C("b03"), C("b04"))),
        "ndvi": F.when(has, spectral.ndvi(C("b04"), C("b08"))).otherwise(spectral.vegetation_proxy(C("b02"), C("b03"), C("b04"))),
    })


def scene_scalars(pixels: DataFrame, large: bool = False) -> DataFrame:
    """All per-scene scalars of both sensors: one aggregation, and one histogram for the radar threshold."""
    more = [F.avg("b02").alias("b02_mean"), F.avg("b03").alias("b03_mean"), F.avg("b04").alias("b04_mean"), F.avg("b08").alias("b08_mean"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.max(C("b08").isNotNull()).alias("four"), F.max(C("vh").isNotNull()).alias("dual"), stats.pooled(["b02", "b03", "b04"]).alias("rgb_std")]
    if "slope" in pixels.columns:
        more.append(F.max("slope").alias("slope_max"))
    s = stats.profile(pixels, ["ndwi", "vv", "vh", "lum"], (5, 10, 25, 35, 50, 75, 90, 95), large=large, listed=True, more=tuple(more))
    s = stats.with_scene(s, stats.radar_threshold(pixels, "vv").withColumnRenamed("threshold", "otsu"))
    return s.withColumns({
        "t_ndwi": F.when(C("four"), spectral.water_threshold(C("ndwi_p50"))).otherwise(F.lit(0.15)),
        "t_vv": radar.water_threshold(C("vv_p50"), C("vv_p35"), C("vv_std"), C("otsu")),
        "t_vh": radar.cross_threshold(C("vh_p35"), C("vh_std")),
        "t_db": radar.bounce_threshold(C("vv_p50"), C("vv_std")),
    })


def masks(pixels: DataFrame, s: DataFrame) -> DataFrame:
    """Adds edges and the masks of each sensor and of both. ``pixels`` has indices and decibel bands, and may have the slopes of ``prepared``."""
    names = ["scene_id", "t_ndwi", "t_vv", "t_vh", "t_db", "vh_p50", "vh_std", "four"]
    if "slope" in pixels.columns and "slope_max" in s.columns:
        p = stats.with_scene(pixels, s.select(*names, "slope_max"))
        p = p.withColumn("edges", stencil.of_largest(C("slope"), C("slope_max"))).drop("slope", "slope_max")
    else:
        p = stats.with_scene(stencil.gradient(pixels, "lum", "edges"), s.select(*names))
    return p.withColumns({
        "water_opt": F.when(C("four"), spectral.water_mask(C("ndwi"), C("t_ndwi"), C("b03"), C("b04"), C("b08"))).otherwise(spectral.water_mask_rgb(C("ndwi"), C("lum"))),
        "veg": F.when(C("four"), spectral.vegetation_mask(C("ndvi"), C("b08"))).otherwise(spectral.vegetation_mask_rgb(C("ndvi"), C("b03"), C("b04"))),
        "water_sar": radar.water_mask(C("vv"), C("t_vv"), C("vh"), C("t_vh")),
        "bounce": radar.bounce_mask(C("vv"), C("t_db")),
        "volume": radar.volume_mask(C("vh"), C("vh_p50"), C("vh_std")),
    }).withColumns({
        "consensus": C("water_opt") & C("water_sar"),
        "structure": (C("edges") > 0.20) & C("bounce"),
        "flooded": C("veg") & C("water_sar"),
    })


def metrics(m: DataFrame) -> DataFrame:
    """Agreement of the two sensors per scene. Sums of rounded shares, as the definition has it."""
    a, b = C("water_opt"), C("water_sar")
    out = m.groupBy("scene_id").agg(
        stats.share(a, 2).alias("optical_water_pct"), stats.share(b, 2).alias("sar_water_pct"), stats.share(a & b, 2).alias("consensus_pct"),
        stats.share(a & ~b, 2).alias("optical_only_pct"), stats.share(~a & b, 2).alias("sar_only_pct"), stats.share(~a & ~b, 2).alias("dry_pct"),
        stats.share(C("structure"), 2).alias("structure_pct"), stats.share(C("bounce"), 2).alias("bounce_pct"), stats.share(C("veg"), 2).alias("vegetation_pct"), stats.share(a | b, 2).alias("candidate_pct"),
        F.sum((a & b).cast("int")).alias("n_both"), F.sum((a | b).cast("int")).alias("n_either"), F.avg("edges").alias("edge_mean"),
    )
    return out.withColumns({"agreement_pct": text.rounded(C("consensus_pct") + C("dry_pct"), 2), "disagreement_pct": text.rounded(C("optical_only_pct") + C("sar_only_pct"), 2), "iou_pct": scores.overlap(C("n_both"), C("n_either"))})


def composites(m: DataFrame) -> DataFrame:
    """Display rasters: false colour (fc_), intensity substitution (ihs_) and the agreement map (ag_)."""
    stretched = components.settled(stats.profile(m, ["b02", "b03", "b04", "vv"], (2, 98), listed=True))
    p = stats.with_scene(m, stretched)
    shown = p.withColumns({"sar_norm": radar.display(C("vv"), C("vv_p2"), C("vv_p98"))} | {f"s{b}": spectral.stretch(C(b), C(f"{b}_p2"), C(f"{b}_p98"), C(b)) for b in ("b02", "b03", "b04")})
    shown = stats.with_scene(shown, components.settled(shown.groupBy("scene_id").agg(F.avg("sar_norm").alias("sar_mean"))))
    mean = C("sar_mean")
    flag = lambda c: C(c).cast("int").cast("double")
    lit = shown.withColumn("ml", colour.clip(C("lum") + 0.35 * (C("sar_norm") - mean)))
    gain = F.least(F.greatest(F.when(C("lum") > 0.01, C("ml") / (C("lum") + 1e-5)).otherwise(F.lit(1.0)), F.lit(0.3)), F.lit(2.0))
    ag = colour.heat_agreement(C("lum"), C("consensus"), C("structure"), C("flooded"))
    return lit.select("scene_id", "y", "x", "sar_norm", "b02", "b03", "b04",
        colour.clip(0.65 * C("b04") + 0.35 * flag("bounce")).alias("fc_r"), colour.clip(0.85 * C("b03") + 0.15 * flag("veg")).alias("fc_g"), colour.clip(0.70 * C("sar_norm") + 0.30 * C("b02")).alias("fc_b"),
        *[colour.clip(C(f"s{b}") * gain).alias(f"ihs_{n}") for b, n in (("b04", "r"), ("b03", "g"), ("b02", "b"))],
        *[c.alias(f"ag_{n}") for c, n in zip(ag, "rgb")])


def features(m: DataFrame, s: DataFrame, label=components.grouped, most: int = 15, least_share: float = 0.0005, exact: bool = False) -> DataFrame:
    """Ranked regions of the three kinds; ``exact``: scores unrounded, without texts. Water falls back to either sensor's mask in scenes without consensus."""
    # either sensor's water is labelled too, and counts where no pixel has consensus
    kinds = ((1, C("consensus")), (2, C("structure")), (3, C("flooded")), (4, C("water_opt") | C("water_sar")))
    stacked = m.select("scene_id", "y", "x", "ndwi", "ndvi", "vv", "edges", C("consensus").cast("int").cast("double").alias("agree"), F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]), lambda k: k.isNotNull())).alias("kind"))
    # one labelling pass: kinds become scenes of their own
    keyed = components.labelled(stacked.withColumn("scene_id", F.struct("scene_id", "kind")).drop("kind"), label)
    r = regions.summarise(keyed, ["ndwi", "ndvi", "vv", "edges", "agree"], ("scene_id", "label"))
    r = r.select("scene_id.scene_id", "scene_id.kind", "label", *r.columns[2:])
    r = r.withColumn("_some", F.max(C("kind") == 1).over(Window.partitionBy("scene_id"))).where((C("kind") != 4) | ~C("_some")).drop("_some")
    r = r.withColumn("kind", F.when(C("kind") == 4, 1).otherwise(C("kind")))
    r = stats.with_scene(r, s.select("scene_id", "h", "w", "t_ndwi", "t_vv", "t_db"))
    total = C("h") * C("w")
    r = r.where(C("area") >= F.greatest(F.lit(15), F.floor(total * least_share)))
    r = r.withColumn("feature_id", F.row_number().over(Window.partitionBy("scene_id").orderBy("kind", "label")))
    is_ = lambda k: C("kind") == k
    optical = F.when(is_(1), scores.water_optical(C("ndwi"), C("t_ndwi"))).when(is_(2), scores.structure_optical(C("edges"))).otherwise(scores.flooded_optical(C("ndvi")))
    sar = F.when(is_(1), scores.water_radar(C("vv"), C("t_vv"))).when(is_(2), scores.structure_radar(C("vv"), C("t_db"))).otherwise(scores.flooded_radar(C("vv"), C("t_vv")))
    agree = F.when(is_(1), C("agree")).otherwise(F.lit(1.0))
    r = r.withColumns({"optical": optical, "sar": sar, "agreement": agree})
    if exact:
        return regions.ranked(r, [F.desc(C("bw") * C("bh")), F.asc("feature_id")], most)
    by_optical = F.when(is_(1), text.worded("Mean NDWI %+.3f with NIR absorption", C("ndwi"))).when(is_(2), text.worded("High spatial edge density (%.2f)", C("edges"))).otherwise(text.worded("Active vegetation response (NDVI %.2f)", C("ndvi")))
    by_sar = F.when(is_(1), text.worded("Low radar backscatter %.1f dB (specular reflection)", C("vv"))).when(is_(2), text.worded("Double-bounce backscatter (%.1f dB)", C("vv"))).otherwise(text.worded("Sub-canopy radar attenuation (%.1f dB)", C("vv")))
    r = r.select("scene_id", "feature_id", "kind", F.when(is_(1), WATER).when(is_(2), STRUCTURE).otherwise(FLOODED).alias("category"), "bx", "by", "bw", "bh", "area", text.rounded(C("area") * 100.0 / total, 3).alias("area_pct"), text.fusion_location(C("mx") / C("w"), C("my") / C("h")).alias("location"), text.rounded(C("optical"), 2).alias("optical_score"), text.rounded(C("sar"), 2).alias("sar_score"), text.rounded(C("agreement"), 2).alias("agreement_score"), scores.blend(C("optical"), C("sar"), C("agreement")).alias("confidence"), by_optical.alias("optical_characteristics"), by_sar.alias("sar_characteristics"))
    return regions.ranked(r, [F.desc(C("bw") * C("bh")), F.asc("feature_id")], most)


def aligned(optical: DataFrame, radar: DataFrame, optical_geo: DataFrame, radar_geo: DataFrame, optical_bands: list[str], radar_bands: list[str]) -> DataFrame:
    """Optical and radar pixels side by side on the common grid of their extents, for scenes of equal coordinate systems.

    Pixels: scene_id, y, x and bands; ``*_geo``: scene_id, crs, left, bottom, right, top, res_x, res_y. The grid has the
    finer of both resolutions. Pixels of the grid that one of the two doesn't cover are absent.
    """
    sides = [g.select(C("scene_id").alias("id"), "crs", "left", "bottom", "right", "top") for g in (optical_geo, radar_geo)]
    own = align.extents(*sides).where("id1 = id2").withColumnRenamed("id1", "scene_id").drop("id2", "crs")
    finest = optical_geo.select("scene_id", "res_x", "res_y").unionByName(radar_geo.select("scene_id", "res_x", "res_y")).groupBy("scene_id").agg(F.min("res_x").alias("res_x"), F.min("res_y").alias("res_y"))
    target = align.grid(own.join(finest, "scene_id"))
    one = align.resample(optical, optical_geo, target, optical_bands).drop("coverage")
    two = align.resample(radar, radar_geo, target, radar_bands).drop("coverage")
    return one.join(two, ["scene_id", "y", "x"])


def warped(optical: DataFrame, radar: DataFrame, optical_geo: DataFrame, radar_geo: DataFrame, optical_bands: list[str], radar_bands: list[str]) -> DataFrame:
    """Optical and radar pixels side by side on the common grid of their extents, which may be in different coordinate systems.

    Pixels: scene_id, y, x and bands; ``*_geo``: scene_id, crs, left, bottom, right, top, res_x, res_y. The grid is in the
    optical system at the optical resolution; pixels of it that a raster doesn't cover are 0 in its bands. Scenes that
    don't meet, or whose systems are not supported, are absent: ``align.matched`` sizes those.
    """
    target = align.common(optical_geo, radar_geo)
    one = align.warp(optical, optical_geo, target, optical_bands).drop("coverage")
    two = align.warp(radar, radar_geo, target, radar_bands).drop("coverage")
    return one.hint("merge").join(two, ["scene_id", "y", "x"])


def from_files(optical: DataFrame, radar: DataFrame, optical_geo: DataFrame, radar_geo: DataFrame) -> DataFrame:
    """What ``analyse`` reads, from pixels and headers of files: bands mapped, and both rasters on their common grid.

    Pixels: scene_id, n_bands, y, x, v1..v4, as the sources give them, and headers, with scenes named alike in both.
    """
    b02, b03, b04, b08 = images.mapped_bands(C("n_bands"), C("v1"), C("v2"), C("v3"), C("v4"))
    vv, vh = images.radar_bands(C("n_bands"), C("v1"), C("v2"))
    one = optical.select("scene_id", "y", "x", b02.alias("b02"), b03.alias("b03"), b04.alias("b04"), b08.alias("b08"))
    two = radar.select("scene_id", "y", "x", vv.alias("vv_raw"), vh.alias("vh_raw"))
    return warped(one, two, optical_geo, radar_geo, ["b02", "b03", "b04", "b08"], ["vv_raw", "vh_raw"])


def fused_picture(m: DataFrame, method: str = "composite") -> DataFrame:
    """(scene_id, y, x, r, g, b) of the chosen method: "ihs" is the intensity substitution, any other name the composite."""
    kind = "ihs" if method == "ihs" else "fc"
    return composites(m).select("scene_id", "y", "x", *[C(f"{kind}_{c}").alias(c) for c in "rgb"])


def prepared(pixels: DataFrame) -> DataFrame:
    """Reflectance, decibels, indices, and the slope of luminance that edges are made of.

    The same as ``scaled``, ``decibels`` and ``optical_indices`` in turn, with one aggregation for the ends of all bands and one pass of
    windows in each direction.
    """
    bands, raws = ["b02", "b03", "b04", "b08"], {"vv_raw": "vv", "vh_raw": "vh"}
    ends = pixels.groupBy("scene_id").agg(*[F.max(b).alias(f"_{b}") for b in bands], *[f(r).alias(f"_{n}_{o}") for r, o in raws.items() for n, f in (("lo", F.min), ("hi", F.max))])
    both = stats.with_scene(pixels, ends)
    ready = both.select(*[spectral.reflectance(C(c), C(f"_{c}")).alias(c) if c in bands else C(c) for c in pixels.columns], *[f"_{n}_{o}" for o in raws.values() for n in ("lo", "hi")])
    lit = ready.withColumn("lum", colour.luminance(C("b04"), C("b03"), C("b02")))
    p = stencil.neighbours(lit, {r: f"_med_{o}" for r, o in raws.items()}, {"lum": "slope"})
    p = p.withColumns({o: radar.decibels(C(r), F.greatest(C(f"_med_{o}"), F.lit(0.0)), C(f"_lo_{o}"), C(f"_hi_{o}")) for r, o in raws.items()})
    return optical_indices(p.select(*pixels.columns, *raws.values(), "slope"))


def texts(scenes: DataFrame, query: str | DataFrame) -> DataFrame:
    """Adds optical_evidence, sar_evidence, interpretation and summary; the theme comes from the query, or that of each scene."""
    scenes, asked = text.asked(scenes, query)
    t = text.theme(asked)
    fmt, line = text.worded, lambda *parts: F.concat_ws(" ", *parts)
    feats = C("features")
    of = lambda k: F.filter(feats, lambda f: f["kind"] == k)
    place = lambda k: F.try_element_at(of(k), F.lit(1))["location"]
    any_ = lambda k: F.size(of(k)) > 0
    nir = F.when(C("four"), F.concat(F.lit(", B08 NIR: "), text.shortest(C("b08_mean"), 4))).otherwise(F.lit(""))
    bands = F.when(C("four"), F.lit(4)).otherwise(F.lit(3))
    lead = F.concat(fmt("Optical multispectral imagery (%d bands: B02 Blue=%.3f, B03 Green=%.3f, B04 Red=%.3f", bands, C("b02_mean"), C("b03_mean"), C("b04_mean")), nir, fmt(") shows mean NDWI of %+.3f (median: %+.3f, std: %.3f).", C("ndwi_mean"), C("ndwi_p50"), C("ndwi_std")))
    veg = F.when(C("four"), C("vegetation_pct")).otherwise(F.lit(0.0))
    wet = F.when(any_(1), fmt("Detected %d distinct contiguous candidate water zone(s), prominently in the %s.", F.size(of(1)), place(1))).otherwise("No dominant isolated open water clusters detected.")
    built = F.when(any_(2), fmt("Detected %d dense structural cluster(s) in the %s.", F.size(of(2)), place(2))).otherwise("Terrain exhibits predominantly uniform radiometric texture.")
    optical = (
        F.when(t == "water", line(fmt("Applying NDWI threshold >= %.2f combined with NIR absorption criteria (B08 <= 0.28) isolates %.2f%% of the scene as optical water / inundation candidate pixels.", C("t_ndwi"), C("optical_water_pct")), wet))
        .when(t == "urban", line(fmt("Spatial edge analysis indicates mean gradient of %.2f.", C("edge_mean")), built))
        .when(t == "vegetation", fmt("Vegetation index response indicates active photosynthetic biomass across approximately %.1f%% of the scene.", veg))
        .otherwise(fmt("Surface classification reveals %.2f%% optical water candidate signature, %.1f%% vegetative canopy, and mean scene luminance of %.1f%%.", C("optical_water_pct"), veg, C("lum_mean") * 100.0))
    )
    pol = F.when(C("dual"), "dual_pol").otherwise("single_pol")
    cross = F.when(C("dual"), F.concat(F.lit(", VH cross-pol mean: "), text.shortest(C("vh_mean"), 2), F.lit(" dB (median: "), text.shortest(C("vh_p50"), 2), F.lit(" dB)"))).otherwise(F.lit(""))
    radar_lead = F.concat(fmt("Calibrated SAR radar backscatter (%s) records mean VV intensity of %.1f dB [median: ", pol, C("vv_mean")), text.shortest(C("vv_p50"), 2), F.lit(" dB, p10: "), text.shortest(C("vv_p10"), 2), F.lit(" dB, p90: "), text.shortest(C("vv_p90"), 2), fmt(" dB, std: %.1f dB]", C("vv_std")), cross, F.lit("."))
    sar = (
        F.when(t == "water", fmt("Adaptive low-backscatter thresholding (VV <= %.1f dB) identifies %.2f%% of the radar scene as specular reflection candidates where microwave pulses reflect away from the sensor.", C("t_vv"), C("sar_water_pct")))
        .when(t == "urban", fmt("High-intensity double-bounce returns (VV >= %.1f dB) occupy %.2f%% of the scene, characteristic of dihedral corner reflections between vertical walls/structures and the ground plane.", C("t_db"), C("bounce_pct")))
        .when(t == "vegetation", F.when(C("dual"), "Cross-polarization volume scattering indicates canopy interaction across vegetated ground.").otherwise(fmt("Moderate VV backscatter (%.1f dB) corresponds to surface roughness across agricultural terrain.", C("vv_mean"))))
        .otherwise(fmt("Radar returns isolate %.2f%% low-backscatter candidate surfaces and %.2f%% high-intensity double-bounce structures.", C("sar_water_pct"), C("bounce_pct")))
    )
    head = fmt("Cross-modal fusion achieves %.2f%% physical sensor agreement across the common spatial domain (Inundation IoU: %.2f%%).", C("agreement_pct"), C("iou_pct"))
    flood = F.when(any_(3), fmt("Additionally, %d sector(s) of potential flooded vegetation / sub-canopy wetness were detected in the %s.", F.size(of(3)), place(3)))
    primary = F.when(any_(1), fmt("Primary candidate water bodies are delineated in the %s.", place(1)))
    note = F.lit("[Note: Since this analysis evaluates single-date acquisitions without a historical baseline, candidate water is reported rather than confirmed permanent vs flood water].")
    fused = (
        F.when(t == "water", line(head, F.concat(F.lit("Regarding surface water and inundation: Optical NDWI (thresh >= "), C("t_ndwi").cast("string"), fmt(") and SAR specular backscatter (thresh <= %.1f dB) jointly confirm %.2f%% surface water / inundation candidate area. Sensor discrepancies account for %.2f%% optical-only and %.2f%% SAR-only candidate detections.", C("t_vv"), C("consensus_pct"), C("optical_only_pct"), C("sar_only_pct"))), flood, primary, note))
        .when(t == "urban", line(head, fmt("Regarding built-up infrastructure: Optical edge contrast and SAR double-bounce backscatter (VV >= %.1f dB) confirm %.2f%% dense urban footprint.", C("t_db"), C("structure_pct")), F.when(any_(2), fmt("Main settlement clusters are localized in the %s.", place(2)))))
        .when(t == "clouds", line(head, F.lit("SAR microwave penetration bypasses optical atmospheric attenuation, confirming terrain structures and surface moisture directly beneath cloud cover.")))
        .otherwise(line(head, fmt("Multimodal analysis provides all-weather characterization: %d candidate water zone(s) and %d built-up infrastructure cluster(s) isolated with high cross-sensor consistency.", F.size(of(1)), F.size(of(2)))))
    )
    summary = fmt("Optical + SAR fusion (%d-band Optical + %s SAR): %.1f%% agreement (IoU: %.1f%%), %d feature region(s), confidence: %d%%.", bands, pol, C("agreement_pct"), C("iou_pct"), F.size(feats), C("confidence"))
    return scenes.withColumns({"theme": t, "optical_evidence": line(lead, optical), "sar_evidence": line(radar_lead, sar), "interpretation": fused, "summary": summary})


def analysed(pixels: DataFrame, label=components.by_size, keep: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pixels with masks, scenes with scalars and metrics, ranked features): what answers and pictures are made of.

    ``keep``: false for pixels that are made anew with less effort than kept, as generated ones are.
    """
    p = components.settled(prepared(pixels)) if keep else prepared(pixels)  # three branches read it
    s = components.settled(scene_scalars(p, selection.large(p)))
    m = masks(p, s)
    return m, stats.with_scene(s, metrics(m)), features(m, s, label)


#: Lines of a trace, before and after those that tell figures, and those of pictures.
RECEIVED = "✓ Both optical and SAR image payloads received"
EXTRACTING = ("Extracting optical spectral indices (NDWI, NDVI) and surface water candidate signatures", "Extracting radar backscatter distributions, adaptive thresholds, double-bounce and specular masks")
DRAWN = ("Generating optical preview, calibrated SAR dB preview, fused composite, and agreement heatmap", "✓ Visual products encoded to base64 PNG")
REASONED = ("Query-aware multimodal reasoning and scientific evidence synthesis", "✓ Multimodal interpretation complete (rule-based reasoning engine)", "Pipeline complete")


def traced(method: str, drawn: bool) -> Column:
    """The steps of an analysis with their figures."""
    lines = [
        F.lit(RECEIVED), F.lit(EXTRACTING[0]), text.worded("✓ Optical features extracted (NDWI thresh: %+.2f, optical water candidate: %.2f%%)", C("t_ndwi"), C("optical_water_pct")),
        F.lit(EXTRACTING[1]), text.worded("✓ SAR features extracted (water thresh: %.1f dB, %.2f%% specular candidate, %.2f%% double-bounce structures)", C("t_vv"), C("sar_water_pct"), C("bounce_pct")),
        F.lit(f"Cross-modal fusion execution (method: {method})"),
        F.concat(F.lit("✓ Multimodal fusion complete: "), C("agreement_pct").cast("string"), text.worded("%% physical sensor agreement (Inundation IoU: %.1f%%), %d isolated cross-modal feature regions", C("iou_pct"), F.size("features"))),
    ]
    return F.array(*lines, *map(F.lit, DRAWN if drawn else ()), *map(F.lit, REASONED))


def told(scenes: DataFrame, found: DataFrame, query: str | DataFrame = "", method: str = "composite", drawn: bool = False) -> DataFrame:
    """The rows of ``analyse`` of what has been measured and found."""
    item = F.struct("rank", *[c for c in found.columns if c not in ("rank", "scene_id")])
    scenes = regions.collected(scenes, found, item).withColumnRenamed("regions", "features")
    bands = F.when(C("four"), F.lit(4)).otherwise(F.lit(3))
    scenes = scenes.withColumn("confidence", scores.fusion_confidence(C("agreement_pct"), C("iou_pct"), C("vv_max") - C("vv_min"), C("rgb_std"), bands, C("dual")))
    return texts(scenes, query).withColumn("trace", traced(method, drawn)).withColumn("simulated", F.lit(True))


def analyse(pixels: DataFrame, query: str | DataFrame = "", label=components.by_size, method: str = "composite", keep: bool = True) -> DataFrame:
    """One row per scene: metrics, confidence, ranked features, texts and trace. ``method``: that of the fused picture, if one is made; ``keep``: as in ``analysed``."""
    _, scenes, found = analysed(pixels, label, keep)
    return told(scenes, found, query, method)
