"""Keyword classifiers, location words and rule-based texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keyword lists, in order of precedence.
INTENTS = (
    ("change", ("chang", "differ", "compar", "between these")),
    ("fusion", ("sar", "fus", "radar", "optical and")),
    ("grounding", ("highlight", "locate", "where is", "point to", "find the")),
    ("captioning", ("caption", "describe", "summari")),
)
CLIENT_INTENTS = (("change", ("chang",)), ("grounding", ("highlight", "where")), ("fusion", ("sar", "fus")))
THEMES = (
    ("water", ("flood", "water", "inundat", "submerg", "river", "lake", "wet")),
    ("urban", ("build", "urban", "struct", "settle", "citi", "infrastruct", "road")),
    ("vegetation", ("crop", "vegetat", "plant", "farm", "agri", "forest")),
    ("clouds", ("cloud", "shadow", "all-weather", "penetrat", "haze")),
)
CONTEXTS = (
    ("built", ("built", "urban", "construct", "building")),
    ("vegetation", ("veget", "green", "forest", "tree", "ndvi")),
    ("water", ("water", "flood", "river", "lake")),
)
#: Accepted uploads.
UPLOADS = ("image/png", "image/jpeg", "image/jpg", "image/webp", "image/gif", "image/tiff", "image/tif", "image/geotiff")
SERVER_UPLOADS = ("image/png", "image/jpeg", "image/jpg", "image/tiff", "image/tif")
MAX_UPLOAD = 12 * 1024 * 1024


def first_match(text: Column, rules: tuple, otherwise: str) -> Column:
    """The first rule of which any keyword occurs in the lower-cased text, wherever in a word."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), None
    for name, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def intent(text: Column) -> Column:
    return first_match(text, INTENTS, "vqa")


def client_intent(text: Column) -> Column:
    return first_match(text, CLIENT_INTENTS, "vqa")


def theme(text: Column) -> Column:
    return first_match(text, THEMES, "general")


def context(text: Column) -> Column:
    return first_match(text, CONTEXTS, "none")


def upload_type(declared: Column, name: Column) -> Column:
    kind = F.lower(F.coalesce(declared, F.lit("")))
    low = F.lower(F.coalesce(name, F.lit("")))
    by_name = F.when(low.endswith(".png"), "image/png").when(low.endswith(".jpg") | low.endswith(".jpeg"), "image/jpeg").when(low.endswith(".webp"), "image/webp").when(low.endswith(".gif"), "image/gif").when(low.endswith(".tif") | low.endswith(".tiff"), "image/tiff").otherwise("")
    return F.when(kind == "image/jpg", "image/jpeg").when(kind.isin(*UPLOADS), kind).otherwise(by_name)


def thirds(v: Column, low: str, high: str) -> Column:
    return F.when(v < 0.33, low).when(v > 0.66, high).otherwise("central")


def change_location(cx: Column, cy: Column) -> Column:
    v, h = thirds(cy, "upper", "lower"), thirds(cx, "left", "right")
    return F.when((v == "central") & (h == "central"), "center of the scene").when(v == "central", F.concat(h, F.lit(" portion of the scene"))).when(h == "central", F.concat(v, F.lit("-central portion of the scene"))).otherwise(F.concat(v, F.lit("-"), h, F.lit(" portion of the scene")))


def fusion_location(cx: Column, cy: Column) -> Column:
    v, h = thirds(cy, "northern", "southern"), thirds(cx, "western", "eastern")
    return F.when(v == "central", F.concat(h, F.lit(" sector"))).when(h == "central", F.concat(v, F.lit(" sector"))).otherwise(F.concat(v, F.lit("-"), h, F.lit(" quadrant")))


def magnitude_band(m: Column) -> Column:
    return F.when(m > 0.6, "high").when(m > 0.3, "moderate").otherwise("low")


def fixed(v: Column, digits: int, plus: bool = False) -> Column:
    """A double with so many decimals (at most 4), its exact binary value rounded, exact ties to even.

    ``format_string`` rounds the shortest decimal that names the double, half up: 12.35, which lies below 12.35, would
    become 12.4. Here every product and difference that decides is exact: the fraction is taken in two parts of 26 bits.
    """
    unit = 10**digits
    let = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))

    def parts(x: Column) -> Column:
        size = F.abs(x)
        rest = size - F.floor(size)
        high = F.floor(rest * float(2**26)) / float(2**26)
        return F.struct((F.floor(size) * unit).alias("n"), (high * float(unit)).alias("a"), ((rest - high) * float(unit)).alias("b"))

    def total(p: Column) -> Column:
        q = F.floor(p["a"] + p["b"])
        over = (p["a"] - q - 0.5) + p["b"]
        return p["n"] + q + F.when((over > 0) | ((over == 0) & ((p["n"] + q) % 2 == 1)), 1).otherwise(0)

    def written(t: Column) -> Column:
        return F.concat(((t - t % unit) / unit).cast("long").cast("string"), F.lit("."), F.lpad((t % unit).cast("string"), digits, "0")) if digits else t.cast("string")

    sign = F.when(v < 0, "-").otherwise("+" if plus else "")
    return F.concat(sign, let(let(let(v.cast("double"), parts), total), written))


def worded(pattern: str, *values: Column) -> Column:
    """``format_string`` whose %.Nf and %+.Nf are written by ``fixed``."""
    marks = [m for m in re.finditer(r"%(?:%|[ds]|(\+?)\.(\d)f)", pattern) if m.group() != "%%"]
    args = [fixed(v, int(m[2]), bool(m[1])) if m[2] else v for m, v in zip(marks, values, strict=True)]
    return F.format_string(re.sub(r"%\+?\.\df", "%s", pattern), *args)


#: Sentences of the change narrative.
NO_CHANGE_EVIDENCE = "No significant changes were detected between the two images. The scenes appear largely identical within the detection threshold."
NO_CHANGE = "No significant changes were detected between the before and after images. The two scenes appear largely consistent."
BAND_TEXT = {
    "high": "The magnitude of the dominant change region is high, suggesting substantial land-cover transformation (e.g. new construction, deforestation, or flooding).",
    "moderate": "The change magnitude is moderate, which may indicate gradual land-use transition, seasonal vegetation change, or partial development.",
    "low": "The change magnitude is relatively low, suggesting subtle changes such as minor vegetation variation or atmospheric differences between acquisitions.",
}
CONTEXT_TEXT = {
    "built": "Based on the query context, the detected changes may correspond to built-up area expansion. Ground truth validation is recommended for confirmation.",
    "vegetation": "Based on the query context, the changes may relate to vegetation cover dynamics (gain or loss). Spectral indices like NDVI would provide more precise classification.",
    "water": "Based on the query context, the changes may involve water body extent variation. Water index analysis (NDWI/MNDWI) would improve classification accuracy.",
}


def by_name(name: Column, texts: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in reversed(texts.items()):
        out = F.when(name == k, v).otherwise(out)
    return out


def change_evidence(regions: Column, percent: Column) -> Column:
    """``regions``: ranked array of structs with region_id, location, area_fraction, magnitude, confidence."""
    head = worded("Detected %d significant change region(s) covering approximately %.1f%% of the total scene area.", F.size(regions), percent)
    line = F.transform(F.slice(regions, 1, 5), lambda r: worded("  • Region %d: %s, area %.2f%%, magnitude %.2f, confidence %.0f%%", r["region_id"], r["location"], r["area_fraction"] * 100.0, r["magnitude"], r["confidence"] * 100.0))
    return F.when(F.size(regions) == 0, NO_CHANGE_EVIDENCE).otherwise(F.array_join(F.concat(F.array(head), line), "\n"))


def change_narrative(regions: Column, percent: Column, query: Column) -> Column:
    """Locations of the three largest regions are named once each, in rank order."""
    lead = worded("Significant changes were detected between the two temporal observations. %d distinct change region(s) were identified, covering approximately %.1f%% of the scene.", F.size(regions), percent)
    where = F.array_join(F.array_distinct(F.transform(F.slice(regions, 1, 3), lambda r: r["location"])), ", ")
    band = by_name(magnitude_band(F.try_element_at(regions, F.lit(1))["magnitude"]), BAND_TEXT)
    return F.when(F.size(regions) == 0, NO_CHANGE).otherwise(F.concat_ws(" ", lead, F.concat(F.lit("The most prominent changes are located in the "), where, F.lit(".")), band, by_name(context(query), CONTEXT_TEXT)))


def rounded(v: Column, digits: int) -> Column:
    """A double rounded as ``fixed`` does, so that no tie of its shortest decimal decides. At most 4 digits."""
    return fixed(v, digits).cast("double")


def shortest(v: Column, digits: int) -> Column:
    """``rounded`` as text without needless zeros, but one; small numbers have no exponent."""
    return F.regexp_replace(F.regexp_replace(fixed(v, digits), "0+$", ""), r"\.$", ".0")


def asked(scenes: DataFrame, query: str | DataFrame) -> tuple[DataFrame, Column]:
    """Scenes, and the query of each: one text for all, or that of (scene_id, query), empty where there is none."""
    if isinstance(query, str):
        return scenes, F.lit(query)
    return scenes.join(query.select("scene_id", F.col("query").alias("_query")), "scene_id", "left"), F.coalesce("_query", F.lit(""))
