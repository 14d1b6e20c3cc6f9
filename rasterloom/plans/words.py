"""Text, coordinate, router, record and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scores, text
from ..operators import align, qa, router
from ..sources import images, synth
from .registry import r6, register

C = F.col


def case(column: str, rules, otherwise: str) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(q, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE '{otherwise}' END AS {column}"


#: Every keyword, and pairs in which precedence decides.
PHRASES = [f"Please {w} it" for rules in (text.INTENTS, text.THEMES, text.CONTEXTS) for _, ws in rules for w in ws] + ["is it necessary", "compare radar", "where is the flood", "describe sar", "", "what is here", "highlight changes", "urban water", "crop shadow"]
VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(PHRASES))
ASKED = f"a AS (SELECT c_custkey AS k, p AS query, lower(p) AS q FROM customer JOIN (VALUES {VALUES}) t(i, p) ON i = c_custkey % {len(PHRASES)})"


def asked(spark, d):
    """(k, query): every customer asks one of the phrases."""
    k = C("c_custkey")
    return synth.table(spark, d, "customer").select(k.alias("k"), F.element_at(F.array(*map(F.lit, PHRASES)), (k % len(PHRASES) + 1).cast("int")).alias("query"))


@register("f1_classifiers", f"WITH {ASKED} SELECT k, query, {case('intent', text.INTENTS, 'vqa')}, {case('client_intent', text.CLIENT_INTENTS, 'vqa')}, {case('theme', text.THEMES, 'general')}, {case('context', text.CONTEXTS, 'none')} FROM a")
def f1_classifiers(spark, d):
    q = asked(spark, d)
    return q.select("k", "query", text.intent(C("query")).alias("intent"), text.client_intent(C("query")).alias("client_intent"), text.theme(C("query")).alias("theme"), text.context(C("query")).alias("context"))


@register("f1_documents", f"WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS q FROM documents) SELECT doc_id, {case('intent', text.INTENTS, 'vqa')}, {case('theme', text.THEMES, 'general')} FROM a")
def f1_documents(spark, d):
    return synth.table(spark, d, "documents").select("doc_id", text.intent(C("text")).alias("intent"), text.theme(C("text")).alias("theme"))


_t = lambda v, a, b: f"(CASE WHEN {v} < 0.33 THEN '{a}' WHEN {v} > 0.66 THEN '{b}' ELSE 'central' END)"


@register("f4_locations", f"""WITH p AS (SELECT c_custkey, (c_custkey % 101) / 101.0 AS cx, (c_custkey * 7 % 103) / 103.0 AS cy FROM customer),
w AS (SELECT c_custkey, {_t('cy', 'upper', 'lower')} AS v, {_t('cx', 'left', 'right')} AS h, {_t('cy', 'northern', 'southern')} AS v2, {_t('cx', 'western', 'eastern')} AS h2 FROM p)
SELECT c_custkey, CASE WHEN v = 'central' AND h = 'central' THEN 'center of the scene' WHEN v = 'central' THEN h || ' portion of the scene' WHEN h = 'central' THEN v || '-central portion of the scene' ELSE v || '-' || h || ' portion of the scene' END AS change_location,
 CASE WHEN v2 = 'central' THEN h2 || ' sector' WHEN h2 = 'central' THEN v2 || ' sector' ELSE v2 || '-' || h2 || ' quadrant' END AS fusion_location FROM w""")
def f4_locations(spark, d):
    k = C("c_custkey")
    p = synth.table(spark, d, "customer").select("c_custkey", (k % 101 / 101.0).alias("cx"), (k * 7 % 103 / 103.0).alias("cy"))
    return p.select("c_custkey", text.change_location(C("cx"), C("cy")).alias("change_location"), text.fusion_location(C("cx"), C("cy")).alias("fusion_location"))


@register("f15_upload_types", """SELECT page_id, name, CASE WHEN name LIKE '%.png' THEN 'image/png' WHEN name LIKE '%.jpg' OR name LIKE '%.jpeg' THEN 'image/jpeg' WHEN name LIKE '%.webp' THEN 'image/webp' WHEN name LIKE '%.gif' THEN 'image/gif' WHEN name LIKE '%.tif' OR name LIKE '%.tiff' THEN 'image/tiff' ELSE '' END AS by_name, CASE page_id % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/webp' ELSE '' END AS declared
FROM (SELECT page_id, 'f' || page_id || list_extract(['.png', '.jpg', '.jpeg', '.webp', '.gif', '.tif', '.tiff', '.txt'], (page_id % 8 + 1)::INT) AS name FROM pages)""")
def f15_upload_types(spark, d):
    k = C("page_id")
    ext = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".jpeg", ".webp", ".gif", ".tif", ".tiff", ".txt"))), (k % 8 + 1).cast("int"))
    p = synth.table(spark, d, "pages").select("page_id", F.concat(F.lit("f"), k.cast("string"), ext).alias("name"))
    said = F.when(k % 3 == 0, "image/JPG").when(k % 3 == 1, "image/webp").otherwise("text/html")
    return p.select("page_id", "name", text.upload_type(F.lit(None), C("name")).alias("by_name"), text.upload_type(said, F.lit("x")).alias("declared"))


COORD = "c AS (SELECT c_custkey AS k, (c_custkey * 37 % 18000) / 100.0 - 90 AS lat, (c_custkey * 91 % 36000) / 100.0 - 180 AS lon FROM customer)"


def coords(spark, d):
    k = C("c_custkey")
    return synth.table(spark, d, "customer").select(k.alias("k"), (k * 37 % 18000 / 100.0 - 90).alias("lat"), (k * 91 % 36000 / 100.0 - 180).alias("lon"))


@register("g1_distances", f"WITH {COORD} SELECT k, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(23.0225 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(23.0225)) * pow(sin(radians(72.5714 - lon) / 2), 2)))), 5) AS km, round(lat - 0.045, 6) AS south, round(lon - 0.045, 6) AS west, round(lat + 0.045, 6) AS north, round(lon + 0.045, 6) AS east FROM c")
def g1_distances(spark, d):
    box = geo.footprint(C("lat"), C("lon"))
    return coords(spark, d).select("k", F.round(geo.haversine_km(C("lat"), C("lon"), F.lit(23.0225), F.lit(72.5714)), 5).alias("km"), *[r6(box[s], s) for s in ("south", "west", "north", "east")])


@register("g2_polygon_area", f"WITH {COORD}, p AS (SELECT k, lat / 2 AS a, lon / 2 AS b FROM c), v AS (SELECT k, i, radians(a + list_extract([0.0, 0.0, 1.0, 1.5], i::INT)) AS la, radians(b + list_extract([0.0, 1.0, 1.25, 0.5], i::INT)) AS lo FROM p, range(1, 5) r(i)), e AS (SELECT x.k, (y.lo - x.lo) * (2 + sin(x.la) + sin(y.la)) AS s FROM v x JOIN v y ON y.k = x.k AND y.i = x.i % 4 + 1) SELECT e.k, round(abs(sum(s)) * 6371.0 * 6371.0 / 2, 3) AS km2, round(any_value(p.a) + 0.625, 6) AS lat, round(any_value(p.b) + 0.6875, 6) AS lng FROM e JOIN p USING (k) GROUP BY e.k")
def g2_polygon_area(spark, d):
    a, b = C("lat") / 2, C("lon") / 2
    corner = lambda i, j: F.struct((a + i).alias("lat"), (b + j).alias("lng"))
    p = coords(spark, d).select("k", F.array(corner(0.0, 0.0), corner(0.0, 1.0), corner(1.0, 1.25), corner(1.5, 0.5)).alias("p"))
    return p.select("k", F.round(geo.polygon_area_km2(C("p")), 3).alias("km2"), r6(geo.centroid(C("p"), "lat"), "lat"), r6(geo.centroid(C("p"), "lng"), "lng"))


@register("g4_scene_ids", f"WITH {COORD}, s AS (SELECT *, abs(floor(lat * 10000 + lon * 7919 + 100000 + 0.5))::BIGINT % 2147483647 AS seed FROM c) SELECT k, seed, 'S2-L2A-DEMO-' || CASE WHEN length(seed::VARCHAR) >= 8 THEN substr(seed::VARCHAR, 1, 8) ELSE right('00000000' || seed::VARCHAR, 8) END AS scene, 3 + seed % 37 AS cloud, 12 + seed % 28 AS built, 5 + seed % 15 AS water, greatest(8, 92 - (12 + seed % 28) - (5 + seed % 15))::BIGINT AS veg FROM s")
def g4_scene_ids(spark, d):
    s = coords(spark, d).select("k", geo.seed(C("lat"), C("lon")).cast("long").alias("seed"))
    built, water, veg = geo.demo_cover(C("seed"))
    return s.select("k", "seed", geo.scene_id(C("seed")).alias("scene"), geo.demo_cloud(C("seed")).alias("cloud"), built.alias("built"), water.alias("water"), veg.cast("long").alias("veg"))


@register("f14_formats")
def f14_formats(spark, d):
    c = coords(spark, d)
    return c.select("k", geo.dms(C("lat"), "lat").alias("lat_dms"), geo.dms(C("lon"), "lon").alias("lon_dms"), geo.decimal_degrees(C("lat"), "lat").alias("lat_dd"), geo.decimal_degrees(C("lon"), "lon").alias("lon_dd"))


PLACES = ["Delhi", " new delhi ", "12.5, -70.25", "95, 10", "10 20", "atlantis", "GOA", "12.5,"]


@register("j9_locate", """WITH p AS (SELECT c_custkey AS k, c_custkey % 12 AS i, c_custkey * 7 % 200 - 100 AS a, c_custkey * 13 % 400 - 200 AS b FROM customer),
v AS (SELECT * FROM (VALUES (0, 'Delhi', 28.6139::DOUBLE, 77.209::DOUBLE, 'city'), (1, ' new delhi ', 28.6139::DOUBLE, 77.209::DOUBLE, 'city'), (2, '12.5, -70.25', 12.5::DOUBLE, -70.25::DOUBLE, 'pair'), (3, '95, 10', NULL, NULL, 'out of range'), (4, '10 20', 10::DOUBLE, 20::DOUBLE, 'pair'), (5, 'atlantis', NULL, NULL, 'unknown'), (6, 'GOA', 15.2993::DOUBLE, 74.124::DOUBLE, 'city'), (7, '12.5,', NULL, NULL, 'unknown')) t(i, q, lat, lon, how))
SELECT k, coalesce(v.q, a || ', ' || b) AS q, CASE WHEN v.q IS NOT NULL THEN lat WHEN abs(a) <= 90 AND abs(b) <= 180 THEN a::DOUBLE END AS lat, CASE WHEN v.q IS NOT NULL THEN lon WHEN abs(a) <= 90 AND abs(b) <= 180 THEN b::DOUBLE END AS lon,
 CASE WHEN v.q IS NOT NULL THEN how WHEN abs(a) <= 90 AND abs(b) <= 180 THEN 'pair' ELSE 'out of range' END AS how FROM p LEFT JOIN v USING (i)""")
def j9_locate(spark, d):
    """Every customer looks for one of the places, or for a pair of numbers of its own."""
    k = C("c_custkey")
    own = F.concat((k * 7 % 200 - 100).cast("string"), F.lit(", "), (k * 13 % 400 - 200).cast("string"))
    place = F.when(k % 12 < len(PLACES), F.get(F.array(*map(F.lit, PLACES)), (k % 12).cast("int"))).otherwise(own)
    return geo.locate(synth.table(spark, d, "customer").select(k.alias("k"), place.alias("q")))


@register("k1_scores", "WITH s AS (SELECT p_partkey AS k, p_size / 50.0 AS m, (p_partkey % 97) / 97.0 AS a FROM part) SELECT k, round(least(1.0, 0.5 + 0.3 * m + 2 * a), 6) AS change, round(least(greatest((m - 0.05 + 0.2) / 0.6, 0.0), 1.0), 6) AS water_o, round(least(greatest((-14 - (a * -30) + 5) / 15, 0.0), 1.0), 6) AS water_r, round(least(1.0, m / 0.5), 6) AS struct_o, round(least(greatest((a * -30 + 8 + 5) / 10, 0.0), 1.0), 6) AS struct_r, round(least(1.0, m / 0.6), 6) AS flood_o, round(least(greatest((-14 - (a * -30) + 3) / 10, 0.0), 1.0), 6) AS flood_r FROM s")
def k1_scores(spark, d):
    m, a = C("p_size") / 50.0, C("p_partkey") % 97 / 97.0
    vv = a * -30.0
    return synth.table(spark, d, "part").select(C("p_partkey").alias("k"), r6(F.least(F.lit(1.0), 0.5 + 0.3 * m + 2.0 * a), "change"), r6(scores.water_optical(m, F.lit(0.05)), "water_o"), r6(scores.water_radar(vv, F.lit(-14.0)), "water_r"), r6(scores.structure_optical(m), "struct_o"), r6(scores.structure_radar(vv, F.lit(-8.0)), "struct_r"), r6(scores.flooded_optical(m), "flood_o"), r6(scores.flooded_radar(vv, F.lit(-14.0)), "flood_r"))


EXT = "e AS (SELECT s_suppkey AS id, 'EPSG:' || (32642 + s_suppkey % 2) AS crs, s_suppkey * 3701 % 400000 AS l, s_suppkey * 7919 % 400000 AS b FROM supplier)"


def _extents(spark, d, k: int, size: float):
    s = synth.table(spark, d, "supplier")
    key = C("s_suppkey")
    left, bottom = (key * 3701 % 400000 + k).cast("double"), (key * 7919 % 400000 + k).cast("double")
    return s.select(key.alias("id"), F.concat(F.lit("EPSG:"), (32642 + key % 2).cast("string")).alias("crs"), left.alias("left"), bottom.alias("bottom"), (left + size).alias("right"), (bottom + size).alias("top"))


@register("j5_extents", f"WITH {EXT} SELECT a.id AS id1, b.id AS id2, a.crs, greatest(a.l, b.l + 1500)::DOUBLE AS \"left\", greatest(a.b, b.b + 1500)::DOUBLE AS bottom, least(a.l + 40000, b.l + 26500)::DOUBLE AS \"right\", least(a.b + 40000, b.b + 26500)::DOUBLE AS top, greatest(5, round_even((least(a.l + 40000, b.l + 26500) - greatest(a.l, b.l + 1500)) / 60.0, 0))::INT AS out_w, greatest(5, round_even((least(a.b + 40000, b.b + 26500) - greatest(a.b, b.b + 1500)) / 60.0, 0))::INT AS out_h FROM e a JOIN e b ON a.crs = b.crs AND a.l < b.l + 26500 AND b.l + 1500 < a.l + 40000 AND a.b < b.b + 26500 AND b.b + 1500 < a.b + 40000")
def j5_extents(spark, d):
    pairs = align.extents(_extents(spark, d, 0, 40000.0), _extents(spark, d, 1500, 25000.0))
    return align.grid(pairs.withColumns({"res_x": F.lit(60.0), "res_y": F.lit(60.0)})).select("id1", "id2", "crs", "left", "bottom", "right", "top", "out_w", "out_h")


@register("s5_resample")
def s5_resample(spark, d):
    """Tiles of one map unit per pixel, on a grid shifted by a quarter and half as fine."""
    t = synth.tiles(spark, d)
    ids = t.select("scene_id").distinct()
    src = ids.select("scene_id", F.lit(0.0).alias("left"), F.lit(8.0).alias("top"), F.lit(1.0).alias("res_x"), F.lit(1.0).alias("res_y"))
    to = ids.select("scene_id", F.lit(0.25).alias("left"), F.lit(7.75).alias("top"), F.lit(1.0).alias("res_x"), F.lit(1.0).alias("res_y"), F.lit(7).alias("out_w"), F.lit(7).alias("out_h"))
    return align.resample(t, src, to, ["v"]).select("scene_id", "y", "x", r6("v"), r6("coverage"))


@register("j7_qa_pairs", "WITH q AS (SELECT conv_id * 1000 + turn AS id, text AS question FROM conversations WHERE role = 'user'), a AS (SELECT conv_id * 1000 + turn - 1 AS question_id, text AS answer FROM conversations WHERE role = 'assistant') SELECT id, question, answer FROM q JOIN a ON id = question_id")
def j7_qa_pairs(spark, d):
    c = synth.table(spark, d, "conversations")
    key = C("conv_id") * 1000 + C("turn")
    q = c.where("role = 'user'").select(key.alias("id"), C("text").alias("question"))
    a = c.where("role = 'assistant'").select((key - 1).alias("question_id"), C("text").alias("answer"), F.lit(0).alias("ord"))
    return qa.pairs(q, a).select("id", "question", "answer")


@register("j8_example_files", "WITH f AS (SELECT page_id, list_extract(['.png', '.tif', '.jpeg', '.txt'], (page_id % 4 + 1)::INT) AS e FROM pages) SELECT '/data/' || d.doc_id || CASE WHEN f.e IN ('.png', '.tif', '.jpeg') THEN f.e ELSE '.tif' END AS image, d.lang AS question, d.source AS answer FROM documents d LEFT JOIN f ON f.page_id = d.doc_id")
def j8_example_files(spark, d):
    k = C("page_id")
    ext = F.element_at(F.array(*map(F.lit, (".png", ".tif", ".jpeg", ".txt"))), (k % 4 + 1).cast("int"))
    files = synth.table(spark, d, "pages").select(F.concat(k.cast("string"), ext).alias("name"))
    e = synth.table(spark, d, "documents").select(C("doc_id").alias("img_id"), C("lang").alias("question"), C("source").alias("answer"))
    return qa.with_files(e, files, "/data")


@register("src6_event_json", "SELECT event_id, json_valid(props) AS ok, event_type FROM events")
def src6_event_json(spark, d):
    e = synth.table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull().alias("ok"), "event_type")


_times = lambda a, b: f"((({a})::HUGEINT * ({b})::HUGEINT) % 4294967296)::BIGINT"


@register("src9_random", f"WITH a AS (SELECT c_custkey AS seed, (c_custkey + 1831565813) % 4294967296 AS a FROM customer), b AS (SELECT seed, {_times('xor(a, a >> 15)', 'a | 1')} AS t FROM a), c AS (SELECT seed, xor((t + {_times('xor(t, t >> 7)', 't | 61')}) % 4294967296, t) AS t FROM b) SELECT seed::INT AS seed, 0::INT AS i, round(xor(t, t >> 14) / 4294967296.0::DOUBLE, 6) AS value FROM c")
def src9_random(spark, d):
    """The first number of every customer's generator."""
    seeds = synth.table(spark, d, "customer").select(C("c_custkey").alias("seed"))
    return synth.mulberry(seeds, "seed", 1).select(C("seed").cast("int").alias("seed"), "i", r6("value"))


@register("src11_uploads", "SELECT doc_id, octet_length(encode(text))::BIGINT AS size FROM documents WHERE doc_id % 5 <> 4 AND length(text) > 0")
def src11_uploads(spark, d):
    k = C("doc_id")
    ext = F.element_at(F.array(*map(F.lit, (".png", ".jpg", ".gif", ".tif", ".exe"))), (k % 5 + 1).cast("int"))
    f = synth.table(spark, d, "documents").select("doc_id", F.concat(F.lit("f"), ext).alias("name"), F.lit(None).cast("string").alias("declared"), C("text").cast("binary").alias("content"))
    return images.uploads(f).select("doc_id", F.octet_length("content").cast("long").alias("size"))


@register("r1_router", f"WITH {ASKED}, c AS (SELECT k, q, k % 3 AS n, {case('t', text.INTENTS, 'vqa')} FROM a) SELECT k AS request_id, CASE WHEN n < 1 OR (t IN ('change', 'fusion') AND n < 2) THEN 'Validation Error' ELSE CASE t WHEN 'vqa' THEN 'Single-Image VQA' WHEN 'grounding' THEN 'Region Grounding' WHEN 'change' THEN 'Bi-Temporal Change Analysis' WHEN 'fusion' THEN 'Optical + SAR Fusion' ELSE 'Scene Captioning' END END AS task, CASE WHEN n < 1 OR (t IN ('change', 'fusion') AND n < 2) THEN 0 WHEN t = 'vqa' THEN 60 ELSE 50 END AS confidence FROM c")
def r1_router(spark, d):
    n = (C("k") % 3).cast("int")
    q = asked(spark, d).select(C("k").alias("request_id"), "query", n.alias("n_images"), F.array_repeat(F.lit("image/png"), n).alias("content_types"))
    return router.answered(q).select("request_id", "task", "confidence")


@register("snk6_response", "SELECT o_custkey, count(*)::BIGINT AS n, max(o_orderkey) AS last FROM orders GROUP BY 1")
def snk6_response(spark, d):
    """A nested response per customer as JSON text, read back into columns."""
    o = synth.table(spark, d, "orders")
    doc = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("orders"))
    text_ = doc.select("o_custkey", F.to_json(F.struct("o_custkey", "orders")).alias("j"))
    back = text_.select("o_custkey", F.from_json("j", "o_custkey long, orders array<struct<o_orderkey:long,o_totalprice:double>>").alias("r"))
    return back.select("o_custkey", F.size("r.orders").cast("long").alias("n"), F.element_at("r.orders", -1)["o_orderkey"].alias("last"))


@register("snk2_pictures")
def snk2_pictures(spark, d):
    from ..functions import colour
    from ..sources import png

    t = synth.tiles(spark, d)
    r, g, b = colour.heat(C("v"))
    return png.pictures(t.select("scene_id", "y", "x", r.alias("r"), g.alias("g"), b.alias("b")), ["r", "g", "b"])
