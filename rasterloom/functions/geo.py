"""Coordinates: distances, areas, seeds, formats, and the offline gazetteer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS_KM = 6371.0

#: The offline gazetteer (name, latitude, longitude).
CITIES = """ahmedabad 23.0225 72.5714; delhi 28.6139 77.2090; new delhi 28.6139 77.2090; mumbai 19.0760 72.8777; bangalore 12.9716 77.5946;
bengaluru 12.9716 77.5946; chennai 13.0827 80.2707; kolkata 22.5726 88.3639; hyderabad 17.3850 78.4867; pune 18.5204 73.8567;
jaipur 26.9124 75.7873; lucknow 26.8467 80.9462; kanpur 26.4499 80.3319; nagpur 21.1458 79.0882; indore 22.7196 75.8577;
bhopal 23.2599 77.4126; visakhapatnam 17.6868 83.2185; patna 25.5941 85.1376; vadodara 22.3072 73.1812; surat 21.1702 72.8311;
rajkot 22.3039 70.8022; gandhinagar 23.2156 72.6369; chandigarh 30.7333 76.7794; kochi 9.9312 76.2673; thiruvananthapuram 8.5241 76.9366;
coimbatore 11.0168 76.9558; madurai 9.9252 78.1198; varanasi 25.3176 83.0059; agra 27.1767 78.0081; amritsar 31.6340 74.8723;
srinagar 34.0837 74.7973; guwahati 26.1445 91.7362; bhubaneswar 20.2961 85.8245; ranchi 23.3441 85.3096; dehradun 30.3165 78.0322;
shimla 31.1048 77.1734; goa 15.2993 74.1240; panaji 15.4909 73.8278; noida 28.5355 77.3910; gurgaon 28.4595 77.0266;
gurugram 28.4595 77.0266; faridabad 28.4089 77.3178; ghaziabad 28.6692 77.4538; mysore 12.2958 76.6394; mysuru 12.2958 76.6394;
jodhpur 26.2389 73.0243; udaipur 24.5854 73.7125; allahabad 25.4358 81.8463; prayagraj 25.4358 81.8463"""


def cities(spark: SparkSession) -> DataFrame:
    rows = [(" ".join(p[:-2]), float(p[-2]), float(p[-1])) for p in (c.split() for c in CITIES.split(";"))]
    return spark.createDataFrame(rows, "city string, city_lat double, city_lon double")


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat, half_lon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return F.lit(2.0 * RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def polygon_area_km2(points: Column) -> Column:
    """Spherical area of an array of (lat, lng) structs; the last point joins the first."""
    n = F.size(points)

    def part(p: Column, i: Column) -> Column:
        q = F.element_at(points, F.when(i + 1 < n, i + 2).otherwise(F.lit(1)).cast("int"))
        return (F.radians(q["lng"]) - F.radians(p["lng"])) * (2.0 + F.sin(F.radians(p["lat"])) + F.sin(F.radians(q["lat"])))

    total = F.aggregate(F.transform(points, part), F.lit(0.0), lambda a, v: a + v)
    return F.when(n >= 3, F.abs(total) * (RADIUS_KM * RADIUS_KM / 2.0)).otherwise(F.lit(0.0))


def centroid(points: Column, field: str) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[field]) / F.size(points)


def half_up(v: Column) -> Column:
    """Ties towards plus infinity."""
    return F.floor(v + 0.5)


def seed(lat: Column, lon: Column) -> Column:
    return F.abs(half_up(lat * 10000.0 + lon * 7919.0 + 100000.0)) % F.lit(2147483647)


def scene_id(s: Column) -> Column:
    return F.concat(F.lit("S2-L2A-DEMO-"), F.lpad(s.cast("string"), 8, "0"))


def demo_cloud(s: Column) -> Column:
    return 3 + s % 37


def demo_cover(s: Column) -> tuple[Column, Column, Column]:
    built, water = 12 + s % 28, 5 + s % 15
    return built, water, F.greatest(F.lit(8).cast("long"), 92 - built - water)


def footprint(lat: Column, lon: Column, half: float = 0.045) -> Column:
    return F.struct((lat - half).alias("south"), (lon - half).alias("west"), (lat + half).alias("north"), (lon + half).alias("east"))


def hemisphere(v: Column, axis: str) -> Column:
    plus, minus = ("N", "S") if axis == "lat" else ("E", "W")
    return F.when(v >= 0, plus).otherwise(minus)


def dms(v: Column, axis: str) -> Column:
    """Degrees, minutes, seconds with one decimal, hemisphere."""
    size = F.abs(v)
    degree = F.floor(size)
    minute = (size - degree) * 60.0
    second = (minute - F.floor(minute)) * 60.0
    return F.concat(degree.cast("string"), F.lit("° "), F.floor(minute).cast("string"), F.lit("′ "), F.format_string("%.1f", second), F.lit("″ "), hemisphere(v, axis))


def decimal_degrees(v: Column, axis: str) -> Column:
    return F.concat(F.format_string("%.4f", F.abs(v)), F.lit("° "), hemisphere(v, axis))


def parse_pair(text: Column) -> tuple[Column, Column, Column]:
    """(latitude, longitude, recognised) of "lat, lon" text; out of range is recognised but null."""
    pattern = r"^\s*(-?\d+\.?\d*)\s*[, ]\s*(-?\d+\.?\d*)\s*$"
    is_pair = text.rlike(pattern)
    lat, lon = (F.when(is_pair, F.regexp_extract(text, pattern, k).try_cast("double")) for k in (1, 2))
    good = lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(good, lat), F.when(good, lon), is_pair


def locate(queries: DataFrame, column: str = "q") -> DataFrame:
    """Adds lat, lon and how they were found: pair, city, out of range, or unknown. No network is asked."""
    lat, lon, is_pair = parse_pair(F.col(column))
    found = queries.join(F.broadcast(cities(queries.sparkSession)), F.lower(F.trim(F.col(column))) == F.col("city"), "left")
    how = F.when(lat.isNotNull(), "pair").when(is_pair, "out of range").when(F.col("city").isNotNull(), "city").otherwise("unknown")
    return found.select(*[F.col(c) for c in queries.columns], F.coalesce(lat, F.when(~is_pair, F.col("city_lat"))).alias("lat"), F.coalesce(lon, F.when(~is_pair, F.col("city_lon"))).alias("lon"), how.alias("how"))
