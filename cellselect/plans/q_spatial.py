"""Point in polygon, proximity, nearest, raster, polygon sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.functions import geo
from cellselect.operators import spatial as S
from cellselect.plans.registry import query
from cellselect.plans.views import hav, pip, tile

AFFINE = (-180.0, 90.0, 1.0, 1.0, 180, 360)  # x0, y0, dx, dy, rows, cols of the climate raster
POP_AFFINE = (-18040095.7, 9020047.85, 100222.753889, 100222.753889, 180, 360)


def cover(t):
    return S.cover_tiles(t.boundaries, 4.0)


def geocoded(t, points, **kw):
    return S.reverse_geocode(points, cover(t), 4.0, **kw)


@query("j5_point_in_polygon", "SELECT sample_key, gid_0 AS country_code, layer FROM sample_geo", "sample_geo")
def j5(t):
    p = t.samples.select("sample_key", "lat", "lng")
    return geocoded(t, p).select("sample_key", "country_code", F.col("hit_layer").alias("layer"))


_TX, _TY = tile("lat", "lng", 12)
_M = hav("p.lat", "p.lng", "c.lat", "c.lng", "6371000.0")


@query("j6_covered", f"""
SELECT DISTINCT p.sample_key FROM (SELECT *, {_TX} AS tx, {_TY} AS ty FROM samples) p
JOIN (SELECT *, {_TX} AS tx, {_TY} AS ty FROM coverage) c USING (tx, ty) WHERE {_M} <= 2500""", "samples coverage")
def j6(t):
    return S.covered(t.samples.select("sample_key", "lat", "lng"), t.coverage, 2500, 12).select("sample_key")


_KM = hav("p.lat", "p.lng", "c.lat", "c.lng")


@query("j7_nearest", f"""
SELECT sample_key, point_id, round(d, 6) AS distance_km FROM (
  SELECT p.sample_key, c.point_id, {_KM} AS d, row_number() OVER (PARTITION BY p.sample_key ORDER BY {_KM}, c.point_id) AS rn
  FROM samples p JOIN coverage c ON abs(p.lat - c.lat) < 0.1 WHERE {_KM} <= 5) WHERE rn = 1""", "samples coverage")
def j7(t):
    out = S.nearest(t.samples, t.coverage, 5.0, "sample_key", "point_id")
    return out.withColumn("distance_km", F.round("distance_km", 6))


@query("j10_raster_sample", """
SELECT sample_key, nullif(value, 0) AS koppen_class,
       CASE WHEN value BETWEEN 1 AND 3 THEN 'A' WHEN value BETWEEN 4 AND 7 THEN 'B' WHEN value BETWEEN 8 AND 16 THEN 'C'
            WHEN value BETWEEN 17 AND 28 THEN 'D' WHEN value BETWEEN 29 AND 30 THEN 'E' END AS koppen_group
FROM samples LEFT JOIN raster ON row_idx = cast(floor(90 - lat) AS bigint) AND col_idx = cast(floor(lng + 180) AS bigint)
""", "samples raster")
def j10(t):
    return (S.climate(t.samples, t.raster_blocks, AFFINE)
            .select("sample_key", "koppen_class", "koppen_group"))


@query("s8_raster_table", """
SELECT value, count(*) AS n FROM samples JOIN raster
ON row_idx = cast(floor(90 - lat) AS bigint) AND col_idx = cast(floor(lng + 180) AS bigint) WHERE value <> 7 GROUP BY value
""", "samples raster")
def s8(t):
    out = S.raster_sample(t.samples, t.raster_blocks, AFFINE, "value", nodata=7)
    return out.where(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("j17_same_country", """
SELECT sample_key, coalesce(gid_0, '') = '' OR country_code IS NULL OR lower(gid_0) = lower(country_code)
       OR contains(lower(gid_0), lower(country_code)) OR contains(lower(country_code), lower(gid_0)) AS same
FROM sample_geo JOIN samples USING (sample_key)""", "samples sample_geo")
def j17(t):
    p = t.samples.select("sample_key", "lat", "lng", F.concat(F.lit("Region, "), F.col("country_code")).alias("hub"))
    g = geocoded(t, p)
    return g.select("sample_key", S.same_country(F.col("country_name"), F.col("hub")).alias("same"))


@query("j21_enrich", """
SELECT s.sample_key, length(s.pano_id) = 22 AS is_official, g.gid_0 AS geo_country, s.s2_l9, nullif(r.value, 0) AS koppen_class,
       cast(d.value AS double) * 60 AS pop_per_km2, coalesce(d.value * 60 >= 1500, false) AS is_urban
FROM s2_samples s JOIN sample_geo g USING (sample_key) JOIN moll m USING (sample_key)
LEFT JOIN raster r ON r.row_idx = cast(floor(90 - s.lat) AS bigint) AND r.col_idx = cast(floor(s.lng + 180) AS bigint)
LEFT JOIN raster d ON d.row_idx = cast(floor((9020047.85 - m.y) / 100222.753889) AS bigint) AND d.col_idx = cast(floor((m.x + 18040095.7) / 100222.753889) AS bigint)
""", "s2_samples sample_geo raster moll")
def j21(t):
    """One enrichment pass: polygons, cells, climate, density, flags."""
    density = S.map_blocks(t.raster_blocks, lambda v: v * 60)
    p = S.enrich(t.samples.select("sample_key", "pano_id", "lat", "lng"), cover(t), t.raster_blocks, AFFINE, density, POP_AFFINE)
    return p.select("sample_key", "is_official", F.col("country_code").alias("geo_country"), geo.s2_text(F.col("s2_l9")).alias("s2_l9"),
                    "koppen_class", "pop_per_km2", "is_urban")


@query("j22_geocode_candidates", f"""
WITH cand AS (SELECT query_id, level, rnk, centroid_lat AS lat, centroid_lng AS lng, query_id * 1000000 + level * 1000 + rnk AS cand_key
              FROM probs JOIN cells USING (level, idx) WHERE rnk <= 3)
SELECT query_id, level, string_agg(coalesce(gid_0, '??'), ',' ORDER BY rnk) AS codes
FROM cand LEFT JOIN ({pip('cand', 'cand_key')}) USING (cand_key) GROUP BY query_id, level""", "probs cells edges")
def j22(t):
    from cellselect.operators import scores as R
    top = R.topk_candidates(t.scores, 3, t.cells).withColumnsRenamed({"centroid_lat": "lat", "centroid_lng": "lng"})
    g = geocoded(t, top.select("query_id", "level", "rank", "lat", "lng"))
    return (g.groupBy("query_id", "level")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(
                F.struct("rank", F.coalesce("country_code", F.lit("??")).alias("c")))), lambda s: s["c"]), ",").alias("codes")))


@query("u5_polygon_union", "SELECT sample_key, gid_0 IS NOT NULL AS inside FROM sample_geo", "sample_geo")
def u5(t):
    return S.within_any(t.samples.select("sample_key", "lat", "lng"), t.boundaries, 4.0).select("sample_key", "inside")


@query("f4_bbox_override", """
SELECT code, count(*) AS n FROM (
  SELECT CASE WHEN la BETWEEN 22.108 AND 22.222 AND ln BETWEEN 113.526 AND 113.601 THEN 'MAC'
              WHEN la BETWEEN 22.135 AND 22.510 AND ln BETWEEN 113.820 AND 114.510 THEN 'HKG' END AS code
  FROM (SELECT 22.1 + (sample_key % 977) / 1900.0 AS la, 113.5 + (sample_key % 883) / 800.0 AS ln FROM samples)) GROUP BY code
""", "samples")
def f4(t):
    k = F.col("sample_key")
    p = t.samples.select((F.lit(22.1) + (k % 977) / 1900.0).alias("lat"), (F.lit(113.5) + (k % 883) / 800.0).alias("lng"))
    return p.groupBy(X.bbox_override("lat", "lng")["code"].alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("w11_sample_points", "SELECT count(*) AS n, count(*) AS draws, count(*) AS inside FROM customer")
def w11(t):
    """As many uniform points inside the polygons as there are customers, each draw once."""
    n = t.read("customer").count()
    p = S.sample_points(t.spark, t.boundaries, n, seed=7, size=4.0)
    return geocoded(t, p, overrides=False).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("draw").alias("draws"), F.count("hit_layer").alias("inside"))


@query("p4_cover_tiles", """
SELECT gid_0, count(*) AS near FROM samples, boundaries
WHERE floor(lng / 4) * 4 <= x1 AND floor(lng / 4) * 4 + 4 >= x0 AND floor(lat / 4) * 4 <= y1 AND floor(lat / 4) * 4 + 4 >= y0 GROUP BY gid_0
""", "samples boundaries")
def p4(t):
    """Samples in a tile of each polygon's cover."""
    root = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).alias(c) for c in ("tx", "ty")]
    tiles = cover(t).select(*root, F.explode("cands").alias("c")).select("tx", "ty", F.col("c.gid_0").alias("gid_0")).distinct()
    p = t.samples.select(F.floor(F.col("lng") / 4).alias("tx"), F.floor(F.col("lat") / 4).alias("ty"))
    per_tile = p.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    return per_tile.join(tiles, ["tx", "ty"]).groupBy("gid_0").agg(F.sum("n").alias("near"))


@query("s7_boundary_layers", "SELECT layer, count(*) AS n FROM sample_geo GROUP BY layer", "sample_geo")
def s7(t):
    """Samples by the layer that names them, from three layer tables."""
    from cellselect.sources import files
    b = files.read_boundaries({n: t.boundaries.where(F.col("layer") == n).drop("layer") for n in (0, 1, 2)})
    out = S.reverse_geocode(t.samples.select("lat", "lng"), S.cover_tiles(b, 4.0), 4.0)
    return out.groupBy(F.col("hit_layer").alias("layer")).agg(F.count(F.lit(1)).alias("n"))
