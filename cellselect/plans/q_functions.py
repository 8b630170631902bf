"""Scalar expressions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.functions import constants as K
from cellselect.functions import geo
from cellselect.functions import text as T
from cellselect.operators import catalog as O
from cellselect.plans.registry import query
from cellselect.plans.blake2b import blake2b_sql
from cellselect.plans.views import hav, sha_uniform, tile


@query("e1_haversine_km", f"SELECT sample_key, round({hav('lat', 'lng', '48.8566', '2.3522')}, 6) AS km FROM samples", "samples")
def e1(t):
    return t.samples.select("sample_key", F.round(geo.haversine_km("lat", "lng", 48.8566, 2.3522), 6).alias("km"))


@query("e2_haversine_m", f"SELECT sample_key, round({hav('lat', 'lng', 'lat + 0.001', 'lng - 0.002', '6371000.0')}, 4) AS m FROM samples", "samples")
def e2(t):
    m = geo.haversine_m("lat", "lng", F.col("lat") + 0.001, F.col("lng") - 0.002)
    return t.samples.select("sample_key", F.round(m, 4).alias("m"))


_TX, _TY = tile("lat", "lng", 17)


@query("e3_latlng_to_tile", f"SELECT sample_key, cast(17 AS bigint) AS z, {_TX} AS x, {_TY} AS y FROM samples", "samples")
def e3(t):
    return t.samples.select("sample_key", geo.latlng_to_tile("lat", "lng").alias("t")).select("sample_key", "t.*")


@query("e4_s2_cell", "SELECT sample_key, s2_l3, s2_l6, s2_l9, s2_l12 FROM s2_samples", "s2_samples")
def e4(t):
    return t.s2_samples.select("sample_key", *[geo.s2_text(F.col(f"s2_l{n}")).alias(f"s2_l{n}") for n in geo.LEVELS])


@query("e5_s2_parent", "SELECT sample_key, s2_l6 AS parent FROM s2_samples", "s2_samples")
def e5(t):
    return t.s2_samples.select("sample_key", geo.s2_text(geo.s2_parent("s2_l12", 6)).alias("parent"))


@query("e6_s2_text", """
SELECT sample_key, s2_l12 AS token, CASE WHEN cast(s2_l12 AS hugeint) > 9223372036854775807
       THEN cast(cast(s2_l12 AS hugeint) - 18446744073709551616 AS bigint) ELSE cast(s2_l12 AS bigint) END AS bits FROM s2_samples""", "s2_samples")
def e6(t):
    token = geo.s2_text(F.col("s2_l12"))
    return t.s2_samples.select("sample_key", token.alias("token"), geo.s2_from_text(token).alias("bits"))


@query("e7_s2_polygon", "SELECT DISTINCT s2_l9 AS cell, cast(4 AS bigint) AS corners, true AS centre_inside, true AS corners_outside FROM s2_samples", "s2_samples")
def e7(t):
    """Corners of every cell: their middle lies in the cell, points just beyond them do not."""
    cells = t.s2_samples.select("s2_l9").distinct()
    p = cells.select("s2_l9", F.explode(geo.s2_polygon("s2_l9", 9)).alias("p")).select(
        "s2_l9", F.radians("p.lat").alias("a"), F.radians("p.lng").alias("o"))
    p = p.select("s2_l9", F.struct((F.cos("a") * F.cos("o")).alias("x"), (F.cos("a") * F.sin("o")).alias("y"), F.sin("a").alias("z")).alias("v"))
    m = p.groupBy("s2_l9").agg(F.collect_list("v").alias("vs"), F.struct(*[F.avg(f"v.{c}").alias(c) for c in "xyz"]).alias("m"))

    def cell(v):
        return geo.s2_cell(F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))), F.degrees(F.atan2(v["y"], v["x"])), 9)

    def beyond(v):  # a hundredth of the way past the corner, seen from the middle
        return F.struct(*[(v[c] + (v[c] - F.col("m")[c]) * 0.01).alias(c) for c in "xyz"])

    past = m.select("s2_l9", "m", F.size("vs").cast("long").alias("corners"), F.explode("vs").alias("v"))
    past = past.select("s2_l9", "m", "corners", beyond(F.col("v")).alias("b"))
    flat = past.select("s2_l9", "corners", cell(F.col("m")).alias("inner"), cell(F.col("b")).alias("outer"))
    return flat.groupBy("s2_l9", "corners").agg(F.bool_and(F.col("inner") == F.col("s2_l9")).alias("centre_inside"),
                                               F.bool_and(F.col("outer") != F.col("s2_l9")).alias("corners_outside")).select(
        geo.s2_text(F.col("s2_l9")).alias("cell"), "corners", "centre_inside", "corners_outside")


@query("e8_hash_uniform", "SELECT sample_key, round(u, 9) AS u FROM split_samples", "split_samples")
def e8(t):
    return t.split_samples.select("sample_key", F.round("u", 9).alias("u"))


@query("e9_split_label", f"""
SELECT sample_key, CASE WHEN u < 0.02 THEN 'test' WHEN u < 0.05 THEN 'val' ELSE 'train' END AS split
FROM (SELECT sample_key, {sha_uniform('pano_id', 'country_code')} AS u FROM samples)""", "samples")
def e9(t):
    return t.samples.select("sample_key", X.split_label(X.hash_uniform("pano_id", "country_code")).alias("split"))


@query("p3_blake2b_uniform", f"""WITH {blake2b_sql("SELECT sample_key AS id, coalesce(country_code, '_unk') || ':' || pano_id AS s FROM samples")}
SELECT sample_key, u, CASE WHEN u < 0.02 THEN 'test' WHEN u < 0.05 THEN 'val' ELSE 'train' END AS split
FROM (SELECT id AS sample_key, cast(h AS double) / 18446744073709551616.0 AS u FROM blake)""", "samples")
def p3(t):
    u = X.hash_uniform("pano_id", "country_code", "blake2b")
    return t.samples.select("sample_key", u.alias("u")).withColumn("split", X.split_label("u"))


@query("e10_is_official", "SELECT sample_key, length(pano_id) = 22 AS official FROM samples", "samples")
def e10(t):
    return t.samples.select("sample_key", X.is_official("pano_id").alias("official"))


@query("e11_camera_generation", """
SELECT sample_key, cast(CASE height WHEN 1664 THEN 1 WHEN 6656 THEN 23 WHEN 8192 THEN 4 ELSE 0 END AS bigint) AS generation FROM samples""", "samples")
def e11(t):
    return t.samples.select("sample_key", X.camera_generation("height").alias("generation"))


@query("e12_crop_paths", """
SELECT sample_key, substr(pano_id, 1, 2) AS shard, concat(substr(pano_id, 1, 2), '/', pano_id, '_', lpad(cast(h * 90 AS varchar), 3, '0'), '.jpg') AS path
FROM samples, range(4) AS r(h)""", "samples")
def e12(t):
    return t.samples.select("sample_key", X.shard_key("pano_id").alias("shard"), F.explode(X.crop_paths("pano_id")).alias("path"))


@query("e13_koppen_group", """
SELECT sample_key, CASE WHEN c BETWEEN 1 AND 3 THEN 'A' WHEN c BETWEEN 4 AND 7 THEN 'B' WHEN c BETWEEN 8 AND 16 THEN 'C'
       WHEN c BETWEEN 17 AND 28 THEN 'D' WHEN c BETWEEN 29 AND 30 THEN 'E' END AS grp FROM (SELECT sample_key, sample_key % 31 AS c FROM samples)""", "samples")
def e13(t):
    return t.samples.select("sample_key", X.koppen_group(F.col("sample_key") % 31).alias("grp"))


@query("e14_is_urban", """
SELECT sample_key, coalesce(pop >= 1500, false) AS urban FROM (SELECT sample_key, nullif(sample_key % 3000, 7) AS pop FROM samples)""", "samples")
def e14(t):
    return t.samples.select("sample_key", X.is_urban(F.nullif(F.col("sample_key") % 3000, F.lit(7).cast("long"))).alias("urban"))




@query("e15_mollweide_xy", """
WITH n AS (SELECT sample_key, lat, lng, radians(lat) AS th, 0 AS k FROM samples
           UNION ALL SELECT sample_key, lat, lng, th - (2 * th + sin(2 * th) - pi() * sin(radians(lat))) / (2 + 2 * cos(2 * th)), k + 1 FROM n WHERE k < 8)
SELECT sample_key, round(2 * sqrt(2) / pi() * 6378137.0 * radians(lng) * cos(th), 3) AS x, round(sqrt(2) * 6378137.0 * sin(th), 3) AS y FROM n WHERE k = 8
""", "samples")
def e15(t):
    p = t.samples.select("sample_key", geo.mollweide_xy("lat", "lng").alias("p"))
    return p.select("sample_key", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@query("e16_pixel_index", """
SELECT sample_key, CASE WHEN r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 299 THEN r END AS row_idx,
       CASE WHEN r BETWEEN 0 AND 99 AND c BETWEEN 0 AND 299 THEN c END AS col_idx
FROM (SELECT sample_key, cast(floor((50 - lat) / 0.5) AS bigint) AS r, cast(floor((lng + 150) / 0.5) AS bigint) AS c FROM samples)""", "samples")
def e16(t):
    p = t.samples.select("sample_key", geo.pixel_index("lng", "lat", -150.0, 50.0, 0.5, 0.5, 100, 300).alias("p"))
    return p.select("sample_key", "p.row_idx", "p.col_idx")


_CODE = "CASE WHEN country_code IS NULL THEN NULL WHEN sample_key % 3 = 0 THEN concat('Z0', cast(sample_key % 10 AS varchar)) ELSE country_code END"


@query("e17_norm_gid0", f"""
SELECT sample_key, CASE WHEN c IN ('Z01', 'Z04', 'Z05', 'Z07', 'Z09') THEN 'IND' WHEN c IN ('Z02', 'Z03', 'Z08') THEN 'CHN' WHEN c = 'Z06' THEN 'PAK' ELSE c END AS code
FROM (SELECT sample_key, {_CODE} AS c FROM samples)""", "samples")
def e17(t):
    k = F.col("sample_key")
    c = F.when(F.col("country_code").isNotNull(),
               F.when(k % 3 == 0, F.concat(F.lit("Z0"), (k % 10).cast("string"))).otherwise(F.col("country_code")))
    return t.samples.select("sample_key", X.norm_gid0(c).alias("code"))


_NAMES = ("Japan", "SOUTH korea", "United States", "Czechia", "Atlantis", "el salvador")
_NAME_SQL = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"


@query("e22_country_iso2", f"""
SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'jp' WHEN 1 THEN 'kr' WHEN 2 THEN 'us' WHEN 3 THEN 'cz' WHEN 5 THEN 'sv' END AS code FROM conversations""")
def e22(t):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))
    return t.read("conversations").select("conv_id", "turn", T.country_iso2(name).alias("code"))


@query("e23_hub_label", """
SELECT sample_key, hub, lower(trim(CASE WHEN contains(hub, ',') THEN split_part(hub, ',', -1) ELSE hub END)) AS country FROM (
  SELECT sample_key, regexp_replace(concat(coalesce(nullif(a, 'NA'), ''), ', ', coalesce(country_code, 'unknown')), '^[, ]+', '') AS hub
  FROM (SELECT *, CASE WHEN sample_key % 3 = 0 THEN 'NA' WHEN sample_key % 3 = 1 THEN 'Region' END AS a FROM samples))""", "samples")
def e23(t):
    a = F.when(F.col("sample_key") % 3 == 0, "NA").when(F.col("sample_key") % 3 == 1, "Region")
    s = t.samples.select("sample_key", T.hub_label(a, "country_code").alias("hub"))
    return s.withColumn("country", T.hub_country("hub"))


_TYPES = "(" + ", ".join(f"'{x}'" for x in K.AREA_TYPES) + ")"


@query("e24_is_area_centroid", f"""
SELECT name, split_part(place_type, '=', 1) = 'boundary' OR split_part(place_type, '=', 2) IN {_TYPES} AS area FROM gazetteer""", "gazetteer")
def e24(t):
    return t.gazetteer.select("name", T.is_area_centroid("place_type").alias("area"))


@query("e25_explanation", """
SELECT conv_id, turn, CASE WHEN line = '' THEN 'no reason given' ELSE line END AS line FROM (
  SELECT conv_id, turn, concat_ws('; ', CASE WHEN turn % 3 <> 0 THEN role END,
    CASE WHEN conv_id % 2 = 0 THEN concat('place found: ', split_part(text, ',', 1), ' (searched ', role, ')') END,
    CASE WHEN conv_id % 5 = 0 THEN 'pin kept: why' END) AS line FROM conversations)""")
def e25(t):
    c = F.col("conv_id")
    return t.read("conversations").select("conv_id", "turn", T.explanation(
        F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")), F.when(c % 2 == 0, F.col("text")),
        "role", c % 5 != 0, F.lit("why")).alias("line"))


@query("e26_build_prompt", """
SELECT sample_key, concat('Coarse guess', chr(10), 'latitude ', printf('%.6f', lat), chr(10), 'longitude ', printf('%.6f', lng), chr(10), 'region ', coalesce(country_code, 'null'), chr(10), chr(10),
  CASE WHEN source IS NULL THEN concat('Text in the image: none', chr(10), chr(10)) ELSE concat('Text in the image', chr(10), 'language French', chr(10), 'raw ', source, chr(10), 'English "', capture_month, '"', chr(10), chr(10)) END,
  'Name the most specific feature and answer in the JSON schema. If only the country is sure, use precision country and the coarse coordinates.') AS prompt,
  concat('Guess to check', chr(10), 'latitude ', printf('%.6f', lat), chr(10), 'longitude ', printf('%.6f', lng), chr(10), 'region ', coalesce(country_code, 'null'), chr(10), chr(10),
  CASE WHEN source IS NULL THEN concat('Text read in the image: none', chr(10), chr(10)) ELSE concat('Text read in the image', chr(10), 'language French', chr(10), 'raw ', source, chr(10), 'English "', capture_month, '"', chr(10), chr(10)) END,
  'Compare script, signs and driving side in the image with the guess, list every contradiction, and answer in the JSON schema.') AS verify
FROM samples""", "samples")
def e26(t):
    parts = ("lat", "lng", "country_code", F.lit("French"), "source", "capture_month")
    return t.samples.select("sample_key", T.build_prompt(*parts).alias("prompt"), T.verification_prompt(*parts).alias("verify"))


@query("e27_image_mode", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN 'panorama' WHEN 2 THEN 'single' ELSE CASE WHEN p_size / 20.0 BETWEEN 1.85 AND 2.25 THEN 'panorama' ELSE 'single' END END AS mode FROM part""")
def e27(t):
    k = F.col("p_partkey")
    mode = F.when(k % 3 == 1, "panorama").when(k % 3 == 2, "single").otherwise("auto")
    return t.read("part").select("p_partkey", T.image_mode(F.col("p_size"), F.lit(20.0), mode).alias("mode"))


@query("f1_passes_filter", """
SELECT sample_key FROM samples WHERE length(pano_id) = 22
AND (height IS NULL OR height <> 1664) AND (source IS NULL OR source = 'launch')
AND (capture_month >= '1993-05') AND (capture_month <= '1998-03')""", "samples")
def f1(t):
    return O.admission(t.samples, after="1993-05", before="1998-03").select("sample_key")


@query("f3_filter_split", "SELECT sample_key FROM split_samples WHERE country_code = 'NATION_3' AND split = 'train'", "split_samples")
def f3(t):
    return t.split_samples.where((F.col("country_code") == "NATION_3") & (F.col("split") == "train")).select("sample_key")


@query("f5_ocr_filter", r"""
SELECT doc_id, pos FROM ocr_lines WHERE confidence >= 0.5
AND length(trim(regexp_replace(regexp_replace(text, '(?i)<(br|sup|sub|/[a-z]+)\s*/?>', ' ', 'g'), '\s+', ' ', 'g'))) > 0""", "ocr_lines")
def f5(t):
    return t.ocr_lines.where(T.ocr_filter("text", "confidence")).select("doc_id", "pos")


@query("f9_valid_coord", """
SELECT sample_key, lat * 2 BETWEEN -90 AND 90 AND lng * 1.2 BETWEEN -180 AND 180 AS valid FROM samples""", "samples")
def f9(t):
    return t.samples.select("sample_key", geo.valid_coord(F.col("lat") * 2, F.col("lng") * 1.2).alias("valid"))


@query("f10_has_text", "SELECT doc_id, pos, length(trim(text)) >= 2 AS present FROM ocr_lines", "ocr_lines")
def f10(t):
    return t.ocr_lines.select("doc_id", "pos", T.has_text("text").alias("present"))


@query("f11_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def f11(t):
    return O.by_id(t.read("orders"), "o_orderkey", 77).select("o_orderkey", "o_totalprice")


@query("t8_query_list", """
SELECT conv_id, turn, concat_ws('|', role, 'a', text) AS queries FROM conversations""")
def t8(t):
    q = T.query_list("role", F.array(F.lit("a"), F.col("text")))
    return t.read("conversations").select("conv_id", "turn", F.array_join(q, "|").alias("queries"))


@query("t9_even_subsample", """
SELECT doc_id, array_to_string(list_transform(range(0, least(4, m)), lambda i: w[cast(floor(i * (m / least(4, m))) AS bigint) + 1]), '|') AS picks
FROM (SELECT doc_id, string_split(text, ' ') AS w, len(string_split(text, ' ')) AS m FROM documents)""")
def t9(t):
    w = t.read("documents").select("doc_id", F.split("text", " ", -1).alias("w"))
    return w.select("doc_id", F.array_join(T.even_subsample("w", 4), "|").alias("picks"))


@query("t10_month_bounds", "SELECT capture_month, count(*) AS n FROM samples WHERE capture_month >= '1994-02' AND capture_month < '1996-11' GROUP BY capture_month", "samples")
def t10(t):
    m = F.col("capture_month")
    return t.samples.where((m >= "1994-02") & (m < "1996-11")).groupBy("capture_month").agg(F.count(F.lit(1)).alias("n"))


@query("t11_event_status", """
SELECT event_id, CASE event WHEN 'heartbeat' THEN NULL WHEN 'fetch_pano_start' THEN 'Loading the panorama' WHEN 'fetch_pano_done' THEN 'Panorama loaded, ? by ? pixels'
  WHEN 'stage1_start' THEN 'Coarse search running' WHEN 'stage1_done' THEN 'Coarse search says ?'
  WHEN 'stage2_extract_start' THEN 'Reading text in the image' WHEN 'stage2_extract_done' THEN concat('Read text in ', left(json_extract_string(data, '$.k'), 200), ' script')
  WHEN 'stage2_pinpoint_start' THEN 'Visual model starting' WHEN 'stage2_pinpoint_done' THEN 'Visual model names ? (?)'
  WHEN 'stage2_geocode_start' THEN 'Looking the name up' WHEN 'stage2_geocode_done' THEN 'Name not found, coarse answer stays'
  WHEN 'error' THEN 'Failed: ?' ELSE '' END AS status FROM progress""", "progress")
def t11(t):
    data = F.regexp_replace("data", '"k":', '"script":')
    return t.progress.select("event_id", T.event_status("event", data).alias("status"))
