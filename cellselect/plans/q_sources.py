"""Sources and sinks: derived data is written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.operators import cells as C
from cellselect.operators import retrieval as V
from cellselect.operators import spatial as S
from cellselect.operators import catalog as O
from cellselect.operators.scale import with_chunks
from cellselect.plans.registry import query
from cellselect.session import scratch_path
from cellselect.sources import files as S_
from cellselect.sources.named_files import write_named


@query("s1_read_metadata", """
SELECT pano_id, round(lat, 6) AS lat, round(lng, 6) AS lng FROM samples WHERE sample_key % 11 <> 5""", "samples")
def s1(t):
    """Every eleventh latitude is written as junk and must be skipped."""
    path = scratch_path(t.spark, "meta")
    lat = F.when(F.col("sample_key") % 11 == 5, "n/a").otherwise(F.col("lat").cast("string"))
    t.samples.select("pano_id", lat.alias("lat"), F.col("lng").cast("string").alias("lng")).write.csv(path, header=True)
    return S_.read_metadata(t.spark, path).select("pano_id", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


def _paths(t):
    k = F.col("sample_key")
    root = F.when(k % 3 == 0, "pool_b").otherwise("pool_a")
    ext = F.when(k % 6 == 1, ".png").otherwise(".jpg")
    one = t.samples.select(F.concat(F.lit("/data/"), root, F.lit("/"), "pano_id", ext).alias("path"),
                           F.when(k % 3 == 0, 1).otherwise(0).alias("priority"))
    two = t.samples.where(k % 5 == 2).select(
        F.concat(F.lit("/data/pool_c/"), "pano_id", F.lit(".jpg")).alias("path"), F.lit(2).alias("priority"))
    return one.unionByName(two)


@query("s2_list_images", """
SELECT pano_id, CASE WHEN sample_key % 6 = 1 THEN 'pool_c' WHEN sample_key % 3 = 0 THEN 'pool_b' ELSE 'pool_a' END AS source_dir
FROM samples WHERE sample_key % 6 <> 1 OR sample_key % 5 = 2""", "samples")
def s2(t):
    """Files of three folders, some ids in two of them and some with another suffix, written and listed. They lie
    in 256 folders of each and are empty, as listing reads names only: a file of a byte takes a block of disk. They
    are links of a few empty files: one inode each is more than a disk has at 50 million samples."""
    path = scratch_path(t.spark, "pools")
    folder = F.lpad(F.hex(F.crc32("path") % 256), 2, "0")
    name = F.concat(F.regexp_extract("path", "^/data/([^/]+/)", 1), folder, F.lit("/"), F.regexp_extract("path", "([^/]+)$", 1))
    tasks = 4 * t.spark.sparkContext.defaultParallelism
    write_named(_paths(t).repartition(tasks, folder).select(name.alias("name"), F.lit(b"").alias("content")), path, link_empty=True)
    roots = [f"{path}/{pool}" for pool in ("pool_a", "pool_b", "pool_c")]
    return S_.list_images(t.spark, roots, nested=True).select("pano_id", "source_dir")


def _feed(t):
    path = scratch_path(t.spark, "feed")
    rows = with_chunks(t.samples.withColumn("g", F.lit(0)), ["g"], ["pano_id"], 5000)
    c = F.collect_list(F.struct(F.col("pano_id").alias("panoId"), "lat", "lng"))
    rows.groupBy("g", "chunk").agg(c.alias("customCoordinates")).select("customCoordinates").write.json(path)
    return path


@query("s3_read_feed", """
SELECT pano_id FROM samples WHERE NOT starts_with(pano_id, 'CAo')
AND pano_id NOT IN (SELECT lpad(cast(l_orderkey * 2 AS varchar), 22, '0') FROM lineitem)""", "samples")
def s3(t):
    return S_.read_feed(t.spark, _feed(t), _seen_large(t), multi_line=False).select("pano_id")


@query("s3_large_feed", """
SELECT pano_id FROM samples WHERE NOT starts_with(pano_id, 'CAo')
AND pano_id NOT IN (SELECT lpad(cast(l_orderkey * 2 AS varchar), 22, '0') FROM lineitem)""", "samples")
def s3_large(t):
    """The same feed, its coordinates cut out of the files by many tasks."""
    return S_.read_feed(t.spark, _feed(t), _seen_large(t), large=True).select("pano_id")


def _seen_large(t):
    return t.read("lineitem").select(F.lpad((F.col("l_orderkey") * 2).cast("string"), 22, "0").alias("pano_id"))


@query("s4_seen_ids", """
SELECT pano_id FROM samples WHERE height = 1664 UNION SELECT pano_id FROM samples WHERE source = 'scout'
UNION SELECT pano_id FROM samples WHERE capture_month < '1993-01'""", "samples")
def s4(t):
    ids, log_ = scratch_path(t.spark, "ids"), scratch_path(t.spark, "log")
    S_.write_ids(t.samples.where("height = 1664"), ids)
    S_.write_log(t.samples.where("source = 'scout'"), log_)
    files = t.samples.where("capture_month < '1993-01'").select("pano_id")
    return S_.seen_ids(t.spark, ids, log_, files)


@query("s5_write_log", "SELECT count(*) AS n, count(DISTINCT pano_id) AS ids FROM samples", "samples")
def s5(t):
    path = scratch_path(t.spark, "log")
    S_.write_log(t.samples.where("height IS NULL"), path)
    S_.write_log(t.samples.where("height IS NOT NULL"), path)
    rows = t.spark.read.schema("pano_id string, lat double, lng double").csv(path, header=True)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pano_id").alias("ids"))


def _feature():
    ring = F.transform("rings", lambda r: F.transform(
        F.concat(r, F.array(F.element_at(r, 1))), lambda p: F.array(p["x"], p["y"])))
    return F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry"),
        F.struct(F.col("gid_0").alias("GID_0"), F.col("country").alias("COUNTRY"), "layer", "ord").alias("properties"))


@query("s6_read_geojson", "SELECT sample_key, gid_0 AS country_code FROM sample_geo", "sample_geo")
def s6(t):
    """Boundaries written as GeoJSON features, read back and joined with all samples."""
    path = scratch_path(t.spark, "geojson")
    t.boundaries.select(F.to_json(_feature()).alias("value")).write.text(path)
    return _placed(t, S_.read_geojson(t.spark, path, multi_line=False))


@query("s6_large_geojson", "SELECT sample_key, gid_0 AS country_code FROM sample_geo", "sample_geo")
def s6_large(t):
    """Boundaries written as one FeatureCollection per layer and cut out by tasks."""
    path = scratch_path(t.spark, "collections")
    texts = t.boundaries.select("layer", F.to_json(_feature()).alias("v")).groupBy("layer").agg(F.array_join(F.collect_list("v"), ",\n").alias("v"))
    texts.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "v", F.lit("]}")).alias("value")).write.text(path)
    return _placed(t, S_.read_geojson(t.spark, path, large=True))


def _placed(t, polygons):
    out = S.reverse_geocode(t.samples.select("sample_key", "lat", "lng"), S.cover_tiles(polygons, 4.0), 4.0)
    return out.select("sample_key", "country_code")


@query("s9_read_guides", r"""
SELECT stem, md5(raw) AS digest FROM guides""", "guides")
def s9(t):
    """Every guide as its own text file, read back whole."""
    path = scratch_path(t.spark, "guides")
    write_named(t.guides.select(F.concat("stem", F.lit(".txt")).alias("name"), F.col("raw").cast("binary").alias("content")), path)
    return S_.read_guides(t.spark, path, "*.txt").select("stem", F.md5("raw").alias("digest"))


@query("s10_cells_parquet", "SELECT level, count(*) AS cells, cast(sum(n) AS bigint) AS rows FROM cell_stats WHERE level = 9 GROUP BY level", "cell_stats")
def s10(t):
    path = scratch_path(t.spark, "cells")
    S_.write_cells(C.cell_stats(t.s2_samples), path)
    return (S_.read_cells(t.spark, path).where("level = 9").groupBy("level")
            .agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows")))


@query("s16_write_prototypes", "SELECT l9 AS cell_idx, count(*) AS n, round(sum(e[1]), 6) AS first FROM vectors GROUP BY l9", "vectors")
def s16(t):
    path = scratch_path(t.spark, "index")
    S_.write_prototypes(t.protos, path)
    return t.spark.read.parquet(path).groupBy("cell_idx").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.element_at("embedding", 1)), 6).alias("first"))


@query("s17_merge_shards", "SELECT vec_id % 4 AS shard, count(*) AS n FROM vectors GROUP BY vec_id % 4", "vectors")
def s17(t):
    paths = []
    for i in range(4):
        path = scratch_path(t.spark, f"shard{i}")
        S_.write_shard(t.protos.where(F.col("vec_id") % 4 == i), path, i, 9)
        paths.append(path)
    merged = V.merge_shards(S_.read_shards(t.spark, paths))
    return merged.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("u3_shard_concat", "SELECT vec_id, l9 AS cell_idx FROM vectors", "vectors")
def u3(t):
    halves = [t.protos.where(F.col("vec_id") % 2 == i) for i in (0, 1)]
    return halves[0].unionByName(halves[1]).select("vec_id", "cell_idx")


@query("s18_vocab_json", "SELECT idx, code FROM countries", "countries")
def s18(t):
    path = scratch_path(t.spark, "vocab")
    S_.write_vocab(t.countries, path)
    return S_.read_vocab(t.spark, path)


@query("s19_read_weights", """
SELECT n_name AS code, round(1 + n_nationkey / 10.0, 6) AS weight, count(*) AS n FROM samples JOIN nation ON country_code = n_name GROUP BY ALL""", "samples")
def s19(t):
    path = scratch_path(t.spark, "weights")
    pairs = F.map_from_entries(F.collect_list(F.struct("n_name", (F.col("n_nationkey") / 10 + 1).cast("double"))))
    full = F.map_concat(F.create_map(F.lit("_comment"), F.lit(0.0)), pairs)
    t.read("nation").agg(F.to_json(F.struct(full.alias("weights"))).alias("value")).coalesce(1).write.text(path)
    w = S_.read_weights(t.spark, path).withColumn("weight", F.round("weight", 6))
    per_code = t.samples.groupBy(F.col("country_code").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return w.join(per_code, "code")


@query("j14_country_weight", """
SELECT sample_key, coalesce(1 + n_nationkey / 10.0, 1.0) AS weight FROM samples LEFT JOIN nation ON country_code = n_name AND n_regionkey <> 2
""", "samples")
def j14(t):
    w = t.read("nation").where("n_regionkey <> 2").select(F.col("n_name").alias("code"), (F.col("n_nationkey") / 10 + 1).alias("weight"))
    return O.country_weights(t.samples, w).select("sample_key", "weight")


@query("s20_read_country_dist", "SELECT level, count(*) AS n, round(sum(p), 6) AS mass FROM country_dist GROUP BY level", "country_dist")
def s20(t):
    path = scratch_path(t.spark, "dist")
    C.country_dist(t.label_long).write.partitionBy("level").parquet(path)
    return (S_.read_country_dist(t.spark, path).groupBy("level")
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 6).alias("mass")))


@query("s21_events_ndjson", "SELECT event, count(*) AS n, cast(max(request_id) AS bigint) AS last FROM progress GROUP BY event", "progress")
def s21(t):
    path = scratch_path(t.spark, "events")
    S_.write_events(t.progress, path)
    return S_.read_events(t.spark, path).groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.max("request_id").alias("last"))
