"""Nothing is lost without a word: feeds, id files, ingests, samples, covers, images, NaN, null keys."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cellselect.operators import sampling as P
from cellselect.operators import spatial as S
from cellselect.operators.scale import exact_percentiles, first_n, with_chunks
from cellselect.session import shared_dir, tune
from cellselect.sources import files
from cellselect.streaming import events as X


def box(spark, x0, y0, x1, y1):
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    row = (0, 0, "A", "A", None, None, None, None, [[(float(x), float(y)) for x, y in ring]])
    return spark.createDataFrame([row], "layer int, ord long, gid_0 string, country string, gid_1 string, name_1 string, "
                                        "gid_2 string, name_2 string, rings array<array<struct<x:double,y:double>>>")


def test_feed_has_no_default_cap(spark, tmp_path):
    n = 310_000
    rows = spark.range(n).select(F.struct(F.lpad(F.col("id").cast("string"), 22, "0").alias("panoId"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng")).alias("c"), "id")
    rows.groupBy(F.floor(F.col("id") / 5000)).agg(F.collect_list("c").alias("customCoordinates")).select("customCoordinates").write.json(str(tmp_path / "f"))
    seen = spark.createDataFrame([], "pano_id string")
    assert files.read_feed(spark, str(tmp_path / "f"), seen, multi_line=False).count() == n
    first = files.read_feed(spark, str(tmp_path / "f"), seen, limit=3, multi_line=False)
    assert sorted(r.pano_id for r in first.collect()) == [str(i).zfill(22) for i in range(3)]


def test_seen_ids_reads_what_write_ids_wrote(spark, tmp_path):
    ids = spark.range(25_000).select(F.col("id").cast("string").alias("pano_id"))
    files.write_ids(ids, str(tmp_path / "ids"))
    assert files.seen_ids(spark, str(tmp_path / "ids")).count() == 25_000
    (tmp_path / "one.json").write_text('[\n  "a",\n  "b", "c"\n]\n')
    assert files.seen_ids(spark, str(tmp_path / "one.json")).count() == 3


def test_two_ingests_keep_both(spark, tmp_path):
    def ingest(low, high, run):
        src = tmp_path / f"src{run}"
        spark.range(low, high).select(F.col("id").cast("string").alias("k"), "id").write.parquet(str(src))
        stream = spark.readStream.schema("k string, id long").parquet(str(src))
        X.stream_ingest(stream, str(tmp_path / "target"), str(tmp_path / f"state{run}"), "k", ["id"]).awaitTermination()

    ingest(0, 100, 1)
    ingest(80, 150, 2)
    rows = spark.read.parquet(str(tmp_path / "target"))
    assert rows.count() == 150 and rows.select("k").distinct().count() == 150


def test_sample_points_returns_n_or_raises(spark):
    ring = [(0.0, 0.0), (8.0, 8.0), (8.05, 8.0), (0.05, 0.0)]
    thin = box(spark, 0, 0, 1, 1).withColumn("rings", F.array(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring])))
    assert S.sample_points(spark, thin, 500).count() == 500
    speck = box(spark, 0.5, 0.5, 0.5000001, 0.5000001)
    with pytest.raises(ValueError, match="fell inside"):
        S.sample_points(spark, speck, 10, least_share=1e-3)


def test_cover_brings_its_tile_size(spark):
    cover = S.cover_tiles(box(spark, 10, 10, 30, 30), 4.0)
    point = spark.createDataFrame([(1, 20.5, 20.5)], "id int, lat double, lng double")
    assert S.reverse_geocode(point, cover).first().country_code == "A"
    assert S.reverse_geocode(point, cover.checkpoint() if shared_dir(spark) else cover).first().country_code == "A"
    with pytest.raises(ValueError, match="tiles of 4.0"):
        S.reverse_geocode(point, cover, 1.0)


def test_broken_image_and_open_geometry(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"not an image")
    row = files.read_images(spark, str(tmp_path)).first()
    assert row.error == "undecodable" and row.width is None
    (tmp_path / "line.json").write_text('{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{}}\n')
    with pytest.raises(PySparkException, match="no polygon but LineString"):
        files.read_geojson(spark, str(tmp_path / "line.json"), multi_line=False).collect()


def test_nan_orders_last_in_percentiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (math.nan,), (math.inf,)], "v double")
    assert exact_percentiles(df.where("not isnan(v) or v is null").unionByName(df.where("isnan(v)")).where("v <> double('infinity') or isnan(v)"),
                             "v", {"m": 0.5}).first().m == 2.5
    assert exact_percentiles(df, "v", {"m": 0.5}).first().m == 3.0


def test_null_keys_are_chunked(spark):
    df = spark.range(5000).select("id", F.lit(None).cast("string").alias("k"))
    sizes = with_chunks(df, ["k"], ["id"], 100).groupBy("chunk").count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] < 200 and sizes[1] == 5000


def test_first_n_and_heavy_weight(spark):
    df = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    want = sorted((r.h, r.id) for r in df.collect())[:7000]
    assert sorted((r.h, r.id) for r in first_n(df, ["h", "id"], 7000).collect()) == want
    heavy = spark.range(2000).select("id", F.when(F.col("id") == 7, 1e9).otherwise(1.0).alias("w"))
    drawn = P.weighted_resample(heavy, "id", "w", 3000)
    assert drawn.count() == 3000 and drawn.where("id = 7").count() >= 2990


def test_dense_tile_of_coverage(spark):
    cover = spark.range(100_000).select(F.col("id").alias("point_id"), (F.lit(10.0) + F.col("id") * 1e-9).alias("lat"), F.lit(20.0).alias("lng"))
    points = spark.range(50).select(F.col("id").alias("sample_key"), (F.lit(10.0) + F.col("id") * 1e-6).alias("lat"), F.lit(20.0).alias("lng"))
    assert S.covered(points, cover, 100).count() == 50
    assert S.covered(points, cover, 100, neighbours=True).count() == 50
    near = S.nearest(points, cover, 1.0, "sample_key", "point_id")
    other = S.nearest(points, cover, 1.0, "sample_key", "point_id", spread="points")
    assert near.count() == 50 and sorted(near.collect()) == sorted(other.collect())


def test_busy_request_is_told_in_time(spark, tmp_path):
    rows = [(1, i, i * 60) for i in range(20)]
    df = spark.createDataFrame(rows, "request_id long, event_id long, s long").select(
        "request_id", "event_id", F.timestamp_seconds("s").alias("ts"), F.lit("stage1_start").alias("event"))
    out = {(r.reason, r.after.minute) for r in X.stalled(df, 900, 600).collect()}
    assert ("total", 10) in out


def test_settings_of_the_session_stay(spark):
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        assert tune(spark).conf.get("spark.sql.adaptive.skewJoin.enabled") == "false"
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
