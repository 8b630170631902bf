import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.functions import geo
from cellselect.operators import spatial as S


def points(spark, n, seed=1, span=1.0):
    rng = np.random.default_rng(seed)
    lat = np.degrees(np.arcsin(rng.uniform(-1, 1, n))) * span
    lng = rng.uniform(-180, 180, n) * span
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lng))]


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


# published vectors: leading hex digits of the leaf id
def test_s2_known(spark):
    rows = [(48.8566, 2.3522, "47E66E"), (37.7749, -122.4194, "808580"), (-33.86, 151.2, "6B12AE"), (0.0, 0.0, "100000")]
    got = spark.createDataFrame(rows, "lat double, lng double, want string").repartition(2).select(
        F.hex(geo.s2_leaf("lat", "lng")).alias("h"), "want").collect()
    assert all(r.h.startswith(r.want) for r in got)


def test_s2_forms_agree_and_contain(spark):
    df = spark.createDataFrame(points(spark, 3000), "id long, lat double, lng double").repartition(4)
    df = geo.with_s2_leaf(df, "lat", "lng", "c")
    assert df.where(F.col("c") != geo.s2_leaf("lat", "lng")).count() == 0
    assert df.where(geo.s2_from_text(geo.s2_text(F.col("c"))) != F.col("c")).count() == 0
    up = df.where(geo.s2_parent(geo.s2_parent("c", 12), 6) != geo.s2_parent("c", 6)).count()
    assert up == 0
    faces = df.select(F.shiftrightunsigned("c", 61).alias("f")).distinct().count()
    assert faces == 6


def test_s2_polygon_holds_point(spark):
    df = spark.createDataFrame([p for p in points(spark, 400, 3) if abs(p[1]) < 60 and abs(p[2]) < 170], "id long, lat double, lng double").repartition(4)
    out = df.select("lat", "lng", geo.s2_polygon(geo.s2_cell("lat", "lng", 12), 12).alias("p")).collect()
    for r in out:
        lats, lngs = [c.lat for c in r.p], [c.lng for c in r.p]
        assert min(lats) - 1e-3 <= r.lat <= max(lats) + 1e-3
        assert min(lngs) - 1e-3 <= r.lng <= max(lngs) + 1e-3


def test_s2_walk_neighbours(spark):
    """Consecutive level-8 cells along the curve share a corner."""
    lsb = 1 << 2 * 22
    df = spark.range(500).select((F.lit(0x1000000000000000 | lsb) + F.col("id") * (2 * lsb)).alias("c"))
    ring = [r.p for r in df.select(geo.s2_polygon("c", 8).alias("p")).collect()]
    for a, b in zip(ring, ring[1:]):
        near = min(hav(p.lat, p.lng, q.lat, q.lng) for p in a for q in b)
        assert near < 1e-6


def test_mollweide_known(spark):
    r = spark.range(1).select(geo.mollweide_xy(F.lit(0.0), F.lit(180.0)).alias("a"), geo.mollweide_xy(F.lit(90.0), F.lit(0.0)).alias("b")).first()
    assert abs(r.a.x - 18040095.696) < 0.01 and abs(r.a.y) < 1e-6
    assert abs(r.b.y - 9020047.848) < 2000  # Newton is slow at the pole itself


def test_blake2b_exact(spark):
    r = spark.range(1).select(X.hash_uniform(F.lit("abc"), F.lit(None).cast("string"), "blake2b").alias("u")).first()
    want = int.from_bytes(hashlib.blake2b(b"_unk:abc", digest_size=8).digest(), "big") / 2 ** 64
    assert r.u == want


def test_haversine_antipode(spark):
    r = spark.range(1).select(geo.haversine_km(0.0, 0.0, 0.0, 180.0).alias("d")).first()
    assert abs(r.d - math.pi * 6371.0) < 1e-6


def star(cx, cy, n, seed):
    rng = np.random.default_rng(seed)
    ang = np.sort(rng.uniform(0, 2 * np.pi, n))
    rad = rng.uniform(2, 9, n)
    return [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a, r in zip(ang, rad)]


def inside(rings, x, y):
    hit = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
    return hit


def polygons(spark, shift=0):
    rows, rings = [], {}
    for i in range(6):
        ring = star(i * 7 - 20, i * 5 - 12, 25, i)
        ring = ring[shift:] + ring[:shift]
        hole = [(i * 7 - 20.6, i * 5 - 12.3), (i * 7 - 19.4, i * 5 - 12.4), (i * 7 - 20.1, i * 5 - 11.2)]
        rings[i] = [ring, hole]
        rows.append((i % 3, i, f"G{i}", f"N{i}", f"G{i}.1", "a", f"G{i}.1.1", "b", rings[i]))
    schema = ("layer int, ord long, gid_0 string, country string, gid_1 string, name_1 string, gid_2 string, name_2 string, "
              "rings array<array<struct<x:double,y:double>>>")
    return spark.createDataFrame(rows, schema), rings


def test_point_in_polygon_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(rng.uniform(-25, 25, 2000), rng.uniform(-32, 28, 2000)))]
    df = spark.createDataFrame(pts, "id long, lat double, lng double")
    results = []
    for size, shift in ((1.0, 0), (3.0, 4), (0.37, 9)):
        polys, rings = polygons(spark, shift)
        got = {r.id: r.country_code for r in S.reverse_geocode(df, S.cover_tiles(polys, size), size).collect()}
        want = {}
        for i, lat, lng in pts:
            hits = sorted((k % 3, k) for k, r in rings.items() if inside(r, lng, lat))
            want[i] = f"G{hits[0][1]}" if hits else None
        assert got == want
        results.append(got)
    assert results[0] == results[1] == results[2]


def test_edge_points_are_outside(spark):
    square = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]]
    schema = ("layer int, ord long, gid_0 string, country string, gid_1 string, name_1 string, gid_2 string, name_2 string, "
              "rings array<array<struct<x:double,y:double>>>")
    polys = spark.createDataFrame([(0, 1, "A", "A", "A", "A", "A", "A", square)], schema)
    pts = spark.createDataFrame([(1, 0.0, 2.0), (2, 2.0, 0.0), (3, 4.0, 4.0), (4, 2.0, 2.0), (5, 3.999, 0.001)], "id long, lat double, lng double")
    got = {r.id for r in S.reverse_geocode(pts, S.cover_tiles(polys, 1.0), 1.0).where("country_code is not null").collect()}
    assert got == {4, 5}


def test_admin_columns_and_overrides(spark):
    polys, _ = polygons(spark)
    pts = spark.createDataFrame([(1, 22.2, 113.55), (2, -12.0, -20.0 + 1.5), (3, 80.0, 80.0)], "id long, lat double, lng double")
    rows = {r.id: r for r in S.reverse_geocode(pts, S.cover_tiles(polys), 1.0).collect()}
    assert rows[1].country_code == "MAC" and rows[1].admin1_code is None
    assert rows[2].country_code == "G0" and rows[2].admin2_name == "b"
    assert rows[3].country_code is None and rows[3].country_name is None


def test_nearest_brute_force_with_poles_and_date_line(spark):
    p = points(spark, 400, 11) + [(1000, 89.95, 10.0), (1001, -89.9, -170.0), (1002, 5.0, 179.99), (1003, 5.0, -179.99), (1004, 90.0, 0.0), (1005, -90.0, 7.0)]
    q = points(spark, 500, 12) + [(2000, 89.9, -170.0), (2001, -89.95, 20.0), (2002, 5.1, -179.9), (2003, 5.1, 179.9), (2004, 5.1, 179.9)]
    a = spark.createDataFrame(p, "id long, lat double, lng double")
    b = spark.createDataFrame(q, "tid long, lat double, lng double")
    for radius in (40.0, 600.0):
        got = {r.id: (r.tid, round(r.distance_km, 6)) for r in S.nearest(a, b, radius, "id", "tid").collect()}
        want = {}
        for i, la, ln in p:
            d, t = min((hav(la, ln, x, y), t) for t, x, y in q)
            if d <= radius:
                want[i] = (t, round(d, 6))
        assert got.keys() == want.keys()
        assert all(abs(got[k][1] - want[k][1]) < 1e-5 for k in want)
        assert got[1003][0] == want[1003][0]


@pytest.mark.parametrize("spread", ["targets", "points"])
def test_nearest_in_crowds_and_at_shared_places(spark, spread):
    """Rounds of growing radii give what one radius gives, and copies of a place meet once."""
    p = [(i, 10 + i % 40 * 0.005, 20 + i % 37 * 0.004) for i in range(300)] + [(900, -89.99, 5.0), (901, 50.0, 50.0)]
    q = [(t, 10 + t % 50 * 0.0031, 20 + t % 23 * 0.0047) for t in range(2000)] + [(5000, -89.98, 170.0), (5001, 10.19, 20.2), (7, 50.03, 50.0)]
    a = spark.createDataFrame(p, "id long, lat double, lng double")
    b = spark.createDataFrame(q, "tid long, lat double, lng double")
    want = {}
    for i, la, ln in p:
        d, t = min((round(hav(la, ln, x, y), 9), t) for t, x, y in q)
        if d <= 5.0:
            want[i] = (t, round(d, 5))
    got = {r.id: (r.tid, round(r.distance_km, 5)) for r in S.nearest(a, b, 5.0, "id", "tid", spread, crowd=4).collect()}
    assert got == want and len(want) > 295
    assert {r.id: (r.tid, round(r.distance_km, 5)) for r in S.nearest(a, b, 5.0, "id", "tid", spread).collect()} == want


def test_nearest_compares_places_not_rows(spark):
    """A million pairs of copies are one pair of places."""
    a = spark.range(1000).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    b = spark.range(1000).select((F.col("id") + 5).alias("tid"), F.lit(1.001).alias("lat"), F.lit(2.0).alias("lng"))
    packs = []
    real = S.packed

    def spy(df, *args):
        packs.append(df.count())
        return real(df, *args)

    S.packed = spy
    try:
        out = S.nearest(a, b, 5.0, "id", "tid")
    finally:
        S.packed = real
    assert max(packs) <= 12 and {r.tid for r in out.collect()} == {5} and out.count() == 1000


def test_pairs_within_brute_force(spark):
    p, q = points(spark, 150, 21), points(spark, 200, 22)
    a = spark.createDataFrame(p, "id long, lat double, lng double")
    b = spark.createDataFrame(q, "idx long, centroid_lat double, centroid_lng double")
    got = {(r.id, r.idx) for r in S.pairs_within(a, b, 900.0).collect()}
    assert got == {(i, j) for i, la, ln in p for j, x, y in q if hav(la, ln, x, y) <= 900.0}


def test_covered_same_tile_and_neighbours(spark):
    # two points across a tile edge: only the neighbour form sees the cover
    edge = 360.0 / 2 ** 17
    a = spark.createDataFrame([(1, 0.001, edge * 10 - 1e-5), (2, 0.001, edge * 10 + 2e-5)], "sample_key long, lat double, lng double")
    c = spark.createDataFrame([(9, 0.001, edge * 10 + 1e-5)], "point_id long, lat double, lng double")
    assert {r.sample_key for r in S.covered(a, c).collect()} == {2}
    assert {r.sample_key for r in S.covered(a, c, neighbours=True).collect()} == {1, 2}


def test_sample_points_inside_and_stable(spark):
    polys, rings = polygons(spark)
    one = S.sample_points(spark, polys, 200, seed=3, oversample=4).collect()
    two = S.sample_points(spark, polys, 200, seed=3, oversample=4).collect()
    assert one == two and len(one) == 200
    assert all(any(inside(r, p.lng, p.lat) for r in rings.values()) for p in one)


def test_population_nodata(spark):
    raster = spark.createDataFrame([(0, 0, 5.0), (0, 1, -3.0), (1, 0, -9999.0)], "row_idx long, col_idx long, value double")
    affine = (-1e7, 1e7, 1e7, 1e7, 2, 2)
    pts = spark.createDataFrame([(1, 10.0, -50.0), (2, 10.0, 50.0), (3, -10.0, -50.0)], "id long, lat double, lng double")
    got = {r.id: (r.pop_per_km2, r.is_urban) for r in S.population(pts, raster, affine, nodata=-9999.0).collect()}
    assert got == {1: (5.0, False), 2: (0.0, False), 3: (None, False)}


@pytest.mark.parametrize("size", [2, 5, 256])
def test_raster_blocks_give_the_pixels(spark, size):
    """Blocks of any size, missing pixels, nodata and a repeated pixel; a block is one row."""
    rows = [(r, c, float(r * 20 + c)) for r in range(13) for c in range(17) if (r + c) % 5] + [(0, 1, -1.0), (3, 3, -9999.0)]
    pixels = spark.createDataFrame(rows, "row_idx long, col_idx long, value double")
    blocks = S.raster_blocks(pixels, size)
    assert blocks.count() == -(-13 // size) * -(-17 // size)
    assert {len(b["values"]) for b in blocks.collect()} == {size * size}
    affine = (0.0, 13.0, 1.0, 1.0, 13, 17)
    pts = spark.createDataFrame([(i, 13 - r - 0.5, c + 0.5) for i, (r, c) in enumerate((r, c) for r in range(-1, 14) for c in range(-1, 18))], "id int, lat double, lng double")
    got = {r.id: r.v for r in S.raster_sample(pts, blocks, affine, "v", nodata=-9999.0).collect()}
    want = {r.id: r.v for r in S.raster_sample(pts, pixels.groupBy("row_idx", "col_idx").agg(F.max("value").alias("value")), affine, "v", nodata=-9999.0).collect()}
    assert got == want and len(got) == pts.count()


def test_raster_join_carries_blocks_only(spark):
    """The raster side of the join has one row per block in the plan, and no pixel key."""
    pixels = spark.range(40_000).select(F.floor(F.col("id") / 200).alias("row_idx"), (F.col("id") % 200).alias("col_idx"), F.col("id").alias("value"))
    blocks = S.raster_blocks(pixels, 100)
    pts = spark.createDataFrame([(150.5, 20.5)], "lat double, lng double")
    out = S.raster_sample(pts, blocks, (0.0, 200.0, 1.0, 1.0, 200, 200), "v")
    assert blocks.count() == 4 and out.first()["v"] == (200 - 151) * 200 + 20
