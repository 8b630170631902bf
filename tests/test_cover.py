"""Quadtree cover: bounded rows whatever the detail of a boundary, and the points of a plain crossing test."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellselect.operators import spatial as S

SCHEMA = ("layer int, ord long, gid_0 string, country string, gid_1 string, name_1 string, gid_2 string, name_2 string, "
          "rings array<array<struct<x:double,y:double>>>")


def polygons(spark, shapes):
    rows = [(layer, n, name, name, None, None, None, None, [[(float(x), float(y)) for x, y in ring] for ring in rings])
            for n, (layer, name, rings) in enumerate(shapes)]
    return spark.createDataFrame(rows, SCHEMA)


def wobbly(n, cx, cy, r, seed):
    rng = np.random.default_rng(seed)
    a = np.arange(n) / n * 2 * math.pi
    rad = r * (1 + 0.25 * np.sin(7 * a) + 0.02 * rng.normal(size=n))
    return list(zip(cx + rad * np.cos(a), cy + rad * np.sin(a)))


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        p = np.array(ring)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, 0)):
            cross = (ay > y) != (by > y)
            with np.errstate(all="ignore"):
                odd ^= cross & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def held(cover):
    return cover.select("level", F.aggregate("cands", F.lit(0), lambda n, c: n + F.coalesce(F.size(c["edges"]), F.lit(0))).alias("n"))


@pytest.mark.parametrize("size,most", [(4.0, 16), (30.0, 40), (1.0, 30)])
def test_points_in_detailed_polygons(spark, size, most):
    """A rough coast with a lake, a small country inside the lake's row and a coarse box below both."""
    coast, lake, dot = wobbly(3000, 3.3, -2.1, 9, 1), wobbly(400, 2, -2, 2, 2), wobbly(150, 14.2, 3.7, 0.8, 3)
    box = [(-20, -20), (25, -20), (25, 20), (-20, 20)]
    shapes = [(0, "coast", [coast, lake]), (0, "dot", [dot]), (2, "box", [box])]
    cover = S.cover_tiles(polygons(spark, shapes), size, most).checkpoint() if S.shared_dir(spark) else None
    worst = held(cover).agg(F.max("n").alias("n"), F.max("level").alias("level")).first()
    assert worst["n"] <= most and worst["level"] > 0
    rng = np.random.default_rng(9)
    x, y = rng.uniform(-30, 30, 4000), rng.uniform(-25, 25, 4000)
    near = np.array(coast)[rng.integers(0, 3000, 2000)] + rng.normal(0, 0.05, (2000, 2))
    x, y = np.r_[x, near[:, 0]], np.r_[y, near[:, 1]]
    pts = spark.createDataFrame(list(zip(range(len(x)), y.tolist(), x.tolist())), "id int, lat double, lng double")
    got = {r.id: r.country_code for r in S.reverse_geocode(pts, cover, overrides=False).collect()}
    assert len(got) == len(x) == S.reverse_geocode(pts, cover).count()
    want = np.full(len(x), None, object)
    for _, name, rings in reversed(shapes):
        want[inside(rings, x, y)] = name
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_a_coarse_boundary_is_not_cut(spark):
    cover = S.cover_tiles(polygons(spark, [(0, "a", [[(0, 0), (9, 0), (9, 9), (0, 9)]])]), 2.0)
    assert cover.agg(F.max("level")).first()[0] == 0


def test_borders_on_tile_lines_with_deep_cuts(spark):
    """Neighbours that share borders on the lines along which tiles are cut: every inner point has its owner."""
    shapes = [(0, f"{i}{j}", [[(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]]) for i in range(4) for j in range(4)]
    cover = S.cover_tiles(polygons(spark, shapes), 4.0, 9)
    assert held(cover).agg(F.max("n")).first()[0] <= 9  # the corner of four squares has eight
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 4, (500, 2))
    df = spark.createDataFrame([(n, float(b), float(a)) for n, (a, b) in enumerate(p)], "id int, lat double, lng double")
    got = {r.id: r.country_code for r in S.reverse_geocode(df, cover, overrides=False).collect()}
    assert all(got[n] == f"{int(a)}{int(b)}" for n, (a, b) in enumerate(p))


def test_edges_that_meet_in_a_point_stop_at_the_depth(spark):
    spokes = [(math.cos(a) * (1 if k % 2 else 0.001), math.sin(a) * (1 if k % 2 else 0.001)) for k, a in enumerate(np.arange(64) / 64 * 2 * math.pi)]
    cover = S.cover_tiles(polygons(spark, [(0, "star", [spokes])]), 1.0, 8, max_depth=4)
    assert cover.agg(F.max("level")).first()[0] == 4


@pytest.mark.parametrize("most", [2, 256])
def test_points_keep_columns_of_the_cover_s_names(spark, most):
    cover = S.cover_tiles(polygons(spark, [(0, "a", [[(0, 0), (9, 0), (9, 9), (5, 12), (0, 9)]])]), 4.0, most, max_depth=6)
    pts = spark.createDataFrame([(7, "x", "y", "z", 1, 2, 3.0, 3.0), (8, "x", "y", "z", 1, 2, 30.0, 3.0)],
                                "level int, tx string, ty string, cands string, levels int, size int, lat double, lng double")
    out = sorted(S.reverse_geocode(pts, cover).select(*pts.columns, "country_code").collect())
    assert [tuple(r) for r in out] == [(7, "x", "y", "z", 1, 2, 3.0, 3.0, "a"), (8, "x", "y", "z", 1, 2, 30.0, 3.0, None)]
