"""Spatial joins as equi-joins on grid tiles: point in polygon, proximity, nearest, raster.

No operator here plans a cartesian or nested-loop product: both sides meet on a tile key and an
exact test follows. Polygon cover rows hold only the edges near their tile, and a bounded number of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cellselect.functions import columns as X
from cellselect.functions import geo
from cellselect.functions.text import hub_country
from cellselect.operators.cells import with_cells
from cellselect.operators.sampling import weighted_resample
from cellselect.operators.scale import first_n, packed
from cellselect.session import shared_dir

ADMIN = ("gid_0", "country", "gid_1", "name_1", "gid_2", "name_2")
KM_PER_DEGREE = 111.19492664455873  # 6371 * pi / 180


# --- polygons ---------------------------------------------------------------------------------

def polygon_edges(polygons: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, ax, ay, bx, by) for every ring side; rings close themselves."""
    rings = polygons.select(*keys, F.explode("rings").alias("r")).where(F.size("r") > 2)
    n = F.size("r")
    sides = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(
        F.element_at("r", i.cast("int")).alias("a"),
        F.element_at("r", (i % n + 1).cast("int")).alias("b")))
    return (rings.select(*keys, F.explode(sides).alias("s"))
            .select(*keys, F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"),
                    F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by")))


_KEYS = ["layer", "ord"]


def _root_tiles(edges: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """((keys, tx, ty, edge) of the tiles an edge's box touches, (keys, tx, ty, centre_in) of every tile of a
    polygon's box): the parity of a tile's centre is the number of edges that its row's centre line crosses to
    the right of it, summed from the right over the row's tiles."""
    def t(c: Column) -> Column:
        return F.floor(c / F.lit(size)).cast("long")

    lo_x, hi_x = F.least("ax", "bx"), F.greatest("ax", "bx")
    lo_y, hi_y = F.least("ay", "by"), F.greatest("ay", "by")
    # a side lying on a tile border belongs to both neighbours
    touch = (edges.withColumn("tx", F.explode(F.sequence(F.ceil(lo_x / size) - 1, t(hi_x))))
             .withColumn("ty", F.explode(F.sequence(F.ceil(lo_y / size) - 1, t(hi_y)))))
    cy = (F.col("ty") + 0.5) * size
    at = (F.col("bx") - F.col("ax")) * (cy - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")
    last = F.floor(F.col("x") / size - 0.5).cast("long")  # the last tile whose centre may lie left of x
    cross = (edges.where(F.col("ay") != F.col("by")).withColumn("ty", F.explode(F.sequence(t(lo_y) - 1, t(hi_y))))
             .where((F.col("ay") > cy) != (F.col("by") > cy)).withColumn("x", at)
             .withColumn("tx", F.when(F.col("x") > (last + 0.5) * size, last).otherwise(last - 1))
             .groupBy(*_KEYS, "ty", "tx").agg(F.count(F.lit(1)).alias("c")))
    box = edges.groupBy(*_KEYS).agg(F.min(lo_x).alias("x0"), F.max(hi_x).alias("x1"), F.min(lo_y).alias("y0"), F.max(hi_y).alias("y1"))
    right = Window.partitionBy(*_KEYS, "ty").orderBy(F.desc("tx")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = (box.withColumn("ty", F.explode(F.sequence(F.ceil(F.col("y0") / size) - 1, t(F.col("y1")))))
            .withColumn("tx", F.explode(F.sequence(F.ceil(F.col("x0") / size) - 1, t(F.col("x1")))))
            .join(cross, [*_KEYS, "ty", "tx"], "left")
            .withColumn("centre_in", F.coalesce(F.sum("c").over(right), F.lit(0)) % 2 == 1))
    return touch.select(*_KEYS, "tx", "ty", "ax", "ay", "bx", "by"), grid.select(*_KEYS, "tx", "ty", "centre_in")


def _flips(x: Column, y: Column, cx: Column, cy: Column) -> Column:
    """Whether the edge (ax, ay, bx, by) is crossed an odd number of times on the way (x, y) → (cx, y) → (cx, cy)."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    x_at = F.when((ay > y) != (by > y), (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)
    y_at = F.when((ax > cx) != (bx > cx), (by - ay) * (cx - ax) / F.nullif(bx - ax, F.lit(0.0)) + ay)
    return F.coalesce((x < x_at) != (cx < x_at), F.lit(False)) != F.coalesce((y < y_at) != (cy < y_at), F.lit(False))


def _split_tiles(touch: DataFrame, tiles: DataFrame, width: float) -> tuple[DataFrame, DataFrame]:
    """Edges and tiles of the four quarters of tiles ``width`` wide. A quarter takes the edges that run through it,
    and its centre's parity is its parent's, flipped by the parent's edges between the two centres."""
    half = width / 2
    quarters = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("q")

    def child(df: DataFrame) -> DataFrame:
        return (df.select("*", quarters).withColumns({"px": (F.col("tx") + 0.5) * width, "py": (F.col("ty") + 0.5) * width})
                .withColumns({"tx": F.col("tx") * 2 + F.col("q.i"), "ty": F.col("ty") * 2 + F.col("q.j")}).drop("q"))

    edges = child(touch)
    x0, y0 = F.col("tx") * half, F.col("ty") * half
    slack = half * 1e-9
    lo, hi = F.greatest(x0, F.least("ax", "bx")), F.least(x0 + half, F.greatest("ax", "bx"))

    def y_at(x: Column) -> Column:
        return F.coalesce(F.col("ay") + (F.col("by") - F.col("ay")) * (x - F.col("ax")) / F.nullif(F.col("bx") - F.col("ax"), F.lit(0.0)), F.lit(None))

    upright = F.col("ax") == F.col("bx")
    ends = [F.when(upright, F.col("ay")).otherwise(y_at(lo)), F.when(upright, F.col("by")).otherwise(y_at(hi))]
    through = (lo <= hi + slack) & (F.least(*ends) <= y0 + half + slack) & (F.greatest(*ends) >= y0 - slack)
    flips = (edges.where(_flips((F.col("tx") + 0.5) * half, (F.col("ty") + 0.5) * half, F.col("px"), F.col("py")))
             .groupBy(*_KEYS, "tx", "ty").agg(F.count(F.lit(1)).alias("f")))
    below = (child(tiles).join(flips, [*_KEYS, "tx", "ty"], "left")
             .select(*_KEYS, "tx", "ty", (F.col("centre_in") != (F.coalesce("f", F.lit(0)) % 2 == 1)).alias("centre_in")))
    return edges.where(through).select(*_KEYS, "tx", "ty", "ax", "ay", "bx", "by"), below


def _leaf_rows(touch: DataFrame, tiles: DataFrame, attrs: DataFrame, level: int) -> DataFrame:
    """(level, tx, ty, cands) of finished tiles; tiles wholly outside are dropped at level 0 and empty below,
    so that every point of a tile that was split finds one leaf."""
    held = touch.groupBy(*_KEYS, "tx", "ty").agg(F.collect_list(F.struct("ax", "ay", "bx", "by")).alias("edges"))
    found = tiles.join(held, [*_KEYS, "tx", "ty"], "left")
    inside = F.col("centre_in") | F.col("edges").isNotNull()
    cand = F.when(inside, F.struct(*_KEYS, *ADMIN, "centre_in", "edges"))
    rows = (found.where(inside) if level == 0 else found).join(attrs, _KEYS)
    return rows.groupBy("tx", "ty").agg(F.sort_array(F.collect_list(cand)).alias("cands")).select(F.lit(level).alias("level"), "tx", "ty", "cands")


def cover_tiles(polygons: DataFrame, size: float = 1.0, max_edges: int = 256, max_depth: int = 24) -> DataFrame:
    """Quadtree cover of polygons: (level, tx, ty, levels, cands, size), ``cands`` sorted by (layer, ord).

    Tiles of ``size`` degrees that more than ``max_edges`` edges run through are cut in four, level by level,
    until none is left; so no row holds more edges, whatever the detail of a boundary (at ``max_depth`` a
    tile stays as it is: edges that meet in one point never part). A candidate holds the parity of the
    tile's centre and the edges of the tile. A point's parity is the centre's, flipped by the edges crossed
    on the way point → (centre x, point y) → centre, so far-away edges never travel with the tile. Tiles
    wholly outside are dropped or empty; tiles wholly inside carry no edges. ``levels`` lists the levels
    within the tile's root.
    """
    edges = polygon_edges(polygons, _KEYS)
    attrs = polygons.select(*_KEYS, *ADMIN)
    touch, tiles = _root_tiles(edges, size)
    leaves, level = None, 0
    while True:
        crowded = touch.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_edges).select("tx", "ty")
        if level == max_depth or not crowded.limit(1).count():
            rest = _leaf_rows(touch, tiles, attrs, level)
            leaves = rest if leaves is None else leaves.unionByName(rest)
            break
        if level == 0:
            shared_dir(polygons.sparkSession)
            touch, tiles = touch.checkpoint(), tiles.checkpoint()
        crowded = crowded.checkpoint()
        done = [df.join(crowded, ["tx", "ty"], "left_anti") for df in (touch, tiles)]
        row = _leaf_rows(*done, attrs, level)
        leaves = row if leaves is None else leaves.unionByName(row)
        parts = [df.join(crowded, ["tx", "ty"], "left_semi") for df in (touch, tiles)]
        touch, tiles = (df.checkpoint() for df in _split_tiles(*parts, size / (1 << level)))
        level += 1
    if level:
        root = {c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))) for c in ("tx", "ty")}
        leaves = leaves.checkpoint().withColumns({"_rx": root["tx"], "_ry": root["ty"]})
        levels = leaves.groupBy("_rx", "_ry").agg(F.sort_array(F.collect_set("level")).alias("levels"))
        leaves = leaves.join(levels, ["_rx", "_ry"]).drop("_rx", "_ry")
    else:
        leaves = leaves.withColumn("levels", F.array(F.lit(0)))
    return leaves.withColumn("size", F.lit(size)).select("level", "tx", "ty", "levels", "cands", F.col("size").alias(
        "size", metadata={"size": size, "deepest": level}))


def _deepest(cover: DataFrame) -> int:
    """Deepest level of a cover, from its metadata or its rows."""
    made = cover.schema["size"].metadata.get("deepest")
    return made if made is not None else cover.agg(F.max("level")).first()[0] or 0


def contains(cand: Column, lat: Column, lng: Column, cx: Column, cy: Column) -> Column:
    """Strict containment of a point in a cover candidate."""

    def crossings(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["ax"], e["ay"], e["bx"], e["by"]
        span = (ay > lat) != (by > lat)
        x_at = F.when(span, (bx - ax) * (lat - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)
        level = F.coalesce((lng < x_at) != (cx < x_at), F.lit(False))
        wide = (ax > cx) != (bx > cx)
        y_at = F.when(wide, (by - ay) * (cx - ax) / F.nullif(bx - ax, F.lit(0.0)) + ay)
        upright = F.coalesce((lat < y_at) != (cy < y_at), F.lit(False))
        on = (((bx - ax) * (lat - ay) == (by - ay) * (lng - ax))
              & lng.between(F.least(ax, bx), F.greatest(ax, bx)) & lat.between(F.least(ay, by), F.greatest(ay, by)))
        return F.struct((acc["odd"] != (level != upright)).alias("odd"), (acc["on"] | on).alias("on"))

    walked = F.aggregate(cand["edges"], F.struct(cand["centre_in"].alias("odd"), F.lit(False).alias("on")), crossings,
                         lambda a: a["odd"] & ~a["on"])
    return F.when(cand["edges"].isNull(), cand["centre_in"]).otherwise(walked)


def _cover_size(cover: DataFrame, asked: float | None) -> float:
    """Tile size of a cover: written in its ``size`` column's metadata by ``cover_tiles``."""
    made = cover.schema["size"].metadata.get("size") if "size" in cover.columns else None
    if made is None and asked is None:
        made = cover.agg(F.max("size")).first()[0] if "size" in cover.columns else None
    if made is not None and asked is not None and made != asked:
        raise ValueError(f"the cover has tiles of {made} degrees, not {asked}")
    return float(made or asked or 1.0)


def reverse_geocode(points: DataFrame, cover: DataFrame, size: float | None = None, lat: str = "lat", lng: str = "lng",
                    overrides: bool = True) -> DataFrame:
    """Admin columns per point: boxes first, then the first strictly containing polygon by layer and
    order, else nulls. Left equi-joins on the tile; where a root tile was cut, a point is tried at each level
    that the root's leaves have, and found at one. The tile size is the cover's own; a different ``size`` is
    an error."""
    size = _cover_size(cover, size)
    la, ln = F.col(lat), F.col(lng)
    out = _in_leaf(points, cover, size, la, ln)
    wide = F.lit(size) / F.pow(F.lit(2.0), F.col("_lv"))
    cx, cy = (F.col("_tx") + 0.5) * wide, (F.col("_ty") + 0.5) * wide
    hit = F.try_element_at(F.filter("_cands", lambda c: contains(c, la, ln, cx, cy)), F.lit(1))
    out = out.withColumn("_hit", hit)
    box = X.bbox_override(lat, lng) if overrides else F.lit(None).cast("struct<code:string,name:string>")
    out = out.withColumn("_box", box)
    poly, none = F.col("_box").isNull(), F.lit(None).cast("string")
    return out.withColumns({
        "country_code": F.coalesce(F.col("_box.code"), X.norm_gid0(F.col("_hit.gid_0"))),
        "country_name": F.coalesce(F.col("_box.name"), F.col("_hit.country")),
        "admin1_code": F.when(poly & (F.col("_hit.layer") < 2), F.col("_hit.gid_1")).otherwise(none),
        "admin1_name": F.when(poly & (F.col("_hit.layer") < 2), F.col("_hit.name_1")).otherwise(none),
        "admin2_code": F.when(poly & (F.col("_hit.layer") < 1), F.col("_hit.gid_2")).otherwise(none),
        "admin2_name": F.when(poly & (F.col("_hit.layer") < 1), F.col("_hit.name_2")).otherwise(none),
        "hit_layer": F.when(poly, F.col("_hit.layer").cast("long")),
    }).drop("_lv", "_tx", "_ty", "_cands", "_hit", "_box")


def _in_leaf(points: DataFrame, cover: DataFrame, size: float, la: Column, ln: Column) -> DataFrame:
    """Each point with the leaf it lies in: _lv, _tx, _ty and _cands, null where the cover has none."""
    def at(level: Column) -> dict[str, Column]:
        wide = F.lit(size) / F.pow(F.lit(2.0), level)
        return {"_tx": F.floor(ln / wide).cast("long"), "_ty": F.floor(la / wide).cast("long")}

    leaves = cover.select(F.col("level").alias("_lv"), F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), F.col("cands").alias("_cands"))
    if not _deepest(cover):
        return points.withColumns(at(F.lit(0))).join(leaves, ["_tx", "_ty"], "left")
    root = {c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).alias(f"_r_{c}") for c in ("tx", "ty")}
    cut = cover.select(root["tx"], root["ty"], F.col("levels").alias("_levels")).distinct()
    pts = points.withColumns({f"_r{c}": v for c, v in at(F.lit(0)).items()}).join(cut, ["_r_tx", "_r_ty"], "left")
    pts = pts.drop("_r_tx", "_r_ty").withColumn("_lv", F.explode_outer("_levels"))
    pts = pts.withColumns(at(F.coalesce("_lv", F.lit(0))))
    out = pts.join(leaves, ["_lv", "_tx", "_ty"], "left")
    return out.where(F.col("_levels").isNull() | F.col("_cands").isNotNull() | (F.size("_levels") == 1)).drop("_levels")


def within_any(points: DataFrame, polygons: DataFrame, size: float = 1.0, keep: str = "inside") -> DataFrame:
    """Flag points inside the union of polygons (inside any part)."""
    geo_cols = ["country_code", "country_name", "admin1_code", "admin1_name", "admin2_code", "admin2_name", "hit_layer"]
    out = reverse_geocode(points, cover_tiles(polygons, size), size, overrides=False)
    return out.withColumn(keep, F.col("hit_layer").isNotNull()).drop(*geo_cols)


def same_country(hit_country: Column, hub: Column) -> Column:
    """Hit and coarse country agree: equal, or one name holds the other; empty passes."""
    a, b = F.coalesce(F.lower(hit_country), F.lit("")), F.coalesce(hub_country(hub), F.lit(""))
    return (a == "") | (b == "") | (a == b) | a.contains(b) | b.contains(a)


# --- proximity --------------------------------------------------------------------------------

def _unit(lat: str, lng: str) -> dict[str, Column]:
    """Unit vector columns; squared chords between them order like distances and cost no trigonometry."""
    phi, lam = F.radians(lat), F.radians(lng)
    return {"ux": F.cos(phi) * F.cos(lam), "uy": F.cos(phi) * F.sin(lam), "uz": F.sin(phi)}


def _chord2(c: Column) -> Column:
    dx, dy, dz = F.col("ux") - c["ux"], F.col("uy") - c["uy"], F.col("uz") - c["uz"]
    return dx * dx + dy * dy + dz * dz


def covered(points: DataFrame, coverage: DataFrame, radius_m: float = 50, zoom: int = 17,
            point_id: str = "sample_key", cover_id: str = "point_id", neighbours: bool = False) -> DataFrame:
    """Points with a coverage point within the radius in the same tile (or the 8 around it).

    Coverage points travel packed, up to 256 per row, so the semi-join tests arrays and no pair
    row exists. The packs of a dense tile are join keys of their own: only points of such a tile are
    copied, once per pack, and its packs spread over tasks. Most points of a dense tile need no pack: they
    lie within the radius of the one coverage point that stands for their small tile, no wider than the radius.
    """
    fine = max(zoom, math.ceil(math.log2(2 * math.pi * geo.EARTH_M * math.sqrt(2) / radius_m))) if radius_m > 0 else zoom
    fine = min(fine, 30)
    coverage = coverage.withColumn("_t", geo.latlng_to_tile("lat", "lng", zoom))
    near = (coverage.withColumn("_f", geo.latlng_to_tile("lat", "lng", fine)).where("lat is not null and lng is not null")
            .groupBy(F.col("_t").alias("_nt"), F.col("_f").alias("_nf")).agg(F.min(F.struct("lat", "lng")).alias("_near")))
    packs = packed(coverage.withColumns(_unit("lat", "lng"))
                   .select(F.col("_t.x").alias("tx"), F.col("_t.y").alias("ty"), cover_id, "lat", "lng", "ux", "uy", "uz"),
                   ["tx", "ty"], [cover_id], ["lat", "lng", "ux", "uy", "uz"], 256)
    # a cheap necessary bound first, then the exact test
    bound = (2 * math.sin(min(radius_m / geo.EARTH_M, math.pi) / 2)) ** 2 * (1 + 1e-6) + 1e-15
    p = (points.withColumn("_t", geo.latlng_to_tile("lat", "lng", zoom)).withColumn("_f", geo.latlng_to_tile("lat", "lng", fine))
         .join(near, F.expr("_t.x = _nt.x and _t.y = _nt.y and _f.x = _nf.x and _f.y = _nf.y"), "left"))
    stands = F.coalesce(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("_near.lat"), F.col("_near.lng")) <= radius_m, F.lit(False))
    sure = p.where(stands).select(*points.columns)
    p = p.where(~stands).select(*points.columns, "_t").withColumns(_unit("lat", "lng"))
    packs = packs.select(F.col("tx").alias("_px"), F.col("ty").alias("_py"), F.col("chunk").alias("_pc"), "items")
    dense = packs.groupBy(F.col("_px").alias("_dx"), F.col("_py").alias("_dy")).agg((F.max("_pc") + 1).alias("_slots")).where("_slots > 1")

    def slotted(p: DataFrame, x: Column, y: Column) -> DataFrame:
        wide = p.withColumns({"_x": x, "_y": y}).join(dense, F.expr("_x = _dx and _y = _dy"), "left")
        return wide.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_slots", F.lit(1)) - 1)))

    here = (F.col("_x") == F.col("_px")) & (F.col("_y") == F.col("_py")) & (F.col("_slot") == F.col("_pc"))
    hit = F.exists("items", lambda c: (_chord2(c) <= bound) & (
        geo.haversine_m(F.col("lat"), F.col("lng"), c["lat"], c["lng"]) <= radius_m))
    if not neighbours:
        found = slotted(p, F.col("_t.x"), F.col("_t.y")).join(packs, here & hit, "left_semi")
        once = found.where("_slots is null").select(*points.columns)
        return sure.unionByName(once).unionByName(found.where("_slots is not null").select(*points.columns).dropDuplicates([point_id]))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    p = p.select(point_id, "lat", "lng", "ux", "uy", "uz", "_t", around.alias("_d"))
    p = slotted(p, F.col("_t.x") + F.col("_d.x"), F.col("_t.y") + F.col("_d.y"))
    found = p.join(packs, here & hit, "left_semi").select(point_id).unionByName(sure.select(point_id))
    return points.join(found.distinct(), point_id, "left_semi")


def _bands(lat: Column, step: float) -> Column:
    return F.floor((lat + 90.0) / F.lit(step)).cast("long")


def _columns_of(band: Column, step: float) -> Column:
    """Number of lng columns in a band: about ``step`` wide at the band's widest latitude."""
    low = band * step - 90.0
    widest = F.when((low <= 0) & (low + step >= 0), F.lit(0.0)).otherwise(F.least(F.abs(low), F.abs(low + step)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(F.least(widest, F.lit(90.0)))) / F.lit(step))).cast("long")


def _column(lng: Column, n: Column) -> Column:
    return F.pmod(F.floor((lng + 180.0) / (F.lit(360.0) / n)), n).cast("long")


def _radius_tiles(df: DataFrame, lat: str, lng: str, radius_km: float) -> DataFrame:
    """Rows exploded to every (band, col) tile the radius may reach, poles and date line included."""
    step = radius_km / KM_PER_DEGREE * 1.000001
    df = df.withColumn("band", F.explode(F.sequence(
        F.greatest(_bands(F.col(lat) - step, step), F.lit(0).cast("long")), _bands(F.least(F.col(lat) + step, F.lit(90.0)), step))))
    df = df.withColumn("_n", _columns_of(F.col("band"), step))
    # half width of the radius circle in lng: asin(sin r / cos lat); the whole circle at the poles
    cos_lat, sin_r = F.cos(F.radians(lat)), F.sin(F.radians(F.lit(step)))
    half = F.when(cos_lat > sin_r, F.degrees(F.asin(F.least(sin_r / cos_lat, F.lit(1.0))))).otherwise(F.lit(180.0))
    width = F.lit(360.0) / F.col("_n")
    first = F.floor((F.col(lng) - half + 180.0) / width)
    last = F.least(F.floor((F.col(lng) + half + 180.0) / width), first + F.col("_n") - 1)
    return (df.withColumn("col", F.explode(F.sequence(first, last)))
            .withColumn("col", F.pmod("col", "_n").cast("long")).drop("_n"))


def _home_tile(df: DataFrame, lat: str, lng: str, radius_km: float) -> DataFrame:
    step = radius_km / KM_PER_DEGREE * 1.000001
    return (df.withColumn("band", _bands(F.col(lat), step))
            .withColumn("col", _column(F.col(lng), _columns_of(F.col("band"), step))))


def nearest(points: DataFrame, targets: DataFrame, radius_km: float, point_id: str, target_id: str,
            spread: str = "targets", crowd: int = 512) -> DataFrame:
    """Nearest target within the radius per point: (point_id, target_id, distance_km).

    Rows at one place count once: places of points look for places of targets, which stand for their smallest
    id. The side named by ``spread`` (the smaller one) is repeated in every tile its radius reaches, the
    other has its home tile and crosses the network once. Targets travel packed per tile; each place
    keeps one best per pack and one overall, so neither side's dense tiles emit pairs. Where a target's tile
    holds more than ``crowd`` places on average, smaller radii come first: a place with a target within one
    needs no wider tiles. Equal distances go to the smaller target id.
    """
    if spread not in ("targets", "points"):
        raise ValueError(f"spread is targets or points, not {spread}")
    rows = points.select(point_id, F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).distinct()
    sites = targets.groupBy("lat", "lng").agg(F.min(target_id).alias(target_id))
    left = rows.select("_lat", "_lng").distinct()
    shared_dir(points.sparkSession)
    tiles = _home_tile(sites, "lat", "lng", radius_km).groupBy("band", "col").agg(F.count(F.lit(1)).alias("n"))
    mean = tiles.agg(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    reach, found = radius_km, None
    if mean > crowd:
        reach = radius_km * math.sqrt(64 / mean)
        sites, left = sites.checkpoint(), left.checkpoint()
    while True:
        near = _nearest_place(left, sites, reach, target_id, spread)
        if reach < radius_km:
            near = near.checkpoint()
            left = left.join(near, ["_lat", "_lng"], "left_anti").checkpoint()
        found = near if found is None else found.unionByName(near)
        if reach >= radius_km:
            return rows.join(found, ["_lat", "_lng"]).select(point_id, target_id, "distance_km")
        reach = min(4 * reach, radius_km)


def _nearest_place(places: DataFrame, sites: DataFrame, radius_km: float, target_id: str, spread: str) -> DataFrame:
    """(_lat, _lng, target_id, distance_km) of the places that have a site within the radius."""
    tiled = {True: _radius_tiles, False: _home_tile}
    packs = packed(tiled[spread == "targets"](sites.withColumns(_unit("lat", "lng")), "lat", "lng", radius_km),
                   ["band", "col"], [target_id], ["lat", "lng", target_id, "ux", "uy", "uz"], 256)
    near = tiled[spread == "points"](places.withColumns(_unit("_lat", "_lng")), "_lat", "_lng", radius_km).join(packs, ["band", "col"])
    best = F.array_min(F.transform("items", lambda c: F.struct(
        _chord2(c).alias("chord2"), c[target_id].alias(target_id), c["lat"].alias("lat"), c["lng"].alias("lng"))))
    found = near.select("_lat", "_lng", best.alias("_b")).groupBy("_lat", "_lng").agg(F.min("_b").alias("_b"))
    return (found.select("_lat", "_lng", F.col(f"_b.{target_id}").alias(target_id),
                         geo.haversine_km("_lat", "_lng", "_b.lat", "_b.lng").alias("distance_km"))
            .where(F.col("distance_km") <= radius_km))


def pairs_within(points: DataFrame, centres: DataFrame, radius_km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Point × centre rows at most ``radius_km`` apart (the radius bounds the output)."""
    c = _home_tile(centres, "centroid_lat", "centroid_lng", radius_km)
    p = _radius_tiles(points, lat, lng, radius_km)
    d = geo.haversine_km(lat, lng, "centroid_lat", "centroid_lng")
    return (p.join(c, ["band", "col"]).withColumn("distance_km", d)
            .where(F.col("distance_km") <= radius_km).drop("band", "col"))


# --- rasters ----------------------------------------------------------------------------------

def raster_blocks(pixels: DataFrame, size: int = 256) -> DataFrame:
    """Pixel table (row_idx, col_idx, value) → one row per occupied block: (brow, bcol, values), ``values`` in row
    order with null for missing pixels.

    A block is one row of ``size`` x ``size`` values, so a world of 10^9 pixels is some 15,000 rows that join
    on their block's key. A pixel given twice has its largest value; its group never exceeds a block.
    """
    kind = pixels.schema["value"].dataType
    one = pixels.where("value is not null").groupBy("row_idx", "col_idx").agg(F.max("value").alias("value"))
    at = (F.col("row_idx") % size * size + F.col("col_idx") % size).cast("int")
    rows = one.select(F.floor(F.col("row_idx") / size).alias("brow"), F.floor(F.col("col_idx") / size).alias("bcol"), at.alias("at"), "value")
    schema = T.StructType([T.StructField("brow", T.LongType()), T.StructField("bcol", T.LongType()), T.StructField("values", T.ArrayType(kind))])
    arrow = to_arrow_type(kind)

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        where = np.full(size * size, -1, np.int64)
        where[table["at"].to_numpy()] = np.arange(table.num_rows)
        values = table["value"].combine_chunks().take(pa.array(where, mask=where < 0))
        return pa.table({"brow": pa.array([key[0].as_py()], pa.int64()), "bcol": pa.array([key[1].as_py()], pa.int64()),
                         "values": pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), values.cast(arrow))})

    return rows.groupBy("brow", "bcol").applyInArrow(fill, schema).select(
        "brow", "bcol", F.col("values").alias("values", metadata={"size": size}))


def map_blocks(blocks: DataFrame, fn) -> DataFrame:
    """Blocks with ``fn`` (a Column function) applied to every value."""
    return blocks.select("brow", "bcol", F.transform("values", fn).alias("values", metadata=blocks.schema["values"].metadata))


def raster_sample(points: DataFrame, raster: DataFrame, affine: tuple, name: str, x: Column | None = None,
                  y: Column | None = None, nodata: float | None = None) -> DataFrame:
    """Add the pixel value under each point; null outside, on nodata and off the map. ``raster`` has blocks
    (``raster_blocks``: points join their block and take one element of it) or single pixels."""
    x = F.col("lng") if x is None else x
    y = F.col("lat") if y is None else y
    pts = points.withColumn("_px", geo.pixel_index(x, y, *affine))
    if "values" in raster.columns:
        size = raster.schema["values"].metadata.get("size")
        if not size:
            raise ValueError("blocks carry their size in the metadata of values, as raster_blocks makes them")
        row, col = F.col("_px.row_idx"), F.col("_px.col_idx")
        pts = pts.withColumns({"_brow": F.floor(row / size), "_bcol": F.floor(col / size)})
        blocks = raster.select(F.col("brow").alias("_brow"), F.col("bcol").alias("_bcol"), F.col("values").alias("_values"))
        value = F.get("_values", (row % size * size + col % size).cast("int"))
        out = pts.join(blocks, ["_brow", "_bcol"], "left")
        return out.select(*points.columns, (value if nodata is None else F.when(value != nodata, value)).alias(name))
    pts = pts.withColumns({"row_idx": F.col("_px.row_idx"), "col_idx": F.col("_px.col_idx")}).drop("_px")
    pix = raster.select("row_idx", "col_idx", F.col("value").alias(name))
    if nodata is not None:
        pix = pix.where(F.col(name) != nodata)
    return pts.join(pix, ["row_idx", "col_idx"], "left").drop("row_idx", "col_idx")


def climate(points: DataFrame, raster: DataFrame, affine: tuple, **kw) -> DataFrame:
    """Climate class and group; class 0 is water and becomes null."""
    out = raster_sample(points, raster, affine, "koppen_class", **kw)
    out = out.withColumn("koppen_class", F.nullif("koppen_class", F.lit(0).cast("long")))
    return out.withColumn("koppen_group", X.koppen_group("koppen_class"))


def population(points: DataFrame, raster: DataFrame, affine: tuple, nodata: float | None = None, **kw) -> DataFrame:
    """Density under the point (never negative) and the urban flag."""
    xy = geo.mollweide_xy("lat", "lng")
    out = points.withColumn("_xy", xy)
    out = raster_sample(out, raster, affine, "pop_per_km2", F.col("_xy.x"), F.col("_xy.y"), nodata, **kw).drop("_xy")
    density = F.col("pop_per_km2").cast("double")
    out = out.withColumn("pop_per_km2", F.when(density < 0, 0.0).otherwise(density))  # null stays null
    return out.withColumn("is_urban", X.is_urban("pop_per_km2"))


def enrich(points: DataFrame, cover: DataFrame, climate_raster: DataFrame, climate_affine: tuple, density_raster: DataFrame,
           density_affine: tuple, id_col: str = "pano_id", nodata: float | None = None) -> DataFrame:
    """Catalogue enrichment in one plan: admin columns by polygon, cells of all levels, climate class and
    group, population density and urban flag, official flag. Each step is an equi-join on a tile or a
    pixel; point rows are never multiplied."""
    out = with_cells(reverse_geocode(points, cover))
    out = climate(out, climate_raster, climate_affine)
    out = population(out, density_raster, density_affine, nodata)
    return out.withColumn("is_official", X.is_official(id_col))


# --- sampling in a polygon --------------------------------------------------------------------

def sample_points(spark, polygons: DataFrame, n: int, seed: int = 42, oversample: int = 4, size: float = 1.0,
                  least_share: float = 1e-6) -> DataFrame:
    """``n`` area-uniform points inside the polygons: a cover tile by its area, then latitude by its sine;
    draws outside are rejected.

    Draws are keyed hashes of their number, so a retried task gives the same points. Rounds with as
    many draws as the share of hits asks for follow until ``n`` fell inside; polygons that take less
    than ``least_share`` of their tiles are an error, never a short result.
    """
    cover = cover_tiles(polygons, size)
    half = 1 << 20
    root = [F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).alias(c) for c in ("tx", "ty")]
    tiles = cover.select(*root).distinct().select(((F.col("tx") + half) * (2 * half) + F.col("ty") + half).alias("tile"),
                         (F.sin(F.radians((F.col("ty") + 1) * F.lit(size))) - F.sin(F.radians(F.col("ty") * F.lit(size)))).alias("area"))
    tiles = tiles.checkpoint() if shared_dir(spark) else tiles

    def uniform(tag: str) -> Column:
        return X.hash_uniform(F.col("draw").cast("string"), F.lit(f"{tag}{seed}"))

    draws = max(n * oversample, 1000)
    while True:
        tx = F.floor(F.col("tile") / (2 * half)) - half
        ty = F.col("tile") % (2 * half) - half
        low, high = F.sin(F.radians(ty * F.lit(size))), F.sin(F.radians((ty + 1) * F.lit(size)))
        spots = weighted_resample(tiles, "tile", "area", draws, seed).select(
            "draw", F.degrees(F.asin(low + uniform("lat") * (high - low))).alias("lat"), ((tx + uniform("lng")) * F.lit(size)).alias("lng"))
        inside = (reverse_geocode(spots, cover, overrides=False).where(F.col("hit_layer").isNotNull())
                  .select("draw", "lat", "lng").checkpoint())
        hits = inside.count()
        if hits >= n:
            return first_n(inside, ["draw"], n)
        if hits < least_share * draws or draws * least_share > n + 1:
            raise ValueError(f"only {hits} of {draws} draws fell inside; use smaller tiles than {size} degrees")
        draws = int(draws * max(2.0, 1.3 * n / hits if hits else 16.0))
