"""Pure Column expressions on coordinates: distances, tiles, hierarchical cells, projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
EARTH_M = 6371000.0
MOLLWEIDE_R = 6378137.0
LEVELS = (3, 6, 9, 12)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _hav(lat1, lng1, lat2, lng2) -> Column:
    lat1, lng1, lat2, lng2 = map(_c, (lat1, lng1, lat2, lng2))
    dp, dl = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    return (F.pow(F.sin(dp / 2), 2)
            + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in km, clamped at the antipode."""
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(_hav(lat1, lng1, lat2, lng2))))


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle distance in metres, no clamp."""
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(_hav(lat1, lng1, lat2, lng2)))


def latlng_to_tile(lat, lng, zoom: int = 17) -> Column:
    """Slippy-map tile as struct(z, x, y); the fraction is cut, not rounded."""
    n = float(2 ** zoom)
    x = ((_c(lng) + 180.0) / 360.0 * n).cast("long")
    y = ((1.0 - F.asinh(F.tan(F.radians(_c(lat)))) / F.lit(3.141592653589793)) / 2.0 * n).cast("long")
    return F.struct(F.lit(zoom).cast("long").alias("z"), x.alias("x"), y.alias("y"))


def tile_key(tile: Column) -> Column:
    """A tile struct as one text key (a cell function that SQL can also state)."""
    return F.concat_ws("/", tile["z"].cast("string"), tile["x"].cast("string"), tile["y"].cast("string"))


# --- hierarchical cells on the sphere (published S2 construction) ------------------------------
# Cube face, quadratic projection, Hilbert curve. The curve is a four-state automaton; four of
# its steps are folded into one table, built below from the rule.
_QUAD = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))  # fixed values: quadrant by (state, position)
_TURN = (1, 0, 0, 3)  # fixed values: state change by position
_BITS = 4
_MAX = 1 << 30


def _curve_tables() -> tuple[list[int], list[int]]:
    """(state, i, j of four bits) → (position of eight bits, next state) and the inverse."""
    ahead, back = [0] * (4 << 2 * _BITS), [0] * (4 << 2 * _BITS)
    for state in range(4):
        for pos in range(1 << 2 * _BITS):
            s, i, j = state, 0, 0
            for step in range(_BITS - 1, -1, -1):
                p = pos >> 2 * step & 3
                q = _QUAD[s][p]
                i, j = i << 1 | q >> 1, j << 1 | q & 1
                s ^= _TURN[p]
            ahead[state << 2 * _BITS | i << _BITS | j] = pos << 2 | s
            back[state << 2 * _BITS | pos] = (i << _BITS | j) << 2 | s
    return ahead, back


_AHEAD, _BACK = _curve_tables()


def _table(values: list[int]) -> Column:
    # one text literal, folded to an array literal by the optimizer: a thousand literal nodes
    # would slow down the analysis of every later step
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def _st_to_ij(uv: Column) -> Column:
    st = F.when(uv >= 0, 0.5 * F.sqrt(1 + 3 * uv)).otherwise(1 - 0.5 * F.sqrt(1 - 3 * uv))
    return F.least(F.greatest(F.floor(st * _MAX), F.lit(0)), F.lit(_MAX - 1)).cast("long")


def s2_leaf(lat, lng) -> Column:
    """Leaf (level 30) cell id as signed BIGINT bits."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lng))
    xyz = F.struct((F.cos(phi) * F.cos(lam)).alias("x"), (F.cos(phi) * F.sin(lam)).alias("y"),
                   F.sin(phi).alias("z"))

    def face(p: Column) -> Column:
        ax, ay, az = F.abs(p["x"]), F.abs(p["y"]), F.abs(p["z"])
        f = (F.when((ax > ay) & (ax > az), F.when(p["x"] < 0, 3).otherwise(0))
             .when((ax <= ay) & (ay > az), F.when(p["y"] < 0, 4).otherwise(1))
             .otherwise(F.when(p["z"] < 0, 5).otherwise(2)))
        return F.struct(f.alias("f"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"))

    def plane(p: Column) -> Column:
        x, y, z, f = p["x"], p["y"], p["z"], p["f"]
        u = (F.when(f == 0, y / x).when(f == 1, -x / y).when(f == 2, -x / z)
             .when(f == 3, z / x).when(f == 4, z / y).otherwise(-y / z))
        v = (F.when(f == 0, z / x).when(f == 1, z / y).when(f == 2, -y / z)
             .when(f == 3, y / x).when(f == 4, -x / y).otherwise(-x / z))
        return F.struct(f.cast("long").alias("f"), _st_to_ij(u).alias("i"), _st_to_ij(v).alias("j"))

    def walk(p: Column) -> Column:
        start = F.struct(p["f"].alias("id"), p["f"].bitwiseAND(F.lit(1)).alias("s"))

        def step(acc: Column, k: Column) -> Column:
            bits = k * _BITS
            half = F.lit((1 << _BITS) - 1)
            i = F.call_function("shiftright", p["i"], bits).bitwiseAND(half)
            j = F.call_function("shiftright", p["j"], bits).bitwiseAND(half)
            at = acc["s"] * (1 << 2 * _BITS) + i * (1 << _BITS) + j
            out = F.element_at(_table(_AHEAD), (at + 1).cast("int")).cast("long")
            return F.struct(F.shiftleft(acc["id"], 2 * _BITS).bitwiseOR(F.shiftright(out, 2)).alias("id"),
                            out.bitwiseAND(F.lit(3)).alias("s"))

        done = F.aggregate(F.array(*[F.lit(k) for k in range(7, -1, -1)]), start, step)
        # 8 steps consume 32 bits of i and j (two leading zero bits each), so the face ends 4 bits
        # above its place: id holds face << 64 | pos; the face is put back at bit 61.
        pos = done["id"].bitwiseAND(F.lit((1 << 60) - 1))
        return F.shiftleft(p["f"], 61).bitwiseOR(F.shiftleft(pos, 1)).bitwiseOR(F.lit(1).cast("long"))

    return _let(_let(_let(xyz, face), plane), walk)


_QUAD_UV = ("CASE _f WHEN 0 THEN _y / _x WHEN 1 THEN -_x / _y WHEN 2 THEN -_x / _z "
            "WHEN 3 THEN _z / _x WHEN 4 THEN _z / _y ELSE -_y / _z END AS _u, "
            "CASE _f WHEN 0 THEN _z / _x WHEN 1 THEN _z / _y WHEN 2 THEN -_y / _z "
            "WHEN 3 THEN _y / _x WHEN 4 THEN -_x / _y ELSE -_x / _z END AS _v")


def with_s2_leaf(df, lat: str, lng: str, name: str):
    """Add the leaf cell as a chain of projections: the same steps as ``s2_leaf``, but every step
    is compiled code, which is what full scans should use. One SQL text keeps planning short."""

    def ij(t: str) -> str:
        st = f"CASE WHEN {t} >= 0 THEN 0.5D * sqrt(1 + 3 * {t}) ELSE 1 - 0.5D * sqrt(1 - 3 * {t}) END"
        return f"least(greatest(floor(({st}) * {_MAX}), 0), {_MAX - 1})"

    steps = [
        f"cos(radians({lat})) * cos(radians({lng})) AS _x, cos(radians({lat})) * sin(radians({lng})) AS _y, "
        f"sin(radians({lat})) AS _z",
        "CASE WHEN abs(_x) > abs(_y) AND abs(_x) > abs(_z) THEN if(_x < 0, 3L, 0L) "
        "WHEN abs(_x) <= abs(_y) AND abs(_y) > abs(_z) THEN if(_y < 0, 4L, 1L) ELSE if(_z < 0, 5L, 2L) END AS _f",
        _QUAD_UV,
        f"{ij('_u')} AS _i, {ij('_v')} AS _j, 0L AS _p8, _f & 1L AS _o8"]
    table = f"cast(split('{','.join(map(str, _AHEAD))}', ',') AS array<int>)"
    for k in range(7, -1, -1):
        at = f"cast(_o{k + 1} * 256 + (shiftright(_i, {4 * k}) & 15) * 16 + (shiftright(_j, {4 * k}) & 15) + 1 AS int)"
        steps.append(f"element_at({table}, {at}) AS _t{k}")
        steps.append(f"shiftleft(_p{k + 1}, 8) | shiftright(_t{k}, 2) AS _p{k}, cast(_t{k} & 3 AS bigint) AS _o{k}")
    text = "{df}"
    for step in steps:
        text = f"(SELECT *, {step} FROM {text})"
    keep = ", ".join(f"`{c}`" for c in df.columns)
    # The one-element generator is a stop for the optimizer: a later filter on the cell would else be
    # pushed below the chain, with every step copied into it as often as it is used.
    return df.sparkSession.sql(
        f"SELECT {keep}, `{name}` FROM (SELECT {keep}, shiftleft(_f, 61) | shiftleft(_p0, 1) | 1L AS _leaf_ FROM {text}) "
        f"LATERAL VIEW OUTER explode(array(_leaf_)) _g AS `{name}`", df=df)


def _let(value: Column, body) -> Column:
    """Bind a struct once so that it is not evaluated per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _lsb(level: int) -> int:
    return 1 << 2 * (30 - level)


def s2_parent(cell, level: int) -> Column:
    """Ancestor of a cell at ``level`` (bit operations on the signed bits)."""
    lsb = _lsb(level)
    return _c(cell).bitwiseAND(F.lit(-lsb)).bitwiseOR(F.lit(lsb))


def s2_cell(lat, lng, level: int) -> Column:
    return s2_parent(s2_leaf(lat, lng), level)


def s2_text(cell) -> Column:
    """Unsigned decimal text of a cell id (the stored form; vocabularies order by it)."""
    return F.conv(F.hex(_c(cell)), 16, 10)


def s2_from_text(text) -> Column:
    """Signed bits of an unsigned decimal text."""
    hexed = F.lpad(F.conv(_c(text), 10, 16), 16, "0")
    high, low = F.conv(F.substring(hexed, 1, 8), 16, 10), F.conv(F.substring(hexed, 9, 8), 16, 10)
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long"))


def s2_polygon(cell, level: int) -> Column:
    """Corners of a cell as array<struct(lat, lng)>, counter-clockwise from the lower left."""
    size = 1 << (30 - level)

    def unwalk(c: Column) -> Column:
        face = F.shiftrightunsigned(c, 61)
        pos = F.shiftrightunsigned(c, 1).bitwiseAND(F.lit((1 << 60) - 1))
        start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"),
                         face.bitwiseAND(F.lit(1)).alias("s"))

        def step(acc: Column, k: Column) -> Column:
            byte = F.call_function("shiftright", pos, k * 8).bitwiseAND(F.lit(255))
            out = F.element_at(_table(_BACK), (acc["s"] * 256 + byte + 1).cast("int")).cast("long")
            ij = F.shiftright(out, 2)
            return F.struct(F.shiftleft(acc["i"], 4).bitwiseOR(F.shiftright(ij, 4)).alias("i"),
                            F.shiftleft(acc["j"], 4).bitwiseOR(ij.bitwiseAND(F.lit(15))).alias("j"),
                            out.bitwiseAND(F.lit(3)).alias("s"))

        done = F.aggregate(F.array(*[F.lit(k) for k in range(7, -1, -1)]), start, step)
        low = F.lit(-size)
        return F.struct(face.alias("f"), done["i"].bitwiseAND(low).alias("i"), done["j"].bitwiseAND(low).alias("j"))

    def corners(p: Column) -> Column:
        steps = F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"))
                          for a, b in ((0, 0), (size, 0), (size, size), (0, size))])
        return F.transform(steps, lambda d: _let(_corner_uv(p, d), _uv_to_latlng))

    return _let(_let(_c(cell), unwalk), corners)


def _corner_uv(p: Column, d: Column) -> Column:
    def project(k: Column) -> Column:
        st = k / float(_MAX)
        return F.when(st >= 0.5, (4 * st * st - 1) / 3).otherwise((1 - 4 * (1 - st) * (1 - st)) / 3)
    return F.struct(p["f"].alias("f"), project(p["i"] + d["di"]).alias("u"), project(p["j"] + d["dj"]).alias("v"))


def _uv_to_latlng(q: Column) -> Column:
    f, u, v = q["f"], q["u"], q["v"]
    one = F.lit(1.0)
    x = F.when(f == 0, one).when(f == 1, -u).when(f == 2, -u).when(f == 3, -one).when(f == 4, v).otherwise(v)
    y = F.when(f == 0, u).when(f == 1, one).when(f == 2, -v).when(f == 3, -v).when(f == 4, -one).otherwise(u)
    z = F.when(f == 0, v).when(f == 1, v).when(f == 2, one).when(f == 3, -u).when(f == 4, -u).otherwise(-one)
    return F.struct(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))).alias("lat"),
                    F.degrees(F.atan2(y, x)).alias("lng"))


# --- rasters ----------------------------------------------------------------------------------

def mollweide_xy(lat, lng, radius: float = MOLLWEIDE_R, rounds: int = 8) -> Column:
    """Mollweide easting and northing as struct(x, y); the auxiliary angle by Newton rounds."""
    pi = 3.141592653589793
    phi, lam = F.radians(_c(lat)), F.radians(_c(lng))

    def solve(p: Column) -> Column:
        target = F.lit(pi) * F.sin(p["phi"])

        def step(t: Column, _k: Column) -> Column:
            slope = 2 + 2 * F.cos(2 * t)
            return F.when(slope < 1e-12, t).otherwise(t - (2 * t + F.sin(2 * t) - target) / slope)

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), p["phi"], step)

    theta = _let(F.struct(phi.alias("phi")), solve)
    root2 = 2 ** 0.5
    return F.struct((F.lit(2 * root2 / pi * radius) * lam * F.cos(theta)).alias("x"),
                    (F.lit(root2 * radius) * F.sin(theta)).alias("y"))


def pixel_index(x, y, x0: float, y0: float, dx: float, dy: float, rows: int, cols: int) -> Column:
    """(row, col) under a north-up affine; null outside."""
    col = F.floor((_c(x) - F.lit(x0)) / F.lit(dx))
    row = F.floor((F.lit(y0) - _c(y)) / F.lit(dy))
    inside = (row >= 0) & (row < rows) & (col >= 0) & (col < cols)
    return F.when(inside, F.struct(row.cast("long").alias("row_idx"), col.cast("long").alias("col_idx")))


def valid_coord(lat, lng) -> Column:
    return _c(lat).between(-90, 90) & _c(lng).between(-180, 180)
