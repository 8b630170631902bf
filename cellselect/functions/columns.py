"""Scalar expressions of the catalogue: ids, flags, splits, vectors."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellselect.functions import constants as K
from cellselect.functions.geo import _c


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


# --- ids and flags ----------------------------------------------------------------------------

def is_official(pano_id) -> Column:
    return F.length(_c(pano_id)) == 22


def camera_generation(height) -> Column:
    out = F.lit(0)
    for h, gen in K.CAMERA_HEIGHTS:
        out = F.when(_c(height) == h, gen).otherwise(out)
    return out.cast("long")


def shard_key(pano_id) -> Column:
    return F.substring(_c(pano_id), 1, 2)


def crop_paths(pano_id, headings=K.HEADINGS) -> Column:
    """``<shard>/<id>_<hhh>.jpg`` per heading."""
    base = F.concat(shard_key(pano_id), F.lit("/"), _c(pano_id), F.lit("_"))
    return F.transform(F.array(*[F.lit(h) for h in headings]),
                       lambda h: F.concat(base, F.lpad(h.cast("string"), 3, "0"), F.lit(".jpg")))


def koppen_group(cls) -> Column:
    out = F.lit(None).cast("string")
    for first, last, group in K.CLIMATE_GROUPS:
        out = F.when(_c(cls).between(first, last), group).otherwise(out)
    return out


def is_urban(density) -> Column:
    return F.coalesce(_c(density) >= K.URBAN_DENSITY, F.lit(False))


def norm_gid0(code) -> Column:
    return F.coalesce(F.try_element_at(literal_map(K.PLACEHOLDER_CODES), _c(code)), _c(code))


def bbox_override(lat, lng) -> Column:
    """struct(code, name) of the first box holding the point, else null."""
    out = F.lit(None)
    for code, name, lat0, lat1, lng0, lng1 in reversed(K.BBOX_OVERRIDES):
        box = F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"))
        out = F.when(_c(lat).between(lat0, lat1) & _c(lng).between(lng0, lng1), box).otherwise(out)
    return out


def passes_filter(pano_id="pano_id", uploader=None, height="height", source="source",
                  date="capture_month", official_only=True, min_generation=2, reject_other=True,
                  after=None, before=None) -> Column:
    """Admission of a sample; unknown generation, source and date pass."""
    ok = F.lit(True)
    if official_only:
        ok = ok & is_official(pano_id)
        if uploader is not None:
            ok = ok & _c(uploader).isNull()
    gen = camera_generation(height)
    ok = ok & ((gen == 0) | (gen >= min_generation))
    if reject_other:
        ok = ok & F.coalesce(_c(source) == "launch", F.lit(True))
    if after:
        ok = ok & F.coalesce(_c(date) >= after, F.lit(True))
    if before:
        ok = ok & F.coalesce(_c(date) <= before, F.lit(True))
    return ok


# --- hash split -------------------------------------------------------------------------------

def _keyed(key, salt) -> Column:
    return F.concat(F.coalesce(_c(salt), F.lit("_unk")), F.lit(":"), _c(key))


@F.pandas_udf(T.DoubleType())
def blake2b_uniform(keys: pd.Series) -> pd.Series:
    """First 64 bits of blake2b, big-endian, as a fraction of 2**64."""
    return keys.map(lambda k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") / 2 ** 64)


def hash_uniform(key, salt, algo: str = "sha2") -> Column:
    """Uniform in [0, 1) from ``salt:key``. ``sha2`` stays on the JVM; ``blake2b`` gives the
    published split's exact values through an Arrow function."""
    text = _keyed(key, salt)
    if algo == "blake2b":
        return blake2b_uniform(text)
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("double") / F.lit(float(2 ** 64))


def split_label(u, p_val: float = 0.03, p_test: float = 0.02) -> Column:
    u = _c(u)
    return F.when(u < p_test, "test").when(u < p_test + p_val, "val").otherwise("train")


# --- vectors ----------------------------------------------------------------------------------

def rotate_views(views, k) -> Column:
    """Cyclic shift of a view array by ``k`` places."""
    views = _c(views)
    n = F.size(views)
    k = F.pmod(_c(k).cast("int"), n)
    return F.concat(F.slice(views, k + 1, n), F.slice(views, F.lit(1), k))


def concat_views(views) -> Column:
    return F.flatten(_c(views))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalise(v) -> Column:
    """Unit vector (length floor 1e-12, so a zero vector stays zero)."""
    return F.element_at(F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))),
                                    lambda n: F.transform(_c(v), lambda x: x.cast("double") / n)), 1)


def cosine(a, b) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))
