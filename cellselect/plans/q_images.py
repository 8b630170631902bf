"""Image jobs on pictures made from the stored vectors: 64 values as a 4 × 16 grey image."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cellselect.functions import text as T
from cellselect.operators import images as I
from cellselect.plans.registry import query
from cellselect.session import scratch_path
from cellselect.sources import files as S_
from cellselect.sources.named_files import bmp, write_named


def pictures(t, floor: float = -9.0):
    """Values at or below ``floor`` become black."""
    level = F.transform("embedding", lambda x: F.when(x > floor, F.floor((x + 1) * 127.5)).otherwise(0))
    pixel = F.transform(level, lambda v: F.repeat(F.lpad(F.hex(v), 2, "0"), F.lit(3)))
    return t.vectors.select("vec_id", F.lit(4).alias("height"), F.lit(16).alias("width"), F.lit(3).alias("nChannels"),
                            F.unhex(F.array_join(pixel, "")).alias("data"))


def stored(t):
    """The pictures written as one image file each and read back through the image source."""
    path = scratch_path(t.spark, "pictures")
    files = pictures(t).select(F.concat(F.lit("p"), F.pmod("vec_id", F.lit(16)).cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".bmp")).alias("name"),
                               bmp(F.col("data"), 16, 4).alias("content"))
    write_named(files, path)
    images = S_.read_images(t.spark, f"{path}/*")
    return images.withColumn("vec_id", F.regexp_extract("origin", r"([^/]+)\.bmp$", 1).cast("long"))


def _light(data: str):
    """Sum of a picture's 192 bytes."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(192)), F.lit(0).cast("long"),
                       lambda s, i: s + F.conv(F.hex(F.substring(F.col(data), i, F.lit(1))), 16, 10).cast("long"))


@query("s22_read_images", """
SELECT vec_id, 4.0::double AS aspect, 'single' AS mode, cast(192 AS bigint) AS bytes,
       cast(3 * list_sum(list_transform(e, lambda x: floor((x + 1) * 127.5))) AS bigint) AS light FROM vectors""", "vectors")
def s22(t):
    p = stored(t)
    return p.select("vec_id", "aspect", T.image_mode("width", "height", F.lit("auto")).alias("mode"), F.octet_length("data").cast("long").alias("bytes"),
                    _light("data").alias("light"))


_RENDERED = """
WITH v AS (SELECT h.heading, i, j, (j / 7.0 * 2 - 1) * tan(radians(45)) AS x, -(i / 7.0 * 2 - 1) * tan(radians(45)) AS y
           FROM range(8) AS a(i), range(8) AS b(j), (VALUES (0), (90), (180), (270)) AS h(heading)),
p AS (SELECT heading, i, j, (0.5 - atan2(y, sqrt(x * x + 1)) / pi()) * 4 - 0.5 AS r, ((atan2(x, 1.0) + radians(heading)) / (2 * pi()) + 0.5) * 16 - 0.5 AS c FROM v),
q AS (SELECT *, cast(floor(r) AS int) AS r0, cast(floor(c) AS int) AS c0, r - floor(r) AS fr, c - floor(c) AS fc FROM p),
w AS (SELECT heading, i, j, least(greatest(r0, 0), 3) AS ra, least(greatest(r0 + 1, 0), 3) AS rb, ((c0 % 16) + 16) % 16 AS ca, (((c0 + 1) % 16) + 16) % 16 AS cb, fr, fc FROM q),
lit AS (SELECT vec_id, list_transform(e, lambda x: floor((x + 1) * 127.5)) AS l FROM vectors)
SELECT vec_id, heading, 192::bigint AS bytes, cast(3 * sum(round_even((l[ra * 16 + ca + 1] * (1 - fc) + l[ra * 16 + cb + 1] * fc) * (1 - fr)
       + (l[rb * 16 + ca + 1] * (1 - fc) + l[rb * 16 + cb + 1] * fc) * fr, 0)) AS bigint) AS light FROM lit, w GROUP BY vec_id, heading"""


@query("i1_render_views", _RENDERED, "vectors")
def i1(t):
    """Views of the stored image files and the sum of their pixels."""
    v = I.render_views(stored(t), "vec_id", size=8)
    return v.select("vec_id", "heading", F.octet_length("data").cast("long").alias("bytes"), _light("data").alias("light"))


@query("i2_trim_black", """
WITH lit AS (SELECT vec_id, (i - 1) // 16 AS r, (i - 1) % 16 AS c FROM vectors, range(1, 65) AS x(i) WHERE e[i] > 0.2)
SELECT v.vec_id, coalesce(max(r) - min(r) + 1, 4) AS height, coalesce(max(c) - min(c) + 1, 16) AS width FROM vectors v LEFT JOIN lit USING (vec_id) GROUP BY v.vec_id""", "vectors")
def i2(t):
    out = I.trim_black(pictures(t, 0.2), "vec_id")
    return out.select("vec_id", F.col("height").cast("long").alias("height"), F.col("width").cast("long").alias("width"))


@query("p1_encode", """
SELECT vec_id, round(list_avg(list_transform(e, lambda x: floor((x + 1) * 127.5))) / 255, 4) AS brightness FROM vectors""", "vectors")
def p1(t):
    """A user function: mean brightness per channel."""
    v = I.encode(pictures(t), lambda imgs: np.stack([i.mean(axis=(0, 1)) / 255 for i in imgs]), "vec_id")
    return v.select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("brightness"))
