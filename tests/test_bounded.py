"""What operators read again and what their workers hold at once."""

import pandas as pd
from pyspark.sql import functions as F

from cellselect.functions import geo
from cellselect.operators import evaluate as E
from cellselect.operators import spatial as S
from cellselect.operators import text as G


def test_merged_batches_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(40).select(F.concat(F.lit("m"), F.col("id") % 3).alias("metric"), F.lit(1).cast("long").alias("correct"), F.lit(2).cast("long").alias("n"),
                                  F.array(F.col("id").cast("double"), (F.col("id") * 7 % 11).cast("double")).alias("distances"))
    out = E.merge_batches(rows.mapInArrow(counted, rows.schema)).collect()
    assert seen.value == 40
    assert {r.metric: (r.correct, r.n, r.n_distances) for r in out} == {"m0": (14, 28, 28), "m1": (13, 26, 26), "m2": (13, 26, 26)}


def test_annotated_texts_come_in_runs_of_bounded_size(spark):
    most = 1 << 20

    def langid(text):
        size = text.fillna("").str.len()
        assert len(text) == 1 or size.sum() <= most, size.sum()
        return pd.DataFrame({"iso": ["en"] * len(text), "confidence": size.astype(float).to_numpy()})

    def translate(text, iso):
        return text.str.upper()

    df = spark.range(3000).coalesce(1).select("id", F.when(F.col("id") % 100 != 5, F.repeat(F.lit("a"), F.when(F.col("id") == 9, 3_000_000).otherwise(2000 + F.col("id") % 7).cast("int"))).alias("text"))
    out = G.annotate(df, "text", langid, translate).select("id", "iso", "confidence", F.length("translation").alias("n"), F.length("text").alias("m"), F.left("translation", F.lit(1)).alias("c"))
    rows = out.orderBy("id").collect()
    assert [r.id for r in rows] == list(range(3000)) and all(r.iso == "en" for r in rows)
    assert all((r.n, r.m, r.c) == ((None, None, None) if r.id % 100 == 5 else (int(r.confidence), r.n, "A")) for r in rows)
    assert rows[9].m == 3_000_000


def test_covered_in_a_dense_tile_is_as_brute_force(spark):
    """Thousands of coverage points in one tile and its small tiles; points within, at the rim and outside."""
    cover = spark.range(3000).select(F.col("id").alias("point_id"), (F.lit(10.0) + F.col("id") * 7919 % 3000 / 100000).alias("lat"), (F.lit(20.0) + F.col("id") * 104729 % 2000 / 100000).alias("lng"))
    points = spark.range(400).select(F.col("id").alias("sample_key"), (F.lit(9.99) + F.col("id") * 31 % 400 / 8000).alias("lat"), (F.lit(19.99) + F.col("id") * 17 % 400 / 8000).alias("lng"))
    p = points.withColumn("t", geo.latlng_to_tile("lat", "lng", 12)).alias("p")
    c = cover.withColumn("t", geo.latlng_to_tile("lat", "lng", 12)).alias("c")
    for radius in (60.0, 2500.0):
        close = geo.haversine_m(F.col("p.lat"), F.col("p.lng"), F.col("c.lat"), F.col("c.lng")) <= radius
        want = sorted(r[0] for r in p.join(c, (F.col("p.t") == F.col("c.t")) & close, "left_semi").select("sample_key").collect())
        assert sorted(r.sample_key for r in S.covered(points, cover, radius, 12).collect()) == want and 0 < len(want) < 400
