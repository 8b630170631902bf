"""Hot keys, ranks, percentiles, samples: against brute force on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellselect.operators import catalog as O
from cellselect.operators import cells as C
from cellselect.operators import sampling as P
from cellselect.operators.scale import exact_percentiles, global_rank, packed, prefix_rank, with_chunks


def test_chunks_bound_a_hot_key(spark):
    df = spark.range(6000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    sizes = with_chunks(df, ["k"], ["id"], 100).groupBy("k", "chunk").count()
    assert sizes.agg(F.max("count")).first()[0] < 200
    packs = packed(df, ["k"], ["id"], ["id"], 100)
    assert packs.select(F.sum(F.size("items"))).first()[0] == 6000


@pytest.mark.parametrize("parts", [1, 7])
def test_global_rank(spark, parts):
    rng = np.random.default_rng(1)
    ids = rng.permutation(5000)
    df = spark.createDataFrame([(int(i), f"k{i % 3}") for i in ids], "id long, g string").repartition(parts)
    got = {r.id: r["rank"] for r in global_rank(df, "g", "id").collect()}
    want = {i: n for n, i in enumerate(sorted(range(5000), key=lambda i: (f"k{i % 3}", i)))}
    assert got == want


def test_prefix_rank_orders_as_text(spark):
    texts = ["9", "10", "100", "1", "99999999", "123456789", "123456780", "1234567", "2"]
    got = {r.t: r.idx for r in prefix_rank(spark.createDataFrame([(t,) for t in texts], "t string"), [], "t", 3).collect()}
    assert got == {t: i for i, t in enumerate(sorted(texts))}


def test_exact_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.gamma(1.2, 300, 999), "b": np.full(400, 7.25), "c": np.array([1.0]), "d": np.concatenate([np.zeros(700), rng.uniform(0, 1e-3, 301)])}
    rows = [(g, float(v)) for g, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    for r in exact_percentiles(df, "v", probs, ["g"]).collect():
        for name, p in probs.items():
            assert abs(r[name] - np.percentile(data[r.g], 100 * p)) < 1e-9
    every = np.concatenate(list(data.values()))
    r = exact_percentiles(df, "v", probs).first()
    assert all(abs(r[n] - np.percentile(every, 100 * p)) < 1e-9 for n, p in probs.items())
    assert exact_percentiles(df.where("v < 0"), "v", probs).count() == 0


def test_stride_shards_are_disjoint_and_complete(spark):
    df = spark.range(1000).select(F.col("id").alias("k"))
    parts = [{r.k for r in P.stride_shard(df, "k", 3, i).collect()} for i in range(3)]
    assert parts == [set(range(i, 1000, 3)) for i in range(3)]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).cast("string").alias("g"))
    assert {r.id for r in P.sample_n(df, "id", 50).collect()} == {r.id for r in P.sample_n(df.repartition(9), "id", 50).collect()}
    s = P.stratified(df, "g", 40, "id").groupBy("g").count().collect()
    assert [r["count"] for r in s] == [40] * 3


def test_resample_with_a_heavy_row(spark):
    """One row holds a third of the weight; draws are the same under any partitioning."""
    df = spark.range(3000).select("id", F.when(F.col("id") == 17, 1500.0).when(F.col("id") < 10, 0.0).otherwise(1.0).alias("w"))
    one = P.weighted_resample(df, "id", "w", 9000, buckets=64)
    got = {r.draw: r.id for r in one.collect()}
    assert got == {r.draw: r.id for r in P.weighted_resample(df.repartition(5), "id", "w", 9000, buckets=64).collect()}
    assert sorted(got) == list(range(9000))
    heavy = sum(v == 17 for v in got.values()) / 9000
    assert abs(heavy - 1500 / 4489) < 0.03
    assert not any(v < 10 for v in got.values())


def test_cell_stats_keep_null_cells_out_and_antimeridian(spark):
    df = spark.createDataFrame([(0.0, 179.9, 5, 5, 5, 5), (0.0, -179.9, 5, 5, 5, 5), (1.0, 1.0, None, 6, 6, 6)],
                               "lat double, lng double, s2_l3 long, s2_l6 long, s2_l9 long, s2_l12 long")
    plain = {(r.level, r.cell): r.centroid_lng for r in C.cell_stats(df).collect()}
    assert (3, None) not in plain and abs(plain[(3, 5)]) < 1e-9  # plain mean, as stored centroids are
    round_ = {(r.level, r.cell): r.centroid_lng for r in C.cell_stats(df, spherical=True).collect()}
    assert abs(abs(round_[(3, 5)]) - 180) < 1e-6


def test_parent_map_argument(spark):
    with pytest.raises(ValueError):
        C.parent_map(spark.createDataFrame([], "level int, cell long, idx long"), 6, 6)


def test_insert_ignore_and_upsert(spark):
    new = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 2)], "k string, v int, o int")
    old = spark.createDataFrame([("b", 9)], "k string, v int")
    assert [(r.k, r.v) for r in O.insert_ignore(new, old, "k", ["o"]).collect()] == [("a", 1)]
    got = {(r.k, r.v) for r in O.upsert(old, new, ["k"], "o").collect()}
    assert got == {("a", 2), ("b", 3)}


def test_remap_keeps_fresh_on_other_length(spark):
    new = spark.createDataFrame([(9, 1, 0), (9, 2, 1), (9, 3, 2)], "level int, cell long, idx long")
    old = spark.createDataFrame([(9, 1, [1.0, 2.0]), (9, 2, [1.0])], "level int, cell long, vec array<double>")
    out = C.remap_vocab(new, old, F.array(F.lit(0.0), F.lit(0.0)))
    assert {r.cell: (list(r.vec), r.copied) for r in out.collect()} == {1: ([1.0, 2.0], True), 2: ([0.0, 0.0], False), 3: ([0.0, 0.0], False)}
    rep = C.remap_report(out).first()
    assert (rep.copied, rep.fresh) == (1, 2)
