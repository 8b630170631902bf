"""Location groups over chains, merged batches of distances, approximate search: against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellselect.operators import approximate as A
from cellselect.operators import catalog as C
from cellselect.operators import evaluate as E
from cellselect.operators import retrieval as V
from cellselect.operators.groups import components


def plain_components(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(top)}


@pytest.mark.parametrize("name", ["chain", "star", "random", "odd"])
def test_components(spark, name):
    rng = random.Random(1)
    edges = {"chain": [(i, i + 1) for i in rng.sample(range(600), 600)], "star": [(0, i) for i in range(1, 900)] + [(i, 10_000 + i) for i in range(1, 900, 3)],
             "random": [(rng.randrange(800), rng.randrange(800)) for _ in range(500)],
             "odd": [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4), (-7, 4)]}[name]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == plain_components(edges)


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_a_chain_of_siblings_is_one_location(spark):
    samples = spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "k long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "anchor long, sibling long")
    got = {r.k: r.location for r in C.location_groups(samples, edges, "k", "anchor", "sibling").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 9}


def test_merged_batches_equal_the_union(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), i % 37, rng.choice([0.0, 0.1, 5.0, 5.0, rng.expovariate(0.002), 20_015.0])) for i in range(4000)]
    df = spark.createDataFrame(rows, "metric string, batch int, distance_km double")
    batches = df.groupBy("metric", "batch").agg(F.count_if(F.col("distance_km") < 25).alias("correct"), F.count(F.lit(1)).alias("n"),
                                                F.collect_list("distance_km").alias("distances"))
    merged = {r.metric: r.asDict() for r in E.merge_batches(batches).collect()}
    for r in E.distance_summary(df, ["metric"]).collect():
        m = merged[r.metric]
        assert m["n_distances"] == r.n and all(abs(m[c] - r[c]) < 1e-9 * max(1, abs(r[c])) for c in r.asDict() if c not in ("metric", "n"))
        assert m["correct"] == sum(g == r.metric and d < 25 for g, _, d in rows)


def test_states_of_batches_add_up(spark):
    """Kept states of two batches, merged without their lists, are the state of both."""
    df = spark.range(3000).select((F.col("id") % 2).alias("batch"), (F.col("id") * 7.5 % 900).alias("distance_km"))
    parts = E.distance_states(df, ["batch"])
    key = lambda r: (r["bin"], r["n"], round(r["total"], 6), r["within_25km"])
    assert sorted(map(key, E.merge_states(parts, []).collect())) == sorted(map(key, E.distance_states(df, []).collect()))
    one = E.summary_of_states(parts.drop("batch"), df).first()
    assert abs(one["median_km"] - np.median(np.arange(3000) * 7.5 % 900)) < 1e-9


def test_merge_without_rows(spark):
    none = spark.createDataFrame([], "metric string, correct long, n long, distances array<double>")
    assert E.merge_batches(none).collect() == []


def vectors(spark, n, clusters, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(clusters, 24))
    rows = [(i, [float(x) for x in base[i % clusters] + 0.35 * rng.normal(size=24)], 0.0, 0.0) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, lat double, lng double")


def test_approximate_search_finds_the_neighbours(spark):
    protos = vectors(spark, 3000, 40, 5)
    queries = protos.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centres = A.train_centres(protos, 40)
    probes = A.probes_for(queries, protos, 10, centres, target=0.95)
    assert 1 <= probes <= 10  # a quarter of the lists at most on clustered vectors
    approx = A.approx_knn(queries, protos, 10, probes=probes, centres=centres)
    r = A.recall(approx, V.knn(queries, protos, 10)).agg(F.avg("recall").alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] == 300 and r["r"] >= 0.9
    # similarities are exact and every query has its own vector first
    top = approx.where("rank = 1").collect()
    assert all(t.query_id == t.vec_id and abs(t.sim - 1) < 1e-6 for t in top)


def test_all_lists_probed_is_the_exact_search(spark):
    protos = vectors(spark, 400, 7, 6)
    queries = protos.limit(50).select(F.col("vec_id").alias("query_id"), "embedding")
    centres = A.train_centres(protos, 16)
    key = lambda r: (r.query_id, r["rank"], r.vec_id)
    assert sorted(map(key, A.approx_knn(queries, protos, 5, probes=16, centres=centres).collect())) == sorted(map(key, V.knn(queries, protos, 5).collect()))


def test_fewer_vectors_than_lists_and_none(spark):
    protos = vectors(spark, 3, 3, 7)
    queries = protos.select(F.col("vec_id").alias("query_id"), "embedding")
    assert A.approx_knn(queries, protos, 2, n_lists=64).count() == 6
    assert A.approx_knn(queries, protos.limit(0), 2).collect() == []


def test_blake2b_text_is_the_hash(spark):
    import duckdb

    from cellselect.plans.blake2b import blake2b_sql
    texts = ["", "a", "_unk:CAo" + "0" * 40, "x" * 80]
    rows = " UNION ALL ".join(f"SELECT {i} AS id, '{t}' AS s" for i, t in enumerate(texts))
    got = dict(duckdb.sql(f"WITH {blake2b_sql(rows)} SELECT id, h FROM blake").fetchall())
    assert got == {i: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big") for i, t in enumerate(texts)}
