import numpy as np
import pytest
from pyspark.sql import functions as F

from cellselect.operators import decide as D
from cellselect.operators import retrieval as V
from cellselect.operators import scores as R


@pytest.fixture(scope="module")
def index(spark):
    """Half of all prototypes sit in cell 0; cell 5 has two, cell 6 none."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        cell = 0 if i % 2 else (5 if i in (2, 4) else 1 + i % 4)
        rows.append((i, cell, [float(x) for x in rng.normal(size=8)], float(cell * 5 + rng.uniform()), float(cell * 9 + rng.uniform())))
    protos = spark.createDataFrame(rows, "vec_id long, cell_idx long, embedding array<float>, lat double, lng double")
    qs = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(60)]
    return rows, protos, qs, spark.createDataFrame(qs, "query_id long, embedding array<double>")


def brute(rows, q, cell, k):
    q = np.array(q) / np.linalg.norm(q)
    sims = sorted(((-float(np.dot(np.float32(v).astype(float), q) / np.linalg.norm(np.float32(v).astype(float))), i, la, ln)
                   for i, c, v, la, ln in rows if c == cell))
    return sims[:k]


def test_in_cell_topk_small_packs_hot_cell(spark, index):
    rows, protos, qs, queries = index
    cands = spark.createDataFrame([(q, c) for q, _ in qs for c in (0, 3, 5, 6)], "query_id long, cell_idx long")
    V_old = V.PACKS_PER_KEY
    V.PACKS_PER_KEY = 2
    try:
        got = V.in_cell_topk(cands, queries, protos, 3, proto_pack=20, query_pack=4).collect()
    finally:
        V.PACKS_PER_KEY = V_old
    best = {}
    for r in got:
        best.setdefault((r.query_id, r.cell_idx), []).append((r.rn, r.vec_id, r.sim))
    for q, vec in qs:
        for c in (0, 3, 5):
            want = brute(rows, vec, c, 3)
            assert [v for _, v, _ in sorted(best[(q, c)])] == [i for _, i, _, _ in want]
        assert (q, 6) not in best


def test_refine_needs_three_prototypes(spark, index):
    rows, protos, qs, queries = index
    cands = spark.createDataFrame([(q, c) for q, _ in qs[:5] for c in (0, 5, 6)], "query_id long, cell_idx long")
    out = V.refine_in_cell(cands, queries, protos).collect()
    assert {r.cell_idx for r in out} == {0} and len(out) == 5
    want = brute(rows, qs[0][1], 0, 5)
    w = np.exp((np.array([-s for s, *_ in want]) + want[0][0]) / 0.1)
    r = next(x for x in out if x.query_id == 0)
    assert abs(r.lat - np.dot(w, [x[2] for x in want]) / w.sum()) < 1e-9 and r.n_used == 5


def scores_of(spark, qs):
    return spark.createDataFrame([(q, 9, c, float((q * 7 + c * 3) % 5)) for q, _ in qs for c in range(7)],
                                 "query_id long, level int, idx long, logit double")


def test_selector_with_one_candidate_is_the_refined_argmax(spark, index):
    _, protos, qs, queries = index
    s = scores_of(spark, qs)
    best = R.ranked(s, 1).select("query_id", F.col("idx").alias("cell_idx"))
    one = {r.query_id: (r.cell_idx, round(r.lat, 9)) for r in V.select_by_content(s, queries, protos, 1).collect()}
    ref = {r.query_id: (r.cell_idx, round(r.lat, 9)) for r in V.refine_in_cell(best, queries, protos).collect()}
    assert one == ref


def test_selector_prefers_similarity_then_rank(spark, index):
    rows, protos, qs, queries = index
    out = {r.query_id: r for r in V.select_by_content(scores_of(spark, qs), queries, protos, 7).collect()}
    for q, vec in qs:
        sims = {c: -brute(rows, vec, c, 1)[0][0] for c in (0, 1, 3)}
        assert out[q].cell_idx == max(sims, key=sims.get)


def test_knn_matches_brute_force(spark, index):
    rows, protos, qs, queries = index
    got = {}
    for r in V.knn(queries, protos, 2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    flat = [(i, 0, v, la, ln) for i, _, v, la, ln in rows]
    assert all([got[q][1], got[q][2]] == [i for _, i, _, _ in brute(flat, vec, 0, 2)] for q, vec in qs)


def test_merge_shards_rejects(spark):
    a = spark.createDataFrame([(1, 0, 9, "x"), (2, 0, 9, "y")], "vec_id long, shard int, level int, file string")
    with pytest.raises(Exception, match="duplicate shard"):
        V.merge_shards(a).collect()
    b = spark.createDataFrame([(1, 0, 9, "x"), (2, 0, 6, "x")], "vec_id long, shard int, level int, file string")
    with pytest.raises(Exception, match="level mismatch"):
        V.merge_shards(b).collect()


def test_softmax_sums_to_one_and_mask_keeps_something(spark):
    s = spark.createDataFrame([(1, 9, i, float(i) * 400) for i in range(4)], "query_id long, level int, idx long, logit double")
    assert abs(R.softmax(s).agg(F.sum("prob")).first()[0] - 1) < 1e-12
    pmap = spark.createDataFrame([(9, i, 6, -1) for i in range(4)], "child_level int, child_idx long, parent_level int, parent_idx long")
    parents = spark.createDataFrame([(1, 7)], "query_id long, parent_idx long")
    assert R.mask_by_parent(s, pmap, 6, (9,), 1, parents=parents).count() == 4  # an emptying mask is not applied
    dist = spark.createDataFrame([(9, 0, "A", 0.2), (9, 0, "B", 0.8), (9, 1, "A", 1.0)], "level int, idx long, country string, p double")
    top = spark.createDataFrame([(1, "A")], "query_id long, country string")
    kept = {r.idx for r in R.mask_by_country(s, dist, top, 9).collect()}
    assert kept == {1, 2, 3}  # 0 is below the threshold, 2 and 3 have no data


def test_pruned_ancestor_counts_minus_1e9(spark):
    s = spark.createDataFrame([(1, lv, i, 0.0) for lv, n in ((3, 1), (6, 1), (9, 1), (12, 2)) for i in range(n)],
                              "query_id long, level int, idx long, logit double")
    pmap = spark.createDataFrame([(12, 0, 9, 0), (12, 1, 9, -1), (12, 0, 6, 0), (12, 1, 6, 0), (12, 0, 3, 0), (12, 1, 3, 0)],
                                 "child_level int, child_idx long, parent_level int, parent_idx long")
    out = {(r.level, r.idx): r.logit for r in R.joint_rerank(s, pmap).collect()}
    assert out[(12, 1)] < -9e8 and abs(out[(12, 0)] - np.log(0.5)) < 1e-9


def test_decision_never_moves_without_a_near_point(spark):
    rows = [(1, True, False, "street", 0.9, 1.0, 1.0, "amenity=bank", "Peru"), (2, True, False, "street", 0.9, 1.0, 9.0, "amenity=bank", "Peru"),
            (3, True, False, "street", 0.9, 1.0, 1.0, "place=city", "Peru"), (4, True, False, "street", 0.9, 1.0, 1.0, "amenity=bank", "Chile"),
            (5, True, False, "street", 0.69, 1.0, 1.0, "amenity=bank", "Peru"), (6, False, False, "street", 0.9, 1.0, 1.0, "amenity=bank", "Peru"),
            (7, True, True, "street", 0.9, 1.0, 1.0, "amenity=bank", "Peru"), (8, True, False, "city", 0.9, 1.0, 1.0, "amenity=bank", "Peru")]
    df = spark.createDataFrame(rows, "id int, has_text boolean, timed_out boolean, pl string, c double, lat double, lng double, pt string, country string").select(
        "id", "has_text", "timed_out", F.struct(F.col("pl").alias("precision_level"), F.col("c").alias("confidence")).alias("pinpoint"),
        F.struct("lat", "lng", F.col("pt").alias("place_type"), "country").alias("hit"), F.lit("Cusco, Peru").alias("hub"),
        F.lit(1.1).alias("stage1_lat"), F.lit(1.1).alias("stage1_lng"))
    got = {r.id: (r.decision.reason, r.decision.lat) for r in D.refine_decision(df).collect()}
    assert got[1] == ("accept", 1.0)
    assert {i: r for i, (r, _) in got.items() if i > 1} == {2: "too_far", 3: "area_centroid", 4: "country_mismatch", 5: "low_confidence",
                                                          6: "no_text", 7: "timeout", 8: "too_coarse"}
    assert all(lat == 1.1 for i, (_, lat) in got.items() if i > 1)


def test_a_query_sends_its_best_once_for_all_packs_of_a_key():
    """Packs of one query pack are merged in the task; copies tie to the smaller id whatever their place, NaN comes last."""
    import pyarrow as pa
    rng = np.random.default_rng(5)
    vecs = np.repeat(rng.normal(size=(60, 8)), 5, axis=0)
    vecs[7] = np.nan
    ids = rng.permutation(300)
    asked = rng.normal(size=(9, 8))
    protos = [{"vec_id": int(i), "embedding": v.tolist(), "lat": None if i == 3 else float(i), "lng": 1.0} for i, v in zip(ids, vecs)]
    queries = [{"query_id": n, "embedding": v.tolist()} for n, v in enumerate(asked)]
    kind = pa.struct([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("lat", pa.float64()), ("lng", pa.float64())])
    asks = pa.struct([("query_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    packs = [protos[i:i + 70] for i in range(0, 300, 70)]

    def batch(rows):
        n = len(rows)
        return pa.record_batch([pa.array([4] * n, pa.int64()), pa.array([300] * n, pa.int64()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64()),
                                pa.array(rows, pa.list_(kind)), pa.array([queries] * n, pa.list_(asks))],
                               names=["cell_idx", "n_prototypes", "chunk", "_j", "protos", "queries"])

    for k in (3, 7, 400):
        out = pa.Table.from_batches(list(V._best_of(k, ())(iter([batch(packs[:2]), batch(packs[2:])])))).to_pylist()
        assert len(out) == 9 * min(k, 300)
        for n, v in enumerate(asked):
            sims = [(float(np.dot(x / np.linalg.norm(x), v / np.linalg.norm(v))), int(i)) for i, x in zip(ids, vecs)]
            want = sorted(((-round(s, 9), i) if s == s else (9.0, i)) for s, i in sims)[:k]
            got = [r for r in out if r["query_id"] == n]
            assert [r["vec_id"] for r in got] == [i for _, i in want]
            assert all(r["lat"] == (None if r["vec_id"] == 3 else r["vec_id"]) for r in got)
