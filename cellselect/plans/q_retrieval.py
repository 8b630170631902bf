"""Vector retrieval: in-cell refinement, selector, averaging, sweep, attribution, index jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.operators import approximate as V2
from cellselect.operators import retrieval as V
from cellselect.operators import scores as R
from cellselect.plans.registry import query
from cellselect.plans.views import hav


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _cands(t, k):
    return R.topk_candidates(t.scores.where("level = 9"), k, t.cells).select(
        "query_id", F.col("idx").alias("cell_idx"), "rank", "prob")


@query("j11_candidate_prototypes", """
SELECT s.query_id, s.cell_idx, s.vec_id, round(s.sim, 6) AS sim FROM sims s
JOIN probs p ON p.query_id = s.query_id AND p.level = 9 AND p.idx = s.cell_idx AND p.rnk <= 3 WHERE s.rn <= 4""", "sims probs")
def j11(t):
    out = V.in_cell_topk(_cands(t, 3), t.probes, t.protos, 4)
    return _round(out.select("query_id", "cell_idx", "vec_id", "sim"), "sim")


_REFINED = """
SELECT r.query_id, r.cell_idx, round(r.lat, 6) AS lat, round(r.lng, 6) AS lng, r.n_used, round(r.top_similarity, 6) AS top_similarity, r.n_prototypes
FROM refined r JOIN probs p ON p.query_id = r.query_id AND p.level = 9 AND p.idx = r.cell_idx AND p.rnk <= 5"""


@query("r1_refine_in_cell", _REFINED, "refined probs")
def r1(t):
    out = V.refine_in_cell(_cands(t, 5).select("query_id", "cell_idx"), t.probes, t.protos)
    return _round(out, "lat", "lng", "top_similarity")


@query("w12_knn_weights", """
SELECT query_id, cell_idx, vec_id, round(w / sum(w) OVER (PARTITION BY query_id, cell_idx), 6) AS weight FROM (
  SELECT s.query_id, s.cell_idx, s.vec_id, exp((sim - max(sim) OVER (PARTITION BY s.query_id, s.cell_idx)) / 0.1) AS w
  FROM sims s JOIN probs p ON p.query_id = s.query_id AND p.level = 9 AND p.idx = s.cell_idx AND p.rnk <= 2 WHERE s.rn <= 5)""", "sims probs")
def w12(t):
    top = V.in_cell_topk(_cands(t, 2), t.probes, t.protos, 5).withColumn("s", F.col("sim") / 0.1)
    out = R.softmax(top, ["query_id", "cell_idx"], "s")
    return _round(out.select("query_id", "cell_idx", "vec_id", F.col("prob").alias("weight")), "weight")


@query("r2_select_by_content", """
SELECT query_id, cell_idx, round(lat, 6) AS lat, round(lng, 6) AS lng, round(top_similarity, 6) AS top_similarity, rnk AS rank FROM selected
""", "selected")
def r2(t):
    out = V.select_by_content(t.scores, t.probes, t.protos, 5)
    return _round(out.select("query_id", "cell_idx", "lat", "lng", "top_similarity", "rank"), "lat", "lng", "top_similarity")


_AVG = f"""
WITH r AS (SELECT r.*, p.rnk, p.prob FROM refined r JOIN probs p ON p.query_id = r.query_id AND p.level = 9 AND p.idx = r.cell_idx WHERE p.rnk <= 3),
a AS (SELECT r.*, f.lat AS alat, f.lng AS alng FROM r JOIN (SELECT query_id, arg_min(lat, rnk) AS lat, arg_min(lng, rnk) AS lng FROM r GROUP BY query_id) f USING (query_id))
SELECT query_id, count(*) AS refinements, bool_and({hav('alat', 'alng', 'lat', 'lng')} <= 3500) AND count(*) > 1 AS averaged,
       round(CASE WHEN bool_and({hav('alat', 'alng', 'lat', 'lng')} <= 3500) AND count(*) > 1 THEN sum(lat * prob) / sum(prob) ELSE max(alat) END, 6) AS lat,
       round(CASE WHEN bool_and({hav('alat', 'alng', 'lat', 'lng')} <= 3500) AND count(*) > 1 THEN sum(lng * prob) / sum(prob) ELSE max(alng) END, 6) AS lng
FROM a GROUP BY query_id"""


@query("r3_refine_average", _AVG, "refined probs")
def r3(t):
    out = V.refine_average(_cands(t, 3), t.probes, t.protos, 3, 3500.0)
    return _round(out.select("query_id", "refinements", "averaged", "lat", "lng"), "lat", "lng")


@query("r8_selector_sweep", """
SELECT k, count(*) AS n, round(avg(top_similarity), 6) AS mean_similarity FROM (
  SELECT b.k, r.query_id, max(r.top_similarity) AS top_similarity
  FROM refined r JOIN probs p ON p.query_id = r.query_id AND p.level = 9 AND p.idx = r.cell_idx
  JOIN (VALUES (1), (3), (5), (11)) AS b(k) ON p.rnk <= b.k GROUP BY b.k, r.query_id) GROUP BY k""", "refined probs")
def r8(t):
    out = V.selector_sweep(t.scores, t.probes, t.protos, (1, 3, 5, 11))
    return _round(out.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.avg("top_similarity").alias("mean_similarity")),
                  "mean_similarity")


def _variants(t):
    """Four blocks per view: a quarter of one half of the vector set to zero."""
    step = F.col("view") * 32 + F.col("block") * 8
    masked = F.transform("embedding", lambda x, i: F.when((i >= step) & (i < step + 8), 0.0).otherwise(x))
    return (t.probes.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(1))))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("embedding", masked))


@query("r10_occlusion_drops", """
WITH base AS (SELECT query_id, cell_idx, sim FROM sims WHERE rn = 1),
sel AS (SELECT s.query_id, s.cell_idx, b.sim AS base_sim FROM selected s JOIN base b USING (query_id, cell_idx)),
parts AS (SELECT query_id, v.view, b.block, list_transform(range(1, len(q) + 1), lambda i: CASE WHEN i > v.view * 32 + b.block * 8 AND i <= v.view * 32 + b.block * 8 + 8 THEN 0.0 ELSE q[i] END) AS m
          FROM probes, range(2) AS v(view), range(4) AS b(block)),
norms AS (SELECT *, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS n FROM parts),
best AS (SELECT p.query_id, p.view, p.block, max(base_sim) AS base_sim, max(list_dot_product(p.m, u.u) / p.n) AS sim
         FROM norms p JOIN sel s USING (query_id) JOIN unit_protos u ON u.cell_idx = s.cell_idx GROUP BY p.query_id, p.view, p.block)
SELECT query_id, view, block, round(d, 6) AS drop, round(d / (max(d) OVER (PARTITION BY query_id, view) + 1e-8), 5) AS heat
FROM (SELECT *, greatest(0.0, base_sim - sim) AS d FROM best)""", "sims selected probes unit_protos")
def r10(t):
    sel = V.select_by_content(t.scores, t.probes, t.protos, 5).select("query_id", "cell_idx")
    out = V.occlusion_drops(sel.join(t.probes, "query_id"), _variants(t), t.protos)
    return _round(out.withColumns({"view": F.col("view").cast("long"), "block": F.col("block").cast("long")}), "drop") \
        .withColumn("heat", F.round("heat", 5))


@query("r11_knn", """
SELECT query_id, vec_id, round(sim, 6) AS sim, rank FROM (
  SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM sims) WHERE rank <= 3""", "sims")
def r11(t):
    return _round(V.knn(t.probes, t.protos, 3), "sim")


@query("r11_approx_knn")
def r11_approx(t):
    """Ten nearest vectors of every vector by inverted lists; tests hold it against the exact search."""
    return _round(V2.approx_knn(t.probes, t.protos, 10, n_lists=64), "sim")


@query("r11_approx_recall", """
SELECT count(DISTINCT query_id) AS queries, 10 * count(DISTINCT query_id) AS neighbours, true AS enough FROM sims""", "sims")
def r11_recall(t):
    """Share of the exact ten neighbours that the lists find, over all queries: 0.9 or more."""
    r = V2.recall(V2.approx_knn(t.probes, t.protos, 10, n_lists=64), V.knn(t.probes, t.protos, 10))
    return r.agg(F.count(F.lit(1)).alias("queries"), F.sum("k").alias("neighbours"), (F.sum("found") >= 0.9 * F.sum("k")).alias("enough"))


@query("a10_index_report", """
SELECT count(*) AS cells, count(p.n) AS filled, cast(sum(p.n) AS bigint) AS prototypes, round(100.0 * count(p.n) / count(*), 6) AS filled_pct,
       round(sum(p.n) / count(p.n), 6) AS per_cell
FROM (SELECT idx FROM cells WHERE level = 12) c LEFT JOIN (SELECT l9 AS idx, count(*) AS n FROM vectors GROUP BY l9) p USING (idx)""", "cells vectors")
def a10(t):
    return _round(V.index_report(t.cells.where("level = 12"), t.protos), "filled_pct", "per_cell")


@query("e18_rotate_views", """
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * e[(i - 1 + vec_id % 64) % 64 + 1])), 6) AS moment FROM vectors""", "vectors")
def e18(t):
    turned = X.rotate_views("embedding", F.col("vec_id") % 64)
    weighted = F.aggregate(F.transform(turned, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return t.vectors.select("vec_id", F.round(weighted, 6).alias("moment"))


@query("e19_concat_views", """
SELECT vec_id, 4 * len(e) AS length, round(e[1] + e[64], 6) AS ends FROM vectors""", "vectors")
def e19(t):
    views = F.array(*[X.rotate_views("embedding", F.lit(k)) for k in (0, 16, 32, 48)])
    v = t.vectors.select("vec_id", X.concat_views(views).alias("v"))
    return v.select("vec_id", F.size("v").cast("long").alias("length"),
                    F.round(F.element_at("v", 1) + F.element_at("v", 64), 6).alias("ends"))


@query("e20_l2_normalise", "SELECT vec_id, round(u[1], 6) AS first, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS squares FROM unit_protos", "unit_protos")
def e20(t):
    v = t.vectors.select("vec_id", X.l2_normalise("embedding").alias("u"))
    return v.select("vec_id", F.round(F.element_at("u", 1), 6).alias("first"), F.round(X.dot("u", "u"), 6).alias("squares"))


@query("e21_cosine", """
SELECT vec_id, round(list_dot_product(p.u, q.u), 6) AS sim FROM unit_protos p JOIN unit_probes q ON q.query_id = p.vec_id""", "unit_protos unit_probes")
def e21(t):
    q = t.probes.select(F.col("query_id").alias("vec_id"), F.col("embedding").alias("q"))
    return t.vectors.join(q, "vec_id").select("vec_id", F.round(X.cosine("embedding", "q"), 6).alias("sim"))


@query("p5_vector_mean", """
SELECT l9 AS cell_idx, cast(i AS bigint) AS pos, round(avg(e[i]), 6) AS x FROM vectors, range(1, 65) AS r(i) GROUP BY l9, i""", "vectors")
def p5(t):
    m = V.vector_mean(t.protos, ["cell_idx"], "embedding")
    return m.select("cell_idx", F.posexplode("embedding").alias("p", "x")).select(
        "cell_idx", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))
