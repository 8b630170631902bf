"""Evaluation and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.operators import evaluate as E
from cellselect.operators import retrieval as V
from cellselect.operators import scores as R
from cellselect.plans.registry import query
from cellselect.plans.views import hav


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


def _truth(t):
    return t.vectors.select(F.col("vec_id").alias("query_id"), "lat", "lng")


_CUTS = ", ".join(f"round(quantile_cont(d, {p}), 6) AS {n}" for p, n in ((0.1, "p10_km"), (0.5, "median_km"), (0.9, "p90_km")))
_WITHIN = ", ".join(f"round(avg(CASE WHEN d < {x} THEN 1.0 ELSE 0.0 END), 6) AS {E.within_name(x)}" for x in K.WITHIN_KM)
_NEAR = hav("s.lat", "s.lng", "n.centroid_lat", "n.centroid_lng")


@query("a15_distance_summary", f"""
SELECT country_code, count(*) AS n, round(avg(d), 6) AS mean_km, {_CUTS}, {_WITHIN} FROM (
  SELECT country_code, {_NEAR} AS d FROM long_cells s JOIN cell_stats n USING (level, cell) WHERE level = 6 AND country_code IS NOT NULL) GROUP BY country_code
""", "long_cells cell_stats")
def a15(t):
    """Distance of every sample to its level-6 cell centroid, by country."""
    from cellselect.functions import geo
    from cellselect.operators import cells as C
    stats = C.cell_stats(t.s2_samples, levels=[6])
    rows = C.explode_levels(t.s2_samples.where("country_code IS NOT NULL"), ["country_code", "lat", "lng"], [6]).join(stats, ["level", "cell"])
    d = rows.select("country_code", geo.haversine_km("lat", "lng", "centroid_lat", "centroid_lng").alias("distance_km"))
    out = E.distance_summary(d, ["country_code"])
    return _round(out, *[c for c in out.columns if c not in ("country_code", "n")])


_RANKS = """
ranks AS (SELECT p.query_id, p.level, p.rnk FROM probs p JOIN label_long l ON l.query_id = p.query_id AND l.level = p.level AND l.idx = p.idx)"""


@query("a16_topk_accuracy", f"""WITH {_RANKS}
SELECT level, k, count(*) FILTER (rnk <= k) AS correct, count(*) AS n, round(count(*) FILTER (rnk <= k) / count(*), 6) AS acc
FROM ranks JOIN (VALUES (1), (5)) AS ks(k) ON true GROUP BY level, k""", "probs label_long")
def a16(t):
    return _round(E.topk_accuracy(E.truth_rank(t.scores, t.label_long)), "acc")


@query("a17_merge_metrics", """
SELECT l_returnflag AS metric, cast(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS bigint) AS correct, count(*) AS n,
       round(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) / count(*), 6) AS acc FROM lineitem GROUP BY l_returnflag""")
def a17(t):
    """Each supplier's rows are a batch."""
    b = t.read("lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("metric")).agg(
        F.count_if(F.col("l_discount") > 0.05).alias("correct"), F.count(F.lit(1)).alias("n"))
    return _round(E.merge_metrics(b), "acc")


_L6 = f"SELECT s.sample_key, country_code, {_NEAR} AS d FROM long_cells s JOIN cell_stats n USING (level, cell) WHERE level = 6 AND country_code IS NOT NULL"


@query("a17_merge_distances", f"""
SELECT country_code AS metric, cast(count(*) FILTER (d < 25) AS bigint) AS correct, count(*) AS n, round(count(*) FILTER (d < 25) / count(*), 6) AS acc,
       count(*) AS n_distances, round(avg(d), 6) AS mean_km, {_CUTS}, {_WITHIN} FROM ({_L6}) GROUP BY country_code""", "long_cells cell_stats")
def a17_distances(t):
    """Batches are the customers' samples, each with its count within 25 km and its list of distances."""
    from cellselect.functions import geo
    from cellselect.operators import cells as C
    stats = C.cell_stats(t.s2_samples, levels=[6])
    rows = C.explode_levels(t.s2_samples.where("country_code IS NOT NULL"), ["cust_key", "country_code", "lat", "lng"], [6]).join(stats, ["level", "cell"])
    d = rows.select("cust_key", F.col("country_code").alias("metric"), geo.haversine_km("lat", "lng", "centroid_lat", "centroid_lng").alias("d"))
    batches = d.groupBy("cust_key", "metric").agg(F.count_if(F.col("d") < 25).alias("correct"), F.count(F.lit(1)).alias("n"), F.collect_list("d").alias("distances"))
    out = E.merge_batches(batches)
    return _round(out, *[c for c in out.columns if c not in ("metric", "correct", "n", "n_distances")])


def _at(name):
    return f"max(CASE WHEN event = '{name}' THEN epoch_us(ts) END)"


@query("a24_stage_timings", f"""
SELECT request_id, round(({_at('fetch_pano_done')} - {_at('fetch_pano_start')}) / 1e6, 3) AS fetch_pano_seconds,
       round(({_at('stage1_done')} - {_at('stage1_start')}) / 1e6, 3) AS stage1_seconds,
       round(({_at('stage2_extract_done')} - {_at('stage2_extract_start')}) / 1e6, 3) AS stage2_extract_seconds,
       round(({_at('stage2_pinpoint_done')} - {_at('stage2_pinpoint_start')}) / 1e6, 3) AS stage2_pinpoint_seconds,
       round(({_at('stage2_geocode_done')} - {_at('stage2_geocode_start')}) / 1e6, 3) AS stage2_geocode_seconds,
       round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 3) AS total_seconds FROM progress GROUP BY request_id""", "progress")
def a24(t):
    out = E.stage_timings(t.progress)
    return out.select("request_id", *[F.round(c, 3).alias(c) for c in out.columns if c != "request_id"])


_D12 = hav("v.lat", "v.lng", "c.centroid_lat", "c.centroid_lng")
_Q1_WITHIN = " UNION ALL ".join(f"SELECT '{E.within_name(x)}', avg(CASE WHEN d < {x} THEN 1.0 ELSE 0.0 END) FROM dist" for x in K.WITHIN_KM)


@query("q1_evaluate", f"""WITH {_RANKS},
dist AS (SELECT {_D12} AS d FROM probs p JOIN cells c USING (level, idx) JOIN vectors v ON v.vec_id = p.query_id WHERE p.level = 12 AND p.rnk = 1),
cr AS (SELECT row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, country) AS rn, query_id, country FROM posterior),
truec AS (SELECT rn FROM cr JOIN vectors v ON v.vec_id = cr.query_id AND v.country = cr.country),
m AS (SELECT concat('L', cast(level AS varchar), '_top', cast(k AS varchar), '_acc') AS metric, count(*) FILTER (rnk <= k) / count(*) AS value
      FROM ranks JOIN (VALUES (1), (5)) AS ks(k) ON true GROUP BY level, k
      UNION ALL SELECT concat('country_top', cast(k AS varchar), '_acc'), count(*) FILTER (rn <= k) / count(*) FROM truec JOIN (VALUES (1), (3)) AS ks(k) ON true GROUP BY k
      UNION ALL SELECT 'mean_km', avg(d) FROM dist UNION ALL SELECT 'p10_km', quantile_cont(d, 0.1) FROM dist
      UNION ALL SELECT 'median_km', quantile_cont(d, 0.5) FROM dist UNION ALL SELECT 'p90_km', quantile_cont(d, 0.9) FROM dist UNION ALL {_Q1_WITHIN})
SELECT metric, round(value, 6) AS value FROM m""", "probs label_long cells vectors posterior")
def q1(t):
    from cellselect.operators import cells as C
    post = R.country_posterior(t.scores, C.country_dist(t.label_long)).withColumn("p", F.round("p", 9))
    true = t.vectors.select(F.col("vec_id").alias("query_id"), "country")
    ranks = R.ranked(post, None, ["query_id"], "p", "country").join(true, ["query_id", "country"]).select("rank")
    return _round(E.evaluate(t.scores, t.label_long, t.cells, _truth(t), 12, ranks), "value")


@query("q2_oracle_floor", f"""
WITH r AS (SELECT l.query_id, l.level, CASE WHEN l.idx >= 0 THEN {hav('l.lat', 'l.lng', 'c.centroid_lat', 'c.centroid_lng')} END AS d
           FROM label_long l LEFT JOIN cells c USING (level, idx)),
b AS (SELECT cast(level AS varchar) AS level, d FROM r UNION ALL SELECT 'finest', arg_max(d, level) FROM r WHERE d IS NOT NULL GROUP BY query_id)
SELECT level, round(count(d) / count(*), 6) AS coverage, round(quantile_cont(d, 0.5), 6) AS median_km FROM b GROUP BY level""", "label_long cells")
def q2(t):
    return _round(E.oracle_floor(t.label_long, t.cells), "coverage", "median_km")


@query("q3_recall_at_k", f"""
WITH kids AS (SELECT l.query_id, m.child_idx AS idx FROM label_long l JOIN pmap m ON l.level = 6 AND m.child_level = 9 AND m.parent_level = 6 AND m.parent_idx = l.idx),
forced AS (SELECT s.query_id, s.idx, row_number() OVER (PARTITION BY s.query_id ORDER BY s.logit DESC, s.idx) AS rnk
           FROM scores s JOIN kids USING (query_id, idx) WHERE s.level = 9),
ranks AS (SELECT p.query_id, p.rnk, 'free' AS regime FROM probs p JOIN label_long l ON l.query_id = p.query_id AND l.level = p.level AND l.idx = p.idx WHERE p.level = 9
          UNION ALL SELECT f.query_id, f.rnk, 'forced' FROM forced f JOIN label_long l ON l.query_id = f.query_id AND l.level = 9 AND l.idx = f.idx)
SELECT 9 AS level, regime, k, round(count(*) FILTER (rnk <= k) / count(*), 6) AS recall FROM ranks JOIN (VALUES (1), (3), (5)) AS ks(k) ON true GROUP BY regime, k
""", "probs label_long pmap scores")
def q3(t):
    """Free-run ranks, and ranks among the children of the true parent."""
    nine = t.scores.where("level = 9")
    true6 = t.label_long.where("level = 6").select("query_id", F.col("idx").alias("parent_idx"))
    forced = R.mask_by_parent(nine, t.pmap, 6, (9,), 1, parents=true6)
    labels = t.label_long.where("level = 9")
    ranks = (E.truth_rank(nine, labels).withColumn("regime", F.lit("free"))
             .unionByName(E.truth_rank(forced, labels).withColumn("regime", F.lit("forced"))))
    return _round(E.recall_at_k(ranks, (1, 3, 5)), "recall")


_DC = hav("v.lat", "v.lng", "c.centroid_lat", "c.centroid_lng")


@query("q4_oracle_selection", f"""
WITH d AS (SELECT p.query_id, p.rnk, {_DC} AS d FROM probs p JOIN cells c USING (level, idx) JOIN vectors v ON v.vec_id = p.query_id WHERE p.level = 9),
b AS (SELECT query_id, k, min(d) AS d FROM d JOIN (VALUES (1), (3), (5), (10)) AS ks(k) ON rnk <= k GROUP BY query_id, k),
m AS (SELECT k, quantile_cont(d, 0.5) AS median_km FROM b GROUP BY k)
SELECT k, round(median_km, 6) AS median_km, round((SELECT median_km FROM m WHERE k = 1) - median_km, 6) AS gap_km FROM m""", "probs cells vectors")
def q4(t):
    return _round(E.oracle_selection(t.scores, t.cells, _truth(t), (1, 3, 5, 10)), "median_km", "gap_km")


_DS = hav("v.lat", "v.lng", "s.lat", "s.lng")


def _selected(t):
    sel = V.select_by_content(t.scores, t.probes, t.protos, 5)
    return E.distances(sel.select("query_id", "lat", "lng", "top_similarity"), _truth(t))


@query("q5_per_country", f"""
WITH r AS (SELECT v.country, {_DS} AS d, s.top_similarity FROM selected s JOIN vectors v ON v.vec_id = s.query_id)
SELECT country, count(*) AS n, round(avg(CASE WHEN d < 25 THEN 1.0 ELSE 0.0 END), 6) AS within_25km, round(avg(top_similarity), 6) AS mean_similarity,
       round(quantile_cont(d, 0.5), 6) AS median_km, any_value(n_train) AS n_train
FROM r JOIN (SELECT country, count(*) AS n_train FROM vectors GROUP BY country) USING (country) GROUP BY country""", "selected vectors")
def q5(t):
    country = t.vectors.select(F.col("vec_id").alias("query_id"), "country")
    rows = _selected(t).join(country, "query_id").withColumnRenamed("top_similarity", "similarity")
    supply = t.vectors.groupBy("country").agg(F.count(F.lit(1)).alias("n_train"))
    return _round(E.per_country(rows, supply), "within_25km", "mean_similarity", "median_km")


@query("q6_compare_runs", f"""
WITH runs AS (SELECT 'select' AS variant, s.query_id, {_DS} AS d FROM selected s JOIN vectors v ON v.vec_id = s.query_id
  UNION ALL SELECT CASE p.level WHEN 9 THEN 'greedy9' ELSE 'greedy12' END, p.query_id, {_DC} FROM probs p JOIN cells c USING (level, idx) JOIN vectors v ON v.vec_id = p.query_id
  WHERE p.level IN (9, 12) AND p.rnk = 1)
SELECT a.variant, count(*) AS n, round(avg(a.d - b.d), 6) AS mean_delta_km, round(avg(CASE WHEN a.d > b.d THEN 1.0 ELSE 0.0 END), 6) AS worse,
       round(quantile_cont(a.d - b.d, 0.5), 6) AS median_delta_km
FROM runs a JOIN runs b ON a.query_id = b.query_id AND b.variant = 'greedy9' AND a.variant <> 'greedy9' GROUP BY a.variant""", "selected probs cells vectors")
def q6(t):
    runs = _selected(t).select(F.lit("select").alias("variant"), "query_id", "distance_km")
    for level in (9, 12):
        d = E.argmax_distances(t.scores, t.cells, _truth(t), level)
        runs = runs.unionByName(d.select(F.lit(f"greedy{level}").alias("variant"), "query_id", "distance_km"))
    return _round(E.compare_runs(runs, "greedy9"), "mean_delta_km", "worse", "median_delta_km")
