"""Decision cascades."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import text as T
from cellselect.operators import decide as D
from cellselect.operators import retrieval as V
from cellselect.operators import scores as R
from cellselect.operators import spatial as S
from cellselect.plans.q_scores import CASCADE
from cellselect.plans.q_text import seen
from cellselect.plans.registry import query
from cellselect.plans.views import hav, pip

_REQ = """
req AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name END AS scope,
  ['none such', concat('Supplier#', lpad(cast(c_custkey % 300 AS varchar), 9, '0')), concat(' supplier#', lpad(cast(c_custkey * 7 % 50 AS varchar), 9, '0'))] AS q
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
found AS (SELECT c_custkey, query, lat, lng, importance, place_type, country FROM (
  SELECT r.c_custkey, r.query, g.*, row_number() OVER (PARTITION BY r.c_custkey ORDER BY pos, importance DESC, country, lat, lng) AS rn
  FROM (SELECT c_custkey, scope, unnest(q) AS query, unnest(range(len(q))) AS pos FROM req) r JOIN gazetteer g
  ON g.name = lower(trim(r.query)) AND (r.scope IS NULL OR r.scope = g.country) AND g.importance >= 0.05) WHERE rn = 1)"""


def _hits(t):
    k = F.col("c_custkey")

    def name(head, n):
        return F.concat(F.lit(head), F.lpad(n.cast("string"), 9, "0"))

    req = t.read("customer").join(t.read("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.when(k % 3 == 0, F.col("n_name")).alias("scope"),
        F.array(F.lit("none such"), name("Supplier#", k % 300), name(" supplier#", k * 7 % 50)).alias("queries"))
    return D.geocode_first_hit(req, t.gazetteer, "c_custkey", 0.05)


@query("j12_geocode_first_hit", f"WITH {_REQ} SELECT c_custkey, query, round(lat, 6) AS lat, round(lng, 6) AS lng, importance, place_type, country FROM found", "gazetteer")
def j12(t):
    return _hits(t).withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query("f6_importance_floor", "SELECT name, importance FROM gazetteer WHERE importance >= 0.5", "gazetteer")
def f6(t):
    return t.gazetteer.where("importance >= 0.5").select("name", "importance")


_TOP = """
t9 AS (SELECT query_id, idx, prob, centroid_lat AS lat, centroid_lng AS lng FROM probs JOIN cells USING (level, idx) WHERE level = 9 AND rnk = 1),
t12 AS (SELECT query_id, idx, centroid_lat AS lat, centroid_lng AS lng, n FROM probs JOIN cells USING (level, idx) WHERE level = 12 AND rnk = 1)"""
_FAR = hav("a.lat", "a.lng", "b.lat", "b.lng")
_FAR9 = hav("coalesce(r.lat, a.lat)", "coalesce(r.lng, a.lng)", "b.lat", "b.lng")


def _tops(t):
    best = R.argmax_centroid(t.scores, t.cells).join(t.cells.select("level", "idx", "n"), ["level", "idx"])
    c = F.struct(F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"), "idx", "n")
    return best.groupBy("query_id").agg(F.max(F.when(F.col("level") == 9, c)).alias("l9"), F.max(F.when(F.col("level") == 12, c)).alias("l12"))


@query("d1_l9_fallback", f"""WITH {_TOP}
SELECT query_id, round(CASE WHEN {_FAR} > 4000 THEN a.lat ELSE b.lat END, 6) AS lat, round(CASE WHEN {_FAR} > 4000 THEN a.lng ELSE b.lng END, 6) AS lng,
       {_FAR} > 4000 AS fallback_used FROM t9 a JOIN t12 b USING (query_id)""", "probs cells")
def d1(t):
    d = D.l9_fallback(F.col("l9.lat"), F.col("l9.lng"), F.col("l12.lat"), F.col("l12.lng"), 4000.0)
    return _tops(t).select("query_id", d.alias("d")).select("query_id", F.round("d.lat", 6).alias("lat"),
                                                            F.round("d.lng", 6).alias("lng"), "d.fallback_used")


@query("d2_final_point", f"""WITH {_TOP}
SELECT query_id, branch, branch IN ('unconstrained', 'far') AS fallback_used,
  round(CASE WHEN branch = 'selected' THEN slat WHEN branch IN ('unconstrained', 'far') THEN coalesce(rlat, alat) WHEN branch = 'refined' THEN rlat ELSE blat END, 6) AS lat,
  round(CASE WHEN branch = 'selected' THEN slng WHEN branch IN ('unconstrained', 'far') THEN coalesce(rlng, alng) WHEN branch = 'refined' THEN rlng ELSE blng END, 6) AS lng
FROM (SELECT a.query_id, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng, s.lat AS slat, s.lng AS slng, r.lat AS rlat, r.lng AS rlng,
  CASE WHEN s.lat IS NOT NULL THEN 'selected' WHEN NOT EXISTS (SELECT 1 FROM pmap WHERE parent_level = 9 AND child_level = 12 AND parent_idx = a.idx) THEN 'unconstrained'
       WHEN {_FAR9} > 8000 THEN 'far' WHEN b.n >= 12 THEN 'dense'
       WHEN r.lat IS NOT NULL THEN 'refined' ELSE 'sparse' END AS branch
  FROM t9 a JOIN t12 b USING (query_id) LEFT JOIN (SELECT * FROM selected WHERE top_similarity > 0.75) s USING (query_id)
  LEFT JOIN refined r ON r.query_id = a.query_id AND r.cell_idx = a.idx)""", "probs cells selected refined pmap")
def d2(t):
    point = F.struct("lat", "lng")
    sel = V.select_by_content(t.scores, t.probes, t.protos, 5).where("top_similarity > 0.75").select("query_id", point.alias("selected"))
    top = _tops(t)
    ref = V.refine_in_cell(top.select("query_id", F.col("l9.idx").alias("cell_idx")), t.probes, t.protos).select("query_id", point.alias("refined"))
    df = top.join(sel, "query_id", "left").join(ref, "query_id", "left").join(
        R.unconstrained(top.select("query_id", F.col("l9.idx").alias("idx")), t.pmap), "query_id")
    f = D.final_point(df, 8000.0, 12).select("query_id", "final.*")
    return f.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


_FIRST_STAGE = f"""{CASCADE},
best AS (SELECT query_id, level, idx, row_number() OVER (PARTITION BY query_id, level ORDER BY logit DESC, idx) AS rn FROM m9),
a9 AS (SELECT query_id, b.idx, centroid_lat AS lat, centroid_lng AS lng FROM best b JOIN cells c USING (level, idx) WHERE level = 9 AND rn = 1),
b12 AS (SELECT query_id, b.idx, centroid_lat AS lat, centroid_lng AS lng, n FROM best b JOIN cells c USING (level, idx) WHERE level = 12 AND rn = 1)"""


@query("predict", f"""WITH {_FIRST_STAGE},
pick AS (SELECT query_id, lat, lng FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id ORDER BY r.top_similarity DESC, b.rn) AS pick
         FROM refined r JOIN best b ON b.query_id = r.query_id AND b.level = 9 AND b.idx = r.cell_idx AND b.rn <= 5) WHERE pick = 1)
SELECT a.query_id, a.idx AS l9_idx, b.idx AS l12_idx,
  CASE WHEN s.lat IS NOT NULL THEN 'selected' WHEN l12_unconstrained THEN 'unconstrained' WHEN {_FAR} > 8000 THEN 'far' WHEN b.n >= 12 THEN 'dense' ELSE 'sparse' END AS branch,
  round(CASE WHEN s.lat IS NOT NULL THEN s.lat WHEN l12_unconstrained OR {_FAR} > 8000 THEN a.lat ELSE b.lat END, 6) AS lat,
  round(CASE WHEN s.lat IS NOT NULL THEN s.lng WHEN l12_unconstrained OR {_FAR} > 8000 THEN a.lng ELSE b.lng END, 6) AS lng
FROM a9 a JOIN b12 b USING (query_id) JOIN flags USING (query_id) LEFT JOIN pick s USING (query_id)""", "scores pmap cells refined")
def predict(t):
    """First stage in selector mode over all queries."""
    out = D.predict(t.scores, t.cells, t.pmap, t.probes, t.protos, select_k=5, k3=2, k6=2, k9=1, threshold=8000.0, min_count=12)
    return out.select("query_id", "l9_idx", "l12_idx", "branch", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query("predict_average", f"""WITH {_FIRST_STAGE}
SELECT query_id, branch, round(CASE WHEN branch IN ('unconstrained', 'far') THEN coalesce(rlat, alat) WHEN branch = 'refined' THEN rlat ELSE blat END, 6) AS lat,
  round(CASE WHEN branch IN ('unconstrained', 'far') THEN coalesce(rlng, alng) WHEN branch = 'refined' THEN rlng ELSE blng END, 6) AS lng
FROM (SELECT a.query_id, a.lat AS alat, a.lng AS alng, b.lat AS blat, b.lng AS blng, r.lat AS rlat, r.lng AS rlng,
  CASE WHEN l12_unconstrained THEN 'unconstrained' WHEN {_FAR9} > 8000 THEN 'far' WHEN b.n >= 12 THEN 'dense' WHEN r.lat IS NOT NULL THEN 'refined' ELSE 'sparse' END AS branch
  FROM a9 a JOIN b12 b USING (query_id) JOIN flags USING (query_id) LEFT JOIN refined r ON r.query_id = a.query_id AND r.cell_idx = a.idx)""", "scores pmap cells refined")
def predict_average(t):
    """First stage in averaging mode with one cell: the refined point feeds the distance test."""
    out = D.predict(t.scores, t.cells, t.pmap, t.probes, t.protos, select_k=0, average_n=1, k3=2, k6=2, k9=1, threshold=8000.0, min_count=12)
    return out.select("query_id", "branch", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


_AREA = "(split_part(place_type, '=', 1) = 'boundary' OR split_part(place_type, '=', 2) IN ('city', 'administrative'))"
_DRIFT = hav("slat", "slng", "lat", "lng")
_DECIDED = f"""{_REQ.replace('found AS', 'named AS')},
found AS (SELECT n.* REPLACE (g.gid_0 AS country) FROM named n LEFT JOIN ({pip('named', 'c_custkey')}) g USING (c_custkey)),
decided AS (SELECT *, CASE WHEN NOT has_text THEN 'no_text' WHEN timed_out THEN 'timeout' WHEN precision_level NOT IN ('street', 'neighborhood') THEN 'too_coarse'
    WHEN confidence < 0.7 THEN 'low_confidence' WHEN lat IS NULL THEN 'geocode_miss' WHEN lower(country) <> hub AND NOT contains(lower(country), hub) AND NOT contains(hub, lower(country)) THEN 'country_mismatch'
    WHEN {_AREA} THEN 'area_centroid' WHEN {_DRIFT} > 75 THEN 'too_far' ELSE 'accept' END AS reason
  FROM (SELECT c.c_custkey, f.lat, f.lng, f.country, f.place_type, c.c_custkey % 17 <> 0 AS has_text, c.c_custkey % 19 = 0 AS timed_out,
     CASE WHEN c.c_custkey % 13 = 0 THEN 'city' WHEN c.c_custkey % 2 = 0 THEN 'street' ELSE 'neighborhood' END AS precision_level,
     CASE WHEN c.c_custkey % 9 = 0 THEN 0.5 ELSE 0.9 END AS confidence,
     CASE WHEN c.c_custkey % 7 = 0 THEN 'elsewhere' ELSE coalesce(lower(f.country), 'x') END AS hub,
     coalesce(f.lat, 0) + CASE WHEN c.c_custkey % 5 = 0 THEN 2.0 ELSE 0.1 END AS slat, coalesce(f.lng, 0) AS slng
   FROM customer c LEFT JOIN found f USING (c_custkey)))"""


def decided(t):
    k = F.col("c_custkey")
    hits = D.hit_country(_hits(t), S.cover_tiles(t.boundaries, 4.0)).select("c_custkey", F.struct("lat", "lng", "place_type", "country", "query").alias("hit"))
    df = t.read("customer").select("c_custkey").join(hits, "c_custkey", "left").select(
        "c_custkey", "hit", (k % 17 != 0).alias("has_text"), (k % 19 == 0).alias("timed_out"),
        F.struct(F.when(k % 13 == 0, "city").when(k % 2 == 0, "street").otherwise("neighborhood").alias("precision_level"),
                 F.when(k % 9 == 0, 0.5).otherwise(0.9).alias("confidence")).alias("pinpoint"),
        F.when(k % 7 == 0, "Region, Elsewhere").otherwise(F.concat(F.lit("Region, "), F.coalesce(F.col("hit.country"), F.lit("x")))).alias("hub"),
        (F.coalesce(F.col("hit.lat"), F.lit(0.0)) + F.when(k % 5 == 0, 2.0).otherwise(0.1)).alias("stage1_lat"),
        F.coalesce(F.col("hit.lng"), F.lit(0.0)).alias("stage1_lng"))
    return D.refine_decision(df)


@query("d3_refine_decision", f"""WITH {_DECIDED}
SELECT c_custkey, reason, reason = 'accept' AS used, round(CASE WHEN reason = 'accept' THEN lat ELSE slat END, 6) AS lat,
       round(CASE WHEN reason = 'accept' THEN lng ELSE slng END, 6) AS lng, CASE WHEN reason = 'accept' THEN precision_level ELSE 'country' END AS precision FROM decided""", "gazetteer edges")
def d3(t):
    d = decided(t).select("c_custkey", "decision.*")
    return d.select("c_custkey", "reason", "used", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "precision")


@query("d4_merge_refinement", f"""WITH {_DECIDED}
SELECT c_custkey, CASE WHEN c_custkey % 23 = 0 THEN false ELSE reason = 'accept' END AS stage2_used,
       CASE WHEN c_custkey % 23 = 0 THEN 'failed' END AS stage2_error,
       round(CASE WHEN c_custkey % 23 <> 0 AND reason = 'accept' THEN lat ELSE slat END, 6) AS lat,
       round(CASE WHEN c_custkey % 23 <> 0 AND reason = 'accept' THEN slat END, 6) AS stage1_lat FROM decided""", "gazetteer edges")
def d4(t):
    d = decided(t).select("c_custkey", F.col("stage1_lat").alias("final_lat"), F.col("stage1_lng").alias("final_lng"),
                          F.when(F.col("c_custkey") % 23 != 0, F.col("decision")).alias("decision"), F.lit("failed").alias("error"))
    return D.merge_refinement(d).select("c_custkey", "stage2_used", "stage2_error", F.round("lat", 6).alias("lat"),
                                        F.round("stage1_lat", 6).alias("stage1_lat"))


@query("d5_build_result", """
SELECT query_id, string_agg(concat(cast(level AS varchar), ':', cells), ' ' ORDER BY level) AS per_level FROM (
  SELECT query_id, level, string_agg(concat(cast(rnk AS varchar), '=', CASE WHEN idx % 3 = 0 THEN '??' ELSE concat('C', cast(idx AS varchar)) END), ',' ORDER BY rnk) AS cells
  FROM probs WHERE rnk <= 5 GROUP BY query_id, level) GROUP BY query_id""", "probs")
def d5(t):
    c = R.topk_candidates(t.scores, 5, t.cells).withColumn(
        "country_code", F.when(F.col("idx") % 3 != 0, F.concat(F.lit("C"), F.col("idx").cast("string"))))
    entries = F.map_entries("per_level")
    text = F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), F.array_join(F.transform(
        e["value"], lambda x: F.concat(x["rank"].cast("string"), F.lit("="), x["country_code"])), ",")))
    return D.build_result(c).select("query_id", F.array_join(text, " ").alias("per_level"))


_SEEN_SQL = """
seen AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Thai' WHEN 1 THEN 'Latin' WHEN 2 THEN 'Greek' WHEN 3 THEN 'Runic' END AS script,
         CASE lang WHEN 'fr' THEN 'Thailand' WHEN 'es' THEN 'Cyprus' WHEN 'de' THEN 'Japan' ELSE 'Peru' END AS country,
         CASE WHEN length(source) = 4 THEN 'left' ELSE 'right' END AS side FROM documents),
odd AS (SELECT doc_id // 4 AS query_id, doc_id % 4 AS rank, country, (script = 'Thai' AND country <> 'Thailand') OR (script = 'Greek' AND country <> 'Cyprus')
        OR (country <> 'Peru' AND side <> 'left') AS odd FROM seen)"""


@query("d6_verify_candidates", f"""WITH {_SEEN_SQL}
SELECT query_id, rank, country, NOT coalesce(odd, false) AS verified FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(odd, false), rank) AS rn FROM odd) WHERE rn = 1""")
def d6(t):
    """Four documents stand for a query's candidates."""
    c = seen(t).select(F.floor(F.col("doc_id") / 4).alias("query_id"), (F.col("doc_id") % 4).alias("rank"), "country", "contradictions")
    return D.verify_candidates(c).select("query_id", "rank", "country", "verified")
