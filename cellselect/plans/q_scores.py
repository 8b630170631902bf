"""Score algebra: softmax, top-K, masks, roll-ups, losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.operators import cells as C
from cellselect.operators import scores as R
from cellselect.operators import spatial as S
from cellselect.plans.registry import query
from cellselect.plans.views import hav


def _round(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("w1_topk_candidates", """
SELECT query_id, level, idx, rnk AS rank, round(prob, 6) AS prob, round(centroid_lat, 6) AS lat, round(centroid_lng, 6) AS lng
FROM probs JOIN cells USING (level, idx) WHERE rnk <= 5""", "probs cells")
def w1(t):
    out = R.topk_candidates(t.scores, 5, t.cells)
    return _round(out.select("query_id", "level", "idx", "rank", "prob", F.col("centroid_lat").alias("lat"),
                             F.col("centroid_lng").alias("lng")), "prob", "lat", "lng")


@query("w2_softmax", "SELECT query_id, level, idx, round(prob, 6) AS prob, round(logp, 6) AS logp FROM probs", "probs")
def w2(t):
    return _round(R.softmax(t.scores).drop("logit"), "prob", "logp")


@query("w3_argmax_centroid", """
SELECT query_id, level, idx, round(centroid_lat, 6) AS centroid_lat, round(centroid_lng, 6) AS centroid_lng
FROM probs JOIN cells USING (level, idx) WHERE rnk = 1""", "probs cells")
def w3(t):
    return _round(R.argmax_centroid(t.scores, t.cells), "centroid_lat", "centroid_lng")


@query("a6_country_posterior", "SELECT query_id, country, round(p, 6) AS p FROM posterior", "posterior")
def a6(t):
    return _round(R.country_posterior(t.scores, C.country_dist(t.label_long)), "p")


@query("l4_topk_countries", """
SELECT query_id, country, rank FROM (
  SELECT query_id, country, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, country) AS rank FROM posterior)
WHERE rank <= 3""", "posterior")
def l4(t):
    post = R.country_posterior(t.scores, C.country_dist(t.label_long)).withColumn("p", F.round("p", 9))
    return R.topk_countries(post, 3).select("query_id", "country", "rank")


@query("a13_parent_mass", """
SELECT query_id, parent_idx, round(sum(prob), 6) AS mass FROM probs p JOIN pmap m
ON m.child_level = 9 AND m.parent_level = 6 AND m.child_idx = p.idx WHERE p.level = 9 AND parent_idx >= 0
GROUP BY query_id, parent_idx""", "probs pmap")
def a13(t):
    return _round(R.parent_mass(t.scores, t.pmap), "mass")


_JOINT = """
joint AS (SELECT p.query_id, p.idx, t.l9, t.l6, t.l3,
                 p.logp + coalesce(a9.logp, -1e9) + coalesce(a6.logp, -1e9) + coalesce(a3.logp, -1e9) AS j
          FROM probs p JOIN tree t ON p.level = 12 AND p.idx = t.l12
          LEFT JOIN probs a9 ON a9.query_id = p.query_id AND a9.level = 9 AND a9.idx = t.l9
          LEFT JOIN probs a6 ON a6.query_id = p.query_id AND a6.level = 6 AND a6.idx = t.l6
          LEFT JOIN probs a3 ON a3.query_id = p.query_id AND a3.level = 3 AND a3.idx = t.l3),
spots AS (SELECT query_id, 12 AS level, idx, j FROM joint UNION ALL SELECT query_id, 9, l9, j FROM joint
          UNION ALL SELECT query_id, 6, l6, j FROM joint UNION ALL SELECT query_id, 3, l3, j FROM joint),
rolled AS (SELECT query_id, level, idx, max(m) + ln(greatest(sum(exp(j - m)), 1e-30)) AS logit
           FROM (SELECT *, max(j) OVER (PARTITION BY query_id, level, idx) AS m FROM spots WHERE idx >= 0)
           GROUP BY query_id, level, idx)"""


@query("a14_logsumexp_rollup", """
SELECT query_id, parent_idx, round(max(m) + ln(greatest(sum(exp(logp - m)), 1e-30)), 6) AS lse FROM (
  SELECT p.query_id, m.parent_idx, p.logp, max(p.logp) OVER (PARTITION BY p.query_id, m.parent_idx) AS m
  FROM probs p JOIN pmap m ON m.child_level = 12 AND m.parent_level = 9 AND m.child_idx = p.idx
  WHERE p.level = 12 AND m.parent_idx >= 0) GROUP BY query_id, parent_idx""", "probs pmap")
def a14(t):
    leaf = R.softmax(t.scores.where("level = 12")).join(R._pmap(t.pmap, 12, 9), "idx").where("parent_idx >= 0")
    return _round(R.logsumexp_by(leaf, ["query_id", "parent_idx"], "logp", "lse"), "lse")


@query("r7_joint_rerank", f"WITH {_JOINT} SELECT query_id, level, idx, round(logit, 5) AS logit FROM rolled WHERE logit > -1e8",
       "probs tree")
def r7(t):
    out = R.joint_rerank(t.scores, t.pmap).where("logit > -1e8")
    return out.withColumn("logit", F.round("logit", 5))


def _kept(allowed: str, levels: str) -> str:
    """Score rows after a mask: ``allowed`` selects (query_id, level, idx), a small set, built first."""
    return f"""
ok AS MATERIALIZED (SELECT DISTINCT query_id, level, idx FROM ({allowed})),
hits AS MATERIALIZED (SELECT DISTINCT s.query_id, s.level FROM scores s JOIN ok o USING (query_id, level, idx)),
masked AS (SELECT s.query_id, s.level, s.idx, s.logit FROM scores s LEFT JOIN hits m USING (query_id, level) LEFT JOIN ok o USING (query_id, level, idx)
           WHERE s.level IN ({levels}) AND (m.query_id IS NULL OR o.query_id IS NOT NULL))"""


_BY9 = "par AS MATERIALIZED (SELECT query_id, idx FROM probs WHERE level = 9 AND rnk <= 3),\n" \
       "kid AS MATERIALIZED (SELECT parent_idx, child_idx FROM pmap WHERE child_level = 12 AND parent_level = 9),\n" \
       + _kept("SELECT query_id, 12 AS level, child_idx AS idx FROM par JOIN kid ON parent_idx = idx", "12")


@query("r4_mask_by_parent", f"""WITH {_BY9}
SELECT query_id, level, idx, logit FROM masked UNION ALL SELECT query_id, level, idx, logit FROM scores WHERE level <> 12""",
       "probs pmap scores")
def r4(t):
    return R.mask_by_parent(t.scores, t.pmap, 9, (12,), 3)


_MASS = f"""
kid AS MATERIALIZED (SELECT parent_idx, child_level AS level, child_idx AS idx FROM pmap WHERE parent_level = 6 AND child_level IN (9, 12)),
p9 AS MATERIALIZED (SELECT query_id, idx, prob FROM probs WHERE level = 9),
mass AS MATERIALIZED (SELECT query_id, parent_idx, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(prob), 9) DESC, parent_idx) AS rn
         FROM p9 JOIN kid ON kid.level = 9 AND kid.idx = p9.idx WHERE parent_idx >= 0 GROUP BY query_id, parent_idx),
{_kept('SELECT query_id, level, idx FROM mass JOIN kid USING (parent_idx) WHERE rn <= 2', '9, 12')}"""


@query("r5_mask_by_child_mass", f"""WITH {_MASS}
SELECT query_id, level, idx, logit FROM masked UNION ALL SELECT query_id, level, idx, logit FROM scores WHERE level IN (3, 6)""",
       "probs pmap scores")
def r5(t):
    return R.mask_by_child_mass(t.scores, t.pmap, 2)


def _step(source: str, name: str, parents: str, parent: int, children: str) -> str:
    """CTEs ``name``: ``source`` after the mask of ``children`` by ``parents`` (query_id, idx)."""
    return f"""
{name}_ok AS (SELECT DISTINCT p.query_id, m.child_level AS level, m.child_idx AS idx FROM ({parents}) p JOIN pmap m
              ON m.parent_level = {parent} AND m.child_level IN ({children}) AND m.parent_idx = p.idx),
{name}_marked AS (SELECT s.*, s.level NOT IN ({children}) OR o.query_id IS NOT NULL AS keep FROM {source} s LEFT JOIN {name}_ok o USING (query_id, level, idx)),
{name} AS MATERIALIZED (SELECT query_id, level, idx, logit FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id, level) AS kept_any FROM {name}_marked)
           WHERE keep OR NOT kept_any)"""


def _best(source: str, level: int, k: int) -> str:
    return f"""SELECT query_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY logit DESC, idx) AS rn
               FROM {source} WHERE level = {level}) WHERE rn <= {k}"""


CASCADE = f"""{_step('scores', 'm3', _best('scores', 3, 2), 3, '6, 9, 12')},
m3p AS (SELECT query_id, idx, exp(logit - max(logit) OVER w) AS e FROM m3 WHERE level = 9 WINDOW w AS (PARTITION BY query_id)),
m3s AS (SELECT query_id, idx, e / sum(e) OVER (PARTITION BY query_id) AS prob FROM m3p),
heavy AS (SELECT query_id, parent_idx AS idx, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(prob), 9) DESC, parent_idx) AS rn
          FROM m3s JOIN pmap ON child_level = 9 AND parent_level = 6 AND child_idx = idx WHERE parent_idx >= 0 GROUP BY query_id, parent_idx),
{_step('m3', 'm6', 'SELECT query_id, idx FROM heavy WHERE rn <= 2', 6, '9, 12')},
top9 AS MATERIALIZED ({_best('m6', 9, 1)}),
flags AS (SELECT query_id, NOT bool_or(EXISTS (SELECT 1 FROM pmap WHERE parent_level = 9 AND child_level = 12 AND parent_idx = top9.idx)) AS l12_unconstrained
          FROM top9 GROUP BY query_id),
{_step('m6', 'm9', 'SELECT query_id, idx FROM top9', 9, '12')}"""


@query("r4_cascade", f"WITH {CASCADE} SELECT query_id, level, idx, logit, l12_unconstrained FROM m9 JOIN flags USING (query_id)", "scores pmap")
def r4_cascade(t):
    masked, flags = R.cascade(t.scores, t.pmap, 2, 2, 1)
    return masked.join(flags, "query_id").select("query_id", "level", "idx", "logit", "l12_unconstrained")


_COUNTRY = f"""
top AS (SELECT query_id, country FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(p, 9) DESC, country) AS rn FROM posterior) WHERE rn <= 2),
{_kept('''SELECT DISTINCT t.query_id, 9 AS level, d.idx FROM top t JOIN country_dist d ON d.country = t.country AND d.level = 9 WHERE d.p >= 0.3
          UNION SELECT query_id, level, idx FROM scores WHERE level = 9 AND idx NOT IN (SELECT idx FROM country_dist WHERE level = 9)''', '9')}"""


@query("r6_mask_by_country", f"WITH {_COUNTRY} SELECT query_id, level, idx, logit FROM masked", "posterior country_dist scores")
def r6(t):
    dist = C.country_dist(t.label_long)
    top = R.topk_countries(R.country_posterior(t.scores, dist).withColumn("p", F.round("p", 9)), 2)
    return R.mask_by_country(t.scores, dist, top, 9).select("query_id", "level", "idx", "logit")


@query("r9_debias_rerank", """
SELECT query_id, level, idx, rank FROM (
  SELECT query_id, level, idx, row_number() OVER (PARTITION BY query_id, level ORDER BY round(logit - 0.5 * ln(n), 9) DESC, idx) AS rank
  FROM scores JOIN cells USING (level, idx)) WHERE rank <= 3""", "scores cells")
def r9(t):
    out = R.debias_rerank(t.scores, t.cells, 0.5).withColumn("logit", F.round("logit", 9))
    return R.ranked(out, 3).drop("logit")


@query("a18_expected_location", f"""
WITH c AS (SELECT query_id, level, rnk, prob, centroid_lat AS lat, centroid_lng AS lng FROM probs JOIN cells USING (level, idx) WHERE rnk <= 5),
a AS (SELECT c.*, f.lat AS alat, f.lng AS alng FROM c JOIN c f ON f.query_id = c.query_id AND f.level = c.level AND f.rnk = 1)
SELECT query_id, level, round(sum(prob * lat) / sum(prob), 6) AS lat, round(sum(prob * lng) / sum(prob), 6) AS lng
FROM a WHERE {hav('alat', 'alng', 'lat', 'lng')} <= 4000 GROUP BY query_id, level""", "probs cells")
def a18(t):
    return _round(R.expected_location(R.topk_candidates(t.scores, 5, t.cells), 5, 4000.0), "lat", "lng")


@query("a19_tta_mean", """
SELECT query_id, level, idx, round(avg(logit + shift * (idx % 3)), 6) AS logit
FROM scores CROSS JOIN range(4) AS s(shift) GROUP BY query_id, level, idx""", "scores")
def a19(t):
    shifts = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shift")
    views = t.scores.select("*", shifts).withColumn("logit", F.col("logit") + F.col("shift") * (F.col("idx") % 3))
    return _round(R.tta_mean(views), "logit")


_D = hav("l.lat", "l.lng", "c.centroid_lat", "c.centroid_lng")
_SIGMA = "CASE s.level WHEN 3 THEN 2000.0 WHEN 6 THEN 500.0 WHEN 9 THEN 100.0 ELSE 20.0 END"
_TARGETS = f"""
targets AS (SELECT query_id, level, idx, exp(lw - mx) / sum(exp(lw - mx)) OVER (PARTITION BY query_id, level) AS q FROM (
  SELECT *, max(lw) OVER (PARTITION BY query_id, level) AS mx FROM (
    SELECT s.query_id, s.level, s.idx, -pow({_D}, 2) / (2 * pow({_SIGMA}, 2)) AS lw
    FROM scores s JOIN cells c USING (level, idx) JOIN vectors l ON l.vec_id = s.query_id)))"""
_CE = f"""{_TARGETS},
ce AS (SELECT t.query_id, t.level, -sum(t.q * p.logp) AS ce FROM targets t JOIN probs p USING (query_id, level, idx)
       JOIN label_long l ON l.query_id = t.query_id AND l.level = t.level AND l.idx >= 0 GROUP BY t.query_id, t.level)"""


@query("a20_soft_targets", f"WITH {_TARGETS} SELECT query_id, level, idx, round(q, 6) AS q FROM targets", "scores cells vectors")
def a20(t):
    truth = t.vectors.select(F.col("vec_id").alias("query_id"), "lat", "lng")
    return _round(R.soft_targets(t.scores.drop("logit"), truth, t.cells), "q")


_DV = hav("v.lat", "v.lng", "c.centroid_lat", "c.centroid_lng")


@query("j13_target_pairs", f"""
SELECT v.vec_id, c.idx, round({_DV}, 6) AS distance_km FROM vectors v JOIN cells c ON c.level = 9 WHERE {_DV} <= 4500""", "vectors cells")
def j13(t):
    cells = t.cells.where("level = 9").select("idx", "centroid_lat", "centroid_lng")
    out = R.target_pairs(t.vectors.select("vec_id", "lat", "lng"), cells, 4500.0)
    return _round(out.select("vec_id", "idx", "distance_km"), "distance_km")


@query("a21_soft_ce", f"""WITH {_CE}
SELECT level, round(avg(ce), 6) AS ce, count(*) AS n, round(avg(ce) * CASE level WHEN 12 THEN 0.5 ELSE 1 END, 6) AS weighted FROM ce GROUP BY level
""", "scores cells vectors probs label_long")
def a21(t):
    return _round(R.soft_ce(t.scores, t.label_long, t.cells, {12: 0.5}), "ce", "weighted")


_MODAL = """
modal AS (SELECT level, idx, arg_min(country, rn) AS country FROM (
  SELECT level, idx, country, row_number() OVER (PARTITION BY level, idx ORDER BY count(*) DESC, country) AS rn
  FROM label_long WHERE idx >= 0 GROUP BY level, idx, country) GROUP BY level, idx)"""


@query("a22_border_penalty", f"""WITH {_CE}, {_MODAL}
SELECT c.level, round(avg(ce * CASE WHEN m.country <> l.country THEN 1.5 ELSE 1 END), 6) AS ce
FROM ce c JOIN probs p ON p.query_id = c.query_id AND p.level = c.level AND p.rnk = 1
JOIN label_long l ON l.query_id = c.query_id AND l.level = c.level
LEFT JOIN modal m ON m.level = p.level AND m.idx = p.idx GROUP BY c.level""", "scores cells vectors probs label_long")
def a22(t):
    counts = t.label_long.where("idx >= 0").groupBy("level", "idx", "country").agg(F.count(F.lit(1)).alias("n"))
    modal = counts.groupBy("level", "idx").agg(F.min(F.struct((-F.col("n")).alias("x"), "country")).alias("b")) \
                  .select("level", "idx", "b.country")
    rows = R.border_penalty(R.soft_ce_rows(t.scores, t.label_long, t.cells), t.scores, modal, t.label_long, 0.5)
    return _round(R.soft_ce(t.scores, t.label_long, t.cells, rows=rows).select("level", "ce"), "ce")


@query("a23_country_ce", """
WITH s AS (SELECT query_id, idx, ln(exp(logit) / sum(exp(logit)) OVER (PARTITION BY query_id)) AS logp FROM scores WHERE level = 6)
SELECT round(avg(-logp), 6) AS ce, count(*) AS n
FROM s JOIN (SELECT vec_id AS query_id, CASE WHEN vec_id % 9 = 0 THEN -1 ELSE cast(substr(country, 2) AS bigint) END AS idx FROM vectors) l
USING (query_id, idx)
""", "scores vectors")
def a23(t):
    """The level-6 table stands for a country head; every ninth query has no known country."""
    known = F.when(F.col("vec_id") % 9 == 0, -1).otherwise(F.substring("country", 2, 9).cast("long"))
    labels = t.vectors.select(F.col("vec_id").alias("query_id"), known.alias("idx"))
    return _round(R.country_ce(t.scores.where("level = 6").drop("level"), labels), "ce")
