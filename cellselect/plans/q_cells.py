"""Cell statistics, vocabularies, labels and country distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellselect.functions import geo
from cellselect.operators import cells as C
from cellselect.plans.registry import query


def _text():
    return geo.s2_text(F.col("cell")).alias("cell")


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query("a1_cell_stats", """
SELECT level, cell, n, round(centroid_lat, 6) AS centroid_lat, round(centroid_lng, 6) AS centroid_lng FROM cell_stats
""", "cell_stats")
def a1(t):
    s = C.cell_stats(t.s2_samples)
    return s.select("level", _text(), "n", _r("centroid_lat"), _r("centroid_lng"))


@query("a2_cell_vocab", """
SELECT level, cell, idx, n, round(centroid_lat, 6) AS centroid_lat, round(centroid_lng, 6) AS centroid_lng FROM vocab
""", "vocab")
def a2(t):
    return t.vocab.select("level", F.col("cell_text").alias("cell"), "idx", "n", _r("centroid_lat"), _r("centroid_lng"))


@query("a3_country_vocab", "SELECT code, idx FROM countries", "countries")
def a3(t):
    return t.countries


@query("a4_modal_country", """
SELECT level, cell, country_code, n FROM (
  SELECT level, cell, country_code, count(*) AS n,
         row_number() OVER (PARTITION BY level, cell ORDER BY count(*) DESC, country_code) AS rn
  FROM long_cells WHERE split = 'train' AND country_code IS NOT NULL GROUP BY level, cell, country_code)
WHERE rn = 1""", "long_cells")
def a4(t):
    return C.modal_country(t.s2_samples).withColumn("cell", _text())


@query("a5_country_dist", "SELECT level, idx, country, round(p, 6) AS p FROM country_dist", "country_dist")
def a5(t):
    return C.country_dist(t.label_long).withColumn("p", F.round("p", 6))


@query("a11_mapped_report", """
SELECT v.level, count(m.cell) AS mapped, count(*) AS cells
FROM vocab v LEFT JOIN (SELECT DISTINCT level, cell FROM long_cells WHERE split = 'train' AND country_code IS NOT NULL) m USING (level, cell)
GROUP BY v.level""", "vocab long_cells")
def a11(t):
    return C.mapped_report(t.vocab, C.modal_country(t.s2_samples))


@query("f7_known_labels", """
SELECT l.sample_key, l.level, v.idx FROM long_cells l JOIN vocab v USING (level, cell)""", "long_cells vocab")
def f7(t):
    return C.known_labels(C.label_cells(t.s2_samples, t.vocab, "sample_key"))


@query("f8_prune_cells", """
SELECT level, cell, n FROM cell_stats WHERE n >= CASE level WHEN 9 THEN 2 WHEN 12 THEN 5 ELSE 1 END""", "cell_stats")
def f8(t):
    return C.prune_cells(C.cell_stats(t.s2_samples)).select("level", _text(), "n")


@query("j8_label_cells", """
SELECT l.sample_key, l.level, coalesce(v.idx, -1) AS idx FROM long_cells l LEFT JOIN vocab v USING (level, cell)
""", "long_cells vocab")
def j8(t):
    return C.label_cells(t.s2_samples, t.vocab, "sample_key")


@query("j9_parent_map", """
SELECT 12 AS child_level, c.idx AS child_idx, 9 AS parent_level, coalesce(p.idx, -1) AS parent_idx
FROM vocab c JOIN (SELECT DISTINCT s2_l12, s2_l9 FROM s2_samples) h ON c.level = 12 AND c.cell = h.s2_l12
LEFT JOIN vocab p ON p.level = 9 AND p.cell = h.s2_l9
UNION ALL
SELECT 9, c.idx, 6, coalesce(p.idx, -1)
FROM vocab c JOIN (SELECT DISTINCT s2_l9, s2_l6 FROM s2_samples) h ON c.level = 9 AND c.cell = h.s2_l9
LEFT JOIN vocab p ON p.level = 6 AND p.cell = h.s2_l6""", "vocab s2_samples")
def j9(t):
    return C.parent_map(t.vocab, 12, 9).unionByName(C.parent_map(t.vocab, 9, 6))


@query("l3_first_per_cell", """
SELECT cell, country_code FROM (
  SELECT cell, country_code, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, country_code) AS rn
  FROM long_cells WHERE split = 'train' AND level = 9 AND country_code IS NOT NULL GROUP BY cell, country_code)
WHERE rn = 1""", "long_cells")
def l3(t):
    return C.modal_country(t.s2_samples, levels=[9]).select(_text(), "country_code")


@query("u2_union_levels", """
SELECT level, count(*) AS cells, cast(sum(n) AS bigint) AS rows FROM cell_stats GROUP BY level""", "cell_stats")
def u2(t):
    parts = [C.cell_stats(t.s2_samples, levels=[n]) for n in (3, 6, 9, 12)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"))


_OLD = """
old AS (SELECT level, cell, n FROM (SELECT level, cell, count(*) AS n FROM long_cells GROUP BY level, cell)
        WHERE n >= CASE level WHEN 9 THEN 2 WHEN 12 THEN 5 ELSE 1 END)"""


@query("j15_vocab_remap", f"""WITH {_OLD}
SELECT v.level, v.cell, v.idx, o.cell IS NOT NULL AND v.idx % 7 <> 0 AS copied,
       cast(CASE WHEN o.cell IS NOT NULL AND v.idx % 7 <> 0 THEN o.n ELSE -1 END AS bigint) AS first_value
FROM vocab v LEFT JOIN (SELECT * FROM old WHERE n > 3) o USING (level, cell)""", "vocab long_cells")
def j15(t):
    """Old payloads come from the vocabulary of all splits; a length mismatch keeps the fresh one."""
    old = (C.prune_cells(C.cell_stats(t.s2_samples, split=None)).where("n > 3")
           .withColumn("vec", F.array(F.col("n"), F.lit(1).cast("long"))))
    fresh = F.when(F.col("idx") % 7 == 0, F.array(F.lit(-1).cast("long"))).otherwise(
        F.array(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    out = C.remap_vocab(t.vocab.select("level", "cell", "idx"), old, fresh)
    return out.select("level", _text(), "idx", "copied", F.element_at("vec", 1).alias("first_value"))
