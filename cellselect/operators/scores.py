"""Score tables (query_id, level, idx, logit): softmax, top-K, masks, roll-ups, losses.

A masked candidate is a row that is gone; a mask that would empty a (query, level) is not applied.
A (query, level) group holds one row per vocabulary cell, so windows over it are bounded by the
vocabulary, never by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.functions import geo
from cellselect.operators.spatial import pairs_within

QL = ("query_id", "level")


def softmax(scores: DataFrame, by: Sequence[str] = QL, value: str = "logit") -> DataFrame:
    """Add ``prob`` and ``logp``: stable softmax per group, one exchange for both windows."""
    w = Window.partitionBy(*by)
    out = scores.withColumn("_x", F.col(value) - F.max(value).over(w))
    out = out.withColumn("_z", F.sum(F.exp("_x")).over(w))
    return (out.withColumn("prob", F.exp("_x") / F.col("_z")).withColumn("logp", F.col("_x") - F.log("_z"))
            .drop("_x", "_z"))


def ranked(scores: DataFrame, k: int | None = None, by: Sequence[str] = QL, value: str = "logit",
           tie: str = "idx", name: str = "rank") -> DataFrame:
    """Rank by value, ties to the smaller index; with ``k`` only the first k stay (tasks keep their
    own k before the exchange)."""
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    out = scores.withColumn(name, F.row_number().over(w).cast("long"))
    return out if k is None else out.where(F.col(name) <= k)


def topk_candidates(scores: DataFrame, k: int, cells: DataFrame) -> DataFrame:
    """Top-K per (query, level) with probability and centroid."""
    top = ranked(softmax(scores).drop("logp"), k)  # all three windows share one exchange
    return top.join(cells.select("level", "idx", "centroid_lat", "centroid_lng"), ["level", "idx"], "left")


def argmax_centroid(scores: DataFrame, cells: DataFrame) -> DataFrame:
    """Best cell per (query, level) and its centroid; an aggregate, no sort."""
    best = scores.groupBy(*QL).agg(F.min(F.struct((-F.col("logit")).alias("n"), F.col("idx"))).alias("_b"))
    return (best.select(*QL, F.col("_b.idx").alias("idx"))
            .join(cells.select("level", "idx", "centroid_lat", "centroid_lng"), ["level", "idx"]))


# --- country signal ---------------------------------------------------------------------------

def country_posterior(scores: DataFrame, dist: DataFrame, level: int = 6) -> DataFrame:
    """Sum over cells of softmax probability times P(country | cell)."""
    p = softmax(scores.where(F.col("level") == level)).select("query_id", "idx", "prob")
    d = dist.where(F.col("level") == level).select("idx", "country", "p")
    return p.join(d, "idx").groupBy("query_id", "country").agg(F.sum(F.col("prob") * F.col("p")).alias("p"))


def topk_countries(posterior: DataFrame, k: int) -> DataFrame:
    return ranked(posterior, k, ["query_id"], "p", "country")


def mask_by_country(scores: DataFrame, dist: DataFrame, top: DataFrame, level: int, threshold: float = 0.30) -> DataFrame:
    """Keep cells whose largest share on any top country reaches the threshold, or without data.

    The kept (query, cell) pairs come out of an equi-join on country; cells without data are an
    anti-join, so no query × cell product is built.
    """
    d = dist.where(F.col("level") == level)
    mine = scores.where(F.col("level") == level)
    if threshold <= 0:
        return mine
    good = (top.select("query_id", "country")
            .join(d.where(F.col("p") >= threshold).select("idx", "country"), "country")
            .select("query_id", "idx").distinct().withColumn("_ok", F.lit(True)))
    data = d.select("idx").distinct().withColumn("_data", F.lit(True))
    kept = (mine.join(data, "idx", "left").join(good, ["query_id", "idx"], "left")
            .withColumn("_keep", F.col("_data").isNull() | F.coalesce("_ok", F.lit(False))))
    return _guarded(kept).drop("_data", "_ok")


def _guarded(marked: DataFrame) -> DataFrame:
    """Rows with ``_keep``; all rows of a (query, level) where none has it."""
    any_kept = F.max("_keep").over(Window.partitionBy(*QL))
    return marked.withColumn("_any", any_kept).where(F.col("_keep") | ~F.col("_any")).drop("_keep", "_any")


# --- hierarchy --------------------------------------------------------------------------------

def _pmap(pmap: DataFrame, child: int, parent: int, idx: str = "idx", name: str = "parent_idx") -> DataFrame:
    rows = pmap.where((F.col("child_level") == child) & (F.col("parent_level") == parent))
    return rows.select(F.col("child_idx").alias(idx), F.col("parent_idx").alias(name))


def parent_mass(scores: DataFrame, pmap: DataFrame, child: int = 9, parent: int = 6) -> DataFrame:
    """Probability of a parent as the sum over its children; the pruned bucket is dropped."""
    p = softmax(scores.where(F.col("level") == child)).select("query_id", "idx", "prob")
    return (p.join(_pmap(pmap, child, parent), "idx").where(F.col("parent_idx") >= 0)
            .groupBy("query_id", "parent_idx").agg(F.sum("prob").alias("mass")))


def mask_by_parent(scores: DataFrame, pmap: DataFrame, parent: int, children: Sequence[int], k: int,
                   parents: DataFrame | None = None) -> DataFrame:
    """Keep children of the top-K parents (or of the given (query_id, parent_idx) rows)."""
    if parents is None:
        parents = ranked(scores.where(F.col("level") == parent), k).select("query_id", F.col("idx").alias("parent_idx"))
    parents = parents.select("query_id", "parent_idx").withColumn("_ok", F.lit(True))
    links = (pmap.where((F.col("parent_level") == parent) & F.col("child_level").isin(*children))
             .select(F.col("child_level").alias("level"), F.col("child_idx").alias("idx"), "parent_idx"))
    kids = scores.where(F.col("level").isin(*children))
    marked = (kids.join(links, ["level", "idx"], "left").join(parents, ["query_id", "parent_idx"], "left")
              .withColumn("_keep", F.coalesce("_ok", F.lit(False))).drop("parent_idx", "_ok"))
    return scores.where(~F.col("level").isin(*children)).unionByName(_guarded(marked).select(*scores.columns))


def mask_by_child_mass(scores: DataFrame, pmap: DataFrame, k: int = 5, digits: int = 9) -> DataFrame:
    """Rank level-6 parents by level-9 child mass, then mask levels 9 and 12. Masses equal to ``digits``
    places go by index, whatever order their sums were taken in."""
    mass = parent_mass(scores, pmap).withColumn("mass", F.round("mass", digits))
    top = ranked(mass, k, ["query_id"], "mass", "parent_idx")
    return mask_by_parent(scores, pmap, 6, (9, 12), k, parents=top)


def unconstrained(top: DataFrame, pmap: DataFrame, level: int = 9, leaf: int = 12) -> DataFrame:
    """(query_id, l12_unconstrained): none of a query's cells (query_id, idx) has a child in the leaf
    vocabulary, so its leaf ranking is not held by the level above."""
    links = pmap.where((F.col("parent_level") == level) & (F.col("child_level") == leaf))
    parents = links.select(F.col("parent_idx").alias("idx"), F.lit(True).alias("_has")).distinct()
    return (top.join(parents, "idx", "left").groupBy("query_id")
            .agg((~F.max(F.coalesce("_has", F.lit(False)))).alias("l12_unconstrained")))


def cascade(scores: DataFrame, pmap: DataFrame, k3: int = 3, k6: int = 5, k9: int = 10) -> tuple[DataFrame, DataFrame]:
    """Hierarchical constraint: (masked scores, (query_id, l12_unconstrained)).

    The best ``k3`` level-3 cells hold levels 6, 9 and 12; of what is left, the ``k6`` level-6 cells
    with the most level-9 mass hold 9 and 12; the best ``k9`` level-9 cells hold 12. A step with 0 is
    left out. A mask that would empty a level is not applied.
    """
    out = scores
    if k3:
        out = mask_by_parent(out, pmap, 3, (6, 9, 12), k3)
    if k6:
        out = mask_by_child_mass(out, pmap, k6)
    if not k9:
        return out, scores.select("query_id").distinct().withColumn("l12_unconstrained", F.lit(False))
    top = ranked(out.where(F.col("level") == 9), k9).select("query_id", "idx")
    flags = unconstrained(top, pmap)
    return mask_by_parent(out, pmap, 9, (12,), k9, parents=top.withColumnRenamed("idx", "parent_idx")), flags


def logsumexp_by(rows: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """log of the sum of exponentials per group, shifted by the group maximum."""
    w = Window.partitionBy(*by)
    return (rows.withColumn("_m", F.max(value).over(w)).groupBy(*by)
            .agg(F.max("_m").alias("_m"), F.sum(F.exp(F.col(value) - F.col("_m"))).alias("_s"))
            .select(*by, (F.col("_m") + F.log(F.greatest("_s", F.lit(1e-30)))).alias(name)))


def joint_rerank(scores: DataFrame, pmap: DataFrame, leaf: int = 12, ancestors: Sequence[int] = (9, 6, 3)) -> DataFrame:
    """Joint log-probability of leaves (own plus all ancestors', a pruned ancestor counts -1e9),
    rolled up to every level by log-sum-exp. Same columns as the input."""
    logp = softmax(scores).select("query_id", "level", "idx", "logp")
    joint = logp.where(F.col("level") == leaf).select("query_id", "idx", F.col("logp").alias("joint"))
    for lvl in ancestors:
        up = logp.where(F.col("level") == lvl).select("query_id", F.col("idx").alias(f"a{lvl}"), F.col("logp").alias("_up"))
        joint = (joint.join(_pmap(pmap, leaf, lvl, name=f"a{lvl}"), "idx")
                 .join(up, ["query_id", f"a{lvl}"], "left")
                 .withColumn("joint", F.col("joint") + F.coalesce("_up", F.lit(-1e9))).drop("_up"))
    spots = F.array(F.struct(F.lit(leaf).alias("level"), F.col("idx").alias("at")),
                    *[F.struct(F.lit(n).alias("level"), F.col(f"a{n}").alias("at")) for n in ancestors])
    rows = (joint.select("query_id", "joint", F.explode(spots).alias("s"))
            .select("query_id", "s.level", F.col("s.at").alias("idx"), "joint").where(F.col("idx") >= 0))
    return logsumexp_by(rows, ["query_id", "level", "idx"], "joint", "logit")


def debias_rerank(scores: DataFrame, cells: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Logit minus alpha times the log of the cell's count."""
    return (scores.join(cells.select("level", "idx", "n"), ["level", "idx"])
            .withColumn("logit", F.col("logit") - F.lit(alpha) * F.log("n")).drop("n").select(*scores.columns))


# --- averages ---------------------------------------------------------------------------------

def expected_location(cands: DataFrame, k: int, span_km: float = 50.0) -> DataFrame:
    """Probability-weighted mean of the top-K centroids near the first one, per (query, level)."""
    c = F.struct("rank", "prob", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    g = cands.where(F.col("rank") <= k).groupBy(*QL).agg(F.sort_array(F.collect_list(c)).alias("c"))
    g = g.withColumn("a", F.element_at("c", 1))
    near = F.filter("c", lambda x: geo.haversine_km(F.col("a.lat"), F.col("a.lng"), x["lat"], x["lng"]) <= span_km)
    g = g.withColumn("near", near)

    def weigh(field: str | None) -> Column:
        return F.aggregate("near", F.lit(0.0), lambda s, x: s + (x["prob"] * x[field] if field else x["prob"]))

    g = g.withColumn("w", weigh(None))
    return g.select(*QL, F.when(F.col("w") > 0, weigh("lat") / F.col("w")).otherwise(F.col("a.lat")).alias("lat"),
                    F.when(F.col("w") > 0, weigh("lng") / F.col("w")).otherwise(F.col("a.lng")).alias("lng"))


def tta_mean(scores: DataFrame) -> DataFrame:
    """Mean logit over view shifts."""
    return scores.groupBy("query_id", "level", "idx").agg(F.avg("logit").alias("logit"))


# --- training signals -------------------------------------------------------------------------

def sigma_of(level: Column, sigmas: dict[int, float] | None = None) -> Column:
    out = F.lit(None).cast("double")
    for lvl, s in (sigmas or K.SIGMA_KM).items():
        out = F.when(level == lvl, float(s)).otherwise(out)
    return out


def target_pairs(samples: DataFrame, cells: DataFrame, radius_km: float, **kw) -> DataFrame:
    """Sample × centroid rows within a radius with their distance (tile join)."""
    return pairs_within(samples, cells, radius_km, **kw)


def soft_targets(rows: DataFrame, truth: DataFrame, cells: DataFrame, sigmas: dict[int, float] | None = None) -> DataFrame:
    """Target weight per (query, level, idx) row: exp(-d²/2σ²) normalised per (query, level).

    The score rows already span query × vocabulary, so centroids and truth join by key; nothing is
    multiplied out.
    """
    near = (rows.join(cells.select("level", "idx", "centroid_lat", "centroid_lng"), ["level", "idx"])
            .join(truth.select("query_id", "lat", "lng"), "query_id"))
    d = geo.haversine_km("lat", "lng", "centroid_lat", "centroid_lng")
    s = sigma_of(F.col("level"), sigmas)
    near = near.withColumn("_lw", -(d * d) / (2 * s * s)).drop("centroid_lat", "centroid_lng", "lat", "lng")
    return softmax(near, value="_lw").withColumnRenamed("prob", "q").drop("_lw", "logp")


def soft_ce_rows(scores: DataFrame, labels: DataFrame, cells: DataFrame, sigmas: dict[int, float] | None = None) -> DataFrame:
    """Cross-entropy against soft targets per (query, level); pruned labels are left out."""
    known = labels.where(F.col("idx") >= 0).select("query_id", "level", F.col("idx").alias("label_idx"))
    truth = labels.groupBy("query_id").agg(F.first("lat").alias("lat"), F.first("lng").alias("lng"))
    rows = softmax(scores.join(known.select("query_id", "level"), list(QL), "left_semi")).drop("prob")
    t = soft_targets(rows.withColumnRenamed("logp", "_logp"), truth, cells, sigmas)
    return t.groupBy(*QL).agg((-F.sum(F.col("q") * F.col("_logp"))).alias("ce"))


def soft_ce(scores: DataFrame, labels: DataFrame, cells: DataFrame, weights: dict[int, float] | None = None,
            sigmas: dict[int, float] | None = None, rows: DataFrame | None = None) -> DataFrame:
    """Mean loss per level with its level weight."""
    rows = soft_ce_rows(scores, labels, cells, sigmas) if rows is None else rows
    w = F.lit(1.0)
    for lvl, x in (weights or {}).items():
        w = F.when(F.col("level") == lvl, float(x)).otherwise(w)
    return (rows.groupBy("level").agg(F.avg("ce").alias("ce"), F.count(F.lit(1)).alias("n"))
            .withColumn("weighted", w * F.col("ce")))


def border_penalty(rows: DataFrame, scores: DataFrame, modal: DataFrame, labels: DataFrame, lam: float) -> DataFrame:
    """Multiply a row's loss by 1 + λ where the best cell's country is known and not the truth's."""
    best = scores.groupBy(*QL).agg(F.min(F.struct((-F.col("logit")).alias("n"), F.col("idx"))).alias("_b"))
    pred = (best.select(*QL, F.col("_b.idx").alias("idx"))
            .join(modal.select("level", "idx", F.col("country").alias("_pc")), ["level", "idx"], "left"))
    true = labels.select("query_id", "level", F.col("country").alias("_tc"))
    wrong = F.coalesce(F.col("_pc") != F.col("_tc"), F.lit(False))
    return (rows.join(pred.drop("idx"), list(QL)).join(true, list(QL))
            .withColumn("ce", F.col("ce") * F.when(wrong, 1.0 + lam).otherwise(1.0)).drop("_pc", "_tc"))


def country_ce(country_scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean cross-entropy of the country head over rows with a known label."""
    logp = softmax(country_scores, ["query_id"]).select("query_id", "idx", "logp")
    return (logp.join(labels.where(F.col("idx") >= 0).select("query_id", "idx"), ["query_id", "idx"])
            .agg(F.avg(-F.col("logp")).alias("ce"), F.count(F.lit(1)).alias("n")))
