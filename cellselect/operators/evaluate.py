"""Evaluation and diagnostics as batch jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.functions import geo
from cellselect.operators import scores as R
from cellselect.operators.scale import bracketed_percentiles, exact_percentiles
from cellselect.session import shared_dir


def within_name(km: float) -> str:
    return f"within_{km:g}km".replace(".", "_")


def within_cols(value: str, thresholds: Sequence[float] = K.WITHIN_KM) -> list[Column]:
    """Shares strictly below each threshold."""
    return [F.avg((F.col(value) < t).cast("double")).alias(within_name(t)) for t in thresholds]


def distance_summary(df: DataFrame, by: Sequence[str] = (), value: str = "distance_km",
                     thresholds: Sequence[float] = K.WITHIN_KM) -> DataFrame:
    """n, mean, exact p10 / median / p90 and shares within thresholds, per group or overall. No rows
    in, no row out."""
    by = list(by)
    base = df.where(F.col(value).isNotNull())
    plain = base.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_km"), *within_cols(value, thresholds))
    cuts = exact_percentiles(base, value, {"p10_km": 0.1, "median_km": 0.5, "p90_km": 0.9}, by)
    if by:
        return plain.join(cuts, by)
    key = F.lit(1).alias("_one")
    return plain.select("*", key).join(cuts.select("*", key), "_one").drop("_one")


def truth_rank(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """Rank of the true cell per (query, level): cells before it are counted, nothing is sorted.
    Pruned labels are left out; a true cell without a score has a null rank."""
    known = labels.where(F.col("idx") >= 0).select("query_id", "level", F.col("idx").alias("label_idx"))
    rows = scores.join(known, ["query_id", "level"])
    own = F.max(F.when(F.col("idx") == F.col("label_idx"), F.col("logit"))).over(Window.partitionBy("query_id", "level"))
    rows = rows.withColumn("_own", own)
    ahead = (F.col("logit") > F.col("_own")) | ((F.col("logit") == F.col("_own")) & (F.col("idx") < F.col("label_idx")))
    return rows.groupBy("query_id", "level", "label_idx").agg(
        F.when(F.max("_own").isNotNull(), F.count_if(ahead) + 1).alias("rank"))


def topk_accuracy(ranks: DataFrame, ks: Sequence[int] = (1, 5), by: Sequence[str] = ("level",)) -> DataFrame:
    """(by, k, correct, n, acc); n is at least 1 in the division."""
    each = ranks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return (each.groupBy(*by, "k").agg(F.count_if(F.col("rank") <= F.col("k")).alias("correct"), F.count(F.lit(1)).alias("n"))
            .withColumn("acc", F.col("correct") / F.greatest(F.col("n"), F.lit(1))))


def merge_metrics(batches: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Batch rows (metric, correct, n) → totals and accuracy."""
    return (batches.groupBy(*by).agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))
            .withColumn("acc", F.col("correct") / F.greatest(F.col("n"), F.lit(1))))


#: Bins of a state per doubling of 1 + distance.
STATE_BINS = 64


def distance_states(rows: DataFrame, by: Sequence[str], value: str = "distance_km",
                    thresholds: Sequence[float] = K.WITHIN_KM) -> DataFrame:
    """Mergeable state of distances per group, one row per occupied bin: (by, bin, n, total, within…).

    Bins are logarithmic (``STATE_BINS`` a doubling), so a state has some 900 rows up to half the globe.
    States of any batches add up (``merge_states``); with the batch among ``by`` they can be written next to
    the batch's list and merged later without reading the lists.
    """
    rows = rows.where(F.col(value).isNotNull()).withColumn("bin", _bin(value))
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
                                        *[F.count_if(F.col(value) < t).alias(within_name(t)) for t in thresholds])


def _bin(value: str) -> Column:
    return F.floor(F.log2(F.col(value) + 1) * STATE_BINS).cast("long")


def merge_states(states: DataFrame, by: Sequence[str]) -> DataFrame:
    """States of several batches as one per group."""
    sums = [c for c in states.columns if c == "n" or c == "total" or c.startswith("within_")]
    return states.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in sums])


def summary_of_states(states: DataFrame, rows: DataFrame, by: Sequence[str] = (), value: str = "distance_km") -> DataFrame:
    """The summary of ``distance_summary`` from merged states; ``rows`` are the batches' distances, of which only
    those in the bins that hold a wanted rank are looked at, to make the percentiles exact."""
    by = list(by)
    if not by:
        out = summary_of_states(states.withColumn("_all", F.lit(1)), rows.withColumn("_all", F.lit(1)), ["_all"], value)
        return out.drop("_all")
    shared_dir(states.sparkSession)
    states = merge_states(states, by).checkpoint()
    shares = [c for c in states.columns if c.startswith("within_")]
    plain = states.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_km"),
                                    *[(F.sum(c) / F.sum("n")).alias(c) for c in shares])
    cuts = bracketed_percentiles(states.select(*by, "bin", "n"), rows.where(F.col(value).isNotNull()).withColumn("bin", _bin(value)),
                                 value, {"p10_km": 0.1, "median_km": 0.5, "p90_km": 0.9}, by)
    return plain.join(cuts, by)


def merge_batches(batches: DataFrame, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Batch rows (by, correct, n, distances as an array) → totals, accuracy and the distance summary of all
    batches' lists together, n being the labelled rows and n_distances the distances. The batches are computed once."""
    shared_dir(batches.sparkSession)
    batches = batches.checkpoint()  # the totals, the states and the percentiles each read them
    rows = batches.select(*by, F.explode("distances").alias("distance_km"))
    summary = summary_of_states(distance_states(rows, by), rows, by).withColumnRenamed("n", "n_distances")
    return merge_metrics(batches, by).join(summary, list(by), "left")


def distances(points: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, lat, lng) against the truth: distance_km."""
    t = truth.select("query_id", F.col("lat").alias("_tlat"), F.col("lng").alias("_tlng"))
    return (points.join(t, "query_id")
            .withColumn("distance_km", geo.haversine_km("_tlat", "_tlng", "lat", "lng")).drop("_tlat", "_tlng"))


def argmax_distances(scores: DataFrame, cells: DataFrame, truth: DataFrame, level: int) -> DataFrame:
    best = R.argmax_centroid(scores.where(F.col("level") == level), cells).select(
        "query_id", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"))
    return distances(best, truth)


def evaluate(scores: DataFrame, labels: DataFrame, cells: DataFrame, truth: DataFrame, finest: int = 12,
             country_ranks: DataFrame | None = None) -> DataFrame:
    """Full evaluation as (metric, value): top-1/5 per level, country top-1/3, distance summary."""
    acc = topk_accuracy(truth_rank(scores, labels)).select(
        F.concat(F.lit("L"), F.col("level").cast("string"), F.lit("_top"), F.col("k").cast("string"), F.lit("_acc")).alias("metric"),
        F.col("acc").alias("value"))
    summary = distance_summary(argmax_distances(scores, cells, truth, finest))
    names = [c for c in summary.columns if c != "n"]
    wide = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    out = acc.unionByName(summary.select(F.explode(wide).alias("m")).select("m.*"))
    if country_ranks is not None:
        c = topk_accuracy(country_ranks, (1, 3), ())
        out = out.unionByName(c.select(F.concat(F.lit("country_top"), F.col("k").cast("string"), F.lit("_acc")).alias("metric"),
                                       F.col("acc").alias("value")))
    return out


def oracle_floor(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """Error of the true cell's centroid and coverage per level, and of the finest known cell."""
    c = cells.select("level", "idx", "centroid_lat", "centroid_lng")
    rows = labels.join(c, ["level", "idx"], "left").withColumn(
        "distance_km", geo.haversine_km("lat", "lng", "centroid_lat", "centroid_lng"))
    known = (F.col("idx") >= 0) & F.col("distance_km").isNotNull()
    finest = rows.where(known).groupBy("query_id").agg(F.max_by("distance_km", "level").alias("distance_km"))
    each = rows.select(F.col("level").cast("string").alias("level"), F.when(known, F.col("distance_km")).alias("distance_km"))
    both = each.unionByName(finest.select(F.lit("finest").alias("level"), "distance_km"))
    cover = both.groupBy("level").agg(F.avg(F.col("distance_km").isNotNull().cast("double")).alias("coverage"))
    return cover.join(exact_percentiles(both, "distance_km", {"median_km": 0.5}, ["level"]), "level")


def recall_at_k(ranks: DataFrame, ks: Sequence[int] = (1, 5, 10, 50), by: Sequence[str] = ("level", "regime")) -> DataFrame:
    return topk_accuracy(ranks, ks, by).select(*by, "k", F.col("acc").alias("recall"))


def oracle_selection(scores: DataFrame, cells: DataFrame, truth: DataFrame, ks: Sequence[int], level: int = 9) -> DataFrame:
    """Distance of the best of the first K candidates: median per K and the gap to the first one."""
    top = R.ranked(scores.where(F.col("level") == level), max(ks)).join(
        cells.select("level", "idx", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng")), ["level", "idx"])
    d = distances(top.select("query_id", "rank", "lat", "lng"), truth)
    each = d.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    best = each.groupBy("query_id", "k").agg(F.min("distance_km").alias("distance_km"))
    out = exact_percentiles(best, "distance_km", {"median_km": 0.5}, ["k"])
    first = out.agg(F.max_by("median_km", -F.col("k")).alias("m")).scalar()
    return out.withColumn("gap_km", first - F.col("median_km"))


def per_country(rows: DataFrame, supply: DataFrame) -> DataFrame:
    """(country, distance_km, similarity) and training supply (country, n_train) → breakdown."""
    s = rows.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("distance_km") < 25).cast("double")).alias("within_25km"),
                                    F.avg("similarity").alias("mean_similarity"))
    return (s.join(exact_percentiles(rows, "distance_km", {"median_km": 0.5}, ["country"]), "country")
            .join(supply, "country", "left"))


def compare_runs(runs: DataFrame, base: str) -> DataFrame:
    """(variant, query_id, distance_km): variants against the base on the queries both have."""
    b = runs.where(F.col("variant") == base).select("query_id", F.col("distance_km").alias("base_km"))
    pairs = runs.where(F.col("variant") != base).join(b, "query_id")
    pairs = pairs.withColumn("delta_km", F.col("distance_km") - F.col("base_km"))
    agg = pairs.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg("delta_km").alias("mean_delta_km"),
                                       F.avg((F.col("delta_km") > 0).cast("double")).alias("worse"))
    return agg.join(exact_percentiles(pairs, "delta_km", {"median_delta_km": 0.5}, ["variant"]), "variant")


def stage_timings(events: DataFrame, stages: Sequence[str] = ("fetch_pano", "stage1", "stage2_extract", "stage2_pinpoint", "stage2_geocode")) -> DataFrame:
    """Seconds per stage and in total per request; a stage without both ends is null."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))

    def at(name: str) -> Column:
        return F.max(F.when(F.col("event") == name, ts))

    return events.groupBy("request_id").agg(
        *[((at(f"{s}_done") - at(f"{s}_start")) / 1e6).alias(f"{s}_seconds") for s in stages],
        ((F.max(ts) - F.min(ts)) / 1e6).alias("total_seconds"))
