"""Decision cascades: lookup, fallback, final point, refinement, merge, response, verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.functions import geo
from cellselect.functions import text as T
from cellselect.operators import retrieval as V
from cellselect.operators import scores as R
from cellselect.operators.spatial import reverse_geocode, same_country

FALLBACK_KM = 500.0


# --- lookup -----------------------------------------------------------------------------------

def geocode_first_hit(requests: DataFrame, gazetteer: DataFrame, key: str, floor: float = 0.0) -> DataFrame:
    """First query of (key, queries, scope) with a match wins, the most important match inside it.

    ``scope`` is a country or null. The gazetteer is first cut to its best row per (name, country)
    and per name, so a name with countless entries joins as one row.
    """
    hit = F.struct("lat", "lng", "importance", "place_type", "country")
    g = (gazetteer.where(F.col("importance") >= floor)
         .select(F.lower(F.trim("name")).alias("name"), "country", hit.alias("hit"),
                 F.struct(-F.col("importance"), "country", "lat", "lng").alias("o")))
    by_country = g.groupBy("name", F.col("country").alias("scope")).agg(F.min_by("hit", "o").alias("hit"))
    anywhere = g.groupBy("name").agg(F.min_by("hit", "o").alias("hit")).withColumn("scope", F.lit(""))
    best = by_country.unionByName(anywhere)
    q = (requests.select(key, F.coalesce("scope", F.lit("")).alias("scope"), F.posexplode("queries").alias("pos", "query"))
         .withColumn("name", F.lower(F.trim("query"))).where(F.col("name") != ""))
    found = q.join(best, ["name", "scope"])
    return (found.groupBy(key).agg(F.min_by(F.struct("query", "hit"), "pos").alias("_f"))
            .select(key, F.col("_f.query").alias("query"), "_f.hit.*"))


def hit_country(hits: DataFrame, cover: DataFrame) -> DataFrame:
    """Hits with ``country`` from their coordinates (null outside every polygon), not from their source."""
    named = reverse_geocode(hits.drop("country"), cover)
    return named.select(*[c for c in hits.columns if c != "country"], F.col("country_name").alias("country"))


# --- points -----------------------------------------------------------------------------------

def l9_fallback(lat9: Column, lng9: Column, lat12: Column, lng12: Column, threshold: float = FALLBACK_KM) -> Column:
    """struct(lat, lng, fallback_used): the coarse point when the fine one lies too far from it."""
    far = geo.haversine_km(lat9, lng9, lat12, lng12) > threshold
    return F.struct(F.when(far, lat9).otherwise(lat12).alias("lat"), F.when(far, lng9).otherwise(lng12).alias("lng"),
                    far.alias("fallback_used"))


def final_point(df: DataFrame, threshold: float = FALLBACK_KM, min_count: int = 10) -> DataFrame:
    """Add ``final`` from structs l9, l12 (lat, lng; l12 with n), selected, refined (lat, lng or
    null), the flag l12_unconstrained, and optional e9, e12 expected locations that stand for the
    centroids except in the distance test. A refined point takes the level-9 cell's place, in the
    distance test too; e9 is expected to be made with it."""
    near9 = F.coalesce(F.struct("refined.lat", "refined.lng"), F.struct("l9.lat", "l9.lng"))
    near9 = F.when(F.col("refined").isNotNull(), near9).otherwise(F.struct("l9.lat", "l9.lng"))
    e9 = F.coalesce(F.col("e9"), near9) if "e9" in df.columns else near9
    e12 = F.coalesce(F.col("e12"), F.struct("l12.lat", "l12.lng")) if "e12" in df.columns else F.struct("l12.lat", "l12.lng")
    refined = F.when(F.col("refined").isNotNull(), F.struct("refined.lat", "refined.lng"))
    far = geo.haversine_km(near9["lat"], near9["lng"], F.col("l12.lat"), F.col("l12.lng")) > threshold

    def out(point: Column, source: str, used: bool) -> Column:
        return F.struct(point["lat"].alias("lat"), point["lng"].alias("lng"), F.lit(source).alias("branch"),
                        F.lit(used).alias("fallback_used"))

    rescue = F.coalesce(refined, e9)
    final = (F.when(F.col("selected").isNotNull(), out(F.struct("selected.lat", "selected.lng"), "selected", False))
             .when(F.col("l12_unconstrained"), out(rescue, "unconstrained", True))
             .when(far, out(rescue, "far", True))
             .when(F.coalesce("l12.n", F.lit(0)) >= min_count, out(e12, "dense", False))
             .when(refined.isNotNull(), out(refined, "refined", False))
             .otherwise(out(e12, "sparse", False)))
    return df.withColumn("final", final)


def predict(scores: DataFrame, cells: DataFrame, pmap: DataFrame, queries: DataFrame, protos: DataFrame, select_k: int = 500,
            average_n: int = 0, k3: int = 3, k6: int = 5, k9: int = 10, threshold: float = FALLBACK_KM, min_count: int = 10,
            country_dist: DataFrame | None = None, countries: DataFrame | None = None, country_share: float = 0.30) -> DataFrame:
    """First stage as one plan: country mask (with ``country_dist`` and top ``countries``) → cascade →
    content selector (``select_k``) or averaging of the best ``average_n`` cells → final point.

    (query_id, l9_idx, l12_idx, lat, lng, branch, fallback_used).
    """
    if country_dist is not None and countries is not None:
        rest = scores.where(~F.col("level").isin(9, 12))
        for level in (9, 12):
            kept = R.mask_by_country(scores, country_dist, countries, level, country_share)
            rest = rest.unionByName(kept.select(*scores.columns))
        scores = rest
    masked, flags = R.cascade(scores, pmap, k3, k6, k9)
    best = R.argmax_centroid(masked, cells).join(cells.select("level", "idx", "n"), ["level", "idx"])
    cell = F.struct(F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"), "idx", "n")
    top = best.groupBy("query_id").agg(*[F.max(F.when(F.col("level") == v, cell)).alias(f"l{v}") for v in (9, 12)])
    none = F.lit(None).cast("struct<lat:double,lng:double>")
    df = top.join(flags, "query_id").withColumns({"selected": none, "refined": none})
    point = F.struct("lat", "lng")
    if select_k:
        chosen = V.select_by_content(masked, queries, protos, select_k).select("query_id", point.alias("selected"))
        df = df.drop("selected").join(chosen, "query_id", "left")
    elif average_n:
        cands = R.ranked(R.softmax(masked.where(F.col("level") == 9)), average_n).select("query_id", F.col("idx").alias("cell_idx"), "rank", "prob")
        mean = V.refine_average(cands, queries, protos, average_n).select("query_id", point.alias("refined"))
        df = df.drop("refined").join(mean, "query_id", "left")
    return final_point(df, threshold, min_count).select("query_id", F.col("l9.idx").alias("l9_idx"), F.col("l12.idx").alias("l12_idx"), "final.*")


def refine_decision(df: DataFrame, trusted=K.TRUSTED_PRECISIONS, min_confidence: float = K.MIN_CONFIDENCE,
                    max_drift: float = K.MAX_DRIFT_KM) -> DataFrame:
    """Add ``decision`` struct(lat, lng, used, precision, source, reason).

    Reads stage1_lat, stage1_lng, hub, has_text, timed_out, pinpoint struct and hit struct (lat, lng,
    place_type, country) or null. Tests run in order; only a near point feature moves the pin.
    """
    p, hit = F.col("pinpoint"), F.col("hit")
    drift = geo.haversine_km("stage1_lat", "stage1_lng", hit["lat"], hit["lng"])
    reason = (F.when(~F.col("has_text"), "no_text").when(F.col("timed_out"), "timeout")
              .when(~p["precision_level"].isin(*trusted), "too_coarse")
              .when(p["confidence"] < min_confidence, "low_confidence")
              .when(hit.isNull(), "geocode_miss")
              .when(~same_country(hit["country"], F.col("hub")), "country_mismatch")
              .when(T.is_area_centroid(hit["place_type"]), "area_centroid")
              .when(drift > max_drift, "too_far").otherwise("accept"))
    out = df.withColumn("_r", reason)
    used = F.col("_r") == "accept"
    return out.withColumn("decision", F.struct(
        F.when(used, hit["lat"]).otherwise(F.col("stage1_lat")).alias("lat"),
        F.when(used, hit["lng"]).otherwise(F.col("stage1_lng")).alias("lng"), used.alias("used"),
        F.when(used, p["precision_level"]).otherwise("country").alias("precision"),
        F.when(used, "gazetteer").otherwise("stage1").alias("source"), F.col("_r").alias("reason"))).drop("_r")


def merge_refinement(df: DataFrame) -> DataFrame:
    """Override the final point by a used decision, keep the first one; a failed refinement (null
    decision with ``error``) only sets the unused flag."""
    used = F.coalesce(F.col("decision.used"), F.lit(False))
    return df.withColumns({
        "stage2_used": used, "stage2_error": F.when(F.col("decision").isNull(), F.col("error")),
        "stage1_lat": F.when(used, F.col("final_lat")), "stage1_lng": F.when(used, F.col("final_lng")),
        "lat": F.when(used, F.col("decision.lat")).otherwise(F.col("final_lat")),
        "lng": F.when(used, F.col("decision.lng")).otherwise(F.col("final_lng"))})


def build_result(cands: DataFrame, top: int = 5) -> DataFrame:
    """Per query a map level → array of its first candidates (prob, lat, lng, country code or ??)."""
    c = F.struct("rank", "prob", F.col("centroid_lat").alias("lat"), F.col("centroid_lng").alias("lng"),
                 F.coalesce("country_code", F.lit("??")).alias("country_code"))
    levels = (cands.where(F.col("rank") <= top).groupBy("query_id", "level")
              .agg(F.sort_array(F.collect_list(c)).alias("cands")))
    return levels.groupBy("query_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "cands")))).alias("per_level"))


def verify_candidates(cands: DataFrame) -> DataFrame:
    """(query_id, rank, contradictions, …) → the first candidate without contradictions, else the
    first one; ``verified`` tells which."""
    rest = [c for c in cands.columns if c != "query_id"]
    order = F.struct(F.size("contradictions") > 0, "rank")
    best = cands.groupBy("query_id").agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select("query_id", "_b.*").withColumn("verified", F.size("contradictions") == 0)
