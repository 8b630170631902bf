"""Catalogue jobs: dedupe, insert-only and replacing sinks, pending work, ledgers and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellselect.functions import columns as X
from cellselect.operators.groups import components
from cellselect.operators.scale import first_n


def _first_by(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """One row per key, the least by ``order``: an aggregate with map-side combine, so a key with
    countless copies never meets in one sort."""
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.distinct()
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def dedupe_priority(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First source wins: the row with the least ``order`` per key."""
    return _first_by(df, [key], F.struct(*order)).select(*df.columns)


def insert_ignore(new: DataFrame, existing: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows to append: new keys only, the first in order on repeats."""
    return dedupe_priority(new, key, order).join(existing.select(key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """Existing rows replaced by the last new row per key."""
    key = list(key)
    both = existing.withColumn("_o", F.lit(None).cast("long")).unionByName(
        new.select(*[c for c in existing.columns], F.col(order).cast("long").alias("_o")))
    # null orders (existing rows) sort first, so the last new row wins
    rest = [c for c in existing.columns if c not in key]
    last = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.coalesce("_o", F.lit(-(1 << 62)))).alias("_b"))
    return last.select(*key, *[F.col(f"_b.{c}").alias(c) for c in rest]).select(*existing.columns)


def prune(existing: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows whose key still occurs in the source."""
    return existing.join(seen.select(*keys).distinct(), list(keys), "left_semi")


def skip_known(df: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return df.join(existing.select(key).distinct(), key, "left_anti")


def match_files(meta: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Metadata against files: full outer with ``state`` both, csv_only or file_only."""
    m = meta.withColumn("_m", F.lit(True))
    f = files.withColumn("_f", F.lit(True))
    state = (F.when(F.col("_m") & F.col("_f"), "both").when(F.col("_m"), "csv_only").otherwise("file_only"))
    return m.join(f, key, "full_outer").withColumn("state", state).drop("_m", "_f")


def ingest_report(meta: DataFrame, files: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Counts of one ingest pass: seen, skipped, ingested, csv without file, file without csv."""
    known = existing.select(key).distinct().withColumn("_k", F.lit(True))
    n = (meta.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), F.count_if("valid").alias("_v"))
         .join(files.select(key).distinct().withColumn("_f", F.lit(True)), key, "full_outer")
         .join(known, key, "left"))
    seen, valid = F.coalesce("_m", F.lit(0)), F.coalesce("_v", F.lit(0))
    here, old = F.col("_f").isNotNull(), F.col("_k").isNotNull()
    return n.agg(
        F.sum(seen).alias("seen"), F.sum(F.when(old, seen).otherwise(0)).alias("skipped"),
        F.sum(F.when(~old & here, F.least(valid, F.lit(1))).otherwise(0)).alias("ingested"),
        F.sum(F.when(~old & ~here, seen).otherwise(0)).alias("csv_without_file"),
        F.count_if(here & ~old & (valid == 0)).alias("file_without_csv"))


def pending_crops(samples: DataFrame, crops: DataFrame, key: str, last_heading: int = 270) -> DataFrame:
    """Samples whose last crop is missing."""
    done = crops.where(F.col("heading") == last_heading).select(key)
    return samples.join(done, key, "left_anti")


def complete_samples(samples: DataFrame, crops: DataFrame, key: str, n: int = 4) -> DataFrame:
    """Samples with exactly ``n`` crops."""
    full = crops.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select(key)
    return samples.join(full, key, "left_semi")


def timeline_edges(df: DataFrame, anchor: str, historical: str) -> DataFrame:
    """Star edges anchor → sibling; missing ids and self edges go."""
    return (df.select(F.col(anchor).alias("anchor"), F.explode(historical).alias("sibling"))
            .where(F.col("sibling").isNotNull() & (F.col("sibling") != F.col("anchor")))
            .dropDuplicates(["anchor", "sibling"]))


def location_groups(samples: DataFrame, edges: DataFrame, key: str, anchor: str, sibling: str) -> DataFrame:
    """Group key of a location: the least key among all samples that timelines link, over any number of
    links; the own key without any."""
    groups = components(edges, anchor, sibling).select(F.col("id").alias(key), F.col("component").alias("_a"))
    return samples.join(groups, key, "left").withColumn("location", F.coalesce("_a", F.col(key))).drop("_a")


def run_ledger(events: DataFrame) -> DataFrame:
    """One row per run from its append-only events (run_id, ts, status, label, target)."""
    return events.groupBy("run_id").agg(
        F.max_by("status", "ts").alias("status"), F.min("ts").alias("started_at"),
        F.max(F.when(F.col("status") == "complete", F.col("ts"))).alias("completed_at"),
        F.max("label").alias("label"), F.max("target").alias("target"))


def reject_report(df: DataFrame, covered: str, passed: str) -> DataFrame:
    reason = F.when(~F.col(covered), "no_coverage").when(~F.col(passed), "filter").otherwise("collected")
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def split_report(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def head_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First rows by a total order; ``n`` may be any share of the data, no task merges n rows."""
    return first_n(df, list(order), n)


def admission(df: DataFrame, **cfg) -> DataFrame:
    return df.where(X.passes_filter(**cfg))


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value)


def country_weights(df: DataFrame, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """Sampling weight by country code, ``default`` where none is listed."""
    w = weights.select(F.col("code").alias("country_code"), F.col("weight").alias("_w"))
    return (df.join(w, "country_code", "left")
            .withColumn("weight", F.coalesce("_w", F.lit(float(default)))).drop("_w"))
