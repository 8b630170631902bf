"""Caps, shards and samples that do not depend on how rows are partitioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellselect.functions.columns import hash_uniform
from cellselect.operators.catalog import complete_samples
from cellselect.operators.scale import first_n, global_rank
from cellselect.session import shared_dir


def keyed_uniform(key: str, seed: int) -> Column:
    return hash_uniform(F.col(key).cast("string"), F.lit(str(seed)))


def cap_per_group(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows per group in key order. Tasks keep their own n first (group limit below the
    exchange), so a hot group moves n rows per task."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def stride_shard(df: DataFrame, key: str, n: int, i: int) -> DataFrame:
    """Rows whose rank in key order is i modulo n: disjoint and complete over all i."""
    ranks = global_rank(df.select(key), key)
    return df.join(ranks.where(F.col("rank") % n == i).select(key), key, "left_semi")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Seeded subset of ``n`` rows: the least keyed hashes. No task merges n rows."""
    return first_n(df.withColumn("_u", keyed_uniform(key, seed)), ["_u", key], n).drop("_u")


def random_eval_set(samples: DataFrame, crops: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return sample_n(complete_samples(samples, crops, key), key, n, seed)


def stratified(df: DataFrame, by: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """At most ``n`` rows per group, chosen by keyed hash."""
    out = cap_per_group(df.withColumn("_u", keyed_uniform(key, seed)), [by], n, ["_u", key])
    return out.drop("_u")


def weighted_resample(df: DataFrame, key: str, weight: str, draws: int, seed: int = 42,
                      buckets: int | None = None) -> DataFrame:
    """``draws`` draws with replacement in proportion to weight: (draw, key), seed-stable.

    Rows get their slice [lo, lo + w) of the total weight: a running sum inside hash buckets plus the
    sum of the buckets before (a table of ``buckets`` rows; by default 4,096, or as many more as keep a
    bucket at about 65,536 rows). Draws and slice starts then meet in
    ranges of equal row count, pinned by a checkpoint; one ordered pass takes the last start before
    each draw, and a slice that reaches into later ranges is carried there by range. A row that holds
    nearly all the weight neither repeats nor gathers its draws, nor squeezes the rest into few ranges.
    """
    if buckets is None:
        buckets = max(4096, 1 << (max(df.count(), 1) // 65_536).bit_length())
    n = F.lit(buckets)
    rows = df.select(key, F.col(weight).cast("double").alias("_w")).where(F.col("_w") > 0)
    rows = rows.withColumn("_b", F.floor(keyed_uniform(key, seed + 1) * n))
    sums = rows.groupBy("_b").agg(F.sum("_w").alias("_t"))
    total = sums.agg(F.sum("_t").alias("t")).scalar()
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_start"))
    inside = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)

    slices = (rows.withColumn("_lo", F.coalesce(F.sum("_w").over(inside), F.lit(0.0)))
              .join(starts, "_b").select(key, (F.col("_start") + F.col("_lo")).alias("_x")))
    d = (df.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("_x", keyed_uniform("draw", seed) * total))
    shared_dir(df.sparkSession)
    both = (slices.select("_x", key, F.lit(None).cast("long").alias("draw")).unionByName(
        d.withColumn(key, F.lit(None).cast(df.schema[key].dataType)))
        .withColumn("_d", F.col("draw").isNotNull()).repartitionByRange("_x", "_d", "draw")
        .withColumn("_p", F.spark_partition_id().cast("long")).drop("_d").checkpoint())
    order = Window.partitionBy("_p").orderBy("_x", F.col("draw").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_k", F.last(key, ignorenulls=True).over(order)).where(F.col("draw").isNotNull())
    last = both.groupBy("_p").agg(F.max_by(key, F.when(F.col("draw").isNull(), F.col("_x"))).alias("_k"))  # a row per range
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = (last
             .select("_p", F.last("_k", ignorenulls=True).over(upto).alias("_c")))
    return found.join(carry, "_p").select("draw", F.coalesce("_k", "_c").alias(key))
