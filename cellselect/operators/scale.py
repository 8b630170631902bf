"""Building blocks that keep hot keys and big groups spread over tasks.

* Equi-joins with a hot left key are left to adaptive execution, which splits the skewed partition
  and repeats the other side's (``session.tune`` lets it do so before aggregates too).
* ``with_chunks``       – split every group into hash chunks of bounded size.
* ``global_rank``       – total order rank without a single-task sort.
* ``exact_percentiles`` – exact interpolated percentiles by narrowing histograms.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.session import shared_dir


def with_chunks(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str], size: int,
                name: str = "chunk") -> DataFrame:
    """Add ``chunk`` so that (keys, chunk) groups hold about ``size`` rows, hot keys included.

    Reads ``df`` twice (once for its key columns only). Chunks are a hash of the id, so a retried
    task gives the same ones; the explicit exchange on (keys, chunk) lets the layout join be split
    on hot keys.
    """
    keys = list(keys)
    layout = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
              .where(F.col("_rows") > size)
              .select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], F.ceil(F.col("_rows") / F.lit(size)).alias("_chunks")))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)])  # null keys are keys too
    return (df.join(layout, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
            .withColumn(name, F.pmod(F.xxhash64(*id_cols), F.coalesce(F.col("_chunks"), F.lit(1)).cast("long")))
            .drop("_chunks").repartition(*[F.col(c) for c in keys], F.col(name)))


def packed(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str], payload: Sequence[str],
           size: int, name: str = "items") -> DataFrame:
    """One row per (keys, chunk) with at most about ``size`` payload structs in an array."""
    return (with_chunks(df, keys, id_cols, size)
            .groupBy(*keys, "chunk")
            .agg(F.collect_list(F.struct(*payload)).alias(name)))


def global_rank(df: DataFrame, *order: str, name: str = "rank") -> DataFrame:
    """0-based rank of every row in the total order of ``order`` (make it unique with an id).

    Range partitions are sorted in parallel and pinned by a checkpoint (their cut points come
    from a sample), then each partition gets the summed size of the ones before it; that offset
    table has one row per partition.
    """
    shared_dir(df.sparkSession)
    rows = (df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
            .withColumn("_mid", F.monotonically_increasing_id()).checkpoint())
    part = F.shiftright(F.col("_mid"), 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return (rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_mid", "_part", "_off"))


def first_n(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows in the total order of ``order`` (make it unique with an id), n of any size.

    Range partitions are counted, and only the one that holds the n-th row is cut; no task merges n
    rows. Columns of ``order`` must be columns of ``df``.
    """
    ranked = global_rank(df.select(*order), *order, name="_rank")
    return df.join(ranked.where(F.col("_rank") < n).drop("_rank"), list(order), "left_semi")


def prefix_rank(df: DataFrame, group: Sequence[str], text: str, width: int = 6,
                name: str = "idx") -> DataFrame:
    """0-based rank of distinct ``text`` inside each group in text order, in two parallel steps.

    A text's prefix orders before the rest, so rank = rows under smaller prefixes + rank inside
    the own prefix. The prefix table is bounded by the prefix alphabet, not by the data.
    """
    group = list(group)
    df = df.withColumn("_pre", F.substring(F.col(text), 1, width))
    before = Window.partitionBy(*group).orderBy("_pre").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*group, "_pre").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*group, "_pre").orderBy(text)
    return (df.withColumn("_rn", F.row_number().over(inside))
            .join(offsets, group + ["_pre"])
            .withColumn(name, (F.col("_off") + F.col("_rn") - 1).cast("long"))
            .drop("_pre", "_rn", "_off"))


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                      widths: Sequence[float] = (0.25, 0.25 / 4096)) -> DataFrame:
    """Exact linearly interpolated percentiles per group; one output column per entry of ``probs``.

    Histograms of falling bin width find the bins that hold the wanted ranks; only rows in those
    bins are counted by value. All steps aggregate map-side; no group's values meet in one task.
    """
    by = list(by)
    one = not by
    data = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    if one:
        by, data = ["_all"], data.withColumn("_all", F.lit(1))
    shared_dir(df.sparkSession)
    data = data.checkpoint()  # narrow (group, value) rows; the steps below read them several times
    total = data.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    spots = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos"))
                      for n, p in probs.items()])
    wanted = total.select(*by, F.explode(spots).alias("_s")).select(*by, "_s.name", "_s.pos")
    ranks = (wanted.select(*by, F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("_rank"))
             .distinct().withColumn("_rem", F.col("_rank")))
    path = list(by)
    for i, width in enumerate(widths):
        col = f"_b{i}"
        # NaN orders last, as in Spark's own percentiles
        data = data.withColumn(col, F.when(F.isnan("_v"), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col("_v") / F.lit(width))))
        data_in = data if i == 0 else data.join(ranks.select(*path).distinct(), path, "left_semi")
        ranks = _descend(data_in, path, col, ranks)
        path.append(col)
    inside = data.join(ranks.select(*path).distinct(), path, "left_semi")
    values = _descend(inside, path, "_v", ranks).select(*by, "_rank", "_v")
    low, high = values.withColumnRenamed("_v", "_lo"), values.withColumnRenamed("_v", "_hi")
    out = (wanted.withColumn("_rl", F.floor("pos")).withColumn("_rh", F.ceil("pos"))
           .join(low.withColumnRenamed("_rank", "_rl"), by + ["_rl"])
           .join(high.withColumnRenamed("_rank", "_rh"), by + ["_rh"])
           .withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("pos") - F.col("_rl")))
           .groupBy(*by)
           .agg(*[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in probs]))
    return out.drop("_all") if one else out


def bracketed_percentiles(hist: DataFrame, rows: DataFrame, value: str, probs: dict[str, float], by: Sequence[str],
                          parts: int = 4096) -> DataFrame:
    """As ``exact_percentiles``, from a histogram (by, bin, n) that exists already and grows with the value;
    ``rows`` have its bin. Only rows in the bins that hold a wanted rank are read on: they are counted in
    ``parts`` slices of their bin's range, and by value in the slices that hold a rank."""
    by = list(by)
    total = hist.groupBy(*by).agg(F.sum("n").alias("_n"))
    spots = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos")) for n, p in probs.items()])
    wanted = total.select(*by, F.explode(spots).alias("_s")).select(*by, "_s.name", "_s.pos")
    ranks = (wanted.select(*by, F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("_rank")).distinct().withColumn("_rem", F.col("_rank")))
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = hist.select(*by, "bin", (F.sum("n").over(upto) - F.col("n")).alias("_start"), F.sum("n").over(upto).alias("_end"))
    ranks = (ranks.join(bins, by).where((F.col("_rem") >= F.col("_start")) & (F.col("_rem") < F.col("_end")))
             .withColumn("_rem", F.col("_rem") - F.col("_start")).drop("_start", "_end"))
    path = [*by, "bin"]
    inside = rows.select(*path, F.col(value).cast("double").alias("_v")).join(ranks.select(*path).distinct(), path, "left_semi").checkpoint()
    span = inside.groupBy(*path).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    inside = inside.join(span, path).withColumn("_slice", F.when(F.col("_hi") > F.col("_lo"), F.floor(
        (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * parts)).otherwise(0)).drop("_lo", "_hi")
    ranks = _descend(inside, path, "_slice", ranks)
    path.append("_slice")
    inside = inside.join(ranks.select(*path).distinct(), path, "left_semi")
    values = _descend(inside, path, "_v", ranks).select(*by, "_rank", "_v")
    out = (wanted.withColumn("_rl", F.floor("pos")).withColumn("_rh", F.ceil("pos"))
           .join(values.select(*by, F.col("_rank").alias("_rl"), F.col("_v").alias("_low")), by + ["_rl"])
           .join(values.select(*by, F.col("_rank").alias("_rh"), F.col("_v").alias("_high")), by + ["_rh"])
           .withColumn("_q", F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("pos") - F.col("_rl"))))
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("name") == n, F.col("_q"))).alias(n) for n in probs])


def _descend(data: DataFrame, path: Sequence[str], col: str, ranks: DataFrame) -> DataFrame:
    upto = Window.partitionBy(*path).orderBy(col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (data.groupBy(*path, col).agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_end", F.sum("_c").over(upto))
            .withColumn("_start", F.col("_end") - F.col("_c")))
    return (ranks.join(hist, list(path))
            .where((F.col("_rem") >= F.col("_start")) & (F.col("_rem") < F.col("_end")))
            .withColumn("_rem", F.col("_rem") - F.col("_start"))
            .drop("_c", "_end", "_start"))
