"""Cell statistics, vocabularies, labels, parent maps and country distributions.

Cell columns ``s2_l<level>`` and ``cell`` hold the 64 id bits as BIGINT (what shuffles carry); the
unsigned decimal text, which vocabularies order by, is made once per distinct cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellselect.functions import constants as K
from cellselect.functions import geo
from cellselect.operators.scale import prefix_rank


def with_cells(df: DataFrame, levels: Sequence[int] = geo.LEVELS) -> DataFrame:
    """Add ``s2_l<level>`` columns; the leaf cell is computed once, its ancestors by bit operations."""
    out = geo.with_s2_leaf(df, "lat", "lng", "_leaf")
    return out.withColumns({f"s2_l{n}": geo.s2_parent("_leaf", n) for n in levels}).drop("_leaf")


def explode_levels(df: DataFrame, keep: Sequence[str], levels: Sequence[int] = geo.LEVELS) -> DataFrame:
    """(level, cell) rows out of the cell columns, one scan for all levels; null cells go."""
    pairs = F.array(*[F.struct(F.lit(n).alias("level"), F.col(f"s2_l{n}").alias("cell")) for n in levels])
    return (df.select(*keep, F.explode(pairs).alias("_c")).select(*keep, "_c.level", "_c.cell")
            .where(F.col("cell").isNotNull()))


def in_split(df: DataFrame, split: str | None = "train") -> DataFrame:
    """Rows of a split; the whole table when it carries no split column."""
    return df.where(F.col("split") == split) if split and "split" in df.columns else df


def cell_stats(df: DataFrame, levels: Sequence[int] = geo.LEVELS, split: str | None = "train",
               spherical: bool = False) -> DataFrame:
    """Count and mean coordinate per (level, cell), partially aggregated before the only shuffle."""
    rows = explode_levels(in_split(df, split), ["lat", "lng"], levels)
    if not spherical:
        return rows.groupBy("level", "cell").agg(
            F.count(F.lit(1)).alias("n"), F.avg("lat").alias("centroid_lat"), F.avg("lng").alias("centroid_lng"))
    phi, lam = F.radians("lat"), F.radians("lng")
    mean = rows.groupBy("level", "cell").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.cos(phi) * F.cos(lam)).alias("_x"),
        F.avg(F.cos(phi) * F.sin(lam)).alias("_y"), F.avg(F.sin(phi)).alias("_z"))
    return mean.select("level", "cell", "n",
                       F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))).alias("centroid_lat"),
                       F.degrees(F.atan2("_y", "_x")).alias("centroid_lng"))


def min_count_of(level: Column, min_count: dict[int, int] | None = None) -> Column:
    out = F.lit(1)
    for lvl, n in (K.MIN_COUNT if min_count is None else min_count).items():
        out = F.when(level == lvl, n).otherwise(out)
    return out


def prune_cells(stats: DataFrame, min_count: dict[int, int] | None = None) -> DataFrame:
    return stats.where(F.col("n") >= min_count_of(F.col("level"), min_count))


def cell_vocab(stats: DataFrame, min_count: dict[int, int] | None = None) -> DataFrame:
    """Kept cells with a dense index in the order of their id text (``cell_text``)."""
    kept = prune_cells(stats, min_count).withColumn("cell_text", geo.s2_text(F.col("cell")))
    return prefix_rank(kept, ["level"], "cell_text", width=6)


def country_vocab(df: DataFrame, split: str | None = "train") -> DataFrame:
    """Sorted distinct country codes of a split with their index (a few hundred rows)."""
    codes = (in_split(df, split).where(F.col("country_code").isNotNull())
             .select(F.col("country_code").alias("code")).distinct())
    return prefix_rank(codes, [], "code", width=2)


def label_cells(df: DataFrame, vocab: DataFrame, key: str, levels: Sequence[int] = geo.LEVELS) -> DataFrame:
    """(key, level, idx) labels; cells outside the vocabulary become -1."""
    rows = explode_levels(df, [key], levels)
    return (rows.join(vocab.select("level", "cell", "idx"), ["level", "cell"], "left")
            .select(key, "level", F.coalesce("idx", F.lit(K.PRUNED).cast("long")).alias("idx")))


def known_labels(labels: DataFrame) -> DataFrame:
    """Label rows without the pruned mark."""
    return labels.where(F.col("idx") >= 0)


def parent_map(vocab: DataFrame, child: int, parent: int) -> DataFrame:
    """Child index → parent index, -1 where the parent is not in the vocabulary."""
    if parent >= child:
        raise ValueError("the parent level must be coarser than the child level")
    kids = vocab.where(F.col("level") == child).select(
        F.col("idx").alias("child_idx"),
        geo.s2_parent("cell", parent).alias("cell"))
    ups = vocab.where(F.col("level") == parent).select("cell", F.col("idx").alias("parent_idx"))
    return kids.join(ups, "cell", "left").select(
        F.lit(child).alias("child_level"), "child_idx", F.lit(parent).alias("parent_level"),
        F.coalesce("parent_idx", F.lit(K.PRUNED).cast("long")).alias("parent_idx"))


def modal_country(df: DataFrame, levels: Sequence[int] = geo.LEVELS, split: str | None = "train") -> DataFrame:
    """Most frequent country per cell; equal counts go to the smaller code."""
    rows = explode_levels(in_split(df, split).where(F.col("country_code").isNotNull()), ["country_code"], levels)
    counts = rows.groupBy("level", "cell", "country_code").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("level", "cell").agg(F.min(F.struct((-F.col("n")).alias("neg"), "country_code")).alias("b"))
    return best.select("level", "cell", F.col("b.country_code").alias("country_code"), (-F.col("b.neg")).alias("n"))


def country_dist(labels: DataFrame, country: str = "country") -> DataFrame:
    """P(country | cell) as a sparse long table from (level, idx, country) rows."""
    counts = (known_labels(labels).where(F.col(country).isNotNull())
              .groupBy("level", "idx", F.col(country).alias("country")).agg(F.count(F.lit(1)).alias("n")))
    cell = Window.partitionBy("level", "idx")
    return counts.select("level", "idx", "country", (F.col("n") / F.sum("n").over(cell)).alias("p"))


def mapped_report(vocab: DataFrame, modal: DataFrame) -> DataFrame:
    """Cells with a known country per level."""
    return (vocab.join(modal.select("level", "cell", "country_code"), ["level", "cell"], "left")
            .groupBy("level").agg(F.count("country_code").alias("mapped"), F.count(F.lit(1)).alias("cells")))


def remap_vocab(new: DataFrame, old: DataFrame, fresh: Column, key: Sequence[str] = ("level", "cell")) -> DataFrame:
    """Carry old payloads (``vec``) to the new index by key; others, or payloads of another length,
    keep the fresh one. ``copied`` tells which."""
    key = list(key)
    carried = new.join(old.select(*key, F.col("vec").alias("_old")), key, "left").withColumn("_fresh", fresh)
    same = F.col("_old").isNotNull() & (F.size("_old") == F.size("_fresh"))
    return (carried.withColumn("vec", F.when(same, F.col("_old")).otherwise(F.col("_fresh")))
            .withColumn("copied", same).drop("_old", "_fresh"))


def remap_report(remapped: DataFrame) -> DataFrame:
    return remapped.groupBy("level").agg(F.count_if("copied").alias("copied"),
                                         F.count_if(~F.col("copied")).alias("fresh"))
