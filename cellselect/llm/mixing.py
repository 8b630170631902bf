"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r in (0, cap), the expected number of its copies. Among all rates whose
expected words meet each source's target, those of greatest entropy are exponential tilts of the
even start: ``r / (cap - r) = exp(lambda * size / mean size)`` with one multiplier per source. The
multipliers minimise a convex dual, solved by Newton steps; each step is one distributed sum over
(source, size) cells, which carry all that the dual depends on. A bracket makes every step safe.

Rates become copies cell by cell along the sizes (running sums are rounded, so a source is off by
less than one document) and a few corrections on whole cells take the rest. Only DataFrame
operations; a source or a size that holds a third of all rows is a cell, not a group of rows, and
its documents are ranked in blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellselect.operators.scale import global_rank
from cellselect.session import shared_dir


def sizes(docs: DataFrame, column: str = "size") -> DataFrame:
    """``docs`` with the number of words of ``text`` (null: 0)."""
    return docs.withColumn(column, F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) for (source, source_size).

    Sources in code point order, null last, take the weights in turn and share ``share`` times all
    sizes; a target stops at ``cap`` times its source's size and its excess is shared again by weight.
    """
    ranked = global_rank(sources.where("source is not null"), "source", name="rank").unionByName(
        sources.where("source is null").crossJoin(sources.agg(F.count("source").alias("rank"))))
    values = F.array(*[F.lit(float(w)) for w in weights])
    table = ranked.select("source", "source_size", F.element_at(values, (F.col("rank") % len(weights) + 1).cast("int")).alias("weight"),
                          (F.col("source_size") * F.lit(float(cap))).alias("limit"),
                          F.lit(False).alias("full")).checkpoint()
    total = float(table.agg(F.sum("source_size")).first()[0] or 0) * share
    while True:  # ends: each round fills at least one source
        row = table.agg(F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).alias("used"),
                        F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).alias("open")).first()
        rate = (total - (row["used"] or 0.0)) / row["open"] if row["open"] else 0.0
        open_target = F.col("weight") * F.lit(rate)
        over = ~F.col("full") & (open_target > F.col("limit"))
        if not table.where(over).limit(1).count():
            return table.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(open_target).alias("target"))
        table = table.withColumn("full", F.col("full") | over).checkpoint()


def _sum(value):
    """Sum in thousandths as whole numbers: the same in any order, so reruns agree to the last bit."""
    return F.sum(F.round(value * 1000).cast("long")) / 1000


def tilt(cells: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """(source, lambda, mean): dual solution per source for cells (source, size, n); raises where some source
    does not come within ``tolerance`` of its target in ``rounds`` steps."""
    state = (cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"), F.sum("n").alias("docs"))
             .join(targets.select(F.col("source").alias("s"), "target"), F.expr("source <=> s")).drop("s")
             .select("source", "target", F.greatest(F.col("words") / F.col("docs"), F.lit(1e-6)).alias("mean"),
                     (F.col("target") >= F.col("words") * cap * (1 - 1e-12)).alias("all"),
                     F.lit(0.0).alias("lambda"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
             .checkpoint())
    kept = ("target", "mean", "all", "lambda", "low", "high")
    for _ in range(rounds):  # a step is one join and one sum, which carries the source's state along
        x = F.col("size") / F.col("mean")
        rate = cap / (1 + F.exp(-F.col("lambda") * x))
        own = state.select(F.col("source").alias("s"), *kept)
        sums = (cells.join(own, F.expr("source <=> s"))
                .groupBy("source").agg(*[F.first(c).alias(c) for c in kept],
                                       _sum(F.col("n") * F.col("size") * rate).alias("got"),
                                       _sum(F.col("n") * F.col("size") * x * rate * (1 - rate / cap)).alias("slope")))
        miss = F.col("target") - F.col("got")
        low = F.when(miss > 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(miss > 0, F.col("high")).otherwise(F.col("lambda"))
        newton = F.col("lambda") + F.try_divide(miss, F.col("slope"))
        wide = F.greatest(F.lit(1.0), F.abs("lambda") * 2)
        inside = (F.isnull("low") | (newton > F.col("low"))) & (F.isnull("high") | (newton < F.col("high")))
        middle = F.when(F.isnull("high"), F.col("low") + wide).when(F.isnull("low"), F.col("high") - wide).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when((F.col("slope") > 0) & inside & (F.abs(newton - F.col("lambda")) <= 4 * wide), newton).otherwise(middle)
        stepped = (sums.withColumn("low", low).withColumn("high", high)
                   .withColumn("done", F.col("all") | (F.abs(miss) <= F.lit(tolerance) * F.col("target")))
                   .withColumn("lambda", F.when(F.col("done") | F.isnull(step), F.col("lambda")).otherwise(step)))
        state = stepped.select("source", "target", "mean", "all", "lambda", "low", "high", "done").checkpoint()
        left = state.where("not done").limit(1).count()
        state = state.drop("done")
        if not left:
            return state
    raise RuntimeError(f"some source is still off its target after {rounds} rounds: {state.drop('low', 'high').first()}")


def cell_copies(cells: DataFrame, state: DataFrame, cap: float = 2.0, corrections: int = 3) -> DataFrame:
    """(source, size, n, copies): whole copies for each cell, near the tilted rates."""
    rate = F.when(F.col("all"), F.lit(cap)).otherwise(cap / (1 + F.exp(-F.col("lambda") * F.col("size") / F.col("mean"))))
    own = state.select(F.col("source").alias("s"), "target", "mean", "all", "lambda")
    upto = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    table = (cells.join(own, F.expr("source <=> s")).drop("s")
             .withColumn("units", F.sum(F.round(F.col("n") * rate * 1_000_000).cast("long")).over(upto))
             .withColumn("sum", F.expr("(units + 500000) div 1000000"))
             .withColumn("copies", F.col("sum") - F.coalesce(F.lag("sum").over(Window.partitionBy("source").orderBy("size")), F.lit(0)))
             .withColumn("most", F.floor(F.col("n") * F.lit(cap)))
             .withColumn("copies", F.least("copies", "most").cast("long"))
             .select("source", "size", "n", "target", "copies", "most"))
    # A source of W words has at most sqrt(2 W) sizes above 0, so its cells fit the task that has summed them up.
    every = Window.partitionBy("source")
    for _ in range(corrections):
        table = table.withColumn("off", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(every))
        want = F.round(F.try_divide(F.abs("off"), F.col("size"))).cast("long")
        room = F.when(F.col("off") > 0, F.col("most") - F.col("copies")).otherwise(F.col("copies"))
        table = table.withColumn("move", F.least(want, room)).withColumn("left", F.abs(F.abs("off") - F.col("move") * F.col("size")))
        useful = (F.col("size") > 0) & (F.col("move") != 0) & (F.col("left") < F.abs("off"))
        table = table.withColumn("best", F.min(F.when(useful, F.struct("left", "size"))).over(every))
        table = (table.withColumn("copies", F.col("copies") + F.when(F.col("size") == F.col("best.size"), (F.signum("off") * F.col("move")).cast("long")).otherwise(0))
                 .select("source", "size", "n", "target", "copies", "most"))
    return table.select("source", "size", "n", "copies").checkpoint()


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
        block: int = 20_000) -> DataFrame:
    """``docs`` (doc_id, source, size and any other columns) with source_size, target and copies.

    One row for each row. A null source is a source of its own, last in order. Documents of size 0
    take part and never move a target. Equal rows may get different copies; which of them gets more
    is fixed by a hash of doc_id, so reruns agree. Columns source_size, target, copies are replaced.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    docs = docs.drop("source_size", "target", "copies")
    cells = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    sources = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = source_targets(sources, weights, share, cap).checkpoint()
    state = tilt(cells, targets, cap)
    plan = cell_copies(cells, state, cap).join(
        targets.select(F.col("source").alias("s"), "source_size", "target"), F.expr("source <=> s")).drop("s")
    plan = plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "copies",
                       F.ceil(F.col("n") / F.lit(block)).alias("_blocks"),
                       F.expr("copies div n").alias("_base"), F.expr("copies % n").alias("_extra"))
    placed = docs.join(plan, F.expr("source <=> _source and size = _size")).withColumn("_hash", F.xxhash64("doc_id"))
    placed = placed.withColumn("_block", F.pmod("_hash", "_blocks"))
    # Only cells that give some but not all documents one copy more need an order among them.
    part = Window.partitionBy("_source", "_size", "_block").orderBy("_hash", "doc_id")
    before = Window.partitionBy("_source", "_size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_source", "_size", "_block").agg(F.count(F.lit(1)).alias("_c"))
              .withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
              .select(F.col("_source").alias("_s"), F.col("_size").alias("_z"), F.col("_block").alias("_b"), "_start"))
    ranked = (placed.withColumn("_row", F.row_number().over(part))
              .join(starts, F.expr("_source <=> _s and _size = _z and _block = _b")))
    copies = F.col("_base") + (F.col("_start") + F.col("_row") <= F.col("_extra")).cast("long")
    return ranked.withColumn("copies", copies).select(*docs.columns, "source_size", "target", "copies")
