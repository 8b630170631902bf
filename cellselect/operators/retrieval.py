"""Vector retrieval inside cells, the content selector and its diagnostics.

Prototypes (vec_id, cell_idx, embedding, lat, lng) and candidates (query_id, cell_idx) meet as
packs of bounded size: a prototype pack of a cell × a query pack of the same cell is one row, and
one matrix product. Only the k best per (query, pack) leave a task, so neither a dense cell nor a
popular one yields pair rows or lands in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellselect.functions import geo
from cellselect.operators import scores as R
from cellselect.session import shared_dir

PROTO_PACK = 2048
QUERY_PACK = 1024
#: Packs of either side that meet under one key of the grid.
PACKS_PER_KEY = 16


def _matrix(structs: pa.StructArray, start: int, end: int) -> np.ndarray:
    flat = structs.field("embedding").slice(start, end - start).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(end - start, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _first_k(k: int, group: np.ndarray, sim: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the k best of each group, in order: by similarity (NaN last), ties to the smaller id."""
    order = np.lexsort((ids, -sim, group))
    g = group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)])) < k]


def _candidates(k: int, q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, prototype, sim) of all pairs that may be among a query's k best. A matrix product rounds a pair by its
    place in the matrix, so those near the k-th are kept and computed anew, each alike: copies tie."""
    sims = q @ p.T
    if np.isnan(q).any() or np.isnan(p).any():
        sims[np.isnan(sims)] = -np.inf
    if k < len(p):
        # the k-th largest of the greatest of 16 each is no larger than the k-th of all
        tops = np.maximum.reduceat(sims, np.arange(0, len(p), 16), axis=1) if k * 16 < len(p) else sims
        least = np.partition(tops, tops.shape[1] - k, axis=1)[:, tops.shape[1] - k] - 1e-12
        at_q, at_p = np.divmod(np.flatnonzero(sims >= least[:, None]), len(p))
    else:
        at_q, at_p = (x.ravel() for x in np.indices(sims.shape))
    return at_q, at_p, np.einsum("ij,ij->i", q[at_q], p[at_p])


def _best_of(k: int, carry: Sequence[str]):
    """Arrow function: joined packs → the k most similar prototypes per query and pack of queries. Consecutive
    rows of one pack of queries are merged, so it sends k rows for each query, not for each of its packs."""
    names = ["query_id", *carry, "cell_idx", "n_prototypes", "vec_id", "sim", "lat", "lng"]

    def sent(key: tuple, queries: pa.StructArray, at: np.ndarray, sim: np.ndarray, found: list[pa.Array]) -> pa.RecordBatch:
        take = pa.array(at)
        same = [pa.array(np.full(len(at), v), pa.int64()) for v in key[:2]]
        return pa.RecordBatch.from_arrays([*[queries.field(n).take(take) for n in ("query_id", *carry)], *same, found[0], pa.array(sim), *found[1:]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, queries, their unit vectors, query of each found row, its sim, its (vec_id, lat, lng)
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            protos, queries = cols["protos"], cols["queries"]
            p_off, q_off = protos.offsets.to_numpy(), queries.offsets.to_numpy()
            for r in range(batch.num_rows):
                p0, p1, q0, q1 = p_off[r], p_off[r + 1], q_off[r], q_off[r + 1]
                key = tuple(cols[n][r].as_py() for n in ("cell_idx", "n_prototypes", "chunk", "_j"))
                new = held is None or held[0] != key
                if new and held is not None:
                    yield sent(held[0], held[1], *held[3:])
                if new:
                    own = pa.concat_arrays([queries.values.slice(q0, q1 - q0)])
                    held = (key, own, _unit(_matrix(own, 0, len(own))), np.zeros(0, np.int64), np.zeros(0), None)
                _, own, units, at, sim, found = held
                at_q, at_p, s = _candidates(k, units, _unit(_matrix(protos.values, p0, p1)))
                rows = [protos.values.field(n).take(pa.array(p0 + at_p)) for n in ("vec_id", "lat", "lng")]
                if found is not None:
                    at_q, s = np.concatenate([at, at_q]), np.concatenate([sim, s])
                    rows = [pa.concat_arrays([a, b]) for a, b in zip(found, rows)]
                best = _first_k(k, at_q, s, rows[0].to_numpy(zero_copy_only=False))
                held = (key, own, units, at_q[best], s[best], [c.take(pa.array(best)) for c in rows])
        if held is not None:
            yield sent(held[0], held[1], *held[3:])

    return run


def in_cell_topk(cands: DataFrame, queries: DataFrame, protos: DataFrame, k: int, min_n: int = 1,
                 on: Sequence[str] = ("query_id",), proto_pack: int = PROTO_PACK, query_pack: int = QUERY_PACK) -> DataFrame:
    """The k most similar prototypes of each candidate's cell: (query_id, cell_idx, vec_id, sim,
    lat, lng, n_prototypes, rn and further candidate columns), ties to the smaller vec_id.

    The candidate list (ids only) is checkpointed: it is read for the layout and for the packs. The
    layout has one row per asked cell and decides how many packs a cell takes on either side; cells
    nobody asks for, or with fewer than ``min_n`` prototypes, go before any vector moves. ``on`` names
    the columns that identify a query vector.
    """
    shared_dir(cands.sparkSession)
    cands = cands.checkpoint()
    carry = [c for c in cands.columns if c not in ("query_id", "cell_idx")]
    n_q = cands.groupBy("cell_idx").agg(F.count(F.lit(1)).alias("_nq"))
    n_p = protos.groupBy("cell_idx").agg(F.count(F.lit(1)).alias("n_prototypes"))
    layout = n_p.where(F.col("n_prototypes") >= min_n).join(n_q, "cell_idx")
    packs_p = F.ceil(F.col("n_prototypes") / F.lit(proto_pack)).cast("long")
    packs_q = F.ceil(F.col("_nq") / F.lit(query_pack)).cast("long")
    # A cell's packs meet on a grid of join keys: row i takes every a-th query pack, column j every
    # b-th prototype pack, so no key sees more than about PACKS_PER_KEY packs of either side however
    # many vectors or queries the cell has. Nearly all cells have the grid 1 × 1 and copy nothing.
    a, b = (F.ceil(n / F.lit(PACKS_PER_KEY)).cast("long") for n in (packs_q, packs_p))
    layout = layout.select("cell_idx", "n_prototypes", packs_p.alias("_p"), packs_q.alias("_q"), a.alias("_a"), b.alias("_b"))

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    p = (protos.join(layout, "cell_idx").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "_p"))
         .repartition("cell_idx", "chunk")
         .groupBy("cell_idx", "chunk", "n_prototypes", "_a", "_b")
         .agg(F.collect_list(F.struct("vec_id", "embedding", "lat", "lng")).alias("protos"))
         .select("cell_idx", "n_prototypes", "protos", F.pmod("chunk", "_b").alias("_j"), upto("_a").alias("_i")))
    q = (cands.join(layout, "cell_idx").withColumn("chunk", F.pmod(F.xxhash64(*on), "_q"))
         .join(queries.select(*on, "embedding"), list(on))
         .groupBy("cell_idx", "chunk", "_a", "_b")
         .agg(F.collect_list(F.struct("query_id", *carry, "embedding")).alias("queries"))
         .select("cell_idx", "chunk", "queries", F.pmod("chunk", "_a").alias("_i"), upto("_b").alias("_j")))
    # a pack of queries goes through the packs of its key one after the other
    joined = q.join(p, ["cell_idx", "_i", "_j"]).select("cell_idx", "n_prototypes", "chunk", "_j", "protos", "queries")
    types = dict(cands.dtypes)
    schema = ", ".join(["query_id long", *[f"{c} {types[c]}" for c in carry], "cell_idx long", "n_prototypes long",
                        "vec_id long", "sim double", "lat double", "lng double"])
    best = joined.mapInArrow(_best_of(k, carry), schema)
    w = Window.partitionBy("cell_idx", *on).orderBy(F.desc("sim"), "vec_id")
    return best.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def refine_in_cell(cands: DataFrame, queries: DataFrame, protos: DataFrame, k: int = 5, tau: float = 0.1,
                   min_n: int = 3) -> DataFrame:
    """In-cell refinement: softmax(sim / tau) mean of the k nearest prototypes' coordinates.

    Cells with fewer than ``min_n`` prototypes, or none, give no row. Further candidate columns stay.
    """
    carry = [c for c in cands.columns if c not in ("query_id", "cell_idx")]
    top = in_cell_topk(cands, queries, protos, k, min_n)
    g = top.groupBy("query_id", "cell_idx", "n_prototypes", *carry).agg(
        F.sort_array(F.collect_list(F.struct("rn", "sim", "lat", "lng"))).alias("t"), F.max("sim").alias("top_similarity"))
    g = g.withColumn("w", F.transform("t", lambda s: F.exp((s["sim"] - F.col("top_similarity")) / tau)))

    def total(values) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)

    z = total(F.col("w"))
    return g.select("query_id", "cell_idx", *carry,
                    (total(F.zip_with("w", "t", lambda w, s: w * s["lat"])) / z).alias("lat"),
                    (total(F.zip_with("w", "t", lambda w, s: w * s["lng"])) / z).alias("lng"),
                    "n_prototypes", F.size("t").cast("long").alias("n_used"), "top_similarity")


def _by_score(scores: DataFrame, k: int) -> DataFrame:
    return (R.ranked(scores.where(F.col("level") == 9), k)
            .select("query_id", F.col("idx").alias("cell_idx"), "rank"))


def select_by_content(scores: DataFrame, queries: DataFrame, protos: DataFrame, k: int = 500, **kw) -> DataFrame:
    """Content selector: the top-K level-9 cells by score, refined, the most similar one wins; equal
    similarities go to the higher score. The K-limit comes before any vector is joined."""
    return pick_best(refine_in_cell(_by_score(scores, k), queries, protos, **kw))


def pick_best(refined: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    rest = [c for c in refined.columns if c not in by]
    best = refined.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct("top_similarity", -F.col("rank"))).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in rest])


def selector_sweep(scores: DataFrame, queries: DataFrame, protos: DataFrame, budgets: Sequence[int], **kw) -> DataFrame:
    """Selector result per candidate budget; vectors are compared once, for the largest."""
    refined = refine_in_cell(_by_score(scores, max(budgets)), queries, protos, **kw)
    each = (refined.withColumn("k", F.explode(F.array(*[F.lit(b) for b in budgets])))
            .where(F.col("rank") <= F.col("k")))
    return pick_best(each, ("query_id", "k"))


def refine_average(cands: DataFrame, queries: DataFrame, protos: DataFrame, n: int = 3, span_km: float = 100.0,
                   **kw) -> DataFrame:
    """Refine the top-n candidates (query_id, cell_idx, rank, prob); average by probability when all
    refined points lie near the first, else take the first."""
    refined = refine_in_cell(cands.where(F.col("rank") <= n), queries, protos, **kw)
    g = refined.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "lat", "lng", "prob", "n_used", "top_similarity"))).alias("r"))
    g = g.withColumn("a", F.element_at("r", 1))
    close = F.forall("r", lambda x: geo.haversine_km(F.col("a.lat"), F.col("a.lng"), x["lat"], x["lng"]) <= span_km)

    def weigh(field):
        return F.aggregate("r", F.lit(0.0), lambda s, x: s + (x["prob"] * x[field] if field else x["prob"]))

    g = g.withColumn("averaged", close & (F.size("r") > 1)).withColumn("w", weigh(None))
    return g.select("query_id",
                    F.when(F.col("averaged"), weigh("lat") / F.col("w")).otherwise(F.col("a.lat")).alias("lat"),
                    F.when(F.col("averaged"), weigh("lng") / F.col("w")).otherwise(F.col("a.lng")).alias("lng"),
                    F.size("r").cast("long").alias("refinements"), "averaged",
                    F.col("a.n_used").alias("n_used"), F.col("a.top_similarity").alias("top_similarity"))


def occlusion_drops(base: DataFrame, variants: DataFrame, protos: DataFrame) -> DataFrame:
    """Attribution table: base (query_id, cell_idx, embedding) against variants (query_id, view,
    block, embedding) by the best cosine in the selected cell; drops are cut at 0 and divided by the
    view's largest drop."""
    shared_dir(base.sparkSession)
    base = base.select("query_id", "cell_idx", "embedding").checkpoint()
    none = F.lit(-1)
    whole = base.select("query_id", none.alias("view"), none.alias("block"), "embedding")
    both = variants.select("query_id", "view", "block", "embedding").unionByName(whole)
    cands = both.select("query_id", "view", "block").join(base.select("query_id", "cell_idx"), "query_id")
    sims = in_cell_topk(cands, both, protos, 1, on=("query_id", "view", "block")).select("query_id", "view", "block", "sim")
    all_parts, view = Window.partitionBy("query_id"), Window.partitionBy("query_id", "view")
    return (sims.withColumn("base_sim", F.max(F.when(F.col("view") == -1, F.col("sim"))).over(all_parts))
            .where(F.col("view") >= 0)
            .withColumn("drop", F.greatest(F.lit(0.0), F.col("base_sim") - F.col("sim")))
            .withColumn("heat", F.col("drop") / (F.max("drop").over(view) + 1e-8))
            .select("query_id", "view", "block", "drop", "heat"))


def knn(queries: DataFrame, protos: DataFrame, k: int) -> DataFrame:
    """Exact nearest prototypes over the whole index: the same packs with one cell for everything."""
    one = F.lit(0).cast("long")
    cands = queries.select("query_id", one.alias("cell_idx"))
    return (in_cell_topk(cands, queries, protos.withColumn("cell_idx", one), k)
            .select("query_id", "vec_id", "sim", F.col("rn").cast("long").alias("rank")))


def index_report(vocab: DataFrame, protos: DataFrame) -> DataFrame:
    """Filled cells, share and mean prototypes per filled cell."""
    sizes = protos.groupBy("cell_idx").agg(F.count(F.lit(1)).alias("_n"))
    return (vocab.select(F.col("idx").alias("cell_idx")).join(sizes, "cell_idx", "left")
            .agg(F.count(F.lit(1)).alias("cells"), F.count("_n").alias("filled"),
                 F.coalesce(F.sum("_n"), F.lit(0)).alias("prototypes"))
            .withColumn("filled_pct", 100.0 * F.col("filled") / F.greatest("cells", F.lit(1)))
            .withColumn("per_cell", F.col("prototypes") / F.greatest("filled", F.lit(1))))


def merge_shards(shards: DataFrame) -> DataFrame:
    """Prototype rows of all shards (shard, level, part of the rows each); a shard number loaded from
    two files or a second level is an error raised by the job itself."""
    checks = shards.groupBy("shard").agg(F.count_distinct("file").alias("_files"), F.count_distinct("level").alias("_l"))
    bad = checks.agg(F.max("_files").alias("f"), F.max("_l").alias("l")).select(F.struct("*")).scalar()
    return shards.where(F.when(bad["f"] > 1, F.raise_error(F.lit("duplicate shard")).cast("boolean"))
                        .when(bad["l"] > 1, F.raise_error(F.lit("level mismatch")).cast("boolean"))
                        .otherwise(F.lit(True)))


def vector_mean(df: DataFrame, by: Sequence[str], vec: str) -> DataFrame:
    """Element-wise mean of vectors per group, combined map-side by (group, position)."""
    by = list(by)
    long = df.select(*by, F.posexplode(vec).alias("_p", "_x")).groupBy(*by, "_p").agg(F.avg("_x").alias("_x"))
    return (long.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_p", "_x"))).alias("_v"))
            .select(*by, F.transform("_v", lambda s: s["_x"]).alias(vec)))
