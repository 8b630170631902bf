"""Approximate vector search: inverted lists around trained centres, several lists probed, exact re-rank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cellselect.operators.retrieval import in_cell_topk, knn
from cellselect.session import shared_dir

#: Centres are broadcast: at most this many, whatever the index holds.
MOST_LISTS = 8192


def _rows(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    m = flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def train_centres(vectors: DataFrame, n_lists: int, sample: int = 131_072, rounds: int = 10) -> np.ndarray:
    """Unit centres (lists × dimension) of ``vectors`` (vec_id, embedding) by spherical k-means.

    Fitted on at most about ``sample`` vectors, chosen by a hash of the id; every round adds up the sample's
    vectors per nearest centre inside the tasks and moves the centres. The first centres are the vectors
    with the smallest hashes; a centre without vectors stays where it is. Fewer vectors than lists give as
    many lists as vectors.
    """
    spark = vectors.sparkSession
    shared_dir(spark)
    n_lists = min(n_lists, MOST_LISTS)
    place = F.xxhash64("vec_id", F.lit("centres"))
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    part = (vectors.select("vec_id", "embedding", place.alias("place")).where(F.pmod("place", F.lit(1 << 20)) < int(share * (1 << 20)))
            .repartition(max(1, min(n, sample) // 4096), "place").checkpoint())
    first = part.orderBy("place", "vec_id").limit(n_lists).toArrow()  # n_lists rows
    centres = _rows(first["embedding"].combine_chunks()) if first.num_rows else np.zeros((0, 1), np.float32)
    for _ in range(rounds if len(centres) else 0):
        centres = _moved(part, centres)
    return centres


def _moved(part: DataFrame, centres: np.ndarray) -> np.ndarray:
    shared = part.sparkSession.sparkContext.broadcast(centres)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shared.value.shape, np.float64)
        for batch in batches:
            m = _rows(batch["embedding"])
            np.add.at(sums, np.argmax(m @ shared.value.T, axis=1), m)
        some = np.flatnonzero(np.abs(sums).sum(1))
        yield pa.record_batch([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["list", "sums"])

    def join(table: pa.Table) -> pa.Table:
        total = np.sum(np.stack(table["sums"].to_numpy()), axis=0)
        return pa.table({"list": table["list"][:1], "sums": pa.array([total], pa.list_(pa.float64()))})

    schema = "list long, sums array<double>"
    rows = part.select("embedding").mapInArrow(add, schema).groupBy("list").applyInArrow(join, schema).toArrow()
    out = centres.astype(np.float64)
    if rows.num_rows:
        out[rows["list"].to_numpy()] = np.stack(rows["sums"].to_numpy())
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def probe_lists(df: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``df`` (with embedding) once for each of its ``probes`` nearest centres: the centre's number as
    ``cell_idx`` and its place among them as ``probe``, from 0."""
    shared = df.sparkSession.sparkContext.broadcast(centres)
    probes = max(1, min(probes, len(centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _rows(batch["embedding"]) @ shared.value.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            out = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), probes)))
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(best.ravel().astype(np.int64)), pa.array(np.tile(np.arange(probes), batch.num_rows))],
                names=[*batch.schema.names, "cell_idx", "probe"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("cell_idx", LongType()), StructField("probe", LongType())]))


def in_lists(protos: DataFrame, centres: np.ndarray) -> DataFrame:
    """The inverted lists: every vector with the number of its nearest centre as ``cell_idx``."""
    return probe_lists(protos.select("vec_id", "embedding", "lat", "lng"), centres, 1).drop("probe")


def probes_for(queries: DataFrame, protos: DataFrame, k: int, centres: np.ndarray, target: float = 0.95, sample: int = 256) -> int:
    """Fewest lists to probe so that ``target`` of the exact neighbours of ``sample`` queries, chosen by a hash,
    lie in them: those queries are searched exactly, and the place of each neighbour's list among the
    query's lists is counted."""
    some = queries.select("query_id", "embedding").orderBy(F.xxhash64("query_id", F.lit("probes")), "query_id").limit(sample).checkpoint()
    where = in_lists(protos, centres).select("vec_id", "cell_idx")
    order = probe_lists(some, centres, len(centres)).select("query_id", "cell_idx", "probe")
    places = knn(some, protos, k).select("query_id", "vec_id").join(where, "vec_id").join(order, ["query_id", "cell_idx"])
    counts = dict(places.groupBy("probe").count().collect())  # at most a row per list
    need, have = target * sum(counts.values()), 0
    for p in range(len(centres)):
        have += counts.get(p, 0)
        if have >= need:
            return p + 1
    return len(centres)


def approx_knn(queries: DataFrame, protos: DataFrame, k: int, n_lists: int = 1024, probes: int | None = None,
               centres: np.ndarray | None = None) -> DataFrame:
    """(query_id, vec_id, sim, rank): the k most similar of the vectors in each query's nearest lists.

    Every vector of ``protos`` (vec_id, embedding, lat, lng) lies in the list of its nearest centre, whose
    vectors are compared exactly; only those of the probed lists move. ``centres`` may be trained once and
    kept; without ``probes`` their number is measured (``probes_for``). Queries without any candidate give
    no row.
    """
    shared_dir(queries.sparkSession)
    if centres is None:
        centres = train_centres(protos, n_lists)
    if not len(centres):
        return queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("sim"), F.lit(0).cast("long").alias("rank")).limit(0)
    if probes is None:
        probes = probes_for(queries, protos, k, centres)
    cands = probe_lists(queries.select("query_id", "embedding"), centres, probes).select("query_id", "cell_idx")
    best = in_cell_topk(cands, queries, in_lists(protos, centres), k)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "vec_id")  # at most probes × k rows a query
    return (best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
            .select("query_id", "vec_id", "sim", "rank"))


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, k, found, recall): how many of a query's exact neighbours the approximate search has."""
    hit = approx.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return (exact.select("query_id", "vec_id").join(hit, ["query_id", "vec_id"], "left").groupBy("query_id")
            .agg(F.count(F.lit(1)).alias("k"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("k")))
